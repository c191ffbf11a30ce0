"""A key that many rows repeat counts once in a bounded sample."""

from pyspark.sql import functions as F

from docloom.llm import toxicity, vector_tree
from docloom.llm.common import bounded_sample


def hottest(spark, n, *columns):
    """The id among 0 to n - 1 whose hash sorts first."""
    ids = spark.range(n).select(F.col("id").alias("k"))
    return ids.orderBy(F.xxhash64("k", *columns)).first().k


def test_a_repeated_key_leaves_room_for_others(spark):
    hot = hottest(spark, 100, F.lit(1))
    rows = spark.createDataFrame([(i, 1) for i in range(100)] + [(hot, 1)] * 60, "doc_id long, label int")
    got = {r.doc_id for r in bounded_sample(rows, 40, "doc_id", "label").collect()}
    want = {r.doc_id for r in bounded_sample(rows.distinct(), 40, "doc_id", "label").collect()}
    assert got == want and len(got) == 40


def test_a_repeated_label_doesn_t_hide_the_other_class(spark):
    hot = hottest(spark, 120, F.lit(0))
    labels = [(i, int(i % 2 == 1 and i != hot)) for i in range(120)]
    texts = spark.createDataFrame([(i, "you vile stinking wretch" if toxic else f"a calm plain sentence {i}") for i, toxic in labels], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(hot, 0)] * 80, "doc_id long, toxic int")
    model = toxicity.train(texts, known, limit=60)
    assert model is not None


def test_a_repeated_vector_leaves_room_in_the_tree(spark, monkeypatch):
    seen, grow = [], vector_tree.grow
    monkeypatch.setattr(vector_tree, "grow", lambda x, *more: seen.append(len(x)) or grow(x, *more))
    hot = hottest(spark, 100)
    rows = [(i, [1.0 + i, 2.0, 3.0 + i % 7]) for i in [*range(100), *[hot] * 60]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vector_tree.search(vectors, F.col("vec_id") % 10 == 0, 3, sample=40)
    assert seen == [40]
