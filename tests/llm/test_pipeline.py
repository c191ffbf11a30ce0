"""run() against a plain version of each stage, stage by stage, on small tables."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import queries, suffix_dedup, toxicity
from tests.llm.test_dedup import brute_classes, brute_repeats, near_copies, passages
from tests.llm.test_models import brute_mix, corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in corpus()[:400]]
    for n, (_, t) in enumerate(near_copies()[:150]):
        rows.append((2000 + n, t, "en", f"s{n % 5}", len(t or "")))
    for n, t in enumerate(passages()):
        rows.append((4000 + n, t, "en", None if n % 9 == 0 else "p", len(t or "")))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(path / "documents.parquet"))
    labels = [(r[0], 1, int(r[5] == "True")) for r in corpus()[:400]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows


def test_run_equals_plain_stages(spark, folder):
    from tokenizers import Tokenizer

    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.severity(docs, model).filter("toxic").collect()}
    assert bad == {i for i in range(400) if i % 5 == 0}
    kept = {r[0]: r for r in rows if r[0] not in bad}
    classes = brute_classes([(i, r[1]) for i, r in kept.items()], 5, 80, 100)
    kept = {i: r for i, r in kept.items() if classes[i][1] == i}
    order = sorted(kept)
    removed = brute_repeats([kept[i][1] for i in order], suffix_dedup.LENGTH)
    texts = {}
    for i, (n, gone, _, _) in zip(order, removed, strict=True):
        texts[i] = kept[i][1] if not gone else None
    stage2 = [kept[i] for i in order]
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, spark.createDataFrame(stage2, DOCS), path).collect()}
    for i, (n, gone, _, _) in zip(order, removed, strict=True):
        if not gone:
            assert cut[i] == kept[i][1]
        else:
            assert n - gone <= len(cut[i].encode()) <= n - gone + 6 * (gone // suffix_dedup.LENGTH + 1)
    stage3 = [(i, cut[i], *kept[i][2:4], len(cut[i] or "")) for i in order]
    drawn, _ = brute_mix(stage3, 2.0)
    tok = Tokenizer.from_file(queries.vocabulary_path())
    want = Counter()
    for i in order:
        ids = tok.encode(cut[i] or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] = drawn[i]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, path).collect())
    assert got == want


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and [k for _, k in out.dtypes] == [k for _, k in docs.dtypes]


def test_stages_on_an_empty_table(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_stages_pass_on_columns_with_clashing_names(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as toxic", "2 as label", "3 as epoch", "'x' as k", "4 as copies", "5 as new")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() > 0
