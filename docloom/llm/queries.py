"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, html_text, language_id, mixing, near_dup, oracles, order_minhash, sharding, suffix_dedup, toxicity, vector_tree
from docloom.llm.common import read


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), 24)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(read(spark, sf_dir, "documents"), rule=order_minhash.order_fingerprint)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources flattened until the rarest is drawn twice as often as the commonest."""
    drawn = mixing.mix(read(spark, sf_dir, "documents"), repeat=2.0, keep=("doc_id", "source"))
    return drawn.withColumn("weight", F.round("weight", 8)).withColumn("place", F.round("place", 8))


def op4_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary_path())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_order_minhash, op3_mixing, op4_vector_tree, op5_near_dup, op6_html_text, op7_toxicity, op8_suffix_dedup, op9_bpe, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": oracles.SHARDING, "op3_mixing": oracles.MIXING, "op5_near_dup": oracles.NEAR_DUP, "op8_suffix_dedup": oracles.REPEATS}
