"""The corpus pipeline: five stages, each one operator of docloom.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows
and ids, and empty tables (no rows come out).  Null and empty texts are clean, copies of
nothing and hold no repeated string, so they stay; mixing counts them as one token; they
have no token ids.  Of repeated rows stage 2 keeps one; an id with several texts keeps each
that isn't near to a kept one.  The stages up to mixing return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, mixing, near_dup, suffix_dedup, toxicity
from docloom.llm.common import read, work_dir
from docloom.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels, rejects go."""
    return toxicity.reject(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, likeness 0.8)."""
    return near_dup.deduplicate(docs, words=5, num=80, den=100)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that start more than once are cut out."""
    return suffix_dedup.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn up to twice as often as the largest; each document at least once."""
    return mixing.draw(docs, repeat=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, for each time it is drawn."""
    return bpe.encode(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: Fitted models and iterative graphs have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written in the shared folder."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    path = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{path}/{name}")
    return docs
