"""Balanced contiguous shards by global byte-size prefix sums.

The rows are range-partitioned in id order, each partition gives one total, and the
running sum of these totals (one row per partition) starts the running sum inside each
partition.  The byte axis is cut at equal targets, so shards are contiguous in the id
order and differ by less than two documents' bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Workspace, partitions


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the UTF-8 length plus 8 (null text: 8, checksum 0).  Null ids come first;
    rows with equal ids are ordered by checksum and size; repeated rows each get a slot.
    An empty table gives an empty result, and with fewer rows than shards some shards
    stay empty.  Other columns of the table are ignored.  Law `bytes`: a row belongs to
    the shard in whose share of the byte axis its middle lies.
    """
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("long")
    slim = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(F.col(text_col)), F.lit(0).cast("long")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    # Two small tables (about 20 bytes a row): the text is read once, and the range
    # bounds, which Spark samples anew for each run of a plan, are fixed by the second.
    ws = Workspace(spark)
    ranged = ws.store(slim, "sizes").repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    ranged = ws.store(ranged, "ranges")
    ws.drop("sizes")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.sum("b").over(every).alias("total"),
    )  # one row per partition of the range shuffle, so small enough to broadcast
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.join(F.broadcast(starts), "part")
        .withColumn("before", F.col("b0") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("rank", F.col("n0") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (2 * before + size) * {shards} div (2 * total)) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard, rows in slot order.

    Needs unique ids; rows whose id is null or repeated are refused.
    """
    bad = docs.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1)
    if bad.take(1):
        raise ValueError("write_shards needs ids that are unique and not null")
    placed = shard(docs, shards, id_col).select(F.col("doc_id").alias(id_col), "shard", "slot")
    docs.join(placed, id_col).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
