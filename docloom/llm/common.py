"""Shared helpers: table reading, the shared work folder, bounded samples, hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; keeps a batch of long texts small.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of very long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


#: Stands for a null id inside Python steps, where null would make a column of floats.
NO_ID = -(2**63)


def id_in(column: str, alias: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(alias)


def id_out(df: DataFrame, column: str = "doc_id") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) != NO_ID, F.col(column)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where driver and executors are one process (tests) and none is named, a temporary
    folder is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def trim() -> None:
    """Give memory that a worker has freed back to the machine: workers live on between
    stages, and each would keep its largest."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class Workspace:
    """Tables of one run of an operator, written in the shared folder and read back.

    They cut the lineage: a lost executor repeats only what came after the last one.
    drop() deletes those that nothing reads any more, so disk holds what is in use.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths, self.tables = spark, f"{work_dir(spark)}/docloom-{uuid.uuid4().hex}", {}, {}

    def _path(self, name: str) -> str:
        self.paths[name] = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        return self.paths[name]

    def store(self, df: DataFrame, name: str) -> DataFrame:
        old = self.paths.get(name)
        path = self._path(name)
        df.write.option("compression", "zstd").parquet(path)
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Bucketed by key: later joins on key don't shuffle this side."""
        path, table = self._path(name), f"docloom_{name}_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            if name in self.paths:
                self._delete(self.paths.pop(name))

    def keep_only(self, *names: str) -> None:
        """Drop all other tables, and let executors delete the shuffle files of past steps."""
        self.drop(*[n for n in [*self.paths, *self.tables] if n not in names])
        self.release()

    def release(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public xorshift-multiply form)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x9FB21C651E98DF25)
        x = x ^ (x >> np.uint64(28))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k symbols, by doubling: O(len * log k) steps."""
    with np.errstate(over="ignore"):
        level = mix(h.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        out, width, left = None, 1, k
        while left:
            if left & 1:
                if out is None:
                    out, done = level, width
                else:
                    n = len(out) - width
                    out = mix(out[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + level[done : done + n])
                    done += width
            left >>= 1
            if left:
                n = len(level) - width
                level = mix(level[:n] * np.uint64(0x9E3779B97F4A7C15) + level[width:])
                width *= 2
        return out[: len(h) - k + 1]


def bounded_sample(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The rows of at most `limit` distinct keys, chosen by a hash: the same in every run.

    Each key counts once, however many rows repeat it.  Only the keys are sorted; fit
    models on this, never use it for corpus statistics.
    """
    # A hash keeps about three times as many keys as wanted, so that no task sorts many more.
    n = df.agg(F.approx_count_distinct(F.xxhash64(*keys), 0.03)).first()[0] or 1
    some = df.select(*keys).filter(F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(1 << 31)) <= int(min(1.0, 3 * limit / n) * (1 << 31)))
    slim = some.distinct().withColumn("_h", F.xxhash64(*keys)).orderBy("_h", *keys).limit(limit).drop("_h")
    return df.join(F.broadcast(slim), list(keys), "left_semi")


#: Largest bitmap of possible_members(), in bits: 16 MB, whatever the number of ids.
MOST_BITS, CHUNK_BYTES = 1 << 27, 1 << 16


def possible_members(ids: DataFrame, column: str):
    """A test on a column of longs: false only for values that `ids` doesn't hold.

    A one-hash Bloom filter of bounded size, so a join with few ids needn't shuffle the
    rows that can't match.  Nulls give false.
    """
    n = ids.count()
    bits = 1 << 16
    while bits < min(32 * n, MOST_BITS):
        bits *= 2

    def places(values) -> np.ndarray:
        return (mix(np.asarray(values, np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)

    def build(batches):
        own = np.zeros(bits // 8, np.uint8)
        for pdf in batches:
            at = places(pdf[column])
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = own.reshape(-1, min(CHUNK_BYTES, bits // 8))
        used = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"chunk": used.astype(np.int32), "bits": [parts[i].tobytes() for i in used]})

    def merge(pdf):
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()]})

    schema = "chunk int, bits binary"
    bitmap = np.zeros((bits // 8 // min(CHUNK_BYTES, bits // 8), min(CHUNK_BYTES, bits // 8)), np.uint8)
    for r in ids.select(F.col(column).cast("long").alias(column)).filter(F.col(column).isNotNull()).mapInPandas(build, schema).groupBy("chunk").applyInPandas(merge, schema).collect():
        bitmap[r.chunk] = np.frombuffer(bytes(r.bits), np.uint8)
    bitmap = bitmap.ravel()

    def test(values: pd.Series) -> pd.Series:
        at = places(values)
        return pd.Series(((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))

    udf = F.pandas_udf(test, "boolean")
    return lambda c: c.isNotNull() & udf(F.coalesce(c, F.lit(0).cast("long")))
