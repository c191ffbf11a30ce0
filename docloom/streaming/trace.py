"""Trace roll-up and page states over Structured Streaming.

The batch operators have no clock; these are additions.  Late events are dropped after
the watermark, and state is bounded by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas
from docloom.operators.state import PAGE_EDGES


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace events of a folder of JSON lines, as a stream."""
    return spark.readStream.schema(schemas.TRACE + ", ts timestamp").json(path)


def windowed_rollup(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, event, runs, duration_ms of tumbling (or sliding) windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event")
    return g.agg(F.count(F.lit(1)).alias("runs"), F.sum("duration_ms").alias("duration_ms")).select(F.col("w.start").alias("start"), "event", "runs", "duration_ms")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """page, start, end, runs: a page's bursts of events, parted by `gap`."""
    g = events.withWatermark("ts", late).groupBy("page", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("runs")).select("page", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "runs")


def page_states(targets: DataFrame, start: str = "pending") -> DataFrame:
    """page, state, applied, rejected: legal edges move a page's state, others are counted.

    targets: a stream of page, seq, state.  State is one row a page; within a batch a
    page's targets are applied in `seq` order.
    """
    legal = {(a, b) for a, to in PAGE_EDGES.items() for b in to}

    def step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, applied, rejected = held.get if held.exists else (start, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for target in rows["state"]:
            if (state, target) in legal:
                state, applied = target, applied + 1
            else:
                rejected += 1
        held.update((state, applied, rejected))
        yield pd.DataFrame({"page": [key[0]], "state": [state], "applied": [applied], "rejected": [rejected]})

    out = "page long, state string, applied long, rejected long"
    return targets.groupBy("page").applyInPandasWithState(step, out, "state string, applied long, rejected long", "update", "NoTimeout")


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its result table (for tests and small jobs)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
