"""Connected components of a graph of any size by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Workspace


def _lower_first(edges: DataFrame) -> DataFrame:
    a, b = F.greatest("a", "b"), F.least("a", "b")
    return edges.select(a.alias("a"), b.alias("b")).filter("a > b").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Each node has one smaller neighbour, or only larger ones."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").limit(1).take(1)


def components(edges: DataFrame, ws: Workspace | None = None, name: str = "edges") -> DataFrame:
    """Edges (a, b), both long -> (node, label): the smallest node reachable.

    Nodes without an edge to another don't appear.  Each round replaces every node's
    neighbours by the smallest one (large star, then small star); the rounds grow with
    the logarithm of the size.  Minima are partial aggregates and the joins that follow
    are sort-merge joins, which adaptive execution splits at hubs; none is broadcast, as the
    planner knows only the size of the compressed edges.
    """
    ws = ws or Workspace(edges.sparkSession)
    e = ws.store(_lower_first(edges), name)
    while not _is_stars(e):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").unionAll(low.select("a", F.col("m").alias("b")))
        e = ws.store(small.distinct(), name)
    return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
