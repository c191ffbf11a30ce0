"""Temperature mixing of sources, with DataFrame and SQL functions only.

Source token shares p are raised to an exponent and normalised, w ~ p^a: a = 1 keeps the
shares, a = 0 makes sources equal.  The exponent is found by bisection, each step one
small aggregation over the table of sources, so that the weights' entropy reaches a
target or the most repeated source isn't repeated more often than a limit.  A token
budget is then realised in whole blocks: a block is one permutation of all documents of
a source; a source gets as many whole blocks as its weight buys and the start of one
more.  Running sums over a permutation are made in two levels, so a source of any size
is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Workspace

#: Fixed values of the word rule: runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
PASSES = 10


def tokens(text: Column) -> Column:
    """At least 1, so that documents without words can be dealt too."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)), F.lit(1)).cast("long")


def source_weights(sources: DataFrame, entropy: float | None = None, repeat: float | None = None) -> DataFrame:
    """source, tokens -> source, tokens, exponent, weight, quota (tokens to draw).

    Give one target: `entropy`, the wanted entropy as a share of the largest possible
    (log of the number of sources), or `repeat`, the most often that a source's
    documents may be drawn.  The budget is the smallest with which every source is drawn
    once in full, so no document is lost: quota = tokens of the least repeated source /
    its weight * weight.
    """
    if (entropy is None) == (repeat is None):
        raise ValueError("give either entropy or repeat")
    lo, hi = 0.0, 1.0
    total = sources.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total.n:
        return sources.select("source", "tokens", F.lit(1.0).alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    share = F.col("tokens") / float(total.t)
    for _ in range(PASSES):  # each pass halves the interval three times, with one aggregation
        tried = [lo + (hi - lo) * i / 8 for i in range(1, 8)]
        powers = [F.pow(share, F.lit(a)) for a in tried]
        got = sources.agg(F.array(*[F.sum(p) for p in powers]), F.array(*[F.sum(p * F.log(p)) for p in powers]), F.array(*[F.max(p / share) / F.min(p / share) for p in powers])).first()
        for a, z, zl, most in zip(tried, *got, strict=True):
            # Both the entropy and the repetition fall as the exponent rises.
            if (math.log(z) - zl / z >= entropy * math.log(total.n)) if entropy is not None else (most > repeat):
                lo = a
            else:
                hi = a
                break
    a = lo if entropy is not None else hi
    p = F.pow(share, F.lit(a))
    z, least = sources.agg(F.sum(p), F.min(p / share)).first()
    weighted = sources.withColumn("exponent", F.lit(a)).withColumn("weight", p / z)
    return weighted.withColumn("quota", F.greatest(F.col("tokens"), F.round(F.col("tokens") * (p / share / least), 3).cast("decimal(38,3)").cast("long")))


def mix(docs: DataFrame, entropy: float | None = None, repeat: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), seed: int = 17) -> DataFrame:
    """A row each time a document is drawn: the `keep` columns, then n_tokens, epoch,
    weight, place.

    epoch counts the permutations of a source, from 0; `place`, in [0, 1), is the
    document's place in the mixture, in which the sources are interleaved evenly: order
    by (place, source, doc_id).  A document without words counts one token; null sources
    are a source of their own; rows with equal ids are drawn together; in the last,
    partial permutation documents are drawn while the tokens before them are fewer than
    the rest of the quota.  An empty table gives an empty result; columns that `keep`
    doesn't name are ignored.
    """

    rows = _drawn(docs, entropy, repeat, id_col, text_col, source_col, keep, seed)
    return rows.select(*keep, F.col("_mx_tokens").alias("n_tokens"), F.col("_mx_epoch").cast("int").alias("epoch"), F.col("_mx_weight").alias("weight"), F.col("_mx_place").alias("place"))


def draw(docs: DataFrame, entropy: float | None = None, repeat: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as mix() draws it."""
    return _drawn(docs, entropy, repeat, id_col, text_col, source_col, tuple(docs.columns), seed).select(*docs.columns)


def _drawn(docs: DataFrame, entropy: float | None, repeat: float | None, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...], seed: int) -> DataFrame:
    def turn(epoch: Column) -> Column:  # a document's place in one of its source's permutations
        return F.md5(F.concat_ws(":", F.coalesce(F.col("_mx_id").cast("string"), F.lit("")), epoch.cast("string"), F.lit(str(seed))))

    own = [F.col(id_col).cast("long").alias("_mx_id"), F.col(source_col).cast("string").alias("_mx_source"), tokens(F.col(text_col)).alias("_mx_tokens")]
    ws = Workspace(docs.sparkSession)
    slim = ws.store(docs.select(*own), "tokens")
    totals = ws.store(slim.groupBy("_mx_source").agg(F.sum("_mx_tokens").alias("tokens")).withColumnRenamed("_mx_source", "source"), "sources")
    weights = ws.store(source_weights(totals, entropy, repeat), "weights")
    known = weights.select(F.col("source").alias("_mx_s"), F.col("weight").alias("_mx_weight"), F.expr("quota div tokens").alias("_mx_whole"), F.expr("quota % tokens").alias("_mx_rest"), (F.col("quota") / F.col("tokens")).alias("_mx_scale"))
    same = F.col("_mx_source").eqNullSafe(F.col("_mx_s"))
    last = slim.join(known, same).filter("_mx_rest > 0").withColumn("h", turn(F.col("_mx_whole"))).withColumn("cell", F.substring("h", 1, 3))
    before = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    cells = last.groupBy(F.col("_mx_source").alias("s"), F.col("cell").alias("c")).agg(F.sum("_mx_tokens").alias("t"))  # at most 4096 rows a source
    cells = cells.select("s", "c", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    inside = Window.partitionBy("_mx_source", "cell").orderBy("h", "_mx_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = last.withColumn("t1", F.coalesce(F.sum("_mx_tokens").over(inside), F.lit(0))).join(cells, F.col("_mx_source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    # One row a source: the last place that its partial permutation reaches.
    cut = placed.filter(F.col("t0") + F.col("t1") < F.col("_mx_rest")).groupBy(F.col("_mx_source").alias("_mx_c")).agg(F.max("h").alias("_mx_cut"))
    known = ws.store(known.join(cut, F.col("_mx_s").eqNullSafe(F.col("_mx_c")), "left").drop("_mx_c"), "cuts")
    ws.drop("tokens", "sources", "weights")
    rows = docs.select(*keep, *own).join(known, same)
    epochs = F.col("_mx_whole") - F.when(turn(F.col("_mx_whole")) <= F.col("_mx_cut"), F.lit(0)).otherwise(F.lit(1))
    rows = rows.withColumn("_mx_epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
    part = F.conv(F.substring(turn(F.col("_mx_epoch")), 1, 12), 16, 10).cast("double") / float(16**12)
    place = F.least((F.col("_mx_epoch") + part) / F.col("_mx_scale"), F.lit(1 - 2**-40))
    return rows.withColumn("_mx_place", place)
