"""First-wins, best-by-key and budget operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import quality as q
from docloom.functions import text as t


def pixel_owner(claims: DataFrame) -> DataFrame:
    """page, y, x, owner: highest z wins, then the smaller area, then the lower ordinal.

    claims: page, owner, z, ord, y, x; areas are counted here.  max_by combines before the
    shuffle, so a pixel that many masks claim isn't a hot group.
    """
    size = claims.groupBy("page", "owner").agg(F.count(F.lit(1)).alias("pixels"))
    rank = F.struct(F.col("z"), (-F.col("pixels")).alias("a"), (-F.col("ord")).alias("o"))
    return claims.join(size, ["page", "owner"]).groupBy("page", "y", "x").agg(F.max_by("owner", rank).alias("owner"))


def first_claim(claims: DataFrame, descending: bool = True) -> DataFrame:
    """page, y, x, owner: the claim of the last (or first) position takes the pixel."""
    pick = F.max_by if descending else F.min_by
    return claims.groupBy("page", "y", "x").agg(pick("owner", "ord").alias("owner"))


def top_per_page(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of each page in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("page").orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def by_area(regions: DataFrame, least: int = 0) -> DataFrame:
    """Regions of at least `least` pixels with their place by falling area: rank from 1."""
    w = Window.partitionBy("page").orderBy(F.desc("pixels"), "ord")
    return regions.filter(F.col("pixels") >= least).withColumn("rank", F.row_number().over(w))


def budget_prefix(rows: DataFrame, most_rows: int, most_cost: int) -> DataFrame:
    """The rows of each page, in order, that stay inside a count and a cost budget.

    rows: page, ord, cost.  The first row over the cost ends the prefix.
    """
    w = Window.partitionBy("page").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("spent", F.sum("cost").over(w)).filter((F.col("n") <= most_rows) & (F.col("spent") <= most_cost))


def progress(rounds: DataFrame) -> DataFrame:
    """page, round, progressed: a smaller quality key, or newly accepted, than the round before.

    rounds: page, round, accepted and the key's parts largest, unexplained, violations, mae, p95.
    """
    zero = F.lit(0)
    key = q.progress_key(F.col("largest"), F.col("unexplained"), F.col("violations"), zero, zero, zero, zero, F.col("mae"), F.col("p95"))
    w = Window.partitionBy("page").orderBy("round")
    r = rounds.withColumn("key", key).withColumn("before", F.lag("key").over(w)).withColumn("was", F.lag("accepted").over(w))
    better = F.col("before").isNull() | (F.col("key") < F.col("before")) | (F.col("accepted") & ~F.coalesce("was", F.lit(False)))
    return r.select("page", "round", better.alias("progressed"))


def may_continue(rounds: DataFrame, most: int = 5) -> DataFrame:
    """page, next_round, allowed: one more round follows progress, below the round limit."""
    last = progress(rounds).groupBy("page").agg(F.max(F.struct("round", "progressed")).alias("m"))
    return last.select("page", (F.col("m.round") + 1).alias("next_round"), (F.col("m.progressed") & (F.col("m.round") + 1 < most)).alias("allowed"))


def compatibility_reasons(h: dict[str, Column], need: dict[str, Column]) -> Column:
    """Names of what a machine lacks for a catalog entry, in fixed order."""
    short = lambda a, b: F.coalesce(h[a], F.lit(0.0)) < need[b]
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(h["cuda"], F.lit(False)), F.lit("cuda")),
            F.when(short("vram", "minimum_vram"), F.lit("vram")),
            F.when(short("free_vram", "minimum_free_vram"), F.lit("free_vram")),
            F.when(short("ram", "minimum_ram"), F.lit("ram")),
            F.when(short("free_ram", "minimum_free_ram"), F.lit("free_ram")),
            F.when(short("disk", "minimum_disk"), F.lit("disk")),
        )
    )


def recommend(offers: DataFrame) -> DataFrame:
    """host, model, compatible: the first compatible offer by priority, else the first.

    offers: host, model, priority, reasons array<string>.
    """
    fits = F.size("reasons") == 0
    return offers.groupBy("host").agg(F.max_by(F.struct("model", fits.alias("compatible")), F.struct(fits.cast("int"), "priority")).alias("m")).select("host", "m.model", "m.compatible")


def dependency_report(installed: DataFrame, needed: DataFrame) -> DataFrame:
    """package, version, minimum, compatible; needed: package, minimum; installed: package, version."""
    return needed.join(installed, "package", "left").select("package", "version", "minimum", t.version_compatible(F.col("version"), F.col("minimum")).alias("compatible"))


def environment_ready(checks: DataFrame) -> DataFrame:
    """host, ready, missing: all required checks hold; checks: host, name, required, ok."""
    return checks.groupBy("host").agg(F.bool_and(~F.col("required") | F.col("ok")).alias("ready"), F.array_sort(F.collect_set(F.when(F.col("required") & ~F.col("ok"), F.col("name")))).alias("missing"))


def next_item(handshakes: DataFrame, requests: DataFrame) -> DataFrame:
    """run, kind, item: an open handshake first, then the earliest open request."""
    both = handshakes.select("run", F.lit(0).alias("kind"), F.col("item")).unionAll(requests.select("run", F.lit(1).alias("kind"), F.col("item")))
    best = both.groupBy("run").agg(F.min(F.struct("kind", "item")).alias("m"))
    return best.select("run", F.when(F.col("m.kind") == 0, "handshake").otherwise("request").alias("kind"), F.col("m.item").alias("item"))


def choose_fill(candidates: DataFrame) -> DataFrame:
    """page, name: the fill of least (violations, worst ratio, summed ratio, ord).

    candidates: page, ord, name, seam, gradient, detail, and their limits l_*.
    """
    c = F.col
    ratios = [c(n) / c(f"l_{n}") for n in ("seam", "gradient", "detail")]
    over = sum((F.when(r > 1, 1).otherwise(0) for r in ratios), F.lit(0))
    return candidates.groupBy("page").agg(F.min_by("name", F.struct(over.alias("v"), F.greatest(*ratios).alias("m"), (ratios[0] + ratios[1] + ratios[2]).alias("s"), c("ord"))).alias("name"))


def choose_route(candidates: DataFrame) -> DataFrame:
    """page, node, route: text before an allowed native shape before raster; none: problem.

    candidates: page, node, kind, allowed (for native shapes).
    """
    place = F.when(F.col("kind") == "editable_text", 3).when((F.col("kind") == "native_shape") & F.col("allowed"), 2).when(F.col("kind") == "raster", 1).otherwise(0)
    best = candidates.groupBy("page", "node").agg(F.max(place).alias("p"))
    return best.select("page", "node", F.when(F.col("p") == 3, "editable_text").when(F.col("p") == 2, "native_shape").when(F.col("p") == 1, "raster").otherwise("none").alias("route"))


def fallback_routes(routes: DataFrame, failed: DataFrame) -> DataFrame:
    """Routes with those of the failed nodes replaced by raster."""
    hit = failed.select("page", "node").distinct().withColumn("_f", F.lit(True))
    return routes.join(hit, ["page", "node"], "left").withColumn("route", F.when(F.col("_f"), "raster").otherwise(F.col("route"))).drop("_f")


def routed_elements(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Visual elements in drawing order: texts are left out; page, node, route, z, place."""
    both = routes.filter("route not in ('editable_text', 'none')").join(nodes.select("page", "node", "z", "ord"), ["page", "node"])
    return both.select("page", "node", "route", "z", F.row_number().over(Window.partitionBy("page").orderBy("z", "ord")).alias("place"))


def fresh_ids(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows with ids above all of their page's: page, ord, new_id."""
    top = existing.groupBy("page").agg(F.max("id").alias("top"))
    w = Window.partitionBy("page").orderBy("ord")
    return incoming.join(top, "page", "left").select("page", "ord", (F.coalesce("top", F.lit(0)) + F.row_number().over(w)).alias("new_id"))


def free_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """name, free: the name itself, or its first free numeric suffix before the extension.

    Names are made unique against `taken` (column name) and numbered from 2.
    """
    stem = F.regexp_replace("name", r"\.[^./]*$", "")
    ext = F.regexp_extract("name", r"(\.[^./]*)$", 1)
    used = taken.select(F.col("name").alias("_t")).distinct()
    tries = names.select("name", F.explode(F.concat(F.array("name"), F.transform(F.sequence(F.lit(2), F.lit(100)), lambda i: F.concat(stem, F.lit("_"), i.cast("string"), ext)))).alias("free"))
    tries = tries.withColumn("n", F.when(F.col("free") == F.col("name"), 1).otherwise(F.regexp_extract("free", r"_(\d+)(?:\.[^./]*)?$", 1).cast("int")))
    return tries.join(used, F.col("free") == F.col("_t"), "left_anti").groupBy("name").agg(F.min_by("free", "n").alias("free"))
