"""Joins of boxes, texts, masks and records.

Box joins never compare all pairs of a page: boxes are dealt to the grid cells that they
touch, joined on (page, cell), and a pair is kept only in the cell that holds the top
left corner of its overlap, so it comes out once.  A crowded page is thus many small
groups, and the shuffle grows with the boxes, not with their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as g
from docloom.functions import text as t

#: Width and height of a cell for boxes of any shape, and for lines of text, which are wide
#: and flat: a line stays in one or two cells, and its text with it.
CELL, LINE_CELL = (128, 128), (2048, 128)


def _cells(df: DataFrame, cell: tuple[int, int]) -> DataFrame:
    low = lambda c, size: F.floor(F.col(c) / size).cast("long")
    high = lambda a, b, size: F.greatest(low(a, size), F.floor((F.ceil(F.col(a) + F.col(b)) - 1) / size).cast("long"))
    return df.withColumn("_gx", F.explode(F.sequence(low("x", cell[0]), high("x", "w", cell[0])))).withColumn("_gy", F.explode(F.sequence(low("y", cell[1]), high("y", "h", cell[1]))))


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("page",), cell: tuple[int, int] = CELL) -> DataFrame:
    """Pairs of size boxes (x, y, w, h) of equal keys whose insides meet.

    left's columns become l_*, right's r_*; the keys keep their names.
    """
    a = _cells(left, cell).select(*keys, "_gx", "_gy", *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys])
    b = _cells(right, cell).select(*keys, "_gx", "_gy", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    c = F.col
    x1, y1 = F.greatest("l_x", "r_x"), F.greatest("l_y", "r_y")
    meet = (x1 < F.least(c("l_x") + c("l_w"), c("r_x") + c("r_w"))) & (y1 < F.least(c("l_y") + c("l_h"), c("r_y") + c("r_h")))
    own = (F.floor(x1 / cell[0]) == c("_gx")) & (F.floor(y1 / cell[1]) == c("_gy"))
    return a.join(b, [*keys, "_gx", "_gy"]).filter(meet & own).drop("_gx", "_gy")


def corner_columns(prefix: str) -> tuple:
    return g.corners(*[F.col(f"{prefix}{n}") for n in ("x", "y", "w", "h")])


def bbox_relations(boxes: DataFrame) -> DataFrame:
    """page, a, b, relation: contains (a holds b), or overlaps (both ways).

    boxes: page, ord, x, y, w, h.  Equal boxes overlap.
    """
    slim = boxes.select("page", "ord", "x", "y", "w", "h")
    p = overlapping_pairs(slim, slim).filter("l_ord < r_ord")
    left, right = corner_columns("l_"), corner_columns("r_")
    rel = F.when(g.contains(left, right), 1).when(g.contains(right, left), 2).otherwise(0)
    one = lambda a, b, name: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(name).alias("relation"))
    rows = F.when(rel == 1, F.array(one("l_ord", "r_ord", "contains"))).when(rel == 2, F.array(one("r_ord", "l_ord", "contains"))).otherwise(F.array(one("l_ord", "r_ord", "overlaps"), one("r_ord", "l_ord", "overlaps")))
    return p.select("page", F.explode(rows).alias("r")).select("page", "r.a", "r.b", "r.relation")


def known_text(items: DataFrame, known: DataFrame, exact_only: bool = False) -> DataFrame:
    """Items that a known text matches (semi join): page, ord.

    Both: page, ord, x, y, w, h, text.  exact_only leaves out the similarity ratio, the
    one part that needs Python.
    """
    norm = t.compact_ascii if exact_only else t.compact
    a = items.select("page", "ord", "x", "y", "w", "h", norm(F.col("text")).alias("t"))
    b = known.select("page", "ord", "x", "y", "w", "h", norm(F.col("text")).alias("t"))
    p = overlapping_pairs(a, b, cell=LINE_CELL)
    c = F.col
    over = g.overlap_of_smaller([c(f"l_{n}") for n in "xywh"], [c(f"r_{n}") for n in "xywh"])
    short = F.least(F.length("l_t"), F.length("r_t"))
    held = (short >= 4) & (F.contains("l_t", "r_t") | F.contains("r_t", "l_t"))
    p = p.withColumn("over", over).filter("over >= 0.5")
    same = c("l_t") == c("r_t")
    sure = same | ((c("over") >= 0.8) & held)
    if exact_only:
        return p.filter(sure).select("page", F.col("l_ord").alias("ord")).distinct()
    most = F.greatest
    near = (
        (F.least("l_w", "r_w") / most(F.lit(1), "l_w", "r_w") >= 0.75)
        & (F.least("l_h", "r_h") / most(F.lit(1), "l_h", "r_h") >= 0.70)
        & (F.abs(c("l_x") + c("l_w") / 2 - c("r_x") - c("r_w") / 2) <= most("l_w", "r_w") * 0.20)
        & (F.abs(c("l_y") + c("l_h") / 2 - c("r_y") - c("r_h") / 2) <= most("l_h", "r_h") * 0.25)
    )
    # One pass over the pairs: texts go to Python only where the ratio decides, which is at
    # most twice the shorter text over both.
    long = most(F.length("l_t"), F.length("r_t"))
    least = F.when((long >= 20) & (short / most(F.lit(1), long) <= 0.75), 0.5).otherwise(0.88)
    p = p.withColumn("sure", F.coalesce(sure, F.lit(False)))
    p = p.filter(c("sure") | ((c("over") >= 0.8) & ~same & ~held & near & (2 * short / most(F.lit(1), short + long) >= least)))
    similar = t.similar(*[F.when(~c("sure"), c(s)) for s in ("l_t", "r_t")], least)
    return p.filter(c("sure") | similar).select("page", F.col("l_ord").alias("ord")).distinct()


def uncovered(diagnostics: DataFrame, items: DataFrame, least: float = 0.80) -> DataFrame:
    """Diagnostics (page, ord, x, y, w, h) that no text box covers by `least` (anti join)."""
    slim = ("page", "ord", "x", "y", "w", "h")
    p = overlapping_pairs(diagnostics.select(*slim), items.select(*slim))
    share = g.intersection(corner_columns("l_"), corner_columns("r_")) / F.greatest(F.lit(1), F.col("l_w") * F.col("l_h"))
    hit = p.filter(share >= least).select("page", F.col("l_ord").alias("ord")).distinct()
    return diagnostics.join(hit, ["page", "ord"], "left_anti")


def unowned_text_check(diagnostics: DataFrame, items: DataFrame) -> DataFrame:
    """page, check: fail where a diagnostic is uncovered, else pass."""
    bad = uncovered(diagnostics, items).groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    return diagnostics.select("page").distinct().join(bad, "page", "left").select("page", F.when(F.col("n") > 0, "fail").otherwise("pass").alias("check"))


def best_owner(items: DataFrame, owners: DataFrame, least: float = 0.2) -> DataFrame:
    """page, ord, owner: the box with the largest overlap (ties: the smallest ord), if its
    share of the item reaches `least`."""
    slim = ("page", "ord", "x", "y", "w", "h")
    p = overlapping_pairs(items.select(*slim), owners.select(*slim))
    both = g.intersection(corner_columns("l_"), corner_columns("r_"))
    best = p.groupBy("page", F.col("l_ord").alias("ord"), (F.col("l_w") * F.col("l_h")).alias("size")).agg(F.max(F.struct(both.alias("n"), (-F.col("r_ord")).alias("o"))).alias("m"))
    return best.filter(F.col("m.n") / F.greatest(F.lit(1), F.col("size")) >= least).select("page", "ord", (-F.col("m.o")).alias("owner"))


def repaired_component(items: DataFrame, components: DataFrame) -> DataFrame:
    """Text box -> component of the largest (overlap, z), first on ties: page, ord, owner."""
    p = overlapping_pairs(items.select("page", "ord", "x", "y", "w", "h"), components.select("page", "ord", "x", "y", "w", "h", "z"))
    both = g.intersection(corner_columns("l_"), corner_columns("r_"))
    best = p.groupBy("page", F.col("l_ord").alias("ord")).agg(F.max(F.struct(both.alias("n"), F.col("r_z").alias("z"), (-F.col("r_ord")).alias("o"))).alias("m"))
    return best.select("page", "ord", (-F.col("m.o")).alias("owner"))


def residual_owners(regions: DataFrame, nodes: DataFrame, reach: int = 4, share: float = 0.0002) -> DataFrame:
    """page, ord, owner: active nodes adjacent to a region, else the smallest that holds it.

    Adjacent: within `reach` pixels by at least max(1, round(share * area)) pixels.
    """
    r = regions.select("page", "ord", "x", "y", "w", "h")
    wide = r.select("page", "ord", (F.col("x") - reach).alias("x"), (F.col("y") - reach).alias("y"), (F.col("w") + 2 * reach).alias("w"), (F.col("h") + 2 * reach).alias("h"))
    n = nodes.select("page", "node", "x", "y", "w", "h", "z")
    p = overlapping_pairs(wide, n)
    both = g.intersection(corner_columns("l_"), corner_columns("r_"))
    touched = p.filter(both >= F.greatest(F.lit(1), F.bround(F.col("r_w") * F.col("r_h") * share))).select("page", F.col("l_ord").alias("ord"), F.col("r_node").alias("owner"))
    rest = r.join(touched.select("page", "ord").distinct(), ["page", "ord"], "left_anti")
    q = overlapping_pairs(rest, n)
    a, b = corner_columns("r_"), corner_columns("l_")
    held = q.filter((a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3]))
    best = held.groupBy("page", F.col("l_ord").alias("ord")).agg(F.min(F.struct((F.col("r_w") * F.col("r_h")).alias("s"), (-F.col("r_z")).alias("z"), F.col("r_node").alias("node"))).alias("m"))
    return touched.unionAll(best.select("page", "ord", F.col("m.node").alias("owner")))


def nearest_target(regions: DataFrame, targets: DataFrame, reach: int = 3) -> DataFrame:
    """page, ord, owner: the eligible target of least (distance, area, order).

    Eligible: holds the region, or comes within `reach` pixels of it.
    """
    wide = targets.select("page", "ord", (F.col("x") - reach).alias("x"), (F.col("y") - reach).alias("y"), (F.col("w") + 2 * reach).alias("w"), (F.col("h") + 2 * reach).alias("h"))
    p = overlapping_pairs(regions.select("page", "ord", "x", "y", "w", "h"), wide)
    c = F.col
    tx, ty, tw, th = c("r_x") + reach, c("r_y") + reach, c("r_w") - 2 * reach, c("r_h") - 2 * reach
    dx = F.greatest(tx - (c("l_x") + c("l_w")), c("l_x") - (tx + tw), F.lit(0))
    dy = F.greatest(ty - (c("l_y") + c("l_h")), c("l_y") - (ty + th), F.lit(0))
    best = p.groupBy("page", c("l_ord").alias("ord")).agg(F.min(F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), (tw * th).alias("s"), c("r_ord").alias("o"))).alias("m"))
    return best.select("page", "ord", c("m.o").alias("owner"))


def overlap_reports(components: DataFrame, texts: DataFrame) -> DataFrame:
    """page, ord, pixels, overlap, share: components that hold at least 16 text pixels and 2 %.

    components: page, ord, y, x per pixel; texts: page, y, x per pixel.
    """
    hit = components.join(texts.select("page", "y", "x").distinct().withColumn("hit", F.lit(1)), ["page", "y", "x"], "left")
    n = hit.groupBy("page", "ord").agg(F.count(F.lit(1)).alias("pixels"), F.count("hit").alias("overlap"))
    return n.filter((F.col("overlap") >= 16) & (F.col("overlap") / F.col("pixels") >= 0.02)).withColumn("share", F.col("overlap") / F.col("pixels"))


def contained_parents(nodes: DataFrame, least: float = 0.95) -> DataFrame:
    """page, a, b: unordered pairs of parents that overlap by `least` of the smaller."""
    parents = nodes.filter("kind = 'parent'").select("page", "node", "x", "y", "w", "h")
    p = overlapping_pairs(parents, parents).filter("l_node < r_node")
    both = g.intersection(corner_columns("l_"), corner_columns("r_"))
    return p.filter(both / F.least(F.col("l_w") * F.col("l_h"), F.col("r_w") * F.col("r_h")) >= least).select("page", F.col("l_node").alias("a"), F.col("r_node").alias("b"))


def overlap_dependencies(reports: DataFrame, nodes: DataFrame) -> DataFrame:
    """page, node: frozen visual nodes that failing reports name.

    reports: page, violations array<string>, overlap_ids array<long>.
    """
    named = reports.filter(F.array_contains("violations", "component_overlap")).select("page", F.explode("overlap_ids").alias("node")).distinct()
    return named.join(nodes.filter("kind <> 'text' and state = 'frozen'").select("page", "node"), ["page", "node"], "left_semi")


def multiset_difference(expected: DataFrame, rendered: DataFrame, *columns: str) -> DataFrame:
    """Rows and how often one side has more of them: columns, missing, extra."""
    a = expected.groupBy(*columns).agg(F.count(F.lit(1)).alias("a"))
    b = rendered.groupBy(*columns).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, list(columns), "full_outer").na.fill(0, ["a", "b"]).filter("a <> b")
    return both.select(*columns, F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("missing"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("extra"))


def positional(left: DataFrame, right: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Zip two lists per key by position: mismatched places and lengths, field by field.

    key, place, field; a row missing on one side is reported as field `(missing)`.
    """
    w = Window.partitionBy(key).orderBy(order)
    a = left.select(key, F.row_number().over(w).alias("place"), F.struct(*columns).alias("a"))
    b = right.select(key, F.row_number().over(w).alias("place"), F.struct(*columns).alias("b"))
    both = a.join(b, [key, "place"], "full_outer")
    missing = F.col("a").isNull() | F.col("b").isNull()
    fields = F.array_compact(F.array(F.when(missing, F.lit("(missing)")), *[F.when(~missing & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    return both.select(key, "place", F.explode(fields).alias("field"))


def shadow_plans(decisions: DataFrame, states: DataFrame) -> DataFrame:
    """page, object, decision, conflict, state: the first decision of a page wins, and more
    than one marks a conflict."""
    w = Window.partitionBy("page").orderBy("object")
    first = decisions.withColumn("_n", F.row_number().over(w)).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("page"))).filter("_n = 1")
    return first.join(states, "page", "left").select("page", "object", "decision", (F.col("_c") > 1).alias("conflict"), "state")


def undecided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates without a decision (anti join), in page order: order by page, object."""
    return candidates.join(decisions.select("page", "object").distinct(), ["page", "object"], "left_anti")


def reconstruction_objects(nodes: DataFrame, assets: DataFrame, texts: DataFrame, shapes: DataFrame) -> DataFrame:
    """Frozen nodes with their sources, in (z, ordinal) order per page.

    Visual nodes need an asset: `problem` says missing_asset otherwise.  Text nodes
    without a text item are left out.  candidates: representations that can be chosen.
    """
    frozen = nodes.filter("state = 'frozen'")
    visual = frozen.filter("kind <> 'text'").join(assets.select("node", "asset"), "node", "left").join(shapes.select("node", "shape"), "node", "left").withColumn("item", F.lit(None).cast("string"))
    written = frozen.filter("kind = 'text'").join(texts.select("node", "item"), "node").withColumn("asset", F.lit(None).cast("string")).withColumn("shape", F.lit(None).cast("string"))
    both = visual.unionByName(written)
    kinds = F.array_compact(F.array(F.when(F.col("item").isNotNull(), F.lit("editable_text")), F.when(F.col("shape").isNotNull(), F.lit("native_shape")), F.when(F.col("asset").isNotNull(), F.lit("raster"))))
    place = F.row_number().over(Window.partitionBy("page").orderBy("z", "ord"))
    return both.select("page", "node", "kind", "z", place.alias("place"), kinds.alias("candidates"), F.when((F.col("kind") != "text") & F.col("asset").isNull(), F.lit("missing_asset")).alias("problem"))


def approved_parent_pairs(pairs: DataFrame, actions: DataFrame, least: float = 0.92) -> DataFrame:
    """Pairs whose two parents were both accepted with confidence and each cite both."""
    ok = actions.filter((F.col("verb") == "accept") & (F.col("score") >= least)).select("page", "node", "cited")
    a = ok.select("page", F.col("node").alias("a"), F.col("cited").alias("ca"))
    b = ok.select("page", F.col("node").alias("b"), F.col("cited").alias("cb"))
    both = pairs.join(a, ["page", "a"]).join(b, ["page", "b"])
    cites = lambda c: F.array_contains(c, F.col("a")) & F.array_contains(c, F.col("b"))
    return both.filter(cites(F.col("ca")) & cites(F.col("cb"))).select("page", "a", "b")


def unapproved_parents(pairs: DataFrame, approved: DataFrame) -> DataFrame:
    """page, node: members of pairs that nobody approved."""
    left = pairs.join(approved, ["page", "a", "b"], "left_anti")
    return left.select("page", F.explode(F.array("a", "b")).alias("node")).distinct()


def carried_parent_pairs(pairs: DataFrame) -> DataFrame:
    """Approvals never carry over to another round."""
    return pairs.limit(0)


def reuse_frozen(current: DataFrame, previous: DataFrame, key: str = "node") -> DataFrame:
    """Current rows, with the previous record where the node is frozen."""
    old = previous.select(key, F.col("record").alias("_old"))
    both = current.join(old, key, "left")
    return both.withColumn("record", F.when(F.col("state") == "frozen", F.coalesce("_old", F.raise_error(F.concat(F.lit("no previous record: "), F.col(key).cast("string"))).cast("string"))).otherwise(F.col("record"))).drop("_old")


def equal_tag(first: Column, second: Column) -> Column:
    """Labels that share a token."""
    return F.arrays_overlap(t.tokens(first), t.tokens(second))


def same_instance(pairs: DataFrame) -> DataFrame:
    """Pairs (l_*, r_*) of proposals that show one thing: page, a, b."""
    c = F.col
    over = g.iou_floored(corner_columns("l_"), corner_columns("r_"))
    limit = F.when(c("l_role") == "person", 0.55).otherwise(0.70)
    loose = (c("l_role") == "container") & (c("l_source") != c("r_source")) & equal_tag(c("l_label"), c("r_label")) & (over >= 0.30)
    return pairs.filter((c("l_role") == c("r_role")) & ((over >= limit) | loose)).select("page", c("l_ord").alias("a"), c("r_ord").alias("b"))
