"""Closures over parent links and adjacency, and set operations on pixels.

Links never leave a page, so a closure is one shuffle by page and a walk through each
page's links in the stream of its task, however deep the forest is.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import joins
from docloom.operators.greedy import by_page


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frontier in the shared checkpoint folder."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return df.checkpoint()


def _parent_links(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent is not null").select("page", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """page, node, ancestor, depth; nodes: page, node, parent.

    However deep the forest is; a cycle ends at the first repeated node, so a node on it
    is its own ancestor.
    """

    def run(rows: list[dict]) -> Iterator[tuple]:
        above = {r["node"]: r["parent"] for r in rows}
        for node in above:
            at, depth, seen = above[node], 1, set()
            while at is not None and at not in seen:
                seen.add(at)
                yield node, at, depth
                at, depth = above.get(at), depth + 1

    return by_page(_parent_links(nodes), run, "page long, node long, ancestor long, depth int")


def on_cycles(nodes: DataFrame) -> DataFrame:
    """page, node: the nodes on parent cycles of any length, each once; nodes: page, node, parent."""

    def run(rows: list[dict]) -> list[tuple]:
        above = {r["node"]: r["parent"] for r in rows}
        walk_of: dict = {}  # the walk that came first to a node: each is walked once
        out = []
        for start in above:
            at = start
            while at in above and at not in walk_of:
                walk_of[at] = start
                at = above[at]
            if walk_of.get(at) == start:
                first = at
                while True:
                    out.append((at,))
                    at = above[at]
                    if at == first:
                        break
        return out

    return by_page(_parent_links(nodes), run, "page long, node long")


def reached(links: DataFrame, seeds: DataFrame, keep_seeds: bool) -> DataFrame:
    """page, node: what links (page, a, b) lead to from the seeds (page, node); each node once."""

    def run(rows: list[dict]) -> list[tuple]:
        to: dict = {}
        for r in rows:
            if not r["seed"]:
                to.setdefault(r["a"], []).append(r["b"])
        start = {r["a"] for r in rows if r["seed"]}
        found, todo = set(start) if keep_seeds else set(), list(start)
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in found:
                    found.add(b)
                    todo.append(b)
        return [(n,) for n in found]

    both = links.select("page", F.lit(False).alias("seed"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = both.unionAll(seeds.select("page", F.lit(True), F.col("node").cast("long"), F.lit(0).cast("long")))
    return by_page(both, run, "page long, node long")


def descendants(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """page, node: all below the seeds (page, node); each node once."""
    down = nodes.filter("parent is not null").select("page", F.col("parent").alias("a"), F.col("node").alias("b"))
    return reached(down, seeds, False)


def deactivate_descendants(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """nodes with every descendant of the seeds made inactive."""
    hit = descendants(nodes, seeds).withColumn("_d", F.lit(True))
    return nodes.join(hit, ["page", "node"], "left").withColumn("state", F.when(F.col("_d"), "inactive").otherwise(F.col("state"))).drop("_d")


def related_inactive(pairs: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """page, target, source of pairs whose target is above the source, or its sibling.

    Without pairs: of all pairs of two nodes of a page, which are then never listed.
    """
    if pairs is None:
        return by_page(_parent_links(nodes), _related, "page long, target long, source long")
    above = ancestors(nodes).select("page", F.col("node").alias("source"), F.col("ancestor").alias("target"))
    p = nodes.select("page", "node", "parent")
    s = pairs.join(p.select("page", F.col("node").alias("source"), F.col("parent").alias("sp")), ["page", "source"]).join(p.select("page", F.col("node").alias("target"), F.col("parent").alias("tp")), ["page", "target"])
    sibling = s.filter(F.col("sp") == F.col("tp")).select("page", "source", "target")
    return pairs.select("page", "source", "target").join(above, ["page", "source", "target"], "left_semi").union(sibling).distinct()


def _related(rows: list[dict]) -> Iterator[tuple]:
    """target, source, each pair once, where a node may have several parents, too."""
    above: dict = {}
    below: dict = {}
    for r in rows:
        above.setdefault(r["node"], set()).add(r["parent"])
        below.setdefault(r["parent"], set()).add(r["node"])
    for node, parents in above.items():
        related, todo = set(parents), list(parents)
        while todo:
            for up in above.get(todo.pop(), ()):
                if up not in related:
                    related.add(up)
                    todo.append(up)
        for target in related.union(*(below[p] for p in parents)) - {node}:
            yield target, node


def delta_scope(nodes: DataFrame, changed: DataFrame, reach: int = 3, most: int = 64) -> DataFrame:
    """page, node: what a change of text makes stale.

    Seeds are the nodes whose boxes come within `reach` pixels of a changed box; the
    scope closes over parents, children and adjacent nodes.  A page whose scope would
    exceed `most` nodes is unprovable: node null, everything is to be computed anew.
    """
    wide = nodes.select("page", "node", (F.col("x") - reach).alias("x"), (F.col("y") - reach).alias("y"), (F.col("w") + 2 * reach).alias("w"), (F.col("h") + 2 * reach).alias("h"))
    row = lambda what, a, b: ("page", F.lit(what).alias("what"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    touched = joins.overlapping_pairs(wide, changed.select("page", "x", "y", "w", "h")).select(*row(0, "l_node", "l_node"))
    # The same rows on both sides, widened, so that they are shuffled once; r is made plain after
    # the join.  Boxes that have a size are near each other or not; one without is nobody's neighbour.
    at = lambda n, side: F.greatest(f"l_{n}", F.col(f"r_{n}") + reach) < F.least(F.col(f"l_{n}") + F.col(f"l_{side}"), F.col(f"r_{n}") + F.col(f"r_{side}") - reach)
    sized = F.least("l_w", "l_h", "r_w", "r_h") > 2 * reach
    pairs = joins.overlapping_pairs(wide, wide).filter(at("x", "w") & at("y", "h") & ((F.col("l_node") < F.col("r_node")) | ((F.col("l_node") > F.col("r_node")) & ~sized)))
    near = pairs.select("page", F.when(sized, 2).otherwise(1).alias("what"), F.col("l_node").cast("long").alias("a"), F.col("r_node").cast("long").alias("b"))
    kin = nodes.filter("parent is not null").select(*row(2, "node", "parent"))

    def run(rows: list[dict]) -> list[tuple]:
        to: dict = {}
        found = {r["a"] for r in rows if r["what"] == 0}
        if not found:
            return []
        for r in rows:
            if r["what"]:
                to.setdefault(r["a"], []).append(r["b"])
            if r["what"] == 2:
                to.setdefault(r["b"], []).append(r["a"])
        todo = list(found)
        while todo and len(found) <= most:
            for b in to.get(todo.pop(), ()):
                if b not in found:
                    found.add(b)
                    todo.append(b)
        return [(n,) for n in found] if len(found) <= most else [(None,)]

    return by_page(touched.unionAll(near).unionAll(kin), run, "page long, node long")


def can_reuse(scope: DataFrame, pages: DataFrame, hashes: DataFrame) -> DataFrame:
    """page, reuse: all or nothing: an empty scope and every hash equal.

    hashes: page, name, old, new.
    """
    stale = scope.select("page").distinct().withColumn("_s", F.lit(True))
    same = hashes.groupBy("page").agg(F.bool_and(F.col("old").eqNullSafe(F.col("new"))).alias("_h"))
    return pages.select("page").distinct().join(stale, "page", "left").join(same, "page", "left").select("page", (F.col("_s").isNull() & F.coalesce("_h", F.lit(False))).alias("reuse"))


def keep_islands(regions: DataFrame, least: int = 20, share: float = 0.10) -> DataFrame:
    """Regions of at least max(least, share of the page's largest) pixels."""
    top = F.max("pixels").over(Window.partitionBy("page"))
    return regions.withColumn("_t", top).filter(F.col("pixels") >= F.greatest(F.lit(float(least)), F.col("_t") * share)).drop("_t")


def merged_foreground(initial: DataFrame, refined: DataFrame) -> DataFrame:
    """Refined pixels and the initial regions in which none was refined: page, y, x.

    initial: page, region, y, x; refined: page, y, x.
    """
    hit = initial.join(refined, ["page", "y", "x"], "left_semi").select("page", "region").distinct()
    rest = initial.join(hit, ["page", "region"], "left_anti").select("page", "y", "x")
    return refined.select("page", "y", "x").union(rest).distinct()


def overlapping_masks(claims: DataFrame) -> DataFrame:
    """page, y, x, owners: pixels that more than one mask holds (none: masks are disjoint)."""
    return claims.groupBy("page", "y", "x").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1")


def outside_parent(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Child pixels that their parent doesn't hold: page, owner, y, x (both: page, owner, y, x)."""
    return children.select("page", "owner", "y", "x").exceptAll(parents.select("page", "owner", "y", "x"))


def removal_mask(masks: DataFrame, texts: DataFrame, width: int, height: int, reach: int = 2) -> DataFrame:
    """page, y, x: the union of masks and text, widened by a square of 2 * reach + 1."""
    d = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    both = masks.select("page", "y", "x").union(texts.select("page", "y", "x")).distinct()
    rows = both.withColumn("dy", F.explode(d)).select("page", (F.col("y") + F.col("dy")).alias("y"), "x").distinct()
    wide = rows.withColumn("dx", F.explode(d)).select("page", "y", (F.col("x") + F.col("dx")).alias("x")).distinct()
    return wide.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height))


def box_cells(boxes: DataFrame, padding: int, width: int, height: int) -> DataFrame:
    """page, ord, y, x: the pixels of padded boxes on a canvas."""
    c = F.col
    span = lambda a, b, most: F.sequence(F.greatest(F.lit(0), c(a) - padding), F.least(F.lit(most - 1), c(a) + c(b) + padding - 1))
    inside = (c("x") + c("w") + padding > 0) & (c("y") + c("h") + padding > 0) & (c("x") - padding < width) & (c("y") - padding < height)
    return boxes.filter(inside).select("page", "ord", F.explode(span("y", "h", height)).alias("yy"), "x", "w").select("page", "ord", F.col("yy").alias("y"), F.explode(span("x", "w", width)).alias("x"))


def region_labels(texts: DataFrame, boxes: DataFrame) -> DataFrame:
    """page, y, x, label: the first box to cover a text pixel owns it.

    texts: page, y, x; boxes: page, ord, y, x per pixel.  Pixels without a box: null.
    """
    own = boxes.groupBy("page", "y", "x").agg(F.min("ord").alias("label"))
    return texts.join(own, ["page", "y", "x"], "left")


def box_labels(texts: DataFrame, boxes: DataFrame) -> DataFrame:
    """As region_labels, of whole boxes: page, ord, x, y, w, h.

    Pixels and boxes meet in cells of the grid, so no box is spread to its pixels and what
    is held grows with the text pixels.
    """
    pixels = texts.select("page", "y", "x", F.lit(1).alias("w"), F.lit(1).alias("h")).distinct()
    met = joins.overlapping_pairs(pixels, boxes.select("page", "ord", "x", "y", "w", "h"))
    own = met.groupBy("page", F.col("l_y").alias("y"), F.col("l_x").alias("x")).agg(F.min("r_ord").alias("label"))
    return texts.join(own, ["page", "y", "x"], "left")


def largest_label(labels: DataFrame) -> DataFrame:
    """page, pixels: the size of the page's largest label."""
    return labels.filter("label is not null").groupBy("page", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("page").agg(F.max("n").alias("pixels"))


def project(claims: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Claims on the canvas, and how many each page and owner has outside it."""
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height)
    return claims.filter(inside), claims.filter(~inside).groupBy("page", "owner").agg(F.count(F.lit(1)).alias("outside"))


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """page, iou of two pixel sets (page, y, x each); 0 where both are empty."""
    both = a.select("page", "y", "x", F.lit(1).alias("a")).join(b.select("page", "y", "x", F.lit(1).alias("b")), ["page", "y", "x"], "full_outer")
    return both.groupBy("page").agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count(F.lit(1))).alias("iou"))


def box_fill(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """page, ord, fill: mask pixels in a box over its area; boxes: page, ord, x, y, w, h."""
    b = boxes.select("page", "ord", F.col("x").alias("bx"), F.col("y").alias("by"), "w", "h")
    hit = cells.filter("mask").join(b, "page").filter("x >= bx and y >= by and x < bx + w and y < by + h").groupBy("page", "ord").agg(F.count(F.lit(1)).alias("n"))
    return b.join(hit, ["page", "ord"], "left").select("page", "ord", (F.coalesce("n", F.lit(0)) / F.greatest(F.lit(1), F.col("w") * F.col("h"))).alias("fill"))


def positive_hits(cells: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """page, hits: points (px, py as doubles), rounded half to even and clamped, on the mask."""
    at = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), F.bround(c).cast("int")))
    p = points.select("page", at(F.col("px"), width).alias("x"), at(F.col("py"), height).alias("y"))
    return p.join(cells.filter("mask").select("page", "y", "x"), ["page", "y", "x"], "left_semi").groupBy("page").agg(F.count(F.lit(1)).alias("hits"))
