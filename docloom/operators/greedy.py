"""Order-dependent operators, one page at a time in Arrow batches.

What they do depends on what was kept before, so no join can express them.  Rows are
dealt and sorted by page, and a task walks its pages in one stream: a task holds one
page's rows at a time, whatever its number of pages, and a page costs no call of its own.
Pairs of boxes come from the grid join; the walks see only those that meet.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import geometry as g
from docloom.functions import text as t
from docloom.operators import joins


_KINDS = {"long": "Int64", "int": "Int32", "double": "float64", "boolean": "boolean", "string": "object"}


def by_page(df: DataFrame, run: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply run(rows of a page) -> result rows, without the page, to every page."""
    fields = [f.split() for f in schema.split(", ")]

    def frame(out: list[tuple]) -> pd.DataFrame:
        columns = zip(*out, strict=True) if out else [[] for _ in fields]
        return pd.DataFrame({n: pd.array(list(v), dtype=_KINDS[k]) if _KINDS[k] != "object" else pd.Series(list(v), dtype="object") for (n, k), v in zip(fields, columns, strict=True)})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for held in pages(batches):
            for row in run(held):
                out.append((held[0]["page"], *row))
                if len(out) > 10_000:
                    yield frame(out)
                    out = []
        yield frame(out)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for pdf in batches:
            for r in pdf.to_dict("records"):
                if held and r["page"] != held[0]["page"]:
                    yield held
                    held = []
                held.append(r)
        if held:
            yield held

    return df.repartition("page").sortWithinPartitions("page").mapInPandas(walk, schema)


def _iou(a, b, floor: float = 1.0) -> float:
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    size = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    return both / max(size(a) + size(b) - both, floor)


def _shared(prefixes: tuple[str, str] = ("l_", "r_")) -> tuple[Column, Column, Column]:
    """Areas of both boxes of a pair and of what they share."""
    (x1, y1, x2, y2), (u1, v1, u2, v2) = (joins.corner_columns(p) for p in prefixes)
    both = g.span(x1, x2, u1, u2) * g.span(y1, y2, v1, v2)
    return (x2 - x1) * (y2 - y1), (u2 - u1) * (v2 - v1), both


def _overlap() -> Column:
    a, b, both = _shared()
    return both / F.greatest(a + b - both, F.lit(1.0))


def independent(rows: DataFrame, clashes: DataFrame, *order) -> DataFrame:
    """page, ord, rank of rows taken in the given order, but for those that clash with one
    taken before.

    rows: page, ord and the columns of order; clashes: page, l_ord, r_ord, either way round.
    Only the clashing pairs reach the walk, so a page costs as much as it has of them.
    """
    nodes = rows.select("page", F.struct(*order, F.col("ord")).alias("place"), "ord", F.lit(None).cast("int").alias("other"))
    pairs = clashes.select("page", F.explode(F.array(*[F.struct(F.col(a).alias("ord"), F.col(b).alias("other")) for a, b in (("l_ord", "r_ord"), ("r_ord", "l_ord"))])).alias("p"))
    links = pairs.select("page", F.lit(None).cast(nodes.schema["place"].dataType).alias("place"), "p.ord", "p.other")
    numbered = nodes.unionAll(links)

    def run(rows: list[dict]) -> list[tuple]:
        near: dict[int, list[int]] = {}
        for r in rows:
            if r["place"] is None:
                near.setdefault(int(r["ord"]), []).append(int(r["other"]))
        barred: set[int] = set()
        out: list[tuple] = []
        for r in sorted((r for r in rows if r["place"] is not None), key=lambda r: tuple(r["place"].values())):
            if r["ord"] not in barred:
                out.append((r["ord"], len(out) + 1))
                barred.update(near.get(r["ord"], ()))
        return out

    return by_page(numbered, run, "page long, ord int, rank int")


#: Fixed values of proposals: largest share of page and crop, an icon's shape, what makes a duplicate, what makes people separate.
PAGE_SHARE, PORTRAIT_SHARE, ICON_SHAPE, LIKE_SIZE, LIKE_BOX, APART = 0.85, 0.80, 0.85, 0.85, 0.75, 0.05


def filter_proposals(proposals: DataFrame, width: int, height: int, crop_w: int, crop_h: int) -> DataFrame:
    """page, ord of the proposals kept: eligible, not a duplicate of one kept before, and no
    weak container around two separate people.

    proposals: page, ord, x, y, w, h, score, label, edge.
    """
    found = proposals.select("page", "ord", "x", "y", "w", "h", "score", "edge", t.role(F.col("label")).alias("role"), t.tokens(F.col("label")).alias("tok"))
    has = lambda word: F.array_contains("tok", word)
    size = F.col("w") * F.col("h")
    too_large = size / max(width * height, 1) >= PAGE_SHARE
    whole_crop = has("portrait") & (size / max(crop_w * crop_h, 1) >= PORTRAIT_SHARE)
    info_icon = has("information") & has("icon") & (F.size("tok") == 2) & (F.least("w", "h") / F.greatest(F.col("w"), F.col("h"), F.lit(1.0)) < ICON_SHAPE)
    rows = found.filter(~(too_large | whole_crop | info_icon))

    a, b, _ = _shared()
    same_kind = (F.col("role") != "object") | F.arrays_overlap("l_tok", "r_tok")  # roles are equal, by the join
    like = (F.least(a, b) / F.greatest(a, b, F.lit(1.0)) >= LIKE_SIZE) & (_overlap() >= LIKE_BOX)
    slim = rows.select("page", "role", "ord", "x", "y", "w", "h", "score", "edge", F.when(F.col("role") == "object", F.col("tok")).alias("tok"))
    clashes = joins.overlapping_pairs(slim, slim, ("page", "role")).filter((F.col("l_ord") < F.col("r_ord")) & same_kind & like)
    dropped = _beaten(clashes.withColumns({f"{p}last": -F.col(f"{p}score") for p in ("l_", "r_")}), "edge", "last")
    out = dropped.unionAll(_around_people(rows, dropped))
    return rows.select("page", "ord").join(out, ["page", "ord"], "left_anti")


def _beaten(clashes: DataFrame, *order) -> DataFrame:
    """page, ord of what independent() leaves out, from the pairs alone: rows that clash with
    none are never walked.

    clashes: page, and ord and the columns of order as l_* and r_*.
    """
    side = lambda p: F.struct(*[F.col(f"{p}{n}") for n in order], F.col(f"{p}ord").alias("ord")).alias(f"{p}place")

    def run(rows: list[dict]) -> list[tuple]:
        near: dict[tuple, list[tuple]] = {}
        for r in rows:
            a, b = tuple(r["l_place"].values()), tuple(r["r_place"].values())
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        barred: set[tuple] = set()
        for place in sorted(near):
            if place not in barred:
                barred.update(near[place])
        return [(place[-1],) for place in barred]

    return by_page(clashes.select("page", side("l_"), side("r_")), run, "page long, ord int")


def _around_people(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """page, ord of weak containers that hold the centres of two people that don't overlap,
    none of them dropped.

    People are paired only where they meet: n of them are all close to each other if the
    close pairs number n (n - 1) / 2, so separate ones are never listed.
    """
    weak = rows.filter(F.col("role").isin("container", "mixed") & ~F.arrays_overlap("tok", F.array(*[F.lit(w) for w in t.STRONG_CONTAINER])))
    people = rows.filter(F.col("role") == "person").select("page", "ord", "x", "y", "w", "h")
    (x1, y1, x2, y2), cx, cy = joins.corner_columns(""), F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    # A pixel more on each side, as the grid pairs insides only and a centre may lie on an edge.
    holders = weak.select("page", "ord", (x1 - 1).alias("x"), (y1 - 1).alias("y"), (x2 - x1 + 2).alias("w"), (y2 - y1 + 2).alias("h"))
    centres = people.select("page", "ord", (cx - 1).alias("x"), (cy - 1).alias("y"), F.lit(2.0).alias("w"), F.lit(2.0).alias("h"))
    at = lambda v: F.col(f"r_{v}") + 1
    within = F.lit(True)
    for v, side in (("x", "w"), ("y", "h")):
        within &= at(v).between(F.col(f"l_{v}") + 1, F.col(f"l_{v}") + F.col(f"l_{side}") - 1)
    held = joins.overlapping_pairs(holders, centres).filter(within).select("page", F.col("l_ord").alias("ord"), F.col("r_ord").alias("person"))
    held = held.join(dropped, ["page", "ord"], "left_anti").join(dropped.withColumnRenamed("ord", "person"), ["page", "person"], "left_anti")
    close = joins.overlapping_pairs(people, people).filter((F.col("l_ord") < F.col("r_ord")) & (_overlap() > APART)).select("page", F.col("l_ord").alias("person"), F.col("r_ord").alias("second"))
    together = held.join(close, ["page", "person"]).join(held.withColumnRenamed("person", "second"), ["page", "ord", "second"]).groupBy("page", "ord").agg(F.count("*").alias("close"))
    n = F.col("n")
    counts = held.groupBy("page", "ord").agg(F.count("*").alias("n")).join(together, ["page", "ord"], "left")
    return counts.filter(F.coalesce("close", F.lit(0)) < n * (n - 1) / 2).select("page", "ord")


def deduplicate_texts(items: DataFrame) -> DataFrame:
    """page, ord of texts kept: of overlapping ones (0.8 of the smaller) where one text holds
    the other, the longer stays, then the surer, then the earlier.  Empty texts stay.

    Texts come in their order; one that clashes with several held ones contends for the
    place that was taken first.
    """
    slim = items.select("page", "ord", "x", "y", "w", "h", "confidence", t.compact(F.col("text")).alias("t"))
    a, b, both = _shared()
    nested = F.contains("l_t", "r_t") | F.contains("r_t", "l_t")
    met = joins.overlapping_pairs(slim.drop("confidence"), slim.drop("confidence"), cell=joins.LINE_CELL)
    pairs = met.filter((F.col("l_ord") < F.col("r_ord")) & (F.col("l_t") != "") & (F.col("r_t") != "") & nested & (both / F.greatest(F.least(a, b), F.lit(1)) >= 0.8))
    nodes = slim.select("page", "ord", F.lit(None).cast("int").alias("before"), F.length("t").alias("long"), "confidence")
    links = pairs.select("page", F.col("r_ord").alias("ord"), F.col("l_ord").alias("before"), F.lit(None).cast("int").alias("long"), F.lit(None).cast("double").alias("confidence"))

    def run(rows: list[dict]) -> list[tuple]:
        worth = {r["ord"]: (r["long"], r["confidence"]) for r in rows if pd.isna(r["before"])}
        earlier: dict[int, list[int]] = {}
        for r in rows:
            if not pd.isna(r["before"]):
                earlier.setdefault(r["ord"], []).append(int(r["before"]))
        holder: list[int] = []  # of each place
        place: dict[int, int] = {}
        for o in sorted(worth):
            clash = min((place[b] for b in earlier.get(o, ()) if b in place), default=None)
            if clash is None:
                place[o] = len(holder)
                holder.append(o)
            elif worth[o] > worth[holder[clash]]:
                del place[holder[clash]]
                place[o], holder[clash] = clash, o
        return [(o,) for o in sorted(place)]

    return by_page(nodes.unionAll(links), run, "page long, ord int")


#: Fixed values of merging, heights as shares of the smaller (shared rows) or larger box:
#: shared rows, overlap and gap allowed, gap always allowed, difference of size, of colour.
SHARED_ROWS, OVERLAP, GAP, LEAST_GAP, SIZE_STEP, COLOUR_STEP = 0.60, 0.35, 0.45, 6, 0.25, 48.0

TEXT_SCHEMA = "page long, ord int, x int, y int, w int, h int, text string, font_size double, color string, bold boolean, confidence double"

#: Height of the bands in which neighbours of a line are looked up.
BAND = 32


class _Lines:
    """The texts of a page, found by the bands of rows that they touch."""

    def __init__(self):
        self.items: list[dict | None] = []
        self.bands: dict[int, set[int]] = {}

    @staticmethod
    def _touched(item: dict) -> range:
        return range(item["y"] // BAND, (item["y"] + max(item["h"], 1) - 1) // BAND + 1)

    def add(self, item: dict) -> int:
        at = len(self.items)
        self.items.append(item)
        for band in self._touched(item):
            self.bands.setdefault(band, set()).add(at)
        return at

    def take(self, at: int) -> dict:
        item, self.items[at] = self.items[at], None
        for band in self._touched(item):
            self.bands[band].discard(at)
        return item

    def neighbours(self, at: int) -> Iterator[tuple[float, float, int, int]]:
        """(gap, distance of middles, left, right) of what may be merged with an item."""
        item = self.items[at]
        for other in set().union(*(self.bands[b] for b in self._touched(item))) - {at}:
            for i, j in ((at, other), (other, at)):
                gap = _gap_on_a_line(self.items[i], self.items[j])
                if gap is not None:
                    yield max(gap, 0), abs(self._middle(i) - self._middle(j)), i, j

    def _middle(self, at: int) -> float:
        return self.items[at]["y"] + self.items[at]["h"] / 2


def _gap_on_a_line(a: dict, b: dict) -> int | None:
    """The gap from a to b where b goes on in a's line and style, else null."""
    low, tall = sorted((a["h"], b["h"]))
    rows = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    gap = b["x"] - a["x"] - a["w"]
    sizes = a["font_size"], b["font_size"]
    fits = (
        a["x"] <= b["x"]
        and rows / max(low, 1) >= SHARED_ROWS
        and -OVERLAP * tall <= gap <= max(LEAST_GAP, GAP * tall)
        and a["bold"] == b["bold"]
        and max(sizes) - min(sizes) <= SIZE_STEP * max(*sizes, 1)
        and _like_colours(a, b)
    )
    return gap if fits else None


def _like_colours(a: dict, b: dict) -> bool:
    if a["rgb"] is None or b["rgb"] is None:
        return a["color"] == b["color"]
    return sum((p - q) ** 2 for p, q in zip(a["rgb"], b["rgb"], strict=True)) <= COLOUR_STEP**2


_CJK, _CJK_OR_DIGIT = re.compile(t.CJK), re.compile(rf"(?:{t.CJK}|\d)\Z")


def _joined(a: dict, b: dict) -> dict:
    """One text of two: no blank where CJK follows CJK or a digit."""
    blank = "" if _CJK.match(b["text"]) and _CJK_OR_DIGIT.search(a["text"]) else " "
    pair = (a, b)
    out = dict(a, text=blank.join(p["text"] for p in pair), font_size=max(p["font_size"] for p in pair), confidence=min(p["confidence"] for p in pair))
    for low, side in (("x", "w"), ("y", "h")):
        out[low] = min(p[low] for p in pair)
        out[side] = max(p[low] + p[side] for p in pair) - out[low]
    return out


def merge_texts(items: DataFrame) -> DataFrame:
    """Neighbouring texts of a line merged, the closest pair first (overlapping ones are at
    distance 0), until none is left; a merged text stands behind all others.

    Pairs wait in a heap, and a merged text meets only what shares its rows.
    """

    def run(rows: list[dict]) -> list[tuple]:
        page = _Lines()
        for r in sorted(rows, key=lambda r: (r["y"], r["x"], r["ord"])):
            hexes = re.match(r".([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})", r["color"] or "")
            r["rgb"] = tuple(int(v, 16) for v in hexes.groups()) if hexes else None
            page.add(r)
        waiting = [p for at in range(len(page.items)) for p in page.neighbours(at) if p[2] == at]
        heapq.heapify(waiting)
        while waiting:
            _, _, i, j = heapq.heappop(waiting)
            if page.items[i] is not None and page.items[j] is not None:
                merged = page.add(_joined(page.take(i), page.take(j)))
                for pair in page.neighbours(merged):
                    heapq.heappush(waiting, pair)
        return [tuple(r[n] for n in names[1:]) for r in page.items if r is not None]

    names = [c.split()[0] for c in TEXT_SCHEMA.split(", ")]
    return by_page(items.select(*names), run, TEXT_SCHEMA)


def two_views(first: DataFrame, second: DataFrame, least: float = 0.5) -> DataFrame:
    """page, ord, other, consistent: one-to-one matches of two readings by falling overlap.

    Consistent where the compacted texts agree; unmatched rows have other null.
    """
    if least <= 0:
        raise ValueError("least must be over 0: boxes that don't meet are no match")
    side = lambda df: df.select("page", "ord", "x", "y", "w", "h", t.compact(F.col("text")).alias("t"))
    size_a, size_b, both = _shared()
    share = both / F.greatest(F.least(size_a, size_b), F.lit(1))
    met = joins.overlapping_pairs(side(first), side(second), cell=joins.LINE_CELL).withColumn("share", share).filter(F.col("share") >= least)
    pairs = met.select("page", F.col("l_ord").alias("ord"), F.col("r_ord").alias("other"), "share", F.col("l_t").eqNullSafe(F.col("r_t")).alias("same"))
    alone = first.select("page", "ord", F.lit(None).cast("int").alias("other"), F.lit(-1.0).alias("share"), F.lit(False).alias("same"))

    def run(rows: list[dict]) -> list[tuple]:
        used, taken, out = set(), set(), []
        for r in sorted(rows, key=lambda r: (-r["share"], r["ord"], -1 if pd.isna(r["other"]) else r["other"])):
            if r["ord"] not in used and r["other"] not in taken:
                used.add(r["ord"])
                if pd.isna(r["other"]):
                    out.append((r["ord"], None, False))
                else:
                    taken.add(r["other"])
                    out.append((r["ord"], int(r["other"]), bool(r["same"])))
        return out

    return by_page(pairs.unionAll(alone), run, "page long, ord int, other int, consistent boolean")


def text_metrics(expected: DataFrame, rendered: DataFrame) -> DataFrame:
    """page, mismatch, minimum_iou: equal multisets of normalised texts, then the greedy best
    IoU for each (ties: the later one); minimum_iou is null where the texts differ."""
    side = lambda df, v: df.select("page", F.lit(v).alias("v"), "ord", "x", "y", "w", "h", t.normalized(F.col("text")).alias("t"))

    def run(rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: r["ord"])
        left, right = [r for r in rows if r["v"] == 0], [r for r in rows if r["v"] == 1]
        if sorted(r["t"] for r in left) != sorted(r["t"] for r in right):
            return [(True, None)]
        low = 1.0
        free: dict[str, list] = {}
        for r in right:
            free.setdefault(r["t"], []).append((r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]))
        for r in left:
            box = (r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"])
            s, i = max((_iou(box, f, 1e-12), i) for i, f in enumerate(free[r["t"]]))
            low = min(low, s)
            free[r["t"]].pop(i)
        return [(False, low)]

    return by_page(side(expected, 0).unionAll(side(rendered, 1)), run, "page long, mismatch boolean, minimum_iou double")


def mask_nms(candidates: DataFrame, most_iou: float = 0.92) -> DataFrame:
    """page, ord, rank of box candidates kept by falling score; a dropped one suppresses nobody."""
    if most_iou <= 0:
        raise ValueError("most_iou must be over 0: boxes that don't meet suppress nobody")
    boxes = candidates.select("page", "ord", "x", "y", "w", "h")
    clashes = joins.overlapping_pairs(boxes, boxes).filter((F.col("l_ord") < F.col("r_ord")) & (_overlap() >= most_iou))
    return independent(candidates, clashes, -F.col("score"))


def entity_count(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """page, entities: groups of masks that pairs (page, a, b) join; members: page, ord."""
    both = members.select("page", F.col("ord").alias("a"), F.col("ord").alias("b")).unionAll(pairs.select("page", "a", "b"))

    def run(rows: list[dict]) -> list[tuple]:
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for r in rows:
            p, q = root(r["a"]), root(r["b"])
            up[max(p, q)] = min(p, q)
        return [(len({root(x) for x in list(up)}),)]

    return by_page(both, run, "page long, entities int")


def execute_plan(nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """Nodes after a page's actions, applied in their order: page, node, parent, state, kind,
    x, y, w, h, z.

    accept freezes, discard and suppress_text make inactive, merge joins the cited nodes
    into a new one, split cuts at the middle of the longer side, expand and shrink move
    the edges by 5 %, the retries make pending (with a box or points: pending_gate).
    attach_text puts the cited texts under the node, collapse_to_parent gives a family
    back to its parent, absorb_into_parent joins the cited children's boxes to it,
    absorb_residual and rebuild_background leave the table to the raster step and make
    the node pending.  Frozen nodes change only by a retry; an action on a node that an
    earlier one used up is skipped.
    """
    n = nodes.select("page", F.lit(0).alias("what"), "node", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), "state", "kind", "x", "y", "w", "h", "z", F.lit(None).cast("string").alias("verb"), F.lit(0).alias("ord"), F.array().cast("array<long>").alias("cited"))
    a = actions.select("page", F.lit(1).alias("what"), "node", F.lit(-1).cast("long").alias("parent"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("kind"), *[F.lit(0).alias(c) for c in "xywhz"], "verb", "ord", "cited")
    schema = "page long, node long, parent long, state string, kind string, x int, y int, w int, h int, z int"

    names = ("node", "parent", "state", "kind", "x", "y", "w", "h", "z")
    retries = {"retry": "pending", "retry_with_box": "pending_gate", "retry_with_points": "pending_gate"}

    def run(rows: list[dict]) -> list[tuple]:
        have = {r["node"]: {c: r[c] for c in names} for r in rows if r["what"] == 0}
        fresh = max(have, default=0)
        used: set = set()
        for act in sorted((r for r in rows if r["what"] == 1), key=lambda r: (r["ord"], r["node"])):
            target = have.get(act["node"])
            if target is None or act["node"] in used or (target["state"] in ("frozen", "inactive") and act["verb"] not in retries):
                continue
            verb = act["verb"]
            if verb == "accept":
                target["state"] = "frozen"
            elif verb in ("discard", "suppress_text"):
                target["state"] = "inactive"
            elif verb in retries:
                target["state"] = retries[verb]
            elif verb in ("absorb_residual", "rebuild_background"):
                target["state"] = "pending"
            elif verb == "attach_text":
                for i in act["cited"]:
                    if i != act["node"] and i in have and have[i]["kind"] == "text":
                        have[i]["parent"] = act["node"]
            elif verb in ("collapse_to_parent", "absorb_into_parent"):
                up = have.get(target["parent"]) if verb == "collapse_to_parent" else target
                if up is None or up["state"] == "frozen":
                    continue
                family = [p for p in have.values() if p["parent"] == up["node"] and p["kind"] != "text" and p["state"] != "frozen" and (verb == "collapse_to_parent" or p["node"] in set(act["cited"]))]
                if verb == "absorb_into_parent" and family:
                    x, y = min(p["x"] for p in [up, *family]), min(p["y"] for p in [up, *family])
                    w, h = max(p["x"] + p["w"] for p in [up, *family]) - x, max(p["y"] + p["h"] for p in [up, *family]) - y
                    up.update(x=x, y=y, w=w, h=h)
                up["state"] = "pending"
                for p in family:
                    p["state"] = "inactive"
                    used.add(p["node"])
            elif verb in ("expand", "shrink"):
                sign = 1 if verb == "expand" else -1
                dx, dy = int(target["w"] * 0.05) * sign, int(target["h"] * 0.05) * sign
                target.update(x=max(0, target["x"] - dx), y=max(0, target["y"] - dy), w=target["w"] + 2 * dx, h=target["h"] + 2 * dy)
            elif verb == "merge":
                parts = [have[i] for i in dict.fromkeys(act["cited"]) if i in have and i not in used and have[i]["state"] not in ("frozen", "inactive")]
                if len(parts) > 1:
                    fresh += 1
                    x, y = min(p["x"] for p in parts), min(p["y"] for p in parts)
                    have[fresh] = target | {"node": fresh, "state": "pending", "x": x, "y": y, "w": max(p["x"] + p["w"] for p in parts) - x, "h": max(p["y"] + p["h"] for p in parts) - y}
                    for p in parts:
                        p["state"] = "inactive"
                        used.add(p["node"])
            elif verb == "split":
                wide = target["w"] >= target["h"]
                half = (target["w"] if wide else target["h"]) // 2
                if half:
                    for k in range(2):
                        fresh += 1
                        rest = (target["w"] if wide else target["h"]) - half
                        part = {"x": target["x"] + half * k, "w": rest if k else half} if wide else {"y": target["y"] + half * k, "h": rest if k else half}
                        have[fresh] = target | {"node": fresh, "state": "pending"} | part
                    target["state"] = "inactive"
                    used.add(target["node"])
        return [tuple(None if c == "parent" and v[c] == -1 else v[c] for c in names) for v in have.values()]

    return by_page(n.unionAll(a), run, schema)


def reconcile_fragments(fragments: DataFrame, containers: DataFrame, structural: float = 0.15) -> DataFrame:
    """page, ord, owner, fate of residual fragments, largest first: attached to the container of
    most contact (which then grows), kept if sure and off the edge, else dropped."""
    f = fragments.select("page", F.lit(1).alias("what"), "ord", "x", "y", "w", "h", "score", "edge")
    c = containers.select("page", F.lit(0).alias("what"), "ord", "x", "y", "w", "h", F.lit(1.0).alias("score"), F.lit(False).alias("edge"))

    def run(rows: list[dict]) -> list[tuple]:
        boxes = {r["ord"]: [r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]] for r in rows if r["what"] == 0}
        out = []
        for r in sorted((r for r in rows if r["what"] == 1), key=lambda r: (-r["w"] * r["h"], r["ord"])):
            x1, y1, x2, y2 = r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]
            best, owner = 0.0, None
            for o, b in boxes.items():
                share = max(0, min(x2 + 1, b[2]) - max(x1 - 1, b[0])) * max(0, min(y2 + 1, b[3]) - max(y1 - 1, b[1])) / max(1, r["w"] * r["h"])
                if share > best:
                    best, owner = share, o
            if best >= structural:
                b = boxes[owner]
                boxes[owner] = [min(b[0], x1), min(b[1], y1), max(b[2], x2), max(b[3], y2)]
                out.append((r["ord"], owner, "attached"))
            else:
                out.append((r["ord"], None, "kept" if r["score"] >= 0.95 and not r["edge"] else "dropped"))
        return out

    return by_page(f.unionAll(c), run, "page long, ord int, owner int, fate string")
