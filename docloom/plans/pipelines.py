"""Page pipelines.

Models (text recognition, detection, segmentation, inpainting, language models) are
callables that the caller gives; they run in Arrow batches, once built per Python worker.
Everything around them is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as g
from docloom.functions import quality as q
from docloom.functions import text as t
from docloom.operators import aggregates, checks, greedy, joins, ranking

_MODELS: dict = {}


def model(key: str, factory: Callable[[], object]):
    """One model per worker and key."""
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def tiles(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """page, tile, x, y, w, h of a page's tiles (pages: page, width, height)."""
    xs, ys = g.tile_origins(F.col("width"), size, overlap), g.tile_origins(F.col("height"), size, overlap)
    rows = pages.withColumn("y", F.explode(ys)).withColumn("x", F.explode(xs))
    place = F.row_number().over(Window.partitionBy("page").orderBy("y", "x")) - 1
    return rows.select("page", place.alias("tile"), "x", "y", F.least(F.lit(size), F.col("width")).alias("w"), F.least(F.lit(size), F.col("height")).alias("h"), "width", "height")


def detect(tile_rows: DataFrame, factory: Callable, key: str = "detector") -> DataFrame:
    """page, ord, x, y, w, h, score, label, edge: boxes of all tiles in the page's frame.

    factory() -> f(list of tile dicts) -> list of lists of (x1, y1, x2, y2, score, label).
    A box that touches an inner tile border is marked `edge`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = model(key, factory)
        for pdf in batches:
            out = []
            rows = pdf.to_dict("records")
            for r, boxes in zip(rows, f(rows), strict=True):
                for n, (x1, y1, x2, y2, score, label) in enumerate(boxes):
                    edge = (x1 <= 0 < r["x"]) or (y1 <= 0 < r["y"]) or (x2 >= r["w"] and r["x"] + r["w"] < r["width"]) or (y2 >= r["h"] and r["y"] + r["h"] < r["height"])
                    out.append((r["page"], r["tile"] * 10_000 + n, x1 + r["x"], y1 + r["y"], x2 - x1, y2 - y1, score, label, bool(edge)))
            yield pd.DataFrame(out, columns=["page", "ord", "x", "y", "w", "h", "score", "label", "edge"])

    return tile_rows.mapInPandas(run, "page long, ord int, x double, y double, w double, h double, score double, label string, edge boolean")


def object_proposals(pages: DataFrame, factory: Callable, size: int = 640, overlap: int = 128, width: int = 4000, height: int = 3000) -> DataFrame:
    """Tile, detect, shift to the page, filter: the kept proposals."""
    found = detect(tiles(pages, size, overlap), factory)
    return found.join(greedy.filter_proposals(found, width, height, size, size), ["page", "ord"], "left_semi")


def mask_candidates(tile_rows: DataFrame, factory: Callable, key: str = "masks") -> DataFrame:
    """page, ord, score, mask (packed), x, y, h, w; score = min(iou, stability).

    factory() -> f(list of tile dicts) -> list of lists of (bool mask, iou, stability).
    """

    def run(batches):
        f = model(key, factory)
        for pdf in batches:
            out, rows = [], pdf.to_dict("records")
            for r, masks in zip(rows, f(rows), strict=True):
                for n, (m, iou, stability) in enumerate(masks):
                    out.append((r["page"], r["tile"] * 10_000 + n, min(iou, stability), np.packbits(m).tobytes(), r["x"], r["y"], m.shape[0], m.shape[1]))
            yield pd.DataFrame(out, columns=["page", "ord", "score", "mask", "x", "y", "h", "w"])

    return tile_rows.mapInPandas(run, "page long, ord int, score double, mask binary, x long, y long, h int, w int")


def prompted_masks(pages: DataFrame, prompts: DataFrame, factory: Callable, key: str = "prompted") -> DataFrame:
    """page, ord, score, mask: one embedding a page, all its prompts at once.

    pages: page, height, width, rgb; prompts: page, ord, box columns.  factory() ->
    f(raster, list of boxes) -> list of (mask, score).
    """
    p = prompts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("boxes"))

    def run(batches):
        f = model(key, factory)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                raster = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
                boxes = [(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]) for b in r.boxes]
                out += [(r.page, b["ord"], s, np.packbits(m).tobytes()) for b, (m, s) in zip(r.boxes, f(raster, boxes), strict=True)]
            yield pd.DataFrame(out, columns=["page", "ord", "score", "mask"])

    return pages.join(p, "page").select("page", "height", "width", "rgb", "boxes").mapInPandas(run, "page long, ord int, score double, mask binary")


def recognise(pages: DataFrame, factory: Callable, key: str = "ocr") -> DataFrame:
    """Text rows of pages; factory() -> f(list of page dicts) -> list of lists of item dicts."""

    def run(batches):
        f = model(key, factory)
        for pdf in batches:
            rows = pdf.to_dict("records")
            out = [{"page": r["page"], "ord": n, **item} for r, items in zip(rows, f(rows), strict=True) for n, item in enumerate(items)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in greedy.TEXT_SCHEMA.split(", ")])

    return pages.mapInPandas(run, greedy.TEXT_SCHEMA)


def recognise_crops(crops: DataFrame, factory: Callable, key: str = "recognition") -> DataFrame:
    """page, ord, text, confidence: crops are read in order of their aspect ratio (equal
    shapes make full batches) and come back under their own ordinals."""
    ordered = crops.withColumn("_ratio", F.col("w") / F.greatest(F.lit(1), F.col("h"))).sortWithinPartitions("_ratio").drop("_ratio")

    def run(batches):
        f = model(key, factory)
        for pdf in batches:
            got = f(pdf.to_dict("records"))
            yield pd.DataFrame({"page": pdf["page"], "ord": pdf["ord"], "text": [x[0] for x in got], "confidence": [x[1] for x in got]})

    return ordered.mapInPandas(run, "page long, ord int, text string, confidence double")


def inpaint(pages: DataFrame, factory: Callable, key: str = "inpaint", multiple: int = 8) -> DataFrame:
    """page, height, width, rgb: the model fills the mask; pixels outside stay as they are.

    pages: page, height, width, rgb, mask (packed).  The raster is padded to `multiple`.
    """

    def run(batches):
        f = model(key, factory)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                img = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
                m = np.unpackbits(np.frombuffer(r.mask, np.uint8))[: r.height * r.width].reshape(r.height, r.width).astype(bool)
                pad = ((0, -r.height % multiple), (0, -r.width % multiple))
                new = f(np.pad(img, (*pad, (0, 0)), mode="edge"), np.pad(m, pad))[: r.height, : r.width]
                out.append(np.where(m[..., None], new, img).astype(np.uint8).tobytes())
            yield pd.DataFrame({"page": pdf["page"], "height": pdf["height"], "width": pdf["width"], "rgb": out})

    return pages.mapInPandas(run, "page long, height int, width int, rgb binary")


def complete(requests: DataFrame, client: Callable[[], Callable[[str], str]], key: str = "chat") -> DataFrame:
    """page, response, status, duration_ms of language-model requests (page, prompt).

    client() -> f(prompt) -> text; a failure is a row with status `error`.
    """

    def run(batches):
        import time

        f = model(key, client)
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                began = time.perf_counter()
                try:
                    text, status = f(p), "success"
                except Exception as e:  # noqa: BLE001  a model's failure is data here
                    text, status = type(e).__name__, "error"
                out.append((text, status, round((time.perf_counter() - began) * 1000)))
            yield pd.DataFrame({"page": pdf["page"], "response": [o[0] for o in out], "status": [o[1] for o in out], "duration_ms": [o[2] for o in out]})

    return requests.mapInPandas(run, "page long, response string, status string, duration_ms long")


def text_items(raw: DataFrame, width: int, least: float = 0.7) -> DataFrame:
    """Recognised lines: noise dropped, small sizes dropped, merged, fonts and alignment set."""
    keep = raw.filter(~t.noise(F.col("text"), F.col("confidence"), F.col("w"), F.col("h"), least) & (F.col("font_size") >= 8))
    merged = greedy.merge_texts(keep.withColumn("text", F.trim("text")))
    merged = merged.withColumn("font_size", t.font_size(F.col("text"), F.col("font_size"))).withColumn("font", t.font(F.col("text")))
    return merged.withColumn("align", g.alignment(F.col("x"), F.col("w"), F.lit(width)))


def text_records(items: DataFrame, width: int, height: int) -> DataFrame:
    """page, text_id, x1, y1, x2, y2, text: cleaned, clipped to the page, numbered in order."""
    c = F.col
    x1, y1 = F.greatest(F.lit(0), F.floor("x")), F.greatest(F.lit(0), F.floor("y"))
    x2, y2 = F.least(F.lit(width), F.ceil(c("x") + c("w"))), F.least(F.lit(height), F.ceil(c("y") + c("h")))
    rows = items.select("page", "ord", F.trim("text").alias("text"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).filter("text <> '' and x1 < x2 and y1 < y2")
    place = F.row_number().over(Window.partitionBy("page").orderBy("ord"))
    return rows.select("page", F.format_string("text_%04d", place).alias("text_id"), "x1", "y1", "x2", "y2", "text")


def route(objects: DataFrame, shapes: DataFrame, policy: dict) -> DataFrame:
    """page, node, route: candidates of reconstruction_objects() routed under a policy.

    shapes: node, shape, score, mad.
    """
    rows = objects.select("page", "node", F.explode("candidates").alias("kind")).join(shapes, "node", "left")
    ok = q.native_allowed(F.col("shape"), F.col("score"), F.col("mad"), F.lit(policy["enabled"]), F.lit(policy["qa"]), F.array(*[F.lit(s) for s in policy["shapes"]]), policy["least_score"], policy["most_mad"])
    return ranking.choose_route(rows.withColumn("allowed", ok))


def evaluate_native(routes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Routes after the comparison of renders: nodes whose native form is worse fall back.

    metrics: page, node and c_*, b_*, n_* (candidate, baseline, noise) of the five measures.
    """
    names = ("normalized_mae", "changed_ratio", "edge_ratio", "largest_ratio")
    side = lambda p: {n: F.col(f"{p}_{n}") for n in (*names, "ssim")}
    failed = metrics.filter(~q.within_baseline(side("c"), side("b"), side("n"), names)).select("page", "node")
    native = routes.filter("route = 'native_shape'").select("page", "node")
    return ranking.fallback_routes(routes, failed.join(native, ["page", "node"], "left_semi"))


def page_quality(reports: DataFrame, pairs: DataFrame, page_checks: DataFrame) -> DataFrame:
    """page, violations, accepted: component reports, pixel measures and checks together."""
    visual = aggregates.visual_difference(pairs)
    return aggregates.page_violations(reports, visual, page_checks)


def reject_reason(metrics: DataFrame) -> DataFrame:
    """page, reason: the first that holds of raster text, residual, artifacts, difference."""
    c = F.col
    first = F.coalesce(
        F.when(c("raster_text") > 0, F.lit("raster_text")),
        F.when(q.background_residual(c("source_edge_pixels"), c("retained_edge_ratio")), F.lit("background_residual")),
        F.when(c("largest_artifact_ratio") > 0.001, F.lit("artifacts")),
        F.when(q.reconstruction_rejected(c("mae"), c("p95")), F.lit("visual_difference")),
    )
    return metrics.select("page", first.alias("reason"))


def clean_icons(items: DataFrame) -> DataFrame:
    """Texts without icon-like items and overlapping repeats."""
    kept = items.filter(~t.icon_text(F.col("text"), F.col("confidence"), F.col("w"), F.col("h")))
    return kept.join(greedy.deduplicate_texts(kept), ["page", "ord"], "left_semi")


def repair_round(nodes: DataFrame, actions: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: refuse a plan that breaks its contract, apply the rest, freeze by reports.

    Gives the new nodes and the refused rows (rule, page, node).
    """
    from docloom.operators import state

    bad = checks.plan_violations(actions, nodes)
    fine = actions.join(bad.select("page").distinct(), "page", "left_anti")
    done = greedy.execute_plan(nodes, fine)
    none = reports.select("page", "node").limit(0)
    return state.freeze(done, reports, none), bad


def repair(nodes: DataFrame, planner: Callable[[DataFrame, int], DataFrame], judge: Callable[[DataFrame], DataFrame], most: int = 5) -> DataFrame:
    """Rounds of plan, apply and judge until nothing is open, at most `most`.

    planner(nodes, round) -> actions; judge(nodes) -> page, node, accepted.
    """
    from docloom.operators.graph import _cut

    for n in range(1, most + 1):
        nodes, _ = repair_round(nodes, planner(nodes, n), judge(nodes))
        nodes = _cut(nodes)
        if not nodes.filter("state in ('pending', 'failed')").take(1):
            break
    return nodes


def variants(jobs: DataFrame) -> DataFrame:
    """job, path, size: output files of a batch, two where both sizes are asked for."""
    from docloom.sinks.writers import output_targets

    return output_targets(jobs)


def duplicates_of_known(items: DataFrame, known: DataFrame) -> DataFrame:
    """items without those that a known text matches."""
    return items.join(joins.known_text(items, known), ["page", "ord"], "left_anti")
