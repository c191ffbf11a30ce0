"""Boxes, slides and page rasters as Catalyst expressions.

Boxes are given by their columns: corner boxes as x1, y1, x2, y2, size boxes as x, y, w,
h.  All functions return Columns, so filters and joins stay inside generated code.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slide size in inches, limits of page rasters, relative tolerance.
SLIDE_WIDTH, SLIDE_HEIGHT, MIN_INCH, MAX_INCH = 13.333, 7.5, 1.0, 56.0
DPI = {"standard": 200.0, "detail": 300.0}
SHORT_EDGE, LONG_EDGE, PIXELS = 1200, 6000, 24_000_000


def span(a1, a2, b1, b2) -> Column:
    """Length of the overlap of two intervals, at least 0."""
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))


def area(x1, y1, x2, y2) -> Column:
    return F.greatest(F.lit(0), x2 - x1) * F.greatest(F.lit(0), y2 - y1)


def intersection(a, b) -> Column:
    """a, b: (x1, y1, x2, y2)."""
    return span(a[0], a[2], b[0], b[2]) * span(a[1], a[3], b[1], b[3])


def iou_floored(a, b) -> Column:
    """IoU whose union is at least 1."""
    both = intersection(a, b)
    return both / F.greatest(area(*a) + area(*b) - both, F.lit(1.0))


def iou(a, b) -> Column:
    """IoU without a floor; null where the union is empty."""
    both = intersection(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / F.nullif(union, F.lit(0))


def corners(x, y, w, h) -> tuple:
    return x, y, x + w, y + h


def overlap_of_smaller(a, b) -> Column:
    """Intersection over the smaller area (at least 1) of two size boxes."""
    return intersection(corners(*a), corners(*b)) / F.greatest(F.lit(1), F.least(a[2] * a[3], b[2] * b[3]))


def contains(a, b) -> Column:
    """a holds b, and they differ; corner boxes."""
    same = (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3]) & ~same


def intersects(a, b) -> Column:
    return (F.greatest(a[0], b[0]) < F.least(a[2], b[2])) & (F.greatest(a[1], b[1]) < F.least(a[3], b[3]))


def contains_center(a, b) -> Column:
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    return (a[0] <= cx) & (cx <= a[2]) & (a[1] <= cy) & (cy <= a[3])


def polygon_box(points) -> Column:
    """array<struct<x,y>> -> struct of truncated ints x, y, w, h."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    low, high = F.array_min, F.array_max
    return F.struct(low(xs).cast("int").alias("x"), low(ys).cast("int").alias("y"), (high(xs) - low(xs)).cast("int").alias("w"), (high(ys) - low(ys)).cast("int").alias("h"))


def valid_corners(x1, y1, x2, y2) -> Column:
    fine = [c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")) for c in (x1, y1, x2, y2)]
    return F.coalesce(fine[0] & fine[1] & fine[2] & fine[3] & (x1 < x2) & (y1 < y2), F.lit(False))


def tile_origins(length, size: int, overlap: int) -> Column:
    """Starts of tiles along an axis; the last tile is flush with the end."""
    last = length - size
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long"), F.lit(size - overlap).cast("long"))
    flush = F.when(F.element_at(steps, -1) == last, steps).otherwise(F.array_append(steps, last.cast("long")))
    return F.when(length <= size, F.array(F.lit(0).cast("long"))).otherwise(flush)


def tile_count(width, height, size: int, overlap: int) -> Column:
    return F.size(tile_origins(width, size, overlap)) * F.size(tile_origins(height, size, overlap))


def contain_fit(width, height, original: Column) -> dict[str, Column]:
    """Slide and content sizes in inches, and the content's offset.

    original true: the slide takes the picture's shape, its short side at least 1 inch
    (over 56 inches: null); false: a fixed widescreen slide with centred content.
    """
    scale = F.least(F.lit(SLIDE_WIDTH) / width, F.lit(SLIDE_HEIGHT) / height)
    cw, ch = width * scale, height * scale
    up = F.when(original & (F.least(cw, ch) < MIN_INCH), F.lit(MIN_INCH) / F.least(cw, ch)).otherwise(F.lit(1.0))
    cw, ch = cw * up, ch * up
    ok = ~original | (F.greatest(cw, ch) <= MAX_INCH + 1e-9)
    keep = lambda c: F.when(ok, c)
    return {
        "slide_width": keep(F.when(original, cw).otherwise(F.lit(SLIDE_WIDTH))),
        "slide_height": keep(F.when(original, ch).otherwise(F.lit(SLIDE_HEIGHT))),
        "content_width": keep(cw),
        "content_height": keep(ch),
        "offset_x": keep(F.when(original, F.lit(0.0)).otherwise((F.lit(SLIDE_WIDTH) - cw) / 2)),
        "offset_y": keep(F.when(original, F.lit(0.0)).otherwise((F.lit(SLIDE_HEIGHT) - ch) / 2)),
    }


def map_box(box, picture, fit: dict[str, Column]) -> dict[str, Column]:
    """A size box in pixels of a picture (w, h) -> inches on its slide."""
    (x, y, w, h), (pw, ph) = box, picture
    return {
        "left": fit["offset_x"] + x / pw * fit["content_width"],
        "top": fit["offset_y"] + y / ph * fit["content_height"],
        "width": w / pw * fit["content_width"],
        "height": h / ph * fit["content_height"],
    }


def map_box_on_canvas(box, canvas, offset, slide) -> dict[str, Column]:
    """The variant for a picture that stands inside a larger canvas."""
    (x, y, w, h), (cw, ch), (ox, oy), (sw, sh) = box, canvas, offset, slide
    return {"left": (x + ox) / cw * sw, "top": (y + oy) / ch * sh, "width": w / cw * sw, "height": h / ch * sh}


def widescreen(width, height) -> dict[str, Column]:
    """The smallest 16:9 canvas in whole units that holds the picture, and its offsets."""
    units = F.greatest(F.ceil(width / 16), F.ceil(height / 9))
    cw, ch = 16 * units, 9 * units
    return {"canvas_width": cw, "canvas_height": ch, "offset_x": F.floor((cw - width) / 2), "offset_y": F.floor((ch - height) / 2)}


def slide_coverage(x, y, w, h, slide_w, slide_h) -> Column:
    """Clipped share of the slide; null for sizes that aren't positive."""
    # As doubles: the products of sizes in slide units don't fit an int.
    x, y, w, h, slide_w, slide_h = (v.cast("double") for v in (x, y, w, h, slide_w, slide_h))
    inside = span(x, x + w, F.lit(0.0), slide_w) * span(y, y + h, F.lit(0.0), slide_h)
    return F.when((w > 0) & (h > 0) & (slide_w > 0) & (slide_h > 0), inside / (slide_w * slide_h))


def hex_rgb(color) -> Column:
    """'#rrggbb' -> array of three ints; other lengths give black."""
    c = F.regexp_replace(color, "^#+", "")
    part = lambda a: F.conv(F.substring(c, a, 2), 16, 10).cast("int")
    return F.when(F.length(c) == 6, F.array(part(1), part(3), part(5))).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))


def colors_close(a, b, most: float = 48.0) -> Column:
    """RGB distance at most `most`; where one can't be parsed, equality of the strings."""
    form = "^.[0-9a-fA-F]{6}"
    part = lambda c, i: F.conv(F.substring(c, i, 2), 16, 10).cast("double")
    far = F.sqrt(sum((F.pow(part(a, i) - part(b, i), 2) for i in (2, 4, 6)), F.lit(0.0)))
    return F.when(a.rlike(form) & b.rlike(form), far <= most).otherwise(a.eqNullSafe(b))


def repair_padding(height) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(4), F.bround(F.greatest(height, F.lit(1)) * 0.15).cast("int")))


def halo(height) -> Column:
    """Pixels around a text box; rounding is half to even."""
    return F.greatest(repair_padding(height), F.least(F.lit(12), F.bround(F.greatest(height, F.lit(1)) * 0.30).cast("int")))


def mask_dilation(height) -> Column:
    """Radius by which a text box's repair mask is widened."""
    return F.greatest(F.lit(2), F.least(F.lit(6), F.bround(height * 0.15).cast("int")))


def alignment(x, w, page_width) -> Column:
    """1: centred, 0: left."""
    off = F.abs(x + w / 2 - page_width / 2)
    return F.when(off < page_width * 0.05, 1).when((w >= page_width * 0.5) & (off < page_width * 0.15), 1).otherwise(0)


def scaled(value, donor, target, offset) -> Column:
    """A donor coordinate on target bounds, half to even."""
    return (F.bround(value * target / donor) + offset).cast("long")


def pixel_size(points, scale) -> Column:
    return F.greatest(F.lit(1), F.ceil(points * scale)).cast("long")


def fits_limits(width, height, scale) -> Column:
    w, h = pixel_size(width, scale), pixel_size(height, scale)
    return (F.greatest(w, h) <= LONG_EDGE) & (w * h <= PIXELS)


def _safe_scale(width: float, height: float, scale: float) -> float:
    def fits(s: float) -> bool:
        w, h = max(1, math.ceil(width * s)), max(1, math.ceil(height * s))
        return max(w, h) <= LONG_EDGE and w * h <= PIXELS

    if fits(scale):
        return scale
    low, high = 0.0, scale
    for _ in range(64):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return math.nextafter(low, 0.0)


def _safe_scales(width: pd.Series, height: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series([_safe_scale(w, h, s) for w, h, s in zip(width, height, scale, strict=True)], dtype="float64")


def safe_scale(width: Column, height: Column, scale: Column) -> Column:
    """The largest scale, by bisection, whose whole pixel sizes keep the limits."""
    return F.pandas_udf(_safe_scales, "double")(width, height, scale)


def render_plan(width, height, profile: str = "standard") -> dict[str, Column]:
    """Scale and reasons of a page raster, before whole pixels are made to fit."""
    w, h = width.cast("double"), height.cast("double")
    start = F.lit(DPI[profile] / 72.0)
    short = F.least(w, h) * start < SHORT_EDGE if profile == "standard" else F.lit(False)
    s1 = F.when(short, F.least(F.lit(float(SHORT_EDGE)) / F.least(w, h), F.lit(DPI["detail"] / 72.0))).otherwise(start)
    long = F.greatest(w, h) * s1 > LONG_EDGE
    s2 = F.when(long, F.lit(float(LONG_EDGE)) / F.greatest(w, h)).otherwise(s1)
    cap = F.lit(math.sqrt(PIXELS)) / F.sqrt(w) / F.sqrt(h)
    many = s2 > cap
    reasons = F.array_compact(F.array(F.when(short, F.lit("short_edge_floor")), F.when(long, F.lit("long_edge_ceiling")), F.when(many, F.lit("pixel_count_ceiling"))))
    return {"scale": F.when(many, cap).otherwise(s2), "reasons": reasons}


def same_ratio(first, other) -> Column:
    """Aspect ratios that agree within a relative 1e-4 or an absolute 1e-6."""
    return F.abs(first - other) <= F.greatest(1e-4 * F.greatest(F.abs(first), F.abs(other)), F.lit(1e-6))
