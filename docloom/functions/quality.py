"""Quality gates and region rules as boolean expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the gates.
RENDER_STATES = ("pending", "pending_gate", "frozen")
VISUAL_LIMITS = {"mae": 8.0, "p95": 32.0, "changed_ratio": 0.02}


def ratio(a, b) -> Column:
    return a / F.greatest(b, F.lit(1))


def background_residual(edge_pixels, retained) -> Column:
    return (F.coalesce(edge_pixels, F.lit(0)) >= 16) & (F.coalesce(retained, F.lit(0.0)) >= 0.45)


def text_only_fallback(p99, changed, largest) -> Column:
    zero = F.lit(0.0)
    return ((F.coalesce(p99, zero) > 5.0) & (F.coalesce(changed, zero) > 0.01)) | (F.coalesce(largest, zero) > 0.001)


def reconstruction_rejected(mae, p95) -> Column:
    return (mae > 12.0) | (p95 > 48.0)


def visual_rejected(mae, p95, changed) -> Column:
    return (mae > VISUAL_LIMITS["mae"]) | (p95 > VISUAL_LIMITS["p95"]) | (changed > VISUAL_LIMITS["changed_ratio"])


def large_mask(depth_ratio, mask_ratio, largest_ratio) -> Column:
    return (depth_ratio > 0.015) | ((mask_ratio > 0.08) & (largest_ratio > 0.04))


def shadow_halo(w, h, page_w, page_h, most_area=0.08, most_width=0.25, most_height=0.30) -> Column:
    return (ratio(w * h, page_w * page_h) <= most_area) & (ratio(w, page_w) <= most_width) & (ratio(h, page_h) <= most_height)


def dense_region(pixels, w, h, total, least_box=0.12, least_fill=0.30) -> Column:
    """A large filled region: beyond local repair, and cut as a solid box."""
    box = F.greatest(w * h, F.lit(1))
    return (ratio(box, total) >= least_box) & (pixels / box >= least_fill)


def replace_region_box(pixels, w, h, total) -> Column:
    box = F.greatest(w * h, F.lit(1))
    return dense_region(pixels, w, h, total) | ((ratio(box, total) <= 0.12) & (pixels / box >= 0.18))


def keep_mask(nonzero, total, most=0.45) -> Column:
    """A mask that doesn't take most of the page for foreground."""
    return F.coalesce((total > 0) & (nonzero / F.nullif(total, F.lit(0)) <= most), F.lit(False))


def limited_mask(nonzero, fallback_nonzero, total) -> Column:
    """Which mask is used: mask, fallback or none."""
    return F.when(keep_mask(nonzero, total), "mask").when(keep_mask(fallback_nonzero, total), "fallback").otherwise("none")


def noise_region(pixels, w, h, page_w, page_h, least=15) -> Column:
    full = (h >= page_h * 0.8) | (w >= page_w * 0.8)
    return (pixels < least) | (full & (pixels / F.greatest(w * h, F.lit(1)) < 0.30))


def render_active(kind, state) -> Column:
    return (kind != "text") & state.isin(*RENDER_STATES)


def native_allowed(shape, score, mad, enabled, qa, shapes, least_score, most_mad) -> Column:
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(enabled & qa & F.array_contains(shapes, shape) & fine(score) & (score >= least_score) & fine(mad) & (mad <= most_mad), F.lit(False))


def within_baseline(candidate: dict, baseline: dict, noise: dict, errors: tuple[str, ...]) -> Column:
    """Errors at most the baseline's plus the noise; similarity at least as good but for noise."""
    eps = 1e-12
    ok = candidate["ssim"] >= baseline["ssim"] - (1.0 - noise["ssim"]) - eps
    for name in errors:
        ok = ok & (candidate[name] <= baseline[name] + noise[name] + eps)
    return ok


def picture_reasons(p) -> Column:
    """Ordered reasons why a picture is left alone; p: name -> Column."""
    bad = ~p["transform_reliable"] | (p["cx"] <= 0) | (p["cy"] <= 0)
    outside = p["target_mode"] == "External"
    crop = (p["crop_left"] != 0) | (p["crop_top"] != 0) | (p["crop_right"] != 0) | (p["crop_bottom"] != 0)
    reason = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    return F.array_compact(
        F.array(
            F.when(bad, F.lit("unreliable_transform")).when(p["inside_group"], F.lit("inside_group")).when(p["coverage"] < 0.80, F.lit("coverage_below_threshold")),
            reason((p["rotation"] != 0) | p["flip_h"] | p["flip_v"], "rotation_or_flip"),
            reason(crop, "nonzero_crop"),
            reason(p["has_external"], "external_relationship"),
            reason(p["ambiguous"], "ambiguous_media_source"),
            F.when(F.coalesce(outside, F.lit(False)), F.lit(None)).when(~F.coalesce(p["media_present"], F.lit(False)), F.lit("missing_media")).when(~F.coalesce(p["media_valid"], F.lit(False)), F.lit("invalid_media")),
            reason(p["has_extension"] | p["has_timing_reference"], "unsupported_extension"),
        )
    )


def eligible_replacement(decision, category, confidence) -> Column:
    return (decision == "replace") & (category == "full_slide_screenshot") & (confidence >= 0.92)


def progress_key(largest, unexplained, count, background_text, component_text, duplicate, merged, mae, p95) -> Column:
    """Nine numbers compared from the left: smaller is better."""
    parts = (largest, unexplained, count, background_text, component_text, duplicate, merged, mae, p95)
    return F.struct(*[c.cast("double").alias(f"k{i}") for i, c in enumerate(parts)])


def check_state(value) -> Column:
    """pass, fail or unknown; anything else, and nothing, is unknown."""
    return F.when(value.isin("pass", "fail"), value).otherwise("unknown")


def same_entity(a_area, b_area, both, a_box, b_box, radius) -> Column:
    """Whether two masks are one entity; boxes as (x1, y1, x2, y2)."""
    small, large = F.least(a_area, b_area), F.greatest(a_area, b_area)
    ca, cb = both / a_area, both / b_area
    dx, dy = F.abs((a_box[0] + a_box[2]) / 2 - (b_box[0] + b_box[2]) / 2), F.abs((a_box[1] + a_box[3]) / 2 - (b_box[1] + b_box[3]) / 2)
    near = (dx <= F.greatest(radius * 3, F.greatest(a_box[2] - a_box[0], b_box[2] - b_box[0]) * 0.5)) & (dy <= F.greatest(radius * 3, F.greatest(a_box[3] - a_box[1], b_box[3] - b_box[1]) * 0.5))
    return ((ca >= 0.8) & (cb >= 0.8)) | ((F.greatest(ca, cb) >= 0.95) & (small / large >= 0.5)) | ((small / large >= 0.67) & (both / small >= 0.4) & near)


def gap_fragment(a_area, b_area, small, large, radius) -> Column:
    """A thin fragment that stands a small gap away from a larger mask."""
    least, most = F.least(a_area, b_area), F.greatest(a_area, b_area)
    w, h = small[2] - small[0], small[3] - small[1]
    gap_x = F.greatest(small[0] - large[2], large[0] - small[2], F.lit(0))
    gap_y = F.greatest(small[1] - large[3], large[1] - small[3], F.lit(0))
    over_y = F.greatest(F.lit(0), F.least(small[3], large[3]) - F.greatest(small[1], large[1]))
    over_x = F.greatest(F.lit(0), F.least(small[2], large[2]) - F.greatest(small[0], large[0]))
    beside = ((gap_x > 0) & (gap_x <= radius) & (over_y / h >= 0.5)) | ((gap_y > 0) & (gap_y <= radius) & (over_x / w >= 0.5))
    return (least / most <= 0.35) & (F.least(w, h) / F.greatest(w, h) <= 0.4) & beside
