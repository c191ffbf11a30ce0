"""Registered queries: operators over the views, each with independent SQL where SQL can
say it.  A query without SQL is order dependent, iterative, or needs Unicode tables; it is
tested against plain Python in tests/."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import kernels
from docloom.functions import geometry as g
from docloom.functions import quality as q
from docloom.functions import text as t
from docloom.operators import aggregates, checks, graph, greedy, joins, ranking, state
from docloom.plans import pipelines
from docloom.sinks import writers
from docloom.sources import files, packages
from docloom.views import Views, with_views

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def take(f: Callable[[Views], DataFrame]):
        _FOUND[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_views(sql)
        return f

    return take


def box(df: DataFrame, **columns) -> DataFrame:
    """page, ord and computed columns."""
    return df.select("page", "ord", *[e.alias(n) for n, e in columns.items()])




def xywh() -> list:
    return [c("x"), c("y"), c("w"), c("h")]


def left() -> tuple:
    return joins.corner_columns("l_")


def right() -> tuple:
    return joins.corner_columns("r_")


# --- scalar functions over boxes --------------------------------------------------

query("bbox_relations", """
    WITH p AS (SELECT a.page, a.ord AS o1, b.ord AS o2,
        a.x <= b.x AND a.y <= b.y AND a.x + a.w >= b.x + b.w AND a.y + a.h >= b.y + b.h AND NOT (a.x = b.x AND a.y = b.y AND a.w = b.w AND a.h = b.h) AS ab,
        b.x <= a.x AND b.y <= a.y AND b.x + b.w >= a.x + a.w AND b.y + b.h >= a.y + a.h AND NOT (a.x = b.x AND a.y = b.y AND a.w = b.w AND a.h = b.h) AS ba
        FROM boxes a JOIN boxes b ON a.page = b.page AND a.ord < b.ord
        WHERE greatest(a.x, b.x) < least(a.x + a.w, b.x + b.w) AND greatest(a.y, b.y) < least(a.y + a.h, b.y + b.h))
    SELECT page, o1 AS a, o2 AS b, 'contains' AS relation FROM p WHERE ab UNION ALL SELECT page, o2, o1, 'contains' FROM p WHERE ba AND NOT ab
    UNION ALL SELECT page, o1, o2, 'overlaps' FROM p WHERE NOT ab AND NOT ba UNION ALL SELECT page, o2, o1, 'overlaps' FROM p WHERE NOT ab AND NOT ba""")(lambda v: joins.bbox_relations(v.boxes))  # fmt: skip

PAIRS = "boxes a JOIN boxes b ON a.page = b.page AND a.ord < b.ord AND greatest(a.x, b.x) < least(a.x + a.w, b.x + b.w) AND greatest(a.y, b.y) < least(a.y + a.h, b.y + b.h)"
BOTH = "(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def pairs(v: Views) -> DataFrame:
    return joins.overlapping_pairs(v.boxes, v.boxes).filter("l_ord < r_ord")


def on_pairs(v: Views, **columns) -> DataFrame:
    return pairs(v).select("page", c("l_ord").alias("a"), c("r_ord").alias("b"), *[e.alias(n) for n, e in columns.items()])


query("box_iou_floored", f"SELECT a.page, a.ord AS a, b.ord AS b, {BOTH} / greatest(CAST(a.w * a.h + b.w * b.h - {BOTH} AS DOUBLE), 1.0) AS iou FROM {PAIRS}")(lambda v: on_pairs(v, iou=g.iou_floored(left(), right())))
query("box_iou", f"SELECT a.page, a.ord AS a, b.ord AS b, {BOTH} / CAST(a.w * a.h + b.w * b.h - {BOTH} AS DOUBLE) AS iou FROM {PAIRS}")(lambda v: on_pairs(v, iou=g.iou(left(), right())))
query("box_overlap_of_smaller", f"SELECT a.page, a.ord AS a, b.ord AS b, {BOTH} / CAST(greatest(1, least(a.w * a.h, b.w * b.h)) AS DOUBLE) AS share FROM {PAIRS}")(
    lambda v: on_pairs(v, share=g.overlap_of_smaller([c(f"l_{n}") for n in "xywh"], [c(f"r_{n}") for n in "xywh"]))
)
query("box_contains_center", f"SELECT a.page, a.ord AS a, b.ord AS b, a.x <= b.x + b.w / 2.0 AND b.x + b.w / 2.0 <= a.x + a.w AND a.y <= b.y + b.h / 2.0 AND b.y + b.h / 2.0 <= a.y + a.h AS inside FROM {PAIRS}")(
    lambda v: on_pairs(v, inside=g.contains_center(left(), right()))
)
query("box_area", "SELECT page, ord, w * h AS area FROM boxes")(lambda v: box(v.boxes, area=g.area(*g.corners(*xywh()))))
query("text_bbox", "SELECT page, ord, x AS x1, y AS y1, x + w AS x2, y + h AS y2, w > 0 AND h > 0 AS valid FROM boxes")(
    lambda v: box(v.boxes, x1=c("x"), y1=c("y"), x2=c("x") + c("w"), y2=c("y") + c("h"), valid=g.valid_corners(*g.corners(*xywh())))
)
query("polygon_box", "SELECT page, ord, CAST(trunc(x + 0.25) AS INTEGER) AS px, CAST(trunc(y + 0.75) AS INTEGER) AS py, CAST(trunc(w + 0.25) AS INTEGER) AS pw, CAST(trunc(h + 0.0) AS INTEGER) AS ph FROM boxes")(
    lambda v: box(v.boxes, b=g.polygon_box(F.array(F.struct((c("x") + 0.25).alias("x"), (c("y") + 0.75).alias("y")), F.struct((c("x") + c("w") + 0.5).alias("x"), (c("y") + c("h") + 0.75).alias("y")))))
    .select("page", "ord", c("b.x").alias("px"), c("b.y").alias("py"), c("b.w").alias("pw"), c("b.h").alias("ph"))
)
query("tile_origins", "SELECT page, ord, CASE WHEN x + w <= 200 THEN '0' ELSE array_to_string(list_transform(generate_series(0, x + w - 200, 150), lambda z: CAST(z AS VARCHAR)), ',') || CASE WHEN (x + w - 200) % 150 = 0 THEN '' ELSE ',' || CAST(x + w - 200 AS VARCHAR) END END AS origins FROM boxes")(
    lambda v: box(v.boxes, origins=F.array_join(F.transform(g.tile_origins(c("x") + c("w"), 200, 50), lambda o: o.cast("string")), ","))
)
query("tile_budget", "SELECT page, ord, (CASE WHEN x + w <= 200 THEN 1 ELSE (x + w - 200 + 149) // 150 + 1 END) * (CASE WHEN y + h <= 200 THEN 1 ELSE (y + h - 200 + 149) // 150 + 1 END) * 100 AS budget FROM boxes")(
    lambda v: box(v.boxes, budget=g.tile_count(c("x") + c("w"), c("y") + c("h"), 200, 50) * 100)
)
_S = "least(13.333::DOUBLE / w, 7.5::DOUBLE / h)"
query("slide_transform_wide", f"SELECT page, ord, round(w * {_S}, 6) AS cw, round(h * {_S}, 6) AS ch, round((13.333::DOUBLE - w * {_S}) / 2, 6) + 0.0 AS ox, round((7.5::DOUBLE - h * {_S}) / 2, 6) + 0.0 AS oy FROM boxes")(
    lambda v: (lambda f: box(v.boxes, cw=F.round(f["content_width"], 6), ch=F.round(f["content_height"], 6), ox=F.round(f["offset_x"], 6) + 0.0, oy=F.round(f["offset_y"], 6) + 0.0))(g.contain_fit(c("w").cast("double"), c("h").cast("double"), F.lit(False)))
)
_U = f"CASE WHEN least(w * {_S}, h * {_S}) < 1.0 THEN 1.0 / least(w * {_S}, h * {_S}) ELSE 1.0 END"
query("slide_transform_original", f"SELECT page, ord, round(w * {_S} * {_U}, 6) AS sw, round(h * {_S} * {_U}, 6) AS sh FROM boxes WHERE greatest(w * {_S} * {_U}, h * {_S} * {_U}) <= 56.000000001")(
    lambda v: (lambda f: box(v.boxes, sw=F.round(f["slide_width"], 6), sh=F.round(f["slide_height"], 6)).filter("sw is not null"))(g.contain_fit(c("w").cast("double"), c("h").cast("double"), F.lit(True)))
)
query("map_box", "WITH f AS (SELECT *, least(13.333::DOUBLE / 1300, 7.5::DOUBLE / 700) AS s FROM boxes) SELECT page, ord, round((13.333::DOUBLE - 1300 * s) / 2 + x / 1300.0::DOUBLE * (1300 * s), 9) + 0.0 AS l, round((7.5::DOUBLE - 700 * s) / 2 + y / 700.0::DOUBLE * (700 * s), 9) + 0.0 AS t, round(w / 1300.0::DOUBLE * (1300 * s), 9) AS wi, round(h / 700.0::DOUBLE * (700 * s), 9) AS hi FROM f")(
    lambda v: (lambda m: box(v.boxes, l=F.round(m["left"], 9) + 0.0, t=F.round(m["top"], 9) + 0.0, wi=F.round(m["width"], 9), hi=F.round(m["height"], 9)))(g.map_box(xywh(), (F.lit(1300.0), F.lit(700.0)), g.contain_fit(F.lit(1300.0), F.lit(700.0), F.lit(False))))
)
query("map_box_canvas", "SELECT page, ord, round((x + 10) / 1600.0::DOUBLE * 13.333::DOUBLE, 9) AS l, round((y + 20) / 900.0::DOUBLE * 7.5::DOUBLE, 9) AS t FROM boxes")(
    lambda v: (lambda m: box(v.boxes, l=F.round(m["left"], 9), t=F.round(m["top"], 9)))(g.map_box_on_canvas(xywh(), (F.lit(1600.0), F.lit(900.0)), (10, 20), (F.lit(g.SLIDE_WIDTH), F.lit(g.SLIDE_HEIGHT))))
)
query("widescreen_canvas", "WITH u AS (SELECT *, greatest((w + 15) // 16, (h + 8) // 9) AS u FROM boxes) SELECT page, ord, 16 * u AS cw, 9 * u AS ch, (16 * u - w) // 2 AS ox, (9 * u - h) // 2 AS oy FROM u")(
    lambda v: (lambda m: box(v.boxes, cw=m["canvas_width"], ch=m["canvas_height"], ox=m["offset_x"], oy=m["offset_y"]))(g.widescreen(c("w"), c("h")))
)
query("slide_coverage", "SELECT page, ord, (greatest(0, least(x + w, 600) - greatest(x, 0)) * greatest(0, least(y + h, 400) - greatest(y, 0))) / 240000.0::DOUBLE AS coverage FROM boxes")(
    lambda v: box(v.boxes, coverage=g.slide_coverage(*xywh(), F.lit(600), F.lit(400)))
)
query("text_halo", "SELECT page, ord, greatest(greatest(2, least(4, CAST(round_even(greatest(h, 1) * 0.15::DOUBLE, 0) AS INTEGER))), least(12, CAST(round_even(greatest(h, 1) * 0.30::DOUBLE, 0) AS INTEGER))) AS halo FROM boxes")(lambda v: box(v.boxes, halo=g.halo(c("h"))))
query("mask_dilation", "SELECT page, ord, greatest(2, least(6, CAST(round_even(h * 0.15::DOUBLE, 0) AS INTEGER))) AS reach FROM boxes")(lambda v: box(v.boxes, reach=g.mask_dilation(c("h"))))
query("text_alignment", "SELECT page, ord, CASE WHEN abs(x + w / 2.0 - 500) < 50 THEN 1 WHEN w >= 500 AND abs(x + w / 2.0 - 500) < 150 THEN 1 ELSE 0 END AS align FROM boxes")(lambda v: box(v.boxes, align=g.alignment(c("x"), c("w"), F.lit(1000))))
query("map_shape", "SELECT page, ord, CAST(round_even(x * 12192 / 900.0::DOUBLE, 0) AS BIGINT) + 7 AS mx FROM boxes")(lambda v: box(v.boxes, mx=g.scaled(c("x"), F.lit(900), F.lit(12192), F.lit(7))))
query("pixel_dimensions", "SELECT page, ord, greatest(1, CAST(ceil(w * 2.75::DOUBLE) AS BIGINT)) AS pw, greatest(1, CAST(ceil(h * 2.75::DOUBLE) AS BIGINT)) AS ph FROM boxes")(lambda v: box(v.boxes, pw=g.pixel_size(c("w"), F.lit(2.75)), ph=g.pixel_size(c("h"), F.lit(2.75))))
query("pdf_render_plan", """
    WITH a AS (SELECT page, ord, CAST(w * 9 AS DOUBLE) AS w, CAST(h * 9 AS DOUBLE) AS h FROM boxes), b AS (SELECT *, least(w, h) * (200.0::DOUBLE / 72.0) < 1200 AS short FROM a),
    d AS (SELECT *, CASE WHEN short THEN least(1200.0::DOUBLE / least(w, h), 300.0::DOUBLE / 72.0) ELSE 200.0::DOUBLE / 72.0 END AS s1 FROM b), e AS (SELECT *, greatest(w, h) * s1 > 6000 AS long FROM d),
    f AS (SELECT *, CASE WHEN long THEN 6000.0::DOUBLE / greatest(w, h) ELSE s1 END AS s2 FROM e), k AS (SELECT *, sqrt(24000000.0::DOUBLE) / sqrt(w) / sqrt(h) AS cap FROM f)
    SELECT page, ord, round(CASE WHEN s2 > cap THEN cap ELSE s2 END, 9) AS scale, short, long, s2 > cap AS many FROM k""")(
    lambda v: (lambda p: box(v.boxes, scale=F.round(p["scale"], 9), short=F.array_contains(p["reasons"], "short_edge_floor"), long=F.array_contains(p["reasons"], "long_edge_ceiling"), many=F.array_contains(p["reasons"], "pixel_count_ceiling")))(g.render_plan(c("w") * 9, c("h") * 9))
)
query("pdf_job")(lambda v: files.pdf_job(v.boxes.select(c("page").alias("document"), c("ord"), (c("w") * 9).alias("width"), (c("h") * 9).alias("height"))))
query("aspect_ratios_match", "SELECT page, bool_and(abs(r - f) <= greatest(0.0001::DOUBLE * greatest(abs(r), abs(f)), 0.000001::DOUBLE)) AS same FROM (SELECT page, CAST(w AS DOUBLE) / h AS r, first_value(CAST(w AS DOUBLE) / h) OVER (PARTITION BY page ORDER BY ord) AS f FROM boxes) GROUP BY page")(
    lambda v: v.boxes.withColumn("r", c("w") / c("h")).withColumn("f", F.first("r").over(Window.partitionBy("page").orderBy("ord"))).groupBy("page").agg(F.bool_and(g.same_ratio(c("f"), c("r"))).alias("same"))
)

# --- text functions ---------------------------------------------------------------

query("normalized_text", "SELECT page, ord, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM text_items")(lambda v: box(v.text_items, t=t.normalized_ascii(c("text"))))
query("compact_text", "SELECT page, ord, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM text_items")(lambda v: box(v.text_items, t=t.compact_ascii(c("text"))))
query("normalized_text_unicode")(lambda v: box(v.text_items, t=t.normalized(c("text")), k=t.compact(c("text"))))
query("label_tokens", "SELECT page, ord, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(trim(label), '\\s+'), lambda z: z <> ''), lambda z: lower(trim(z, '.,'))))), ' ') AS tokens FROM boxes")(lambda v: box(v.boxes, tokens=F.array_join(F.array_sort(t.tokens(c("label"))), " ")))
_T = "list_transform(regexp_split_to_array(trim(label), '\\s+'), lambda z: lower(trim(z, '.,')))"
query("object_role", f"SELECT page, ord, CASE WHEN p AND k THEN 'mixed' WHEN p THEN 'person' WHEN k THEN 'container' ELSE 'object' END AS role FROM (SELECT page, ord, list_has_any({_T}, ['person', 'player', 'portrait']) AS p, list_has_any({_T}, ['card', 'panel', 'chart', 'table', 'frame', 'border']) AS k FROM boxes)")(lambda v: box(v.boxes, role=t.role(c("label"))))
query("font_choice", "SELECT page, ord, 'Arial' AS font, font_size AS size, false AS cjk FROM text_items")(lambda v: box(v.text_items, font=t.font(c("text")), size=t.font_size(c("text"), c("font_size")), cjk=t.has_cjk(c("text"))))
query("font_choice_cjk", "SELECT page, ord, 'Microsoft YaHei' AS font, round(CASE WHEN font_size >= 80 THEN font_size * 0.88::DOUBLE WHEN font_size >= 48 THEN font_size * 0.90::DOUBLE ELSE font_size END, 1) AS size FROM text_items")(
    lambda v: (lambda s: box(v.text_items, font=t.font(s), size=t.font_size(s, c("font_size"))))(F.concat(c("text"), F.lit("中")))
)
query("ocr_language", "SELECT DISTINCT lang, CASE WHEN lang IN ('ch', 'zh', 'cn') THEN 'chi_sim+eng' WHEN lang = 'en' THEN 'eng' ELSE lang END AS pack FROM documents")(lambda v: v.table("documents").select("lang", t.ocr_language(c("lang")).alias("pack")).distinct())
query("hex_rgb", "SELECT page, ord, CAST('0x' || substr(color, 2, 2) AS INTEGER) AS r, CAST('0x' || substr(color, 4, 2) AS INTEGER) AS g, CAST('0x' || substr(color, 6, 2) AS INTEGER) AS b FROM text_items")(lambda v: (lambda a: box(v.text_items, r=a[0], g=a[1], b=a[2]))(g.hex_rgb(c("color"))))
query("colors_close", "WITH h AS (SELECT page, ord, color, CAST('0x' || substr(color, 2, 2) AS INTEGER) AS r, CAST('0x' || substr(color, 4, 2) AS INTEGER) AS g, CAST('0x' || substr(color, 6, 2) AS INTEGER) AS b FROM text_items) SELECT a.page, a.ord, sqrt(pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2)) <= 48.0 AS near FROM h a JOIN h b ON a.page = b.page AND b.ord = a.ord + 1")(
    lambda v: (lambda a, b: a.join(b, (a["page"] == b["page"]) & (b["o2"] == a["ord"] + 1)).select(a["page"], a["ord"], g.colors_close(a["color"], b["k2"]).alias("near")))(v.text_items.select("page", "ord", "color"), v.text_items.select("page", c("ord").alias("o2"), c("color").alias("k2")))
)
query("utc_time", "SELECT event_id, epoch_us(ts) AS us FROM trace")(lambda v: v.trace.select("event_id", F.unix_micros(t.utc_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).alias("us")))
query("version_compatible", "WITH p AS (SELECT page, ord, [x % 3, y % 4, w % 5] AS a, [z % 3, h % 4, x % 5] AS b, x % 4 AS k FROM boxes) SELECT page, ord, a > b OR (a = b AND k <> 0) AS ok FROM p")(
    lambda v: box(v.boxes, ok=t.version_compatible(F.concat_ws(".", c("x") % 3, c("y") % 4, F.concat((c("w") % 5).cast("string"), F.when(c("x") % 4 == 0, "rc1").otherwise(""))), F.concat_ws(".", c("z") % 3, c("h") % 4, c("x") % 5)))
)
query("ooxml_integer", "SELECT page, ord, CASE WHEN x % 3 <> 0 THEN CAST(x AS BIGINT) END AS n, CASE WHEN x % 7 = 0 THEN 0 WHEN x % 3 <> 0 THEN CAST(x AS BIGINT) ELSE 1 END AS crop FROM boxes")(
    lambda v: (lambda s, k: box(v.boxes, n=t.ooxml_integer(s), crop=t.crop_value(k)))(F.when(c("x") % 3 != 0, c("x").cast("string")).otherwise("1e5"), F.when(c("x") % 7 != 0, F.when(c("x") % 3 != 0, c("x").cast("string")).otherwise("1e5")))
)
query("safe_member", "SELECT page_id, NOT regexp_matches(p, '(^|/)\\.{1,2}(/|$)') AND NOT p LIKE '%//%' AND NOT p LIKE '%/' AS ok FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*', '') AS p FROM pages)")(
    lambda v: v.table("pages").select("page_id", t.safe_member(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*", "")).alias("ok"))
)
query("part_target")(lambda v: v.table("pages").select("page_id", t.part_target(F.concat(F.lit("ppt/slides/s"), c("page_id").cast("string"), F.lit(".xml")), F.when(c("page_id") % 3 == 0, "../media/a.png").when(c("page_id") % 3 == 1, "/ppt/b.xml").otherwise("../../../x")).alias("target")))
query("fallback_parent", "SELECT page, node, coalesce(CAST(parent AS VARCHAR), 'parent_' || CAST(node AS VARCHAR)) AS parent FROM nodes")(lambda v: v.nodes.select("page", "node", t.fallback_parent(F.concat(F.lit("component_"), c("node").cast("string")), c("parent").cast("string")).alias("parent")))
query("document_hash", "SELECT page, ord, sha256('{\"h\":' || h || ',\"w\":' || w || ',\"x\":' || x || ',\"y\":' || y || '}') AS sha FROM boxes")(lambda v: box(v.boxes, sha=F.sha2(F.to_json(F.struct("h", "w", "x", "y")), 256)))
query("plan_hash", "SELECT page, sha256(string_agg(CAST(node AS VARCHAR) || ':' || verb, ',' ORDER BY node)) AS sha FROM actions GROUP BY page")(
    lambda v: v.actions.groupBy("page").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "verb"))), lambda s: F.concat(s["node"].cast("string"), F.lit(":"), s["verb"])), ","), 256).alias("sha"))
)

# --- filters ----------------------------------------------------------------------

_NOISE = """
    WITH a AS (SELECT page, ord, trim(text) AS t, confidence, w, h FROM text_items),
    b AS (SELECT *, length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) AS n, length(replace(t, ' ', '')) AS total, regexp_matches(t, '[-_./]') AS parted,
        regexp_matches(t, '^[\\p{L}\\p{N}]+([-_./][\\p{L}\\p{N}]+)*$') AS form, regexp_matches(t, '^[\\p{L}\\p{N}\\-_./]+$') AS compact, length(regexp_replace(t, '\\P{L}', '', 'g')) AS letters, length(regexp_replace(t, '\\P{Lu}', '', 'g')) AS up FROM a),
    d AS (SELECT *, form AND n >= CASE WHEN parted THEN 4 ELSE 2 END AS label FROM b)
    SELECT page, ord FROM d WHERE NOT (t = '' OR confidence < 0.7 OR regexp_matches(t, '^[\\s\\-_=.|/\\\\:;,!?~`@#$%^&*(){}\\[\\]<>+''"]+$')
        OR (w > 0 AND h > 0 AND h / CAST(w AS DOUBLE) >= 1.8 AND w <= 36 AND regexp_matches(t, '[A-Za-z0-9]')) OR (total > 0 AND n / CAST(total AS DOUBLE) < 0.6) OR (parted AND compact AND NOT label)
        OR (length(t) = 1 AND NOT regexp_matches(t, '^[\\p{L}\\p{N}]$')) OR (letters >= 4 AND up / CAST(letters AS DOUBLE) > 0.8 AND regexp_matches(t, '[:;./\\\\]') AND NOT label))"""
query("noise_filter", _NOISE)(lambda v: v.text_items.filter(~t.noise(c("text"), c("confidence"), c("w"), c("h"))).select("page", "ord"))
query("vertical_fragment", "SELECT page, ord FROM text_items WHERE h / CAST(w AS DOUBLE) >= 1.8 AND w <= 36 AND regexp_matches(trim(text), '[A-Za-z0-9]')")(lambda v: v.text_items.filter(t.vertical_fragment(c("text"), c("w"), c("h"))).select("page", "ord"))
query("icon_text_filter", "SELECT page, ord FROM text_items WHERE NOT (confidence < 0.9 AND length(regexp_replace(text, '\\s+', '', 'g')) <= 2 AND greatest(1, w) / CAST(greatest(1, h) AS DOUBLE) BETWEEN 0.65 AND 1.5)")(lambda v: v.text_items.filter(~t.icon_text(c("text"), c("confidence"), c("w"), c("h"))).select("page", "ord"))
query("icon_text", "SELECT page, ord FROM text_items WHERE confidence < 0.9 AND length(regexp_replace(text, '\\s+', '', 'g')) <= 2 AND greatest(1, w) / CAST(greatest(1, h) AS DOUBLE) BETWEEN 0.65 AND 1.5")(lambda v: v.text_items.filter(t.icon_text(c("text"), c("confidence"), c("w"), c("h"))).select("page", "ord"))
query("icon_analysis")(lambda v: pipelines.clean_icons(v.text_items).select("page", "ord"))
query("proposal_filter")(lambda v: greedy.filter_proposals(v.boxes, 900, 600, 300, 300))
query("keep_detector_mask", "SELECT page, ord, (x % 97) / 96.0::DOUBLE <= 0.45 AS keep, CASE WHEN (x % 97) / 96.0::DOUBLE <= 0.45 THEN 'mask' WHEN (y % 97) / 96.0::DOUBLE <= 0.45 THEN 'fallback' ELSE 'none' END AS choice FROM boxes")(
    lambda v: box(v.boxes, keep=q.keep_mask(c("x") % 97, F.lit(96)), choice=q.limited_mask(c("x") % 97, c("y") % 97, F.lit(96)))
)
query("region_rules", f"""SELECT page, ord, (w * h) / 60000.0::DOUBLE >= 0.12 AND (x * 9) / CAST(w * h AS DOUBLE) >= 0.30 AS dense,
    ((w * h) / 60000.0::DOUBLE >= 0.12 AND (x * 9) / CAST(w * h AS DOUBLE) >= 0.30) OR ((w * h) / 60000.0::DOUBLE <= 0.12 AND (x * 9) / CAST(w * h AS DOUBLE) >= 0.18) AS replace_box,
    (w * h) / 60000.0::DOUBLE <= 0.08 AND w / 300.0::DOUBLE <= 0.25 AND h / 200.0::DOUBLE <= 0.30 AS halo, x < 15 OR ((h >= 160 OR w >= 240) AND x / CAST(w * h AS DOUBLE) < 0.30) AS noise FROM boxes""")(
    lambda v: box(v.boxes, dense=q.dense_region(c("x") * 9, c("w"), c("h"), F.lit(60000)), replace_box=q.replace_region_box(c("x") * 9, c("w"), c("h"), F.lit(60000)), halo=q.shadow_halo(c("w"), c("h"), F.lit(300), F.lit(200)), noise=q.noise_region(c("x"), c("w"), c("h"), F.lit(300), F.lit(200)))
)
query("quality_gates", """SELECT page, round, p95 >= 16 AND mae / 13 >= 0.45 AS residual, (p95 > 5.0 AND mae / 100 > 0.01) OR largest / 1000 > 0.001 AS fallback, mae > 12.0 OR p95 > 48.0 AS rejected,
    mae > 8.0 OR p95 > 32.0 OR unexplained / 100 > 0.02 AS visual, largest / 100 > 0.015 OR (mae / 100 > 0.08 AND p95 / 100 > 0.04) AS large FROM rounds""")(
    lambda v: v.rounds.select("page", "round", q.background_residual(c("p95"), c("mae") / 13).alias("residual"), q.text_only_fallback(c("p95"), c("mae") / 100, c("largest") / 1000).alias("fallback"), q.reconstruction_rejected(c("mae"), c("p95")).alias("rejected"), q.visual_rejected(c("mae"), c("p95"), c("unexplained") / 100).alias("visual"), q.large_mask(c("largest") / 100, c("mae") / 100, c("p95") / 100).alias("large"))
)
query("render_active", "SELECT page, node FROM nodes WHERE kind <> 'text' AND state IN ('pending', 'pending_gate', 'frozen')")(lambda v: v.nodes.filter(q.render_active(c("kind"), c("state"))).select("page", "node"))
query("active_nodes", "SELECT page, node, row_number() OVER (PARTITION BY page ORDER BY ord) AS place FROM nodes WHERE kind <> 'text' AND state IN ('pending', 'pending_gate', 'frozen')")(
    lambda v: ranking.top_per_page(v.nodes.filter(q.render_active(c("kind"), c("state"))), 10**6, c("ord")).select("page", "node", F.row_number().over(Window.partitionBy("page").orderBy("ord")).alias("place"))
)
query("native_gate", "SELECT page, ord, label IN ('chart', 'panel') AND score >= 0.95 AND h % 20 <= 6 AS ok FROM boxes")(
    lambda v: box(v.boxes, ok=q.native_allowed(c("label"), c("score"), (c("h") % 20).cast("double"), F.lit(True), F.lit(True), F.array(F.lit("chart"), F.lit("panel")), 0.95, 6.0))
)
query("within_baseline", "SELECT page, round, mae <= p95 + 1 + 1e-12 AND largest <= unexplained + 1 + 1e-12 AND largest / 5 >= unexplained / 7 - (1.0 - 0.9) - 1e-12 AS ok FROM rounds")(
    lambda v: v.rounds.select("page", "round", q.within_baseline({"a": c("mae"), "b": c("largest"), "ssim": c("largest") / 5}, {"a": c("p95"), "b": c("unexplained"), "ssim": c("unexplained") / 7}, {"a": F.lit(1.0), "b": F.lit(1.0), "ssim": F.lit(0.9)}, ("a", "b")).alias("ok"))
)
query("picture_safety", """SELECT page, ord, array_to_string(list_filter([CASE WHEN x % 11 = 0 THEN 'unreliable_transform' WHEN x % 5 = 0 THEN 'inside_group' WHEN (greatest(0, least(x + w, 200)  - x) * greatest(0, least(y + h, 100) - y)) / 20000.0::DOUBLE < 0.80 THEN 'coverage_below_threshold' END,
    CASE WHEN x % 3 = 0 THEN 'rotation_or_flip' END, CASE WHEN y % 3 = 0 THEN 'nonzero_crop' END, CASE WHEN y % 7 = 0 THEN 'external_relationship' END, CASE WHEN w % 5 = 0 THEN 'ambiguous_media_source' END,
    CASE WHEN y % 7 = 0 THEN NULL WHEN h % 4 = 0 THEN 'missing_media' WHEN h % 6 = 1 THEN 'invalid_media' END, CASE WHEN h % 9 = 0 THEN 'unsupported_extension' END], lambda z: z IS NOT NULL), ',') AS reasons FROM boxes""")(
    lambda v: box(v.boxes, reasons=F.array_join(q.picture_reasons({"transform_reliable": c("x") % 11 != 0, "cx": c("w"), "cy": c("h"), "inside_group": c("x") % 5 == 0, "coverage": g.slide_coverage(*xywh(), F.lit(200), F.lit(100)), "rotation": F.when(c("x") % 3 == 0, 90).otherwise(0), "flip_h": F.lit(False), "flip_v": F.lit(False), "crop_left": F.when(c("y") % 3 == 0, 1).otherwise(0), "crop_top": F.lit(0), "crop_right": F.lit(0), "crop_bottom": F.lit(0), "has_external": c("y") % 7 == 0, "ambiguous": c("w") % 5 == 0, "target_mode": F.when(c("y") % 7 == 0, "External").otherwise("Internal"), "media_present": c("h") % 4 != 0, "media_valid": c("h") % 6 != 1, "has_extension": c("h") % 9 == 0, "has_timing_reference": F.lit(False)}), ","))
)

# --- joins ------------------------------------------------------------------------

query("known_text", """WITH k AS (SELECT page, ord, x, y, w, h, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM text_items),
    p AS (SELECT a.page, a.ord, a.t AS s, b.t AS t, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / CAST(greatest(1, least(a.w * a.h, b.w * b.h)) AS DOUBLE) AS o
    FROM k a JOIN k b ON a.page = b.page AND b.ord % 2 = 0 AND greatest(a.x, b.x) < least(a.x + a.w, b.x + b.w) AND greatest(a.y, b.y) < least(a.y + a.h, b.y + b.h) WHERE a.ord % 2 = 1)
    SELECT DISTINCT page, ord FROM p WHERE (o >= 0.8 AND (s = t OR (least(length(s), length(t)) >= 4 AND (contains(s, t) OR contains(t, s))))) OR (o >= 0.5 AND s = t)""")(
    lambda v: (lambda a: joins.known_text(a.filter("ord % 2 = 1"), a.filter("ord % 2 = 0"), True))(v.text_items)
)
query("known_text_similar")(lambda v: joins.known_text(v.text_items.filter("ord % 2 = 1"), v.text_items.filter("ord % 2 = 0")))
query("targeted_sweep")(lambda v: greedy.two_views(v.text_items.filter("ord % 2 = 1"), v.text_items.filter("ord % 2 = 0")))
query("text_deduplication")(lambda v: greedy.deduplicate_texts(v.text_items))
query("text_metrics")(lambda v: greedy.text_metrics(v.text_items, v.text_items.filter("page % 3 <> 0 or ord <> 2")))
_D = "SELECT page, ord, x, y, w, h FROM boxes WHERE z % 2 = 1"
_UNC = f"SELECT a.page, a.ord FROM ({_D}) a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = a.page AND b.z % 2 = 0 AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / CAST(greatest(1, a.w * a.h) AS DOUBLE) >= 0.8)"
query("unowned_text_anti", _UNC)(lambda v: joins.uncovered(v.boxes.filter("z % 2 = 1"), v.boxes.filter("z % 2 = 0")).select("page", "ord"))
query("unowned_text_check", f"SELECT page, CASE WHEN count(u.ord) > 0 THEN 'fail' ELSE 'pass' END AS \"check\" FROM ({_D}) d LEFT JOIN ({_UNC}) u USING (page, ord) GROUP BY page")(lambda v: joins.unowned_text_check(v.boxes.filter("z % 2 = 1"), v.boxes.filter("z % 2 = 0")))
_O = "SELECT a.page, a.ord, b.ord AS owner, a.w * a.h AS size, b.z, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS n FROM boxes a JOIN boxes b ON a.page = b.page AND a.z % 2 = 1 AND b.z % 2 = 0 AND greatest(a.x, b.x) < least(a.x + a.w, b.x + b.w) AND greatest(a.y, b.y) < least(a.y + a.h, b.y + b.h)"
query("text_owner", f"SELECT page, ord, owner FROM ({_O}) QUALIFY row_number() OVER (PARTITION BY page, ord ORDER BY n DESC, owner) = 1 AND n / CAST(greatest(1, size) AS DOUBLE) >= 0.2")(lambda v: joins.best_owner(v.boxes.filter("z % 2 = 1"), v.boxes.filter("z % 2 = 0")))
query("repaired_component", f"SELECT page, ord, owner FROM ({_O}) QUALIFY row_number() OVER (PARTITION BY page, ord ORDER BY n DESC, z DESC, owner) = 1")(lambda v: joins.repaired_component(v.boxes.filter("z % 2 = 1"), v.boxes.filter("z % 2 = 0")))
query("residual_owners", """WITH n AS (SELECT * FROM nodes WHERE kind <> 'text' AND state IN ('pending', 'pending_gate', 'frozen')), r AS (SELECT page, ord, x, y, w, h FROM nodes WHERE kind = 'text'),
    t AS (SELECT r.page, r.ord, n.node AS owner FROM r JOIN n ON r.page = n.page AND greatest(0, least(r.x + r.w + 4, n.x + n.w) - greatest(r.x - 4, n.x)) * greatest(0, least(r.y + r.h + 4, n.y + n.h) - greatest(r.y - 4, n.y)) >= greatest(1, round_even(n.w * n.h * 0.0002::DOUBLE, 0))),
    k AS (SELECT r.page, r.ord, n.node AS owner FROM r JOIN n ON r.page = n.page AND n.x <= r.x AND n.y <= r.y AND n.x + n.w >= r.x + r.w AND n.y + n.h >= r.y + r.h WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = r.page AND t.ord = r.ord) QUALIFY row_number() OVER (PARTITION BY r.page, r.ord ORDER BY n.w * n.h, -n.z, n.node) = 1)
    SELECT * FROM t UNION ALL SELECT * FROM k""")(lambda v: joins.residual_owners(v.nodes.filter("kind = 'text'"), v.nodes.filter(q.render_active(c("kind"), c("state")))))
query("nearest_target", """WITH p AS (SELECT a.page, a.ord, b.ord AS o, b.w * b.h AS s, greatest(b.x - (a.x + a.w), a.x - (b.x + b.w), 0) AS dx, greatest(b.y - (a.y + a.h), a.y - (b.y + b.h), 0) AS dy FROM boxes a JOIN boxes b ON a.page = b.page AND a.z % 2 = 1 AND b.z % 2 = 0
    AND greatest(a.x, b.x - 3) < least(a.x + a.w, b.x + b.w + 3) AND greatest(a.y, b.y - 3) < least(a.y + a.h, b.y + b.h + 3)) SELECT page, ord, o AS owner FROM p QUALIFY row_number() OVER (PARTITION BY page, ord ORDER BY sqrt(dx * dx + dy * dy), s, o) = 1""")(
    lambda v: joins.nearest_target(v.boxes.filter("z % 2 = 1"), v.boxes.filter("z % 2 = 0"))
)
query("contained_parents", "SELECT a.page, a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON a.page = b.page AND a.node < b.node AND a.kind = 'parent' AND b.kind = 'parent' WHERE greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / CAST(least(a.w * a.h, b.w * b.h) AS DOUBLE) >= 0.95")(lambda v: joins.contained_parents(v.nodes))
query("overlap_reports", "WITH k AS (SELECT a.page, a.y, a.x, a.m, b.px > 127 AS t FROM pairs a JOIN cells b ON a.page = b.page AND a.y = b.y AND a.x = b.x) SELECT page, 1 AS ord, count(*) AS pixels, count_if(t) AS overlap, count_if(t) / CAST(count(*) AS DOUBLE) AS share FROM k WHERE m GROUP BY page HAVING count_if(t) >= 16 AND count_if(t) / CAST(count(*) AS DOUBLE) >= 0.02")(
    lambda v: joins.overlap_reports(v.cells.filter("mask").select("page", F.lit(1).alias("ord"), "y", "x"), v.cells.filter("px > 127"))
)
query("component_text_overlap", "SELECT page, count_if(mask AND px > 127) >= 16 AS overlaps FROM cells GROUP BY page HAVING count_if(mask AND px > 127) >= 16 AND count_if(mask AND px > 127) / CAST(count_if(mask) AS DOUBLE) >= 0.02")(
    lambda v: joins.overlap_reports(v.cells.filter("mask").select("page", F.lit(1).alias("ord"), "y", "x"), v.cells.filter("px > 127")).select("page", F.lit(True).alias("overlaps"))
)
_REP = lambda v: v.nodes.filter("ord % 2 = 1").select("page", "node", F.when(c("x") % 2 == 0, F.array(F.lit("component_overlap"))).otherwise(F.array(F.lit("edge_loss"))).alias("violations"), F.array(c("node") + 1, c("page") * 100 + 1).alias("overlap_ids"))
query("overlap_dependencies", "WITH r AS (SELECT page, unnest([node + 1, page * 100 + 1]) AS node FROM nodes WHERE ord % 2 = 1 AND x % 2 = 0) SELECT DISTINCT r.page, r.node FROM r JOIN nodes n ON r.page = n.page AND r.node = n.node WHERE n.kind <> 'text' AND n.state = 'frozen'")(lambda v: joins.overlap_dependencies(_REP(v), v.nodes))
query("multiset_text_diff", "WITH a AS (SELECT page, md5(text) AS k, count(*) AS a FROM text_items GROUP BY ALL), b AS (SELECT page, md5(text) AS k, count(*) AS b FROM text_items WHERE ord <> 2 GROUP BY ALL) SELECT page, k, greatest(coalesce(a, 0) - coalesce(b, 0), 0) AS missing, greatest(coalesce(b, 0) - coalesce(a, 0), 0) AS extra FROM a FULL JOIN b USING (page, k) WHERE coalesce(a, 0) <> coalesce(b, 0)")(
    lambda v: (lambda s: joins.multiset_difference(s, s.filter("ord <> 2"), "page", "k"))(v.text_items.select("page", "ord", F.md5("text").alias("k")))
)
query("positional_join", "WITH a AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY ord) AS place, x, w FROM boxes), b AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY ord) AS place, x, CASE WHEN x % 5 = 0 THEN w + 1 ELSE w END AS w FROM boxes WHERE NOT (ord = 1 AND x % 3 = 0)), j AS (SELECT page, place, a.x AS ax, b.x AS bx, a.w AS aw, b.w AS bw FROM a FULL JOIN b USING (page, place)) SELECT page, place, '(missing)' AS field FROM j WHERE ax IS NULL OR bx IS NULL UNION ALL SELECT page, place, 'x' FROM j WHERE ax <> bx UNION ALL SELECT page, place, 'w' FROM j WHERE aw <> bw")(
    lambda v: joins.positional(v.boxes, v.boxes.filter("not (ord = 1 and x % 3 = 0)").withColumn("w", F.when(c("x") % 5 == 0, c("w") + 1).otherwise(c("w"))), "page", "ord", "x", "w")
)
query("shadow_plans", "WITH s AS (SELECT page, arg_max(state, seq) AS state FROM state_log GROUP BY page) SELECT page, object, decision, n > 1 AS conflict, state FROM (SELECT *, count(*) OVER (PARTITION BY page) AS n, row_number() OVER (PARTITION BY page ORDER BY object) AS r FROM decisions) d LEFT JOIN s USING (page) WHERE r = 1")(
    lambda v: joins.shadow_plans(v.decisions, v.state_log.groupBy("page").agg(F.max_by("state", "seq").alias("state")))
)
query("undecided_candidates", "SELECT doc_id % 50 AS page, doc_id AS object FROM documents d WHERE NOT EXISTS (SELECT 1 FROM decisions e WHERE e.object = d.doc_id)")(lambda v: joins.undecided(v.table("documents").select((c("doc_id") % 50).alias("page"), c("doc_id").alias("object")), v.decisions))
query("next_candidate", "SELECT page, object FROM (SELECT doc_id % 50 AS page, doc_id AS object FROM documents d WHERE NOT EXISTS (SELECT 1 FROM decisions e WHERE e.object = d.doc_id)) ORDER BY page, object LIMIT 1")(
    lambda v: joins.undecided(v.table("documents").select((c("doc_id") % 50).alias("page"), c("doc_id").alias("object")), v.decisions).orderBy("page", "object").limit(1)
)


def _ir(v: Views) -> DataFrame:
    n = v.nodes
    name = lambda p: F.concat(F.lit(p), c("node").cast("string"))
    return joins.reconstruction_objects(n, n.filter("x % 4 <> 0").select("node", name("a").alias("asset")), n.filter("x % 3 <> 0").select("node", name("t").alias("item")), n.filter("y % 2 = 0").select("node", name("s").alias("shape")))


query("reconstruction_ir", """WITH f AS (SELECT *, kind <> 'text' AND x % 4 <> 0 AS has, kind <> 'text' AND y % 2 = 0 AS shp FROM nodes WHERE state = 'frozen' AND (kind <> 'text' OR x % 3 <> 0))
    SELECT page, node, kind, z, row_number() OVER (PARTITION BY page ORDER BY z, ord) AS place, array_to_string(list_filter([CASE WHEN kind = 'text' THEN 'editable_text' END, CASE WHEN shp THEN 'native_shape' END, CASE WHEN has THEN 'raster' END], lambda k: k IS NOT NULL), ',') AS candidates, CASE WHEN kind <> 'text' AND NOT has THEN 'missing_asset' END AS problem FROM f""")(
    lambda v: _ir(v).withColumn("candidates", F.array_join("candidates", ","))
)
query("approved_parent_pairs", "WITH p AS (SELECT a.page, a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON a.page = b.page AND a.node < b.node AND a.kind = 'parent' AND b.kind = 'parent'), k AS (SELECT page, node, CASE WHEN node % 5 <> 0 THEN [page * 100 + 1, page * 100 + 2] ELSE [node] END AS cited FROM actions WHERE verb IN ('accept', 'retry') AND score >= 0.92) SELECT p.page, p.a, p.b FROM p JOIN k x ON x.page = p.page AND x.node = p.a JOIN k y ON y.page = p.page AND y.node = p.b WHERE list_contains(x.cited, p.a) AND list_contains(x.cited, p.b) AND list_contains(y.cited, p.a) AND list_contains(y.cited, p.b)")(
    lambda v: (lambda n: joins.approved_parent_pairs(n.select("page", c("node").alias("a")).join(n.select("page", c("node").alias("b")), "page").filter("a < b"), v.actions.withColumn("verb", F.when(c("verb") == "retry", "accept").otherwise(c("verb"))).withColumn("cited", F.when(c("node") % 5 != 0, F.array(c("page") * 100 + 1, c("page") * 100 + 2)).otherwise(F.array("node")))))(v.nodes.filter("kind = 'parent'").select("page", "node"))
)
query("unapproved_parents", "SELECT DISTINCT page, unnest([a, b]) AS node FROM (SELECT a.page, a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON a.page = b.page AND a.node < b.node AND a.kind = 'parent' AND b.kind = 'parent') WHERE a % 3 <> 0")(
    lambda v: (lambda p: joins.unapproved_parents(p, p.filter("a % 3 = 0")))((lambda n: n.select("page", c("node").alias("a")).join(n.select("page", c("node").alias("b")), "page").filter("a < b"))(v.nodes.filter("kind = 'parent'").select("page", "node")))
)
query("carried_parent_pairs", "SELECT page, node AS a, node AS b FROM nodes WHERE 1 = 0")(lambda v: joins.carried_parent_pairs(v.nodes.select("page", c("node").alias("a"), c("node").alias("b"))))
query("reuse_frozen", "SELECT node, state, CASE WHEN state = 'frozen' THEN 'old' || node ELSE 'new' || node END AS record FROM nodes")(
    lambda v: joins.reuse_frozen(v.nodes.select("node", "state", F.concat(F.lit("new"), c("node").cast("string")).alias("record")), v.nodes.select("node", F.concat(F.lit("old"), c("node").cast("string")).alias("record")))
)
query("same_instance", f"""WITH k AS (SELECT *, list_transform(regexp_split_to_array(trim(label), '\\s+'), lambda u: lower(trim(u, '.,'))) AS tok FROM boxes), r AS (SELECT *, CASE WHEN p AND k THEN 'mixed' WHEN p THEN 'person' WHEN k THEN 'container' ELSE 'object' END AS role FROM (SELECT *, list_has_any(tok, ['person', 'player', 'portrait']) AS p, list_has_any(tok, ['card', 'panel', 'chart', 'table', 'frame', 'border']) AS k FROM k)),
    j AS (SELECT a.page, a.ord AS a, b.ord AS b, a.role, a.source AS sa, b.source AS sb, list_has_any(a.tok, b.tok) AS shared, {BOTH} / greatest(CAST(a.w * a.h + b.w * b.h - {BOTH} AS DOUBLE), 1.0) AS iou FROM r a JOIN r b ON a.page = b.page AND a.ord < b.ord AND a.role = b.role AND greatest(a.x, b.x) < least(a.x + a.w, b.x + b.w) AND greatest(a.y, b.y) < least(a.y + a.h, b.y + b.h))
    SELECT page, a, b FROM j WHERE iou >= CASE WHEN role = 'person' THEN 0.55 ELSE 0.70 END OR (role = 'container' AND sa <> sb AND shared AND iou >= 0.30)""")(
    lambda v: (lambda b: joins.same_instance(joins.overlapping_pairs(b, b).filter("l_ord < r_ord")))(v.boxes.withColumn("role", t.role(c("label"))))
)
query("route_gate_join", "SELECT page, node, CASE WHEN kind = 'text' THEN 'editable_text' WHEN y % 2 = 0 AND score >= 0.95 THEN 'native_shape' ELSE 'raster' END AS route FROM nodes")(
    lambda v: ranking.choose_route(v.nodes.select("page", "node", F.explode(F.when(c("kind") == "text", F.array(F.lit("editable_text"), F.lit("raster"))).when(c("y") % 2 == 0, F.array(F.lit("native_shape"), F.lit("raster"))).otherwise(F.array(F.lit("raster")))).alias("kind"), (c("score") >= 0.95).alias("allowed")))
)

# --- aggregates -------------------------------------------------------------------


def pixel_pairs(v: Views) -> DataFrame:
    p = v.pictures.select("page", F.posexplode(F.arrays_zip("px", "other_px", "mask", "other_mask")).alias("i", "s"))
    return p.select("page", F.floor(c("i") / 8).cast("int").alias("y"), (c("i") % 8).cast("int").alias("x"), c("s.px").alias("p"), c("s.other_px").alias("q"), c("s.mask").alias("m"), c("s.other_mask").alias("n"))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if k == "double" else c(n) for n, k in df.dtypes])


query("visual_difference", "SELECT page, round(coalesce(avg(abs(p - q)) FILTER (NOT n), 0), 9) AS mae, round(coalesce(quantile_cont(CAST(abs(p - q) AS DOUBLE), 0.95) FILTER (NOT n), 0), 9) AS p95, round(coalesce(quantile_cont(CAST(abs(p - q) AS DOUBLE), 0.99) FILTER (NOT n), 0), 9) AS p99, round(coalesce(avg(CAST(abs(p - q) > 3 AS INTEGER)) FILTER (NOT n), 0), 9) AS changed_ratio FROM pairs GROUP BY page")(
    lambda v: rounded(aggregates.visual_difference(pixel_pairs(v).withColumn("masked", c("n"))))
)
query("ssim", "SELECT page, round(((2 * avg(p) * avg(q) + 6.5025) * (2 * covar_pop(p, q) + 58.5225)) / ((avg(p) * avg(p) + avg(q) * avg(q) + 6.5025) * (var_pop(p) + var_pop(q) + 58.5225)), 8) AS ssim FROM pairs GROUP BY page")(
    lambda v: rounded(pixel_pairs(v).groupBy("page").agg(aggregates.ssim(c("p").cast("double"), c("q").cast("double")).alias("ssim")), 8)
)
query("render_metrics", "SELECT page, round(avg(abs(p - q)) / 255.0, 9) AS normalized_mae, round(avg(CAST(abs(p - q) > 8 AS INTEGER)), 9) AS changed_ratio FROM pairs GROUP BY page")(lambda v: rounded(aggregates.render_metrics(pixel_pairs(v), "page").drop("ssim")))
query("render_metrics_rollup", "SELECT page, region, round(avg(abs(p - q)) / 255.0, 9) AS normalized_mae, round(avg(CAST(abs(p - q) > 8 AS INTEGER)), 9) AS changed_ratio, count(*) AS pixels FROM (SELECT *, (y // 4) * 2 + x // 4 AS region FROM pairs) GROUP BY GROUPING SETS ((page, region), (page))")(
    lambda v: rounded(aggregates.render_rollup(pixel_pairs(v).withColumn("region", (F.floor(c("y") / 4) * 2 + F.floor(c("x") / 4)).cast("int"))))
)
query("tail_metrics", "SELECT page, round(avg(abs(p - q)), 9) AS mean_abs, round(sqrt(avg(pow(p - q, 2))), 9) AS rms, round(avg(CAST(abs(p - q) >= 32 AS INTEGER)), 9) AS over_32, round(avg(CAST(abs(p - q) >= 64 AS INTEGER)), 9) AS over_64 FROM pairs GROUP BY page")(lambda v: rounded(aggregates.tail_metrics(pixel_pairs(v))))


def _words(v: Views) -> DataFrame:
    return v.text_items.select("page", F.floor(c("ord") / 3).cast("int").alias("line"), "ord", "x", "y", "w", "h", "text", F.when(c("ord") % 5 == 0, -1.0).otherwise(c("confidence")).alias("confidence"))


query("line_grouping", """WITH k AS (SELECT page, ord // 3 AS line, ord, x, y, w, h, trim(text) AS text, CASE WHEN ord % 5 = 0 THEN -1.0 ELSE confidence END AS c FROM text_items WHERE trim(text) <> ''),
    g AS (SELECT page, line, string_agg(text, '' ORDER BY ord) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, coalesce(avg(CAST(c AS DOUBLE)) FILTER (c >= 0), 0) AS confidence FROM k GROUP BY page, line)
    SELECT page, line, text, x, y, w, h, round(confidence, 9) AS confidence FROM g WHERE confidence >= 0.5 AND w >= 2 AND h >= 2""")(lambda v: rounded(aggregates.text_lines(_words(v), 0.5)))  # fmt: skip
_OWN = lambda v: pixel_pairs(v).select("page", (c("p") > 60).alias("material"), c("m").alias("owned"), c("n").alias("generated"), (c("q") > 200).alias("text"))
query("ownership_metrics", """WITH k AS (SELECT page, count_if(a) AS material_pixels, count_if(a AND m) AS owned_pixels, count_if(a AND n AND NOT m) AS generated_pixels, count_if(a AND NOT m AND NOT n) AS unexplained_pixels FROM (SELECT *, p > 60 AND NOT q > 200 AS a FROM pairs) GROUP BY page)
    SELECT *, round(CASE WHEN material_pixels > 0 THEN owned_pixels / CAST(material_pixels AS DOUBLE) ELSE 1 END, 9) AS ownership_coverage, round(CASE WHEN material_pixels > 0 THEN (owned_pixels + generated_pixels) / CAST(material_pixels AS DOUBLE) ELSE 1 END, 9) AS responsibility_coverage FROM k""")(lambda v: rounded(aggregates.ownership_metrics(_OWN(v))))  # fmt: skip


def _claims(v: Views) -> DataFrame:
    p = pixel_pairs(v)
    one = p.filter("m").select("page", F.lit(1).alias("owner"), F.lit(1).alias("ord"), F.lit(3).alias("z"), "y", "x")
    two = p.filter("n").select("page", F.lit(2).alias("owner"), F.lit(2).alias("ord"), F.lit(5).alias("z"), "y", "x")
    three = p.filter("p > 150").select("page", F.lit(3).alias("owner"), F.lit(3).alias("ord"), F.lit(5).alias("z"), "y", (c("x") + 1).alias("x"))
    return one.unionAll(two).unionAll(three)


_CLAIMS = "SELECT page, 1 AS owner, 1 AS ord, 3 AS z, y, x FROM pairs WHERE m UNION ALL SELECT page, 2, 2, 5, y, x FROM pairs WHERE n UNION ALL SELECT page, 3, 3, 5, y, x + 1 FROM pairs WHERE p > 150"
query("pixel_ownership", f"WITH k AS ({_CLAIMS}), s AS (SELECT page, owner, count(*) AS n FROM k GROUP BY ALL) SELECT page, y, x, owner FROM k JOIN s USING (page, owner) QUALIFY row_number() OVER (PARTITION BY page, y, x ORDER BY z DESC, n, ord) = 1")(lambda v: ranking.pixel_owner(_claims(v)))
query("text_hole_claims", f"WITH k AS ({_CLAIMS}) SELECT page, y, x, owner FROM k QUALIFY row_number() OVER (PARTITION BY page, y, x ORDER BY ord DESC) = 1")(lambda v: ranking.first_claim(_claims(v)))
query("pixel_claim_defects", f"""WITH k AS ({_CLAIMS}), i AS (SELECT page, y, x, count(*) AS n FROM k WHERE x < 8 GROUP BY ALL), a AS (SELECT c.page, i.n, c.px > 200 AS t, c.px > 120 AS f FROM cells c LEFT JOIN i ON c.page = i.page AND c.y = i.y AND c.x = i.x WHERE i.n IS NOT NULL OR c.px > 120)
    SELECT page, count_if(n > 1) AS duplicate, count_if(f AND n IS NULL) AS missing, count_if(t AND n IS NOT NULL) AS text_duplicate, coalesce(any_value(o.c), 0) AS out_of_bounds FROM a LEFT JOIN (SELECT page, count(*) AS c FROM k WHERE x >= 8 GROUP BY page) o USING (page) GROUP BY page""")(
    lambda v: aggregates.pixel_claims(_claims(v), v.cells.filter("px > 200"), v.cells.filter("px > 120"), 8, 8)
)
query("mask_disjointness", f"WITH k AS ({_CLAIMS}) SELECT page, y, x, count(*) AS owners FROM k GROUP BY ALL HAVING count(*) > 1")(lambda v: graph.overlapping_masks(_claims(v)))
query("child_outside_parent", "SELECT page, 1 AS owner, y, x FROM pairs WHERE m EXCEPT ALL SELECT page, 1, y, x FROM pairs WHERE n")(lambda v: graph.outside_parent(pixel_pairs(v).filter("m").withColumn("owner", F.lit(1)), pixel_pairs(v).filter("n").withColumn("owner", F.lit(1))))
query("mask_iou", "SELECT page, count_if(m AND n) / CAST(count_if(m OR n) AS DOUBLE) AS iou FROM pairs GROUP BY page HAVING count_if(m OR n) > 0")(lambda v: graph.mask_iou(pixel_pairs(v).filter("m"), pixel_pairs(v).filter("n")))
query("removal_mask", "SELECT DISTINCT page, y, x FROM (SELECT page, y + dy AS y, x + dx AS x FROM (SELECT page, y, x FROM cells WHERE px > 220 UNION SELECT page, y, x FROM cells WHERE px < 20) k, (SELECT unnest([-2, -1, 0, 1, 2]) AS dy) a, (SELECT unnest([-2, -1, 0, 1, 2]) AS dx) b) WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7")(
    lambda v: graph.removal_mask(v.cells.filter("px > 220"), v.cells.filter("px < 20"), 8, 8)
)
_BC = lambda v: v.boxes.select("page", "ord", F.floor(c("x") / 100).cast("int").alias("x"), F.floor(c("y") / 100).cast("int").alias("y"), (c("w") % 3 + 1).alias("w"), (c("h") % 3 + 1).alias("h"))
_BX = "SELECT page, ord, x // 100 AS x, y // 100 AS y, w % 3 + 1 AS w, h % 3 + 1 AS h FROM boxes"
query("text_mask", f"SELECT page, ord, yy AS y, xx AS x FROM (SELECT *, unnest(generate_series(greatest(0, x - 1), least(7, x + w))) AS xx FROM (SELECT *, unnest(generate_series(greatest(0, y - 1), least(7, y + h))) AS yy FROM ({_BX}) WHERE x - 1 < 8 AND y - 1 < 8))")(lambda v: graph.box_cells(_BC(v), 1, 8, 8))
query("text_region_labels", f"WITH k AS (SELECT page, min(ord) AS label, yy AS y, xx AS x FROM (SELECT *, unnest(generate_series(x, least(7, x + w - 1))) AS xx FROM (SELECT *, unnest(generate_series(y, least(7, y + h - 1))) AS yy FROM ({_BX}) WHERE x < 8 AND y < 8)) GROUP BY page, yy, xx) SELECT c.page, c.y, c.x, k.label FROM cells c LEFT JOIN k ON k.page = c.page AND k.y = c.y AND k.x = c.x WHERE c.mask")(
    lambda v: graph.box_labels(v.cells.filter("mask").select("page", "y", "x"), _BC(v))
)
query("largest_text_region", f"WITH k AS (SELECT page, min(ord) AS label, yy AS y, xx AS x FROM (SELECT *, unnest(generate_series(x, least(7, x + w - 1))) AS xx FROM (SELECT *, unnest(generate_series(y, least(7, y + h - 1))) AS yy FROM ({_BX}) WHERE x < 8 AND y < 8)) GROUP BY page, yy, xx) SELECT page, max(n) AS pixels FROM (SELECT c.page, k.label, count(*) AS n FROM cells c JOIN k ON k.page = c.page AND k.y = c.y AND k.x = c.x WHERE c.mask GROUP BY ALL) GROUP BY page")(
    lambda v: graph.largest_label(graph.box_labels(v.cells.filter("mask").select("page", "y", "x"), _BC(v)))
)
query("mask_projection", f"WITH k AS ({_CLAIMS}) SELECT page, owner, count(*) AS outside FROM k WHERE x >= 8 GROUP BY ALL")(lambda v: graph.project(_claims(v), 8, 8)[1])
query("mask_box_fill", f"SELECT b.page, b.ord, count(CASE WHEN c.mask THEN 1 END) / CAST(greatest(1, any_value(b.w * b.h)) AS DOUBLE) AS fill FROM ({_BX}) b LEFT JOIN cells c ON c.page = b.page AND c.x >= b.x AND c.y >= b.y AND c.x < b.x + b.w AND c.y < b.y + b.h GROUP BY b.page, b.ord")(lambda v: graph.box_fill(v.cells, _BC(v)))
query("positive_hits", "SELECT b.page, count(*) AS hits FROM boxes b JOIN cells c ON c.page = b.page AND c.mask AND c.x = greatest(0, least(7, CAST(round_even(b.x / 64.0::DOUBLE, 0) AS INTEGER))) AND c.y = greatest(0, least(7, CAST(round_even(b.y / 32.0::DOUBLE, 0) AS INTEGER))) GROUP BY b.page")(
    lambda v: graph.positive_hits(v.cells, v.boxes.select("page", (c("x") / 64).alias("px"), (c("y") / 32).alias("py")), 8, 8)
)
query("border_background", "WITH k AS (SELECT page, CAST(px AS DOUBLE) AS v FROM cells WHERE x < 2 OR y < 2 OR x >= 6 OR y >= 6) SELECT page, median(v) AS background, round(stddev_pop(v), 8) AS spread, round(greatest(35.0, stddev_pop(v) * 2.5), 8) AS threshold FROM k GROUP BY page")(lambda v: rounded(aggregates.border_background(v.cells, 2, 8), 8))
query("fill_evidence", "WITH m AS (SELECT page, median(CAST(px AS DOUBLE)) AS color FROM cells WHERE mask GROUP BY page) SELECT page, any_value(color) AS color, median(abs(px - color)) AS mad FROM cells JOIN m USING (page) WHERE mask GROUP BY page")(lambda v: aggregates.fill_evidence(v.cells))
query("edge_retention", "WITH k AS (SELECT page, count_if(p > 150 AND m) AS source_edge_pixels, count_if(p > 150 AND m AND q > 150) AS retained_edge_pixels FROM pairs GROUP BY page) SELECT *, CASE WHEN source_edge_pixels > 0 THEN retained_edge_pixels / CAST(source_edge_pixels AS DOUBLE) ELSE 0 END AS retained_edge_ratio FROM k")(
    lambda v: aggregates.edge_retention(pixel_pairs(v).select("page", (c("p") > 150).alias("source_edge"), (c("q") > 150).alias("kept_edge"), c("m").alias("removed")))
)
query("unchanged_residual_filter", "SELECT page FROM pairs WHERE m AND NOT n GROUP BY page HAVING avg(CAST(abs(p - q) < 100 AS INTEGER)) >= 0.75")(lambda v: pixel_pairs(v).filter("m and not n").groupBy("page").agg(F.avg((F.abs(c("p") - c("q")) < 100).cast("int")).alias("share")).filter("share >= 0.75").select("page"))
query("text_overlap_filter", f"SELECT b.page, b.ord FROM ({_BX}) b LEFT JOIN cells c ON c.page = b.page AND c.mask AND c.x >= b.x AND c.y >= b.y AND c.x < b.x + b.w AND c.y < b.y + b.h GROUP BY b.page, b.ord HAVING count(c.page) / CAST(greatest(1, any_value(b.w * b.h)) AS DOUBLE) <= 0.5")(lambda v: graph.box_fill(v.cells, _BC(v)).filter("fill <= 0.5").select("page", "ord"))
query("page_violations", """WITH v AS (SELECT page, coalesce(avg(abs(p - q)) FILTER (NOT n), 0) AS mae, coalesce(quantile_cont(CAST(abs(p - q) AS DOUBLE), 0.95) FILTER (NOT n), 0) AS p95, coalesce(avg(CAST(abs(p - q) > 3 AS INTEGER)) FILTER (NOT n), 0) AS ch FROM pairs GROUP BY page),
    r AS (SELECT page, unnest(CASE WHEN x % 3 = 0 THEN ['edge_loss'] WHEN x % 3 = 1 THEN ['duplicate_pixels', 'edge_loss'] ELSE [] END || CASE WHEN w >= 100 THEN ['orphan_residual'] ELSE [] END) AS n FROM boxes),
    u AS (SELECT page, n FROM r UNION SELECT page, CASE page % 3 WHEN 0 THEN 'pptx_reopen_unknown' WHEN 1 THEN 'pptx_reopen' END FROM v WHERE page % 3 <> 2 UNION SELECT page, 'visual_difference' FROM v WHERE mae > 8 OR p95 > 32 OR ch > 0.02)
    SELECT v.page, coalesce(string_agg(n, ',' ORDER BY n), '') AS violations, count(n) = 0 AS accepted FROM v LEFT JOIN u USING (page) GROUP BY v.page""")(
    lambda v: pipelines.page_quality(
        v.boxes.select("page", F.when(c("x") % 3 == 0, F.array(F.lit("edge_loss"))).when(c("x") % 3 == 1, F.array(F.lit("duplicate_pixels"), F.lit("edge_loss"))).otherwise(F.array().cast("array<string>")).alias("violations"), c("w").alias("orphan_pixels"), F.lit(10).alias("edge_width")),
        pixel_pairs(v).withColumn("masked", c("n")),
        v.table("embeddings").select(c("vec_id").alias("page"), F.when(c("vec_id") % 3 == 1, "fail").when(c("vec_id") % 3 == 2, "pass").alias("pptx_reopen")),
    ).withColumn("violations", F.array_join("violations", ","))
)
query("component_violations", "SELECT page, round, array_to_string(list_filter([CASE WHEN largest >= 4 THEN 'largest' END, CASE WHEN mae > 8 THEN 'mae' END, CASE WHEN p95 > 32 THEN 'p95' END], lambda z: z IS NOT NULL), ',') AS violations, NOT (largest >= 4 OR mae > 8 OR p95 > 32) AS accepted FROM rounds")(
    lambda v: aggregates.component_violations(v.rounds.drop("violations", "accepted"), {"mae": (">", 8.0), "p95": (">", 32.0), "largest": (">=", 4.0)}).select("page", "round", F.array_join("violations", ",").alias("violations"), "accepted")
)
query("round_improvement", "SELECT page, round, lag(mae) OVER (PARTITION BY page ORDER BY round) - mae AS improvement FROM rounds")(lambda v: aggregates.improvement(v.rounds, "mae").select("page", "round", "improvement"))
_ROLL = """WITH e AS (SELECT page, unnest(CASE event WHEN 'span' THEN [{'f': 'stage_runs', 'k': stage, 'v': CAST(1 AS BIGINT)}, {'f': 'stage_duration_ms', 'k': stage, 'v': duration_ms}] WHEN 'worker' THEN [{'f': 'worker_runs', 'k': model, 'v': CAST(1 AS BIGINT)}, {'f': 'worker_duration_ms', 'k': model, 'v': duration_ms}]
    WHEN 'inference_finish' THEN [{'f': 'inference_runs', 'k': model, 'v': CAST(1 AS BIGINT)}, {'f': 'inference_operations', 'k': model, 'v': operation_count}, {'f': 'inference_duration_ms', 'k': model, 'v': duration_ms}] ELSE [] END) AS e FROM trace) SELECT page, e.f AS field, e.k AS key, sum(e.v) AS value FROM e GROUP BY ALL"""
query("trace_rollup", _ROLL)(lambda v: aggregates.trace_rollup(v.trace))
query("trace_summary")(lambda v: aggregates.trace_summary(v.trace).select("page", *[F.to_json(n).alias(n) for n in ("stage_runs", "worker_runs", "inference_runs")]))
query("paired_model_loads", """WITH l AS (SELECT *, lag(event) OVER (PARTITION BY page, model ORDER BY ts, event_id) AS b FROM trace WHERE event IN ('model_load_start', 'model_load_finish'))
    SELECT page, model, count_if(event = 'model_load_finish' AND b = 'model_load_start' AND status = 'success') AS loads, count_if((event = 'model_load_finish' AND coalesce(b, '') <> 'model_load_start') OR (event = 'model_load_start' AND b = 'model_load_start')) AS unpaired FROM l GROUP BY page, model""")(lambda v: aggregates.paired_loads(v.trace))  # fmt: skip

# --- ranking and windows ----------------------------------------------------------

query("first_decision", "SELECT page, arg_min(object, object) AS object, arg_min(decision, object) AS decision, count(*) > 1 AS conflict FROM decisions GROUP BY page")(lambda v: joins.shadow_plans(v.decisions, v.decisions.select("page", F.lit("").alias("state")).distinct()).select("page", "object", "decision", "conflict"))
query("budget_prefix", "SELECT page, ord, n, spent FROM (SELECT page, ord, row_number() OVER o AS n, sum(w * h) OVER o AS spent FROM boxes WINDOW o AS (PARTITION BY page ORDER BY ord ROWS UNBOUNDED PRECEDING)) WHERE n <= 5 AND spent <= 20000")(
    lambda v: ranking.budget_prefix(v.boxes.select("page", "ord", (c("w") * c("h")).alias("cost")), 5, 20_000).select("page", "ord", "n", "spent")
)
query("regions_by_area", "SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, ord) AS rank FROM boxes WHERE w * h >= 3000")(lambda v: ranking.by_area(v.boxes.withColumn("pixels", c("w") * c("h")), 3000).select("page", "ord", "rank"))
_PROG = "SELECT page, round, b IS NULL OR k < b OR (accepted AND NOT coalesce(was, false)) AS progressed FROM (SELECT page, round, accepted, row(largest, unexplained, CAST(violations AS DOUBLE), mae, p95) AS k, lag(row(largest, unexplained, CAST(violations AS DOUBLE), mae, p95)) OVER o AS b, lag(accepted) OVER o AS was FROM rounds WINDOW o AS (PARTITION BY page ORDER BY round))"
query("progress", _PROG)(lambda v: ranking.progress(v.rounds))
query("next_round_allowed", f"SELECT page, max(round) + 1 AS next_round, arg_max(progressed, round) AND max(round) + 1 < 5 AS allowed FROM ({_PROG}) GROUP BY page")(lambda v: ranking.may_continue(v.rounds))
_OFFER = lambda v: v.boxes.select(c("page").alias("host"), F.concat(F.lit("m"), c("ord").cast("string")).alias("model"), c("ord").alias("priority"), ranking.compatibility_reasons({"cuda": c("x") % 5 != 0, "vram": c("w").cast("double"), "free_vram": c("w").cast("double"), "ram": c("h").cast("double"), "free_ram": c("h").cast("double"), "disk": c("y").cast("double")}, {"minimum_vram": F.lit(60.0), "minimum_free_vram": F.lit(50.0), "minimum_ram": F.lit(20.0), "minimum_free_ram": F.lit(15.0), "minimum_disk": F.lit(30.0)}).alias("reasons"))
_OFF = "SELECT page AS host, 'm' || ord AS model, ord AS priority, list_filter([CASE WHEN x % 5 = 0 THEN 'cuda' END, CASE WHEN w < 60 THEN 'vram' END, CASE WHEN w < 50 THEN 'free_vram' END, CASE WHEN h < 20 THEN 'ram' END, CASE WHEN h < 15 THEN 'free_ram' END, CASE WHEN y < 30 THEN 'disk' END], lambda z: z IS NOT NULL) AS reasons FROM boxes"
query("compatibility_reasons", f"SELECT host, model, array_to_string(reasons, ',') AS reasons FROM ({_OFF})")(lambda v: _OFFER(v).select("host", "model", F.array_join("reasons", ",").alias("reasons")))
query("model_recommend", f"SELECT host, model, len(reasons) = 0 AS compatible FROM ({_OFF}) QUALIFY row_number() OVER (PARTITION BY host ORDER BY (len(reasons) = 0) DESC, priority DESC) = 1")(lambda v: ranking.recommend(_OFFER(v)))
query("dependency_report", "WITH p AS (SELECT page * 100 + ord AS package, x % 3 AS a, y % 4 AS b, z % 3 AS k, h % 4 AS l, x % 5 AS i FROM boxes) SELECT package, CASE WHEN i <> 0 THEN a || '.' || b END AS version, k || '.' || l AS minimum, CASE WHEN i = 0 THEN false ELSE [a, b] >= [k, l] END AS compatible FROM p")(
    lambda v: (lambda b: ranking.dependency_report(b.filter("x % 5 <> 0").select("package", F.concat_ws(".", c("x") % 3, c("y") % 4).alias("version")), b.select("package", F.concat_ws(".", c("z") % 3, c("h") % 4).alias("minimum"))))(v.boxes.withColumn("package", c("page") * 100 + c("ord")))
)
query("environment_ready", "SELECT page AS host, bool_and(x % 2 <> 0 OR y % 3 <> 0) AS ready, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (x % 2 = 0 AND y % 3 = 0), '') AS missing FROM boxes GROUP BY page")(
    lambda v: ranking.environment_ready(v.boxes.select(c("page").alias("host"), c("label").alias("name"), (c("x") % 2 == 0).alias("required"), (c("y") % 3 != 0).alias("ok"))).withColumn("missing", F.array_join("missing", ","))
)
query("next_agent_item", "SELECT page AS run, CASE WHEN min(k) = 0 THEN 'handshake' ELSE 'request' END AS kind, arg_min(ord, k * 100 + ord) AS item FROM (SELECT page, ord, CASE WHEN x % 4 = 0 THEN 0 ELSE 1 END AS k FROM boxes) GROUP BY page")(
    lambda v: (lambda b: ranking.next_item(b.filter("x % 4 = 0").select("run", "item"), b.filter("x % 4 <> 0").select("run", "item")))(v.boxes.select(c("page").alias("run"), c("ord").alias("item"), "x"))
)
query("choose_fill", "WITH k AS (SELECT page, ord, label AS name, x / 300.0::DOUBLE AS a, y / 200.0::DOUBLE AS b, h / 40.0::DOUBLE AS d FROM boxes) SELECT page, name FROM k QUALIFY row_number() OVER (PARTITION BY page ORDER BY CAST(a > 1 AS INTEGER) + CAST(b > 1 AS INTEGER) + CAST(d > 1 AS INTEGER), greatest(a, b, d), a + b + d, ord) = 1")(
    lambda v: ranking.choose_fill(v.boxes.select("page", "ord", c("label").alias("name"), c("x").alias("seam"), c("y").alias("gradient"), c("h").alias("detail"), F.lit(300.0).alias("l_seam"), F.lit(200.0).alias("l_gradient"), F.lit(40.0).alias("l_detail")))
)
_ROUTES = lambda v: v.nodes.select("page", "node", F.when(c("kind") == "text", "editable_text").when(c("y") % 2 == 0, "native_shape").otherwise("raster").alias("route"))
query("fallback_plan", "SELECT page, node, CASE WHEN x % 5 = 0 THEN 'raster' WHEN kind = 'text' THEN 'editable_text' WHEN y % 2 = 0 THEN 'native_shape' ELSE 'raster' END AS route FROM nodes")(lambda v: ranking.fallback_routes(_ROUTES(v), v.nodes.filter("x % 5 = 0")))
query("evaluate_native", "SELECT page, node, CASE WHEN kind = 'text' THEN 'editable_text' WHEN y % 2 = 0 AND w <= h * 3 THEN 'native_shape' ELSE 'raster' END AS route FROM nodes")(
    lambda v: pipelines.evaluate_native(_ROUTES(v), v.nodes.select("page", "node", *[e.cast("double").alias(f"{p}_{n}") for n in ("normalized_mae", "changed_ratio", "edge_ratio", "largest_ratio") for p, e in (("c", c("w")), ("b", c("h")), ("n", c("h") * 2))], *[F.lit(1.0).alias(f"{p}_ssim") for p in "cbn"]))
)
query("route_visual_elements", "SELECT page, node, CASE WHEN y % 2 = 0 THEN 'native_shape' ELSE 'raster' END AS route, z, row_number() OVER (PARTITION BY page ORDER BY z, ord) AS place FROM nodes WHERE kind <> 'text'")(lambda v: ranking.routed_elements(_ROUTES(v), v.nodes))
query("fresh_shape_ids", "SELECT b.page, b.ord, m.top + row_number() OVER (PARTITION BY b.page ORDER BY b.ord) AS new_id FROM boxes b JOIN (SELECT page, max(x) AS top FROM boxes GROUP BY page) m USING (page)")(lambda v: ranking.fresh_ids(v.boxes.select("page", c("x").cast("long").alias("id")), v.boxes.select("page", "ord")))
query("unique_media_part")(lambda v: ranking.free_names(v.boxes.select(F.concat(F.lit("media/i"), (c("x") % 50).cast("string"), F.lit(".png")).alias("name")).distinct(), v.boxes.filter("y % 2 = 0").select(F.concat(F.lit("media/i"), (c("x") % 30).cast("string"), F.lit(".png")).alias("name")).distinct()))
query("absorbed_entities")(lambda v: greedy.entity_count(joins.same_instance(joins.overlapping_pairs(*[v.boxes.withColumn("role", F.lit("object"))] * 2).filter("l_ord < r_ord")), v.boxes.select("page", "ord")))
query("same_absorbed_entity", f"""WITH p AS (SELECT a.page, a.ord AS a, b.ord AS b, a.w * a.h AS s, b.w * b.h AS t, {BOTH} AS n, abs(a.x + a.w / 2.0 - b.x - b.w / 2.0) AS dx, abs(a.y + a.h / 2.0 - b.y - b.h / 2.0) AS dy, greatest(a.w, b.w) AS mw, greatest(a.h, b.h) AS mh FROM {PAIRS})
    SELECT page, a, b FROM p WHERE (n / CAST(s AS DOUBLE) >= 0.8 AND n / CAST(t AS DOUBLE) >= 0.8) OR (greatest(n / CAST(s AS DOUBLE), n / CAST(t AS DOUBLE)) >= 0.95 AND least(s, t) / CAST(greatest(s, t) AS DOUBLE) >= 0.5) OR (least(s, t) / CAST(greatest(s, t) AS DOUBLE) >= 0.67 AND n / CAST(least(s, t) AS DOUBLE) >= 0.4 AND dx <= greatest(9, mw * 0.5) AND dy <= greatest(9, mh * 0.5))""")(
    lambda v: pairs(v).filter(q.same_entity(c("l_w") * c("l_h"), c("r_w") * c("r_h"), g.intersection(left(), right()), left(), right(), F.lit(3))).select("page", c("l_ord").alias("a"), c("r_ord").alias("b"))
)
query("gap_fragments")(
    lambda v: (lambda b: b.join(b.select("page", *[c(k).alias("o_" + k) for k in ("ord", "x", "y", "w", "h")]), "page").filter("w * h < o_w * o_h").filter(q.gap_fragment(c("w") * c("h"), c("o_w") * c("o_h"), g.corners(*xywh()), g.corners(c("o_x"), c("o_y"), c("o_w"), c("o_h")), F.lit(40))).select("page", c("ord").alias("a"), c("o_ord").alias("b")))(v.boxes.select("page", "ord", "x", "y", "w", "h"))
)

# --- closures and regions ---------------------------------------------------------

_UP = "WITH RECURSIVE a AS (SELECT page, node, parent AS ancestor, 1 AS depth FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT a.page, a.node, n.parent, a.depth + 1 FROM a JOIN nodes n ON n.page = a.page AND n.node = a.ancestor WHERE n.parent IS NOT NULL) "
query("ancestors", _UP + "SELECT page, node, ancestor, depth FROM a")(lambda v: graph.ancestors(v.nodes))
query("descendants", _UP + "SELECT DISTINCT a.page, a.node FROM a JOIN nodes s ON s.page = a.page AND s.node = a.ancestor WHERE s.x % 4 = 0")(lambda v: graph.descendants(v.nodes, v.nodes.filter("x % 4 = 0")))
query("deactivate_descendants", _UP + "SELECT page, node, CASE WHEN EXISTS (SELECT 1 FROM a JOIN nodes s ON s.page = a.page AND s.node = a.ancestor WHERE s.x % 4 = 0 AND a.page = n.page AND a.node = n.node) THEN 'inactive' ELSE state END AS state FROM nodes n")(
    lambda v: graph.deactivate_descendants(v.nodes, v.nodes.filter("x % 4 = 0")).select("page", "node", "state")
)
query("related_inactive", _UP + "SELECT s.page, t.node AS target, s.node AS source FROM nodes s JOIN nodes t ON s.page = t.page AND s.node <> t.node WHERE EXISTS (SELECT 1 FROM a WHERE a.page = s.page AND a.node = s.node AND a.ancestor = t.node) OR s.parent = t.parent")(
    lambda v: graph.related_inactive(None, v.nodes).select("page", "target", "source")
)
query("delta_scope", """WITH RECURSIVE k AS (SELECT a.page, a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON a.page = b.page AND a.node <> b.node AND greatest(a.x - 3, b.x) < least(a.x + a.w + 3, b.x + b.w) AND greatest(a.y - 3, b.y) < least(a.y + a.h + 3, b.y + b.h) UNION SELECT page, node, parent FROM nodes WHERE parent IS NOT NULL UNION SELECT page, parent, node FROM nodes WHERE parent IS NOT NULL),
    s AS (SELECT page, node FROM nodes WHERE greatest(x - 3, 100) < least(x + w + 3, 260) AND greatest(y - 3, 100) < least(y + h + 3, 260) UNION SELECT s.page, k.b FROM s JOIN k ON k.page = s.page AND k.a = s.node), n AS (SELECT page, count(*) AS n FROM s GROUP BY page)
    SELECT DISTINCT s.page, CASE WHEN n.n <= 5 THEN s.node END AS node FROM s JOIN n USING (page)""")(
    lambda v: graph.delta_scope(v.nodes, v.nodes.select("page", F.lit(100).alias("x"), F.lit(100).alias("y"), F.lit(160).alias("w"), F.lit(160).alias("h")).distinct(), 3, 5)
)
query("reuse_text_delta", "SELECT page, NOT bool_or(x % 7 = 0) AND bool_and(y % 50 <> 0) AS reuse FROM nodes GROUP BY page")(
    lambda v: graph.can_reuse(v.nodes.filter("x % 7 = 0").select("page", "node"), v.nodes, v.nodes.select("page", c("node").cast("string").alias("name"), F.lit("a").alias("old"), F.when(c("y") % 50 == 0, "b").otherwise("a").alias("new")))
)
query("island_filter", "SELECT page, ord FROM (SELECT page, ord, w * h AS s, max(w * h) OVER (PARTITION BY page) AS m FROM boxes) WHERE s >= greatest(2000, m * 0.5)")(lambda v: graph.keep_islands(v.boxes.withColumn("pixels", c("w") * c("h")), 2000, 0.5).select("page", "ord"))
query("merged_foreground", "WITH i AS (SELECT page, y // 4 AS region, y, x FROM pairs WHERE m), r AS (SELECT page, y, x FROM pairs WHERE n AND x < 2), h AS (SELECT DISTINCT i.page, i.region FROM i JOIN r USING (page, y, x)) SELECT page, y, x FROM r UNION SELECT i.page, y, x FROM i WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.page = i.page AND h.region = i.region)")(
    lambda v: (lambda p: graph.merged_foreground(p.filter("m").select("page", F.floor(c("y") / 4).alias("region"), "y", "x"), p.filter("n and x < 2").select("page", "y", "x")))(pixel_pairs(v))
)
query("connected_regions")(lambda v: kernels.region_table(v.cells))
query("enclosed_holes")(lambda v: kernels.per_page(v.cells.select("page", "y", "x", "mask"), "page long, holes int, islands int, largest int", lambda page, mask: [{"page": page, "holes": int(kernels.enclosed_holes(mask).sum()), "islands": int(kernels.drop_small(mask, 0.10, 2).sum()), "largest": kernels.largest_region(mask)}]))
query("ink_and_shapes")(lambda v: kernels.per_page(v.cells.select("page", "y", "x", "px", "mask"), "page long, ink int, threshold int, shape string, depth double", lambda page, px, mask: [{"page": page, "ink": int(kernels.text_ink(px).sum()), "threshold": kernels.otsu(px), "shape": (kernels.best_shape(mask, 0.5) or (None,))[0], "depth": kernels.depth_ratio(mask)}]))
query("text_merge")(lambda v: greedy.merge_texts(v.text_items))
query("text_pipeline")(lambda v: pipelines.text_items(v.text_items, 1000).select("page", "ord", "text", "font", "font_size", "align"))
query("text_records", "SELECT page, 'text_' || lpad(CAST(row_number() OVER (PARTITION BY page ORDER BY ord) AS VARCHAR), 4, '0') AS text_id, x AS x1, y AS y1, least(800, x + w) AS x2, least(600, y + h) AS y2, trim(text) AS text FROM text_items WHERE trim(text) <> '' AND x < least(800, x + w) AND y < least(600, y + h)")(lambda v: pipelines.text_records(v.text_items, 800, 600))
query("mask_nms")(lambda v: greedy.mask_nms(v.boxes, 0.5))
query("execute_plan")(lambda v: greedy.execute_plan(v.nodes, v.actions))
query("reconcile_fragments")(lambda v: greedy.reconcile_fragments(v.boxes.filter("z > 2"), v.boxes.filter("z <= 2")))
query("reject_reason", "SELECT page, round, CASE WHEN violations > 2 THEN 'raster_text' WHEN p95 >= 16 AND mae / 13 >= 0.45 THEN 'background_residual' WHEN largest / 1000 > 0.003 THEN 'artifacts' WHEN mae > 12 OR p95 > 48 THEN 'visual_difference' END AS reason FROM rounds")(
    lambda v: (lambda r: r.join(pipelines.reject_reason(r.withColumn("page", c("page") * 100 + c("round"))).withColumnRenamed("page", "k"), c("page") * 100 + c("round") == c("k")).select("page", "round", "reason"))(
        v.rounds.select("page", "round", "mae", "p95", F.when(c("violations") > 2, 1).otherwise(0).alias("raster_text"), c("p95").alias("source_edge_pixels"), (c("mae") / 13).alias("retained_edge_ratio"), F.when(c("largest") / 1000 > 0.003, 0.5).otherwise(0.0).alias("largest_artifact_ratio"))
    )
)

# --- state machines ---------------------------------------------------------------

_EDGE = lambda table: ", ".join(f"'{a}>{b}'" for a, to in table.items() for b in to)
for _name, _col, _table in (("illegal_page_transitions", "state", state.PAGE_EDGES), ("illegal_run_transitions", "run_state", state.RUN_EDGES)):
    query(_name, f"SELECT page, seq, s AS state, {_col} AS target FROM (SELECT page, seq, {_col}, lag({_col}) OVER (PARTITION BY page ORDER BY seq) AS s FROM state_log) WHERE s IS NOT NULL AND s <> {_col} AND s || '>' || {_col} NOT IN ({_EDGE(_table)})")(
        lambda v, _col=_col, _table=_table: state.illegal_steps(v.state_log, _table, _col)
    )
query("apply_transition", f"WITH d AS (SELECT page, arg_min(state, seq) AS s, arg_max(state, seq) AS t FROM state_log GROUP BY page) SELECT page, CASE WHEN s || '>' || t IN ({_EDGE(state.PAGE_EDGES)}) THEN t ELSE s END AS state, s || '>' || t IN ({_EDGE(state.PAGE_EDGES)}) AS applied FROM d")(
    lambda v: (lambda l: state.transition(l.groupBy("page").agg(F.min_by("state", "seq").alias("state")), l.groupBy("page").agg(F.max_by("state", "seq").alias("target")), state.PAGE_EDGES))(v.state_log)
)
query("replay_page_log", f"WITH RECURSIVE r AS (SELECT page, CAST(0 AS BIGINT) AS seq, 'pending' AS state, 0 AS applied, 0 AS rejected FROM (SELECT DISTINCT page FROM state_log) UNION ALL SELECT r.page, l.seq, CASE WHEN r.state || '>' || l.state IN ({_EDGE(state.PAGE_EDGES)}) THEN l.state ELSE r.state END, r.applied + CAST(r.state || '>' || l.state IN ({_EDGE(state.PAGE_EDGES)}) AS INTEGER), r.rejected + CAST(r.state || '>' || l.state NOT IN ({_EDGE(state.PAGE_EDGES)}) AS INTEGER) FROM r JOIN state_log l ON l.page = r.page AND l.seq = r.seq + 1) SELECT page, arg_max(state, seq) AS state, arg_max(applied, seq) AS applied, arg_max(rejected, seq) AS rejected FROM r GROUP BY page")(
    lambda v: state.replay(v.state_log, state.PAGE_EDGES, "pending")
)
query("recover_runs", "SELECT page AS run, CASE WHEN s IN ('running', 'finalizing', 'failed') THEN 'prepared' ELSE s END AS state, CASE WHEN s IN ('running', 'finalizing') THEN s || ',failed,prepared' WHEN s = 'failed' THEN 'failed,prepared' ELSE s END AS path FROM (SELECT page, arg_max(run_state, seq) AS s FROM state_log GROUP BY page)")(
    lambda v: state.recover(v.state_log.groupBy(c("page").alias("run")).agg(F.max_by("run_state", "seq").alias("state"))).withColumn("path", F.array_join("path", ","))
)
query("reset_pages", "SELECT page, CASE WHEN s IN ('pending', 'analyzed', 'failed') THEN 'pending' ELSE s END AS state, CASE WHEN s NOT IN ('pending', 'analyzed', 'failed', 'preserved', 'replaced', 'preserved_with_warning') THEN 'cannot reset ' || s END AS problem FROM (SELECT page, arg_max(state, seq) AS s FROM state_log GROUP BY page)")(
    lambda v: state.reset_pages(v.state_log.groupBy("page").agg(F.max_by("state", "seq").alias("state")))
)
query("freeze_components", "SELECT n.page, n.node, CASE WHEN ord % 3 = 0 AND x % 2 = 0 THEN 'frozen' WHEN ord % 3 = 0 THEN 'pending' WHEN y % 5 = 0 AND state = 'frozen' THEN 'pending' ELSE state END AS state FROM nodes n")(
    lambda v: state.freeze(v.nodes, v.nodes.filter("ord % 3 = 0").select("page", "node", (c("x") % 2 == 0).alias("accepted")), v.nodes.filter("y % 5 = 0")).select("page", "node", "state")
)
query("fallback_parents", "SELECT page, array_to_string(list_sort(list(DISTINCT coalesce(parent, node))), ',') AS parents FROM nodes WHERE state IN ('pending', 'failed') AND kind <> 'text' GROUP BY page")(lambda v: state.fallback_required(v.nodes).withColumn("parents", F.array_join(F.transform("parents", lambda p: p.cast("string")), ",")))
query("parent_fallback", "WITH e AS (SELECT page, count(DISTINCT coalesce(parent, node)) AS n FROM nodes WHERE state IN ('pending', 'failed') AND kind <> 'text' GROUP BY page), r AS (SELECT page, bool_and(x % 5 <> 0) AS ok, count(DISTINCT node) AS n FROM nodes WHERE kind = 'parent' GROUP BY page) SELECT e.page, CASE WHEN coalesce(r.ok, false) AND r.n = e.n THEN 'ready_for_assembly' ELSE 'preserved_with_warning' END AS phase FROM e LEFT JOIN r USING (page)")(
    lambda v: state.parent_fallback(v.nodes.filter("kind = 'parent'").select("page", "node", (c("x") % 5 != 0).alias("accepted")), state.fallback_required(v.nodes))
)
query("ready_pages", "SELECT page, CASE WHEN bool_and(state IN ('frozen', 'inactive')) THEN 'ready_for_assembly' ELSE 'request_published' END AS phase FROM nodes GROUP BY page")(lambda v: state.ready(v.nodes))
_RS = lambda v: v.rounds.groupBy("page").agg(F.max("round").alias("round"), F.count(F.lit(1)).alias("revision"), F.sort_array(F.collect_set(F.when(~c("accepted"), c("round")))).alias("failed")).withColumn("fallback_reason", F.when(c("page") % 3 == 0, "round_limit").when(c("page") % 3 == 1, "renderer"))
query("preserved_warning", "SELECT page, count(*) + 1 AS revision, 'preserved_with_warning' AS phase, 'preserved_with_warning' AS status, 'no_progress' AS fallback_reason FROM rounds GROUP BY page")(lambda v: state.preserved_warning(_RS(v), "no_progress"))
query("resumable_pages", "SELECT page FROM rounds GROUP BY page HAVING page % 3 = 0 AND max(round) < 5 AND count_if(NOT accepted) > 0")(lambda v: state.resumable(_RS(v)).select("page"))
_VIO = lambda: F.array_compact(F.array(F.when(c("x") % 2 == 0, F.lit("pptx_reopen_unknown")), F.when(c("x") % 3 == 0, F.lit("edge_loss")), F.when(c("y") % 2 == 0, F.lit("duplicate_pixels"))))
query("blocking_violations", "SELECT page, ord, array_to_string(list_filter([CASE WHEN x % 3 = 0 THEN 'edge_loss' END, CASE WHEN y % 2 = 0 THEN 'duplicate_pixels' END], lambda z: z IS NOT NULL), ',') AS blocking, CASE WHEN y % 2 = 0 THEN 'duplicate_pixels' ELSE '' END AS repairable FROM boxes")(
    lambda v: box(v.boxes, blocking=F.array_join(state.blocking(_VIO()), ","), repairable=F.array_join(state.repairable(_VIO(), ("duplicate_pixels", "over_merged")), ","))
)
query("run_status", "SELECT count_if(state IN ('frozen', 'inactive')) AS done, count_if(state NOT IN ('frozen', 'inactive')) AS open FROM nodes")(lambda v: state.status(v.state_log.groupBy("page").agg(F.max_by("state", "seq").alias("state")), v.nodes).select("done", "open"))
query("record_decisions", """WITH o AS (SELECT * FROM decisions WHERE object % 3 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY page, decision ORDER BY object) AS r FROM decisions WHERE object % 3 <> 1), k AS (SELECT page, count(*) AS c FROM o WHERE decision = 'replace' GROUP BY page)
    SELECT n.page, n.object, n.decision, CASE WHEN o.decision = n.decision THEN 'repeated' WHEN o.decision IS NOT NULL OR NOT (n.decision = 'preserve' OR (n.category = 'full_slide_screenshot' AND n.confidence >= 0.92)) OR (n.decision = 'replace' AND (coalesce(k.c, 0) > 0 OR n.r > 1)) THEN 'refused' ELSE 'recorded' END AS verdict
    FROM n LEFT JOIN o ON o.page = n.page AND o.object = n.object LEFT JOIN k ON k.page = n.page""")(lambda v: state.record_decisions(v.decisions.filter("object % 3 = 0"), v.decisions.filter("object % 3 <> 1")))  # fmt: skip
query("record_plans", "SELECT page, CASE WHEN page % 5 = 0 THEN 'wrong_request' WHEN page % 3 = 0 THEN 'recorded' WHEN page % 2 = 0 THEN 'repeated' WHEN page % 7 = 0 THEN 'recorded' ELSE 'refused' END AS verdict FROM (SELECT DISTINCT page FROM nodes)")(
    lambda v: (lambda p: state.record_plans(p.filter("page % 5 <> 0").select("page", F.lit("r").alias("request_sha256"), F.when(c("page") % 3 != 0, F.lit("p")).alias("plan_sha256"), (c("page") % 7 == 0).alias("retry_due")), p.select("page", F.lit("r").alias("request_sha256"), F.when(c("page") % 2 == 0, "p").otherwise("q").alias("plan_sha256"))))(v.nodes.select("page").distinct())
)
query("eligible_replacement", "SELECT page, object FROM decisions WHERE decision = 'replace' AND category = 'full_slide_screenshot' AND confidence >= 0.92")(lambda v: v.decisions.filter(q.eligible_replacement(c("decision"), c("category"), c("confidence"))).select("page", "object"))

# --- contracts --------------------------------------------------------------------

query("graph_violations", """SELECT 'unique_z' AS rule, page, min(node) AS node FROM nodes WHERE state <> 'inactive' GROUP BY page, z HAVING count(*) > 1 UNION ALL SELECT 'parent_exists', page, parent FROM nodes n WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes m WHERE m.page = n.page AND m.node = n.parent)
    UNION ALL SELECT 'active_family', a.page, a.node FROM nodes a JOIN nodes p ON p.page = a.page AND p.node = a.parent WHERE a.state <> 'inactive' AND p.state <> 'inactive' AND a.kind <> 'text' AND p.kind <> 'text'""")(lambda v: checks.graph_violations(v.nodes))  # fmt: skip
query("graph_transition_violations", "SELECT CASE WHEN ord % 11 = 0 THEN 'lost' WHEN x % 3 = 0 THEN 'frozen_changed' ELSE 'frozen_opened' END AS rule, page, node FROM nodes WHERE ord % 11 = 0 OR (state = 'frozen' AND y % 4 <> 0 AND (x % 3 = 0 OR x % 5 = 0))")(
    lambda v: checks.transition_violations(v.nodes.select("page", "node", "state", c("x").alias("record")), v.nodes.filter("ord % 11 <> 0").select("page", "node", F.when(c("x") % 5 == 0, "pending").otherwise(c("state")).alias("state"), F.when(c("x") % 3 == 0, c("x") + 1).otherwise(c("x")).alias("record")), v.nodes.filter("y % 4 = 0"))
)
query("plan_violations", """SELECT 'role' AS rule, a.page, a.node FROM actions a JOIN nodes n ON n.page = a.page AND n.node = a.node WHERE (n.state IN ('frozen', 'inactive') AND a.verb NOT IN ('accept', 'retry')) OR ((a.verb = 'suppress_text') <> (n.kind = 'text'))""")(lambda v: checks.plan_violations(v.actions, v.nodes))
query("ir_violations", "SELECT 'box' AS rule, page, node FROM nodes WHERE state = 'frozen' AND (kind <> 'text' OR x % 3 <> 0) AND NOT (x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 800 AND y + h <= 500) UNION ALL SELECT 'native_needs_raster', page, node FROM nodes WHERE state = 'frozen' AND kind <> 'text' AND y % 2 = 0 AND x % 4 = 0 UNION ALL SELECT 'has_candidate', page, node FROM nodes WHERE state = 'frozen' AND kind <> 'text' AND y % 2 <> 0 AND x % 4 = 0")(
    lambda v: checks.ir_violations(_ir(v).join(v.nodes.select("page", "node", "x", "y", "w", "h"), ["page", "node"]), 800, 500)
)
query("plan_coverage", "SELECT CASE WHEN x % 5 = 0 THEN 'missing' ELSE 'unknown' END AS rule, page, node FROM nodes WHERE (x % 5 = 0) <> (y % 7 = 0)")(lambda v: checks.coverage_violations(v.nodes.filter("x % 5 <> 0"), v.nodes.filter("y % 7 <> 0")))
query("route_result_check", "SELECT 'route' AS rule, page, node FROM nodes WHERE x % 9 = 0 UNION ALL SELECT 'confidence', page, node FROM nodes WHERE score > 0.97")(lambda v: checks.check(v.nodes.select("page", "node", F.when(c("x") % 9 == 0, "none").otherwise("raster").alias("route"), F.when(c("score") > 0.97, c("score") + 1).otherwise(c("score")).alias("score")), ["page", "node"], checks.route_rules()))
query("request_violations", "WITH r AS (SELECT page, list_sort(list(ord) FILTER (x % 2 = 0)) AS o, list_sort(list(ord) FILTER (x % 3 = 0)) AS f, count(*) AS n FROM boxes GROUP BY page) SELECT 'disjoint' AS rule, page FROM r WHERE list_has_any(o, f) IS DISTINCT FROM false AND o IS NOT NULL AND f IS NOT NULL UNION ALL SELECT 'round', page FROM r WHERE n > 5")(
    lambda v: checks.request_violations(v.boxes.groupBy("page").agg(F.count(F.lit(1)).alias("round"), F.array_sort(F.collect_list(F.when(c("x") % 2 == 0, c("ord")))).alias("open"), F.array_sort(F.collect_list(F.when(c("x") % 3 == 0, c("ord")))).alias("frozen")).withColumn("evidence", F.array(F.lit("source.png"))))
)
query("repair_state_violations", "SELECT 'round' AS rule, page FROM rounds GROUP BY page HAVING max(round) > 5 UNION ALL SELECT 'plan_ref', page FROM rounds GROUP BY page HAVING page % 4 = 1 AND page % 3 = 0 UNION ALL SELECT 'fallback', page FROM rounds GROUP BY page HAVING (page % 4 = 0) <> (page % 5 = 0)")(
    lambda v: checks.repair_state_violations(v.rounds.groupBy("page").agg(F.max("round").alias("round"), F.count(F.lit(1)).alias("revision")).select("page", "round", "revision", F.when(c("page") % 4 == 0, "preserved_with_warning").when(c("page") % 4 == 1, "plan_recorded").otherwise("awaiting_plan").alias("phase"), F.when(c("page") % 3 != 0, "p").alias("plan_ref"), F.lit("q").alias("qa_ref"), F.when(c("page") % 5 == 0, "x").alias("fallback_reason")))
)
query("report_recheck", "SELECT 'report' AS rule, page, node FROM nodes WHERE x % 13 = 0")(lambda v: checks.report_violations(v.nodes, v.nodes.withColumn("w", F.when(c("x") % 13 == 0, c("w") + 1).otherwise(c("w"))), "w", "h"))
query("inventory_violations", "WITH o AS (SELECT page, ord, tag IN ('p', 'b') AS k FROM tags) SELECT 'candidates' AS rule, page FROM o WHERE k AND ord % 50 = 9 GROUP BY page UNION ALL SELECT 'totals', page FROM o GROUP BY page HAVING page % 6 = 0")(
    lambda v: (lambda o: checks.inventory_violations(o, o.filter("action = 'candidate' and object % 50 <> 9"), o.groupBy("page").agg((F.count(F.lit(1)) + (F.first("page") % 6 == 0).cast("int")).alias("objects"), F.count_if(c("action") == "candidate").alias("candidates"))))(v.tags.select("page", c("ord").alias("object"), F.when(c("tag").isin("p", "b"), "candidate").otherwise("preserve").alias("action")))
)
query("shadow_patch_violations", "SELECT DISTINCT 'target_kept' AS rule, page FROM tags WHERE tag = 'footer' AND page % 4 = 0 UNION ALL SELECT DISTINCT 'protected_lost', page FROM tags WHERE tag = 'h1' AND page % 5 = 0")(
    lambda v: (lambda o: checks.patch_violations(o, o.filter("not (tag = 'footer' and page % 4 <> 0)").filter("not (tag = 'h1' and page % 5 = 0)"), o.filter("tag = 'footer'")))(v.tags.select("page", c("ord").alias("object"), F.md5("tag").alias("sha"), "tag"))
)
query("reference_blocks", "SELECT DISTINCT page FROM boxes WHERE (label = 'chart' AND x % 2 = 0) OR y % 97 = 0")(lambda v: checks.reference_blocks(v.boxes.select("page", F.when(c("label") == "chart", "connector").otherwise("text").alias("type"), (c("x") % 2 == 0).alias("refers_to_target"), (c("y") % 97 == 0).alias("has_timing_reference"))))
query("trace_event_violations", "WITH t AS (SELECT event_id, event, stage, model FROM trace) SELECT 'allowed_fields' AS rule, event_id FROM t WHERE event LIKE 'model_load%'")(
    lambda v: checks.trace_event_violations(v.trace.select("event_id", "event", "stage", "model", F.when(c("event") != "model_load_start", c("duration_ms")).alias("duration_ms"), F.when(c("event").isin("worker", "model_load_finish", "inference_finish"), c("status")).alias("status")), ["event_id"])
)
query("trace_summary_violations", f"SELECT 'range' AS rule, page, field, key FROM ({_ROLL}) WHERE value > 100000")(lambda v: checks.summary_violations(aggregates.trace_rollup(v.trace), 100_000))
query("diagnostics_violations", "SELECT 'box' AS rule, page, ord FROM boxes WHERE x + w > 800 OR y + h > 500 UNION ALL SELECT 'too_many', page, max(ord) FROM boxes GROUP BY page HAVING count(*) > 8")(lambda v: checks.diagnostics_violations(v.boxes, 800, 500, 8))
query("node_contract", "SELECT 'box' AS rule, page, node FROM nodes WHERE w > 200 UNION ALL SELECT 'kind', page, node FROM nodes WHERE x % 17 = 0")(lambda v: checks.check(v.nodes.withColumn("w", F.when(c("w") > 200, -1).otherwise(c("w"))).withColumn("kind", F.when(c("x") % 17 == 0, "blob").otherwise(c("kind"))), ["page", "node"], checks.node_rules()))

# --- sources and sinks ------------------------------------------------------------

query("classify_inputs", "WITH k AS (SELECT page, count(*) AS n, count_if(x % 5 = 0) AS pdf, count_if(x % 5 = 1) AS pptx FROM boxes GROUP BY page) SELECT page AS job, CASE WHEN pdf > 0 THEN 'pdf' WHEN pptx > 0 THEN 'pptx' ELSE 'images' END AS kind, CASE WHEN pdf + pptx > 0 AND n > 1 THEN 'must_be_the_only_input' END AS problem FROM k")(
    lambda v: files.classify(v.boxes.select(c("page").alias("job"), "ord", F.concat(F.lit("in/f."), F.when(c("x") % 5 == 0, "PDF").when(c("x") % 5 == 1, "pptx").otherwise("png")).alias("path")))
)
query("image_job", "SELECT printf('page_%03d', doc_id + 1) AS page_id, source, sha256(text) AS sha256, 'pending' AS state FROM documents")(lambda v: files.image_job(v.table("documents").select(c("doc_id").alias("ordinal"), c("source").alias("path"), F.sha2("text", 256).alias("sha256"))))
query("content_types", "WITH m AS (SELECT page, ord, tag, CASE WHEN tag = 'p' THEN 'a.XML' WHEN tag = 'b' THEN 'b.png' ELSE 'c' END AS name FROM tags WHERE ord % 10 = 0) SELECT page || ':' || ord AS path, name, CASE WHEN tag = 'p' AND ord % 20 = 0 THEN 'own' WHEN tag = 'p' THEN 'xml' WHEN tag = 'b' THEN 'png' END AS content_type FROM m")(
    lambda v: (lambda m: packages.content_types(m.select("path", F.explode(F.array(F.lit("xml"), F.lit("PNG"))).alias("extension")).withColumn("content_type", F.lower("extension")), m.filter("name = 'a.XML' and ord % 20 = 0").select("path", F.lit("/a.XML").alias("part"), F.lit("own").alias("content_type")), m))(v.tags.filter("ord % 10 = 0").select(F.concat_ws(":", "page", "ord").alias("path"), "ord", F.when(c("tag") == "p", "a.XML").when(c("tag") == "b", "b.png").otherwise("c").alias("name")))
)
query("missing_content_defaults", "SELECT DISTINCT tag AS extension, CASE WHEN length(tag) = 1 THEN tag || '/x' END AS content_type, CASE WHEN length(tag) <> 1 THEN 'donor_default_missing' END AS problem FROM tags WHERE tag NOT IN ('p', 'li')")(
    lambda v: (lambda k: packages.missing_defaults(k.filter("extension in ('p', 'li')"), k.filter("length(extension) = 1").withColumn("content_type", F.concat("extension", F.lit("/x"))), k))(v.tags.select(c("tag").alias("extension")).distinct())
)
query("package_limits", "SELECT page AS path, array_to_string(list_sort(list_distinct(flatten(list(list_filter([CASE WHEN CAST(x AS BIGINT) * 3000000 > 536870912 THEN 'part_size' END, CASE WHEN CAST(x AS BIGINT) * 3000000 > 200 * greatest(1, CAST(w AS BIGINT) * 20000) THEN 'ratio' END, CASE WHEN y % 9 = 0 THEN 'encrypted' END], lambda z: z IS NOT NULL))) || CASE WHEN sum(CAST(x AS BIGINT) * 3000000) > 2147483648 THEN ['total_size'] ELSE [] END)), ',') AS violations FROM boxes GROUP BY page")(
    lambda v: packages.package_violations(v.boxes.select(c("page").alias("path"), F.concat(F.lit("ppt/"), c("ord").cast("string")).alias("name"), (c("x").cast("long") * 3_000_000).alias("size"), (c("w").cast("long") * 20_000).alias("packed"), (c("y") % 9 == 0).alias("encrypted"), F.lit(False).alias("is_dir"))).withColumn("violations", F.array_join("violations", ","))
)
query("slide_notes", "WITH r AS (SELECT page AS slide, ord, tag FROM tags WHERE tag IN ('p', 'b')) SELECT slide, CAST(min(ord) AS VARCHAR) AS target, CASE WHEN arg_min(tag, ord) = 'b' THEN 'invalid_notes' END AS problem FROM r GROUP BY slide")(
    lambda v: packages.notes(v.tags.filter("tag in ('p', 'b')").select(c("page").alias("slide"), "ord", F.lit(packages.REL + "notesSlide").alias("type"), c("ord").cast("string").alias("target"), F.when(c("tag") == "b", "External").otherwise("Internal").alias("target_mode"), F.lit("x.notesSlide+xml").alias("content_type")))
)
query("referenced_relationships", "SELECT page AS object, min(ord) AS ord, tag AS rel_id, CASE WHEN length(tag) = 1 THEN tag || '.xml' END AS target FROM tags GROUP BY page, tag")(
    lambda v: packages.referenced(v.tags.select(c("page").alias("object"), "ord", c("tag").alias("rel_id")), v.tags.filter("length(tag) = 1").select(c("tag").alias("id"), F.concat("tag", F.lit(".xml")).alias("target")).distinct())
)
query("slide_inventory", "WITH k AS (SELECT page, tag, count(*) AS n, count_if(ord % 3 = 0) AS k FROM tags GROUP BY page, tag) SELECT CAST(page AS VARCHAR) AS path, CAST(0 AS INTEGER) AS slide_ordinal, sum(n) AS objects, sum(k) AS candidates, string_agg(tag || '=' || n, ',' ORDER BY tag) AS types FROM k GROUP BY page")(
    lambda v: packages.slide_inventory(v.tags.select(c("page").cast("string").alias("path"), F.lit(0).alias("slide_ordinal"), c("tag").alias("type"), F.when(c("ord") % 3 == 0, "candidate").otherwise("preserve").alias("action"))).withColumn("types", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))
)
query("output_targets", "SELECT page AS job, CASE WHEN page % 2 = 0 THEN 'o_original.pptx' ELSE 'o.pptx' END AS path, CASE WHEN page % 2 = 0 THEN 'original' ELSE '16:9' END AS size FROM (SELECT DISTINCT page FROM boxes) UNION ALL SELECT page, 'o_16x9.pptx', '16:9' FROM (SELECT DISTINCT page FROM boxes) WHERE page % 2 = 0")(
    lambda v: pipelines.variants(v.boxes.select(c("page").alias("job")).distinct().select("job", F.lit("o.pptx").alias("path"), F.when(c("job") % 2 == 0, "both").otherwise("16:9").alias("size")))
)
query("insert_donor_shapes", "WITH d AS (SELECT page, ord FROM boxes WHERE x % 2 = 0), n AS (SELECT page, count(*) AS n FROM d GROUP BY page), m AS (SELECT page, max(CAST(page * 100 + ord AS BIGINT)) AS top FROM boxes GROUP BY page) SELECT b.page, b.page * 100 + b.ord AS id, b.z + coalesce(n.n, 0) AS z FROM boxes b LEFT JOIN n USING (page) UNION ALL SELECT d.page, m.top + row_number() OVER (PARTITION BY d.page ORDER BY d.ord), row_number() OVER (PARTITION BY d.page ORDER BY d.ord) - 1 FROM d JOIN m USING (page)")(
    lambda v: writers.insert_at_bottom(v.boxes.select("page", (c("page") * 100 + c("ord")).alias("id"), "z"), v.boxes.filter("x % 2 = 0").select("page", "ord"))
)
query("replace_screenshot", "WITH t AS (SELECT page, page * 100 + ord AS id FROM boxes WHERE ord = 1 AND x % 3 = 0), k AS (SELECT page, page * 100 + ord AS id, z FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND t.id = b.page * 100 + b.ord)), d AS (SELECT page, ord FROM boxes WHERE x % 2 = 0 AND page IN (SELECT page FROM t)), n AS (SELECT page, count(*) AS n FROM d GROUP BY page), m AS (SELECT page, max(id) AS top FROM k GROUP BY page) SELECT k.page, k.id, k.z + coalesce(n.n, 0) AS z FROM k LEFT JOIN n USING (page) UNION ALL SELECT d.page, coalesce(m.top, 0) + row_number() OVER (PARTITION BY d.page ORDER BY d.ord), row_number() OVER (PARTITION BY d.page ORDER BY d.ord) - 1 FROM d LEFT JOIN m USING (page)")(
    lambda v: (lambda b: writers.replace_objects(b, b.filter("ord = 1 and x % 3 = 0"), b.filter("x % 2 = 0")))(v.boxes.withColumn("id", c("page") * 100 + c("ord")))
)
query("fold_replacements", "WITH p AS (SELECT page, max(CASE WHEN x % 9 = 0 THEN 'check_failed' END) AS problem, count(*) AS n FROM boxes WHERE ord <= 2 AND y % 2 = 0 GROUP BY page) SELECT b.page, CASE WHEN n IS NULL THEN 'preserved' WHEN problem IS NOT NULL OR n > 1 THEN 'preserved_with_warning' ELSE 'replaced' END AS status, coalesce(problem, CASE WHEN n > 1 THEN 'conflict' END) AS warning FROM (SELECT DISTINCT page FROM boxes) b LEFT JOIN p USING (page)")(
    lambda v: writers.fold_replacements(v.boxes.select("page").distinct(), v.boxes.filter("ord <= 2 and y % 2 = 0").select("page", F.when(c("x") % 9 == 0, "check_failed").alias("problem")))
)
query("gather_results", "SELECT page AS job, string_agg('p' || ord, ',' ORDER BY ord) AS pages, count_if(x % 7 = 0) > 0 AS blocked FROM boxes GROUP BY page")(
    lambda v: writers.gather(v.boxes.select(c("page").alias("job"), c("ord").alias("ordinal"), F.concat(F.lit("p"), c("ord").cast("string")).alias("page_id"), F.when(c("x") % 7 == 0, "preserved_with_warning").otherwise("replaced").alias("status"))).withColumn("pages", F.array_join("pages", ","))
)
query("component_export", "SELECT page, 'component_' || lpad(CAST(ord AS VARCHAR), 4, '0') AS name, greatest(0, x - 3) AS x, greatest(0, y - 3) AS y, least(800, x + w + 3) - greatest(0, x - 3) AS w, least(500, y + h + 3) - greatest(0, y - 3) AS h, w * h AS pixels, z FROM boxes")(lambda v: writers.component_records(v.boxes.withColumn("pixels", c("w") * c("h")), 3, 800, 500))
query("layer_manifest", "WITH l AS (SELECT page, ord, z, label AS name, CASE WHEN ord = 1 THEN 0 WHEN x % 2 = 0 THEN 2 ELSE 1 END AS r FROM boxes) SELECT page, string_agg(name, ',' ORDER BY r, z, ord) AS layers FROM l GROUP BY page")(
    lambda v: writers.layer_manifest(v.boxes.select("page", "ord", "z", c("label").alias("name"), F.when(c("ord") == 1, "background").when(c("x") % 2 == 0, "text").otherwise("component").alias("kind"), "x", "y", "w", "h")).select("page", F.array_join(F.transform("layers", lambda s: s["name"]), ",").alias("layers"))
)
query("tiles", "SELECT page, row_number() OVER (PARTITION BY page ORDER BY y, x) - 1 AS tile, x, y FROM (SELECT DISTINCT page, xx AS x, yy AS y FROM (SELECT page, unnest(list_distinct(generate_series(0, 900 - 400, 300) || [500])) AS xx FROM (SELECT DISTINCT page FROM boxes)) a JOIN (SELECT page, unnest(list_distinct(generate_series(0, 700 - 400, 300) || [300])) AS yy FROM (SELECT DISTINCT page FROM boxes)) b USING (page))")(
    lambda v: pipelines.tiles(v.boxes.select("page").distinct().withColumn("width", F.lit(900)).withColumn("height", F.lit(700)), 400, 100).select("page", "tile", "x", "y")
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
