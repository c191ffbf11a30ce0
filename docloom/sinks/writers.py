"""Sinks.  Tables go through Spark's writers; a package is made by one task per file."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the package format.
EMU = 914_400
NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPE = "application/vnd.openxmlformats-officedocument.presentationml"
GEOMETRY = {"rectangle": "rect", "rounded": "roundRect", "ellipse": "ellipse", "line": "line"}
ALIGN = {0: "l", 1: "ctr", 2: "r"}


def write_json(df: DataFrame, path: str) -> None:
    """Documents with sorted keys; the job's commit publishes all files or none."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def publish(df: DataFrame, path: str) -> None:
    """Write only if nothing is there."""
    df.write.mode("errorifexists").parquet(path)


def append_trace(events: DataFrame, path: str) -> None:
    """Append valid events, null fields left out, as JSON lines."""
    from docloom.operators.checks import trace_event_violations

    key = ["event", "duration_ms"]
    bad = trace_event_violations(events, key).limit(1).take(1)
    if bad:
        raise ValueError(f"trace event breaks rule {bad[0].rule}")
    events.withColumn("schema_version", F.lit(1)).write.mode("append").json(path)


def output_targets(jobs: DataFrame) -> DataFrame:
    """job, path, size: one file, or two for `both` (..._original and ..._16x9)."""
    stem, ext = F.regexp_replace("path", r"\.[^./]*$", ""), F.regexp_extract("path", r"(\.[^./]*)$", 1)
    both = F.array(F.struct(F.concat(stem, F.lit("_original"), ext).alias("path"), F.lit("original").alias("size")), F.struct(F.concat(stem, F.lit("_16x9"), ext).alias("path"), F.lit("16:9").alias("size")))
    one = F.array(F.struct(F.col("path").alias("path"), F.col("size").alias("size")))
    return jobs.select("job", F.explode(F.when(F.col("size") == "both", both).otherwise(one)).alias("t")).select("job", "t.path", "t.size")


def insert_at_bottom(objects: DataFrame, donors: DataFrame) -> DataFrame:
    """page, id, z: donor rows (page, ord) below all objects (page, id, z), with fresh ids."""
    from docloom.operators.ranking import fresh_ids

    n = donors.groupBy("page").agg(F.count(F.lit(1)).alias("_n"))
    moved = objects.join(n, "page", "left").select("page", "id", (F.col("z") + F.coalesce("_n", F.lit(0))).alias("z"))
    w = F.row_number().over(Window.partitionBy("page").orderBy("ord"))
    new = fresh_ids(objects, donors).withColumn("z", w - 1).select("page", F.col("new_id").alias("id"), "z")
    return moved.unionByName(new)


def replace_objects(objects: DataFrame, targets: DataFrame, donors: DataFrame) -> DataFrame:
    """objects without the targets (page, id), with the donors' rows added at the bottom."""
    kept = objects.join(targets.select("page", "id"), ["page", "id"], "left_anti").select("page", "id", "z")
    hit = donors.join(targets.select("page").distinct(), "page", "left_semi")
    return insert_at_bottom(kept, hit)


def fold_replacements(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """page, status, warning: replaced, preserved, or preserved with a warning where a plan's
    check failed; one page's failure never stops the others.

    pages: page; plans: page, problem.
    """
    p = plans.groupBy("page").agg(F.max("problem").alias("problem"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "preserved").when(F.col("problem").isNotNull() | (F.col("n") > 1), "preserved_with_warning").otherwise("replaced")
    return pages.join(p, "page", "left").select("page", status.alias("status"), F.coalesce("problem", F.when(F.col("n") > 1, "conflict")).alias("warning"))


def gather(results: DataFrame) -> DataFrame:
    """Accepted results in page order with a guard: job, pages, blocked (a warning page)."""
    return results.groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "page_id"))), lambda s: s["page_id"]).alias("pages"), (F.count_if(F.col("status") == "preserved_with_warning") > 0).alias("blocked"))


def component_records(crops: DataFrame, padding: int, width: int, height: int) -> DataFrame:
    """page, name, x, y, w, h, area, z of exported components: padded boxes clipped to the page."""
    c = F.col
    x1, y1 = F.greatest(F.lit(0), c("x") - padding), F.greatest(F.lit(0), c("y") - padding)
    x2, y2 = F.least(F.lit(width), c("x") + c("w") + padding), F.least(F.lit(height), c("y") + c("h") + padding)
    return crops.select("page", F.format_string("component_%04d", c("ord")).alias("name"), x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"), "pixels", "z")


def write_components(records: DataFrame, path: str) -> None:
    """Component graphs, trees and diagnostics: partitioned tables, one folder a page group."""
    records.withColumn("bucket", F.col("page") % 64).write.mode("overwrite").partitionBy("bucket").parquet(path)


def layer_manifest(layers: DataFrame) -> DataFrame:
    """Layered-document manifest: page, layers in drawing order, background first, texts last.

    layers: page, kind (background, component, text), z, ord, name, x, y, w, h.
    """
    rank = F.when(F.col("kind") == "background", 0).when(F.col("kind") == "component", 1).otherwise(2)
    entry = F.struct(rank.alias("r"), "z", "ord", "name", "kind", "x", "y", "w", "h")
    return layers.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["x"].alias("x"), s["y"].alias("y"), s["w"].alias("w"), s["h"].alias("h"))).alias("layers"))


def _shape(i: int, s: dict) -> str:
    x, y, w, h = (round(s[k] * EMU) for k in ("left", "top", "width", "height"))
    frame = f'<a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{max(0, w)}" cy="{max(0, h)}"/></a:xfrm>'
    color = (s.get("color") or "#000000").lstrip("#")
    ident = f'<p:cNvPr id="{i}" name={quoteattr(s.get("name") or f"item {i}")}/>'
    if s["kind"] == "text":
        runs = escape(s.get("text") or "")
        props = f'<a:rPr lang="en-US" sz="{round((s.get("font_size") or 12) * 100)}" b="{int(bool(s.get("bold")))}"><a:solidFill><a:srgbClr val="{color}"/></a:solidFill><a:latin typeface={quoteattr(s.get("font") or "Arial")}/></a:rPr>'
        return f'<p:sp><p:nvSpPr>{ident}<p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr>{frame}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom><a:noFill/></p:spPr><p:txBody><a:bodyPr wrap="square" lIns="0" tIns="0" rIns="0" bIns="0"/><a:p><a:pPr algn="{ALIGN[int(s.get("align") or 0)]}"/><a:r>{props}<a:t>{runs}</a:t></a:r></a:p></p:txBody></p:sp>'
    if s["kind"] == "shape":
        return f'<p:sp><p:nvSpPr>{ident}<p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr>{frame}<a:prstGeom prst="{GEOMETRY[s["shape"]]}"><a:avLst/></a:prstGeom><a:solidFill><a:srgbClr val="{color}"/></a:solidFill></p:spPr></p:sp>'
    return f'<p:pic><p:nvPicPr>{ident}<p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="{s["rel"]}"/><a:stretch><a:fillRect/></a:stretch></p:blipFill><p:spPr>{frame}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic>'


def build_package(slides: list[list[dict]], width: float, height: float) -> bytes:
    """A slide package from rows of kind picture (png bytes), shape or text, sizes in inches."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = [f'<Override PartName="/ppt/presentation.xml" ContentType="{TYPE}.presentation.main+xml"/>']
        rels, ids, media = [], [], 0
        for n, items in enumerate(slides, start=1):
            own, body = [], []
            for i, s in enumerate(items, start=2):
                if s["kind"] == "picture":
                    media += 1
                    z.writestr(f"ppt/media/image{media}.png", bytes(s["png"]))
                    own.append(f'<Relationship Id="rId{i}" Type="{REL}/image" Target="../media/image{media}.png"/>')
                    s = s | {"rel": f"rId{i}"}
                body.append(_shape(i, s))
            tree = f'<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{"".join(body)}'
            z.writestr(f"ppt/slides/slide{n}.xml", f'<?xml version="1.0" encoding="UTF-8"?><p:sld {NS}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>')
            z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(own)}</Relationships>')
            kinds.append(f'<Override PartName="/ppt/slides/slide{n}.xml" ContentType="{TYPE}.slide+xml"/>')
            rels.append(f'<Relationship Id="rId{n}" Type="{REL}/slide" Target="slides/slide{n}.xml"/>')
            ids.append(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>')
        z.writestr("ppt/presentation.xml", f'<?xml version="1.0" encoding="UTF-8"?><p:presentation {NS}><p:sldIdLst>{"".join(ids)}</p:sldIdLst><p:sldSz cx="{round(width * EMU)}" cy="{round(height * EMU)}"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(rels)}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="ppt/presentation.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>{"".join(kinds)}</Types>')
    return buffer.getvalue()


ITEMS = "deck string, slide int, ord int, kind string, left double, top double, width double, height double, png binary, shape string, text string, font string, font_size double, bold boolean, align int, color string, name string"


def assemble(items: DataFrame, width: float, height: float) -> DataFrame:
    """deck, package: one slide package a deck, each built in one task.

    items: columns of ITEMS; rows of a slide are drawn in `ord` order.  A deck that mixes
    shapes of pages needs one aspect ratio: give each its own deck otherwise.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["slide", "ord"])
        slides = [g.to_dict("records") for _, g in rows.groupby("slide")]
        return pd.DataFrame({"deck": pdf["deck"].iloc[:1], "package": [build_package(slides, width, height)]})

    return items.groupBy("deck").applyInPandas(run, "deck string, package binary")
