"""Slide packages (zip and XML) as tables of parts, relationships and objects.

A package is one binary row; it is opened in the task that reads it, and everything else
is DataFrame work on the rows that come out.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions import geometry as g
from docloom.functions import quality as q
from docloom.functions import text as t

#: Fixed values of the package format, and the limits of a package.
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/"
MEMBERS, PART_BYTES, TOTAL_BYTES, RATIO = 10_000, 512 << 20, 2 << 30, 200
SUPPORTED = frozenset({"http://schemas.microsoft.com/office/drawing/2010/main", "http://schemas.microsoft.com/office/powerpoint/2010/main"})


def packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter(F.lower("path").endswith(".pptx")).select("path", "content")


def parts(files: DataFrame) -> DataFrame:
    """path, name, size, packed, encrypted, is_dir, sha256 of every member (hash null over the
    part limit); a file that is no zip gives one row with name null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for i in z.infolist():
                            secret = bool(i.flag_bits & 1)
                            fine = not secret and i.file_size <= PART_BYTES and i.file_size <= RATIO * max(1, i.compress_size)
                            out.append((path, i.filename, i.file_size, i.compress_size, secret, i.is_dir(), hashlib.sha256(z.read(i)).hexdigest() if fine else None))
                except zipfile.BadZipFile:
                    out.append((path, None, 0, 0, False, False, None))
            yield pd.DataFrame(out, columns=["path", "name", "size", "packed", "encrypted", "is_dir", "sha256"])

    return files.mapInPandas(run, "path string, name string, size long, packed long, encrypted boolean, is_dir boolean, sha256 string")


def package_violations(members: DataFrame) -> DataFrame:
    """path, violations: limits, unsafe, repeated, encrypted and directory members."""
    bad = F.array_compact(
        F.array(
            F.when(F.col("name").isNull(), F.lit("not_a_package")),
            F.when(F.col("size") > PART_BYTES, F.lit("part_size")),
            F.when(F.col("size") > RATIO * F.greatest(F.lit(1), F.col("packed")), F.lit("ratio")),
            F.when(F.col("encrypted"), F.lit("encrypted")),
            F.when(F.col("is_dir") & (F.col("size") > 0), F.lit("directory_payload")),
            F.when(F.col("name").isNotNull() & ~F.col("is_dir") & ~t.safe_member(F.col("name")), F.lit("unsafe_name")),
        )
    )
    folded = members.groupBy("path", F.lower("name").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    twice = folded.groupBy("path").agg(F.max("c").alias("twice"))
    per = members.groupBy("path").agg(F.flatten(F.collect_set(bad)).alias("v"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    more = F.array_compact(F.array(F.when(F.col("n") > MEMBERS, F.lit("members")), F.when(F.col("total") > TOTAL_BYTES, F.lit("total_size")), F.when(F.col("twice") > 1, F.lit("repeated_name"))))
    return per.join(twice, "path").select("path", F.array_sort(F.array_distinct(F.concat("v", more))).alias("violations"))


def content_types(defaults: DataFrame, overrides: DataFrame, members: DataFrame) -> DataFrame:
    """path, name, content_type: by part name, else by the case-folded extension."""
    ext = F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1))
    d = defaults.select("path", F.lower("extension").alias("_e"), F.col("content_type").alias("_d"))
    o = overrides.select("path", F.regexp_replace("part", "^/", "").alias("name"), F.col("content_type").alias("_o"))
    return members.select("path", "name").withColumn("_e", ext).join(o, ["path", "name"], "left").join(d, ["path", "_e"], "left").select("path", "name", F.coalesce("_o", "_d").alias("content_type"))


def missing_defaults(source: DataFrame, donor: DataFrame, needed: DataFrame) -> DataFrame:
    """extension, content_type, problem: donor defaults a package lacks for imported parts.

    source, donor: extension, content_type; needed: extension.
    """
    want = needed.select(F.lower("extension").alias("extension")).distinct().join(source.select(F.lower("extension").alias("extension")), "extension", "left_anti")
    have = want.join(donor.select(F.lower("extension").alias("extension"), "content_type"), "extension", "left")
    return have.withColumn("problem", F.when(F.col("content_type").isNull(), "donor_default_missing"))


def _target(part: str, target: str) -> str | None:
    path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(part), target))
    return None if path.startswith("..") else path


_DIGITS = re.compile(r"[+-]?[0-9]+")


def _integer(v):
    """As text.ooxml_integer: ASCII digits, at most 20 characters and 64 bits."""
    if not isinstance(v, str) or len(v) > 20 or not _DIGITS.fullmatch(v):
        return None
    return int(v) if -(2**63) <= int(v) < 2**63 else None


def _relations(z: zipfile.ZipFile, part: str, types: dict) -> dict:
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    out: dict = {}
    if name in z.namelist():
        for r in ET.fromstring(z.read(name)):
            mode = r.get("TargetMode", "Internal")
            target = r.get("Target", "") if mode == "External" else _target(part, r.get("Target", ""))
            if r.get("Id") in out or mode not in ("Internal", "External"):
                raise ValueError("relationship")
            out[r.get("Id")] = {"id": r.get("Id"), "type": r.get("Type"), "target": target, "target_mode": mode, "content_type": types.get(target) or types.get("." + (target or "").rpartition(".")[2].lower())}
    return out


def _children(parent, scopes):
    """Shape nodes of a tree.  Of alternatives the first counts that names needs and whose
    needs are all met, else the fallback; one that holds nothing is an error."""
    met = lambda c: bool(needs := (c.get("Requires") or "").split()) and {scopes.get(p) for p in needs} <= set(SUPPORTED)
    for node in parent:
        if node.tag == MC + "AlternateContent":
            fit = [c for c in node if c.tag == MC + "Choice" and met(c)] or [c for c in node if c.tag == MC + "Fallback"]
            shapes = list(_children(fit[0], scopes)) if fit else []
            if not shapes:
                raise ValueError("alternatives")
            yield from shapes
        elif node.tag in (P + "sp", P + "pic", P + "grpSp", P + "graphicFrame", P + "cxnSp", P + "contentPart"):
            yield node


def _kind(node) -> str:
    plain = {P + "grpSp": "group", P + "cxnSp": "connector", P + "contentPart": "unknown"}
    if node.tag in plain:
        return plain[node.tag]
    if node.tag == P + "pic":
        media = any(node.iter(A + tag) for tag in ("videoFile", "audioFile")) and any(True for tag in ("videoFile", "audioFile") for _ in node.iter(A + tag))
        return "media" if media else "picture"
    if node.tag == P + "sp":
        return "text" if node.find(f"{P}nvSpPr/{P}cNvSpPr[@txBox='1']") is not None or node.find(f".//{P}ph") is not None else "autoshape"
    uri = next((d.get("uri", "") for d in node.iter(A + "graphicData")), "")
    return next((k for k in ("table", "chart") if uri.endswith("/" + k)), "smartart" if uri.endswith("/diagram") else "unknown")


def _transform(node) -> dict:
    x = node.find(f".//{A}xfrm")
    x = x if x is not None else node.find(f".//{P}xfrm")
    off, ext = (None, None) if x is None else (x.find(A + "off"), x.find(A + "ext"))
    v = [_integer(o.get(k)) if o is not None else None for o, k in ((off, "x"), (off, "y"), (ext, "cx"), (ext, "cy"))]
    turn = _integer(x.get("rot", "0")) if x is not None else 0
    flips = [x.get(k, "0") if x is not None else "0" for k in ("flipH", "flipV")]
    fine = None not in v and turn is not None and all(f in ("0", "1", "true", "false") for f in flips)
    return {"x": v[0] or 0, "y": v[1] or 0, "cx": v[2] or 0, "cy": v[3] or 0, "transform_reliable": fine, "rotation": (turn or 0) / 60000, "flip_h": flips[0] in ("1", "true"), "flip_v": flips[1] in ("1", "true")}


def _walk(parent, path, scopes, rels, timed, parts_sha):
    for node in _children(parent, scopes):
        ident = next((n for n in node.iter(P + "cNvPr")), None)
        own = {} if ident is None else ident.attrib
        kind = _kind(node)
        blips = [b.get(R + k) for b in node.iter(A + "blip") for k in ("embed", "link") if b.get(R + k)] if kind != "group" else []
        used = list(dict.fromkeys(v for n in (node.iter() if kind != "group" else ()) for k, v in n.attrib.items() if k.startswith(R)))
        crop = node.find(f".//{A}srcRect") if kind == "picture" else None
        side = lambda k: 0 if crop is None or crop.get(k) is None else (1 if _integer(crop.get(k)) is None else _integer(crop.get(k)))  # noqa: E731, B023
        media = rels.get(blips[0], {}).get("target") if blips else None
        yield {
            "shape_id": own.get("id"), "name": own.get("name"), "type": kind, "group_path": path, **_transform(node), "crop_left": side("l"), "crop_top": side("t"), "crop_right": side("r"), "crop_bottom": side("b"),
            "inside_group": bool(path), "has_extension": any(True for _ in node.iter(P + "extLst")), "has_timing_reference": own.get("id") in timed,
            "relationships": [rels.get(i, {"id": i, "type": None, "target": None, "target_mode": None, "content_type": None}) for i in used], "blip_sources": blips,
            "media_sha256": parts_sha.get(media), "media_valid": parts_sha.get(media) is not None, "xml_sha256": hashlib.sha256(ET.canonicalize(ET.tostring(node)).encode()).hexdigest(),
        }
        if kind == "group":
            yield from _walk(node, [*path, own.get("id") or ""], scopes, rels, timed, parts_sha)


def objects(files: DataFrame) -> DataFrame:
    """Every object of every slide in preorder, a picture background first; problem rows for
    slides that can't be read.  Columns: path, slide_ordinal, problem and schemas.OBJECTS."""
    schema = "path string, slide_ordinal int, problem string, " + schemas.OBJECTS
    names = [c.strip().split(" ")[0] for c in _split(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [{"path": path, **r} for r in _slides(z)]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError) as e:
                    out.append({"path": path, "problem": f"{type(e).__name__}"})
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in out], columns=names)

    return files.mapInPandas(run, schema)


def _split(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, own = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(own)
            own = ""
        else:
            own += ch
    return [*out, own]


def _slides(z: zipfile.ZipFile) -> Iterator[dict]:
    types: dict = {}
    for e in ET.fromstring(z.read("[Content_Types].xml")):
        types[e.get("PartName", "").lstrip("/") if e.tag.endswith("Override") else "." + e.get("Extension", "").lower()] = e.get("ContentType")
    shas = {i.filename: hashlib.sha256(z.read(i)).hexdigest() for i in z.infolist() if i.filename.startswith("ppt/media/")}
    main = "ppt/presentation.xml"
    root, rels = ET.fromstring(z.read(main)), _relations(z, main, types)
    size = root.find(P + "sldSz")
    sw, sh = (_integer(size.get("cx")), _integer(size.get("cy"))) if size is not None else (0, 0)
    for n, s in enumerate(root.iter(P + "sldId")):
        part = rels[s.get(R + "id")]["target"]
        raw = z.read(part)
        scopes = dict(v for _, v in ET.iterparse(io.BytesIO(raw), events=("start-ns",)))
        slide, own = ET.fromstring(raw), _relations(z, part, types)
        timed = {e.get("spid") for e in slide.iter(P + "spTgt")}
        rows = list(_walk(slide.find(f"{P}cSld/{P}spTree"), [], scopes, own, timed, shas))
        for i, r in enumerate(rows):
            r["z_order"] = i
        blip = slide.find(f"{P}cSld/{P}bg//{A}blip")
        if blip is not None:
            target = own.get(blip.get(R + "embed"), {}).get("target")
            rows.insert(0, {"shape_id": None, "name": "background", "type": "slide_background_image", "z_order": -1, "group_path": [], "x": 0, "y": 0, "cx": sw, "cy": sh, "transform_reliable": True, "rotation": 0.0, "flip_h": False, "flip_v": False, "crop_left": 0, "crop_top": 0, "crop_right": 0, "crop_bottom": 0, "inside_group": False, "has_extension": False, "has_timing_reference": False, "relationships": [own[blip.get(R + "embed")]] if blip.get(R + "embed") in own else [], "blip_sources": [blip.get(R + "embed")], "media_sha256": shas.get(target), "media_valid": target in shas, "xml_sha256": None})
        for i, r in enumerate(rows):
            yield {"slide_ordinal": n, "part": main, "slide": part, "ordinal": i, **r}


def notes(relations: DataFrame) -> DataFrame:
    """slide, target, problem: the first notes relation of a slide; wrong mode or MIME is named.

    relations: slide, ord, type, target, target_mode, content_type.
    """
    own = relations.filter(F.col("type") == REL + "notesSlide").groupBy("slide").agg(F.min_by(F.struct("target", "target_mode", "content_type"), "ord").alias("r"))
    wrong = (F.col("r.target_mode") != "Internal") | ~F.coalesce(F.col("r.content_type"), F.lit("")).contains("notesSlide")
    return own.select("slide", "r.target", F.when(wrong, "invalid_notes").alias("problem"))


def referenced(attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """object, ord, rel_id, target: first-seen distinct references; unknown ids keep nulls."""
    first = attributes.groupBy("object", "rel_id").agg(F.min("ord").alias("ord"))
    return first.join(relations.select(F.col("id").alias("rel_id"), "target"), "rel_id", "left").select("object", "ord", "rel_id", "target")


def safety(pictures: DataFrame, slide_w: int, slide_h: int) -> DataFrame:
    """Pictures of objects() with slide_coverage, safety_reasons and action."""
    rel = F.col("relationships")
    c = {n: F.col(n) for n in ("transform_reliable", "cx", "cy", "inside_group", "rotation", "flip_h", "flip_v", "crop_left", "crop_top", "crop_right", "crop_bottom", "has_extension", "has_timing_reference", "media_valid")}
    c["coverage"] = g.slide_coverage(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), F.lit(slide_w), F.lit(slide_h))
    c["target_mode"] = F.try_element_at(rel, F.lit(1))["target_mode"]
    c["has_external"] = F.exists(rel, lambda r: r["target_mode"] == "External")
    c["ambiguous"] = (F.size("blip_sources") > 1) | (F.size(rel) != 1) | ((F.size("blip_sources") == 1) & (F.try_element_at("blip_sources", F.lit(1)) != F.try_element_at(rel, F.lit(1))["id"]))
    r = F.try_element_at(rel, F.lit(1))
    c["media_present"] = (r["target_mode"] == "Internal") & r["target"].startswith("ppt/media/") & F.lower(r["content_type"]).startswith("image/") & F.col("media_sha256").isNotNull()
    return pictures.withColumn("slide_coverage", c["coverage"]).withColumn("safety_reasons", q.picture_reasons(c)).withColumn("action", F.when(F.size("safety_reasons") == 0, "candidate").otherwise("preserve"))


def slide_inventory(objs: DataFrame) -> DataFrame:
    """path, slide_ordinal, objects, candidates, types (map): a slide's totals.

    objs: objects() with `action`.
    """
    n = objs.groupBy("path", "slide_ordinal", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "candidate").alias("c"))
    return n.groupBy("path", "slide_ordinal").agg(F.sum("n").alias("objects"), F.sum("c").alias("candidates"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
