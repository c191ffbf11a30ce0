import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import kernels as k
from docloom.plans import pipelines
from docloom.sinks import writers
from docloom.sources import files, packages
from docloom.streaming import trace


def flood(mask):
    """Plain labelling, 8-connected, in scan order."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


def test_labels_against_flood_fill():
    rng = np.random.default_rng(0)
    for p in (0.3, 0.45, 0.6):
        m = rng.random((20, 17)) < p
        assert (k.label(m) == flood(m)).all()
        assert k.largest_region(m) == np.bincount(flood(m).ravel())[1:].max()
    assert k.label(np.zeros((3, 3), bool)).max() == 0


def test_distance_against_brute_force():
    m = np.random.default_rng(1).random((9, 11)) < 0.7
    out = np.argwhere(~m)
    d = k.distance(m)
    for y, x in np.argwhere(m):
        assert d[y, x] == pytest.approx(np.sqrt(((out - [y, x]) ** 2).sum(axis=1)).min())


def test_morphology_and_holes():
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert k.enclosed_holes(ring).sum() == 1 and k.has_hole(ring)
    ring[2, 2] = ring[1, 1] = False  # a diagonal gap opens it
    assert not k.has_hole(ring)
    dot = np.zeros((5, 5), bool)
    dot[2, 2] = True
    assert k.dilate(dot, 1).sum() == 9 and k.erode(k.dilate(dot, 1), 1).sum() == 1 and k.close(dot, 1).sum() == 1
    assert k.silhouette(k.dilate(dot, 1) & ~dot).sum() == 9


def test_mask_records():
    m = np.random.default_rng(2).random((5, 7)) < 0.5
    assert (k.unpack_mask(k.pack_mask(m), (5, 7)) == m).all()
    for bad in ({"height": 5, "width": 8, "data": k.pack_mask(m)["data"]}, k.pack_mask(m) | {"data": "AA=="}):
        with pytest.raises(ValueError):
            k.unpack_mask(bad, (5, 7))


def test_ownership_by_depth():
    panel, icon = np.zeros((12, 16), bool), np.zeros((12, 16), bool)
    panel[1:11, 1:15], icon[4:8, 5:9] = True, True
    own = k.own_pixels([panel, icon], [1, 2])
    assert (own[1] == icon).all() and not (own[0] & own[1]).any() and ((own[0] | own[1]) == panel).all()


def test_fills_keep_what_is_outside():
    img = np.tile(np.linspace(0, 255, 20).astype(np.uint8)[None, :, None], (10, 1, 3))
    hole = np.zeros((10, 20), bool)
    hole[3:6, 8:12] = True
    for new in (k.diffuse(img, hole), k.fill_from_nearest(img, hole)):
        assert (new[~hole] == img[~hole]).all()
    assert np.abs(k.interpolate_masked(img, hole)[hole] - img[hole]).max() < 1
    assert np.abs(k.fit_plane(img, ~hole) - img).max() < 1
    assert (k.gradient(np.array([[0] * 3, [9] * 3, [0] * 3, [9] * 3]), 10, 4)[:, -1] == 9).all()


def test_shapes():
    yy, xx = np.mgrid[:40, :60]
    ellipse = ((xx - 30) / 25) ** 2 + ((yy - 20) / 15) ** 2 <= 1
    box = np.zeros((40, 60), bool)
    box[5:35, 8:50] = True
    assert k.best_shape(ellipse)[0] == "ellipse" and k.best_shape(box)[0] in ("rectangle", "rounded")
    assert k.best_shape(np.zeros((3, 3), bool)) is None


def test_compose_and_seams():
    base = np.zeros((4, 4, 3), np.uint8)
    layer = np.full((2, 2, 4), 200, np.uint8)
    layer[..., 3] = 255
    out = k.over(base, [(1, 1, layer), (3, 3, layer)])
    assert (out[1:3, 1:3] == 200).all() and (out[3, 3] == 200).all() and out[0, 0, 0] == 0
    flat = np.full((8, 8, 3), 50, np.uint8)
    assert k.seam_passes(flat, flat[0], flat[0], flat, flat) and not k.seam_passes(flat, flat[0] + 100, flat[0], flat, flat)
    wide = k.extend_canvas(flat, 16, 9)
    assert wide.shape == (9, 16, 3) and (wide[0:8, 4:12] == 50).all() and k.cover(flat, 16, 9).shape == (9, 16, 3)


def png(color, size=2):
    raw = b"".join(b"\0" + bytes(color) * size for _ in range(size))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


ITEM = "deck slide ord kind left top width height png shape text font font_size bold align color name".split()


def deck(spark):
    full = ("d", 1, 0, "picture", 0.0, 0.0, 13.333, 7.5, png((9, 8, 7)), None, None, None, None, None, None, None, "shot")
    rows = [full, ("d", 1, 1, "text", 1.0, 1.0, 2.0, 0.5, None, None, "a < b & c", "Arial", 18.0, True, 1, "#102030", "t"), ("d", 2, 0, "shape", 1.0, 1.0, 1.0, 1.0, None, "ellipse", None, None, None, None, None, "#ff0000", "s")]
    return writers.assemble(spark.createDataFrame(rows, writers.ITEMS), 13.333, 7.5)


def test_package_round_trip(spark, tmp_path):
    raw = bytes(deck(spark).first().package)
    (tmp_path / "d.pptx").write_bytes(raw)
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    got = packages.packages(spark, str(tmp_path))
    objs = packages.objects(got)
    assert [r.problem for r in objs.filter("problem is not null").collect()] == ["BadZipFile"]
    rows = objs.filter("problem is null").orderBy("slide_ordinal", "ordinal").collect()
    assert [(r.slide_ordinal, r.type, r.name) for r in rows] == [(0, "picture", "shot"), (0, "text", "t"), (1, "autoshape", "s")]
    w, h = round(13.333 * 914400), round(7.5 * 914400)
    safe = packages.safety(objs.filter("type = 'picture'"), w, h).first()
    assert safe.action == "candidate" and safe.slide_coverage == 1.0 and safe.safety_reasons == []
    inv = packages.slide_inventory(packages.safety(objs.filter("problem is null"), w, h)).orderBy("slide_ordinal").collect()
    assert [(r.objects, r.candidates) for r in inv] == [(2, 1), (1, 0)]
    members = packages.parts(got)
    bad = {r.path.rsplit("/", 1)[1]: r.violations for r in packages.package_violations(members).collect()}
    assert bad == {"d.pptx": [], "bad.pptx": ["not_a_package"]}


def test_groups_and_alternatives(spark, tmp_path):
    raw = bytes(deck(spark).first().package)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as src, zipfile.ZipFile(out, "w") as dst:
        for i in src.infolist():
            data = src.read(i)
            if i.filename == "ppt/slides/slide2.xml":
                sp = '<p:sp><p:nvSpPr><p:cNvPr id="{}" name="n"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr/></p:sp>'
                alt = f'<mc:AlternateContent xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:zz="urn:none"><mc:Choice Requires="zz">{sp.format(50)}</mc:Choice><mc:Fallback>{sp.format(51)}</mc:Fallback></mc:AlternateContent>'
                group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="40" name="g"/></p:nvGrpSpPr><p:grpSpPr/>{sp.format(41)}</p:grpSp>'
                data = data.replace(b"</p:spTree>", (group + alt + "</p:spTree>").encode())
            dst.writestr(i.filename, data)
    (tmp_path / "g.pptx").write_bytes(out.getvalue())
    rows = packages.objects(packages.packages(spark, str(tmp_path))).filter("slide_ordinal = 1").orderBy("ordinal").collect()
    assert [(r.shape_id, r.type, r.group_path) for r in rows][1:] == [("40", "group", []), ("41", "autoshape", ["40"]), ("51", "autoshape", [])]
    assert not rows[1].transform_reliable


def test_image_files(spark, tmp_path):
    for name, color in (("b.PNG", (1, 2, 3)), ("A.png", (4, 5, 6)), ("x.txt", (0, 0, 0))):
        (tmp_path / name).write_bytes(png(color))
    got = files.images(spark, [str(tmp_path)]).orderBy("ordinal").collect()
    assert [(r.page_id, r.path.rsplit("/", 1)[1]) for r in got] == [("page_001", "A.png"), ("page_002", "b.PNG")]
    rgb = {r.path.rsplit("/", 1)[1]: bytes(r.rgb)[:3] for r in files.pictures(spark, str(tmp_path / "A.png")).collect()}
    assert rgb == {"A.png": bytes((4, 5, 6))}
    assert {r.problem for r in files.file_hashes(spark, str(tmp_path / "*.png"), 10).collect()} == {"too_large"}


def test_trace_lines(spark, tmp_path):
    lines = ['{"schema_version":1,"event":"span","stage":"ocr","duration_ms":5}', "not json", '{"schema_version":2,"event":"span"}', '{"schema_version":1,"event":"span","odd":1}', '{"schema_version":1,"event":"span","stage":"' + "x" * 20_000 + '"}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n")
    got = [r.problem for r in files.trace_lines(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([None, "not_an_event", "schema_version", "unknown_field", "too_long"], key=str)
    (tmp_path / "c.json").write_text('{"models": [{"model_id": "a", "priority": 2}]}')
    assert files.model_catalog(spark, str(tmp_path / "c.json")).first().model_id == "a"
    assert files.json_documents(spark, str(tmp_path / "c.json")).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "b int, a string")
    writers.write_json(df, str(tmp_path / "j"))
    assert "".join(p.read_text() for p in (tmp_path / "j").iterdir() if p.name.startswith("part")).strip() == '{"a":"a","b":1}'
    writers.publish(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="already exists"):
        writers.publish(df, str(tmp_path / "p"))
    e = spark.createDataFrame([("span", "ocr", 5)], "event string, stage string, duration_ms long")
    writers.append_trace(e, str(tmp_path / "t"))
    writers.append_trace(e, str(tmp_path / "t"))
    assert files.trace_lines(spark, str(tmp_path / "t")).filter("problem is null").count() == 2
    with pytest.raises(ValueError, match="rule"):
        writers.append_trace(e.withColumn("event", F.lit("odd")), str(tmp_path / "t"))
    writers.write_components(spark.createDataFrame([(70, "c")], "page long, name string"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first().bucket == 6


def test_detector_tiles(spark):
    pages = spark.createDataFrame([(1, 900, 900)], "page long, width int, height int")
    found = pipelines.object_proposals(pages, lambda: lambda tiles: [[(10.0, 10.0, 40.0, 40.0, 0.9, "logo")] for _ in tiles], 640, 128, 900, 900).collect()
    assert len(found) == 4 and any(r.x >= 140 and r.y >= 140 for r in found)


def test_models_in_batches(spark):
    raster = np.zeros((5, 6, 3), np.uint8)
    mask = np.zeros((5, 6), bool)
    mask[1:3, 1:3] = True
    pages = spark.createDataFrame([(1, 5, 6, bytearray(raster.tobytes()), bytearray(np.packbits(mask).tobytes()))], "page long, height int, width int, rgb binary, mask binary")
    new = np.frombuffer(pipelines.inpaint(pages, lambda: lambda img, m: np.full_like(img, 7), "test_fill").first().rgb, np.uint8).reshape(5, 6, 3)
    assert (new[mask] == 7).all() and (new[~mask] == 0).all()

    def client():
        def ask(prompt):
            if "bad" in prompt:
                raise TimeoutError
            return prompt.upper()

        return ask

    got = pipelines.complete(spark.createDataFrame([(1, "ok"), (2, "bad")], "page long, prompt string"), client, "test_chat").orderBy("page").collect()
    assert [(r.response, r.status) for r in got] == [("OK", "success"), ("TimeoutError", "error")]


def test_streams(spark, tmp_path):
    rows = [("span", "a", 10, "2024-01-01 00:01:00"), ("span", "a", 20, "2024-01-01 00:30:00"), ("worker", "b", 5, "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "event string, stage string, duration_ms long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.json(str(tmp_path / "in"))
    got = trace.run_to_memory(trace.windowed_rollup(trace.read_trace(spark, str(tmp_path / "in"))), "rollup").collect()
    assert [(r.event, r.runs, r.duration_ms) for r in got] == [("span", 2, 30)]  # the last window is still open
    log = spark.createDataFrame([(1, 1, "processing"), (1, 2, "validated"), (1, 3, "pending"), (2, 1, "replaced")], "page long, seq int, state string")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    got = {r.page: (r.state, r.applied, r.rejected) for r in trace.run_to_memory(trace.page_states(stream), "states", "update").collect()}
    assert got == {1: ("validated", 2, 1), 2: ("pending", 0, 1)}
