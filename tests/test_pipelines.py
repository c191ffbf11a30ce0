"""Pipelines with stand-in models, and kernels that have no query."""

import numpy as np
from pyspark.sql import functions as F

from docloom import kernels as k
from docloom.operators import greedy
from docloom.plans import pipelines
from tests.test_rasters_files_streams import flood


def test_region_table_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rng = np.random.default_rng(4)
        masks = {p: rng.random((9, 13)) < 0.4 for p in range(12)}
        rows = [(p, int(y), int(x), bool(v)) for p, m in masks.items() for (y, x), v in np.ndenumerate(m)]
        cells = spark.createDataFrame(rows, "page long, y int, x int, mask boolean").repartition(5)
        got = {}
        for r in k.region_table(cells).collect():
            got.setdefault(r.page, []).append((r.ord, r.pixels, r.x, r.y, r.w, r.h))
        for p, m in masks.items():
            lab = flood(m)
            want = []
            for i in range(1, lab.max() + 1):
                ys, xs = np.nonzero(lab == i)
                want.append((i, len(ys), xs.min(), ys.min(), xs.max() - xs.min() + 1, ys.max() - ys.min() + 1))
            assert sorted(got[p]) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_text_kernels():
    gray = np.full((20, 40), 230)
    gray[6:14, 5:35] = 30
    gray[5, 5:35] = 150  # a soft edge
    ink = k.text_ink(gray)
    assert ink[7, 10] and not ink[0, 0] and not k.text_ink(np.full((9, 9), 7)).any()
    assert k.soften_edges(gray, ink)[5, 10] and k.bold(ink) and not k.bold(np.zeros((5, 5), bool))
    rgb = np.repeat(gray[..., None], 3, axis=2)
    assert k.sample_color(rgb).tolist() == [30.0] * 3
    alpha = k.soft_alpha(ink)
    assert alpha[9, 20] == 255 and 0 < alpha[ink][0] < 255 and alpha[0, 0] == 0


def test_background_kernels():
    img = np.full((30, 40, 3), 240, np.uint8)
    img[10:20, 10:30] = (200, 20, 20)
    none = np.zeros((30, 40), bool)
    color, spread, near = k.border_color(img, none)
    assert color.tolist() == [240.0] * 3 and spread == 0 and near[0, 0] and not near[15, 15]
    box = np.zeros((30, 40), bool)
    box[10:20, 10:30] = True
    assert k.ring_median(img, box, np.zeros(3)).tolist() == [240.0] * 3
    assert k.ring_median(img, ~none, np.full(3, 9.0)).tolist() == [9.0] * 3
    assert np.allclose(k.smooth_background(img, color, near), 240)
    assert (k.foreground(img, np.full_like(img, 240), none) == box).all()
    assert k.needs_large_inpaint(box) and not k.needs_large_inpaint(none)
    assert k.remove_noise(box).sum() == box.sum() and not k.remove_noise(np.eye(10, dtype=bool)).any()


def test_recognition_and_masks(spark):
    pages = spark.createDataFrame([(1, 4, 5, bytearray(60)), (2, 4, 5, bytearray(60))], "page long, height int, width int, rgb binary")
    item = {"x": 0, "y": 0, "w": 40, "h": 20, "text": "Hello", "font_size": 12.0, "color": "#000000", "bold": False, "confidence": 0.9}
    got = pipelines.recognise(pages, lambda: lambda rows: [[item, item | {"x": 42, "text": "you"}] for _ in rows], "t_ocr")
    lines = pipelines.text_items(got, 100).orderBy("page").collect()
    assert [(r.page, r.text, r.font) for r in lines] == [(1, "Hello you", "Arial"), (2, "Hello you", "Arial")]
    crops = spark.createDataFrame([(1, 0, 90, 10), (1, 1, 10, 10)], "page long, ord int, w int, h int")
    read = pipelines.recognise_crops(crops, lambda: lambda rows: [(str(r["w"]), 1.0) for r in rows], "t_rec").collect()
    assert {r.ord: r.text for r in read} == {0: "90", 1: "10"}
    prompts = spark.createDataFrame([(1, 0, 0, 0, 2, 2), (1, 1, 1, 1, 2, 2)], "page long, ord int, x int, y int, w int, h int")
    masks = pipelines.prompted_masks(pages, prompts, lambda: lambda img, boxes: [(np.ones(img.shape[:2], bool), b[0] / 10) for b in boxes], "t_prompt").orderBy("ord").collect()
    assert [(r.page, r.score) for r in masks] == [(1, 0.0), (1, 0.1)]
    tiles = pipelines.tiles(spark.createDataFrame([(1, 100, 80)], "page long, width int, height int"), 64, 16)
    found = pipelines.mask_candidates(tiles, lambda: lambda rows: [[(np.ones((2, 2), bool), 0.9, 0.8)] for _ in rows], "t_masks").collect()
    assert len(found) == 4 and {r.score for r in found} == {0.8}


def test_repair_rounds_end_when_nothing_is_open(spark):
    nodes = spark.createDataFrame([(1, 1, "child", None, "pending", 0, 0, 9, 9, 1), (1, 2, "child", None, "pending", 20, 0, 9, 9, 2)], "page long, node long, kind string, parent long, state string, x int, y int, w int, h int, z int")
    rounds = []

    def planner(n, i):
        rounds.append(i)
        return n.filter(f"node = {i}").select("page", "node", F.lit("accept").alias("verb"), F.lit(0.9).alias("score"), F.lit(1).alias("ord"), F.array("node").alias("cited"))

    def judge(n):
        return n.filter("state = 'frozen'").select("page", "node", F.lit(True).alias("accepted"))

    done = pipelines.repair(nodes, planner, judge)
    assert rounds == [1, 2] and {r.state for r in done.collect()} == {"frozen"}
    bad = nodes.select("page", "node", F.lit("explode").alias("verb"), F.lit(0.9).alias("score"), F.lit(1).alias("ord"), F.array("node").alias("cited"))
    _, refused = pipelines.repair_round(nodes, bad, judge(nodes))
    assert {r.rule for r in refused.collect()} >= {"verb"}


def test_known_duplicates_are_dropped(spark):
    names = [f.split()[0] for f in greedy.TEXT_SCHEMA.split(", ")]
    row = lambda o, text: dict(zip(names, (1, o, 0, 0, 90, 20, text, 12.0, "#000000", False, 0.9), strict=True))
    items = spark.createDataFrame([row(1, "Grand total 2024"), row(2, "else")], greedy.TEXT_SCHEMA)
    known = spark.createDataFrame([row(1, "ＧＲＡＮＤ total 2024")], greedy.TEXT_SCHEMA)
    assert [r.ord for r in pipelines.duplicates_of_known(items, known).collect()] == [2]
