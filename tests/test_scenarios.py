"""Small scenarios with known results."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import geometry as g
from docloom.functions import quality as q
from docloom.functions import text as t
from docloom.operators import aggregates, checks, graph, greedy, joins, ranking, state

c = F.col


def one(spark, **columns):
    return spark.range(1).select(*[e.alias(n) for n, e in columns.items()]).first()


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows, start=1)], "page long, ord int, x int, y int, w int, h int")


def test_clipped_coverage(spark):
    lit = F.lit
    r = one(spark, a=g.slide_coverage(lit(-10), lit(-10), lit(100), lit(120), lit(100), lit(100)), b=g.slide_coverage(lit(0), lit(0), lit(5), lit(5), lit(0), lit(10)))
    assert r.a == 0.9 and r.b is None


def test_two_ious(spark):
    a = [F.lit(v) for v in (0.0, 0.0, 0.5, 0.5)]
    r = one(spark, floored=g.iou_floored(a, a), plain=g.iou(a, a), empty=g.iou([F.lit(0.0)] * 4, [F.lit(0.0)] * 4))
    assert (r.floored, r.plain, r.empty) == (0.25, 1.0, None)


def test_tile_origins(spark):
    rows = spark.createDataFrame([(n,) for n in (640, 641, 900, 1152)], "n int").select("n", g.tile_origins(c("n"), 640, 128).alias("o")).collect()
    assert {r.n: r.o for r in rows} == {640: [0], 641: [0, 1], 900: [0, 260], 1152: [0, 512]}


def test_halo_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(h,) for h in (1, 15, 25, 100)], "h int").select("h", g.halo(c("h")).alias("a")).collect()
    assert {r.h: r.a for r in rows} == {h: max(max(2, min(4, round(h * 0.15))), min(12, round(h * 0.30))) for h in (1, 15, 25, 100)}


def test_render_plan(spark):
    rows = [(612.0, 792.0), (100.0, 200.0), (4000.0, 4000.0), (14000.0, 20.0)]
    df = spark.createDataFrame(rows, "w double, h double")
    p = g.render_plan(c("w"), c("h"))
    for r in df.select("w", "h", p["reasons"].alias("reasons"), g.safe_scale(c("w"), c("h"), p["scale"]).alias("s")).collect():
        assert g._safe_scale(r.w, r.h, r.s) == r.s
        assert ("short_edge_floor" in r.reasons) == (min(r.w, r.h) * 200 / 72 < 1200)


def test_text_rules(spark):
    rows = [("ﬁ Straße\tX", 1), ("中文", 2)]
    df = spark.createDataFrame(rows, "s string, i int").select("i", t.compact(c("s")).alias("k"), t.normalized(c("s")).alias("n"), t.font(c("s")).alias("f"))
    got = {r.i: r for r in df.collect()}
    assert (got[1].k, got[1].n, got[2].f) == ("fistrassex", "fi strasse x", "Microsoft YaHei")
    r = one(spark, p=t.part_target(F.lit("ppt/slides/s.xml"), F.lit("../media/a.png")), u=t.part_target(F.lit("a/b"), F.lit("../../x")), s=t.similarity(F.lit("abcd"), F.lit("bcde")), v=t.version_compatible(F.lit("2.1.0rc1"), F.lit("2.1")), w=t.version_compatible(F.lit("2.1.1"), F.lit("2.1")))
    assert (r.p, r.u, r.s, r.v, r.w) == ("ppt/media/a.png", None, 0.75, False, True)


@pytest.mark.parametrize(("text", "confidence", "w", "h", "dropped"), [("---", 0.9, 90, 20, True), ("Total: 4", 0.9, 90, 20, False), ("ok", 0.6, 90, 20, True), ("l", 0.95, 10, 60, True), ("a_-b", 0.9, 90, 20, True), ("node-12", 0.9, 90, 20, False), ("ABCDE;", 0.9, 90, 20, True), ("题", 0.9, 100, 130, True), ("  ", 0.9, 9, 9, True), (":)x", 0.9, 90, 20, True)])
def test_noise(spark, text, confidence, w, h, dropped):
    assert one(spark, n=t.noise(F.lit(text), F.lit(confidence), F.lit(w), F.lit(h))).n == dropped


def test_relations_equal_boxes_overlap(spark):
    got = joins.bbox_relations(boxes(spark, [(0, 0, 10, 10), (0, 0, 10, 10), (2, 2, 3, 3), (200, 200, 5, 5), (10, 0, 5, 5)])).collect()
    assert {(r.a, r.b, r.relation) for r in got} == {(1, 2, "overlaps"), (2, 1, "overlaps"), (1, 3, "contains"), (2, 3, "contains")}


def test_pairs_come_out_once_over_many_cells(spark):
    b = boxes(spark, [(-300, -300, 900, 900), (100, 100, 600, 600), (0, 0, 128, 128)])
    p = joins.overlapping_pairs(b, b).filter("l_ord < r_ord").collect()
    assert sorted((r.l_ord, r.r_ord) for r in p) == [(1, 2), (1, 3), (2, 3)]


def proposals(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows, start=1)], "page long, ord int, x double, y double, w double, h double, score double, label string, edge boolean")


def test_proposals_nested_and_cut(spark):
    p = proposals(spark, [(10.0, 10.0, 100.0, 100.0, 0.9, "player card", False), (20.0, 20.0, 80.0, 80.0, 0.8, "person", False), (10.0, 10.0, 98.0, 100.0, 0.95, "player card", True)])
    assert sorted(r.ord for r in greedy.filter_proposals(p, 1000, 1000, 1000, 1000).collect()) == [1, 2]


def test_weak_container_around_two_people(spark):
    p = proposals(spark, [(0.0, 0.0, 100.0, 70.0, 0.9, "chart", False), (0.0, 0.0, 100.0, 100.0, 0.9, "panel", False), (10.0, 10.0, 20.0, 50.0, 0.9, "person", False), (70.0, 10.0, 20.0, 50.0, 0.9, "person", False)])
    assert sorted(r.ord for r in greedy.filter_proposals(p, 400, 400, 400, 400).collect()) == [2, 3, 4]


def test_suppressed_boxes_suppress_nobody(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, 100, 10, 0.9), (1, 2, 30, 0, 100, 10, 0.8), (1, 3, 60, 0, 100, 10, 0.7)], "page long, ord int, x int, y int, w int, h int, score double")
    assert [r.ord for r in greedy.mask_nms(rows, 0.5).orderBy("rank").collect()] == [1, 3]


def test_residual_text_is_covered(spark):
    d = spark.createDataFrame([(1, 1, 1045, 335, 416, 31)], "page long, ord int, x int, y int, w int, h int")
    item = spark.createDataFrame([(1, 1, 1047, 337, 436, 30)], "page long, ord int, x int, y int, w int, h int")
    assert joins.unowned_text_check(d, item).first().check == "pass"
    assert joins.unowned_text_check(d, item.limit(0)).first().check == "fail"


def test_contained_parents(spark):
    nodes = spark.createDataFrame([(1, 1, "parent", 0, 0, 100, 100), (1, 2, "parent", 10, 10, 50, 50), (1, 3, "child", 20, 20, 10, 10)], "page long, node long, kind string, x int, y int, w int, h int")
    assert [(r.a, r.b) for r in joins.contained_parents(nodes).collect()] == [(1, 2)]


def test_quality_key(spark):
    rows = []
    for page, largest in ((1, 119.0), (2, 120.0), (3, 121.0)):
        rows += [(page, 0, False, 120.0, 120.0, 2, 1.0, 2.0), (page, 1, False, largest, 120.0, 2, 1.0, 2.0)]
    r = spark.createDataFrame(rows, "page long, round int, accepted boolean, largest double, unexplained double, violations int, mae double, p95 double")
    assert {x.page: x.progressed for x in ranking.progress(r).filter("round = 1").collect()} == {1: True, 2: False, 3: False}


def test_decision_gate(spark):
    r = one(spark, a=q.eligible_replacement(F.lit("preserve"), F.lit("full_slide_screenshot"), F.lit(0.99)), b=q.eligible_replacement(F.lit("replace"), F.lit("full_slide_screenshot"), F.lit(0.99)))
    assert (r.a, r.b) == (False, True)


def test_trace_event_rules(spark):
    rows = [(1, "span", "ocr", None, 5), (2, "span", None, None, 5), (3, "odd", "x", None, 5), (4, "worker_start", "ocr", None, 5), (5, "span", "ocr", None, -1)]
    e = spark.createDataFrame(rows, "id int, event string, stage string, status string, duration_ms long")
    got = {(r.id, r.rule) for r in checks.trace_event_violations(e, ["id"]).collect()}
    assert got == {(2, "required_fields"), (3, "known_event"), (4, "allowed_fields"), (5, "duration_ms_range")}


def test_cycles_are_found(spark):
    n = spark.createDataFrame([(1, 1, "child", 2, "pending", 0, 0, 5, 5, 1), (1, 2, "child", 1, "pending", 0, 0, 5, 5, 2)], "page long, node long, kind string, parent long, state string, x int, y int, w int, h int, z int")
    assert {(r.rule, r.node) for r in checks.graph_violations(n).filter("rule = 'acyclic'").collect()} == {("acyclic", 1), ("acyclic", 2)}


def test_pixel_claims(spark):
    claims = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 0), (1, 2, 0, 9)], "page long, owner int, y int, x int")
    cell = lambda *rows: spark.createDataFrame(list(rows), "page long, y int, x int")
    r = aggregates.pixel_claims(claims, cell((1, 0, 0)), cell((1, 0, 1)), 4, 4).first()
    assert (r.duplicate, r.missing, r.text_duplicate, r.out_of_bounds) == (1, 1, 1, 1)


def test_execute_plan(spark):
    nodes = spark.createDataFrame([(1, i, "child", None, s, 10 * i, 0, 10, 10, i) for i, s in ((1, "pending"), (2, "pending"), (3, "frozen"), (4, "pending"))], "page long, node long, kind string, parent long, state string, x int, y int, w int, h int, z int")
    acts = spark.createDataFrame([(1, 1, "merge", 1, [1, 2]), (1, 3, "discard", 2, [3]), (1, 4, "split", 3, [4])], "page long, node long, verb string, ord int, cited array<long>")
    got = {r.node: r for r in greedy.execute_plan(nodes, acts).collect()}
    assert got[5].x == 10 and got[5].w == 20 and got[1].state == got[2].state == "inactive" and got[3].state == "frozen"
    assert got[4].state == "inactive" and (got[6].w, got[7].x) == (5, 45)


def test_families_in_a_plan(spark):
    rows = [(1, 1, "parent", None, "inactive", 10, 10, 10, 10, 1), (1, 2, "child", 1, "pending", 0, 0, 5, 5, 2), (1, 3, "child", 1, "pending", 30, 30, 5, 5, 3), (2, 1, "parent", None, "pending", 10, 10, 10, 10, 1), (2, 2, "child", 1, "pending", 0, 0, 5, 5, 2), (2, 3, "text", None, "pending", 0, 0, 5, 5, 3)]
    nodes = spark.createDataFrame(rows, "page long, node long, kind string, parent long, state string, x int, y int, w int, h int, z int")
    acts = spark.createDataFrame([(1, 2, "collapse_to_parent", 1, [2]), (1, 3, "accept", 2, [3]), (2, 1, "attach_text", 1, [1, 3]), (2, 1, "absorb_into_parent", 2, [1, 2])], "page long, node long, verb string, ord int, cited array<long>")
    got = {(r.page, r.node): r for r in greedy.execute_plan(nodes, acts).collect()}
    assert [got[1, i].state for i in (1, 2, 3)] == ["pending", "inactive", "inactive"]
    assert got[2, 3].parent == 1 and got[2, 2].state == "inactive" and (got[2, 1].x, got[2, 1].w) == (0, 20) and got[2, 1].parent is None


def test_merge_texts_puts_no_blank_between_cjk(spark):
    rows = [(1, 0, 0, 0, 20, 20, "中", 12.0, "#000000", False, 0.9), (1, 1, 22, 0, 20, 20, "文", 12.0, "#000000", False, 0.8), (1, 2, 44, 0, 20, 20, "ok", 12.0, "#010000", False, 0.7)]
    got = greedy.merge_texts(spark.createDataFrame(rows, greedy.TEXT_SCHEMA)).collect()
    assert [(r.text, r.w, r.confidence) for r in got] == [("中文 ok", 64, 0.7)]


def test_delta_scope_gives_up_on_wide_changes(spark):
    nodes = spark.createDataFrame([(1, i, None if i == 1 else 1, 10 * i, 0, 8, 8) for i in range(1, 6)] + [(2, 1, None, 0, 0, 5, 5)], "page long, node long, parent long, x int, y int, w int, h int")
    change = spark.createDataFrame([(1, 10, 0, 4, 4)], "page long, x int, y int, w int, h int")
    assert {r.node for r in graph.delta_scope(nodes, change, 1).collect()} == {1, 2, 3, 4, 5}
    assert [r.node for r in graph.delta_scope(nodes, change, 1, most=2).collect()] == [None]


def test_replay_skips_illegal_targets(spark):
    log = spark.createDataFrame([(1, 1, "analyzed"), (1, 2, "replaced"), (1, 3, "processing"), (1, 4, "validated"), (1, 5, "replaced"), (1, 6, "pending")], "page long, seq int, state string")
    r = state.replay(log, state.PAGE_EDGES, "pending").first()
    assert (r.state, r.applied, r.rejected) == ("replaced", 4, 2)


def test_parent_fallback_and_records(spark):
    expected = spark.createDataFrame([(1, [1, 2]), (2, [5])], "page long, parents array<long>")
    reports = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 5, False)], "page long, node long, accepted boolean")
    assert {r.page: r.phase for r in state.parent_fallback(reports, expected).collect()} == {1: "ready_for_assembly", 2: "preserved_with_warning"}
    assert joins.carried_parent_pairs(expected).count() == 0


def test_empty_tables(spark):
    b = boxes(spark, [(0, 0, 1, 1)]).limit(0)
    assert joins.bbox_relations(b).count() == 0 and joins.uncovered(b, b).count() == 0 and joins.best_owner(b, b).count() == 0
    assert graph.descendants(spark.createDataFrame([], "page long, node long, parent long"), spark.createDataFrame([], "page long, node long")).count() == 0
