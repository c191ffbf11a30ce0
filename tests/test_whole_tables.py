"""Registered queries use every row of their tables, against plain Python."""

import pytest
from types import SimpleNamespace

from docloom import queries


def registered(monkeypatch, spark, name, **tables):
    """The rows of a registered query over the given views."""
    monkeypatch.setattr(queries, "Views", lambda *_: SimpleNamespace(**tables))
    return queries.queries()[name](spark, "").collect()


def test_page_violations_of_all_pages(spark, monkeypatch):
    pages = [0, 1, 2, 499, 500, 501, 1999, 2000, 10**6]
    boxes = [(p, p * 7 + i, 20 + 40 * ((p + i) % 4)) for p in pages for i in range(p % 3)]
    tables = {"embeddings": spark.createDataFrame([(p,) for p in pages], "vec_id long")}
    pictures = spark.createDataFrame([(p, [5] * 64, [5] * 64, [False] * 64, [False] * 64) for p in pages], "page long, px array<int>, other_px array<int>, mask array<boolean>, other_mask array<boolean>")
    got = registered(monkeypatch, spark, "page_violations", boxes=spark.createDataFrame(boxes, "page long, x long, w long"), pictures=pictures, table=tables.get)
    want = {}
    for p in pages:
        found = {("pptx_reopen_unknown", "pptx_reopen", None)[p % 3]} - {None}
        for page, x, w in boxes:
            if page == p:
                found |= set((["edge_loss"], ["duplicate_pixels", "edge_loss"], [])[x % 3]) | ({"orphan_residual"} if w >= 100 else set())
        want[p] = (",".join(sorted(found)), not found)
    assert {r.page: (r.violations, r.accepted) for r in got} == want and len(got) == len(pages)


def test_line_grouping_of_whole_texts(spark, monkeypatch):
    texts = ["a text of more than nine characters ", " " * 12 + "after blanks", "short", "   ", "ninechars", "ninechars and ten", " ünïcode in the text", ""]
    items = [(page, i, t, 10 * i, 3 * i, 20 + i, 9, 0.6 + i / 100) for page in (1, 700) for i, t in enumerate(texts[: 8 if page == 1 else 4])]
    got = registered(monkeypatch, spark, "line_grouping", text_items=spark.createDataFrame(items, "page long, ord int, text string, x int, y int, w int, h int, confidence double"))
    want = set()
    for page, line in {(r[0], r[1] // 3) for r in items}:
        own = [r for r in items if (r[0], r[1] // 3) == (page, line) and r[2].strip(" ")]
        sure = [r[7] for r in own if r[1] % 5]
        if own and sure and sum(sure) / len(sure) >= 0.5:
            x, y = min(r[3] for r in own), min(r[4] for r in own)
            size = max(r[3] + r[5] for r in own) - x, max(r[4] + r[6] for r in own) - y
            want.add((page, line, "".join(r[2].strip(" ") for r in own), x, y, *size, round(sum(sure) / len(sure), 9)))
    assert {(r.page, r.line, r.text, r.x, r.y, r.w, r.h, r.confidence) for r in got} == want and len(got) == len(want)


def test_texts_that_overlap_or_are_empty(spark):
    """Overlapping pieces count as distance 0; an empty text is part of none."""
    from docloom.operators import greedy

    row = lambda o, x, w, text: (0, o, x, 0, w, 10, text, 10.0, "#000000", False, 1.0)
    items = spark.createDataFrame([row(0, 0, 20, "a"), row(1, 17, 20, "b"), row(2, 38, 20, "c"), row(3, 500, 9, "z")], greedy.TEXT_SCHEMA)
    assert [r.text for r in greedy.merge_texts(items).collect()] == ["z", "a b c"]
    texts = [(0, 0, 0, 0, 10, 10, 1.0, "word"), (0, 1, 0, 0, 10, 10, 1.0, ""), (0, 2, 0, 0, 10, 10, 1.0, "a word here"), (0, 3, 0, 0, 10, 10, 1.0, " ")]
    boxes = spark.createDataFrame(texts, "page long, ord int, x int, y int, w int, h int, confidence double, text string")
    assert sorted(r.ord for r in greedy.deduplicate_texts(boxes).collect()) == [1, 2, 3]


def test_package_integers_and_alternatives():
    import xml.etree.ElementTree as ET

    from docloom.sources import packages as p

    assert [p._integer(v) for v in ("12", "-7", "+3", "1_000", " 7 ", "٣", "5\n", "0" * 21, "9" * 19, None, "")] == [12, -7, 3, None, None, None, None, None, None, None, None]
    uri = next(iter(p.SUPPORTED))
    tree = lambda needs, inner: ET.fromstring(f'<t xmlns:mc="{p.MC[1:-1]}" xmlns:p="{p.P[1:-1]}"><mc:AlternateContent><mc:Choice Requires="{needs}">{inner}</mc:Choice><mc:Fallback><p:pic/></mc:Fallback></mc:AlternateContent></t>')
    found = lambda needs, inner, scopes: [n.tag for n in p._children(tree(needs, inner), scopes)]
    assert found("x", "<p:sp/>", {"x": uri}) == [p.P + "sp"]
    assert found("", "<p:sp/>", {"x": uri}) == found("x y", "<p:sp/>", {"x": uri}) == [p.P + "pic"]
    with pytest.raises(ValueError):
        found("x", "", {"x": uri})


def test_paired_loads_of_lone_and_undated_events(spark):
    """As its SQL: a count is null where no row tells, and rows without a time come last."""
    from docloom.operators import aggregates

    start, finish = "model_load_start", "model_load_finish"
    rows = [("lone finish", 1, 1, finish, "success"), ("failed finish", 1, 2, finish, "error"), ("lone start", 1, 3, start, "success"), ("undated", None, 4, finish, "success"), ("undated", 1, 5, start, "success")]
    trace = spark.createDataFrame([(0, *r) for r in rows], "page long, model string, ts int, event_id long, event string, status string")
    got = {r.model: (r.loads, r.unpaired) for r in aggregates.paired_loads(trace).collect()}
    assert got == {"lone finish": (None, 1), "failed finish": (0, 1), "lone start": (0, None), "undated": (1, 0)}
