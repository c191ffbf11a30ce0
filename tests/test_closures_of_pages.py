"""Closures and labels by page: against plain Python, and without what grew faster than their input."""

import random

from docloom import queries
from docloom.operators import graph


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_of_whole_boxes(spark, monkeypatch):
    rng = random.Random(3)
    texts = sorted({(p, rng.randrange(300), rng.randrange(300)) for p in (1, 2, 3) for _ in range(300)}) + [(1, 5, 5), (1, 5, 5)]
    boxes = [(p, i, rng.randrange(280), rng.randrange(280), rng.randrange(0, 90), rng.randrange(1, 90)) for p in (1, 2, 4) for i in range(12)]
    t = spark.createDataFrame(texts, "page long, y int, x int")
    b = spark.createDataFrame(boxes, "page long, ord int, x int, y int, w int, h int")
    got = sorted(tuple(-1 if v is None else v for v in (r.page, r.y, r.x, r.label)) for r in graph.box_labels(t, b).collect())
    first = lambda p, y, x: min((o for q, o, u, v, w, h in boxes if q == p and u <= x < u + w and v <= y < v + h), default=-1)
    assert got == sorted((p, y, x, first(p, y, x)) for p, y, x in texts)
    spread = []
    monkeypatch.setattr(graph, "box_cells", lambda *a: spread.append(a))
    for name in ("text_region_labels", "largest_text_region"):
        queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert not spread


def test_scope_against_plain_python(spark):
    rng = random.Random(4)
    nodes = [(p, 100 * p + i, 100 * p + rng.randrange(i) if i and i % 3 == 0 else None, rng.randrange(400), rng.randrange(400), rng.choice([0, 5, 30]), rng.choice([5, 5, 30])) for p in range(1, 13) for i in range(25)]
    changed = [(p, 100, 100, 60, 60) for p in range(2, 13)] + [(2, 300, 300, 20, 20)]
    meet = lambda a, b: all(max(a[i], b[i]) < min(a[i] + a[i + 2], b[i] + b[i + 2]) for i in (0, 1))
    for reach, most in ((3, 6), (0, 4), (20, 64)):
        want = set()
        for p in range(1, 13):
            own = {n[1]: n[3:] for n in nodes if n[0] == p}
            wide = {n: (x - reach, y - reach, w + 2 * reach, h + 2 * reach) for n, (x, y, w, h) in own.items()}
            links = {(a, b) for a in own for b in own if a != b and meet(wide[a], own[b])} | {e for n in nodes if n[0] == p and n[2] is not None for e in ((n[1], n[2]), (n[2], n[1]))}
            found = {n for n in own if any(meet(wide[n], c[1:]) for c in changed if c[0] == p)}
            while more := {b for a, b in links if a in found} - found:
                found |= more
            want |= {(p, n) for n in found} if len(found) <= most else {(p, None)}
        scope = graph.delta_scope(spark.createDataFrame(nodes, "page long, node long, parent long, x int, y int, w int, h int"), spark.createDataFrame(changed, "page long, x int, y int, w int, h int"), reach, most)
        got = [(r.page, r.node) for r in scope.collect()]
        assert set(got) == want and len(got) == len(want)
    assert plan(scope).count("MapInPandas") == 1 and "Aggregate" not in plan(scope)  # one walk; links go to it as they are


def test_related_without_listed_pairs(spark):
    nodes = [(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 2), (1, 6, 4), (1, 7, None), (2, 1, 2), (2, 2, 1), (2, 3, 1), (3, 5, 5), (3, 6, None)]
    df = spark.createDataFrame(nodes, "page long, node long, parent long")
    ids = df.select("page", "node")
    pairs = ids.withColumnRenamed("node", "source").join(ids.withColumnRenamed("node", "target"), "page").filter("source <> target")
    row = lambda d: sorted((r.page, r.target, r.source) for r in d.collect())
    assert row(graph.related_inactive(None, df)) == row(graph.related_inactive(pairs, df)) != []
    assert "Join" not in plan(queries.queries()["related_inactive"](spark, "/root/testdata/sf0.001"))
