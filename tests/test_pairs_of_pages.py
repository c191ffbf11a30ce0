"""Walks over pruned pairs against all pairs of a page in plain Python."""

import random

from docloom.operators import greedy

WORDS = ["中文 ok", "ok", "a", "", "a b", "Grand", "12", "中", "grand total"]


def both(a, b):
    wide = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    tall = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    return max(wide, 0) * max(tall, 0)


def iou(a, b):
    return both(a, b) / max(a["w"] * a["h"] + b["w"] * b["h"] - both(a, b), 1)


def pages(spark, schema, make, n=12, rows=25):
    r = random.Random(3)
    items = [(p, o, *make(r)) for p in range(n) for o in range(rows)]
    names = [f.split()[0] for f in schema.split(", ")]
    dicts = [dict(zip(names, i, strict=True)) for i in items]
    return spark.createDataFrame(items, schema), [[d for d in dicts if d["page"] == p] for p in range(n)]


def texts(spark):
    make = lambda r: (r.randrange(150), r.randrange(60), r.randrange(40), r.randrange(24), r.choice(WORDS), float(r.choice([10, 12, 20])), r.choice(["#000000", "#0a0a0a", "#ff0000", "red"]), r.random() < 0.2, r.choice([0.5, 0.7, 0.9]))
    return pages(spark, greedy.TEXT_SCHEMA, make)


def test_masks_and_proposals_by_all_pairs(spark):
    make = lambda r: (float(r.randrange(-9, 40)), float(r.randrange(-9, 40)), r.choice([20.0, 21.0, 90.5]), r.choice([20.0, 21.0]), r.choice([0.5, 0.7]), r.choice(["person", "red car", "blue car", "chart", "card", "player card"]), r.random() < 0.3)
    df, by = pages(spark, "page long, ord int, x double, y double, w double, h double, score double, label string, edge boolean", make)

    def walk(rows, order, clash):
        kept = []
        for r in sorted(rows, key=order):
            if not any(clash(r, k) for k in kept):
                kept.append(r)
        return kept

    want = {(k["page"], k["ord"], i) for rows in by for i, k in enumerate(walk(rows, lambda r: (-r["score"], r["ord"]), lambda a, b: iou(a, b) >= 0.5), start=1)}
    assert {tuple(r) for r in greedy.mask_nms(df, 0.5).collect()} == want

    role = lambda r: {"person": "person", "chart": "container", "card": "container", "player card": "mixed"}.get(r["label"], "object")
    size = lambda r: r["w"] * r["h"]
    like = lambda a, b: role(a) == role(b) and min(size(a), size(b)) / max(size(a), size(b)) >= 0.85 and iou(a, b) >= 0.75
    holds = lambda c, p: 0 <= p["x"] + p["w"] / 2 - c["x"] <= c["w"] and 0 <= p["y"] + p["h"] / 2 - c["y"] <= c["h"]
    want, dropped = set(), 0
    for rows in by:
        kept = walk(rows, lambda r: (r["edge"], -r["score"], r["ord"]), like)
        for k in kept:
            inside = [p for p in kept if p["label"] == "person" and holds(k, p)] if k["label"] == "chart" else []
            apart = any(iou(p, q) <= 0.05 for i, p in enumerate(inside) for q in inside[:i])
            dropped += apart
            want |= set() if apart else {(k["page"], k["ord"])}
    assert {tuple(r) for r in greedy.filter_proposals(df, 900, 900, 900, 900).collect()} == want and dropped and len(want) < 300 - dropped


def test_texts_by_all_pairs(spark):
    df, by = texts(spark)
    compact = lambda r: "".join(r["text"].casefold().split())
    want = set()
    for rows in by:
        kept = []
        for r in rows:
            a = compact(r)
            clashes = [i for i, k in enumerate(kept) if a and compact(k) and (a in compact(k) or compact(k) in a) and both(r, k) / max(1, min(r["w"] * r["h"], k["w"] * k["h"])) >= 0.8]
            if not clashes:
                kept.append(r)
            elif (len(a), r["confidence"]) > (len(compact(kept[clashes[0]])), kept[clashes[0]]["confidence"]):
                kept[clashes[0]] = r
        want |= {(k["page"], k["ord"]) for k in kept}
    assert {tuple(r) for r in greedy.deduplicate_texts(df).collect()} == want and len(want) < 300


def test_merged_texts_are_closed_and_lose_nothing(spark):
    """No pair that may still be merged is left, and all texts are in the merged ones."""
    df, by = texts(spark)
    got = [r.asDict() for r in greedy.merge_texts(df).collect()]
    assert len(got) < sum(map(len, by))
    for rows in by:
        out = [dict(g, rgb=None if g["color"] == "red" else bytes.fromhex(g["color"][1:])) for g in got if g["page"] == rows[0]["page"]]
        assert all(greedy._gap_on_a_line(a, b) is None for a in out for b in out if a is not b)
        letters = lambda items: sorted(c for r in items for c in r["text"] if c != " ")
        assert letters(out) == letters(rows)


def test_only_clashing_proposals_are_walked(spark, monkeypatch):
    walked = []
    by_page = greedy.by_page
    monkeypatch.setattr(greedy, "by_page", lambda df, *a: walked.append(df) or by_page(df, *a))
    rows = [(0, i, 40 * i, 0, 30, 30, 0.5, "logo", False) for i in range(50)] + [(0, 50, 0, 0, 30, 30, 0.9, "logo", False), (0, 51, 40, 0, 30, 30, 0.9, "chart", False)]
    df = spark.createDataFrame(rows, "page long, ord int, x int, y int, w int, h int, score double, label string, edge boolean")
    assert {r.ord for r in greedy.filter_proposals(df, 9000, 9000, 900, 900).collect()} == set(range(1, 52))
    assert sum(d.count() for d in walked) == 1
