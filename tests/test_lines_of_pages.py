"""Lines of text, which are wide and flat, cross the shuffles once or twice with their texts."""

import difflib
import random

import pytest

from docloom.operators import greedy, joins
from docloom.plans import pipelines

SCHEMA = "page long, ord int, x int, y int, w int, h int, confidence double, text string"


def lines(n, odd):
    rng = random.Random(odd)
    words = ["overhead", "overhead wire", "overhead wires", "wire", "ein langer Satz mit Wörtern", "ein langer Satz mit Worten"]
    return [(page, 2 * i + odd, rng.randrange(-60, 2300), rng.randrange(0, 300), rng.choice([200, 900, 905, 2100]), rng.choice([30, 31, 40]), 0.9, rng.choice(words)) for page in (1, 2) for i in range(n)]


def test_pairs_of_lines_by_all_pairs(spark):
    left, right = lines(60, 1), lines(60, 0)
    got = joins.overlapping_pairs(*(spark.createDataFrame(r, SCHEMA) for r in (left, right)), cell=joins.LINE_CELL).select("page", "l_ord", "r_ord").collect()
    meet = lambda a, b: a[0] == b[0] and all(max(a[i], b[i]) < min(a[i] + a[i + 2], b[i] + b[i + 2]) for i in (2, 3))
    want = [(a[0], a[1], b[1]) for a in left for b in right if meet(a, b)]
    assert sorted(tuple(r) for r in got) == sorted(want) and want


@pytest.mark.parametrize("name", ["known_text", "known_text_similar", "two_views", "deduplicate_texts", "clean_icons"])
def test_lines_are_dealt_to_few_cells(spark, monkeypatch, name):
    seen = []
    cells = joins._cells
    monkeypatch.setattr(joins, "_cells", lambda df, *a: seen.append((df, cells(df, *a))) or seen[-1][1])
    a, b = (spark.createDataFrame([(0, 2 * i + odd, 37 * i % 700, 24 * i, 900, 60, 0.9, f"text {i}") for i in range(40)], SCHEMA) for odd in (1, 0))
    {"known_text": lambda: joins.known_text(a, b, True), "known_text_similar": lambda: joins.known_text(a, b), "two_views": lambda: greedy.two_views(a, b), "deduplicate_texts": lambda: greedy.deduplicate_texts(a), "clean_icons": lambda: pipelines.clean_icons(a)}[name]()
    assert len(seen) == 2 and all(dealt.count() <= 2 * df.count() for df, dealt in seen)


def test_similar_texts_are_paired_once(spark):
    """One pass: a join of pairs for the sure ones and another for the likely ones doubles the shuffles."""
    words = ["overhead", "overhead wire", "overhead wires", "wire", "ein langer Satz mit Wörtern", "ein langer Satz mit Worten", "ein langer Satz", "dass ein Satz mit Worten lang", ""]
    rng = random.Random(5)
    rows = lambda odd: [(0, 2 * i + odd, 10 + rng.randrange(12), 40 * (i % 20), rng.choice([100, 110, 130]), rng.choice([30, 31]), 0.9, rng.choice(words)) for i in range(60)]
    left, right = rows(1), rows(0)
    found = joins.known_text(*(spark.createDataFrame(r, SCHEMA) for r in (left, right)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1

    def matches(a, b):
        (x, y, w, h), (u, v, p, q) = a[2:6], b[2:6]
        over = max(0, min(x + w, u + p) - max(x, u)) * max(0, min(y + h, v + q) - max(y, v)) / min(w * h, p * q)
        s, r = (t.lower().replace(" ", "") for t in (a[7], b[7]))
        short, long = sorted((len(s), len(r)))
        if over < 0.5 or s == r:
            return over >= 0.5
        if over < 0.8 or (short >= 4 and (s in r or r in s)):
            return over >= 0.8
        near = min(w, p) / max(w, p) >= 0.75 and min(h, q) / max(h, q) >= 0.7 and abs(x + w / 2 - u - p / 2) <= max(w, p) * 0.2 and abs(y + h / 2 - v - q / 2) <= max(h, q) * 0.25
        ratio = difflib.SequenceMatcher(None, s, r).ratio()
        return near and (ratio >= 0.88 or (long >= 20 and short / long <= 0.75 and ratio >= 0.5))

    want = {(0, a[1]) for a in left if any(matches(a, b) for b in right)}
    assert {tuple(r) for r in found.collect()} == want and len(want) < len(left)
    assert want > {tuple(r) for r in joins.known_text(*(spark.createDataFrame(r, SCHEMA) for r in (left, right)), True).collect()}
