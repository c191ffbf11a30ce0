import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import near_dup, suffix_dedup
from docloom.llm.common import Workspace
from docloom.llm.components import components

DOCS = "doc_id long, text string, label int, k1 string, c int"


def brute_classes(rows, words, num, den):
    def shingles(t):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({i: " " for i in range(9, 14)}).split(" ") if x]
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 40, 120, 300]))]
        for _ in range(rng.randint(1, 14)):
            some = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                some[rng.randrange(len(some))] = word()
            texts.append(" ".join(some))
    chain = [word() for _ in range(200)]  # neighbours are near, the ends are not
    for i in range(90):
        texts.append(" ".join(chain[: 100 + i] + [f"x{j}" for j in range(90 - i)]))
    texts += [texts[0], texts[0].upper(), "one", "One\t", "", None, "   ", "two words", "é É", "É É"]
    rng.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("words", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates_against_brute_force(spark, words, num, den):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows] + [(rows[0][0], rows[0][1], 1, "k", 2), (None, rows[0][1], 0, "", 0)], DOCS)
    want = brute_classes(rows, words, num, den)
    got = near_dup.classes(docs, words, num, den).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = near_dup.deduplicate(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), words, num, den)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_dup.classes(empty).count() == 0
    assert suffix_dedup.repeats(empty).count() == 0
    assert suffix_dedup.deduplicate(empty, length_col=None).count() == 0


def linked(spark, rows, stars, links=()):
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "id long, doc long, text string").select(F.unhex(F.md5("text")).alias("k"), "doc", "text")
    sets, ws = near_dup.Sets(3, 85, 100), Workspace(spark)
    _, nodes = near_dup._sketched(docs, sets, ws)
    nodes = nodes.withColumn("node", F.col("doc"))
    first = spark.createDataFrame(list(links), "a long, b long")
    found, _ = near_dup._second_round(spark.createDataFrame(stars, "p long, node long"), first, nodes, docs, sets, ws)
    return {tuple(sorted((r.a, r.b))) for r in found.collect()} - set(links)


def test_second_round_links_what_pivots_miss(spark):
    """A pivot that is near to nothing: what met it is settled by the cells of round two."""
    base = [f"w{i}" for i in range(100)]
    texts = {1: base[:80] + [f"p{i}" for i in range(20)], 5: base, 9: base[:97] + ["q1", "q2", "q3"]}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    assert linked(spark, rows, [(1, 5), (1, 9)]) == {(5, 9)}
    assert linked(spark, rows[:2], [(1, 5)]) == set()


def test_second_round_joins_whole_clusters(spark, monkeypatch):
    """Two clusters behind a far pivot: small cells, and all of them end as one component."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    base = [f"w{i}" for i in range(300)]
    rows = [(1, "far " * 5)] + [(10 + i, " ".join([*base[: 299 - i], f"x{i}", f"y{i}"])) for i in range(12)]
    links = [(10, 10 + i) for i in range(1, 6)] + [(16, 16 + i) for i in range(1, 6)]
    got = linked(spark, rows, [(1, 10 + i) for i in range(12)], links)
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in [*links, *got]:
        up[root(a)] = root(b)
    assert len({root(10 + i) for i in range(12)}) == 1 and len(got) < 12


REPEATED = [(1, "a b c"), (2, "x y z"), (2, "a b c"), (3, "x y z"), (4, ""), (4, "p q r"), (7, "p q r"), (9, "k l m"), (9, "k l m"), (9, "n o p"), (None, "a b c"), (8, "t u v w x y z 0 1"), (8, "far from all"), (6, "t u v w x y z 0 1"), (9, "t u v w x y z 0 1")]


def test_ids_with_several_texts(spark):
    """Rows of an id are one node of classes(); deduplicate() goes by texts and loses none."""
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in REPEATED], DOCS).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.classes(docs).collect()), key=str)
    want = [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (4, 1, 4), (7, 1, 4), (9, 1, 6), (9, 1, 6), (9, 1, 6), (8, 5, 6), (8, 1, 6), (6, 5, 6), (9, 5, 6)]
    assert got == sorted([(i, n, c, i == c) for i, n, c in want] + [(None, 1, None, True)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in near_dup.deduplicate(docs).collect()), key=str)
    assert kept == sorted([(1, "a b c"), (2, "x y z"), (4, ""), (4, "p q r"), (9, "k l m"), (9, "n o p"), (None, "a b c"), (6, "t u v w x y z 0 1"), (8, "far from all")], key=str)


def test_deduplicate_keeps_columns_with_odd_names(spark):
    rows = [(5, "t w o", {"a": 1}, 1), (3, "t w o", {"b": 2}, 2), (3, "t w o", {"b": 2}, 1), (8, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row map<string,int>, `k.doc` int")
    got = near_dup.deduplicate(docs)
    assert got.schema == docs.schema
    assert sorted((r[0], r[3]) for r in got.collect() if r[0] == 3) == [(3, 1)] and got.count() == 2


def test_likeness_estimate():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8, 0.95):
        pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
        n = int(2000 * share)
        a, b = pool[:2000], np.concatenate([pool[:n], pool[2000 : 2000 + 2000 - n]]) if n >= 1000 else np.concatenate([pool[:n], rng.integers(0, 2**63, 2000 - n).astype(np.uint64)])
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        m = 1024
        ka, kb = near_dup.registers(a, m), near_dup.registers(b, m)
        got = near_dup.likeness(np.array([(ka > kb).sum()]), np.array([(ka < kb).sum()]), m, np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - true) < 0.07
    both = np.maximum(near_dup.registers(a, 64), near_dup.registers(b, 64))
    assert (both == near_dup.registers(np.concatenate([a, b]), 64)).all()  # sketches merge by maxima


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges for n in e if root(n) != n}


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(hit)) if hit[i] and not (i and hit[i - 1]))
        out.append((len(r), sum(hit), runs, hashlib.sha256(bytes(b for b, x in zip(r, hit) if not x)).hexdigest()))
    return out


def passages():
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdé fg.\n") for _ in range(n))
    common, line = noise(420), noise(120)
    texts = [noise(rng.randint(0, 900)) for _ in range(30)]
    texts += [noise(rng.randint(0, 300)) + common[rng.randint(0, 150) :] + noise(rng.randint(0, 300)) for _ in range(25)]
    texts += [noise(90) + line + noise(90) for _ in range(25)]
    texts += ["Shti " * 300 + noise(50), noise(100) + "ab" * 700, texts[3], texts[3], texts[40] * 2, "", None, "x" * 199, "y" * 200, "z" * 201, common[:200], common[100:299]]
    return texts


@pytest.mark.parametrize("hot", [256, 3])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = passages()
    docs = spark.createDataFrame([(i, t, 0, "", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    want = dict(enumerate(brute_repeats(texts, 200)))
    for r in suffix_dedup.repeats(docs).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    new = {r.doc_id: r for r in suffix_dedup.deduplicate(docs, length_col="c").collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert new[i].text is None
            continue
        assert new[i].c == len(new[i].text) and (new[i].text == t) == (want[i][1] == 0)
        assert len(new[i].text.encode()) >= want[i][0] - want[i][1]


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(5)
    for n in [*range(1, 30), 100, 1000]:
        for letters in (1, 2, 30):
            s = rng.integers(1, letters + 1, n)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_long_texts_in_pieces(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(2000))
    got = pd.concat(list(suffix_dedup._runs(iter([pd.DataFrame({"k": [b"k"], "text": [text]})]))))
    covered = sorted((a, b) for a, b in zip(got["first"], got["last"]))
    assert covered[0][0] == 0 and covered[-1][1] == 1800
    assert all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:]))


def test_strip_keeps_whole_code_points():
    assert suffix_dedup.strip("aéb", np.array([[2, 4]])) == "aé"
    assert suffix_dedup.strip("aéb", np.array([[0, 2]])) == "éb"


def test_groups_by_anchor_hold_all_equal_windows():
    rng = random.Random(3)
    text = ("".join(rng.choice("ab") for _ in range(700))).encode()
    gram, first, last = suffix_dedup.anchors(np.frombuffer(text, np.uint8), 200)
    groups = defaultdict(set)
    for g, a, b in zip(gram.tolist(), first.tolist(), last.tolist()):
        for i in range(a, b + 1):
            groups[text[i : i + 200]].add(g)
    assert all(len(x) == 1 for x in groups.values())


def test_groups_are_dealt_until_they_are_small(spark, monkeypatch):
    """A template line with many variants: no group that is sorted in one go stays large."""
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    rng = random.Random(7)
    head, tail = ("".join(rng.choice("abcdefgh ") for _ in range(170)) for _ in range(2))
    texts = [f"{head}{rng.randrange(10**9):09d}{tail}" for _ in range(60)] + [head + "same field" + tail] * 2
    texts += ["ab" * 150 + str(i) for i in range(12)]  # periods: windows that share all hashes
    docs = spark.createDataFrame([(i, t, 0, "", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    want = dict(enumerate(brute_repeats(texts, 200)))
    sizes = []
    inner = suffix_dedup.Workspace.store

    def store(self, df, name):
        out = inner(self, df, name)
        if name.startswith("level-"):
            sizes.append(out.agg(F.max("n")).first()[0] or 0)
        return out

    monkeypatch.setattr(suffix_dedup.Workspace, "store", store)
    for r in suffix_dedup.repeats(docs).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert len(sizes) > 1 and sizes[-1] <= 4


def test_finer_groups_hold_all_equal_windows():
    rng = random.Random(3)
    text = ("".join(rng.choice("ab") for _ in range(500)) * 2).encode()
    for most in (2, 8, 169):
        groups = defaultdict(set)
        key, first, last = suffix_dedup.finer(np.frombuffer(text, np.uint8), 200, most)
        for g, a, b in zip(key.tolist(), first.tolist(), last.tolist()):
            for i in range(a, b + 1):
                groups[text[i : i + 200]].add(g)
        assert all(len(x) == 1 for x in groups.values())
