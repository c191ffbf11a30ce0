import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import html_text, language_id, mixing, toxicity, vector_tree

DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxic string, epoch int, weight int"


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(n=400):
    rng = random.Random(6)
    alphabets = {"en": "abcdet", "de": "schüör", "fr": "eéèulx"}
    rows = []
    for i in range(n):
        lang = rng.choice(list(alphabets))
        text = words(rng, alphabets[lang], rng.randint(5, 120))
        bad = i % 5 == 0
        if bad:
            parts = text.split()
            for w in rng.sample(["idiots", "idiotic", "scumbag", "worthless"], rng.randint(1, 3)):
                parts.insert(rng.randrange(len(parts)), w)
            text = " ".join(parts)
        rows.append((i, text, lang, f"s{i % 7 if i % 3 else 0}", len(text), str(bad), 1, 2))
    odd = [(1000, None, "en", None, None, None, None, None), (1001, "", None, "s0", 0, None, None, None), (1002, "123 !?", "en", "s1", 6, None, None, None), (1003, "abc de " * 20_000, "en", "s0", 1, None, None, None), (None, rows[1][1], "en", "s1", 1, None, None, None), rows[2]]
    return rows + odd


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def test_language_on_held_out_rows(spark, docs):
    model = language_id.train(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    got = language_id.identify(docs, model, "doc_id", "text", F.col("lang")).withColumn("out", language_id.held_out()).collect()
    assert len(got) == len(corpus())
    real = [r for r in got if r.out and r.lang and r.lang_pred != "und"]
    assert len(real) > 50 and np.mean([r.lang == r.lang_pred for r in real]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.train(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_nystroem_equals_the_full_kernel_when_all_rows_are_landmarks():
    rng = random.Random(1)
    texts = [words(rng, a, 30) for a in ("abcd", "vwxyz") for _ in range(20)]
    sets = [language_id.presence(t) for t in texts]
    y = ["a"] * 20 + ["b"] * 20
    grams = [{t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in texts]
    k = np.array([[len(p & q) / (len(p) * len(q)) ** 0.5 for q in grams] for p in grams])
    assert np.allclose(language_id.kernel(sets, sets), k, atol=5e-3)  # hashing hardly ever joins two n-grams
    model = language_id.fit(sets, k, y)
    t = np.where(np.array(y)[:, None] == np.array(["a", "b"]), 1.0, -1.0)
    c = k - k.mean(axis=0)
    centred = c - c.mean(axis=1, keepdims=True)
    want = centred @ np.linalg.solve(centred + language_id.RIDGE * len(y) / 100 * np.eye(len(y)), t - t.mean(axis=0)) + t.mean(axis=0)
    assert np.allclose(language_id.Scorer(model).margins(sets), want, atol=0.02)


def test_language_rows_against_brute_force(spark, docs):
    """Every row of identify(): plain sets of n-grams, the Nystroem map and ridge by hand."""
    rows = [r for r in corpus() if r[0] is not None and r[0] < 120] + [(5, "a text that is not the one of row five", "en", None, None, None, None, None)]
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    model = language_id.train(table, F.lit(True))
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.identify(table, model, "doc_id", "text", F.col("text").alias("text_")).withColumnRenamed("text_", "text").collect()}
    by = {}
    for i, text, lang, *_ in rows:
        by.setdefault((i, lang), []).append(text)
    h = {r.text: r.h for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    keys = sorted(by)
    texts = [min(by[key], key=lambda t: (h[t], t)) for key in keys]
    grams = lambda t: {t.lower()[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}
    k = lambda p, q: len(p & q) / (len(p) * len(q)) ** 0.5
    sets = [grams(t) for t in texts]
    marks = [sets[i] for i in language_id.landmarks([lang for _, lang in keys])]
    values, vectors = np.linalg.eigh(np.array([[k(p, q) for q in marks] for p in marks]))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    z = np.array([[k(p, q) for q in marks] for p in sets]) @ root
    names = sorted({lang for _, lang in keys})
    target = np.array([[1.0 if lang == c else -1.0 for c in names] for _, lang in keys])
    mean, offset = z.mean(axis=0), target.mean(axis=0)
    w = np.linalg.solve((z - mean).T @ (z - mean) + language_id.RIDGE * len(keys) / 100 * np.eye(z.shape[1]), (z - mean).T @ (target - offset))
    assert len(got) == len({(r[0], r[1]) for r in rows})
    for (_, text), (lang, score) in got.items():
        margin = (np.array([k(grams(text), q) for q in marks]) @ root - mean) @ w + offset
        p = np.exp(3 * margin) / np.exp(3 * margin).sum()
        assert lang == names[int(margin.argmax())] and score == pytest.approx(p.max(), abs=1e-3)


def test_long_texts_do_not_fill_the_n_gram_space():
    rng = random.Random(5)
    x = language_id.presence(words(rng, "abcdefghijklmnopqrstuvwxyz", 5000))
    share = np.bincount(x >> language_id.BITS, minlength=4) / 2**language_id.BITS
    assert share.max() < 0.15


def test_toxicity_on_held_out_labels(spark, docs):
    labels = spark.createDataFrame([(r[0], int(r[5] == "True"), 1) for r in corpus(400)[:400]], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels.filter("doc_id % 4 <> 1"))
    assert (np.diff(model["theta"]) > 0).all()
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    for i, r in got.items():
        if i is not None and i < 400:
            assert r.toxic == (i % 5 == 0), i
    assert not any(got[i].toxic or got[i].severity for i in (1000, 1001))
    assert all(0 <= r.severity <= 1 and r.severity == r.p_toxic and r.grade == (r.p_toxic > 0.5) == r.toxic for r in got.values())
    kept = toxicity.reject(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(not r.toxic for r in toxicity.severity(docs, model).collect())
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.severity(docs, None).filter("toxic").count() == 0


def test_toxicity_rows_against_brute_force(spark):
    """Grades 0, 1, 2 and 4, an id with two texts: feature choice and scores by plain Python."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        grade = (0, 0, 1, 2, 4)[i % 5]
        parts = words(rng, "abcdet", 20).split() + [rng.choice(["nasty", "vile"]) for _ in range(grade > 0)] + ["scumbag"] * (grade > 1) + ["worthless"] * (grade > 3)
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
        labels.append((i, grade))
    rows += [(7, "another text of seven"), (8, None), (None, "vile"), (900, ""), (901, "Scumbag! worthless vile")]
    labels += [(2, 0), (7, None), (None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    h = {r.text: r.h for r in docs.filter("text is not null").select("text", F.xxhash64("text").alias("h")).collect()}
    texts = {}
    for i, t in rows:
        if i is not None and i < 300 and t is not None:
            texts[i] = min(texts.get(i, t), t, key=lambda t: (h[t], t))
    bad = {i: max(g for j, g in labels if j == i and g is not None) > 0 for i in texts}
    p, n = Counter(), Counter()
    for i, t in texts.items():
        (p if bad[i] else n).update(toxicity.features(t))
    n1, n0 = sum(bad.values()), len(bad) - sum(bad.values())
    want = set()
    for f in p:
        a, b = p[f], n[f]
        c, d = n1 - a, n0 - b
        chi2 = (n0 + n1) * max(abs(a * d - b * c) - (n0 + n1) / 2, 0) ** 2 / (n0 * n1 * (a + b) * max(c + d, 1))
        if chi2 >= toxicity.CHI2 and a + b >= toxicity.MIN_HITS and a * n0 > toxicity.LIFT * b * n1:
            want.add(f)
    assert set(model["place"]) == want and len(model["theta"]) == 3 and (np.diff(model["theta"]) > 0).all()
    seen = toxicity.severity(docs, model).collect()
    by = {}
    for r in seen:
        by.setdefault(r.doc_id, []).append(r)
    assert len(seen) == len(rows)
    for i, t in rows:
        s = sum(float(model["weights"][model["place"][f]]) for f in toxicity.features(t or "") & want)
        up = [1 / (1 + np.exp(theta - s)) if t else 0.0 for theta in model["theta"]]
        share = [1 - up[0], up[0] - up[1], up[1] - up[2], up[2]]
        assert any(r.severity == pytest.approx(sum(up), abs=1e-9) and r.grade == int(np.argmax(share)) and r.toxic == (r.grade > 0) for r in by[i])
    grades = {i: by[i][0].grade for i in range(300) if i != 7}
    assert np.mean([grades[i] == (0, 0, 1, 2, 3)[i % 5] for i in grades]) > 0.95 and by[901][0].grade == 3


def test_ordinal_fit_orders_three_grades():
    rng = np.random.default_rng(2)
    x = (rng.random((600, 3)) < 0.5).astype(np.float32)
    grades = (x[:, 0] + x[:, 0] * x[:, 1]).astype(int)
    model = toxicity.fit(x, grades)
    s = x @ model["weights"]
    assert s[grades == 0].max() < s[grades == 1].min() < s[grades == 2].min()


def brute_mix(rows, repeat, seed=17):
    import hashlib
    import math

    token = lambda t: max(1, len(re.findall(mixing.TOKEN, t or "")))
    totals = Counter()
    for r in rows:
        totals[r[3]] += token(r[1])
    share = {s: n / sum(totals.values()) for s, n in totals.items()}
    lo, hi = 0.0, 1.0
    for _ in range(30):
        a = (lo + hi) / 2
        ratio = [p ** (a - 1) for p in share.values()]
        lo, hi = (a, hi) if max(ratio) / min(ratio) > repeat else (lo, a)
    a = hi
    least = min(p ** (a - 1) for p in share.values())
    quota = {s: max(n, math.floor(round(n * share[s] ** (a - 1) / least, 3))) for s, n in totals.items()}
    drawn = Counter()
    for s, n in totals.items():
        whole, rest = divmod(quota[s], n)
        own = sorted((hashlib.md5(f"{'' if r[0] is None else r[0]}:{whole}:{seed}".encode()).hexdigest(), token(r[1]), r[0]) for r in rows if r[3] == s)
        spent, cut = 0, ""
        for h, t, _ in own:
            if spent < rest:
                cut = h
            spent += t
        for h, _, i in own:
            drawn[i] += whole + (h <= cut)
    return drawn, a


def test_mixing_against_brute_force(spark, docs):
    rows = corpus()
    want, a = brute_mix(rows, 1.5)
    got = mixing.mix(docs, repeat=1.5, keep=("doc_id", "source")).collect()
    assert Counter(r.doc_id for r in got) == want
    assert {r[0] for r in rows} <= set(want)
    assert all(0 <= r.place < 1 for r in got)
    draws = mixing.draw(docs, repeat=1.5)
    assert draws.columns == docs.columns and draws.count() == len(got)
    assert mixing.mix(docs.limit(0), repeat=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, repeat=2.0, entropy=0.5)


def test_mixing_reaches_an_entropy_target(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    got = mixing.source_weights(sources, entropy=0.8).collect()
    w = np.array([r.weight for r in got])
    assert abs(-(w * np.log(w)).sum() / np.log(3) - 0.8) < 1e-6 and abs(w.sum() - 1) < 1e-9


PAGE = """<html><head><title>T</title></head><body><header class="site"><h1>Site</h1><p>Welcome to the site with a long slogan that goes on and on.</p></header>
<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><div class="cookie-notice">We use cookies to make this site better for you and all others.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First para <a href=x>link</a> text.<p>Short.</p><div class="ad-box">Buy now the best thing ever at a good price today</div>
<form><label>Name</label><input><button>Go</button></form><script>if (a < b) { document.write("<p>no</p>") }</script><p>Last   para
with lines &lt;b&gt; &#8364; end<br>of it</p></article><section id="comments"><p>Great article, I loved it a lot, thanks for all the fish!</p></section></main>
<aside><p>Side text that is rather long and has many words in it for sure.</p></aside><footer>&copy; x</footer></body></html>"""


def test_html_main_text(spark):
    want = "Title & more\nFirst para link text.\nShort.\nLast para with lines <b> € end of it"
    long = "<article>" + "<p>word and word</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 1), (3, "v", "", 1), (None, "w", "<p", 1), (4, "x", long, 0), (5, "y", "<nav><a>only menu</a></nav>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [r.text for r in got if r.page_id == 1] == [want, want]
    assert by[2].text == by[3].text == by[None].text == by[5].text == "" and by[4].text.count("\n") == 19_999
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_without_article_element():
    body = "some words of text " * 10
    page = f"<body><div id=menu><a href=1>A</a> <a href=2>B</a></div><div><h2>Head line</h2><p>{body}</p><p>Short one.</p><p>{body}</p></div><ul><li><a href=3>one two</a></li></ul><div>Copyright 2020</div></body>"
    assert html_text.main_text(page).split("\n")[1:] == [body.strip(), "Short one.", body.strip()]


def test_html_raw_text_and_attributes():
    page = '<article><p title="a > b">x</p><style>p{}</style><!-- <p>no</p> --><p>y &amp z&nbsp;w</p><textarea>t</textarea></article>'
    assert html_text.main_text(page) == "x\ny & z w"
    assert html.unescape("&amp") == "&"


ARTICLE = "<h1>A real title of it</h1>" + "".join(f"<p>{'word ' * n}end.</p>" for n in (40, 25, 60, 3, 30))
WRAPPERS = ['<div class="layout has-sidebar"><article>%s</article></div>', '<article class="post has-comments">%s</article>', '<div class="with-menu"><article>%s</article></div>', '<main class="search-page">%s</main>', '<article class="share-price">%s</article>', '<div class="related-content"><article>%s</article></div>', '<div class="sidebar"><article>%s</article></div>', "<form><div>%s</div></form>", "<div>%s</div>", '<section id="related-work">%s</section>', '<div class="comments"><article>%s</article></div>', "%s"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_wrappers_keep_the_article(wrapper):
    """Names of wrappers don't empty a page, and pages without an article element pass."""
    menu = "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in ("Home", "About us", "Contact")) + "</ul>"
    rest = "<aside><p>Buy this now and save a lot</p></aside><section class=page-comments><article class=comment><p>I read it all and like it.</p></article></section><footer>All rights reserved</footer>"
    page = f"<html><body><nav>{menu}</nav>{menu}{wrapper % ARTICLE}{rest}</body></html>"
    want = re.sub(r" *</p>| *</h1>", "\n", ARTICLE).replace("<p>", "").replace("<h1>", "").strip()
    assert html_text.main_text(page) == want


def test_html_menus_inside_the_article():
    menu = "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in ("Home", "About us", "Contact")) + "</ul>"
    page = f"<article><h1>Some title here</h1>{menu}<p>{'word ' * 40}</p><p><a href=y>a single link of the article, alone</a></p><p>{'more ' * 30}</p></article>"
    assert html_text.main_text(page).split("\n") == ["Some title here", ("word " * 40).strip(), "a single link of the article, alone", ("more " * 30).strip()]


def test_html_features_against_brute_force():
    """share, holds and side by walking a page of well-nested elements with another parser."""
    import xml.etree.ElementTree as ET

    page = '<body><nav><p>a b</p></nav><div class="sidebar"><article><h1>t u</h1><p>one two three four five six</p><div class="ad"><p>x y</p></div></article></div><aside><p>k l m</p></aside><p>z</p></body>'
    root = ET.fromstring(page)
    up = {c: p for p in root.iter() for c in p}
    leaves = [e for e in root.iter() if e.text]
    chain = lambda e: [e] + (chain(up[e]) if e in up else [])
    words = lambda e: sum(len(x.text.split()) for x in e.iter() if x.text)
    marked = lambda e: e.tag in ("nav", "aside") or e.get("class") in ("sidebar", "ad")
    article, total = root.find(".//article"), words(root)
    want = []
    for e in leaves:
        mark = next((a for a in chain(e) if marked(a)), None)
        want.append((100 if mark is None else 100 * words(mark) / total, 1 if mark is None else article in list(mark.iter()), 1 if article in chain(e) else -1))
    found, around = html_text.blocks(page)
    assert [b.text for b in found] == [e.text for e in leaves]
    assert np.allclose(html_text.table(found, around)[:, 6:9], np.array(want, float))
    tree = repr(html_text.trained())
    used = {int(m) for m in re.findall(r"\((\d+),", tree)}
    assert used >= {0, 1, 2, 4, 6, 8} and used & {3, 5}  # words and links of neighbours decide, too


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (150, 8)) for c in rng.normal(0, 2, (8, 8))] + [np.tile(rng.normal(0, 2, 8), (300, 1))])
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 8, 1), (5002, [float("nan")] + [1.0] * 7, 1), (5003, [None] + [1.0] * 7, 1), (5004, [float("inf")] * 8, 1), (5005, [], 1), (None, [1.0] * 8, 1), (5006, [1.0] * 3, 1), rows[3]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = vector_tree.search(table, F.col("vec_id") % 50 == 0, 10).collect()
    ids = np.arange(len(x)).tolist() + [3]
    full = np.concatenate([x, x[3:4]])
    hits = total = 0
    for q in range(0, len(x), 50):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        d = np.sqrt(((full - x[q]) ** 2).sum(axis=1))
        true = sorted((float(d[i]), ids[i]) for i in range(len(ids)) if ids[i] != q)[:10]
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in own)
        hits += len({i for _, i in true} & {r.vec_id for r in own})
        total += 10
    assert hits / total >= 0.9
    few = vector_tree.search(table.filter("vec_id < 4"), F.col("vec_id") == 0, 10).collect()
    assert {r.vec_id for r in few} == {1, 2, 3}
    assert vector_tree.search(table.limit(0), F.lit(True)).count() == 0


def test_best_first_order_opens_every_leaf():
    x = np.random.default_rng(1).normal(size=(2000, 4))
    tree = vector_tree.grow(x)
    order = [leaf for leaf, _ in vector_tree.leaf_order(tree, x[0])]
    assert sorted(order) == list(range(tree["leaves"])) and order[0] == vector_tree.deal(tree, x[:1])[0]


def neighbours(rows, queries, k=10):
    """Brute force: {(id, vector): [(distance, id)]}, each row but one of the query's own."""
    out = {}
    for q, v in set(queries):
        left = list(rows)
        left.remove((q, v))
        out[q, v] = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in left)[:k]
    return out


def test_repeated_queries_and_shared_vectors(spark):
    """Every leaf is open in a table this small, so the result is exact."""
    rng = np.random.default_rng(3)
    rows = [(i, tuple(rng.normal(size=4).tolist())) for i in range(30)]
    rows += [rows[0], rows[10], rows[10], (20, rows[3][1]), (20, tuple(rng.normal(size=4).tolist()))] + [(100 + i, rows[5][1]) for i in range(40)]
    table = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    want = neighbours(rows, [r for r in rows if r[0] % 10 == 0])
    got = {}
    for r in vector_tree.search(table, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    for q in {q for q, _ in want}:
        lists = [[(n, d, i) for n, (d, i) in enumerate(w, start=1)] for (x, _), w in want.items() if x == q]
        assert sorted(got[q]) == sorted(x for one in lists for x in one), q


def test_subtrees_split_what_the_top_leaves_large(spark, monkeypatch):
    for name, value in (("SPLIT", 60), ("CELL", 20), ("SPREAD", 50), ("LEAF", 8)):
        monkeypatch.setattr(vector_tree, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 1500)] + 0.2 * rng.normal(size=(1500, 6))
    rows = [(i, tuple(v)) for i, v in enumerate(x.tolist())]
    table = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in vector_tree.search(table, F.col("vec_id") % 50 == 0, sample=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = neighbours(rows, [r for r in rows if r[0] % 50 == 0])
    assert all(sorted(x[0] for x in own) == list(range(1, 11)) for own in got.values()) and len(got) == 30
    assert sum(len({i for _, i in w} & {x[2] for x in got[q]}) for (q, _), w in want.items()) >= 0.9 * 300
