import hashlib
import zlib

import numpy as np
import pytest

from docloom.llm import bpe, order_minhash, queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, block int"


def rows():
    texts = ["Hello, the WORLD's <|endoftext|> foo12", "", None, "ΑΣ İx a\x85b ﬁ é", "one two three " * 400, "a", "a", "Ünïcode ß ẞ Σ ΣΣ. don't can't"]
    texts += [f"document number {i} says {'word ' * (i % 7)}" for i in range(60)] + ["x" * 120_000]
    out = [(i, t, "en", "s", 0, 7, 9) for i, t in enumerate(texts)]
    return out + [out[4], (None, "no id", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def test_shards_are_gapless_contiguous_and_near_equal(spark, docs):
    got = sharding.shard(docs, 5).collect()
    assert len(got) == len(rows())
    key = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in key]
    assert ids == sorted(ids)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    text = {r[0]: r[1] for r in rows()}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    total, before = sum(r["size"] for r in key), 0
    for r in key:
        assert r.shard == min(4, (2 * before + r["size"]) * 5 // (2 * total))
        before += r["size"]
    assert sharding.shard(docs.limit(0), 5).count() == 0


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.filter("doc_id <> 4"), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.filter("doc_id <> 4").count()
    with pytest.raises(ValueError):
        sharding.write_shards(docs, str(tmp_path / "no"), 3)


def brute_fingerprint(text):
    """Every k-mer in every bin, sorted plainly."""
    cp = order_minhash.points(text)
    k = min(order_minhash.K, len(cp))
    if not k:
        return [0] * order_minhash.SLOTS
    h = order_minhash.windows(cp, k)
    seen, bins = {}, {}
    for i, x in enumerate(h.tolist()):
        occ = seen[x] = seen.get(x, -1) + 1
        with np.errstate(over="ignore"):
            g = int(order_minhash.mix(np.array([x], np.uint64) + np.array([occ], np.uint64) * np.uint64(0xA24BAED4963EE407))[0])
        bins.setdefault(g % order_minhash.SLOTS, []).append((g // order_minhash.SLOTS, i))
    out = []
    for b in range(order_minhash.SLOTS):
        if b not in bins:
            out.append(0)
            continue
        places = sorted(i for _, i in sorted(bins[b])[: order_minhash.TUPLE])
        code = np.array([0x51ED270B], np.uint64)
        for j in range(order_minhash.TUPLE):
            with np.errstate(over="ignore"):
                code = order_minhash.mix(code * np.uint64(0x9E3779B97F4A7C15) + (h[places[j] : places[j] + 1] if j < len(places) else np.zeros(1, np.uint64)))
        out.append(int(code[0] >> np.uint64(32)) | 1)
    return out


def test_fingerprints_against_brute_force(spark, docs):
    order = sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in rows())
    got = order_minhash.fingerprints(docs).collect()
    assert len(got) == len(order)
    want = []
    for i, (doc_id, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        if len(text) > 10_000:
            continue
        a, b, c = (np.array(brute_fingerprint(t), np.uint32) for t in (text, edited, nxt[:10_000]))
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), order_minhash._hex(a), order_minhash._hex(b), order_minhash.likeness(a, b), order_minhash.likeness(a, c) if len(nxt) <= 10_000 else None))
    key = lambda r: (r[0], r[1], r[2])
    have = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in got if r.n_chars <= 10_000)
    for w, h in zip(sorted(want, key=key), sorted(have, key=key), strict=True):
        assert w[:6] == h[:6]
        assert w[6] is None or w[6] == h[6]
    assert order_minhash.fingerprints(docs.limit(0)).count() == 0
    assert order_minhash.fingerprints(docs.filter("doc_id = 0")).collect()[0].near_next == 1.0


def test_long_text_shortcut_equals_brute_force():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh "), 6000)) + "repeat this line\n" * 40
    assert order_minhash.fingerprint(order_minhash.points(text)).tolist() == brute_fingerprint(text)


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary_path())
    got = bpe.encode(docs, queries.vocabulary_path(), keep=True).collect()
    assert len(got) == len(rows())
    text = {r[0]: r[1] for r in rows()}
    for r in got:
        ids = tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == tok.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), queries.vocabulary_path()).count() == 0


def test_word_splitter_on_many_code_points():
    from tokenizers import Tokenizer

    with open(queries.vocabulary_path(), "rb") as f:
        spec = f.read()
    tok, split = Tokenizer.from_str(spec.decode()), bpe.Splitter(spec)
    rng = np.random.default_rng(3)
    for n in range(120):
        text = "".join(chr(c) for c in rng.choice([*range(1, 0x250)] if n % 2 else [*range(1, 0x500), *range(0x1E00, 0x2100), 0x3000, 0x4E00, 0x1F600], 60))
        want = [text_ for text_, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))]
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        have = [level.pre_tokenize_str(w)[0][0] for w in split.words(text)]
        assert have == want


def test_small_blocks(spark, docs, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(bpe, "BLOCK_WORDS", 5)
    with open(queries.vocabulary_path(), "rb") as f:
        spec = f.read()
    parts = list(bpe.number_words(iter([pd.DataFrame({"doc_id": [1, 2, None], "text": ["a b c d e f", "", "a a"]})]), 3, spec, 4))
    assert [p["block"].iloc[0] for p in parts if p["kind"].iloc[0] == 0] == [3 << 24, (3 << 24) + 1]
