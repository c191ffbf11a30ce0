"""op2_order_minhash against Order MinHash in plain Python."""

import hashlib
import random

import numpy as np
import pytest

from docloom.llm import order_minhash as m
from docloom.llm import queries


def numbered(cp, k):
    seen, out = {}, []
    for i in range(len(cp) - k + 1):
        gram = tuple(cp[i : i + k])
        seen[gram] = seen.get(gram, -1) + 1
        out.append((gram, seen[gram]))
    return out


def true_slots(text):
    """For each of 64 independent hashes, the two least k-mers in text order."""
    grams = numbered(text, min(m.K, len(text)))
    out = []
    for s in range(m.SLOTS):
        least = sorted(range(len(grams)), key=lambda i: hashlib.blake2b(repr((s, grams[i])).encode(), digest_size=8).digest())[: m.TUPLE]
        out.append(tuple(grams[i][0] for i in sorted(least)))
    return out


def brute(text):
    """The slots' own hashes, one k-mer at a time."""
    cp = m.points(text)
    if not len(cp):
        return [0] * m.SLOTS
    k = min(m.K, len(cp))
    h = m.windows(cp, k)
    u, odd, wide = np.uint64, np.uint64(0xA24BAED4963EE407), 2**64
    g = [int(m.mix(np.array([(int(x) + occ * int(odd)) % wide], u))[0]) >> 32 for x, (_, occ) in zip(h, numbered(cp.tolist(), k), strict=True)]
    out = []
    for s in range(m.SLOTS):
        flip, factor = (int(m.mix(np.array([(s + 1) * c % wide], u))[0]) >> 32 for c in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15))
        least = sorted(range(len(g)), key=lambda i: (((g[i] ^ flip) * (factor | 1)) % 2**32, i))[: m.TUPLE]
        code = 0x51ED270B
        for x in ([int(h[i]) for i in sorted(least)] + [0] * m.TUPLE)[: m.TUPLE]:
            code = int(m.mix(np.array([(code * 0x9E3779B97F4A7C15 + x) % wide], u))[0])
        out.append(code >> 32 | 1)
    return out


@pytest.mark.parametrize("size", [40, 60, 80, 140, 300])
def test_swapped_halves_are_as_unlike_as_under_64_hashes(size):
    rnd, got, want = random.Random(size), [], []
    for _ in range(60):
        text = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=size))
        swapped = text[size // 2 :] + text[: size // 2]
        got.append(m.likeness(m.order_fingerprint(m.points(text)), m.order_fingerprint(m.points(swapped))))
        want.append(np.mean([a == b for a, b in zip(true_slots(text), true_slots(swapped), strict=True)]))
    assert abs(np.mean(got) - np.mean(want)) < 0.04
    assert abs(np.std(got) - np.std(want)) < 0.03


def test_query_keeps_the_order_of_short_texts(spark, tmp_path):
    texts = ["", "a", "short text", "twelve chars", "thirteen char", "document number 7 says word word word word word word ", "Ünïcode ß ẞ Σ ΣΣ. don't can't", "ab" * 300, "the same line again\n" * 90]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op2_order_minhash(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        own, edited, other = (np.array(brute(t), np.uint32) for t in (text, text[: len(text) - half] + after[:half], after))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (m._hex(own), m._hex(edited))
        assert (got[i].near_edited, got[i].near_next) == (m.likeness(own, edited), m.likeness(own, other))


def test_blocks_of_slots_don_t_change_a_long_text():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh "), 3000)) + "repeat this line\n" * 40
    assert m.order_fingerprint(m.points(text)).tolist() == brute(text)
