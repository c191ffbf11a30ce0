"""Order MinHash fingerprints: signatures that are sensitive to edit distance.

A k-mer of code points is numbered by its occurrence in the text.  Each of SLOTS hashes of
(k-mer, occurrence) keeps its TUPLE smallest ones of the whole text, puts them back in
text order and hashes them together.  Two texts agree in a slot only if they share these
k-mers in the same order.

fingerprint() is the cheaper variant with one hash that deals the k-mers into SLOTS bins.
A bin of a short text holds fewer than TUPLE k-mers, and then no order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import id_in, id_out, mix, partitions, prepare, windows

K, SLOTS, TUPLE = 12, 64, 2
_BITS = SLOTS.bit_length() - 1


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _occurrences(h: np.ndarray) -> np.ndarray:
    """For each place, how often its k-mer came before."""
    occ = np.zeros(len(h), np.uint64)
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        at = np.searchsorted(twice, h)
        places = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == h)
        order = places[np.argsort(h[places], kind="stable")]
        v = h[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        starts = np.flatnonzero(new)
        occ[order] = (np.arange(len(v)) - np.repeat(starts, np.diff(np.append(starts, len(v))))).astype(np.uint64)
    return occ


def fingerprint(cp: np.ndarray) -> np.ndarray:
    """SLOTS 32-bit values; 0 marks a bin without a k-mer (a text shorter than K is one k-mer)."""
    out = np.zeros(SLOTS, np.uint32)
    if not len(cp):
        return out
    h = windows(cp, min(K, len(cp)))
    with np.errstate(over="ignore"):
        g = mix(h + _occurrences(h) * np.uint64(0xA24BAED4963EE407))
        key = (g << np.uint64(64 - _BITS)) | (g >> np.uint64(_BITS))  # bin first, then order
        places = None
        if len(h) > SLOTS * 32:  # the smallest few of each bin are enough, if every bin has enough
            below = np.flatnonzero((g >> np.uint64(_BITS)) < np.uint64(int(2 ** (64 - _BITS) * (SLOTS * 16 / len(h)))))
            if np.bincount((g[below] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).min() >= TUPLE:
                places = below
        if places is None:
            places = np.arange(len(h))
        order = places[np.argsort(key[places], kind="stable")]
        bins = (key[order] >> np.uint64(64 - _BITS)).astype(np.int64)
        starts = np.searchsorted(bins, np.arange(SLOTS))
        ends = np.searchsorted(bins, np.arange(SLOTS), side="right")
        chosen = np.full((SLOTS, TUPLE), len(h), np.int64)
        for j in range(TUPLE):
            has = starts + j < ends
            chosen[has, j] = order[starts[has] + j]
        chosen.sort(axis=1)  # text order; len(h) stands for none
        hp = np.append(h, np.uint64(0))
        code = np.full(SLOTS, np.uint64(0x51ED270B))
        for j in range(TUPLE):
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + hp[chosen[:, j]])
    out[:] = (code >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out[ends == starts] = 0
    return out


#: Hashes that are compared at once: a block of slots by all places of the text.
_BLOCK = 1 << 15
_SEED = np.arange(1, SLOTS + 1, dtype=np.uint64)
_FLIP = (mix(_SEED * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)[:, None]
_FACTOR = (mix(_SEED * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def order_fingerprint(cp: np.ndarray) -> np.ndarray:
    """SLOTS 32-bit values; 0 only for an empty text (one shorter than K is one k-mer).

    Slot s orders the k-mers by (g ^ _FLIP[s]) * _FACTOR[s], g being a hash of (k-mer,
    occurrence); equal values go by place.
    """
    out = np.zeros(SLOTS, np.uint32)
    if not len(cp):
        return out
    h = windows(cp, min(K, len(cp)))
    with np.errstate(over="ignore"):
        g = (mix(h + _occurrences(h) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32)
        chosen = np.full((SLOTS, TUPLE), len(h), np.int64)
        step = max(1, _BLOCK // len(h))
        for s in range(0, SLOTS, step):
            values = (g ^ _FLIP[s : s + step]) * _FACTOR[s : s + step]
            slot = np.arange(len(values))
            for j in range(min(TUPLE, len(h))):
                least = values.argmin(axis=1)
                chosen[s : s + step, j] = least
                values[slot, least] = np.uint32(0xFFFFFFFF)
        chosen.sort(axis=1)  # text order; len(h) stands for none
        hp = np.append(h, np.uint64(0))
        code = np.full(SLOTS, np.uint64(0x51ED270B))
        for j in range(TUPLE):
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + hp[chosen[:, j]])
    out[:] = (code >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing slots among those that either text fills; two empty texts: 1."""
    filled = int(((a != 0) | (b != 0)).sum())
    return float(((a == b) & (a != 0)).sum() / filled) if filled else 1.0


def _hex(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def _follow(rows: Iterator[pd.DataFrame], fingerprint: Callable[[np.ndarray], np.ndarray]) -> Iterator[pd.DataFrame]:
    """Rows in order; each document meets the next one.  `carry` rows only end a bucket."""
    held = None
    for pdf in rows:
        out = []
        for doc_id, text, carry in zip(pdf["doc_id"].array, pdf["text"].array, pdf["carry"].array, strict=True):
            if carry and held is None:
                continue
            cp = points(text if isinstance(text, str) else "")
            f = fingerprint(cp)
            if held is not None:
                own_id, own, own_f = held
                half = len(own) // 2
                edited = np.concatenate([own[: len(own) - half], cp[:half]])
                edited_f = fingerprint(edited)
                raw = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                out.append((own_id, len(own), hashlib.sha256(raw).hexdigest(), _hex(own_f), _hex(edited_f), likeness(own_f, edited_f), likeness(own_f, f)))
            held = None if carry else (doc_id, cp, f)
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Callable[[np.ndarray], np.ndarray] = fingerprint) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Every text is compared with an edited form (its last half replaced by the start of
    the next document in ascending id order; the first follows the last) and with that
    next document.  Null texts count as empty; null ids come first; rows with equal ids
    are ordered by text; repeated rows each give a row; a lone row follows itself.  An
    empty table gives an empty result.  Very long texts are one row each.  Other columns
    are ignored.  rule: order_fingerprint, or fingerprint for bins of one hash.

    Each row crosses one shuffle: rows are dealt into id ranges of equal counts, and the
    first row of a range also goes to the end of the range before it.
    """
    spark = prepare(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = id_in("doc_id", "_key")
    n = partitions(spark)
    cuts = sorted({int(x) for x in slim.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) or []}) if n > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("_key"))) if cuts else F.lit(0)
    slim = slim.withColumn("_key", key)
    # One row per range, so a small list.
    firsts = sorted((r[0], r[1]) for r in slim.select("_key", bucket.alias("b")).groupBy("b").agg(F.min("_key")).collect())
    if not firsts:
        return spark.createDataFrame([], schema)
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
    to = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    places = F.when(to[F.col("_key")].isNotNull(), F.array(F.struct(bucket.cast("int").alias("b"), F.lit(0).alias("carry")), F.struct(to[F.col("_key")].cast("int").alias("b"), F.lit(1).alias("carry")))).otherwise(
        F.array(F.struct(bucket.cast("int").alias("b"), F.lit(0).alias("carry")))
    )
    dealt = slim.select(F.col("_key").alias("doc_id"), "text", "_key", F.explode(places).alias("p")).select("doc_id", "text", "_key", "p.b", "p.carry")
    ordered = dealt.repartitionById(n, "b").sortWithinPartitions("b", "carry", "_key", "text")
    return id_out(ordered.select("doc_id", "text", "carry").mapInPandas(lambda rows: _follow(rows, rule), schema))
