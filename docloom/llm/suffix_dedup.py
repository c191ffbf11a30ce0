"""Repeated byte strings by a distributed difference-cover suffix sort.

A string of LENGTH bytes is a window.  Sorting all suffixes of a corpus in one order needs
several shuffles of a row per byte; but only windows that could be equal must be sorted
together.  So the corpus is first dealt by content, without loss:

* Every window is named by the smallest hash of the GRAM-byte strings inside it (ties: the
  last one), its anchor.  Equal windows have equal anchors.  Neighbouring windows share an
  anchor, so a text becomes a short list of runs, each with its context: the bytes from
  the first window's start to the last one's end.
* Equal contexts are folded and counted.  A context that occurs once, with an anchor no
  other context has, can't hold a repeated window.  A context that occurs twice is
  repeated throughout.  What is left are the distinct contexts that share an anchor.
* A group of more than HOT distinct contexts is dealt again, by the 2 smallest hashes in a
  window, then by the 4, 8, ... smallest, until it is no larger, and equal contexts are
  folded each time: a very common passage, or a template with a million variants, doesn't
  meet in one task.  Windows with all hashes in common are equal, or turns of one period.

Within each group the contexts are suffix-sorted by the difference-cover algorithm modulo
3: the triples at places 1 and 2 mod 3 are sorted and named, the names are sorted by
recursion, the remaining suffixes are sorted by one letter and the rank behind it, both
lists are merged, and neighbouring suffixes are compared over LENGTH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Workspace, mix, partitions, possible_members, prepare, trim, windows

LENGTH, GRAM, HOT = 200, 32, 256
#: Texts are hashed in pieces of this many windows; groups are sorted in chunks of so many bytes.
PIECE, CHUNK = 1 << 17, 1 << 18
_POS = np.uint64(20)


# --- suffix sorting ---------------------------------------------------------------


def _order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by the columns, and from 1 the rank of each row's value."""
    key = columns[0].astype(np.uint64)
    top = int(columns[0].max()) + 1
    packed = True
    for c in columns[1:]:
        size = int(c.max()) + 1
        packed = packed and top * size < 2**64
        top *= size
        if packed:
            key = key * np.uint64(size) + c.astype(np.uint64)
    if packed:
        order = np.argsort(key, kind="stable")
        new = key[order][1:] != key[order][:-1]
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order) - 1, bool)
        for c in columns:
            new |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate([[1], 1 + np.cumsum(new)])
    return order, rank


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of s (numbers of at least 1) in ascending order."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), [0, 0, 0]])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    _, names = _order([t[sample], t[sample + 1], t[sample + 2]])
    if names.max() < len(sample):
        inner = suffix_array(names)
        names = np.empty(len(sample), np.int64)
        names[inner] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sorted12 = np.empty(len(sample), np.int64)
    sorted12[names - 1] = sample
    sorted12 = sorted12[sorted12 < n]
    zero = np.arange(0, n, 3)
    order0, _ = _order([t[zero], rank[zero + 1]])
    sorted0 = zero[order0]
    # Merge: how many sampled suffixes stand before each of the others.
    size = np.int64(rank.max() + 2)
    first, second = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    before = np.searchsorted(t[first] * size + rank[first + 1], t[sorted0] * size + rank[sorted0 + 1])
    pair = lambda i: t[i] * np.int64(t.max() + 1) + t[i + 1]
    pairs = np.concatenate([pair(second), pair(sorted0)])
    _, pair_rank = np.unique(pairs, return_inverse=True)
    before = before + np.searchsorted(pair_rank[: len(second)] * size + rank[second + 2], pair_rank[len(second) :] * size + rank[sorted0 + 2])
    out = np.empty(n, np.int64)
    at0 = before + np.arange(len(sorted0))
    out[at0] = sorted0
    rest = np.ones(n, bool)
    rest[at0] = False
    out[rest] = sorted12
    return out


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context the windows (by start) that also start elsewhere in the contexts."""
    sizes = np.array([len(c) for c in contexts])
    joined = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    s = joined.astype(np.int64) + 1
    s[starts + sizes] = 257 + np.arange(len(contexts))  # each context ends with a letter of its own
    can = np.zeros(len(s), bool)
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        can[a : a + n - length + 1] = n >= length
    order = suffix_array(s)
    order = order[can[order]]
    word = np.zeros(len(joined) + 8, np.uint64)
    word[: len(joined)] = joined
    for k in (1, 2, 4):  # eight bytes at each place
        word[: len(word) - k] |= word[k:] << np.uint64(8 * k)
    left, right = order[:-1], order[1:]
    for at in [*range(0, length - 7, 8)] + [length - 8] * (length % 8 > 0):
        same = word[left + at] == word[right + at]
        left, right = left[same], right[same]
    found = np.zeros(len(s), bool)
    found[left] = found[right] = True
    return [found[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


# --- anchors ----------------------------------------------------------------------


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def anchors(a: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the bytes a with one anchor: (gram hash, first, last window)."""
    h = windows(a, GRAM)
    with np.errstate(over="ignore"):
        key = ((h >> _POS) << _POS) | (np.uint64((1 << 20) - 1) - np.arange(len(h), dtype=np.uint64))
    low = _sliding_min(key, length - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.append(first[1:], len(low)) - 1
    at = (np.uint64((1 << 20) - 1) - (low[first] & np.uint64((1 << 20) - 1))).astype(np.int64)
    return h[np.minimum(at, len(h) - 1)], first, last


def finer(a: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same `most` smallest gram hashes: (their hash, first, last)."""
    each = np.lib.stride_tricks.sliding_window_view(windows(a, GRAM), length - GRAM + 1)
    some = np.sort(np.partition(each, most - 1, axis=1)[:, :most] if most < each.shape[1] else each, axis=1)
    key = np.full(len(some), np.uint64(most))
    with np.errstate(over="ignore"):
        for j in range(some.shape[1]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + some[:, j])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], first, np.append(first[1:], len(key)) - 1


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts -> a row for each run: anchor, hash of the context, text, first, last window."""
    for pdf in batches:
        out: list[list] = [[], [], [], [], []]
        for k, text in zip(pdf["k"].tolist(), pdf["text"].tolist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for at in range(0, len(raw) - LENGTH + 1, PIECE):
                piece = raw[at : at + PIECE + LENGTH - 1]
                gram, first, last = anchors(np.frombuffer(piece, np.uint8), LENGTH)
                view = memoryview(piece)
                digest = np.fromiter((xxhash.xxh3_64_intdigest(view[i : j + LENGTH]) for i, j in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
                for column, x in zip(out, (gram.view(np.int64), digest.view(np.int64), [k] * len(gram), first + at, last + at), strict=True):
                    column.append(x)
            if len(out[0]) and sum(map(len, out[0][-50:])) > 100_000:
                yield _frame(out)
                out = [[], [], [], [], []]
        yield _frame(out)
    trim()


def _frame(columns: list[list]) -> pd.DataFrame:
    whole = lambda c: (np.concatenate(c) if c else np.zeros(0, np.int64)).astype(np.int64)
    return pd.DataFrame({"gram": whole(columns[0]), "ctx": whole(columns[1]), "k": [k for c in columns[2] for k in c], "first": whole(columns[3]), "last": whole(columns[4])})


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with lists of runs -> the runs' contexts."""
    for pdf in batches:
        rows = []
        for text, runs in zip(pdf["text"].tolist(), pdf["runs"].tolist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            rows += [(r["gram"], r["ctx"], raw[r["first"] : r["last"] + LENGTH], r["c"], r["n"]) for r in runs]
        yield pd.DataFrame(rows, columns=["grp", "ctx2", "own", "c", "n"]).astype({"grp": "int64", "ctx2": "int64", "c": "int64", "n": "int64"})


def _deal_again(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Contexts -> the parts of each whose windows share their `most` smallest hashes."""
    for pdf in batches:
        out: list[tuple] = []
        for g, x, own, c in zip(pdf["grp"].tolist(), pdf["ctx2"].tolist(), pdf["own"].tolist(), pdf["c"].tolist(), strict=True):
            key, first, last = finer(np.frombuffer(own, np.uint8), LENGTH, most)
            with np.errstate(over="ignore"):
                key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + np.int64(g).view(np.uint64)).view(np.int64)
            out += [(g, x, i, k, own[i : j + LENGTH], c) for k, i, j in zip(key.tolist(), first.tolist(), last.tolist(), strict=True)]
            if len(out) > 20_000:
                yield _parts(out)
                out = []
        yield _parts(out)


def _parts(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["up_grp", "up_ctx", "shift", "grp", "own", "c"]).astype({"up_grp": "int64", "up_ctx": "int64", "shift": "int32", "grp": "int64", "c": "int64"})


def _sort_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group: whole groups are suffix-sorted, several in one chunk.

    Contexts that occur more than once only serve the others: they are repeated as a whole.
    """
    held: list[tuple] = []
    size = 0

    def done():
        # Equal windows have equal groups, so groups may share a suffix array.
        flags = repeated_windows([r[2] for r in held])
        hits = [(g, c, np.packbits(f).tobytes(), len(f), level) for (g, c, _, level, once), f in zip(held, flags, strict=True) if once and f.any()]
        return pd.DataFrame(hits, columns=["grp", "ctx2", "bits", "n", "level"]).astype({"grp": "int64", "ctx2": "int64", "n": "int32", "level": "int32"})

    for pdf in batches:
        for g, c, own, level, once in zip(*(pdf[x].tolist() for x in ("grp", "ctx2", "own", "level", "once")), strict=True):
            if size >= CHUNK and (held[-1][3], held[-1][0]) != (level, g):
                yield done()
                held, size = [], 0
            if held and held[-1][3] != level:  # a window is judged within one level
                yield done()
                held, size = [], 0
            held.append((g, c, bytes(own), level, once))
            size += len(own)
    if held:
        yield done()
    held = []
    trim()


# --- the operator -----------------------------------------------------------------


def _fold(docs: DataFrame, text_col: str) -> DataFrame:
    """k (MD5 of the text), text, copies: a row for each distinct text that has a window.

    Copies are folded before the shuffle, which is also the bucketing of the result.
    """
    text = docs.select(F.col(text_col).alias("text")).filter(F.octet_length("text") >= LENGTH)
    return text.select(_key(), "text").groupBy("k").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def _key() -> Column:
    return F.unhex(F.md5(F.col("text"))).alias("k")


def _flagged(texts: DataFrame, ws: Workspace) -> DataFrame:
    """k, marks: each text's runs of repeated windows as (first window, bits, count); bits
    null: all `count` windows.  texts: bucketed by k."""
    n = partitions(texts.sparkSession)
    runs = ws.store(texts.select("k", "text").mapInPandas(_runs, "gram long, ctx long, k binary, first long, last long"), "runs")
    # Most anchors occur once in the corpus, and with them their windows: only (nearly) the
    # others are kept, by a bitmap of the repeated anchors, before anything is shuffled.
    often = ws.store(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "often")
    runs = ws.store(runs.filter(possible_members(often, "gram")(F.col("gram"))), "repeated")
    ws.drop("runs")
    ws.release()
    place = F.struct("k", "first", "last")
    folded = runs.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("p"))
    folded = ws.store(folded.select("gram", "ctx", "c", "p.*"), "folded")
    # Written first: both sides of the join are plain shuffles, which are split at a hot gram.
    per = ws.store(folded.groupBy("gram").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("n")).filter("all > 1").drop("all"), "per")
    known = ws.store(folded.join(per, "gram"), "contexts")
    ws.drop("folded", "often", "per")
    # A text's runs are at most one for each of its bytes.
    asked = known.filter("n > 1").groupBy("k").agg(F.collect_list(F.struct("gram", "ctx", "first", "last", "c", "n")).alias("runs"))
    owned = texts.join(asked.hint("merge"), "k").select("text", "runs").mapInPandas(_contexts, "grp long, ctx2 long, own binary, c long, n long")
    owned = ws.store(owned, "owned")
    ws.release()
    levels, ties, most, grams = [owned], [], 2, LENGTH - GRAM + 1
    while most < 2 * grams and (hot := levels[-1].filter(F.col("n") > HOT)).take(1):
        name, size = f"-{most}", min(most, grams)
        dealt = hot.mapInPandas(lambda b, size=size: _deal_again(b, size), "up_grp long, up_ctx long, shift int, grp long, own binary, c long")
        dealt = ws.store(dealt.withColumn("ctx2", F.xxhash64("own")), "dealt" + name)
        fold = ws.store(dealt.groupBy("grp", "ctx2").agg(F.sum("c").alias("c"), F.first("own").alias("own")), "fold" + name)
        per = fold.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        levels.append(ws.store(fold.join(per, "grp").select("grp", "ctx2", "own", "c", "n"), "level" + name))
        # Contexts that occur more than once need no marks from their parts.
        ties.append(ws.store(dealt.filter("c = 1").select("up_grp", "up_ctx", "shift", "grp", "ctx2"), "ties" + name))
        ws.drop("dealt" + name, "fold" + name)
        most *= 2
    last = len(levels) - 1 if most >= 2 * grams else None  # no hash is left to deal by
    to_sort = [x.filter((F.col("n") > 1) & ((F.col("n") <= HOT) | F.lit(i == last))).select("grp", "ctx2", "own", F.lit(i).alias("level"), (F.col("c") == 1).alias("once")) for i, x in enumerate(levels)]
    both = to_sort[0]
    for x in to_sort[1:]:
        both = both.unionAll(x)
    # Groups of two levels never share a name but by chance, and are kept apart anyway.
    sorted_ = both.repartition(n, "level", "grp").sortWithinPartitions("level", "grp", "ctx2").mapInPandas(_sort_groups, "grp long, ctx2 long, bits binary, n int, level int")
    hits = ws.store(sorted_, "hits")
    # Marks on the contexts of a level: place, bits, count.  A context that occurs more than
    # once has one mark, for the whole of it, and one that occurs once has one tie: the join
    # with the ties gives no more rows than there are marks and ties.
    found = None
    for i in range(len(levels) - 1, -1, -1):
        own = hits.filter(F.col("level") == i).select("grp", "ctx2", F.lit(0).alias("at"), "bits", "n")
        if i:
            # Parts that occur more than once are repeated as a whole.
            own = own.unionAll(levels[i].filter("c > 1").select("grp", "ctx2", F.lit(0), F.lit(None).cast("binary"), (F.octet_length("own") - LENGTH + 1).cast("int")))
        found = own if found is None else found.unionAll(own)
        if i:
            found = found.join(ties[i - 1], ["grp", "ctx2"]).select(F.col("up_grp").alias("grp"), F.col("up_ctx").alias("ctx2"), (F.col("at") + F.col("shift")).cast("int").alias("at"), "bits", "n")
    found = found.select(F.col("grp").alias("gram"), F.col("ctx2").alias("ctx"), F.col("at").alias("shift"), "bits", "n")
    # Here, too, contexts that occur more than once are repeated as a whole.
    whole = known.filter("c > 1").select("gram", "ctx", F.lit(0).alias("shift"), F.lit(None).cast("binary").alias("bits"), F.lit(-1).alias("n"))
    on_text = runs.join(whole.unionAll(found), ["gram", "ctx"]).select("k", (F.col("first") + F.col("shift")).alias("at"), "bits", F.when(F.col("n") < 0, F.col("last") - F.col("first") + 1).otherwise(F.col("n")).alias("n"))
    marked = ws.store(on_text.groupBy("k").agg(F.collect_list(F.struct("at", "bits", "n")).alias("marks")), "marks")
    ws.drop("repeated", "contexts", *[name for name in ws.paths if name.split("-")[0] in ("owned", "hits", "level", "ties")])
    ws.release()
    return marked


def spans(n_bytes: int, copies: int, marks) -> np.ndarray:
    """(start, end) rows of the maximal byte runs that repeated windows cover."""
    if copies > 1 and n_bytes >= LENGTH:
        return np.array([[0, n_bytes]])
    edge = np.zeros(n_bytes + 1, np.int32)
    for m in marks if marks is not None else ():
        at, n = m["at"], m["n"]
        if m["bits"] is None:
            edge[at] += 1
            edge[at + n - 1 + LENGTH] -= 1
        else:
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], np.uint8))[:n])
            np.add.at(edge, at + hit, 1)
            np.add.at(edge, at + hit + LENGTH, -1)
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    change = np.diff(inside)
    return np.column_stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1)])


def _prepared(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame, Workspace]:
    spark = prepare(docs.sparkSession)
    ws = Workspace(spark)
    texts = ws.bucketed(_fold(docs, text_col), "texts", "k", partitions(spark))
    ws.release()
    return texts, _flagged(texts, ws), ws


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Every byte that a string of LENGTH bytes covers which also starts anywhere else, in
    the same or another row, is removed; strings are judged on the input.  Null texts
    count as empty; repeated rows repeat each other; a shorter text keeps all.  Null or
    repeated ids don't matter; very long texts are worked on whole; other columns are
    ignored; an empty table gives an empty result.
    """
    texts, marks, ws = _prepared(docs, text_col)

    def cut(batches):
        for pdf in batches:
            rows = []
            for k, text, copies, m in zip(pdf["k"].tolist(), pdf["text"].tolist(), pdf["copies"].tolist(), pdf["marks"].tolist(), strict=True):
                if copies == 1 and m is None:
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                found = spans(len(raw), copies, m)
                if len(found):
                    kept, at = hashlib.sha256(), 0
                    for a, b in found.tolist():
                        kept.update(raw[at:a])
                        at = b
                    kept.update(raw[at:])
                    rows.append((k, int((found[:, 1] - found[:, 0]).sum()), len(found), kept.hexdigest()))
            yield pd.DataFrame(rows, columns=["k", "n_removed", "n_spans", "kept"]).astype({"n_removed": "int64", "n_spans": "int64"})

    removed = texts.join(marks.hint("merge"), "k", "left").mapInPandas(cut, "k binary, n_removed long, n_spans long, kept string")
    removed = ws.store(removed, "removed")
    ws.keep_only("removed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", _key(), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    return rows.join(removed, "k", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "own").alias("kept_sha256"))


def strip(text: str, found: np.ndarray) -> str:
    """The text without the code points that lie wholly inside removed byte runs."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in found.tolist():
        while a < len(raw) and raw[a] & 0xC0 == 0x80:  # back to whole code points
            a += 1
        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append(raw[at:a])
            at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def deduplicate(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the repeated strings cut out of the text, and length_col (if any) anew."""
    texts, marks, ws = _prepared(docs, text_col)

    def cut(batches):
        for pdf in batches:
            new = [strip(t, spans(len(t.encode("utf-8", "surrogatepass")), c, m)) for t, c, m in zip(pdf["text"].tolist(), pdf["copies"].tolist(), pdf["marks"].tolist(), strict=True)]
            yield pd.DataFrame({"k": pdf["k"], "new": new})

    changed = texts.join(marks.hint("merge"), "k", "left").filter("copies > 1 or marks is not null").mapInPandas(cut, "k binary, new string")
    changed = ws.store(changed, "changed")
    ws.keep_only("changed")
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col(text_col).alias("text"))
    rows = rows.select("*", _key())
    maybe = possible_members(changed.select(F.xxhash64("k").alias("h")), "h")(F.xxhash64("k"))
    joined = rows.filter(maybe).join(changed.hint("merge"), "k", "left").unionByName(rows.filter(~maybe).withColumn("new", F.lit(None).cast("string")))
    out = []
    for i, c in enumerate(docs.columns):
        new = F.coalesce("new", "text")
        out.append((new if c == text_col else F.length(new).cast("long") if c == length_col else F.col(f"_c{i}")).alias(c))
    return joined.select(*out)
