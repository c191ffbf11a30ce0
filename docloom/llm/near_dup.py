"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

A register holds the exponent, on an exponential scale of base BASE and truncated, of the
smallest of a set's exponentially distributed hashes: registers of a union are the
maxima, and two registers agree with about the Jaccard likeness.  The registers are cut
into bands; sets that agree in a band are candidates.  Band sizes follow the threshold so
that a pair at the threshold is missed with probability MISS.

1. Equal texts are folded, then equal sets, into one node (its smallest doc_id).
2. In each band bucket every node is paired with the smallest node, the pivot: a star,
   never all pairs.  The pairs' likeness is estimated jointly from the registers and the
   known set sizes by maximum likelihood; what isn't far too small is verified on the
   full sets.
3. Where the nodes that met a pivot still belong to several components, their sketches
   meet in cells of bounded size.  Only nodes with a partner of another component that
   the sketches can't rule out send their texts to the cell, where pairs are verified
   until their components are joined.  So no link between different components can be
   lost, and a cell gives at most a row for each of its rows.
Components are found by alternating stars.

Distinct texts are written once, bucketed by their MD5: no later step shuffles texts that
nobody asks for, at any size.

Joins of tables that grow with the nodes carry a merge hint: the planner takes a table's
size from its compressed file and doesn't count the rows that explode() adds, so it would
broadcast, through the driver, tables many times larger than its threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import Workspace, id_in, id_out, partitions, prepare, trim, windows
from docloom.llm.components import components

BASE, RATE, MISS = 1.001, 20.0, 1e-9
#: Texts that a text meets in one cell; in the second round, sketches on each side of a cell.
CELL, BLOCK = 64, 512
_LOG = math.log(BASE)


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, registers a band)."""
    rows = max(1, round(math.log(0.37) / math.log(threshold))) if threshold < 1 else 8
    rows = min(rows, 8)
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows)) if threshold < 1 else 1, rows


def shingles(text, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words, A-Z lower-cased; with
    fewer words one run of all; without words none."""
    if not isinstance(text, str):
        return np.zeros(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    return np.unique(windows(h, min(words, len(h))))


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return (rng.integers(0, 2**32, m, np.uint64).astype(np.uint32) | np.uint32(1)), (rng.integers(0, 2**32, m, np.uint64).astype(np.uint32) | np.uint32(1))


def registers(h: np.ndarray, m: int) -> np.ndarray:
    """m SetSketch registers of a set of hashes; those of an empty set are 0."""
    if not len(h):
        return np.zeros(m, np.uint16)
    first, second = _seeds(m)
    low = np.full(m, 2**32 - 1, np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 512):
            y = x[at : at + 512, None] * first
            y ^= y >> np.uint32(15)
            y *= second
            y ^= y >> np.uint32(13)
            np.minimum(low, y.min(axis=0), out=low)
    smallest = -np.log1p(-(low + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / _LOG), 0, 65_534).astype(np.uint16)


_GRID = np.linspace(0.0, 1.0, 201)


def likeness(more: np.ndarray, less: np.ndarray, m: int, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard likeness of pairs of sketches.

    more, less: registers in which the first exceeds the second, or is exceeded; na, nb:
    sizes of the sets.
    """
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    scale = (BASE - 1) / BASE
    p = np.maximum(-np.log1p(-np.maximum(u - v * j, 0) * scale) / _LOG, 1e-12)
    q = np.maximum(-np.log1p(-np.maximum(v - u * j, 0) * scale) / _LOG, 1e-12)
    equal = np.maximum(1 - p - q, 1e-12)
    d1, d2 = more[:, None], less[:, None]
    best = (d1 * np.log(p) + d2 * np.log(q) + (m - d1 - d2) * np.log(equal)).argmax(axis=1)
    return j[np.arange(len(j)), best]


class Sets:
    """The sets of a cell, with their sketches, and exact tests of pairs."""

    def __init__(self, words: int, num: int, den: int):
        self.words, self.num, self.den = words, num, den
        bands, rows = bands_for(num / den)
        self.m = bands * rows
        t = num / den
        self.sigma = math.sqrt(t * (1 - t) / self.m)
        self.least = t - 6 * self.sigma

    def of(self, text) -> tuple[np.ndarray, np.ndarray]:
        h = shingles(text, self.words)
        return h, registers(h, self.m)

    def linked(self, a, others: list) -> list[bool]:
        """Which of `others` reach the threshold with a."""
        n = np.array([len(h) for h, _ in others])
        fits = (np.minimum(n, len(a[0])) * self.den >= self.num * np.maximum(n, len(a[0]))) & (n > 0) & (len(a[0]) > 0)
        out = [False] * len(others)
        places = np.flatnonzero(fits)
        if not len(places):
            return out
        k = np.stack([others[i][1] for i in places])
        # With BASE near 1, the share of equal registers is close to the likeness.
        close = (k == a[1]).sum(axis=1) >= (self.least - self.sigma) * self.m
        k, places = k[close], places[close]
        if not len(places):
            return out
        near = likeness((a[1] > k).sum(axis=1), (a[1] < k).sum(axis=1), self.m, np.full(len(places), len(a[0])), n[places])
        for i in places[near >= self.least]:
            h = others[i][0]
            at = np.searchsorted(h, a[0])
            both = int((h[np.minimum(at, len(h) - 1)] == a[0]).sum())
            out[i] = self.den * both >= self.num * (len(h) + len(a[0]) - both)
        return out


def _cells(batches: Iterator[pd.DataFrame], sets: Sets) -> Iterator[pd.DataFrame]:
    """Rows by cell, role 0 first: each role-1 row is tested against the role-0 rows.

    Labels that are already equal need no test, and within a cell none that links have
    made equal.  At most a link for each row of the cell comes out.
    """
    at, heads, up = None, [], {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for pdf in batches:
        out = []
        for g, i, j, role, doc, label, text in zip(pdf["g"].tolist(), pdf["i"].tolist(), pdf["j"].tolist(), pdf["role"].tolist(), pdf["doc_id"].tolist(), pdf["label"].tolist(), pdf["text"].tolist(), strict=True):
            if (g, i, j) != at:
                at, heads, up = (g, i, j), [], {}
            if role == 0:
                heads.append((doc, label, sets.of(text)))
                continue
            others = [h for h in heads if root(h[1]) != root(label)]
            if not others:
                continue
            own = sets.of(text)
            for h, yes in zip(others, sets.linked(own, [h[2] for h in others]), strict=True):
                if yes and root(h[1]) != root(label):
                    out.append((h[0], doc))
                    up[root(h[1])] = root(label)
        yield pd.DataFrame(out, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})


def _verify(asked: DataFrame, nodes: DataFrame, texts: DataFrame, sets: Sets) -> DataFrame:
    """asked: (g, i, j, role, doc_id, label), a cell being (g, i, j)."""
    n = partitions(asked.sparkSession)
    asked = asked.join(nodes.select(F.col("node").alias("doc_id"), "k").hint("merge"), "doc_id")
    rows = texts.select("k", "text").join(asked.hint("merge"), "k").repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j", "role", "doc_id")
    return rows.select("g", "i", "j", "role", "doc_id", "label", "text").mapInPandas(lambda b: _cells(b, sets), "a long, b long")


def _star_cells(stars: DataFrame) -> DataFrame:
    """(a, b, la, lb): cells of a and at most about CELL of its b."""
    salts = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("s"), F.first("la").alias("la"))
    heads = salts.select(F.col("a").alias("g"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("role"), F.col("a").alias("doc_id"), F.col("la").alias("label"))
    tails = stars.join(salts.select("a", "s").hint("merge"), "a").select(F.col("a").alias("g"), F.pmod(F.xxhash64("b"), F.col("s")).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("role"), F.col("b").alias("doc_id"), F.col("lb").alias("label"))
    return heads.unionAll(tails)


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text)).alias("k")


def _sketched(texts: DataFrame, sets: Sets, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(k, n, node) of every text, and a node for each distinct set: (node, doc, k, n, regs),
    doc and k being its smallest id and that text.  Node numbers mean nothing else.

    texts: k, doc (smallest id, perhaps null), text.
    """

    def sketch(batches):
        for pdf in batches:
            done = [sets.of(t) for t in pdf["text"]]
            yield pd.DataFrame({"k": pdf["k"], "doc": pdf["doc"], "n": [len(h) for h, _ in done], "set": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h, _ in done], "regs": [k.astype(">u2").tobytes() for _, k in done]})
        trim()

    table = ws.store(id_out(texts.select("k", id_in("doc", "doc"), "text").mapInPandas(sketch, "k binary, doc long, n long, set binary, regs binary"), "doc"), "sketches")
    nodes = table.filter("doc is not null").groupBy("set").agg(F.min(F.struct("doc", "k")).alias("m"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = ws.store(nodes.select(F.monotonically_increasing_id().alias("node"), "m.doc", "m.k", "n", "regs", "set"), "nodes")
    return table.select("k", "n", "set").join(nodes.select("set", "node"), "set", "left").select("k", "n", "node"), nodes


def _linked(nodes: DataFrame, texts: DataFrame, sets: Sets, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join all nodes of a component, of both rounds, and their labels."""
    bands, rows = bands_for(sets.num / sets.den)
    width = 2 * rows
    keyed = nodes.select("node", "regs", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("b")).select("node", F.expr(f"xxhash64(b, substring(regs, b * {width} + 1, {width}))").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("node").alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    stars = ws.store(keyed.join(pivots.hint("merge"), "key").filter("node > p").select("p", "node").distinct(), "stars")
    ws.release()
    cells = _star_cells(stars.select(F.col("p").alias("a"), F.col("node").alias("b"), F.col("p").alias("la"), F.col("node").alias("lb")))
    links = ws.store(_verify(cells, nodes, texts, sets), "links")
    return _second_round(stars, links, nodes, texts, sets, ws)


def _labelled(df: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """df with the label of a node column; a node without links is its own."""
    found = labels.select(F.col("node").alias(node), F.col("label").alias("_l"))
    return df.join(found.hint("merge"), node, "left").withColumn(label, F.coalesce("_l", node)).drop("_l")


def _second_round(stars: DataFrame, links: DataFrame, nodes: DataFrame, texts: DataFrame, sets: Sets, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Adds the links between components whose nodes met the same pivot, but not each other."""
    labels = components(links, ws, "labels")
    both = ws.store(_labelled(_labelled(stars, labels, "p", "lp"), labels, "node", "ln"), "both")
    several = both.groupBy("p").agg(F.min("ln").alias("lo"), F.max("ln").alias("hi")).filter("lo <> hi").select("p")
    if not several.take(1):
        return links, labels
    members = both.join(several, "p").select("p", "node", F.col("ln").alias("label"))
    sizes = members.groupBy("p", "label").agg(F.count(F.lit(1)).alias("c"))
    shape = sizes.groupBy("p").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("c"))
    shape = shape.select("p", F.col("m.label").alias("big"), F.ceil((F.col("c") - F.col("m.c")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("c") / BLOCK).cast("int").alias("all"))
    rows = members.join(shape, "p").join(nodes.select("node", "n", "regs"), "node")
    i, j = F.pmod(F.xxhash64("node"), F.col("few")).cast("int"), F.pmod(F.xxhash64("node"), F.col("all")).cast("int")
    small = F.col("label") != F.col("big")
    tail = ["node", "label", small.alias("small"), "n", "regs"]
    heads = rows.filter(small).select("p", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(0).alias("role"), *tail)
    tails = rows.select("p", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), j.alias("j"), F.lit(1).alias("role"), *tail)
    cells = heads.unionAll(tails).repartition(partitions(stars.sparkSession), "p", "i", "j").sortWithinPartitions("p", "i", "j", "role", "node")
    met = ws.store(cells.mapInPandas(lambda b: _sketch_cells(b, sets), "g long, i int, j int, role int, doc_id long, label long"), "met")
    ws.drop("both")
    if not met.take(1):
        return links, labels
    links = links.unionAll(ws.store(_verify(met, nodes, texts, sets), "links2"))
    return links, components(links, ws, "labels")


def _sketch_cells(batches: Iterator[pd.DataFrame], sets: Sets) -> Iterator[pd.DataFrame]:
    """Rows by cell, role 0 first -> those that may reach the threshold with a row of the
    other role and another label."""
    columns = ["g", "i", "j", "role", "doc_id", "label"]
    at, heads, have, hit = None, [], None, None

    def done():
        return [] if hit is None else [(*at, 0, int(have[0][x]), int(have[1][x])) for x in np.flatnonzero(hit)]

    for pdf in batches:
        out: list[tuple] = []
        regs = np.frombuffer(b"".join(pdf["regs"]), ">u2").reshape(len(pdf), -1).astype(np.uint16)
        for r, (p, i, j, role, node, label, small, n) in enumerate(zip(*(pdf[c].tolist() for c in ("p", "i", "j", "role", "node", "label", "small", "n")), strict=True)):
            if (p, i, j) != at:
                out += done()
                at, heads, have, hit = (p, i, j), [], None, None
            if role == 0:
                heads.append((node, label, n, regs[r]))
                continue
            if not heads:
                continue
            if have is None:
                have = [np.array([h[c] for h in heads]) for c in range(3)] + [np.stack([h[3] for h in heads])]
                hit = np.zeros(len(heads), bool)
            ids, labels, sizes, k = have
            fits = (np.minimum(sizes, n) * sets.den >= sets.num * np.maximum(sizes, n)) & (labels != label)
            if small:  # both are heads: the pair counts once
                fits &= ids < node
            places = np.flatnonzero(fits)
            if len(places):
                some = k[places]
                close = (some == regs[r]).sum(axis=1) >= (sets.least - sets.sigma) * sets.m
                some, places = some[close], places[close]
            if len(places):
                near = likeness((regs[r] > some).sum(axis=1), (regs[r] < some).sum(axis=1), sets.m, np.full(len(places), n), sizes[places])
                places = places[near >= sets.least]
            if len(places):
                hit[places] = True
                out.append((p, i, j, 1, node, label))
        yield pd.DataFrame(out, columns=columns).astype({"g": "int64", "i": "int32", "j": "int32", "role": "int32", "doc_id": "int64", "label": "int64"})
    if hit is not None and hit.any():
        yield pd.DataFrame(done(), columns=columns)


def classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Links hold for sets with den * |A and B| >= num * |A or B|.  Null, empty and blank
    texts have empty sets and are linked with nothing.  Rows with equal texts are one
    class.  Rows that share a doc_id are one node, whatever their texts: all get the
    component that any of their texts reaches.  Rows without an id are never linked:
    component_id null, kept true.  An empty table gives an empty result; texts are used
    whole, whatever their length; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    ws = Workspace(spark)
    sets = Sets(words, num, den)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    real = slim.filter(has_words(F.col("text"))).select(_key(F.col("text")), "doc_id", "text")
    texts = ws.bucketed(real.groupBy("k").agg(F.min("doc_id").alias("doc"), F.first("text").alias("text")), "texts", "k", partitions(spark))
    ws.release()
    of_text, nodes = _sketched(texts, sets, ws)
    links, labels = _linked(nodes, texts, sets, ws)
    found = slim.select("doc_id", _key(F.col("text"))).join(of_text.select("k", "n", "node").hint("merge"), "k", "left")
    found = ws.store(found.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), "node"), "found")
    ws.keep_only("found", "nodes", "links", "links2", "labels")
    shared = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    if shared.take(1):
        shared = found.join(shared.select("doc_id", "a"), "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
        labels = components(links.unionAll(shared), ws, "shared")
    named = _labelled(nodes.select("node", "doc", "k"), labels, "node", "label")
    of_node = named.select("node", "label").join(_groups(named).select("label", F.col("m.doc").alias("first")), "label").select("node", "first")
    done = ws.store(found.join(of_node, "node", "left").select("doc_id", "n_shingles", "first"), "named")
    # Blank rows of an id that has other texts, too.
    mixed = done.filter("doc_id is not null").groupBy("doc_id").agg(F.min("first").alias("of_id"), F.max(F.col("first").isNull()).alias("blank")).filter("blank and of_id is not null")
    done = done.join(mixed.select("doc_id", "of_id"), "doc_id", "left")
    done = done.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "of_id", "doc_id")).alias("component_id"))
    done = ws.store(done, "classes")  # three numbers a document; all other tables can go
    ws.keep_only("classes")
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _groups(named: DataFrame) -> DataFrame:
    """Of each label the smallest id, with its text: m.doc, m.k."""
    return named.groupBy("label").agg(F.min(F.struct("doc", "k")).alias("m"))


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def deduplicate(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: the smallest id; ties by the text's MD5.

    Groups are made by texts, not by ids: where an id is repeated with other texts, each
    of its texts stands for itself, so none is lost that isn't near to a kept one.  Of
    repeated rows the smallest stays (by all columns).  Rows without an id, and null,
    empty and blank texts, are copies of nothing and stay.  All columns are returned as
    they are, whatever their names; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    ws = Workspace(spark)
    sets = Sets(words, num, den)
    own = lambda c: F.col("`" + c.replace("`", "``") + "`")
    in_play = own(id_col).cast("long").isNotNull() & has_words(own(text_col))
    order = F.struct(own(id_col).cast("long"), *[own(f.name) for f in docs.schema.fields if _comparable(f.dataType)])
    real = docs.filter(in_play).select(_key(own(text_col)), own(id_col).cast("long").alias("doc"), order.alias("order"), F.struct(*[own(c) for c in docs.columns]).alias("row"))
    rows = ws.bucketed(real.groupBy("k").agg(F.min("doc").alias("doc"), F.min_by("row", "order").alias("row")), "rows", "k", partitions(spark))
    ws.release()
    texts = rows.select("k", "doc", F.col("row")[text_col].alias("text"))
    _, nodes = _sketched(texts, sets, ws)
    _, labels = _linked(nodes, texts, sets, ws)
    stay = _groups(_labelled(nodes.select("node", "doc", "k"), labels, "node", "label")).select("m.k")
    kept = rows.join(stay.hint("merge"), "k", "left_semi").select("row.*")
    kept = ws.store(kept.unionAll(docs.filter(~in_play)), "kept")
    ws.keep_only("kept")
    return kept
