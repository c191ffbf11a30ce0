"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

Equal vectors are folded first, so a vector that a third of all rows share is one entry.
The top of the tree is grown on a bounded sample by the driver.  Each of its leaves that
holds more than SPLIT vectors gets a subtree, grown by a task from a bounded sample of the
leaf, so leaves stay small however large the table is: the driver never sees them.

A query walks the top with a priority queue of unopened nodes, nearest centre first, and
the subtrees of the leaves it opens in the same way; of all leaves met the nearest are
visited.  How many is calibrated: for a few queries the true neighbours are found by brute
force in one pass, and leaf visits are widened until RECALL of them lie in visited leaves.
Distances are exact.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Workspace, partitions, prepare

SAMPLE, BRANCH, LEAF, ROUNDS = 65_536, 12, 48, 8
CALIBRATION, RECALL = 64, 0.95
#: A top leaf with more vectors is split; a leaf of a subtree holds about CELL; a task deals
#: at most about SPREAD vectors of one top leaf; numbers that a sample may hold.
SPLIT, CELL, SPREAD, NUMBERS = 8192, 2048, 65_536, 1 << 23
#: Queries whose best a task holds.
HELD = 50_000


def grow(x: np.ndarray, most: int | None = None, seed: int = 5) -> dict:
    """Nodes as arrays: centres, children lists (leaves have none), leaf numbers, leaf sizes.

    most: rows of a leaf; left out, there are about as many leaves as rows in one.
    """
    rng = np.random.default_rng(seed)
    centres, children, leaf, sizes = [x.mean(axis=0)], [[]], [-1], []
    most = max(LEAF, int(len(x) ** 0.5)) if most is None else most
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        split = None
        if len(rows) > most:
            split = _kmeans(x[rows], min(BRANCH, -(-len(rows) // most) + 1), rng)
        if split is None:
            leaf[node] = len(sizes)
            sizes.append(len(rows))
            continue
        mids, own = split
        for c in range(len(mids)):
            children[node].append(len(centres))
            todo.append((len(centres), rows[own == c]))
            centres.append(mids[c])
            children.append([])
            leaf.append(-1)
    return {"centres": np.array(centres), "children": [np.array(c, np.int64) for c in children], "leaf": np.array(leaf), "leaves": len(sizes), "sizes": sizes}


def _kmeans(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray] | None:
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return None
    mids = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        own = (((mids**2).sum(axis=1))[None, :] - 2 * x @ mids.T).argmin(axis=1)
        used = np.unique(own)
        mids = np.array([x[own == c].mean(axis=0) for c in used])
    own = (((mids**2).sum(axis=1))[None, :] - 2 * x @ mids.T).argmin(axis=1)
    used, own = np.unique(own, return_inverse=True)
    return (mids[used], own) if len(used) > 1 else None


def deal(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row: at each node on to the nearest child."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        kids = tree["children"][node]
        if not len(rows):
            continue
        if not len(kids):
            out[rows] = tree["leaf"][node]
            continue
        c = tree["centres"][kids]
        own = ((x[rows, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        todo += [(int(kids[i]), rows[own == i]) for i in range(len(kids))]
    return out


def leaf_order(tree: dict, q: np.ndarray) -> Iterator[tuple[int, float]]:
    """Leaves, with their squared distances, best bin first: the nearest unopened node is opened next."""
    queue = [(0.0, 0)]
    while queue:
        d, node = heapq.heappop(queue)
        kids = tree["children"][node]
        if not len(kids):
            yield int(tree["leaf"][node]), d
            continue
        far = ((tree["centres"][kids] - q) ** 2).sum(axis=1)
        for d, k in zip(far.tolist(), kids.tolist(), strict=True):
            heapq.heappush(queue, (d, k))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(-1, dim)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def best(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest (distance, id)."""
    if len(d) > 4 * k:
        edge = np.partition(d, k - 1)[k - 1]
        some = np.flatnonzero(d <= edge)
        return some[np.lexsort((ids[some], d[some]))[:k]]
    return np.lexsort((ids, d))[:k]


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


_QUERY = "h long, h2 int, v array<double>"


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows, nearest first.

    score is the Euclidean distance in double precision; ties go to the smaller id.
    Rows whose vector is null, empty, zero, of another length than most usable vectors,
    or holds null or non-finite components, and rows without an id, take no part.
    Every row but one of the query's own is a candidate, so a repeated query row meets its
    copy at distance 0, and repeated rows count each.  Repeated query rows (equal id and
    vector) are asked once; two vectors of one id are two queries, a list for each.
    Fewer than k candidates: all of them.  Other columns are ignored.

    Index: its top is fitted on at most `sample` distinct vectors chosen by a hash (and at
    most NUMBERS components), each subtree on at most as many of its leaf; every vector is
    dealt to a leaf.
    """
    spark = prepare(vectors.sparkSession)
    ws, n = Workspace(spark), partitions(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    own = own.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("h", F.xxhash64("v")).withColumn("h2", F.hash("v"))
    lengths = own.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0].dim
    own = own.filter(F.size("v") == dim)
    most = max(1, min(sample, max(LEAF, NUMBERS // dim)))

    # Of equal vectors only the k + 1 smallest ids can be among anybody's nearest.
    order = Window.partitionBy("h", "h2").orderBy("vec_id")
    few = own.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    folded = ws.store(few.groupBy("h", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "folded")
    asking = ws.store(own.filter("asks").select("vec_id", "h", "h2", "v").dropDuplicates(["vec_id", "h", "h2"]), "asking")
    asked = asking.groupBy("h", "h2").agg(F.first("v").alias("v"))

    share = min(1.0, 2 * most / max(1, folded.count()))  # so that no task sorts more than it must
    some = folded.filter(F.pmod(F.xxhash64("h", F.lit(7)), F.lit(1 << 31)) <= int(share * (1 << 31)))
    fitted = some.orderBy("h", "h2").limit(most).select("v").toPandas()  # bounded by sample and NUMBERS
    tree = grow(_matrix(fitted["v"], dim))

    def to_leaf(batches):
        for pdf in batches:
            yield pdf.assign(leaf=deal(tree, _matrix(pdf["v"], dim)).astype(np.int32))

    dealt = ws.store(folded.mapInPandas(to_leaf, "h long, h2 int, v array<double>, ids array<long>, leaf int"), "dealt")
    ws.drop("folded")
    sizes = {r.leaf: r.n for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row a top leaf
    large = {leaf: c for leaf, c in sizes.items() if c > SPLIT}
    if large:
        subtrees = ws.store(_subtrees(dealt, large, most, dim), "subtrees")
        dealt = ws.store(_deal_again(dealt, subtrees, large, dim, n), "cells")
        ws.drop("dealt")
    else:
        subtrees, dealt = None, dealt.withColumn("cell", F.lit(0))

    def visits(queries: DataFrame, opened: int) -> DataFrame:
        """(h, h2, leaf, cell, near): the `opened` nearest leaves of each query, and more while
        they don't hold enough rows."""
        return _visits(queries, tree, subtrees, sizes, large, dim, opened, k + 1, n)

    opened = _calibrate(dealt, asked, visits, k, dim, recall)
    parts = dealt.select("leaf", "cell", F.lit(0).alias("kind"), "h", "h2", "v", "ids")
    met = visits(asked, opened).join(asked, ["h", "h2"]).select("leaf", "cell", F.lit(1).alias("kind"), "h", "h2", "v", F.lit(None).cast("array<long>").alias("ids"))
    parts = parts.unionAll(met).repartition(n, "leaf", "cell").sortWithinPartitions("leaf", "cell", "kind")
    near = parts.mapInPandas(lambda batches: _meet(batches, dim, k + 1), "h long, h2 int, vec_id long, score double, same boolean")
    order = Window.partitionBy("h", "h2").orderBy("score", "vec_id")
    near = ws.store(near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n"), "near")
    # Back to the rows that ask: one occurrence of the own row is left out.
    order = Window.partitionBy("query_id", "h", "h2").orderBy("score", "vec_id")
    own_row = F.sum((F.col("same") & (F.col("vec_id") == F.col("query_id"))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    done = asking.select(F.col("vec_id").alias("query_id"), "h", "h2").join(near, ["h", "h2"])
    done = done.select("query_id", "vec_id", "score", F.row_number().over(order).alias("n"), own_row.alias("own"), (F.col("same") & (F.col("vec_id") == F.col("query_id"))).alias("is_own"))
    done = done.filter(~(F.col("is_own") & (F.col("own") == 1))).withColumn("rank", F.col("n") - F.least("own", F.lit(1)))
    done = ws.store(done.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found")
    ws.keep_only("found")
    return done


def _subtrees(dealt: DataFrame, large: dict, most: int, dim: int) -> DataFrame:
    """(leaf, tree): a pickled subtree of each large leaf, with the cells of each of its leaves."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = int(pdf["leaf"].iloc[0])
        x = _matrix(pdf.sort_values(["h", "h2"])["v"], dim)
        share = len(x) / large[leaf]
        tree = grow(x, max(2, int(CELL * share)))
        # Cells of the leaves that k-means can't split further, by the share of the sample.
        tree["cells"] = np.maximum(1, np.ceil(np.array(tree["sizes"]) / share / (2 * CELL))).astype(np.int64)
        return pd.DataFrame({"leaf": [leaf], "tree": [pickle.dumps(tree)]})

    order = Window.partitionBy("leaf").orderBy("h", "h2")
    some = dealt.filter(F.col("leaf").isin(list(large))).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return some.select("leaf", "h", "h2", "v").groupBy("leaf").applyInPandas(fit, "leaf int, tree binary")


def _with_trees(rows: DataFrame, subtrees: DataFrame, large: dict, n: int) -> DataFrame:
    """Rows of large leaves dealt over tasks, each part behind the subtree of its leaf."""
    spark = rows.sparkSession
    tasks = {leaf: -(-c // SPREAD) for leaf, c in large.items()}
    of_leaf = F.create_map(*[F.lit(x) for kv in tasks.items() for x in kv])  # at most a row a top leaf
    trees = subtrees.select("leaf", F.explode(F.sequence(F.lit(0), of_leaf[F.col("leaf")] - 1)).alias("task"), F.lit(0).alias("kind"), "tree", F.lit(0).cast("long").alias("h"), F.lit(0).alias("h2"))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("h", F.lit(3)), of_leaf[F.col("leaf")]).cast("int")).withColumn("kind", F.lit(1))
    return trees.unionByName(rows, allowMissingColumns=True).repartition(n, "leaf", "task").sortWithinPartitions("leaf", "task", "kind")


def _deal_again(dealt: DataFrame, subtrees: DataFrame, large: dict, dim: int, n: int) -> DataFrame:
    """dealt with `cell`: 0 in small leaves, else a number that the subtree gives."""

    def run(batches):
        tree, first = None, None
        for pdf in batches:
            out = []
            for leaf, g in pdf.groupby("leaf", sort=False):
                for blob in g.loc[g["kind"] == 0, "tree"]:
                    tree = pickle.loads(blob)
                    first = np.concatenate([[0], np.cumsum(tree["cells"])])
                g = g[g["kind"] == 1]
                if len(g):
                    sub = deal(tree, _matrix(g["v"], dim))
                    part = (g["h"].to_numpy().astype(np.uint64) >> np.uint64(20)).astype(np.int64) % tree["cells"][sub]
                    out.append(g[["h", "h2", "v", "ids", "leaf"]].assign(cell=(first[sub] + part).astype(np.int32)))
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("h", "h2", "v", "ids", "leaf", "cell")})

    schema = "h long, h2 int, v array<double>, ids array<long>, leaf int, cell int"
    inside = F.col("leaf").isin(list(large))
    return _with_trees(dealt.filter(inside), subtrees, large, n).select("leaf", "kind", "tree", "h", "h2", "v", "ids").mapInPandas(run, schema).unionAll(dealt.filter(~inside).withColumn("cell", F.lit(0)))


def _visits(queries: DataFrame, tree: dict, subtrees: DataFrame | None, sizes: dict, large: dict, dim: int, opened: int, least: int, n: int) -> DataFrame:
    def top(batches):
        for pdf in batches:
            out = []
            for h, h2, v, q in zip(pdf["h"], pdf["h2"], pdf["v"], _matrix(pdf["v"], dim), strict=True):
                count = 0
                for at, (leaf, d) in enumerate(leaf_order(tree, q)):
                    if at >= opened and count >= least:
                        break
                    count += sizes.get(leaf, 0)
                    out.append((h, h2, v if leaf in large else None, leaf, d, float(sizes.get(leaf, 0))))
            yield pd.DataFrame(out, columns=["h", "h2", "v", "leaf", "near", "rows"])

    found = queries.select("h", "h2", "v").mapInPandas(top, _QUERY + ", leaf int, near double, rows double")
    if subtrees is None:
        return found.select("h", "h2", "leaf", F.lit(0).alias("cell"), "near")

    def below(batches):
        sub, first = None, None
        for pdf in batches:
            out = []
            for kind, leaf, blob, h, h2, v in zip(*(pdf[c] for c in ("kind", "leaf", "tree", "h", "h2", "v")), strict=True):
                if kind == 0:
                    sub = pickle.loads(blob)
                    first = np.concatenate([[0], np.cumsum(sub["cells"])])
                    continue
                for at, (s, d) in enumerate(leaf_order(sub, np.asarray(v, np.float64))):
                    if at >= opened:
                        break
                    out += [(h, h2, leaf, c, d, float(sub["sizes"][s] > 0)) for c in range(first[s], first[s + 1])]
            yield pd.DataFrame(out, columns=["h", "h2", "leaf", "cell", "near", "rows"])

    inside = F.col("leaf").isin(list(large))
    deep = _with_trees(found.filter(inside).select("h", "h2", "v", "leaf"), subtrees, large, n).select("leaf", "kind", "tree", "h", "h2", "v").mapInPandas(below, "h long, h2 int, leaf int, cell int, near double, rows double")
    both = deep.unionAll(found.filter(~inside).select("h", "h2", "leaf", F.lit(0).alias("cell"), "near", "rows"))
    # Cells of one leaf share its distance, so they are opened together.
    order = Window.partitionBy("h", "h2").orderBy("near", "leaf")
    before = F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("n", F.dense_rank().over(order)).withColumn("before", F.coalesce(before, F.lit(0.0)))
    return both.filter((F.col("n") <= opened) | (F.col("before") < least)).select("h", "h2", "leaf", "cell", "near")


def _meet(batches: Iterator[pd.DataFrame], dim: int, k: int) -> Iterator[pd.DataFrame]:
    """Rows by cell, vectors first: each query keeps its k best of the task's cells."""
    at, held = None, []
    kept: dict[tuple, tuple] = {}

    def done():
        names = [x[0] for x in kept.values()]
        count = [len(x) for x in names]
        return pd.DataFrame({"h": np.repeat(np.array([q[0] for q in kept], np.int64), count), "h2": np.repeat(np.array([q[1] for q in kept], np.int32), count), "vec_id": np.concatenate(names), "score": np.concatenate([x[1] for x in kept.values()]), "same": np.concatenate([x[2] for x in kept.values()])})

    for pdf in batches:
        for (leaf, cell, kind), g in pdf.groupby(["leaf", "cell", "kind"], sort=False):
            if (leaf, cell) != at:
                at, held = (leaf, cell), []
            if kind == 0:
                held.append((g["h"].to_numpy(), g["h2"].to_numpy(), _matrix(g["v"], dim), g["ids"].tolist()))
                continue
            if not held:
                continue
            if len(held) > 1:
                held = [(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), [i for x in held for i in x[3]])]
            h, h2, xs, ids = held[0]
            least = np.array([i[0] for i in ids])
            for qh, qh2, q in zip(g["h"].tolist(), g["h2"].tolist(), _matrix(g["v"], dim), strict=True):
                d = distances(q, xs)
                some = best(least, d, k)  # k groups of equal vectors hold the k nearest rows
                names = np.concatenate([ids[i] for i in some]).astype(np.int64)
                far = np.repeat(d[some], [len(ids[i]) for i in some])
                same = np.repeat((h[some] == qh) & (h2[some] == qh2), [len(ids[i]) for i in some])
                if (qh, qh2) in kept:
                    names, far, same = (np.concatenate(x) for x in zip(kept[qh, qh2], (names, far, same), strict=True))
                some = best(names, far, k)
                kept[qh, qh2] = (names[some], far[some], same[some])
            if len(kept) > HELD:
                yield done()
                kept.clear()
    if kept:
        yield done()


def _calibrate(dealt: DataFrame, asked: DataFrame, visits, k: int, dim: int, recall: float) -> int:
    """Leaves to visit so that `recall` of the true neighbours of some queries lie in them."""
    some = asked.orderBy("h", "h2").limit(CALIBRATION)
    held = some.toPandas()  # bounded
    if not len(held):
        return 1
    qs, names = _matrix(held["v"], dim), list(zip(held["h"].tolist(), held["h2"].tolist(), strict=True))

    def nearest(batches):
        """Of each task's rows, the k nearest of each calibration query."""
        kept: list = [None] * len(qs)
        for pdf in batches:
            x, h, h2 = _matrix(pdf["v"], dim), pdf["h"].to_numpy(), pdf["h2"].to_numpy()
            place = np.column_stack([pdf["leaf"].to_numpy(), pdf["cell"].to_numpy()])
            for i, q in enumerate(qs):
                other = (h != names[i][0]) | (h2 != names[i][1])
                d, a, b = distances(q, x[other]), h[other], place[other]
                if kept[i] is not None:
                    d, a, b = (np.concatenate([m, n]) for m, n in zip(kept[i], (d, a, b), strict=True))
                top = best(a, d, k)
                kept[i] = (d[top], a[top], b[top])
        for i, found in enumerate(kept):
            if found is not None:
                yield pd.DataFrame({"q": np.int32(i), "d": found[0], "id": found[1], "leaf": found[2][:, 0], "cell": found[2][:, 1]})

    order = Window.partitionBy("q").orderBy("d", "id")
    true = dealt.mapInPandas(nearest, "q int, d double, id long, leaf int, cell int").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).collect()
    if not true:
        return 1
    opened, met = 8, -1
    while True:  # wider and wider, until enough is met or there is nothing more to open
        rows = visits(some, opened).collect()  # about `opened` for each of the bounded queries
        rank: dict[tuple, int] = {}
        order_of: dict[tuple, dict] = {}
        for r in sorted(rows, key=lambda r: (r.near, r.leaf)):
            seen = order_of.setdefault((r.h, r.h2), {})
            rank[r.h, r.h2, r.leaf, r.cell] = seen.setdefault((r.near, r.leaf), len(seen) + 1)
        found = np.sort([rank.get((*names[t.q], t.leaf, t.cell), np.iinfo(np.int64).max) for t in true])
        need = int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)])
        if need < np.iinfo(np.int64).max:
            return need
        if len(rows) == met:
            return opened
        opened, met = opened * 2, len(rows)
