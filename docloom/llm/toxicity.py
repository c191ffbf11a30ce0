"""Severity of toxicity by cumulative-link (proportional odds) regression.

Features are the presence of words and of their first 4, 5 and 6 letters; those that are
LIFT times as frequent in toxic texts, with a chi-squared against the label over a
threshold (at most FEATURES), are kept: what marks clean texts only by chance or by topic
must not outweigh an insult.  All
ordered thresholds share one weight vector: P(grade > k) = sigmoid(w.x - theta_k).  The
likeliest grade decides, and a text is toxic if it isn't 0.

Grades are the label's own values, in order: a table with 0, 1, 2, 3 gives three
thresholds.  The labels at hand hold 0 and 1 only, so the registered query has two grades
and one threshold, and its severity is the probability of the upper one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Workspace, bounded_sample, id_in, id_out, prepare

TRAIN_ROWS, FEATURES, CHI2, MIN_HITS, LIFT = 12_000, 1024, 28.0, 3, 4.0
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    found: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        found.add(w)
        for n in (4, 5, 6):
            if len(w) >= n:
                found.add(w[:n] + "-")
    return found


def _count(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pos: Counter[str] = Counter()
    neg: Counter[str] = Counter()
    for pdf in rows:
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            (pos if label else neg).update(features(text))
    names = list(pos)  # what never occurs in a toxic text can't be chosen
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        yield pd.DataFrame({"feature": some, "pos": [pos[x] for x in some], "neg": [neg[x] for x in some]})
    rest = [x for x in neg if x not in pos]
    for at in range(0, len(rest), 50_000):
        some = rest[at : at + 50_000]
        yield pd.DataFrame({"feature": some, "pos": 0, "neg": [neg[x] for x in some]})


def fit(x: np.ndarray, grades: np.ndarray, steps: int = 400, ridge: float = 1e-5) -> dict:
    """x: presence matrix; grades: 0..K-1.  Full-batch Adam on the ordinal likelihood."""
    k = int(grades.max()) + 1
    w = np.zeros(x.shape[1], np.float32)
    free = np.array([0.0] + [0.5] * (k - 2))  # theta_0, then log-free gaps
    above = np.array([max((grades > t).mean(), 1e-6) for t in range(k - 1)])
    free[0] = np.log((1 - above[0]) / above[0])
    m = [np.zeros_like(w), np.zeros_like(free)]
    v = [np.zeros_like(w), np.zeros_like(free)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        theta = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])
        s = (x @ w).astype(np.float64)
        up = np.column_stack([np.ones(len(s)), *[sigmoid(s - t) for t in theta], np.zeros(len(s))])  # P(grade >= g)
        low, high = up[np.arange(len(s)), grades + 1], up[np.arange(len(s)), grades]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high), low * (1 - low)
        ds = (d_high - d_low) / p
        grad_w = -(x.T @ ds.astype(np.float32)) / len(s) + ridge * w
        by = np.zeros(k - 1)
        for t in range(k - 1):
            by[t] = (np.where(grades == t, -d_low / p, 0) + np.where(grades == t + 1, d_high / p, 0)).sum() / len(s)
        grad_free = np.array([by.sum()] + [by[i:].sum() * np.exp(free[i]) for i in range(1, k - 1)])
        for i, (g, rate) in enumerate(((grad_w, 0.1), (grad_free, 0.05))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            change = rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
            if i:
                free -= change
            else:
                w -= change.astype(np.float32)
    theta = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])
    return {"weights": w, "theta": theta}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = TRAIN_ROWS) -> dict | None:
    """Fit on at most `limit` labelled ids; None if their labels hold only one grade or none.

    Labels are grades: numbers, of which only the order counts; below 0 counts as 0.  Of an
    id with several labels the largest counts; of an id with several texts the one with the
    smallest hash, and of equal hashes the smallest text.
    """
    ws = Workspace(prepare(docs.sparkSession))
    grade = F.greatest(F.col(label_col).cast("double"), F.lit(0.0))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), grade.alias("label"))
    known = bounded_sample(known, limit, "doc_id", "label").groupBy("doc_id").agg(F.max("label").alias("label"))  # bounded by limit
    slim = docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    one = slim.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    texts = ws.store(one.select("doc_id", F.col("label").alias("own"), (F.col("label") > 0).cast("int").alias("label"), F.col("m.text").alias("text")), "labelled")
    size = texts.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = texts.select("text", "label").mapInPandas(_count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    n = {r.label: r.n for r in size.collect()}
    if not n.get(0) or not n.get(1):
        return None
    a, b, c, d = F.col("p"), F.col("n"), F.lit(n[1]) - F.col("p"), F.lit(n[0]) - F.col("n")
    total = n[0] + n[1]
    gap = F.greatest(F.abs(a * d - b * c) - total / 2, F.lit(0.0))
    chi2 = total * gap * gap / (F.lit(float(n[0])) * n[1] * (a + b) * F.greatest(c + d, F.lit(1)))
    best = counts.withColumn("chi2", chi2).filter((F.col("chi2") >= CHI2) & (a + b >= MIN_HITS) & (a * float(n[0]) > LIFT * b * float(n[1]))).orderBy(F.desc("chi2"), "feature").limit(FEATURES).collect()
    if not best:
        return None
    place = {r.feature: i for i, r in enumerate(best)}

    def project(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            sets = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "own": pdf["own"], "at": [sorted(place[f] for f in s if f in place) for s in sets]})

    rows = texts.mapInPandas(project, "doc_id long, own double, at array<int>").collect()  # bounded by limit
    ws.drop("labelled")
    rows.sort(key=lambda r: r.doc_id)
    x = np.zeros((len(rows), len(place)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
    grades = np.unique([r.own for r in rows], return_inverse=True)[1].astype(np.int64)
    return fit(x, grades) | {"place": place}


def _scores(texts: list, model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """P(grade > k), a column for each threshold, and the likeliest grade (ties: the lowest)."""
    theta = model["theta"] if model else np.zeros(1)
    s = np.full(len(texts), -np.inf)
    if model:
        place, weights = model["place"], model["weights"].astype(np.float64)
        for i, t in enumerate(texts):
            if isinstance(t, str) and t:
                s[i] = sum(weights[place[f]] for f in sorted(features(t) & place.keys()))
    up = 1 / (1 + np.exp(-np.clip(s[:, None] - theta[None, :], -700, 40)))
    up[np.isneginf(s)] = 0
    return up, np.column_stack([1 - up[:, :1], up[:, :-1] - up[:, 1:], up[:, -1:]]).argmax(axis=1)


def severity(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (P(grade > 0)), grade, toxic per row.

    Null and empty texts, and every text if there was nothing to learn from, are clean
    with severity 0.  Only the text counts, so repeated rows get equal results; whole
    texts are used whatever their length; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def score(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            up, grade = _scores(pdf["text"].tolist(), model)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "severity": up.sum(axis=1), "p_toxic": up[:, 0], "grade": grade.astype(np.int32), "toxic": grade > 0})

    slim = docs.select(id_in(id_col), F.col(text_col).alias("text"))
    return id_out(slim.mapInPandas(score, "doc_id long, severity double, p_toxic double, grade int, toxic boolean"))


def reject(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, whatever their columns, that aren't toxic."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at).to_pylist(), model)[1] == 0))

    return docs.mapInArrow(keep, docs.schema)
