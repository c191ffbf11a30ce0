"""Language identification with a string kernel.

Two texts are compared by the code-point n-grams (lengths 1 to ORDERS, together: the
blended spectrum) that both hold: k(x, y) = |x and y| / sqrt(|x| |y|).  N-grams are hashed
to 2^BITS numbers for each length, which whole texts don't fill.  LANDMARKS training texts
span the feature space (Nystroem) and one ridge regression per language is solved in it.
A text's kernel values with the landmarks enter its scores only through their weighted
sum, so the weights of the landmarks are first summed for each n-gram; a batch of texts is
then scored by one product of its sparse presence matrix with that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Workspace, bounded_sample, id_in, id_out, prepare, windows

ORDERS, BITS, LANDMARKS, RIDGE, TRAIN_ROWS = 4, 18, 128, 1e-2, 4000
DIM = ORDERS << BITS


def presence(text: str) -> np.ndarray:
    """The sorted numbers of the n-grams that the whole text holds."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found = [(windows(cp, n) >> np.uint64(64 - BITS)).astype(np.uint32) + np.uint32((n - 1) << BITS) for n in range(1, ORDERS + 1) if len(cp) >= n]
    if not found:
        return np.zeros(0, np.uint32)
    x = np.concatenate(found)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def kernel(sets: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """k(x, y) for all x of sets and y of marks."""
    flags = np.zeros(DIM, bool)
    out = np.zeros((len(sets), len(marks)))
    for j, y in enumerate(marks):
        flags[y] = True
        out[:, j] = [np.count_nonzero(flags[x]) / np.sqrt(max(len(x) * len(y), 1)) for x in sets]
        flags[y] = False
    return out


def landmarks(langs: list[str], most: int | None = None) -> np.ndarray:
    """Places of the landmarks, dealt to the languages in turn."""
    y = np.array(langs)
    turn = np.zeros(len(y), np.int64)
    for c in np.unique(y):
        turn[y == c] = np.arange((y == c).sum())
    return np.lexsort((np.arange(len(y)), turn))[: most or LANDMARKS]


def fit(marks: list[np.ndarray], k: np.ndarray, langs: list[str]) -> dict:
    """marks: the landmarks' n-grams; k: a row of kernel values for each training text."""
    classes = sorted(set(langs))
    y = np.array([classes.index(x) for x in langs])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = k @ root
    mean = z.mean(axis=0)
    target = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    offset = target.mean(axis=0)
    weights = np.linalg.solve((z - mean).T @ (z - mean) + RIDGE * len(y) / 100 * np.eye(z.shape[1]), (z - mean).T @ (target - offset))
    dual = root @ weights
    grams = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint32)
    table = np.zeros((len(grams), len(classes)))
    for x, a in zip(marks, dual, strict=True):
        table[np.searchsorted(grams, x)] += a / np.sqrt(max(len(x), 1))
    return {"classes": classes, "grams": grams, "table": table, "offset": offset - mean @ weights}


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.place = np.full(DIM, -1, np.int32)
        self.place[model["grams"]] = np.arange(len(model["grams"]), dtype=np.int32)

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        """Presence matrix by table: the rows of each text's n-grams are summed."""
        table = self.model["table"]
        out = np.zeros((len(sets), table.shape[1]))
        for i, x in enumerate(sets):
            at = self.place[x]
            out[i] = table[at[at >= 0]].sum(axis=0) / np.sqrt(max(len(x), 1))
        return out + self.model["offset"]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of the largest margin (ties: the first in the alphabet) and its share."""
        margin = self.margins([presence(t) for t in texts])
        p = np.exp(3 * (margin - margin.max(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = margin.argmax(axis=1)
        return [self.model["classes"][i] for i in best], p[np.arange(len(best)), best]


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = TRAIN_ROWS) -> dict | None:
    """Fit on at most `limit` pairs of an id and a language for which `learn` holds.

    Of rows that repeat a pair the text with the smallest hash counts, and of equal hashes
    the smallest text.  None if there is nothing to learn from.
    """
    ws = Workspace(prepare(docs.sparkSession))
    slim = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    sample = bounded_sample(slim, limit, "doc_id", "lang").groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    sample = ws.store(sample.select("doc_id", "lang", F.col("m.text").alias("text")), "sample")
    keys = sorted((r.doc_id, r.lang) for r in sample.select("doc_id", "lang").collect())  # bounded by limit
    if not keys:
        return None
    chosen = {keys[i]: n for n, i in enumerate(landmarks([lang for _, lang in keys]))}
    ids = sorted({i for i, _ in chosen})
    rows = [(chosen[r.doc_id, r.lang], presence(r.text)) for r in sample.filter(F.col("doc_id").isin(ids)).toLocalIterator() if (r.doc_id, r.lang) in chosen]
    marks = [x for _, x in sorted(rows, key=lambda r: r[0])]

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = kernel([presence(t) for t in pdf["text"]], marks).astype(np.float32)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "k": [r.tobytes() for r in k]})

    found = {(r.doc_id, r.lang): bytes(r.k) for r in sample.mapInPandas(values, "doc_id long, lang string, k binary").collect()}  # LANDMARKS numbers a row
    ws.drop("sample")
    k = np.frombuffer(b"".join(found[key] for key in keys), np.float32).reshape(len(keys), -1).astype(float)
    return fit(marks, k, [lang for _, lang in keys])


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", *keep: Column) -> DataFrame:
    """doc_id, lang_pred, score for every row, after the `keep` columns.

    Null texts and texts without a letter give `und` with score 0, and so does every text
    if there was nothing to learn from.  Only the text enters a prediction, so repeated
    rows get equal results; equal margins go to the first language of the alphabet; very
    long texts count as a whole; an empty table gives an empty result; other columns are
    ignored.
    """
    prepare(docs.sparkSession)

    def score(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model) if model is not None else None
        for pdf in rows:
            lang, value = ["und"] * len(pdf), np.zeros(len(pdf))
            texts = pdf.pop("text").tolist()
            real = [i for i, t in enumerate(texts) if scorer is not None and has_letter(t)]
            if real:
                got, p = scorer.predict([texts[i] for i in real])
                for i, x, v in zip(real, got, p, strict=True):
                    lang[i], value[i] = x, v
            yield pdf.assign(lang_pred=lang, score=value)

    slim = docs.select(id_in(id_col), *keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    return id_out(slim.mapInPandas(score, schema + ", lang_pred string, score double"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
