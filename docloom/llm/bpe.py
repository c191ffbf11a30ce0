"""BPE encoding and decoding over a distinct-word table.

The texts are split into words in Spark tasks.  Each task numbers the distinct words of
a block of documents and writes two things: the documents as word numbers, and the
block's word list, in buckets by a hash of the word.  Every distinct word is then encoded
once, wherever it occurs, and its ids go back to the blocks by (block, word number); ids
reach their places through the word numbers, which are the positions' keys.  Neither texts nor word positions are
ever shuffled: the numbered documents are bucketed by block when they are written.
Decoding maps ids to pieces by the id-to-piece table, whose size is the vocabulary's.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import NO_ID, Workspace, id_in, id_out, partitions, prepare, trim

#: Fixed values of the word tokenizer: white space by the Unicode property, and words.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
#: A block ends with the document that brings it to so many words, or so many distinct ones.
BLOCK_WORDS, BLOCK_DISTINCT = 1_000_000, 150_000
#: Words are dealt to so many tasks at most: a block has a row for each.
MOST_BUCKETS = 4096


@lru_cache(maxsize=4)
def _tokenizer(spec: bytes):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec.decode("utf-8"))
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=4)
def _word_encoder(spec: bytes):
    """The same tokenizer without the normalizer: its words are normalised already."""
    from tokenizers import Tokenizer, normalizers

    t = Tokenizer.from_str(spec.decode("utf-8"))
    t.no_padding()
    t.no_truncation()
    t.normalizer = normalizers.Sequence([])
    return t


def _specials(spec: bytes) -> dict[str, int]:
    import json

    return {x["content"]: x["id"] for x in json.loads(spec).get("added_tokens", [])}


class Splitter:
    """The words of a text, as the tokenizer's normalizer and pre-tokenizer make them.

    Texts in Latin letters are split by a regular expression; any other text goes
    through the tokenizer's own steps, whose Unicode tables may differ from Python's.
    A special token that stands in the text is a word of its own, marked by a blank in
    front; ordinary words never hold white space.
    """

    def __init__(self, spec: bytes):
        self.tok, specials = _tokenizer(spec), list(_specials(spec))
        self.find = regex.compile(WORD).findall
        self.other = regex.compile(r"[^\x00-\u024f]").search
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text.lower())
        if not self.other(text):
            return self.find(unicodedata.normalize("NFC", text).lower())
        text = self.tok.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(" " + part)
            elif part:
                out += self._plain(part)
        return out


def pack(a: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well when most are small."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def number_words(rows: Iterator[pd.DataFrame], part: int, spec: bytes, buckets: int) -> Iterator[pd.DataFrame]:
    """Rows of kind 0: a document as word numbers.  Rows of kind 1: those of a block's
    words that fall into a bucket (by a hash of the word), with their numbers."""
    split, count = Splitter(spec), 0

    def block_end(number: dict[str, int], docs: list):
        block = (part << 24) + count
        yield pd.DataFrame({"block": block, "kind": 0, "doc_id": [d for d, _ in docs], "codes": [c for _, c in docs], "bucket": 0, "words": None})
        words = np.array(list(number), object)
        own = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int64, len(words))
        order = np.argsort(own, kind="stable")
        ends = np.flatnonzero(np.diff(own[order], append=-1)) + 1
        out = []
        for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            some = order[a:b]  # ascending numbers: the gaps are small
            out.append((int(own[some[0]]), zlib.compress(pack(np.diff(some, prepend=0)), 3), zlib.compress("\n".join(words[some]).encode("utf-8", "surrogatepass"), 3)))
        if out:
            yield pd.DataFrame({"block": block, "kind": 1, "doc_id": NO_ID, "codes": [x[1] for x in out], "bucket": [x[0] for x in out], "words": [x[2] for x in out]})

    number: dict[str, int] = {}
    docs, seen = [], 0
    for pdf in rows:
        for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array, strict=True):
            words = split.words(text) if isinstance(text, str) else []
            codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words))
            docs.append((doc_id, pack(codes)))
            seen += len(words)
            if seen >= BLOCK_WORDS or len(number) >= BLOCK_DISTINCT:
                yield from block_end(number, docs)
                number, docs, seen, count = {}, [], 0, count + 1
    if docs:
        yield from block_end(number, docs)
    del number, docs
    trim()


def encode_words(rows: Iterator[pd.DataFrame], spec: bytes) -> Iterator[pd.DataFrame]:
    """All words of a bucket come here; each distinct one is encoded once, and its ids go
    to each block that asked."""
    tok, special = _word_encoder(spec), _specials(spec)
    bucket, known = None, {}
    for pdf in rows:
        out = []
        for own, raw in zip(pdf["bucket"].tolist(), pdf["words"].tolist(), strict=True):
            if own != bucket:
                bucket, known = own, {}
            words = zlib.decompress(raw).decode("utf-8", "surrogatepass").split("\n")
            fresh = [w for w in words if w not in known]
            plain = [w for w in fresh if w[0] != " "]
            for w, e in zip(plain, tok.encode_batch_fast(plain, add_special_tokens=False), strict=True):
                known[w] = e.ids
            for w in fresh:
                if w[0] == " ":
                    known[w] = [special[w[1:]]]
            ids = [known[w] for w in words]
            lens = np.fromiter(map(len, ids), np.uint32, len(ids))
            out.append((zlib.compress(pack(lens), 3), zlib.compress(pack(np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))), 3)))
        yield pd.DataFrame({"block": pdf["block"], "codes": pdf["codes"], "lens": [x[0] for x in out], "ids": [x[1] for x in out]})


def pieces(spec: bytes) -> list[str]:
    """The id-to-piece table as a list: place = id."""
    tok = _tokenizer(spec)
    table = [""] * (max(tok.get_vocab(True).values()) + 1)
    for piece, i in tok.get_vocab(True).items():
        table[i] = piece
    return table


def place_ids(docs: pd.DataFrame, words: pd.DataFrame, spec: bytes, keep: bool) -> pd.DataFrame:
    """One block: ids take the places of word numbers, pieces the places of ids."""
    table = pieces(spec)
    lists = [(np.cumsum(unpack(zlib.decompress(c)), dtype=np.int64), unpack(zlib.decompress(n)).astype(np.int64), unpack(zlib.decompress(i))) for c, n, i in zip(words["codes"], words["lens"], words["ids"], strict=True)]
    lens_of = np.zeros(sum(len(c) for c, _, _ in lists), np.int64)
    for codes, n, _ in lists:
        lens_of[codes] = n
    starts = np.concatenate([[0], np.cumsum(lens_of)]).astype(np.int64)
    flat = np.zeros(int(starts[-1]), np.uint32)
    for codes, n, ids in lists:
        flat[np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    text_of = [" ".join(map(table.__getitem__, flat[a:b].tolist())) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    rows = []
    for doc_id, codes in zip(docs["doc_id"].array, docs["codes"].array, strict=True):
        c = unpack(codes).astype(np.int64)
        lens = starts[c + 1] - starts[c]
        total = int(lens.sum())
        first = np.cumsum(lens) - lens
        own = flat[np.repeat(starts[c] - first, lens) + np.arange(total)].astype("<u4") if total else np.zeros(0, "<u4")
        text = " ".join(map(text_of.__getitem__, c.tolist()))
        row = (doc_id, total, hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest())
        rows.append((*row, own.astype(np.int32), text) if keep else row)
    del text_of, flat, lists
    trim()
    return pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (with keep: ids and decoded too).

    vocabulary: path of a tokenizer file, read by the driver (a few MB, the size of the
    vocabulary, so it may be shipped to every task).  Null and empty texts have no
    tokens; rows with equal or null ids are encoded one by one; very long texts are one
    row each; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        spec = f.read()
    _check(spec)

    buckets = min(partitions(spark), MOST_BUCKETS)

    def number(rows):
        from pyspark import TaskContext

        return number_words(rows, TaskContext.get().partitionId(), spec, buckets)

    slim = docs.select(id_in(id_col), F.col(text_col).alias("text"))
    ws = Workspace(spark)
    numbered = ws.bucketed(
        slim.mapInPandas(number, "block long, kind int, doc_id long, codes binary, bucket int, words binary"), "numbered", "block", partitions(spark)
    )
    lists = numbered.filter("kind = 1").select("block", "bucket", "codes", "words").repartitionById(buckets, "bucket")
    placed = lists.mapInPandas(lambda rows: encode_words(rows, spec), "block long, codes binary, lens binary, ids binary")
    texts = numbered.filter("kind = 0").select("block", "doc_id", "codes")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    # Both sides of a block are bounded by BLOCK_WORDS, BLOCK_DISTINCT and one text.
    done = ws.store(texts.groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(lambda left, right: place_ids(left, right, spec, keep), schema), "encoded")
    ws.keep_only("encoded")  # the numbered texts go, and their catalog entry
    return id_out(done)


def _check(spec: bytes) -> None:
    """The word splitter is written for one kind of tokenizer file; refuse others."""
    import json

    t = json.loads(spec)
    rule = t["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if t.get("pre_tokenizer", {}).get("pretokenizers") else ""
    if t.get("decoder") is not None or rule != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
        raise ValueError("not a word-level BPE file of the supported kind")
