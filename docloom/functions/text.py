"""Text rules as Catalyst expressions; Python only where Unicode tables are needed."""

from __future__ import annotations

import difflib
import posixpath
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token sets of labels, and what counts as noise.
PERSON = ("person", "player", "portrait")
CONTAINER = ("card", "panel", "chart", "table", "frame", "border")
STRONG_CONTAINER = ("card", "panel", "table", "frame")
NOISE = r"^[\s\-_=.|/\\:;,!?~`@#$%^&*(){}\[\]<>+'\"]+$"
CJK, CJK_A = r"[\u4e00-\u9fff]", r"[\u3400-\u4dbf]"


def _compact(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).casefold().split()))


def _normalized(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip())


def compact(text) -> Column:
    """NFKC, case folding, no white space."""
    return F.pandas_udf(_compact, "string")(text)


def normalized(text) -> Column:
    """NFKC, case folding, white space collapsed to one blank and trimmed."""
    return F.pandas_udf(_normalized, "string")(text)


def compact_ascii(text) -> Column:
    """Lower case, no ASCII white space: compact() where a text needs no Unicode tables,
    without leaving generated code."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def normalized_ascii(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(label) -> Column:
    """Distinct lower-case tokens without dots and commas at their ends."""
    parts = F.filter(F.split(F.trim(label), r"\s+"), lambda t: t != "")
    return F.array_distinct(F.transform(parts, lambda t: F.lower(F.regexp_replace(t, "^[.,]+|[.,]+$", ""))))


def _any(found, words) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in words]))


def role(label) -> Column:
    t = tokens(label)
    person, container = _any(t, PERSON), _any(t, CONTAINER)
    return F.when(person & container, "mixed").when(person, "person").when(container, "container").otherwise("object")


def has_cjk(text) -> Column:
    return text.rlike(CJK)


def font(text) -> Column:
    return F.when(has_cjk(text), "Microsoft YaHei").otherwise("Arial")


def font_size(text, size) -> Column:
    """Large CJK titles are made smaller, to one decimal."""
    return F.when(has_cjk(text) & (size >= 80), F.bround(size * 0.88, 1)).when(has_cjk(text) & (size >= 48), F.bround(size * 0.90, 1)).otherwise(size)


def ocr_language(lang) -> Column:
    return F.when(lang.isin("ch", "zh", "cn"), "chi_sim+eng").when(lang == "en", "eng").otherwise(lang)


def utc_time(value) -> Column:
    """The timestamp of an ISO-8601 string in UTC with a Z; null for any other string."""
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
    return F.when(value.rlike(form), F.try_to_timestamp(value))


def ooxml_integer(value) -> Column:
    """A decimal integer of at most 64 bits in at most 20 ASCII characters; null for anything else."""
    return F.when(value.rlike(r"\A[+-]?[0-9]+\z") & (F.length(value) <= 20), value.try_cast("bigint"))


def crop_value(value) -> Column:
    """0 if absent, the integer, or 1 where it can't be parsed (so it counts as cropped)."""
    return F.when(value.isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce(ooxml_integer(value), F.lit(1).cast("bigint")))


def release(version) -> Column:
    """Up to three leading numbers of a version, missing ones 0; null without a number."""
    head = F.regexp_extract(version, r"^\d+(?:\.\d+){0,2}", 0)
    parts = F.transform(F.split(head, r"\."), lambda p: p.cast("int"))
    full = F.slice(F.concat(parts, F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 3)
    return F.when(head != "", full)


def version_compatible(installed, minimum) -> Column:
    """Newer release, or the same one without a pre-release suffix."""
    a, b = release(installed), release(minimum)
    suffix = F.regexp_replace(installed, r"^\d+(?:\.\d+){0,2}", "")
    older = lambda x, y: F.struct(*[x[i] for i in range(3)]) < F.struct(*[y[i] for i in range(3)])
    return F.coalesce(F.when(older(b, a), True).when(older(a, b), False).otherwise(~suffix.rlike(r"(?i)(?:dev|a|b|rc)\d*")) & a.isNotNull() & b.isNotNull(), F.lit(False))


def safe_member(name) -> Column:
    """A relative package path: no backslash, drive, root, or empty, dot and dot-dot parts."""
    return F.coalesce((F.length(name) > 0) & ~name.rlike(r"\\|^/|^[A-Za-z]:|//|\x00") & ~name.rlike(r"(^|/)\.{1,2}(/|$)") & ~name.endswith("/"), F.lit(False))


def _part_target(source: pd.Series, target: pd.Series) -> pd.Series:
    def one(s, t):
        if s is None or t is None or "\\" in t:
            return None
        path = posixpath.normpath(t.lstrip("/") if t.startswith("/") else posixpath.join(posixpath.dirname(s), t))
        return None if path.startswith("../") or path in ("..", ".") else path

    return pd.Series([one(s, t) for s, t in zip(source, target, strict=True)], dtype="object")


def part_target(source, target) -> Column:
    """A relationship target as a package path; null where it leaves the package."""
    return F.pandas_udf(_part_target, "string")(source, target)


def similarity(a, b) -> Column:
    """The matching-blocks ratio of two texts."""
    return F.pandas_udf(_similarity, "double")(a, b)


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similar(a, b, least) -> Column:
    """Whether the matching-blocks ratio of two texts reaches `least`."""
    return F.pandas_udf(_similar, "boolean")(a, b, least)


def _similar(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    def reaches(x: str, y: str, ratio: float) -> bool:
        match = difflib.SequenceMatcher(None, x, y)
        return match.quick_ratio() >= ratio and match.ratio() >= ratio  # the first is never less than the second

    return pd.Series([reaches(x or "", y or "", r) for x, y, r in zip(a, b, least, strict=True)], dtype="bool")


def meaningful(text) -> Column:
    """Letters, digits and CJK characters."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\u4e00-\u9fff\u3400-\u4dbf]", ""))


def technical_label(text) -> Column:
    """Letters and digits joined by single separators, long enough."""
    parted = text.rlike(r"[-_./]")
    return text.rlike(r"^[\p{L}\p{N}]+([-_./][\p{L}\p{N}]+)*$") & (meaningful(text) >= F.when(parted, 4).otherwise(2))


def vertical_fragment(text, w, h) -> Column:
    """Tall narrow glyphs, or one large CJK character."""
    t = F.trim(text)
    tall = (h / F.nullif(w, F.lit(0)) >= 1.8) & (w <= 36) & t.rlike(r"[\u4e00-\u9fffA-Za-z0-9]")
    big = has_cjk(t) & (F.length(t) == 1) & (h >= 120) & (w >= 80)
    return F.coalesce((w > 0) & (h > 0) & (tall | big), F.lit(False))


def noise(text, confidence, w, h, least: float = 0.7) -> Column:
    """Whether a recognised line is dropped."""
    t = F.trim(text)
    n, total = meaningful(t), F.length(F.regexp_replace(t, " ", ""))
    parted, compact_label, label = t.rlike(r"[-_./]"), t.rlike(r"^[\p{L}\p{N}\-_./]+$"), technical_label(t)
    letters, upper = F.length(F.regexp_replace(t, r"\P{L}", "")), F.length(F.regexp_replace(t, r"\P{Lu}", ""))
    garbled = (letters >= 4) & (upper / F.nullif(letters, F.lit(0)) > 0.8) & t.rlike(r"[:;./\\]") & ~has_cjk(t) & ~label
    lone = (F.length(t) == 1) & ~t.rlike(r"^[\p{L}\p{N}]$")
    few = F.coalesce((total > 0) & (n / F.nullif(total, F.lit(0)) < 0.6), F.lit(False))
    return (t == "") | (F.coalesce(confidence, F.lit(0.0)) < least) | t.rlike(NOISE) | vertical_fragment(t, w, h) | few | (parted & compact_label & ~label) | lone | F.coalesce(garbled, F.lit(False))


def icon_text(text, confidence, w, h) -> Column:
    """At most two characters, nearly square and not sure: kept as a picture."""
    ratio = F.greatest(F.lit(1), w) / F.greatest(F.lit(1), h)
    return F.coalesce((confidence < 0.9) & (F.length(F.regexp_replace(text, r"\s+", "")) <= 2) & (ratio >= 0.65) & (ratio <= 1.5), F.lit(False))


def fallback_parent(node_id, parent_id) -> Column:
    """The parent, or the one that a component's own name pairs it with."""
    return F.coalesce(parent_id, F.regexp_replace(node_id, "^component_", "parent_"))
