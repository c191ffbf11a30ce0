"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into text blocks at block-level tags.  Each block is described by its words
and link density, those of its neighbours, and where it stands:

* share, holds: of the innermost element around it that names itself boilerplate (by its
  tag, or by a class, id or role token), the percentage of the page's plain words (blocks
  that are less than half link) inside, and whether the page's article is inside too (if
  it has none its first h1; failing both, half of the plain words).  A block in no such
  element has 100 and 1; one in a mere wrapper of the page is near to that.
* side: 1 inside the page's article, -1 outside it, 0 if the page has none.  That is the
  smallest article or main element with at least half of the plain words that stand in no
  boilerplate element, or in a wrapper: one around an article or h1 that holds half of all.
* heading.

A small CART tree, trained on the labelled table below, keeps or drops each block; no
mark decides alone.  Elements that are hidden or are form controls have no text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import id_in, id_out, prepare

COLUMNS = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "share", "holds", "side", "heading", "content")
#: The labelled table: words and link density (percent) of a block and its neighbours, share,
#: holds, side, heading; last: 1 main text, 0 not.
LABELLED = """
  9   0    3 100   40   0  100 1  1 1  1
  1   0    9   0  120   0  100 1  1 0  1
 12   0    6   0    0   0  100 1  1 1  1
 40   0    9   0   80   0  100 1  1 0  1
 80   3   40   0   10   0  100 1  1 0  1
  2   0   80   0    1   0  100 1  1 0  1
 10   0    2   0    9   0  100 1  1 0  1
  1   0    2   0    3  50  100 1  1 0  1
  5  20   60   0   50   0  100 1  1 0  1
 30  10    5   0    2   0  100 1  1 0  1
  1 100   20   0   25   0  100 1  1 0  1
  6 100   50   0   60   0  100 1  1 0  1
 12 100    9   0   30   0  100 1  1 0  1
  1 100    7   0    0   0  100 1  1 0  1
 15  90   30   0    9  10  100 1  1 0  1
  3   0    4 100    5 100  100 1  1 0  1
 50   0    3 100    1 100  100 1  1 0  1
  8   0   60   0    3 100  100 1  1 0  1
  2   0    1 100   30   0  100 1  1 1  1
  1   0    2  90    2 100  100 1  1 0  1
 90   5    6 100   40 100  100 1  1 0  1
  3   0   70   0    8  20  100 1  1 0  1
 14 100   40   0    5 100  100 1  1 0  1
 16 100   12 100   15 100  100 1  1 0  1
 11  95   10 100   14   0  100 1  1 0  1
  1 100    9   0    2 100  100 1  1 0  0
  2 100    1 100    1 100  100 1  1 0  0
  1 100    2 100   40   0  100 1  1 0  0
  3 100   30   0    2 100  100 1  1 0  0
  2 100    3 100   12   0  100 1  1 0  0
  4 100    3 100    2  90  100 1  1 0  0
  2  90    5 100    1 100   85 1  1 0  0
 60   0    9   0   45   0   95 1  1 0  1
  7   0   50   0   40   0   80 1  1 1  1
  3   0   30   0   20   0   70 1  1 0  1
 35   5   60   0    2   0   60 1  1 0  1
  1   0   15   0   80   0   90 1  1 0  1
 80   0    4 100    9   0   88 1  0 0  1
 25   0   80   0   60   0   75 1  0 0  1
  1 100    1 100    1 100    0 0 -1 0  0
  3 100    2 100    4  90    0 0 -1 0  0
  9   0    1 100   10   0    4 0 -1 0  0
 25   0    1 100    9   0   10 0 -1 0  0
 60   0    3   0   80   0   20 0 -1 0  0
 14   0  120   0    0   0    6 0 -1 0  0
 12  10    2   0    0   0    3 0 -1 0  0
  5   0   30   0    4 100    2 0 -1 1  0
200   0   90   0   70   0   40 0 -1 0  0
 70   0   30   0    0   0   30 0 -1 0  0
 35   5    0   0   20   0   15 0 -1 0  0
 18   0    7   0   50   0   12 0 -1 1  0
 90   0    4  50   60   0   45 0 -1 0  0
  8   0    5 100    9   0    3 0  0 0  0
 15   0   70   0    4 100    8 0  0 0  0
 40   0   60   0   20   0   20 0  0 0  0
110   0   50   0   30   0   35 0  0 0  0
  6   0   30   0    0   0    2 0  0 0  0
  4 100    3 100    2 100    0 0  0 0  0
 12   0   50   0   40   0    5 0  1 0  0
 45   0   60   0    9   0   12 0  1 0  0
 90   0   20   0   60   0   30 0  1 0  0
  2 100   40   0    1 100    0 0  1 0  0
  4   0   90   0   30   0    1 0  1 1  0
 20  80    5 100    6 100    2 0  1 0  0
  1   0   25   0   30   0    1 0  1 0  0
 10   0    3   0   25   0    4 0  1 0  0
 60   0   50   0   70   0   90 1  0 0  1
 35   0   80   0   40   0   80 1  0 0  1
120   5    9   0   60   0   75 1  0 0  1
 16   0    5   0    0   0   53 0  1 0  0
 16   0    5   0    0   0   55 0  0 0  0
 60   0   50   0   70   0   90 0 -1 0  0
 35   0   80   0   40   0   80 0  0 0  0
120   5    9   0   60   0   75 0 -1 0  0
 50   0    9   0   60   0   65 0  1 0  0
  9   0    3 100   40   0   70 0  1 1  0
 80   3   40   0   10   0   85 0  1 0  0
 30  10    5   0    2   0   95 0  1 0  0
 50   0    3 100    1 100   90 0  1 0  0
 16 100   12 100   15 100   70 0  1 0  0
 45   0   60   0    8   0   66 0  0 0  0
 60   5   45   0   30   0   92 0  0 0  0
 40   0    3 100    2 100   84 0  0 0  0
  8   0    3 100   60   0   77 0  0 1  0
120   2    0   0    0   0  100 0  0 0  0
 22   5   50   0    3 100   62 0  0 0  0
 70   0   90   0   55   0   72 0 -1 0  0
 50   5   60   0   45   0   96 0 -1 0  0
  3   0    3   0    0   0  100 1  1 0  1
  2   0   40   0    0   0  100 1  1 0  1
  1   0    5   0    0   0  100 1  1 0  1
  4   0   60   0    0   0  100 1  1 0  1
  6   0    2 100    0   0  100 1  1 0  1
  5   0    0   0    0   0  100 1  1 0  1
  1   0    2 100    3 100  100 1  1 0  1
  2   0   30   0    2 100  100 1  1 0  1
  4   0    3 100    5   0  100 1  1 0  1
  1   0    0   0    2 100  100 1  1 0  1
  7   0   12 100   16 100  100 1  1 0  1
  4   0   60   0   15 100  100 1  1 0  1
  3   0    1 100    0   0  100 1  1 0  1
 20   0    4   0    0   0  100 1  1 0  1
  1 100   40   0    0   0  100 1  1 0  1
  3 100    6   0    0   0  100 1  1 0  1
  2 100    0   0   30   0  100 1  1 0  1
  5   0    1 100    2 100    3 1  0 1  0
  8   0    4 100   12   0    6 1  0 0  0
 12   0    5   0   40   0   10 1 -1 0  0
 30   0    8   0   60   0   14 1  0 0  0
 70   0   90   0   55   0  100 1 -1 0  1
 50   5   60   0   45   0  100 1 -1 0  1
 48   0   35   0    3 100  100 1 -1 0  1
 12   0    3 100    9   0  100 1 -1 0  0
  8   0   60   0    2 100  100 1 -1 0  0
 25   0   40   0   10   0  100 1 -1 0  0
 15   0    4 100   70   0  100 1 -1 0  0
  3   0   50   0   80   0  100 1 -1 1  0
 45   0    5   0    8   0  100 1 -1 0  0
 60   0    3 100    2 100  100 1 -1 0  0
  2 100    2 100    3 100  100 1 -1 0  0
 30  80    5   0    9   0  100 1 -1 0  0
 45   0   60   0    8   0  100 1  0 0  1
 60   5   45   0   30   0  100 1  0 0  1
 25   0   60   0   50  10  100 1  0 0  1
 90  10    3  90   20   0  100 1  0 0  1
 18   0   70   0   40   0  100 1  0 0  1
  8   0    3 100   60   0  100 1  0 1  1
  2   0    2 100   40   0  100 1  0 1  1
  4   0    1 100   90   0  100 1  0 1  1
  6   0   50   0   70   0  100 1  0 1  1
  9   0   60   0   45   0  100 1  0 0  1
  4   0   40   0   40   0  100 1  0 0  1
120   2    0   0    0   0  100 1  0 0  1
 40   0    3 100    2 100  100 1  0 0  1
 75   0    1 100    4 100  100 1  0 0  1
 22   5   50   0    3 100  100 1  0 0  1
  7   0    2 100   70   0  100 1  0 1  1
 30   0    0   0    0   0  100 1  0 0  1
  1 100   40   0   35   0  100 1  0 0  1
  5 100   60   0   80   0  100 1  0 0  1
  1 100    2 100    1 100  100 1  0 0  0
  3 100    0   0    2 100  100 1  0 0  0
  5 100    4 100   40   0  100 1  0 0  0
 12  90    3 100    9 100  100 1  0 0  0
 25  80    5 100    6 100  100 1  0 0  0
 40  75   10  90    8  90  100 1  0 0  0
  4   0    2 100    3 100  100 1  0 0  0
  6   0    0   0    3 100  100 1  0 0  0
  2   0    4 100    0   0  100 1  0 0  0
  7  50    3 100    5 100  100 1  0 0  0
  5  10    6 100    0   0  100 1  0 0  0
  2 100   40   0    3   0  100 1  0 0  0
  3 100   60   0    5   0  100 1  0 0  0
  4 100   30   0    0   0  100 1  0 0  0
 10   0   12 100   14 100  100 1  0 0  0
  9   0   20 100   18 100  100 1  0 0  0
 12   0   16 100   20 100  100 1  0 0  0
 10   0   12   0   14   0  100 1  0 0  1
  9   0   20   0   18   0  100 1  0 0  1
 12   0   16   0   20   0  100 1  0 0  1
  3   0    2   0    1 100  100 1  0 1  0
  5   0    3 100    2 100  100 1  0 0  0
"""

#: Fixed values of HTML: elements that end a block, that have no content, whose content is
#: raw text, that name themselves boilerplate, and that hold no text of a page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BOILER = frozenset("nav footer aside form menu dialog search".split())
SILENT = frozenset("head button select datalist svg math object audio video canvas".split())
#: Words that class, id and role tokens name boilerplate with; words that may stand beside
#: them; first parts of tokens that only tell of something elsewhere on the page.
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs sidebar aside footer masthead toolbar comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended pagination pager widget copyright skip contentinfo complementary alertdialog".split()
)
NEUTRAL = frozenset("area bar block bottom box buttons container form inner item items left line links list main nav outer page panel posts right section site slot text top unit wrap wrapper".split())
MODIFIERS = frozenset("has with no without is not hide show open closed".split())
ARTICLE_WORDS = frozenset("article articlebody".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/>]|$))", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def names_boilerplate(token: str) -> bool:
    """site-footer, ad-banner, commentList; not has-sidebar, search-page, share-price."""
    parts = [w.lower() for w in _SPLIT.findall(token)]
    if not parts or parts[0] in MODIFIERS:
        return False
    return all(w in BOILER_WORDS or w in NEUTRAL for w in parts) and any(w in BOILER_WORDS for w in parts)


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is an article, names itself boilerplate, and is hidden."""
    article, boiler, silent = tag in ("article", "main"), tag in BOILER or (tag == "header" and not in_article), tag in SILENT
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                silent = True
            elif name in ("class", "id", "role", "itemprop"):
                boiler = boiler or (tag not in ("html", "body") and any(map(names_boilerplate, value.split())))
                article = article or value.lower() in ARTICLE_WORDS or (name == "role" and value.lower() == "main")
    return article, boiler, silent


class Block(NamedTuple):
    """Text, words, linked words, elements around it that are articles and that name
    themselves boilerplate (numbers, outermost first), heading, first-level heading."""

    text: str
    words: int
    linked: int
    articles: tuple[int, ...]
    marks: tuple[int, ...]
    heading: bool
    title: bool


def blocks(page: str) -> tuple[list[Block], dict[int, tuple[int, ...]]]:
    """The blocks in page order, and the boilerplate elements around (and at) each article."""
    out: list[Block] = []
    around: dict[int, tuple[int, ...]] = {}
    stack: list[tuple] = []  # tag, articles, marks, heading, title, hidden
    bottom = ("", (), (), False, False, False)
    state, number = bottom, 0
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0
    at, lower = 0, None
    end_of_tags = page.rfind(">") + 1  # behind it no tag can end: the search needn't go on

    def flush():
        if parts:
            text = "" if state[5] else " ".join("".join(parts).split())
            if text:
                n = text.count(" ") + 1
                out.append(Block(text, n, min(n, len(" ".join(linked).split())), state[1], state[2], state[3], state[4]))
            parts.clear()
            linked.clear()

    def say(raw: str):
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked.append(text)

    while True:
        m = _TOKEN.search(page, at, end_of_tags) if at < end_of_tags else None
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith(">"):
            break  # a comment without an end takes the rest
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if close else 1
        elif tag in RAW:
            if not close and not attrs.endswith("/"):
                lower = lower if lower is not None else page.lower()
                end = lower.find(f"</{tag}", at) if len(lower) == len(page) else -1
                if end < 0 and (e := re.compile(f"</{tag}", re.I).search(page, at)):
                    end = e.start()
                at = len(page) if end < 0 else end
            if tag in BLOCK:
                flush()
        elif tag in BLOCK or tag in SILENT:
            flush()
            if tag in VOID:
                continue
            if close:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        in_link = 0
                        break
            elif not attrs.endswith("/"):
                in_link = 0
                if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                    stack.pop()  # its end tag may be left out
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                _, articles, marks, heading, title, hidden = stack[-1] if stack else bottom
                article, boiler, silent = _marks(tag, attrs, bool(articles))
                number += 1
                marks = (*marks, number) if boiler else marks
                if article:
                    articles, around[number] = (*articles, number), marks
                stack.append((tag, articles, marks, heading or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"), title or tag == "h1", hidden or silent))
            state = stack[-1] if stack else bottom
        elif tag in ("span", "b", "i", "em", "strong", "font", "small", "sup", "sub") or tag in VOID:
            continue
    flush()
    return out, around


def table(found: list[Block], around: dict[int, tuple[int, ...]]) -> np.ndarray:
    """The columns of LABELLED, but for the label, for a page's blocks."""
    x = np.zeros((len(found), len(COLUMNS) - 1))
    if not found:
        return x
    words = np.array([b.words for b in found], float)
    links = np.array([100 * b.linked / b.words for b in found])
    x[:, 0], x[:, 1] = words, links
    x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
    inside: dict[int, float] = defaultdict(float)
    plain = 0.0
    for b, w, density in zip(found, words.tolist(), links.tolist(), strict=True):
        if density < 50:
            plain += w
            for e in (*b.articles, *b.marks):
                inside[e] += w  # an element that is both counts double: see below
    both = set(around) & {e for b in found for e in b.marks}
    for e in both:
        inside[e] /= 2
    titles = [b.marks for b in found if b.title]
    wrappers = {e for marks in (*around.values(), *titles) for e in marks}
    base = sum(w for b, w, density in zip(found, words.tolist(), links.tolist(), strict=True) if density < 50 and (not b.marks or (b.marks[-1] in wrappers and 2 * inside[b.marks[-1]] >= plain)))
    own = min((e for e in around if 2 * inside[e] >= base > 0), key=lambda e: (inside[e], -e), default=None)
    if own is not None or titles:
        held = set(around[own] if own is not None else titles[0])
    else:
        held = {e for b in found for e in b.marks if 2 * inside[e] >= plain}
    for i, b in enumerate(found):
        x[i, 6], x[i, 7] = 100, 1
        if b.marks:
            e = b.marks[-1]
            x[i, 6], x[i, 7] = 100 * inside[e] / plain if plain else 0, e in held
        x[i, 8] = 0 if own is None else 1 if own in b.articles else -1
        x[i, 9] = b.heading
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10):
    """A CART tree: (column, cut, below, above), or the share of main text in a leaf."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            below = x[:, j] < cut
            p, q = y[below].mean(), y[~below].mean()
            impurity = below.sum() * p * (1 - p) + (~below).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, j, cut, below)
    if best is None:
        return share
    _, j, cut, below = best
    return (j, float(cut), grow(x[below], y[below], depth - 1), grow(x[~below], y[~below], depth - 1))


@lru_cache(maxsize=8)
def trained(labelled: str = LABELLED):
    rows = np.array([line.split() for line in labelled.strip().splitlines()], float)
    return grow(rows[:, :-1], rows[:, -1])


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    j, cut, below, above = tree
    is_below = x[:, j] < cut
    out = np.zeros(len(x), bool)
    if is_below.any():
        out[is_below] = classify(below, x[is_below])
    if not is_below.all():
        out[~is_below] = classify(above, x[~is_below])
    return out


def main_text(page, labelled: str = LABELLED) -> str:
    """The kept blocks in page order, one a line."""
    if not isinstance(page, str) or not page:
        return ""
    found, around = blocks(page)
    if not found:
        return ""
    keep = classify(trained(labelled), table(found, around))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: str = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages, and pages without main text, give an empty text.  Character
    references are decoded, white space inside a block (line breaks too) becomes one
    blank, and blocks are joined by one line feed; nothing else is changed, whatever the
    length of a page.  Each row is worked on alone, so repeated rows and null or repeated
    ids stay as they are; other columns are ignored.
    """
    prepare(pages.sparkSession)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            texts = [main_text(h, labelled) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    slim = pages.select(id_in(id_col, "page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return id_out(slim.mapInPandas(run, "page_id long, url string, text string, n_chars long"), "page_id")
