"""Main text of web pages: flat text blocks with the word counts and link densities of a block and its
neighbours, classified by a decision tree that is trained on a small labelled table.

A page is cut at block tags into flat blocks. Besides counts, a block knows whether it lies in page furniture
(by the tags, roles, classes and ids around it) and whether it lies in an article. Furniture that may wrap a page,
such as a form, is none for an article within it, nor if it holds half of the page's plain words. The tree is grown from
LABELLED when a task begins, which takes milliseconds; it is one for all pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import textops
from gristmill.llm.storage import arrow_batches, map_arrow

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article")
#: Labelled blocks: FEATURES, then 1 for main text. Fixed by hand from typical pages: menus, mastheads, bylines,
#: paragraphs long and short, headings, quotes, captions, share and tag lists, related links, comments, footers.
LABELLED = """
6 1.00 0 0.00 1 1.00 1 0 0
1 1.00 6 1.00 1 1.00 1 0 0
1 1.00 1 1.00 1 1.00 1 0 0
1 1.00 1 1.00 8 0.00 1 0 0
8 0.00 1 1.00 60 0.00 1 0 0
14 0.00 1 1.00 9 0.00 1 0 0
45 0.10 3 0.50 20 0.00 1 0 0
120 0.00 2 0.00 80 0.00 1 0 0
12 0.00 90 0.00 0 0.00 1 0 0
25 0.20 40 0.00 10 1.00 1 0 0
60 0.00 40 0.00 30 0.00 1 0 0
35 0.00 12 0.00 50 0.00 1 0 0
3 0.00 50 0.00 70 0.00 1 1 0
2 1.00 40 0.00 3 1.00 1 1 0
40 0.00 60 0.00 50 0.00 1 1 0
18 0.00 80 0.05 25 0.00 1 1 0
9 0.00 30 0.00 35 0.00 1 1 0
90 0.02 30 0.00 35 0.00 1 1 0
10 0.00 8 0.00 55 0.00 0 1 1
7 0.00 1 1.00 40 0.00 0 1 1
1 0.00 60 0.00 1 0.00 0 1 1
1 0.00 1 0.00 45 0.00 0 1 1
1 0.00 30 0.00 12 0.00 0 1 1
2 0.00 12 0.00 14 0.00 0 1 1
4 0.00 44 0.00 52 0.00 0 1 1
55 0.00 10 0.00 61 0.00 0 1 1
61 0.05 55 0.00 2 0.00 0 1 1
80 0.12 70 0.02 66 0.00 0 1 1
25 0.40 70 0.02 66 0.00 0 1 1
30 0.60 44 0.10 51 0.00 0 1 1
12 0.75 44 0.10 51 0.00 0 1 1
140 0.00 61 0.00 12 0.00 0 1 1
600 0.00 10 0.00 12 0.00 0 1 1
16 0.00 140 0.00 14 0.30 0 1 1
3 1.00 120 0.00 2 1.00 0 1 0
2 1.00 3 1.00 1 1.00 0 1 0
1 1.00 2 1.00 12 0.00 0 1 0
6 1.00 90 0.00 5 1.00 0 1 0
5 1.00 6 1.00 9 0.00 0 1 0
11 1.00 5 1.00 12 1.00 0 1 0
2 1.00 0 0.00 3 1.00 0 0 0
3 1.00 2 1.00 2 1.00 0 0 0
2 1.00 3 1.00 55 0.00 0 0 0
4 0.00 2 1.00 3 1.00 0 0 0
5 0.00 0 0.00 2 1.00 0 0 0
3 0.00 1 1.00 4 0.50 0 0 0
6 0.50 4 0.00 3 1.00 0 0 0
9 0.90 30 0.00 8 0.95 0 0 0
14 0.85 9 0.90 12 0.80 0 0 0
22 0.70 14 0.85 20 0.65 0 0 0
20 0.65 22 0.70 6 0.00 0 0 0
8 0.00 40 0.00 0 0.00 0 0 0
7 0.10 12 0.90 3 0.00 0 0 0
10 0.30 3 1.00 4 1.00 0 0 0
1 0.00 0 0.00 0 0.00 0 0 0
8 0.00 2 1.00 70 0.00 0 0 1
6 0.00 55 0.00 62 0.00 0 0 1
12 0.00 48 0.00 39 0.00 0 0 1
5 0.00 88 0.00 75 0.02 0 0 1
24 0.00 8 0.00 47 0.00 0 0 1
47 0.00 24 0.00 33 0.00 0 0 1
70 0.03 8 0.00 64 0.00 0 0 1
64 0.10 70 0.03 41 0.00 0 0 1
33 0.25 60 0.00 45 0.10 0 0 1
90 0.00 3 1.00 2 1.00 0 0 1
150 0.05 0 0.00 0 0.00 0 0 1
40 0.00 35 0.00 8 0.00 0 0 1
18 0.00 52 0.00 26 0.00 0 0 1
20 0.00 0 0.00 0 0.00 0 0 1
28 0.00 0 0.00 0 0.00 0 0 1
45 0.00 60 0.00 0 0.00 0 0 1
38 0.05 44 0.00 3 1.00 0 0 1
26 0.00 31 0.00 2 0.00 0 0 1
22 0.00 1 0.00 0 0.00 0 0 1
32 0.10 3 1.00 28 0.00 0 0 1
57 0.15 4 0.00 5 1.00 0 0 1
19 0.00 6 0.00 21 0.05 0 0 1
36 0.20 33 0.00 4 0.90 0 0 1
7 0.00 42 0.05 58 0.00 0 0 1
2 0.00 58 0.00 49 0.00 0 0 1
4 0.00 2 1.00 29 0.00 0 0 1
6 0.00 0 0.00 40 0.00 0 0 1
2 0.00 3 1.00 4 1.00 0 0 0
3 0.00 4 0.00 2 0.00 0 0 0
5 0.00 33 0.00 2 0.00 0 0 0
4 0.20 27 0.00 3 1.00 0 0 0
16 0.90 55 0.00 60 0.00 0 0 0
26 0.75 12 0.80 18 0.90 0 0 0
30 0.85 40 0.00 22 0.70 0 0 0
6 0.90 70 0.00 65 0.00 0 0 0
3 0.67 52 0.00 3 0.00 1 0 0
9 0.70 30 0.00 20 0.00 1 0 0
12 0.75 44 0.10 51 0.00 1 0 0
13 0.72 41 0.10 48 0.00 0 0 0
8 0.65 3 0.00 60 0.00 1 0 0
11 0.78 60 0.00 9 1.00 1 1 0
3 0.00 10 0.00 2 0.00 0 1 1
2 0.00 8 0.00 8 0.00 0 1 1
5 0.00 5 0.00 3 0.00 0 1 1
1 0.00 0 0.00 1 0.00 0 1 1
4 0.00 0 0.00 0 0.00 0 1 1
6 0.00 20 0.00 0 0.00 0 1 1
1 0.00 2 0.00 1 0.00 0 1 1
3 0.00 30 0.00 3 1.00 0 1 1
9 0.00 12 0.00 4 0.50 0 1 1
2 0.00 1 1.00 2 0.00 0 1 1
15 0.10 26 0.00 1 0.00 0 1 1
14 0.72 33 0.00 2 0.00 0 1 1
13 0.00 42 0.00 3 0.00 0 0 1
12 0.00 35 0.00 0 0.00 0 0 1
15 0.00 22 0.00 4 0.00 0 0 1
14 0.00 3 0.00 3 0.00 0 0 1
9 0.00 31 0.00 1 1.00 0 0 0
10 0.00 28 0.00 0 0.00 0 0 0
"""

#: HTML's elements by their part in a page, and words of classes, ids and roles.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title datalist noframes".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus breadcrumb "
    "breadcrumbs pagination pager masthead topbar toolbar sidebar sidebars aside complementary widget widgets rail footer contentinfo copyright colophon comment comments commentlist disqus reply "
    "replies respond responses discussion cookie cookies consent gdpr notice notices notification notifications alert alerts popup popover modal overlay newsletter newsletters subscribe subscription "
    "subscriptions signup signin login register search searchbox form share sharing social related recommended recommendations outbrain taboola skip hidden".split()
)
#: Of these, what never holds the article, however long it is.
LASTING_TAGS = frozenset("nav footer aside menu dialog button".split())
LASTING_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses discussion related recommended recommendations outbrain taboola cookie cookies consent gdpr footer".split())
#: First and last words of class names that tell of a page's layout or state, as in no-sidebar and comments-open.
LAYOUT_FIRST = frozenset("no not has have with without is hide show enable disable single".split())
LAYOUT_LAST = frozenset("open opened closed close enabled disabled active inactive on off on left right none visible ready loaded supported".split())
#: Share of a page's words from which on furniture that may hold the article counts as a wrapper of the page.
WRAPPER = 0.5
#: Share from which on an element without the first heading counts as the whole page.
WHOLE = 0.8
#: An element that closes the same or sibling elements left open before it, back to the container.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_HINTS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_ROLE = re.compile(r"(?:^|\s)role\s*=\s*[\"']?(?:main|article)\b", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _furniture_words(attributes: str) -> Iterator[str]:
    """Words of FURNITURE_WORDS that a class, id or role is, begins or ends with, unless it tells of layout."""
    for value in _HINTS.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w.lower() for w in _WORD.findall(name)]
            if not words or words[0] in LAYOUT_FIRST:
                continue
            if words[-1] in FURNITURE_WORDS:
                yield words[-1]
            elif words[0] in FURNITURE_WORDS and (words[-1] not in LAYOUT_LAST or words[0] == "sidebar"):
                yield words[0]


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    """0 for no furniture, 1 for furniture that may wrap an article, 2 for what never does, 3 for what doesn't unless
    it wraps the whole page, as a class of a page with open comments may."""
    if tag in ("body", "html"):
        return 0
    kind = 2 if tag in LASTING_TAGS else 1 if tag in FURNITURE_TAGS or (tag == "header" and not in_article) else 0
    if kind < 2 and "=" in attributes and tag not in ARTICLE_TAGS:
        for word in _furniture_words(attributes):
            kind = max(kind, 3 if word in LASTING_WORDS else 1)
    return kind or (2 if _HIDDEN.search(attributes) else 0)


def blocks(page: str) -> list[tuple[str, int, float, bool, bool]]:
    """Flat blocks in page order: text, words, share of words in links, in furniture, in an article."""
    out, text, linked = [], [], []
    # furniture: numbers of the elements around that are some; ``lasting`` tells which never hold the article
    stack: list[tuple[str, tuple[int, ...], bool]] = []
    lasting: list[int] = []
    titles: list[bool] = []  # of each block, whether it is a first heading
    opened: dict[str, int] = {}
    furniture: tuple[int, ...] = ()
    article = in_link = False
    lowered = None

    def flush() -> None:
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                n = whole.count(" ") + 1
                out.append((whole, n, min(1.0, len("".join(linked).split()) / n), furniture, article))
                titles.append(bool(opened.get("h1")))
            text.clear(), linked.clear()

    def pop() -> None:
        nonlocal furniture, article
        name, furniture, article = stack.pop()
        opened[name] -= 1

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] == "<" and at - m.start() > 1:
                continue
            part = html.unescape(m[0]) if "&" in m[0] else m[0]
            text.append(part)
            if in_link:
                linked.append(part)
            continue
        tag, attributes = tag.lower(), m[3]
        while attributes.count('"') % 2 and at < size:  # a > inside a quoted value
            close = page.find('"', at)
            end = page.find(">", close) if close >= 0 else -1
            if end < 0:
                break
            attributes, at = attributes + page[at - 1 : end], end + 1
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCK_TAGS:
                flush()
                if opened.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            continue
        if tag in SKIPPED_TAGS:
            if not attributes.endswith("/"):
                lowered = lowered if lowered is not None else page.lower() if len(page.lower()) == size else page
                end = lowered.find("</" + tag, at)
                end = size if end < 0 else page.find(">", end)
                at = size if end < 0 else end + 1
        elif tag == "a":
            in_link = True
        elif tag == "br":
            text.append("\n")
            linked.append("\n")
        elif tag in BLOCK_TAGS:
            flush()
            if opened.get("p") and stack[-1][0] == "p":
                pop()
            if tag in _IMPLIED:
                own, bounds = _IMPLIED[tag]
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in own or stack[i][0] in bounds), -1)
                if depth >= 0 and stack[depth][0] in own:
                    while len(stack) > depth:
                        pop()
            if tag not in VOID_TAGS and not attributes.endswith("/"):
                stack.append((tag, furniture, article))
                opened[tag] = opened.get(tag, 0) + 1
                if tag in ARTICLE_TAGS or "role" in attributes and _ROLE.search(attributes):
                    article = True
                    if furniture:  # what may wrap an article does wrap this one
                        furniture = tuple(i for i in furniture if lasting[i] > 1)
                kind = _furniture(tag, attributes, article)
                if kind:
                    furniture += (len(lasting),)
                    lasting.append(kind)
    flush()
    held, articles, headed = ([0.0] * len(lasting) for _ in range(3))
    words = of_articles = 0.0
    for (_, n, links, around, own), title in zip(out, titles, strict=True):
        plain = n * (1 - links)
        words, of_articles = words + plain, of_articles + plain * own
        for i in around:
            held[i], articles[i], headed[i] = held[i] + plain, articles[i] + plain * own, headed[i] or title

    def counted(i: int) -> bool:
        if lasting[i] < 3:
            return lasting[i] == 2 or held[i] < WRAPPER * words
        # an element that holds the page's first heading, or nearly all its text, and leaves no article outside
        return held[i] < WRAPPER * words or articles[i] < of_articles or not (headed[i] or held[i] >= WHOLE * words)

    counts = [counted(i) for i in range(len(lasting))]
    return [(whole, n, links, any(counts[i] for i in around), own) for whole, n, links, around, own in out]


def features(found: list[tuple[str, int, float, bool, bool]]) -> np.ndarray:
    """A row of FEATURES for each block of one page."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if n:
        words, links = np.array([b[1] for b in found], float), np.array([b[2] for b in found])
        x[:, 0], x[:, 1] = words, links
        x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
        x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
        x[:, 6], x[:, 7] = [b[3] for b in found], [b[4] for b in found]
    return x


class Tree:
    """A decision tree grown by the least Gini impurity; of equal splits the first feature and the lowest
    threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        node = len(self.value)
        for part in (self.feature, self.threshold, self.left, self.right):
            part.append(0)
        self.value.append(float(y.mean()))
        best = None
        if depth and 0 < y.mean() < 1:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, f] <= cut
                    if low.sum() >= least and (~low).sum() >= least:
                        impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
                        if best is None or impurity < best[0] - 1e-12:
                            best = (impurity, f, cut, low)
        if best is None:
            self.feature[node] = -1
            return node
        _, self.feature[node], self.threshold[node], low = best
        self.left[node] = self._grow(x[low], y[low], depth - 1, least)
        self.right[node] = self._grow(x[~low], y[~low], depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right = (np.array(p) for p in (self.feature, self.threshold, self.left, self.right))
        at = np.zeros(len(x), int)
        while len(x) and (inner := feature[at] >= 0).any():
            f = feature[at]
            at = np.where(inner, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at], left[at], right[at]), at)
        return np.array(self.value)[at] >= 0.5


@lru_cache(maxsize=1)
def tree() -> Tree:
    table = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return Tree(table[:, :-1], table[:, -1])


def main_texts(pages: list[str]) -> list[str]:
    """The main text of each page: its kept blocks joined by a space."""
    found = [blocks(p) for p in pages]
    keep = tree().predict(np.concatenate([features(b) for b in found])) if found else []
    out, at = [], 0
    for b in found:
        out.append(" ".join(x[0] for x, k in zip(b, keep[at : at + len(b)], strict=True) if k))
        at += len(b)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: (id_col, url_col, text, n_chars).

    Null and empty pages, and pages without main text, have the empty text. Broken markup is read as browsers
    do: open elements end with their container, an unclosed comment or script takes the rest. Pages of any
    length are read whole. Null ids and urls and repeated rows stay; other columns are not read."""
    arrow_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, texts = textops.text_column(batch.column(2)), []
            for a, b in textops.pieces(textops.raw(column)[1]):
                texts += main_texts(column.slice(a, b - a).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    out = map_arrow(own, run, f"id {own.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
