"""Main text of web pages: flat blocks of text, kept or left out by a decision tree over their own and their neighbours' features.

A page is read once, tag by tag. Text between block tags is one block; for each are known its words, the share of them in links, the same of the
blocks before and after, and whether the block stands inside an article, inside a part that is not one (menu, footer, advert, comments ...),
or is a heading. Names that may say either (reviews, headline, related ...) count the less, the more of the page's words their part holds. The tree
is trained on the small labelled table below.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_batches, text_slices

RESULT = pa.schema({"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()})
RESULT_SQL = "page_id long, url string, text string, n_chars long"

# The elements of HTML that begin and end a block of text, those whose content is no text, and those that only their own end tag ends.
BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = "script style noscript template svg math iframe object textarea select button title canvas audio video datalist".split()
RAW_TAGS = {"script", "style"}

ARTICLE_TAGS = {"article", "main"}
OTHER_TAGS = set("nav aside footer header form menu dialog search".split())
WHOLE_TAGS = ARTICLE_TAGS | {"body", "html"}
CONTAINERS = ARTICLE_TAGS | OTHER_TAGS | set("div section ul ol table td dl fieldset figure blockquote body details".split())
# Words in a class, id or role that say what a part of a page is, and those that are also used around articles.
OTHER_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar\w*|aside|foot(?:er)?\w*|masthead|top-?bar|tool-?bar"
    r"|cookies?\w*|consent|gdpr|pop-?up|modal|overlay|dialog|comments?\w*|respond|disqus|share|sharing|subscribe|subscription|newsletter|sign-?up|log-?in"
    r"|paywall|copyright|disclaimer|pagination|pager|tag-?cloud|widgets?|contentinfo|complementary|navigation|hidden|sr-only|skip\w*)(?:$|[^a-z])"
)
WEAK_NAMES = re.compile(
    r"(?:^|[^a-z])(?:promo\w*|head(?:er)?|notices?|alerts?|replies|reply|discuss\w*|reviews?|social\w*|related|recommend\w*|trending|popular|more-?posts|search|forms?"
    r"|legal|tags?|meta|byline|toc)(?:$|[^a-z])"
)
# Headings that say that what follows in their part was written by readers.
READERS = re.compile(
    r"(?:\d[\d.,]* )?(?:reader |user )?(?:comments?|replies|reply|responses?|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)(?: ?\(\d+\))?:?"
    r"|(?:leave|post|write|add) (?:a|your) (?:comment|reply)|join the (?:discussion|conversation)",
    re.IGNORECASE,
)
ARTICLE_NAMES = re.compile(r"(?:^|[^a-z])(?:article|main|content|post|entry|story|body|text)(?:$|[^a-z])")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>"
    r"|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+\Z",
    re.DOTALL | re.IGNORECASE,
)
# The next start or end tag of an element without text.
NEXT_TAG = {tag: re.compile(rf"<(/?){tag}(?![a-z0-9:-])[^>]*+(?:>|\Z)" if tag not in RAW_TAGS else rf"<(/){tag}(?![a-z0-9:-])[^>]*+(?:>|\Z)", re.IGNORECASE) for tag in NO_TEXT}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "article", "other", "named", "heading"]
# Labelled blocks: the features in the order above, and 1 where the block is main text.
LABELLED = [
    # Paragraphs, headings, short lines and lists of articles.
    (60, 0.0, 8, 0.0, 45, 0.0, 1, 0, 0.0, 0, 1), (45, 0.0, 60, 0.0, 80, 0.0, 1, 0, 0.0, 0, 1), (9, 0.0, 12, 0.0, 60, 0.0, 1, 0, 0.0, 1, 1),
    (2, 0.0, 45, 0.0, 50, 0.0, 1, 0, 0.0, 0, 1), (1, 0.0, 3, 0.0, 20, 0.0, 1, 0, 0.0, 0, 1), (120, 0.1, 1, 0.0, 6, 0.0, 1, 0, 0.0, 0, 1),
    (30, 0.3, 70, 0.0, 12, 0.2, 1, 0, 0.0, 0, 1), (5, 0.0, 6, 0.0, 7, 0.0, 1, 0, 0.0, 0, 1), (6, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0.0, 1, 1),
    (40, 0.0, 4, 1.0, 9, 0.1, 1, 0, 0.0, 0, 1), (14, 0.2, 30, 0.0, 2, 0.0, 1, 0, 0.0, 0, 1), (300, 0.0, 9, 0.0, 3, 1.0, 1, 0, 0.0, 0, 1),
    (3, 0.0, 2, 0.0, 1, 0.0, 1, 0, 0.0, 0, 1), (2, 0.0, 3, 1.0, 0, 0.0, 1, 0, 0.0, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0.0, 1, 1), (4, 0.0, 2, 1.0, 3, 0.0, 1, 0, 0.0, 0, 1),
    (3, 0.3, 4, 0.0, 2, 0.0, 1, 0, 0.0, 0, 1), (4, 0.0, 9, 0.0, 2, 0.0, 1, 0, 0.0, 0, 1), (2, 0.0, 40, 0.0, 0, 0.0, 1, 0, 0.0, 0, 1),
    # Link lists inside articles.
    (6, 1.0, 5, 1.0, 7, 1.0, 1, 0, 0.0, 0, 0), (3, 1.0, 60, 0.0, 4, 1.0, 1, 0, 0.0, 0, 0), (9, 1.0, 4, 1.0, 10, 0.1, 1, 0, 0.0, 0, 0), (2, 1.0, 2, 1.0, 30, 0.0, 1, 0, 0.0, 0, 0),
    (12, 0.9, 40, 0.0, 0, 0.0, 1, 0, 0.0, 0, 0),
    # Menus, headers, footers, side bars, notices, adverts, forms and comments, long and short, also within articles.
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0.0, 0, 0), (2, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0.0, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0.0, 0, 0), (12, 0.1, 80, 0.0, 0, 0.0, 0, 1, 0.0, 0, 0),
    (40, 0.0, 10, 0.0, 35, 0.0, 0, 1, 0.0, 0, 0), (90, 0.0, 40, 0.0, 60, 0.0, 0, 1, 0.0, 0, 0), (25, 0.1, 6, 1.0, 5, 1.0, 0, 1, 0.0, 0, 0), (4, 0.0, 30, 0.0, 3, 0.0, 0, 1, 0.0, 1, 0),
    (70, 0.0, 50, 0.0, 5, 0.0, 1, 1, 0.0, 0, 0), (3, 0.0, 50, 0.0, 20, 0.0, 1, 1, 0.0, 1, 0), (15, 0.5, 45, 0.0, 60, 0.0, 1, 1, 0.0, 0, 0), (150, 0.0, 3, 0.0, 2, 0.0, 1, 1, 0.0, 0, 0),
    (7, 0.0, 7, 0.0, 7, 0.0, 0, 1, 0.0, 0, 0), (33, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0.0, 0, 0),
    # Pages that name no article: paragraphs and headings among paragraphs against what stands alone or links.
    (50, 0.0, 9, 0.0, 60, 0.0, 0, 0, 0.0, 0, 1), (80, 0.1, 50, 0.0, 4, 1.0, 0, 0, 0.0, 0, 1), (18, 0.0, 70, 0.0, 65, 0.0, 0, 0, 0.0, 0, 1), (22, 0.1, 3, 1.0, 40, 0.0, 0, 0, 0.0, 0, 1),
    (8, 0.0, 5, 1.0, 55, 0.0, 0, 0, 0.0, 1, 1), (7, 0.0, 60, 0.0, 48, 0.0, 0, 0, 0.0, 0, 1), (35, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1), (5, 0.0, 90, 0.0, 33, 0.0, 0, 0, 0.0, 1, 1),
    (16, 0.0, 0, 0.0, 30, 0.0, 0, 0, 0.0, 0, 1), (12, 0.0, 45, 0.0, 25, 0.0, 0, 0, 0.0, 0, 1), (28, 0.2, 33, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1),
    (3, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0.0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0.0, 0, 0), (10, 0.8, 12, 0.9, 9, 1.0, 0, 0, 0.0, 0, 0), (6, 0.5, 40, 0.0, 2, 1.0, 0, 0, 0.0, 0, 0),
    (7, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0.0, 0, 0), (9, 0.0, 4, 1.0, 2, 1.0, 0, 0, 0.0, 0, 0), (6, 0.0, 1, 1.0, 5, 0.9, 0, 0, 0.0, 1, 0), (11, 0.1, 3, 1.0, 0, 0.0, 0, 0, 0.0, 0, 0),
    (2, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0.0, 0, 0), (25, 0.9, 20, 0.8, 30, 0.9, 0, 0, 0.0, 0, 0), (4, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0.0, 0, 0), (3, 0.0, 2, 0.0, 1, 0.0, 0, 0, 0.0, 0, 0),
    # Parts whose name may say either: most of what is named so is not the article, but what holds nearly all of a page is.
    (70, 0.0, 50, 0.0, 5, 0.0, 1, 0, 1.0, 0, 0), (40, 0.0, 10, 0.0, 35, 0.0, 0, 0, 1.0, 0, 0), (12, 0.1, 80, 0.0, 0, 0.0, 0, 0, 0.9, 0, 0), (4, 0.0, 30, 0.0, 3, 0.0, 0, 0, 0.8, 1, 0),
    (3, 0.0, 50, 0.0, 20, 0.0, 1, 0, 0.9, 1, 0), (90, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0.5, 0, 0), (25, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0.4, 0, 0), (30, 0.0, 20, 0.0, 40, 0.0, 1, 0, 0.5, 0, 0),
    (60, 0.0, 8, 0.0, 45, 0.0, 1, 0, 0.1, 0, 1), (50, 0.0, 9, 0.0, 60, 0.0, 0, 0, 0.1, 0, 1), (80, 0.1, 50, 0.0, 4, 1.0, 0, 0, 0.2, 0, 1), (8, 0.0, 5, 1.0, 55, 0.0, 0, 0, 0.1, 1, 1),
    (18, 0.0, 70, 0.0, 65, 0.0, 0, 0, 0.2, 0, 1), (35, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1), (9, 0.0, 12, 0.0, 60, 0.0, 1, 0, 0.2, 1, 1),
]


@dataclass
class Tree:
    """Arrays of nodes: feature (-1 for a leaf), threshold, children, and the leaf's label."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    label: list[int]

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, label = map(np.array, (self.feature, self.threshold, self.left, self.right, self.label))
        node = np.zeros(len(x), dtype=np.int64)
        while (feature[node] >= 0).any():
            inner = feature[node] >= 0
            at = node[inner]
            below = x[inner, feature[at]] <= threshold[at]
            node[inner] = np.where(below, left[at], right[at])
        return label[node]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Tree:
    """A tree by Gini impurity, split half way between values; ties go to the earlier feature and smaller value."""
    tree = Tree([], [], [], [], [])

    def node(rows: np.ndarray, left_depth: int) -> int:
        own = y[rows]
        number = len(tree.feature)
        for column, value in zip((tree.feature, tree.threshold, tree.left, tree.right, tree.label), (-1, 0.0, -1, -1, int(2 * own.sum() > len(own))), strict=True):
            column.append(value)
        best = (len(rows) * 2 * own.mean() * (1 - own.mean()) - 1e-9, None, None)
        if left_depth:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    parts = [own[x[rows, f] <= cut], own[x[rows, f] > cut]]
                    impurity = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in parts)
                    if impurity < best[0] - 1e-9:
                        best = (impurity, f, float(cut))
        if best[1] is not None:
            below = x[rows, best[1]] <= best[2]
            tree.feature[number], tree.threshold[number] = best[1], best[2]
            tree.left[number] = node(rows[below], left_depth - 1)
            tree.right[number] = node(rows[~below], left_depth - 1)
        return number

    node(np.arange(len(x)), depth)
    return tree


@cache
def trained_tree() -> Tree:
    table = np.array(LABELLED, dtype=np.float64)
    return grow(table[:, :-1], table[:, -1])


@dataclass
class Block:
    text: str
    words: int
    links: float
    article: bool
    other: bool
    part: int  # number of the outermost part whose name may say either, 0 for none
    heading: bool


@dataclass
class Part:
    """An open container: inside an article, inside something else, inside a part (its number) whose name may say either."""

    tag: str
    article: bool = False
    other: bool = False
    named: int = 0


def _kind(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether a container says that it is an article, that it is something else, or has a name that may say either."""
    words = " ".join("".join(m) for m in NAMES.findall(attributes)).lower().split() if attributes else []
    # "has-sidebar" and the like, and names of the whole page or article, say nothing of what the part is.
    names = "" if tag in WHOLE_TAGS else " ".join(w for w in words if not w.startswith(("has-", "with-", "no-", "is-")))
    other = tag in OTHER_TAGS or bool(names and OTHER_NAMES.search(names)) or bool(attributes and HIDDEN.search(attributes))
    weak = bool(names and not other and WEAK_NAMES.search(names))
    return tag in ARTICLE_TAGS or bool(names and not other and ARTICLE_NAMES.search(names)), other, weak


def _within(outer: Part, tag: str, attributes: str, number: int) -> Part:
    """A container inside another; ``number`` is its own should its name say either."""
    article, other, weak = _kind(tag, attributes)
    if tag == "header" and outer.article and not outer.other:
        # The header of an article, with its title, belongs to it, unless its name says otherwise.
        names = " ".join("".join(m) for m in NAMES.findall(attributes)).lower()
        if not names or (ARTICLE_NAMES.search(names) and not OTHER_NAMES.search(names)):
            other = weak = False
    return Part(tag, outer.article or article, outer.other or other, outer.named or (number if weak else 0))


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page, in its order. Tags that are never closed, or never opened, do no harm.

    The content of an element without text ends at its end tag. Where there is none before the next one of its kind begins, or it closes itself, only
    the tag goes; an open script or style takes the rest of the page. A heading that announces comments makes the rest of its container one of readers.
    """
    blocks: list[Block] = []
    parts = [Part("")]
    open_tags: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    links = number = 0
    heading = False
    odd: Part | None = None  # a paragraph that itself says what it is

    def close() -> None:
        nonlocal pieces
        text = " ".join(html.unescape("".join(p for p, _ in pieces)).split()) if pieces else ""
        if text:
            words = len(text.split())
            linked = len(" ".join(html.unescape(p) for p, in_link in pieces if in_link).split())
            own = odd or parts[-1]
            if heading and READERS.fullmatch(text):
                parts[-1].other = True
                own = parts[-1]
            blocks.append(Block(text, words, min(1.0, linked / words), own.article, own.other, own.named, heading))
        pieces = []

    at = skipped = 0
    for m in TOKEN.finditer(page):
        if m.start() < skipped:
            continue
        if m.start() > at:
            pieces.append((page[at : m.start()], links > 0))
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in NEXT_TAG:
            if not closing and (tag in RAW_TAGS or not attributes.endswith("/")):
                end = NEXT_TAG[tag].search(page, at)
                if end and end[1]:
                    at = skipped = end.end()
                elif tag in RAW_TAGS:
                    at = len(page)
                    break
        elif tag == "a":
            links = max(0, links - 1) if closing else 1
        elif tag == "br":
            pieces.append((" ", False))
        elif tag in BLOCK_TAGS:
            close()
            links, odd = 0, None
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag in CONTAINERS:
                if not closing:
                    number += 1
                    parts.append(_within(parts[-1], tag, attributes, number))
                    open_tags[tag] += 1
                elif open_tags[tag]:
                    while True:
                        ended = parts.pop().tag
                        open_tags[ended] -= 1
                        if ended == tag:
                            break
            elif not closing and attributes:
                number += 1
                odd = _within(parts[-1], tag, attributes, number)
    if at < len(page):
        pieces.append((page[at:], links > 0))
    close()
    return blocks


def _named(blocks: list[Block]) -> list[float]:
    """For blocks of parts whose name may say either, how far the name is believed: wholly where the page has an article elsewhere, else the less
    the more of the page's words outside links the part holds."""
    if any(b.article and not b.other and not b.part and not b.heading for b in blocks):
        return [float(b.part > 0) for b in blocks]
    held: Counter[int] = Counter()
    for b in blocks:
        if not b.other:
            held[b.part] += b.words * (1 - b.links)
    whole = sum(held.values()) or 1.0
    return [1 - held[b.part] / whole if b.part else 0.0 for b in blocks]


def features_of(blocks: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.links) for b in blocks], dtype=np.float64).reshape(-1, 2)
    edge = np.zeros((1, 2))
    flags = np.array([(b.article, b.other, n, b.heading) for b, n in zip(blocks, _named(blocks), strict=True)], dtype=np.float64).reshape(-1, 4)
    return np.hstack([own, np.vstack([edge, own])[: len(own)], np.vstack([own[1:], edge])[: len(own)], flags])


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The main text of every page: blocks that the tree keeps, in order, with an empty line between; all pages are judged at once."""
    blocks = [blocks_of(p or "") for p in pages]
    x = [features_of(b) for b in blocks if b]
    kept = tree.predict(np.vstack(x)).astype(bool).tolist() if x else []
    out, start = [], 0
    for own in blocks:
        out.append("\n\n".join(b.text for b, keep in zip(own, kept[start : start + len(own)], strict=True) if keep))
        start += len(own)
    return out


def _extract(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = main_texts(part.column("html").to_pylist(), tree.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=RESULT)

    return run


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block is one blank, blocks are joined by two line ends; nothing else is cut. Null
    and empty pages, and pages without main text, have an empty text. Rows that repeat are extracted one by one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(tree or trained_tree())
    return bounded_batches(rows).mapInArrow(_extract(shared), RESULT_SQL)
