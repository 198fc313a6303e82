"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut into text blocks at block-level tags. Features of a block are its
words and link density, those of the blocks before and after it, whether its own
element is a paragraph or heading, one mark for where it stands (1 inside an
article, -1 inside furniture, 0 where nothing says so), and whether the page marks
any article. The tree is grown from LABELLED, a small table of blocks that were
judged by hand, half of them from layouts without marks.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "prose", "mark", "page_marked")

# Blocks judged by hand, FEATURES and then 1 for main text, 0 for others.
LABELLED = [
    # paragraphs, headings and list items of marked articles
    (120, 0.0, 80, 0.0, 60, 0.0, 1, 1, 1, 1), (40, 0.1, 120, 0.0, 5, 0.0, 1, 1, 1, 1), (1, 0.0, 90, 0.0, 1, 0.0, 1, 1, 1, 1),
    (2, 0.0, 1, 0.0, 0, 0.0, 1, 1, 1, 1), (9, 0.0, 12, 0.0, 100, 0.0, 1, 1, 1, 1), (7, 0.0, 1, 1.0, 30, 0.0, 1, 1, 1, 1),
    (30, 0.3, 50, 0.0, 40, 0.0, 1, 1, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 1, 1, 1), (300, 0.0, 9, 0.0, 12, 0.0, 1, 1, 1, 1),
    (15, 0.0, 2, 0.0, 9, 0.0, 0, 1, 1, 1), (3, 0.0, 40, 0.0, 20, 0.0, 0, 1, 1, 1), (8, 0.5, 20, 0.0, 25, 0.1, 0, 1, 1, 1),
    (5, 1.0, 60, 0.0, 80, 0.0, 1, 1, 1, 1), (12, 1.0, 45, 0.0, 70, 0.0, 1, 1, 1, 1), (6, 0.0, 8, 0.0, 14, 0.0, 1, 1, 1, 1),
    (25, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1), (11, 0.0, 1, 1.0, 9, 0.0, 1, 1, 1, 1), (10, 0.0, 40, 0.0, 0, 0.0, 0, 1, 1, 1),
    # link lists inside marked articles
    (4, 1.0, 4, 1.0, 4, 1.0, 0, 1, 1, 0), (4, 1.0, 60, 0.0, 4, 1.0, 0, 1, 1, 0), (3, 1.0, 4, 1.0, 0, 0.0, 0, 1, 1, 0),
    (6, 1.0, 5, 1.0, 7, 1.0, 1, 1, 1, 0), (2, 1.0, 2, 1.0, 30, 0.0, 0, 1, 1, 0), (9, 0.9, 8, 0.9, 6, 1.0, 0, 1, 1, 0),
    # paragraphs and headings of pages without marks
    (60, 0.0, 40, 0.0, 30, 0.1, 1, 0, 0, 1), (25, 0.05, 60, 0.0, 70, 0.0, 1, 0, 0, 1), (8, 0.0, 3, 1.0, 60, 0.0, 1, 0, 0, 1),
    (4, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 1), (45, 0.0, 2, 1.0, 6, 0.0, 1, 0, 0, 1), (120, 0.1, 10, 0.0, 3, 1.0, 1, 0, 0, 1),
    (18, 0.0, 35, 0.0, 22, 0.0, 1, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (6, 0.0, 0, 0.0, 45, 0.0, 1, 0, 0, 1),
    (2, 0.0, 60, 0.0, 12, 0.0, 1, 0, 0, 1), (1, 0.0, 3, 0.0, 9, 0.0, 1, 0, 0, 1), (10, 0.0, 8, 0.0, 80, 0.0, 1, 0, 0, 1),
    (7, 0.0, 9, 0.0, 2, 0.0, 1, 0, 0, 1), (3, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 1), (12, 0.0, 25, 0.0, 15, 0.0, 1, 0, 0, 1),
    (1, 0.0, 1, 0.0, 14, 0.0, 1, 0, 0, 1), (5, 1.0, 50, 0.0, 60, 0.0, 1, 0, 0, 1), (9, 0.0, 1, 1.0, 7, 0.0, 1, 0, 0, 1),
    # text of such pages in other elements: long runs, items of a list within the text
    (60, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 1), (40, 0.0, 3, 0.0, 70, 0.0, 0, 0, 0, 1), (22, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (90, 0.1, 30, 0.0, 0, 0.0, 0, 0, 0, 1), (35, 0.1, 45, 0.0, 20, 0.0, 0, 0, 0, 1), (50, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1),
    (12, 0.0, 30, 0.0, 11, 0.0, 0, 0, 0, 1), (9, 0.0, 11, 0.0, 13, 0.0, 0, 0, 0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    # furniture of such pages: lines after a menu, last lines, scraps
    (8, 0.0, 2, 1.0, 9, 0.0, 0, 0, 0, 0), (13, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0, 0), (11, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0, 0),
    (6, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0, 0), (17, 0.0, 3, 1.0, 11, 0.0, 0, 0, 0, 0), (14, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0),
    (9, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 0), (17, 0.0, 25, 0.0, 0, 0.0, 0, 0, 0, 0), (12, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0, 0),
    (10, 0.2, 90, 0.0, 0, 0.0, 0, 0, 0, 0), (8, 0.4, 2, 1.0, 0, 0.0, 0, 0, 0, 0), (4, 0.0, 100, 0.0, 0, 0.0, 0, 0, 0, 0),
    (22, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0), (5, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, 0),
    # link lists of such pages
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 1.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0),
    (12, 0.6, 30, 0.0, 2, 1.0, 0, 0, 0, 0), (4, 1.0, 4, 1.0, 4, 1.0, 1, 0, 0, 0), (25, 0.9, 30, 0.9, 20, 0.9, 0, 0, 0, 0),
    (1, 1.0, 2, 1.0, 8, 0.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 70, 0.0, 0, 0, 0, 0), (15, 0.9, 14, 1.0, 16, 0.8, 1, 0, 0, 0),
    # marked furniture: menus, headers, footers, sidebars, notices, adverts, forms, comments
    (1, 1.0, 1, 1.0, 1, 1.0, 0, -1, 1, 0), (12, 0.0, 1, 1.0, 9, 0.0, 0, -1, 1, 0), (6, 0.0, 80, 0.0, 0, 0.0, 0, -1, 1, 0),
    (80, 0.0, 70, 0.0, 60, 0.0, 1, -1, 1, 0), (20, 0.0, 120, 0.0, 100, 0.0, 1, -1, 1, 0), (200, 0.1, 0, 0.0, 9, 0.0, 1, -1, 0, 0),
    (3, 0.0, 40, 0.0, 2, 0.0, 1, -1, 0, 0), (45, 0.0, 30, 0.0, 25, 0.0, 1, -1, 1, 0), (1, 0.0, 90, 0.0, 1, 0.0, 0, -1, 1, 0),
    (60, 0.0, 40, 0.0, 30, 0.1, 1, -1, 0, 0), (2, 0.0, 60, 0.0, 70, 0.0, 1, -1, 1, 0), (9, 1.0, 9, 1.0, 9, 1.0, 0, -1, 1, 0),
    (25, 0.0, 60, 0.0, 70, 0.0, 1, -1, 0, 0), (30, 0.1, 10, 0.0, 40, 0.0, 0, -1, 0, 0), (8, 0.0, 3, 1.0, 60, 0.0, 1, -1, 0, 0),
    # link lists, with and without marks: menus, tags, pages before and after, related links
    (1, 1.0, 6, 0.0, 1, 1.0, 0, -1, 1, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, -1, 1, 0), (1, 1.0, 2, 1.0, 9, 0.0, 0, -1, 1, 0),
    (3, 1.0, 2, 1.0, 1, 1.0, 0, -1, 0, 0), (7, 1.0, 6, 1.0, 8, 1.0, 0, -1, 1, 0), (2, 0.8, 40, 0.0, 2, 1.0, 0, -1, 1, 0),
    (1, 1.0, 1, 1.0, 12, 0.0, 0, -1, 0, 0), (4, 1.0, 12, 0.0, 4, 1.0, 0, -1, 1, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, -1, 1, 0),
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 0, 1, 0), (1, 1.0, 80, 0.0, 1, 1.0, 0, 0, 1, 0), (6, 1.0, 5, 1.0, 0, 0.0, 0, 0, 1, 0),
    (2, 1.0, 2, 1.0, 5, 1.0, 0, 0, 0, 0), (8, 0.8, 7, 1.0, 9, 0.9, 0, 0, 0, 0), (1, 1.0, 5, 0.0, 1, 1.0, 0, 0, 0, 0),
    (5, 1.0, 6, 1.0, 4, 1.0, 0, 1, 1, 0), (1, 1.0, 30, 0.0, 1, 1.0, 0, 1, 1, 0), (2, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0),
    # outside the article of a page that marks one
    (15, 0.0, 3, 1.0, 100, 0.0, 1, 0, 1, 0), (150, 0.0, 90, 0.0, 70, 0.0, 1, 0, 1, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 1, 0),
    (8, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0), (35, 0.1, 100, 0.0, 12, 0.0, 1, 0, 1, 0), (60, 0.0, 2, 1.0, 9, 0.0, 1, 0, 1, 0),
    (25, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1, 0), (4, 0.0, 60, 0.0, 70, 0.0, 1, 0, 1, 0), (9, 0.0, 40, 0.0, 3, 0.0, 1, 0, 1, 0),
]

# Words of class, id and role that name furniture, or the article.
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs byline captcha comment comments complementary consent contentinfo cookie cookies "
    "copyright dialog discussion disqus footer form gdpr header links login masthead menu menus modal nav navbar navigation newsletter notice "
    "notices pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags toolbar topbar trackback widget widgets".split()
)
ARTICLE_NAMES = frozenset("article content entry main post story".split())
APART_NAMES = frozenset("comment comments discussion disqus related replies reply respond recommended".split())  # an article in there is none of the page's
ARTICLE_APART_NAMES = APART_NAMES | frozenset("ad ads advert advertisement adverts promo promoted promotion sponsor sponsored".split())  # as whole names of an article element

# Tags by their part in the layout.
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
APART_TAGS = frozenset("aside dialog footer nav".split())
FURNITURE_TAGS = frozenset("aside button dialog footer form head header menu nav noscript option select title".split())
RAW_TAGS = frozenset("iframe math noembed noframes object script style svg template textarea video audio canvas".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPEN_TAGS = frozenset("p li dt dd tr td th thead tbody tfoot option rp rt".split())  # their end tags may be left out
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'">])*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[a-z]+")


def named(attributes: str) -> tuple[frozenset[str], frozenset[str]]:
    """Lower-case words in class, id and role, and the whole names there."""
    if "=" not in attributes:
        return frozenset(), frozenset()
    found = [m.strip("\"'") for m in NAMES.findall(attributes)]
    return frozenset(PARTS.findall(" ".join(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m).lower() for m in found))), frozenset(" ".join(found).lower().split())


def furniture_level(name: str, parts: frozenset[str], whole: frozenset[str], in_article: bool) -> int:
    """2: furniture with all that is in it, 1: furniture but for an article in it, 0: none.

    An article element is furniture only by the whole name of an advert, a comment
    or another story, and an element named after both furniture and an article, as content-sidebar-wrap, is neither.
    """
    if name == "article":
        return 2 * bool(whole & ARTICLE_APART_NAMES)
    names = parts & FURNITURE_NAMES if not parts & ARTICLE_NAMES else whole & FURNITURE_NAMES
    if name in APART_TAGS or names & APART_NAMES:
        return 2
    return int(bool(names) or name in FURNITURE_TAGS and not (name == "header" and in_article))


def text_blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, prose, mark) of the page's blocks that have words."""
    blocks: list[tuple[str, int, float, int, int]] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, level of furniture, in an article
    parts: list[tuple[str, bool]] = []
    open_now: Counter[str] = Counter()
    in_link, own, prose, quoted, at, end = False, 0, 0, True, 0, len(page)

    def flush() -> None:
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            words = text.count(" ") + 1
            linked = sum(len(p.split()) for p, link in parts if link)
            blocks.append((text, words, min(1.0, linked / words), prose, -1 if own or stack[-1][1] else stack[-1][2]))
        parts.clear()

    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            tag = end
        if tag > at:
            parts.append((html.unescape(page[at:tag]), in_link))
        if tag == end:
            break
        if page.startswith("<!--", tag):
            at = page.find("-->", tag + 4) + 3
            at = at if at > 2 else end
            continue
        if page.startswith(("<!", "<?"), tag):
            at = page.find(">", tag) + 1 or end
            continue
        m = TAG.match(page, tag) if quoted else PLAIN_TAG.match(page, tag)
        if m is None:
            after = page[tag + 1 : tag + 3]
            if not (after[:1].isalpha() and after[:1].isascii() or after[:1] == "/" and after[1:].isalpha()):
                parts.append(("<", in_link))  # a sign, not a tag
                at = tag + 1
            elif quoted and page.find(">", tag) >= 0:
                quoted = False  # a quote that isn't closed: tags end at the next > from here on
                at = tag
            else:
                at = end  # the page ends within a tag
            continue
        at = m.end()
        closing, name = bool(m[1]), m[2].lower()
        if name in RAW_TAGS:
            if not closing and not m[3].endswith("/"):
                close = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
                at = end if close is None else page.find(">", close.start()) + 1 or end
            continue
        if name == "br":
            parts.append((" ", in_link))
        if name == "a":
            in_link = not closing
        if name not in INLINE_TAGS:
            flush()
            own, prose = 0, int(name in PROSE_TAGS and not closing)
        if name in VOID_TAGS:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0) if open_now[name] else 0
            if depth:
                if name in INLINE_TAGS and (stack[-1][1], stack[-1][2]) != (stack[depth - 1][1], stack[depth - 1][2]):
                    flush()
                open_now.subtract(s[0] for s in stack[depth:])
                del stack[depth:]
            continue
        _, furniture, article = stack[-1]
        parts_of, whole = named(m[3]) if name not in ("html", "body") else (frozenset(), frozenset())
        level = furniture_level(name, parts_of, whole, bool(article))
        if name in OPEN_TAGS:
            in_link, own = False, level
            continue
        if name == "main":
            furniture, level, article = 0, 0, 1
        elif name == "article" and not level:
            furniture, article = furniture if furniture > 1 else 0, 1
        elif name in ("div", "section") and parts_of & ARTICLE_NAMES and not level:
            article = 1
        if level and not furniture and name in INLINE_TAGS:
            flush()
        open_now[name] += 1
        stack.append((name, max(furniture, level), article))
    flush()
    return blocks


def features(blocks: list[tuple[str, int, float, int, int]]) -> np.ndarray:
    own = np.array([b[1:] for b in blocks], np.float64).reshape(-1, 4)
    around = np.zeros((len(blocks) + 2, 2))
    around[1:-1] = own[:, :2]
    has = np.full((len(blocks), 1), float((own[:, 3] > 0).any()))
    return np.hstack([own[:, :2], around[:-2], around[2:], own[:, 2:], has])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9):
    """A decision tree by Gini impurity: a class, or (feature, threshold, tree if at most, tree if above)."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return int(2 * y.sum() > len(y))
    best = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for threshold in ((values[1:] + values[:-1]) / 2).tolist():
            low = x[:, feature] <= threshold
            impurity = sum(part.sum() * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, feature, threshold
    if best is None:
        return int(2 * y.sum() > len(y))
    _, feature, threshold = best
    low = x[:, feature] <= threshold
    return feature, threshold, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@functools.cache
def tree():
    rows = np.array(LABELLED, np.float64)
    return grow(rows[:, :-1], rows[:, -1])


def judge(x: np.ndarray, node=None) -> np.ndarray:
    node = tree() if node is None else node
    if isinstance(node, int):
        return np.full(len(x), bool(node))
    feature, threshold, low, high = node
    below = x[:, feature] <= threshold
    out = np.empty(len(x), bool)
    out[below], out[~below] = judge(x[below], low), judge(x[~below], high)
    return out


def main_text(page: str | None) -> str:
    """The page's main text, one line a block; empty for null, for no page and where nothing is main text."""
    blocks = text_blocks(page) if page else []
    if not blocks:
        return ""
    return "\n".join(b[0] for b, main in zip(blocks, judge(features(blocks)), strict=True) if main)


@F.pandas_udf(T.StringType())
def main_text_udf(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of every whole page, however long; a column of that name is replaced.

    A null or empty page has an empty text; rows that repeat are treated alike, an
    empty table gives no rows, and other columns stay as they are.
    """
    return pages.withColumn(text, main_text_udf(F.col(source)))


def op6_html_text(spark, sf_dir):
    """The main text of every page."""
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
