"""Main text of web pages by the distribution of text over lines.

Markup is cut into lines at block-level tags.  A line weighs its text outside of
links; lines of parts that never belong to the article (menus, forms, adverts,
comments, ...) weigh nothing.  Weights are summed over sliding windows of lines:
text starts where a window surges over a limit and ends where it dives to
nothing, and the weighing lines between those points are kept.  If the page
marks its article, only lines inside it weigh, and each weighs enough to surge,
unless what surges outside the marks outweighs them: then they are teasers.

Defined results: null, empty and text-free pages give an empty string; unclosed
tags end with the page; stray ``<`` are text; character references are decoded once.
Repeated rows stay repeated and an empty table gives an empty one; a very long page is one row; columns other than
page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tilewright.llm.common import in_batches

# Element names of HTML by their role.
RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|canvas|video|audio|select|button"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rb rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav aside footer form menu dialog fieldset figcaption".split())
ARTICLE, MAIN = "article", "main"
SELF_CLOSING = frozenset("p li td th tr dt dd option".split())

# Words in class, id and role that mark parts outside the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar widget "
    "footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login search share sharing social comment comments reply replies "
    "disqus related recommended recommendations pagination pager copyright skip toolbar contentinfo complementary".split())
HEADER_HINTS = frozenset("header masthead topbar".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-z!?][^>]*>",
    re.IGNORECASE | re.DOTALL)
MARKS = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PARTS = re.compile(r"[^a-z0-9]+")


@dataclass(frozen=True)
class Blocks:
    """Window size in lines, the window weight at which text surges, and how much more than all marked text makes marks teasers."""

    window: int = 3
    surge: int = 80
    outweigh: float = 2.0


@dataclass
class Line:
    text: str
    linked: int
    dropped: bool
    article: bool
    main: bool


def _hinted(attributes: str) -> set[str]:
    """Words in the attributes that say what a part is."""
    return set(PARTS.split(" ".join(next(filter(None, m), "") for m in MARKS.findall(attributes)).lower()))


def lines_of(page: str) -> list[Line]:
    """Lines with text, in page order, with the parts of the page they are in."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    links = articles = mains = 0  # open now; links do not nest
    dropped: list[list] = []  # innermost last: [tag, open tags of that name]

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, linked, bool(dropped), articles > 0, mains > 0))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            add(page[at:token.start()])
        at = token.end()
        name = (token[3] or "").lower()
        if not name:
            continue
        closing = bool(token[2])
        if name == "a":
            links = 0 if closing else 1
        if name in INLINE and not (dropped and dropped[-1][0] == name):
            if closing or not token[4] or not _hinted(token[4]) & HINTS:
                continue
        close()
        if name == "body":
            continue
        if name == ARTICLE:
            articles = max(0, articles + (-1 if closing else 1))
        if name == MAIN:
            mains = max(0, mains + (-1 if closing else 1))
        if dropped:
            inner = dropped[-1]
            if name == inner[0] and name not in VOID:
                inner[1] += -1 if closing else 0 if name in SELF_CLOSING else 1
                if not closing and name in SELF_CLOSING:
                    dropped.pop()
                elif inner[1] <= 0:
                    dropped.pop()
                    continue
                else:
                    continue
            else:
                continue
        if not closing and name not in VOID:
            hints = _hinted(token[4]) if token[4] else set()
            header = name == "header" or bool(hints & HEADER_HINTS)
            if name in DROPPED or hints & HINTS or "hidden" in token[4].lower().split() or header and not (articles or mains):
                dropped.append([name, 1])
    if at < len(page):
        add(page[at:])
    close()
    return lines


def surged(weights: list[int], how: Blocks) -> list[int]:
    """Lines from where a window's weight surges to where it dives to nothing."""
    kept, inside = [], False
    for i, weight in enumerate(weights):
        window = sum(weights[i:i + how.window])
        if not inside:
            inside = weight > 0 and window >= how.surge
        elif window == 0:
            inside = False
        if inside and weight:
            kept.append(i)
    return kept


def main_text(page: str | None, how: Blocks = Blocks()) -> str:
    """Text of the lines that surge by their lengths without links.

    Lines in ``article``, else in ``main``, weigh at least a surge and others nothing, unless what surges outside them
    weighs more than ``outweigh`` times as much: then they are teasers, and the text is outside.
    """
    lines = lines_of(page or "")
    own = [0 if x.dropped else max(0, len(x.text) - x.linked) for x in lines]
    article, main = [x.article and not x.dropped for x in lines], [x.main and not x.dropped for x in lines]
    marked = article if any(article) else main
    weights = own
    if any(marked):
        outside = [0 if m else w for w, m in zip(own, marked)]
        if sum(outside[i] for i in surged(outside, how)) > how.outweigh * sum(w for w, m in zip(own, marked) if m):
            weights = outside
        else:
            weights = [max(len(x.text), how.surge) if m else 0 for x, m in zip(lines, marked)]
    # Too short to surge anywhere: the page is one short text.
    kept = surged(weights, how) or [i for i, w in enumerate(weights) if w]
    return " ".join(lines[i].text for i in kept)


def extract_text(pages: DataFrame, how: Blocks = Blocks()) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    def work(rows):
        texts = [main_text(page, how) for page in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return in_batches(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long")
