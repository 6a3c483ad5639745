"""Main text of web pages by line-block distribution: where line lengths surge and dive."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from textmeter.llm.common import derive

#: Lines that a window sums over.
WINDOW = 3
#: Characters in a window that make a surge; a page of short texts needs this share of its fullest window only.
SURGE, SURGE_SHARE = 86, 0.5

# --- fixed values: elements, roles and names ---------------------------------

#: Their content is no markup; it ends at the next end tag of that name.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary "
    "table tbody td template tfoot th thead tr ul".split()
)
#: Blocks that hold text rather than other blocks; a line belongs to the block around them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption figure hr address caption td th tr tbody thead tfoot table ul ol dl".split())
#: An element that begins ends an open one of these, if no block stands between.
ENDS = {
    **{t: frozenset({"p"}) for t in BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption"}},
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
    "tbody": frozenset({"tr", "td", "th", "tbody", "thead", "p"}),
}
#: Never part of the main text.
DROPPED = frozenset(
    "aside button canvas datalist dialog footer form frameset head iframe input label math menu nav noscript object optgroup option "
    "audio video script search select style svg template textarea title".split()
)
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words in a class or id that name something beside the text.
DROPPED_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs colophon comment comments commentlist "
    "consent cookie cookies copyright disclaimer discussion disqus footer gdpr header hidden legal login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification notifications outbrain overlay pager pagination paywall popup promo promoted promotion "
    "recommendations recommended register related replies reply respond responses search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription taboola toolbar topbar warning widget widgets".split()
)
#: Words in a class or id that name the text itself; its own header belongs to it.
TEXT_NAMES = frozenset("article body content entry main post story text".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"'>]|\Z)", re.I)
NAME_WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Line(NamedTuple):
    """A block's text, the characters of it outside of links, and the block it stands in."""
    text: str
    weight: int
    holder: int
    #: The outermost element around it that holds the page's text, or -1.
    main: int


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest else {}


def beside_the_text(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is menu, header, footer, notice, advert, form or comment; ``inside``: it lies in the main text."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    if name in ("html", "body", "main"):
        return False
    words = set(NAME_WORD.findall(CAMEL.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower()))
    beside = words & DROPPED_NAMES
    # "article-header" and the like head the text itself.
    return bool(beside) and not (beside <= {"header", "banner"} and words & TEXT_NAMES)


def _holds_text(name: str, attributes: dict[str, str]) -> bool:
    return name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()


class _Element:
    __slots__ = ("name", "number", "dropped", "main", "holder", "link", "start")

    def __init__(self, name, number, dropped, main, holder, link, start):
        self.name, self.number, self.dropped, self.main, self.holder, self.link, self.start = name, number, dropped, main, holder, link, start


def _tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, element name, whether it ends there, attributes) of each tag; other markup has no name."""
    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            yield page[at:], "", False, ""
            return
        name, closes = (m["name"] or "").lower(), m["close"] == "/"
        yield page[at:m.start()], name, closes, m["rest"] or ""
        at = m.end()
        if name in RAW and not closes:
            end = re.compile(rf"</{name}(?=[\s/>])|\Z", re.I).search(page, at)
            at = end.start()


def _unclosed(page: list[tuple[str, str, bool, str]]) -> set[int]:
    """Which start tags (by place) have no end tag of their own."""
    open_at: dict[str, list[int]] = {}
    for place, (_, name, closes, _) in enumerate(page):
        if closes:
            if open_at.get(name):
                open_at[name].pop()
        elif name and name not in VOID:
            open_at.setdefault(name, []).append(place)
    return {place for places in open_at.values() for place in places}


def lines_of(page: str) -> list[Line]:
    """The page's lines: one for each block with text, and an empty one for each part left out.

    Markup is stripped, character references are decoded, white space becomes
    one blank. An element left out that is never closed ends at the next tag of
    a block, so broken markup does not swallow the text behind it.
    """
    tokens = list(_tokens(page))
    unclosed = _unclosed(tokens)
    root = _Element("", 0, False, -1, 0, False, 0)
    stack, lines, text, linked = [root], [], [], 0

    def end_line() -> None:
        nonlocal linked
        top = stack[-1]
        if text:
            words = " ".join("".join(text).split())
            if words:
                lines.append(Line(words, max(0, len(words) - linked), top.holder, top.main))
            text.clear()
        linked = 0

    for place, (before, name, closes, rest) in enumerate(tokens):
        top = stack[-1]
        if before and not top.dropped:
            decoded = html.unescape(before) if "&" in before else before
            text.append(decoded)
            if top.link:
                linked += len(decoded.strip())
        if not name:
            continue
        block = name in BLOCKS
        if block and not (top.dropped and top.start >= 0):
            end_line()
        if name == "br":
            if not top.dropped:
                text.append(" ")
            continue
        # What was left out and is never closed ends here.
        while block and len(stack) > 1 and stack[-1].dropped and stack[-1].start < 0:
            stack.pop()
        if closes:
            for depth in range(len(stack) - 1, 0, -1):
                held = stack[depth].name
                if held == name:
                    del stack[depth:]
                    break
                # An inline end tag ends no block, and that of a paragraph no other block.
                if held in BLOCKS and (not block or name == "p"):
                    break
            continue
        if name in VOID or rest.endswith("/") and name not in BLOCKS:
            continue
        ended = ENDS.get(name, ())
        while stack[-1].name in ended:
            stack.pop()
        top = stack[-1]
        attributes = _attributes(rest)
        number = place + 1
        drop = top.dropped or beside_the_text(name, attributes, top.main >= 0)
        main = top.main if top.main >= 0 or drop or not _holds_text(name, attributes) else number
        # Below zero: this part is left out and has no end tag.
        start = top.start if top.dropped else -1 if drop and place in unclosed else 0
        if drop and not top.dropped and block:
            lines.append(Line("", 0, number, -1))
        holder = number if block and name not in LEAVES else top.holder
        stack.append(_Element(name, number, drop, main, holder, top.link or name == "a", start))
    end_line()
    return lines


def segments(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, end) of the stretches of lines from a surge to the next dive.

    A window's sum is that of its line and those behind it. A stretch begins
    where the sum reaches the surge and ends before a window of nothing; lines
    without any text at its edges are no part of it.
    """
    n = len(weights)
    total = np.concatenate(([0], np.cumsum(weights, dtype="i8")))
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    if not n or sums.max() == 0:
        return []
    least = min(SURGE, SURGE_SHARE * sums.max())
    found, at = [], 0
    while at < n:
        if sums[at] < least:
            at += 1
            continue
        dives = np.flatnonzero(sums[at:] == 0)
        end = at + int(dives[0]) if len(dives) else n
        inner = [i for i in range(at, end) if weights[i]]
        found.append((inner[0], inner[-1] + 1))
        at = end
    return found


def main_text(page: str) -> str:
    """The page's main text, its blocks joined by line breaks.

    The stretch of lines with the most text says where the main text is. It is
    an element that marks itself as such, with all its lines; else the stretch,
    with the other lines and stretches that stand in the blocks most of it stands in.
    """
    lines = lines_of(page)
    found = segments([line.weight for line in lines])
    if not found:
        return "\n".join(line.text for line in lines if line.text and line.main >= 0)
    by_main: dict[int, int] = {}
    for line in lines:
        if line.main >= 0:
            by_main[line.main] = by_main.get(line.main, 0) + line.weight
    first, end = max(found, key=lambda s: (sum(line.weight for line in lines[s[0]:s[1]]), -s[0]))
    inside: dict[int, int] = {}
    for line in lines[first:end]:
        inside[line.main] = inside.get(line.main, 0) + line.weight
    main = max(inside, key=lambda m: (inside[m], m))
    if main < 0 and by_main and max(by_main.values()) >= inside[-1]:
        main = max(by_main, key=lambda m: (by_main[m], -m))
    if main >= 0:
        return "\n".join(line.text for line in lines if line.text and line.main == main)
    held: dict[int, int] = {}
    for line in lines[first:end]:
        held[line.holder] = held.get(line.holder, 0) + line.weight
    most = max(held.values())
    holders = {h for h, weight in held.items() if 2 * weight >= most}
    kept = [line.text for i, line in enumerate(lines) if line.text and line.holder in holders and (line.weight or first <= i < end)]
    return "\n".join(kept)


_FIELDS = StructType([StructField("text", StringType())])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text``: each page's main text.

    Left out are scripts, styles, comments in the markup, menus, page headers,
    footers, sidebars, notices, adverts, forms and readers' comments: by element,
    role, or the words in class and id. The rest is read as lines, one a block;
    sums of line lengths (without links) over windows of ``WINDOW`` lines locate
    where text surges and dives, and the text between stays (``main_text``).
    Character references are decoded, white space in a block becomes one blank,
    blocks are joined by one line break; nothing else is dropped or cut.

    Each page is read whole, by itself: nothing is shuffled, equal pages and hosts
    are no group, memory follows the longest page. A null or empty page, or one
    without text, gives an empty text. Repeated rows come back each; null keys and
    other columns pass through; a column ``text`` is replaced. An empty table
    gives an empty table.
    """
    return derive(pages, html, _FIELDS, [pa.string()], lambda page: (main_text(page),))
