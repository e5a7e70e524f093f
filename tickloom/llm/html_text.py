"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks of text at block-level tags.  Each block has its word
count and link density, those of the blocks before and after it that stand in no
marked part, how surely it stands in a part of the page that is no article
(menu, footer, advert, ...) and whether it stands in the article.  A CART tree
trained on the small labelled table below tells text from the rest: beside the
marks it reads a block's own link density and words and its neighbours'.

Inline elements mark parts too: text in a marked span, label or button is a block
of its own and leaves the block around it, which stays one.

A word of a class, id or role marks a part less surely than an element's name:
it marks no wrapper of the page's article, main or h1, none in a compound that
tells a state (``has-sidebar``, ``comments-open``), and where no block of a page
passes, the tree judges the blocks so marked without the mark.  Words that also
name an article's subject (``discussion``, ``search``, ``social``) are weaker
still: within the article they count only for blocks made of links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tickloom.llm.workspace import bound_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|aria-modal)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
# HTML's element names by what they mean for text.
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas audio video".split())
#: Elements whose text runs to the end of the page where they are not closed; others of _RAW that are not closed are passed over.
_TO_END = set("script style textarea title xmp".split())
# Start tags that end an svg or math element which is not closed before them.
_BREAKS = "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var"
_BOILER = set("nav aside footer form button select dialog menu fieldset label option datalist search".split())
_MAIN = set("article main".split())
# Words in class, id or role that mark parts of a page.
_BAD = set("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar skip social sponsor sponsored subscribe subscription taboola toolbar topbar warning widget alert complementary contentinfo search".split())
# Those of them that also name what an article is about.
_WEAK = set("discussion search social skip respond widget modal subscription complementary".split())
_GOOD = set("article entry post story content main body".split())
# Words that open or close a class, id or role which tells of the page or of a state, not of a part.
_STATE, _STATES = set("has with without no not is page".split()), set("open opened closed enabled disabled on off page layout".split())
# Words in class, id or role of a site's header, whose h1 is not the article's.
_SITE = set("masthead banner header topbar toolbar navbar".split())

#: Small labelled table: words, link density, words and link density of the block before, of the block after (unmarked ones),
#: mark of a non-article part (0 none, 1 weak word, 2 word, 3 element or hidden), in the article (0/1), text (1) or not (0).
LABELLED = [
    (60, 0.0, 45, 0.0, 80, 0.0, 0, 1, 1), (12, 0.0, 5, 0.9, 70, 0.0, 0, 1, 1), (3, 0.0, 60, 0.0, 55, 0.0, 0, 1, 1),
    (1, 0.0, 20, 0.0, 0, 0.0, 0, 1, 1), (25, 0.3, 40, 0.0, 30, 0.1, 0, 1, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (5, 1.0, 30, 0.0, 25, 0.0, 0, 1, 1), (120, 0.05, 8, 0.0, 4, 1.0, 0, 1, 1), (2, 0.0, 4, 1.0, 10, 0.0, 0, 1, 1),
    (1, 0.0, 1, 1.0, 0, 0.0, 0, 1, 1), (4, 0.0, 3, 1.0, 5, 0.5, 0, 1, 1), (2, 1.0, 3, 1.0, 0, 0.0, 0, 1, 1),
    (3, 0.5, 2, 1.0, 4, 1.0, 0, 1, 1), (2, 0.0, 1, 1.0, 2, 0.0, 0, 1, 1), (6, 0.6, 6, 0.0, 3, 0.0, 0, 1, 1),
    (3, 0.0, 2, 1.0, 1, 1.0, 0, 1, 1), (5, 1.0, 4, 1.0, 6, 1.0, 0, 1, 1), (1, 0.0, 0, 0.0, 3, 0.0, 0, 1, 1),
    (60, 0.0, 45, 0.0, 80, 0.0, 3, 0, 0), (12, 0.0, 5, 0.9, 70, 0.0, 3, 0, 0), (3, 1.0, 2, 1.0, 3, 1.0, 3, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 3, 0, 0), (30, 0.2, 4, 1.0, 6, 0.5, 2, 0, 0), (9, 0.0, 40, 0.0, 0, 0.0, 2, 0, 0),
    (20, 0.0, 60, 0.0, 30, 0.0, 2, 1, 0), (4, 0.5, 60, 0.0, 30, 0.0, 2, 1, 0), (80, 0.0, 60, 0.0, 0, 0.0, 2, 1, 0),
    (2, 1.0, 50, 0.0, 40, 0.0, 3, 1, 0), (6, 0.0, 3, 0.0, 7, 0.0, 3, 1, 0), (15, 0.0, 2, 1.0, 15, 0.0, 2, 0, 0),
    (8, 0.0, 60, 0.0, 30, 0.0, 2, 1, 0), (1, 0.0, 60, 0.0, 30, 0.0, 2, 1, 0), (2, 0.0, 20, 0.0, 20, 0.0, 3, 1, 0),
    (45, 0.0, 60, 0.0, 50, 0.0, 1, 1, 1), (1, 0.0, 60, 0.0, 50, 0.0, 1, 1, 1), (2, 0.0, 1, 0.0, 2, 0.0, 1, 1, 1),
    (70, 0.2, 60, 0.0, 0, 0.0, 1, 1, 1), (12, 0.3, 4, 0.0, 20, 0.1, 1, 1, 1), (2, 1.0, 40, 0.0, 2, 1.0, 1, 1, 0),
    (1, 1.0, 2, 1.0, 0, 0.0, 1, 1, 0), (9, 0.6, 40, 0.0, 30, 0.0, 1, 1, 0), (3, 0.0, 40, 0.0, 3, 1.0, 1, 0, 0),
    (25, 0.0, 40, 0.0, 30, 0.0, 1, 0, 0), (6, 0.0, 0, 0.0, 40, 0.0, 1, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0),
    (45, 0.0, 50, 0.0, 38, 0.0, 0, 0, 1), (70, 0.1, 20, 0.0, 65, 0.0, 0, 0, 1), (30, 0.0, 5, 0.0, 40, 0.0, 0, 0, 1),
    (25, 0.05, 3, 1.0, 50, 0.0, 0, 0, 1), (8, 0.0, 40, 0.0, 45, 0.0, 0, 0, 1), (6, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1),
    (5, 0.0, 35, 0.0, 50, 0.0, 0, 0, 1), (12, 0.0, 60, 0.0, 3, 1.0, 0, 0, 1), (18, 0.0, 18, 0.0, 20, 0.0, 0, 0, 1),
    (2, 0.0, 1, 0.0, 1, 1.0, 0, 0, 1), (3, 0.0, 8, 0.0, 2, 1.0, 0, 0, 1), (60, 0.45, 50, 0.1, 40, 0.0, 0, 0, 1),
    (20, 0.4, 30, 0.0, 2, 1.0, 0, 0, 1), (40, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1), (22, 0.1, 4, 1.0, 3, 1.0, 0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (1, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0), (4, 0.8, 3, 1.0, 5, 0.9, 0, 0, 0),
    (30, 0.7, 5, 1.0, 4, 1.0, 0, 0, 0), (2, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), (3, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 4, 0.0, 0, 0, 0), (10, 0.6, 50, 0.0, 3, 1.0, 0, 0, 0), (3, 1.0, 60, 0.0, 4, 1.0, 0, 0, 0),
    (2, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0), (1, 1.0, 2, 0.0, 0, 0.0, 0, 0, 0), (6, 1.0, 40, 0.0, 35, 0.0, 0, 0, 0),
    (15, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (2, 0.0, 0, 0.0, 5, 0.0, 0, 0, 1),
]


def fit_tree(rows: list[tuple], depth: int = 6):
    """A CART tree by Gini impurity: (feature, bound, left, right) with value <= bound to the left, or a leaf 0 or 1."""
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows])

    def gini(v):
        p = v.mean() if len(v) else 0.0
        return len(v) * p * (1 - p)

    def grow(at, depth):
        share = y[at].mean()
        if not depth or share in (0.0, 1.0):
            return int(share >= 0.5)
        best = None
        for f in (6, 7, 1, 0, 3, 5, 2, 4):  # context first where splits tie
            values = np.unique(x[at, f])
            for bound in (values[:-1] + values[1:]) / 2:
                left = x[at, f] <= bound
                cost = gini(y[at][left]) + gini(y[at][~left])
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(bound), left)
        if best is None or best[0] >= gini(y[at]) - 1e-12:
            return int(share >= 0.5)
        _, f, bound, left = best
        return f, bound, grow(at[left], depth - 1), grow(at[~left], depth - 1)

    return grow(np.arange(len(rows)), depth)


@lru_cache(maxsize=1)
def tree():
    return fit_tree(LABELLED)


def is_text(x: tuple) -> bool:
    node = tree()
    while not isinstance(node, int):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return bool(node)


def _named(value: str) -> set[str]:
    """The words of a class, id or role, without those of compounds that tell a state."""
    found: set[str] = set()
    for name in value.split():
        parts = _PART.findall(name)
        if len(parts) > 1 and (parts[0] in _STATE or parts[-1] in _STATES):
            parts = [x for x in parts if x not in _BAD and x != "header"]
        found.update(parts)
    return found


def _marks(name: str, attrs: str, in_main: bool) -> tuple[bool, frozenset[str], bool]:
    """Whether an element is a non-article part, the words that say so of it, and whether it is the article."""
    bad, words, good = name in _BOILER or (name == "header" and not in_main), frozenset(), name in _MAIN
    if "=" in attrs or "hidden" in attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role"):
                parts = _named(value)
                named = parts & _GOOD
                if parts & _BAD or ("header" in parts and not named):
                    words |= parts & (_BAD | {"header"})
                elif named & {"article", "entry", "post", "story", "main"}:
                    good = True
            elif key == "style":
                bad |= "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
            elif key in ("hidden", "aria-modal") or value == "true":
                bad = True
    return (False, frozenset(), False) if name in ("html", "body") else (bad, words, good)


_BREAK = re.compile(rf"<(?:{'|'.join(_BREAKS.split())})(?=[\s/>])|</(?:p|br)(?=[\s/>])", re.I)
_FOREIGN = re.compile(r"<foreignobject(?=[\s/>])", re.I)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}


class _Next:
    """The next place of a pattern in a page from rising positions on: no stretch is searched twice."""

    def __init__(self, page: str) -> None:
        self.page, self.found = page, {}

    def __call__(self, pattern: re.Pattern, at: int) -> re.Match | None:
        found = self.found.get(pattern, self)
        if found is self or (found and found.start() < at):
            found = self.found[pattern] = pattern.search(self.page, at)
        return found


def _after_raw(following: _Next, name: str, at: int) -> int:
    """Where the text goes on after an element of _RAW whose start tag ends at at."""
    close = following(_CLOSE[name], at)
    if name in ("svg", "math"):
        end = close.start() if close else len(following.page)
        out, foreign = following(_BREAK, at), following(_FOREIGN, at)
        if out and out.start() < end and not (foreign and foreign.start() < end):
            return out.start()
    return close.end() if close else len(following.page) if name in _TO_END else at


#: A piece of text: as written, within a link, its mark (3, or minus the number of the element that words mark), in the article.
_Piece = tuple[str, bool, int, bool]


def pieces(page: str) -> tuple[list[list[_Piece]], list[int]]:
    """The pieces of each block in page order, and the mark of each element that words mark (0 where none)."""
    out: list[list[_Piece]] = []
    stack: list[tuple[str, bool, int, bool]] = []
    bad = good = links = 0
    # elements that words mark: the one around it, its words, whether it holds the article; 0 is none
    worded: list[tuple[int, frozenset[str]]] = [(0, frozenset())]
    wraps, inner = [True], 0
    seen: set[str] = set()
    held: list[_Piece] = []
    at, head, following = 0, False, _Next(page)
    opened: dict[str, int] = {}  # how many elements of a name are on the stack
    blocky: list[int] = []  # places of block-level elements on the stack

    def text(raw: str) -> None:
        if raw and not head:
            held.append((raw, links > 0, 3 if bad else -inner, good > 0))

    def flush() -> None:
        if held:
            out.append(held[:])
            held.clear()

    def pop() -> None:
        nonlocal bad, good, links, inner
        name, was_bad, mark, was_good = stack.pop()
        opened[name] -= 1
        if blocky and blocky[-1] == len(stack):
            blocky.pop()
        inner = worded[mark][0] if mark else inner
        bad, good, links = bad - was_bad, good - was_good, links - (name == "a")

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if name == "head":
                head = False
            if name in _BLOCK:
                flush()
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name == "br":
                text(" ")
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in _RAW and not attrs.endswith("/"):
            at = _after_raw(following, name, at)
            continue
        if name == "head":
            head = True
        elif name == "body" or (head and name in _BLOCK):
            head = False
        if name in _BLOCK:
            flush()
            if blocky and stack[blocky[-1]][0] in ("p", "li", "td", "th", "dt", "dd", "option", "tr") and stack[blocky[-1]][0] in (name, "p"):
                for _ in range(len(stack) - blocky[-1]):  # inline elements left open in it end with it
                    pop()
        if name == "br":
            text(" ")
        if name in _VOID or attrs.endswith("/"):
            continue
        is_bad, words, is_good = _marks(name, attrs, good > 0)
        if (name in _MAIN or name == "h1") and name not in seen and not (bad or is_bad or words):
            seen.add(name)
            at_mark = inner
            while at_mark:
                wraps[at_mark] |= name != "h1" or not worded[at_mark][1] & _SITE
                at_mark = worded[at_mark][0]
        mark = 0
        if words:
            mark = len(worded)
            worded.append((inner, words))
            wraps.append(False)
            inner = mark
        if name in _BLOCK:
            blocky.append(len(stack))
        stack.append((name, is_bad, mark, is_good))
        opened[name] = opened.get(name, 0) + 1
        bad, good, links = bad + is_bad, good + is_good, links + (name == "a")
    text(page[at:])
    flush()
    marked = [0]
    for (around, words), wrap in zip(worded[1:], wraps[1:]):
        marked.append(max(marked[around], 0 if wrap else 1 if words <= _WEAK else 2))
    return out, marked


def blocks(found: list[list[_Piece]], marked: list[int]) -> Iterator[tuple[str, int, float, int, bool]]:
    """(text, words, link density, mark, in the article) of each block, whose pieces of another mark are a block each."""
    for block in found:
        groups: dict[int, list[_Piece]] = {}
        for piece in block:
            groups.setdefault(piece[2] if piece[2] > 0 else marked[-piece[2]], []).append(piece)
        for mark, group in groups.items():
            whole = " ".join(html.unescape("".join(p[0] for p in group)).split())
            if whole:
                n = len(whole.split(" "))
                linked = len(html.unescape(" ".join(p[0] for p in group if p[1])).split())
                yield whole, n, min(1.0, linked / n), mark, any(p[3] for p in group if p[0].strip())


def main_text(page: str | None) -> str:
    """The page's text blocks, joined by a newline; empty where there are none."""
    found, marked = pieces(page or "")
    out: list[str] = []
    for marks in (marked, [0] * len(marked)):  # words count, or they do not
        each = list(blocks(found, marks))
        plain = [(0, 0.0), *((n, density) for _, n, density, mark, _ in each if not mark), (0, 0.0)]
        at = 1  # the place in plain of the next unmarked block
        for text, n, density, mark, good in each:
            if is_text((n, density, *plain[at - 1], *plain[min(at + (not mark), len(plain) - 1)], mark, good)):
                out.append(text)
            at += not mark
        if out:
            break
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages.

    Null or empty html: empty text.  Null ids and urls and repeated rows are
    returned as they are; other columns are not read.  Empty table: no rows.  A
    page is read whole in time linear in its length, whatever its markup.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
