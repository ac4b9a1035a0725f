"""Visible text of HTML pages, laid out in blocks, lists and tables.

A tree builder with implied end tags turns the tags into a tree; rules of visibility drop
what a browser does not show (head, scripts, styles, templates, ``hidden``, ``display:none``); the rest
is rendered: blocks on lines of their own, a blank line around paragraphs and headings, list items
with bullets or numbers and indented, preformatted text as it is, and table cells in
aligned columns.

Defined results: null gives null, an empty page the empty text; text outside any tag counts; unclosed
and stray tags lose no visible text, an unclosed comment is kept as text, an unclosed script or style hides the rest;
nesting deeper than ``MAX_DEPTH`` is rendered at that depth, whole; equal rows give equal results.  A table whose aligned form would be
more than ``MOST_PADDING`` times its text and cells is set without padding and spans, so work and output are linear in the page.  Columns of the input
named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.textbuf import with_result

#: Elements of HTML by their layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link datalist iframe object audio video canvas svg".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form figcaption li dt dd tr caption details summary thead tbody tfoot legend menu".split())
#: A start tag ends these open elements, looked for up to the given ancestors.
CLOSES_P = BLOCK - frozenset("html body li dt dd tr caption summary thead tbody tfoot legend figcaption".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
MAX_DEPTH = 120
#: Characters of padding and cells of spans for each character and cell of a table (and the first so many are free).
MOST_PADDING, FREE_PADDING = 8, 1 << 12
#: HTML's own bounds of spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: What ends a comment and a marked section.
_ENDS = (("<!--", re.compile(r"--!?>")), ("<![", re.compile(r"\]\s*\]\s*>")))
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "attrs", "children", "shown")

    def __init__(self, tag: str, attrs: dict, shown: bool):
        self.tag, self.attrs, self.children, self.shown = tag, attrs, [], shown


class TreeBuilder(HTMLParser):
    """Tags to nodes; text goes to the innermost open element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, True)
        self.open = [self.root]
        #: Tags open below a hidden element; they are not built.
        self.below: Counter = Counter()

    def _close(self, names, stops, outermost: bool = False) -> None:
        """Closes the innermost (or outermost) open element of the names inside the nearest of the stops."""
        found = 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                found = i
                if not outermost:
                    break
            elif self.open[i].tag in stops:
                break
        if found:
            del self.open[found:]

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "html":
            return
        if not self.open[-1].shown:
            hidden = self.open[-1].tag
            names, stops = IMPLIED.get(tag, ((), ()))
            ends = hidden in names and not any(self.below[s] for s in stops) or hidden == "p" and tag in CLOSES_P or hidden == "head" and tag in BLOCK
            if not ends:
                if tag not in VOID:
                    self.below[tag] += 1
                return
            self.below.clear()
        if tag in CLOSES_P or tag in IMPLIED:
            self._close(("p",), ("table", "td", "th", "li", "dd", "button"))
        if tag in BLOCK and self.open[-1].tag == "head":
            self.open.pop()
        if tag in IMPLIED:
            self._close(*IMPLIED[tag], outermost=True)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.handle_starttag("tr", [])
        shown = tag not in HIDDEN and "hidden" not in attrs and not _NONE.search(attrs.get("style") or "") and not (tag == "dialog" and "open" not in attrs)
        node = Node(tag, attrs, shown)
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(node)
        elif tag not in VOID and not shown:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as in HTML, the slash closes nothing

    def handle_endtag(self, tag):
        if not self.open[-1].shown:
            if self.below[tag]:
                self.below[tag] -= 1
                return
            depth = len(self.open)
            self._end(tag)
            if len(self.open) < depth:
                self.below.clear()
            return
        self._end(tag)

    def _end(self, tag):
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p", {}, True))
            return
        if tag == "br":
            self.open[-1].children.append(Node("br", {}, True))
            return
        stops = ("table",) if tag not in ("table", "body") and tag not in ("div", "section", "article") else ()
        self._close((tag,), stops)

    def handle_data(self, data):
        self.open[-1].children.append(data)


class Lines:
    """Collects inline text into lines, with pending spaces and blank lines between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False

    def text(self, data: str) -> None:
        words = _SPACE.split(data)
        if len(words) > 1 and words[0] == "":
            self.space = True
        inner = " ".join(w for w in words if w)
        if inner:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(inner)
            self.space = False
        if len(words) > 1 and words[-1] == "":
            self.space = True

    def end(self) -> None:
        if self.parts:
            self._put("".join(self.parts))
        self.parts, self.space = [], False

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def block(self, lines: list[str]) -> None:
        """Whole lines of a nested layout."""
        self.end()
        for k, line in enumerate(lines):
            if k == 0:
                self._put(line)
            else:
                self.lines.append(line)

    def spaced(self) -> None:
        self.end()
        self.gap = True


def _rows(table: Node) -> list[Node]:
    rows = []
    for c in table.children:
        if isinstance(c, Node) and c.shown:
            if c.tag == "tr":
                rows.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                rows.extend(x for x in c.children if isinstance(x, Node) and x.tag == "tr" and x.shown)
    return rows


def _span(cell: Node, name: str, most: int) -> int:
    digits = (cell.attrs.get(name) or "1").strip()
    return max(1, min(int(digits[:9]), most)) if digits.isascii() and digits.isdigit() else 1


def _grid(rows: list[list[Node]], texts: list[list[list[str]]], most: int) -> list[list[list[str]]] | None:
    """Lines of the cells in their columns; None if spans make more than ``most`` cells."""
    grid, below, made = [], {}, 0  # below: column -> rows that a cell above still covers
    for row, cells in zip(rows, texts):
        line, k = [], 0
        todo = list(zip(row, cells))[::-1]
        while todo or any(j >= k for j in below):
            if below.get(k):
                line.append([])
                k += 1
            elif todo:
                cell, lines = todo.pop()
                wide, high = _span(cell, "colspan", MOST_COLUMNS), _span(cell, "rowspan", MOST_ROWS)
                if made + len(line) + wide > most:
                    return None
                for j in range(k, k + wide):
                    line.append(lines if j == k else [])
                    if high > 1:
                        below[j] = high
                k += wide
            else:
                line.append([])
                k += 1
        below = {j: n - 1 for j, n in below.items() if n > 1}
        made += len(line)
        if made > most:
            return None
        if any(line):
            grid.append(line)
    return grid


def _table(node: Node) -> list[str]:
    """Cells in columns as wide as their longest line; a cell's further lines stay in its column."""
    out: list[str] = []
    rows = [[c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and c.shown] for row in _rows(node)]
    texts = [[render(c) for c in row] for row in rows]
    most = MOST_PADDING * sum(map(len, rows)) + FREE_PADDING
    grid = _grid(rows, texts, most)
    aligned = grid is not None
    grid = [line for line in texts if any(line)] if grid is None else grid
    width = [max((len(x) for line in grid if k < len(line) for x in line[k]), default=0) for k in range(max(map(len, grid), default=0))] if aligned else []
    if aligned:
        text = sum(len(x) + 3 for line in grid for c in line for x in c)
        reach = [0]
        for w in width:
            reach.append(reach[-1] + w + 3)
        aligned = sum(max(map(len, line)) * reach[len(line)] for line in grid) <= MOST_PADDING * text + FREE_PADDING
        width = width if aligned else [0] * len(width)
        grid = grid if aligned else [line for line in texts if any(line)]
    for line in grid:
        for k in range(max(map(len, line))):
            cells = [(c[k] if k < len(c) else "").ljust(width[j] if aligned else 0) for j, c in enumerate(line)] if aligned else [c[k] for c in line if k < len(c)]
            out.append(" | ".join(cells).rstrip().rstrip("|").rstrip())
    loose = Lines()  # text and captions that are in no cell
    for c in node.children:
        if isinstance(c, str):
            loose.text(c)
        elif c.tag not in ("tr", "thead", "tbody", "tfoot"):
            _walk(c, loose)
        else:
            for x in c.children if c.tag != "tr" else [c]:
                if isinstance(x, str):
                    loose.text(x)
                elif x.shown and c.shown:
                    for y in x.children if x.tag == "tr" else [x]:
                        if isinstance(y, str):
                            loose.text(y)
                        elif y.tag not in ("td", "th"):
                            _walk(y, loose)
    loose.end()
    return loose.lines + out


def _walk(node: Node, to: Lines) -> None:
    if not node.shown:
        return
    tag = node.tag
    if tag == "br":
        if to.parts:
            to.end()
        else:
            to.gap = True
        return
    if tag == "wbr" or tag in VOID and tag != "hr":
        return
    spaced = tag in SPACED
    if spaced:
        to.spaced()
    elif tag in BLOCK:
        to.end()
    if tag == "pre":
        raw = "".join(_strings(node))
        to.block(raw.removeprefix("\n").rstrip("\n").split("\n"))
    elif tag == "table":
        if lines := _table(node):
            to.block(lines)
    elif tag in ("ul", "ol", "menu"):
        _list(node, to)
    else:
        _children(node, to)
    if spaced:
        to.spaced()
    elif tag in BLOCK:
        to.end()
    elif tag in ("td", "th"):
        to.space = True


def _list(node: Node, to: Lines) -> None:
    start = (node.attrs.get("start") or "1").strip()
    n = int(start) if start.isascii() and start.isdigit() and len(start) < 9 else 1
    for c in node.children:
        if isinstance(c, str):
            to.text(c)
        elif c.tag == "li" and c.shown:
            mark = f"{n}. " if node.tag == "ol" else "- "
            n += 1
            inner = render(c)
            to.block([mark + (inner[0] if inner else ""), *[" " * len(mark) + x if x else "" for x in inner[1:]]] if inner else [mark.rstrip()])
        else:
            _walk(c, to)


def _children(node: Node, to: Lines) -> None:
    for c in node.children:
        if isinstance(c, str):
            to.text(c)
        else:
            _walk(c, to)


def _strings(node: Node):
    for c in node.children:
        if isinstance(c, str):
            yield c
        elif c.shown:
            if c.tag == "br":
                yield "\n"
            yield from _strings(c)


def render(node: Node) -> list[str]:
    """The lines of an element's visible content."""
    to = Lines()
    _children(node, to)
    to.end()
    return to.lines


def finished(html: str) -> str:
    """The page with the ``<`` of constructs that never end as text, which the parser would else look ahead for again and again."""
    for sign, end in _ENDS:
        at = html.find(sign)
        if at >= 0:
            last = 0
            for m in end.finditer(html, at):
                last = m.end()
            # a sign after the last end starts something without one
            rest = max(at, last)
            html = html[:rest] + html[rest:].replace(sign, "&lt;" + sign[1:])
    end = html.rfind(">") + 1
    return html[:end] + html[end:].replace("<", "&lt;")


def visible_text(html: str) -> str:
    """The visible text of a page."""
    builder = TreeBuilder()
    builder.feed(finished(html))
    builder.close()
    return "\n".join(render(builder.root))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every page without its html, with text, n_lines and n_chars."""
    @F.arrow_udf("string")
    def shown(htmls: pa.Array) -> pa.Array:
        return pa.array([None if h.as_py() is None else visible_text(h.as_py()) for h in htmls], pa.string())

    found = pages.withColumn("__t", shown(F.col(html))).drop(html)
    lines = F.when(F.col("__t") == "", F.lit(0)).otherwise(F.size(F.split(F.col("__t"), "\n")))
    return with_result(found, text=F.col("__t"), n_lines=F.when(F.col("__t").isNotNull(), lines).cast("long"), n_chars=F.length("__t").cast("long")).drop("__t")
