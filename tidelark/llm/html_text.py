"""HTML extraction by layout-aware rendering.

A tree builder with implied tags makes elements of the markup; a renderer walks
the tree and emits all text a reader would see: blocks on lines of their own,
paragraphs parted by an empty line, lists with marks and indents, and table
cells in aligned columns. Nothing is judged to be boilerplate.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelark.llm.common import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to the end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link annotation annotation-xml".split())
#: SVG shows characters within these alone, and nothing of the next.
SVG_TEXT = frozenset({"text", "foreignobject"})
SVG_UNSEEN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
#: Parts of formulas that stand apart.
PARTED = frozenset("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr".split())
#: Markup is HTML again within these; start tags that end SVG and formulas otherwise.
FOREIGN = frozenset({"svg", "math"})
WITHIN_FOREIGN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
#: Blocks that an empty line parts from their neighbours.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: A start tag on the left ends an open element on the right, unless one of the barriers stands between.
IMPLIED: dict[str, frozenset[str]] = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}), "optgroup": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "td", "th", "caption", "colgroup"}), "td": frozenset({"td", "th", "caption", "colgroup"}), "th": frozenset({"td", "th", "caption", "colgroup"}), "thead": frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}),
    "tbody": frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}), "tfoot": frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}), "body": frozenset({"head"}),
    "caption": frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}), "colgroup": frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}), "col": frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}),
}
BARRIER = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "option": frozenset({"select", "datalist"}), "optgroup": frozenset({"select"})}
TABLE = frozenset({"table"})
#: A block's start tag ends an open paragraph.
ENDS_P = BLOCK - frozenset("body html tbody thead tfoot tr caption option optgroup legend summary".split())
IN_COLGROUP = frozenset("col template".split())
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
#: Columns of indent, and width of a table's column, beyond which layout stops growing; the text itself is never cut.
MOST_INDENT, MOST_WIDTH = 64, 160

#: Quotes count after an equals sign alone; one that never ends is a character like any other.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
#: A less-than sign that isn't text.
MARKUP = re.compile("<(?=[A-Za-z/!?])")
TAG_START = re.compile("</?[A-Za-z]")
RAW_END = {name: re.compile(rf"(?ai:</{name}(?=[ \t\n\r\f/>]|\Z))") for name in RAW}
COMMENT_END = re.compile("--!?>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VALUE_ENDS = frozenset(" \t\n\r\f\"'")
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Numbers too long for any character.
LONG_REFERENCE = re.compile("&#[0-9]{8,};?")
P, HEAD, P_BARRIER = frozenset({"p"}), frozenset({"head"}), frozenset({"table", "td", "th", "li", "dd", "button", "object"})


NO_ATTRIBUTES: dict[str, str] = {}


class Element:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes, self.children = name, attributes or NO_ATTRIBUTES, []


def unescape(value: str) -> str:
    return html.unescape(LONG_REFERENCE.sub("\ufffd", value)) if "&" in value else value


class Open:
    """The open elements, and at which depths each name is open, so that no tag walks over all of them."""

    def __init__(self, root: Element):
        self.stack, self.at = [root], defaultdict(list)

    def push(self, e: Element) -> None:
        self.at[e.name].append(len(self.stack))
        self.stack.append(e)

    def cut(self, depth: int) -> None:
        """Closes all elements from a depth on."""
        while len(self.stack) > depth:
            self.at[self.stack.pop().name].pop()

    def last(self, names: frozenset[str]) -> int:
        """Depth of the innermost element of these names, or 0."""
        return max((d[-1] for n in names if (d := self.at.get(n))), default=0)

    def close(self, names: frozenset[str], barrier: frozenset[str]) -> None:
        """Closes the outermost element of these names that no barrier covers, and all within it."""
        under = self.last(barrier)
        found = [d[i] for n in names if (d := self.at.get(n)) and d[-1] > under and (i := bisect_right(d, under)) < len(d)]
        if found:
            self.cut(min(found))

    def is_foreign(self) -> bool:
        return self.last(FOREIGN) > self.last(WITHIN_FOREIGN)


def _ends_itself(inside: str) -> bool:
    """Whether a tag's slash ends it rather than an unquoted value."""
    if not inside.endswith("/"):
        return False
    i = len(inside)
    while i and inside[i - 1] not in VALUE_ENDS:
        i -= 1
    return "=" not in inside[i:-1] and not (len(inside) - i == 1 and inside[:i].rstrip().endswith("="))


def parse(source: str) -> Element:
    """The tree of a page, in time linear in its length. Markup that is malformed is read as text, passed over, or mended, as browsers do; a tag or comment that never ends takes the rest with it."""
    root = Element("#root")
    open_ = Open(root)
    stack = open_.stack
    at, n = 0, len(source)

    def text(value: str) -> None:
        if value:
            if stack[-1].name in ("head", "colgroup") and value.strip():
                open_.cut(len(stack) - 1)
            stack[-1].children.append(unescape(value))

    foreign = False  # whether any such element has begun
    while at < n:
        m = MARKUP.search(source, at)
        if not m:
            text(source[at:])
            break
        start = m.start()
        if start > at:
            text(source[at:start])
        m = TAG.match(source, start)
        if not m:
            if source.startswith("<!--", start):
                m = COMMENT_END.search(source, start + 2)
                at = m.end() if m else n
            elif TAG_START.match(source, start):
                break  # a tag that never ends
            else:
                end = source.find(">", start)
                at = n if end < 0 else end + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            own, table = (d[-1] if (d := open_.at.get(x)) else 0 for x in (name, "table"))
            if own and (own >= table or name in ("div", "body", "html")):
                open_.cut(own)
            elif not own and not table and name in ("br", "p"):
                stack[-1].children.append(Element(name))
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            open_.cut(len(stack) - 1)
        if foreign and name in ENDS_FOREIGN:
            while open_.is_foreign():
                open_.cut(len(stack) - 1)
        if name in ENDS_P and open_.at.get("p"):
            open_.close(P, P_BARRIER)
        if stack[-1].name == "colgroup" and name not in IN_COLGROUP:
            open_.cut(len(stack) - 1)
        if name in IMPLIED:
            open_.close(IMPLIED[name], BARRIER.get(name, TABLE))
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            row = Element("tr")
            stack[-1].children.append(row)
            open_.push(row)
        found = {a.lower(): unescape(b or c or d or "") for a, b, c, d in reversed(ATTRIBUTE.findall(m[3]))} if m[3].strip(" /") else None
        element = Element(name, found)
        stack[-1].children.append(element)
        if name in VOID:
            continue
        foreign = foreign or name in FOREIGN
        if foreign and _ends_itself(m[3]) and (name in FOREIGN or open_.is_foreign()):
            continue
        if name in RAW:
            m = RAW_END[name].search(source, at)
            end = m.start() if m else n
            value = source[at:end]
            element.children.append(unescape(value).removeprefix("\n") if name == "textarea" else value)
            end = source.find(">", end)
            at = n if end < 0 else end + 1
            continue
        open_.push(element)
    return root


def is_hidden(e: Element) -> bool:
    a = e.attributes
    if e.name in HIDDEN or e.name == "input" or e.name == "dialog" and "open" not in a:
        return True
    return bool(a) and ("hidden" in a and a["hidden"].lower() != "until-found" or bool(INVISIBLE.search(a.get("style", ""))))


class Lines:
    """Text as it is laid out: words on the current line, breaks, an indent, and the counters of open lists."""

    def __init__(self):
        self.out: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.indent = 0
        self.mark = ""
        self.counters: list[int | None] = []
        self.held: list[tuple[int, str]] = []

    def words(self, value: str, kept: bool = False) -> None:
        if kept:
            first, *rest = value.split("\n")
            self.line.append(first)
            for x in rest:
                self.end(1)
                self.line.append(x)
            return
        value = SPACE.sub(" ", value)
        if value == " " and (not self.line or self.line[-1].endswith(" ")):
            return
        if not self.line or self.line[-1].endswith(" "):
            value = value.lstrip(" ")
        if value:
            self.line.append(value)

    def end(self, gap: int) -> None:
        """Ends the line; gap: line ends that stand before the next one at least."""
        if self.line:
            value = "".join(self.line).rstrip()
            self.line.clear()
            if value.strip():
                self.out += ["\n" * self.gap if self.out else "", " " * self.indent + self.mark + value]
                self.gap, self.mark = 0, " " * len(self.mark)
        self.gap = max(self.gap, gap)

    def step_in(self, more: int, mark: str) -> None:
        self.held.append((self.indent, self.mark))
        self.indent = min(MOST_INDENT, self.indent + len(self.mark) + more)
        self.mark = mark

    def step_out(self) -> None:
        self.indent, self.mark = self.held.pop()

    def text(self) -> str:
        self.end(0)
        return "".join(self.out)


class Grid:
    """Rows of an outermost table; a cell is laid out by itself and its lines become one."""

    def __init__(self, around: Lines):
        self.around, self.rows = around, []

    def lines(self) -> list[str]:
        """Rows with cells padded to their columns. A column in which no cell stands alone takes no room."""
        widths: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for value, span in row:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), min(len(value), MOST_WIDTH))
                at += span
        columns = sorted(widths)
        before = [0, *accumulate(widths[c] + len(PART) for c in columns)]
        out = []
        for row in self.rows:
            line, at = [], 0
            for value, span in row:
                room = before[bisect_left(columns, at + span)] - before[bisect_left(columns, at)] - len(PART)
                line.append(value.ljust(max(0, room)))
                at += span
            out.append(PART.join(line).rstrip())
        return [x for x in out if x.strip(" |")]


PART = " | "
SECTIONS = frozenset({"tbody", "thead", "tfoot"})
CELLS = frozenset({"td", "th"})


def render(root: Element) -> str:
    """The visible text; an explicit stack serves for the walk, so deep trees are no matter.

    Within a cell, a nested table's rows follow each other on the cell's one line.
    """
    lines = Lines()
    grids: list[Grid] = []  # one at most is open: that of the outermost table
    todo: list[tuple] = [("open", root, False)]
    while todo:
        what, e, kept = todo.pop()
        if what == "open":
            if isinstance(e, str):
                lines.words(e, kept)
            elif not is_hidden(e):
                if e.name == "table":
                    lines.end(2)
                    if not grids:
                        grids.append(Grid(lines))
                        todo += [("table", e, False), *_table(e, "cell")]
                    else:
                        todo += [("gap", 2, False), *_table(e, "nested")]
                else:
                    _open(e, kept, lines, todo)
        elif what == "close":
            _close(e, lines)
        elif what == "gap":
            lines.end(e)
        elif what == "row":
            grids[-1].rows.append([])
        elif what == "cell":
            lines = Lines()
            todo.append(("fill", e, False))
            todo += [("open", c, False) for c in reversed(e.children)]
        elif what == "fill":
            grids[-1].rows[-1].append((SPACE.sub(" ", lines.text()).strip(), _span(e)))
            lines = grids[-1].around
        elif what == "part":  # between cells of a nested row
            lines.line.append(PART)
        elif what == "trim":  # after a nested row: what parts off empty cells at its end goes
            while lines.line and lines.line[-1] == PART:
                lines.line.pop()
            lines.end(1)
        elif what == "table":
            for row in grids.pop().lines():
                lines.line.append(row)
                lines.end(1)
            lines.end(2)
    return lines.text()


def _open(e: Element, kept: bool, lines: Lines, todo: list[tuple]) -> None:
    if e.name == "br":
        lines.end(1)
        return
    if e.name == "img":
        if e.attributes.get("alt", "").strip():
            lines.words(e.attributes["alt"])
        return
    if e.name == "textarea":
        lines.end(1)
        lines.words(e.children[0] if e.children else "", True)
        lines.end(1)
        return
    if e.name == "svg":
        todo += [("open", x, False) for x in _svg_texts(e)]
        return
    if e.name in BLOCK:
        nested = e.name in ("ul", "ol") and bool(lines.counters)
        lines.end(2 if e.name in SPACED and not nested else 1)
    if e.name in ("ul", "ol", "menu"):
        start = e.attributes.get("start", "1")
        lines.counters.append(int(start) if e.name == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1 if e.name == "ol" else None)
    elif e.name == "li":
        mark = "- "
        if lines.counters and lines.counters[-1] is not None:
            mark = f"{lines.counters[-1]}. "
            lines.counters[-1] += 1
        lines.step_in(0, mark)
    elif e.name in ("blockquote", "dd"):
        lines.step_in(4, "")
    elif e.name in CELLS:  # outside a table
        lines.words(" ")
    label = e.attributes.get("label", "").strip() if e.name in ("option", "optgroup") else ""
    if label:
        lines.words(label)
        lines.end(1)
    todo.append(("close", e, kept))
    if label and e.name == "option":  # shown in place of its text
        return
    if e.name in PARTED:
        todo += [("open", x, kept) for c in reversed(e.children) for x in (c, " ")]
        return
    kept = kept or e.name == "pre"
    todo += [("open", c, kept) for c in reversed(e.children)]


def _close(e: Element, lines: Lines) -> None:
    if e.name == "li":
        lines.end(1)
        lines.step_out()
    elif e.name in ("ul", "ol", "menu"):
        lines.end(2 if len(lines.counters) == 1 else 1)
        lines.counters.pop()
    elif e.name in ("blockquote", "dd"):
        lines.end(2 if e.name == "blockquote" else 1)
        lines.step_out()
    elif e.name in BLOCK:
        lines.end(2 if e.name in SPACED else 1)


def _svg_texts(svg: Element) -> list[Element]:
    """What a drawing shows, last first: its texts as lines of their own."""
    out, todo = [], [svg]
    while todo:
        e = todo.pop()
        if e.name in SVG_TEXT:
            line = Element("div", e.attributes)
            line.children = e.children
            out.append(line)
        else:
            todo += [c for c in reversed(e.children) if isinstance(c, Element) and c.name not in SVG_UNSEEN and not is_hidden(c)]
    return out[::-1]


def _table(table: Element, kind: str) -> list[tuple]:
    """What is to be done for a table, last first: strays between rows and cells, which browsers show before it, captions, and rows."""
    strays: list[tuple] = []
    captions: list[tuple] = []
    rows: list[tuple] = []
    todo: list[Element | str] = [table]
    while todo:
        e = todo.pop()
        if isinstance(e, str) or e is not table and e.name not in SECTIONS | {"tr", "colgroup", "caption", "col"}:
            if not isinstance(e, str) or e.strip():
                strays += [("open", e, False), ("gap", 1, False)]
        elif e is not table and is_hidden(e):
            continue
        elif e.name == "caption":
            captions += [("open", e, False), ("gap", 1, False)]
        elif e.name == "tr":
            cells = [c for c in e.children if isinstance(c, Element) and c.name in CELLS and not is_hidden(c)]
            todo += [c for c in reversed(e.children) if isinstance(c, str) or c.name not in CELLS]
            if kind == "cell":
                rows += [("row", e, False), *((kind, c, False) for c in cells)]
            else:
                for i, c in enumerate(cells):
                    rows += [("part", c, False)] * (i > 0) + [("open", x, False) for x in c.children]
                rows.append(("trim", e, False))
        else:
            todo += reversed(e.children)
    return [*reversed(rows), *reversed(captions), *reversed(strays)]


def _span(cell: Element) -> int:
    value = cell.attributes.get("colspan", "1").strip()
    return min(1000, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def extract(source: str | None) -> str:
    return render(parse(source)) if source else ""


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id and text (all that is visible; empty for null and empty pages).

    Text without markup is itself, with white space collapsed. Pages of any
    length and depth are read whole, in linear time. An empty table gives an
    empty table. Repeated rows and null ids are kept; other columns, whatever
    their names, aren't read.
    """
    return map_texts(pages, lambda: lambda sources: [pa.array([extract(s) for s in sources], pa.string())], "text string", id_col, html_col)
