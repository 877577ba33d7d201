"""HTML extraction by layout-aware rendering: all visible text of a page, laid out as text.

A page is cut into tags and text, a tree builder closes what the markup leaves open, visibility rules
drop what a browser would not show, and a renderer writes the rest: blocks on lines of their own,
paragraph-like blocks with an empty line between, list items with marks and indents, table cells in
aligned columns, preformatted text as it stands.

A cell is laid out like a page of its own, so lists and tables inside it keep their lines. Where a cell of a
row holds several blocks, the row's cells follow one another as blocks do, in reading order; in all other
rows they stand side by side, in the table's columns. In a cell that others follow, lines break at spaces where they would pass
`WIDTH`; what cannot break (one long word) stays whole, and the cells after it go on in the next line, at
their own columns. Spans over rows and columns hold their places, with the bounds of the HTML standard.

Defined cases: a null or empty page has empty text. Unclosed tags, quotes and comments end with the page.
Visibility holds at any depth, and what is visible inside a hidden element is shown; beyond `DEEPEST` levels
only indents stop growing and tables are laid out cell by cell, without losing text. Other columns are not
read; repeated rows are extracted each. Rows are implied around cells without one; what stands between the parts of a table is laid out before
it, as browsers do.
"""

from __future__ import annotations

import html as entities
import re
import sys
import textwrap
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, pieces

DEEPEST, WIDTH = 200, 80
#: The largest spans of a cell over columns and rows in the HTML standard.
COLUMNS, ROWS = 1000, 65534

# Element names as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe object canvas audio video datalist noembed noframes param".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
#: A start tag of the group closes an open element of the set, unless one of the bounds stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "caption": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "colgroup": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "col": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
IMPLIED = {tag: (frozenset(closed), frozenset(bounds)) for tag, (closed, bounds) in IMPLIED.items()}
PARAGRAPH = frozenset(["p"])
#: Parts of a table, those that hold only such parts, and what a browser leaves between them.
PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
GRID = frozenset("table tbody tfoot thead tr".split())
BETWEEN = PARTS | {"script", "style", "template"}
#: Text inside drawings and formulas that is not drawn.
UNDRAWN = {"svg": frozenset("defs desc metadata symbol".split()), "math": frozenset(["annotation", "annotation-xml"])}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SCOPE = frozenset("table td th caption button object template".split())
CELL, CAPTION = frozenset("td th template".split()), frozenset(["caption"])

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_NUMBER = re.compile(r"\s*([+-]?\d{1,18})", re.A)
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "beside", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.beside = tag, attributes, [], []

    def shown(self) -> bool:
        a = self.attributes
        if self.tag in UNSEEN or "hidden" in a or (self.tag == "dialog" and "open" not in a) or (self.tag == "input" and a.get("type", "").lower() == "hidden"):
            return False
        return not ("style" in a and _NOT_SHOWN.search(a["style"]))

    def hides(self, around: bool) -> bool:
        """Whether text directly inside is invisible, where `around` tells it of the parent."""
        found = _VISIBILITY.findall(self.attributes["style"]) if "style" in self.attributes else ()
        return found[-1].lower() != "visible" if found else around

    def number(self, name: str, otherwise: int) -> int:
        found = _NUMBER.match(self.attributes.get(name, ""))
        return int(found.group(1)) if found else otherwise


class Open:
    """The open elements, outermost first, with the places of each tag and of some groups of tags, so that the
    nearest one of a kind is found without walking through the others."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.spots: defaultdict[str, list[int]] = defaultdict(list)
        self.groups = {g: [] for g in (BLOCK, SCOPE, GRID)}

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.spots[node.tag].append(at)
        for group, places in self.groups.items():
            if node.tag in group:
                places.append(at)
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.spots[tag].pop()
            for group, places in self.groups.items():
                if tag in group:
                    places.pop()

    def nearest(self, tags: set | frozenset) -> int:
        """The place of the innermost element of `tags`, 0 where none is open."""
        if tags in self.groups:
            return self.groups[tags][-1] if self.groups[tags] else 0
        return max((self.spots[t][-1] for t in tags if self.spots[t]), default=0)

    def close(self, tags: set | frozenset, bounds: set | frozenset) -> None:
        """Close the outermost open element of `tags` inside the nearest bound."""
        low = self.nearest(bounds)
        inside = [spots[i] for t in tags if (spots := self.spots[t]) and (i := bisect_right(spots, low)) < len(spots)]
        if inside:
            self.cut(min(inside))


def parse(page: str) -> Node:
    """The tree of a page, with tags closed that the markup leaves open."""
    root = Node("#root", {})
    stack = Open(root)
    open_, spots, cut, close = stack.nodes, stack.spots, stack.cut, stack.close

    def place(child: Node | str) -> None:
        """Put a child where a browser does: what stands between the parts of a table goes before it."""
        into = open_[-1]
        stray = child.strip() if isinstance(child, str) else child.tag not in BETWEEN
        if into.tag == "colgroup" and (stray if isinstance(child, str) else child.tag != "col"):
            cut(len(open_) - 1)
            into = open_[-1]
        if into.tag in GRID and stray and spots["table"]:  # an open table is the last one in its list
            beside = open_[spots["table"][-1]].beside
            beside.insert(-1, child)
        else:
            beside = into.children
            beside.append(child)
        if isinstance(child, Node):
            child.beside = beside

    at, n, low = 0, len(page), None
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        slash, name, rest = m.group(1), m.group(2), m.group(3)
        if name is None:
            raw = m.group()
            if raw[0] != "<" or raw == "<":
                place(entities.unescape(raw))
            continue
        tag = name.lower()
        if slash:
            at_tag = spots[tag][-1] if spots[tag] else 0
            if not at_tag:
                continue
            if tag not in ("table", "tr", "tbody", "thead", "tfoot") and stack.nearest(SCOPE) > at_tag:
                continue
            if tag not in BLOCK and tag not in FORMATTING and stack.nearest(BLOCK) > at_tag:
                continue  # such an end tag stays inside the block it stands in
            cut(at_tag)
            continue
        if tag == "form" and open_[-1].tag in GRID and spots["table"]:
            continue  # a browser leaves an empty form there; what follows stays in the table
        if tag in BLOCK:
            close(PARAGRAPH, SCOPE)
        if tag in PARTS and (spots["table"] or spots["tr"]):  # back to the table's part, out of what was moved before the table
            part, caption, cell = stack.nearest(GRID), stack.nearest(CAPTION), stack.nearest(CELL)
            if part > max(caption, cell):
                cut(part + 1)
            elif caption > cell:
                cut(caption)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        elif tag not in ("html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template") and open_[-1].tag == "head":
            cut(len(open_) - 1)
        attributes = {}
        if rest.strip():
            for a in _ATTRIBUTE.finditer(rest):
                attributes.setdefault(a.group(1).lower(), entities.unescape(a.group(2) or a.group(3) or a.group(4) or ""))
        if tag in ("td", "th") and open_[-1].tag in GRID and open_[-1].tag != "tr":
            row = Node("tr", {})
            place(row)
            stack.push(row)
        node = Node(tag, attributes)
        drawn = [x for x in UNDRAWN if spots[x]] if tag not in BLOCK else []
        if any(tag in UNDRAWN[x] for x in drawn):
            attributes["hidden"] = ""
        place(node)
        if (drawn or tag in UNDRAWN) and rest.endswith("/"):
            continue
        if tag in RAW:
            if low is None:
                low = page.lower() if len(page.lower()) == n else page
            end = low.find(f"</{tag}", at)
            end = n if end < 0 else end
            body = page[at:end]
            node.children.append(entities.unescape(body) if tag in ("textarea", "title") else body)
            stop = page.find(">", end)
            at = n if stop < 0 else stop + 1
        elif tag not in VOID:
            stack.push(node)
    return root


class Page:
    """Lines of the rendering; `gap` is how many line ends the next text needs before it."""

    def __init__(self, nested: int = 0, hidden: bool = False) -> None:
        self.lines: list[str] = []
        self.nested, self.hidden = nested, hidden  # tables around it; whether text is invisible
        self.line: list[str] = []
        self.gap, self.indent, self.mark = 0, "", ""
        self.space = self.parted = False  # parted: it holds more than one block

    def _put(self) -> None:
        self.lines.append("".join(self.line).rstrip())
        self.line = []

    def end_line(self) -> None:
        if self.line:
            self._put()
        self.space = False

    def block(self, empty: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, 2 if empty else 1)

    def _open(self) -> None:
        if not self.line:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.parted |= self.gap > 0 and bool(self.lines)
            self.gap = 0
            self.line, self.mark = [self.mark or self.indent], ""

    def text(self, text: str) -> None:
        if self.hidden:
            return
        words = _WHITE.split(text)
        if not words[0] and len(words) > 1:
            self.space = bool(self.line)
        body = " ".join(w for w in words if w)
        if body:
            fresh = not self.line
            self._open()
            self.line.append((" " if self.space and not fresh else "") + body)
            self.space = not words[-1]

    def verbatim(self, text: str) -> None:
        if self.hidden:
            return
        rows = text.replace("\r\n", "\n").split("\n")
        for i, row in enumerate(rows):
            if i:
                self._put()
            if row:
                self._open()
                self.line.append(row)

    def finish(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _rows(table: Node, hidden: bool) -> Iterator[tuple[Node, int, bool]]:
    """(row, number of its group, hidden) of all rows of a table."""
    todo = [(c, 0, hidden) for c in table.children[::-1]]
    groups = 0
    while todo:
        child, group, hides = todo.pop()
        if isinstance(child, Node) and child.shown():
            hides = child.hides(hides)
            if child.tag == "tr":
                yield child, group, hides
            elif child.tag in ("thead", "tbody", "tfoot"):
                groups += 1
                todo += [(c, groups, hides) for c in child.children[::-1]]


def _broken(line: str) -> list[str]:
    """A line broken at spaces so that its parts stay within WIDTH where they can."""
    if len(line) <= WIDTH:
        return [line]
    indent = line[: len(line) - len(line.lstrip())][: WIDTH // 2]
    return textwrap.wrap(line, WIDTH, subsequent_indent=indent, break_long_words=False, break_on_hyphens=False)


def _grid(table: Node, page: Page) -> list[tuple[dict[int, list[str]], bool]]:
    """The lines of each row's cells by their column, and whether they stand side by side."""
    grid: list[tuple[dict[int, list[str]], bool]] = []
    rows = list(_rows(table, page.hidden))
    end = [len(rows)] * len(rows)  # the row after the last one of a row's group
    for r in range(len(rows) - 2, -1, -1):
        end[r] = end[r + 1] if rows[r][1] == rows[r + 1][1] else r + 1
    taken: list[tuple[int, int, int]] = []  # columns that cells from above hold: first, after the last, until row
    for r, (row, _, hides) in enumerate(rows):
        if any(x[2] <= r for x in taken):
            taken = [x for x in taken if x[2] > r]
        cells: dict[int, list[str]] = {}
        at, spot, below, aligned = 0, 0, [], True
        for cell in row.children:
            if not (isinstance(cell, Node) and cell.tag in ("td", "th") and cell.shown()):
                continue
            if page.nested >= DEEPEST:
                page.block(False)
                _inside(cell, page, False)
                continue
            while spot < len(taken) and taken[spot][0] <= at:
                at, spot = max(at, taken[spot][1]), spot + 1
            inner = Page(page.nested + 1, hides)
            _inside(cell, inner, False)
            cells[at] = inner.finish().split("\n")
            aligned &= not inner.parted
            across = min(max(cell.number("colspan", 1), 1), COLUMNS)
            down = cell.number("rowspan", 1)
            until = end[r] if down == 0 else min(r + min(max(down, 1), ROWS), end[r])
            if until > r + 1:
                below.append((at, at + across, until))
            at += across
        if below:
            joined: list[tuple[int, int, int]] = []
            for x in sorted(taken + below):
                if joined and joined[-1][1] == x[0] and joined[-1][2] == x[2]:
                    joined[-1] = (joined[-1][0], x[1], x[2])
                else:
                    joined.append(x)
            taken = joined
        grid.append((cells, aligned))
    return grid


def _table(table: Node, page: Page) -> None:
    grid = _grid(table, page)
    width: dict[int, int] = {}
    for cells, aligned in grid:
        final = max(cells, default=0)
        for i, lines in cells.items() if aligned else ():
            if i < final:
                lines[:] = [part for x in lines for part in _broken(x)]
            width[i] = max(width.get(i, 0), *(min(len(x), WIDTH) for x in lines))
    place, at = {}, 0
    for i in sorted(width):
        place[i], at = at, at + width[i] + 2
    for other in table.children:  # text and captions that stand outside the cells
        if not isinstance(other, Node):
            page.text(other)
        elif other.tag not in ("tr", "thead", "tbody", "tfoot") and other.shown():
            _render([other], page, False)
    hidden, page.hidden = page.hidden, False  # what is left in the cells is visible
    for cells, aligned in grid:
        page.block(False)
        if not aligned:
            for lines in cells.values():
                page.verbatim("\n".join(lines))
                page.block(False)
            continue
        for k in range(max(map(len, cells.values()), default=0)):
            line, low = [], 0  # `low` is where the line's written part ends
            for i, lines in cells.items():
                text = lines[k] if k < len(lines) else ""
                if text:
                    if low > place[i]:  # a long word stands in the way: go on below it
                        page.verbatim("".join(line))
                        page.block(False)
                        line, low = [], 0
                    line.append(" " * (place[i] - low) + text)
                    low = place[i] + len(text) + 2 * (len(text) > width[i])
            if line:
                page.verbatim("".join(line))
                page.block(False)
    page.hidden = hidden
    page.block(True)


def _inside(node: Node, page: Page, pre: bool, order: list | None = None) -> None:
    """A node's children, under its own visibility."""
    before, page.hidden = page.hidden, node.hides(page.hidden)
    _render(node.children, page, pre, order)
    page.hidden = before


def _render(children: list, page: Page, pre: bool, order: list | None = None) -> None:
    for child in children:
        if not isinstance(child, Node):
            (page.verbatim if pre else page.text)(child)
            continue
        tag = child.tag
        if not child.shown():
            continue
        if tag == "br":
            page.end_line() if page.line else page.block(False)
            continue
        block, empty = tag in BLOCK, tag in SPACED and not (tag in ("ul", "ol", "menu") and (page.indent or page.mark))
        if block:
            page.block(empty)
        if tag == "table":
            before, page.hidden = page.hidden, child.hides(page.hidden)
            _table(child, page)
            page.hidden = before
        elif tag == "li":
            before = page.indent
            if order is not None:
                order[0] = child.number("value", order[0] + 1)
            mark = "- " if order is None else f"{order[0]}. "
            page.mark, page.indent = before + mark, before + " " * len(mark) * (len(before) < 2 * DEEPEST)
            _inside(child, page, pre)
            page.end_line()
            page.mark, page.indent = "", before
        elif tag in ("ul", "ol", "menu", "dir"):
            _inside(child, page, pre, [child.number("start", 1) - 1] if tag == "ol" else None)
        elif tag in ("blockquote", "dd"):
            before = page.indent
            page.indent = before + "  " * (len(before) < 2 * DEEPEST)
            _inside(child, page, pre)
            page.end_line()
            page.indent = before
        elif tag == "details" and "open" not in child.attributes:
            before, page.hidden = page.hidden, child.hides(page.hidden)
            _render([c for c in child.children if isinstance(c, Node) and c.tag == "summary"], page, pre)
            page.hidden = before
        else:
            _inside(child, page, pre or tag in ("pre", "textarea"))
        if block:
            page.block(empty)


def render(page: str) -> str:
    """The visible text of a page."""
    # The renderer calls itself once a level; such calls take memory of the heap, not of the C stack.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 30))
    out = Page()
    _render(parse(page).children, out, False)
    return out.finish()


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines, n_chars) of every row of pages (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [render(v or "") for v in batch.column("html").to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_lines", "n_chars"])

    return pick(pages, "page_id", "html").mapInArrow(run, "page_id long, text string, n_lines long, n_chars long")
