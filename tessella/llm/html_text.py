"""Layout-aware rendering of HTML: all visible text, with block spacing, lists and aligned table cells.

A tokeniser feeds a tree builder that knows implied end tags (a block ends an open paragraph, an item its sibling, a
row its cells, ...), void and raw-text elements; elements that aren't displayed (by tag, the attribute ``hidden`` or
``display:none`` in their style) are left out with all they hold, and text under ``visibility:hidden`` unless an element
within is visible again. ``aria-hidden`` text is seen on the page, so it stays. Blocks are separated by line breaks,
paragraphs and headings by blank lines; list items get a bullet or number and two spaces a level; cells of a table
stand in a grid (with their row and column spans) padded to the widest of their column; preformatted text keeps its
white space, other white space collapses.

Edge cases: a null page is a null text, an empty one or one without visible text an empty text; unclosed, stray or
badly nested tags are mended, never an error; rows are rendered one by one, so repeated rows and null ids don't
matter; an empty table gives an empty result; other columns are ignored. Pages of any length or depth are rendered
whole, without recursion.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging

# Element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript datalist object audio video canvas svg iframe noembed noframes param rp meta link base".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend main menu nav option optgroup search section select summary tbody tfoot thead".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol pre table caption blockquote dl".split())
#: element -> open elements that it ends, and those that guard against ending further out
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
ENDS_P = BLOCK | SPACED | {"li", "hr"}
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
CELL_SCOPE = frozenset(("td", "th", "table"))
CROSSES_CELLS = frozenset("table tr tbody thead tfoot td th body html".split())
#: roots of foreign content, where "/>" closes, and elements in it that hold HTML again
FOREIGN = frozenset(("svg", "math"))
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|(?=<)|\Z)""", re.S)
_MAY_HIDE = re.compile(r"(?i)hidden|style")
_ATTRIBUTE = re.compile(r"""(=?[^ \t\n\f\r/>=]+|=)(?:[ \t\n\f\r]*=[ \t\n\f\r]*("[^"]*"?|'[^']*'?|[^ \t\n\f\r>]+))?""")
#: what a semicolon of CSS doesn't end: comments, strings, brackets
_OPAQUE = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^()"'])*\)""", re.S)
_KEYWORDS = re.compile(r"[a-z-]+(?:\s+[a-z-]+)*")
_NUMBER = re.compile(r"[ \t\n\f\r]*\+?(\d{1,9})")
#: Cells wider than this don't widen their column, they push what follows in their row.
WIDEST = 200
DEEPEST = 60
_START = re.compile(r"""(?i)\bstart\s*=\s*["']?(-?\d+)""")
_SPACES = re.compile(r"[ \t\n\r\f\v]+")


class Table:
    """Cells in a grid: each row's (column, columns it spans, text), as row and column spans place them."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, str]]] = []
        self.down: list[list[int]] = []  # spans from rows above: first column, end, rows left (negative: all of the section)

    def new_row(self) -> None:
        self.rows.append([])
        self.down = [[a, b, left - 1] for a, b, left in self.down if left != 0]
        self.at = 0

    def new_section(self) -> None:
        self.down = []

    def add(self, text: str, columns: int, rows: int) -> None:
        if not self.rows:
            self.new_row()
        for a, b, _ in sorted(self.down):
            if a < self.at + columns and b > self.at:
                self.at = b
        if rows != 1:
            self.down.append([self.at, self.at + columns, rows - 1])
        self.rows[-1].append((self.at, columns, text))
        self.at += columns

    def lines(self) -> list[str]:
        used = sorted({c for row in self.rows for c, _, _ in row})
        ends: dict[int, list[tuple[int, int]]] = {}
        for row in self.rows:
            for c, columns, text in row:
                k = bisect_left(used, c + columns)
                if k < len(used):
                    ends.setdefault(used[k], []).append((c, min(max(map(len, text.split("\n"))), WIDEST)))
        place: dict[int, int] = {}
        for before, c in zip([None, *used], used, strict=False):
            place[c] = max([place[a] + w + 2 for a, w in ends.get(c, ())] + [0 if before is None else place[before] + 2])
        out = []
        for row in self.rows:
            if not any(text for _, _, text in row):
                continue
            cells = [(place[c], text.split("\n")) for c, _, text in row]
            for i in range(max(len(x) for _, x in cells)):
                line = ""
                for at, x in cells:
                    if i < len(x) and x[i]:
                        line = (line.ljust(at) if len(line) + 2 <= at or not line else line + "  ") + x[i]
                out.append(line.rstrip())
        return out


class Canvas:
    """Lines of one flow: the page, or one table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.mark = ""
        self.gap = False
        self.space = False
        self.span = (1, 1)

    def text(self, s: str, pre: bool) -> None:
        if pre:
            head, *tail = s.split("\n")
            self.add(head)
            for part in tail:
                self.lines.append("".join(self.line))
                self.line = [part] if part else []
            return
        for i, word in enumerate(_SPACES.split(s)):
            if i:
                self.space = True
            if word:
                self.add(word)

    def add(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            if self.mark:
                self.line.append(self.mark)
                self.mark = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(s)

    def end_line(self, gap: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap |= gap

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _closes_itself(attrs: str) -> bool:
    """Whether a start tag ends in a slash of its own, not one of an unquoted value."""
    if not attrs.endswith("/"):
        return False
    last = None
    for last in _ATTRIBUTE.finditer(attrs):
        pass
    return last is None or last.end() < len(attrs)


def _attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        value = m[2] or ""
        if value[:1] in ('"', "'"):
            value = value[1:].removesuffix(value[0])
        out.setdefault(m[1].lower(), unescape(value))
    return out


def _declared(style: str) -> tuple[str, str]:
    """The values of display and visibility that prevail among declarations; empty without one."""
    chosen: dict[str, tuple[bool, str]] = {}
    for declaration in _OPAQUE.sub(" ", style).lower().split(";"):
        name, _, value = declaration.partition(":")
        name = name.strip()
        if name not in ("display", "visibility"):
            continue
        value, bang, rest = value.partition("!")
        value, important = value.strip(), rest.strip() == "important"
        if bool(bang) == important and _KEYWORDS.fullmatch(value) and (important or not chosen.get(name, (False,))[0]):
            chosen[name] = important, value
    return chosen.get("display", (False, ""))[1], chosen.get("visibility", (False, ""))[1]


def _shows(tag: str, attrs: str) -> tuple[bool, bool | None]:
    """Whether an element is left out with all it holds; whether its text is seen (None: as its parent's)."""
    if tag in HIDDEN:
        return True, None
    if not attrs or not _MAY_HIDE.search(attrs):
        return False, None
    own = _attributes(attrs)
    if own.get("hidden", "false").strip().lower() not in ("false", "until-found") or tag == "input" and own.get("type", "").strip().lower() == "hidden":
        return True, None
    display, visibility = _declared(own.get("style", ""))
    return display == "none", {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(visibility)


def _spans(attrs: str) -> tuple[int, int]:
    """(columns, rows) that a cell spans; 0 rows are all that are left of its section."""
    own = _attributes(attrs) if "span" in attrs.lower() else {}
    columns, rows = (int(m[1]) if (m := _NUMBER.match(own.get(k, ""))) else 1 for k in ("colspan", "rowspan"))
    return min(max(columns, 1), 1000), min(rows, 65534)


def indent(depth: int) -> str:
    """Two spaces a level; beyond DEEPEST the level is written as a number, so a page's lines don't grow with its depth."""
    return "  " * depth if depth <= DEEPEST else "  " * DEEPEST + f"({depth}) "


class Renderer:
    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # open elements, whether each hides what it holds, whether text was seen before
        self.places: dict[str, list[int]] = {}  # of each element's name, where it stands on the stack
        self.hidden = 0
        self.seen = True
        self.pre = 0
        self.lists: list[int | None] = []
        self.canvases = [Canvas()]
        self.tables: list[Table] = []

    @property
    def out(self) -> Canvas:
        return self.canvases[-1]

    def text(self, raw: str) -> None:
        if not self.hidden and self.seen:
            self.out.text(unescape(raw) if "&" in raw else raw, bool(self.pre))

    def innermost(self, tags: Iterable[str]) -> int:
        """Where the innermost open element of these names stands, however deep; -1 without one."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def foreign(self, tag: str) -> bool:
        """Whether an element that starts here is one of an inline drawing or formula, not of HTML."""
        return tag in FOREIGN or (root := self.innermost(FOREIGN)) >= 0 and self.innermost(HTML_AGAIN) < root

    def pop(self) -> None:
        tag, hides, seen = self.stack.pop()
        self.places[tag].pop()
        self.finish(tag, hides)
        self.seen = seen

    def start(self, tag: str, attrs: str) -> None:
        if tag in ENDS_P:
            self.close_within({"p"}, {"table", "td", "th", "button"})
        if tag in IMPLIED:
            self.close_within(*IMPLIED[tag])
        if attrs.endswith("/") and self.foreign(tag) and _closes_itself(attrs):
            return
        hides, shown = _shows(tag, attrs)
        shown = self.seen if shown is None else shown
        if tag in VOID:
            if not self.hidden and not hides and shown:
                if tag == "br":
                    self.out.end_line() if self.out.line else self.out.lines.append("") if self.out.lines and self.out.lines[-1] else None
                elif tag == "hr":
                    self.out.end_line()
                    self.out.text("---", False)
                    self.out.end_line()
            return
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, hides, self.seen))
        self.hidden += hides
        self.seen = shown
        if self.hidden:
            return
        if tag in ("td", "th"):
            if self.tables:
                self.canvases.append(Canvas())
                self.out.span = _spans(attrs)
        elif tag == "table":
            self.out.end_line(True)
            self.tables.append(Table())
        elif tag == "tr":
            if self.tables:
                self.tables[-1].new_row()
        elif tag in SPACED or tag in BLOCK:
            if tag in SECTIONS and self.tables:
                self.tables[-1].new_section()
            self.out.end_line(tag in SPACED and not (tag in ("ul", "ol") and self.lists))
            if tag in ("ul", "ol"):
                first = _START.search(attrs)
                self.lists.append(None if tag == "ul" else int(first[1]) - 1 if first else 0)
            elif tag == "pre":
                self.pre += 1
        elif tag == "li":
            self.out.end_line()
            deep = indent(max(len(self.lists) - 1, 0))
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                self.out.mark = f"{deep}{self.lists[-1]}. " if shown else ""
            else:
                self.out.mark = f"{deep}- " if shown else ""

    def finish(self, tag: str, hides: bool) -> None:
        """Effects of the end of the innermost element, already off the stack."""
        visible = not self.hidden
        self.hidden -= hides
        if not visible:
            return
        if tag in ("td", "th"):
            if self.tables and len(self.canvases) > 1:
                cell = self.canvases.pop()
                self.tables[-1].add(cell.result(), *cell.span)
        elif tag == "table":
            if self.tables:
                for line in self.tables.pop().lines():
                    self.out.add(line)
                    self.out.end_line()
                self.out.end_line(True)
        elif tag in SPACED or tag in BLOCK:
            self.out.end_line(tag in SPACED and not (tag in ("ul", "ol") and len(self.lists) > 1))
            if tag in ("ul", "ol"):
                self.lists.pop() if self.lists else None
            elif tag == "pre":
                self.pre -= 1
        elif tag == "li":
            self.out.end_line()
            self.out.mark = ""

    def close_within(self, targets: set[str], guards: set[str]) -> None:
        """Ends the innermost open target, and all inside it, unless a guard is met before."""
        at = self.innermost(targets)
        if at <= self.innermost(guards):
            return
        while at > 0 and self.stack[at - 1][0] in targets and len(targets) > 1:
            at -= 1
        while len(self.stack) > at:
            self.pop()

    def end(self, tag: str) -> None:
        if tag == "p" and not self.places.get("p"):
            if not self.hidden:
                self.out.end_line(True)
            return
        if tag == "br":
            self.start("br", "")
            return
        at = self.innermost((tag,))
        if at < 0 or tag not in CROSSES_CELLS and self.innermost(CELL_SCOPE) > at:
            return
        while len(self.stack) > at:
            self.pop()

    def result(self) -> str:
        while self.stack:
            self.pop()
        return self.canvases[0].result()


def render(html: str | None) -> str | None:
    if html is None:
        return None
    r = Renderer()
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            r.text(html[at:])
            break
        if m.start() > at:
            r.text(html[at : m.start()])
        at = max(m.end(), m.start() + 1)
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            r.end(tag)
            continue
        raw = tag in RAW and not r.foreign(tag)
        r.start(tag, m[3])
        if raw:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = end.start() if end else n
            if tag == "textarea" or tag == "xmp":
                r.text(html[at:stop])
            at = stop
            if not end:
                break
    return r.result()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = [render(h) for h in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page."""
    staging.ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return source.mapInArrow(_render, f"id {kind}, text string").withColumnRenamed("id", id_col)
