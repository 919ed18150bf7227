"""Rows from HTML pages: by CSS query, from tables, or by a row selector with columns.

A page is parsed in Python (Arrow batches, no row-wise UDF) with the standard library's tokenizer and a small tree;
selectors cover types, ids, classes, attributes, positions and the four combinators.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        todo = [iter(self.elements)]
        while todo:
            node = next(todo[-1], None)
            if node is None:
                todo.pop()
                continue
            yield node
            todo.append(iter(node.elements))

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                todo += reversed(x.children)
        return "".join(parts)

    def outer(self) -> str:
        attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        inner = "".join(c.outer() if isinstance(c, Node) else escape(c, quote=False) for c in self.children)
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class _Builder(HTMLParser):
    #: a start tag ends these open elements
    ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.now.tag in self.ENDS.get(tag, ()):
            self.now = self.now.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.now.tag == tag:
            self.now = self.now.parent

    def handle_endtag(self, tag):
        x = self.now
        while x is not self.root and x.tag != tag:
            x = x.parent
        if x is not self.root:
            self.now = x.parent

    def handle_data(self, data):
        self.now.children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_SIMPLE = re.compile(r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^)]*)\))?""")
Test = Callable[[Node], bool]


def _place(node: Node, of_type: bool = False) -> tuple[int, int]:
    same = [e for e in (node.parent.elements if node.parent else [node]) if not of_type or e.tag == node.tag]
    return same.index(node) + 1, len(same)


def _nth(arg: str) -> Callable[[int], bool]:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip(), arg.replace(" ", ""))
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", arg):
        a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
        b = int(m[2] or 0)
        return lambda k: k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0
    return lambda k: k == int(arg)


def _pseudo(name: str, arg: str | None) -> Test:
    if name == "not":
        inner = selector(arg or "*")
        return lambda n: not inner(n)
    if name == "nth-child":
        hit = _nth(arg or "")
        return lambda n: hit(_place(n)[0])
    if name == "nth-of-type":
        hit = _nth(arg or "")
        return lambda n: hit(_place(n, True)[0])
    found = {
        "first-child": lambda n: _place(n)[0] == 1,
        "last-child": lambda n: len(set(_place(n))) == 1,
        "only-child": lambda n: _place(n) == (1, 1),
        "first-of-type": lambda n: _place(n, True)[0] == 1,
        "last-of-type": lambda n: len(set(_place(n, True))) == 1,
        "empty": lambda n: not n.children,
    }.get(name)
    if found is None:
        raise ValueError(f"unknown pseudo-class :{name}")
    return found


def _attribute(name: str, op: str | None, value: str) -> Test:
    if op is None:
        return lambda n: name in n.attrs
    check = {"=": lambda a: a == value, "^=": lambda a: bool(value) and a.startswith(value), "$=": lambda a: bool(value) and a.endswith(value), "*=": lambda a: bool(value) and value in a, "~=": lambda a: value in a.split(), "|=": lambda a: a == value or a.startswith(value + "-")}[op]
    return lambda n: name in n.attrs and check(n.attrs[name])


def _compound(text: str) -> Test:
    tests: list[Test] = []
    at = 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"can't read selector {text!r}")
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                tests.append(lambda n, t=m["tag"].lower(): n.tag == t)
        elif m["id"]:
            tests.append(lambda n, i=m["id"]: n.attrs.get("id") == i)
        elif m["cls"]:
            tests.append(lambda n, c=m["cls"]: c in n.attrs.get("class", "").split())
        elif m["attr"]:
            value = (m["val"] or "").strip()
            tests.append(_attribute(m["attr"].lower(), m["op"], value[1:-1] if value[:1] in "\"'" and value else value))
        else:
            tests.append(_pseudo(m["pseudo"], m["arg"]))
    return lambda n: all(t(n) for t in tests)


def _split(text: str, separators: str) -> list[str]:
    """Split outside of brackets, parentheses and quotes; separators are kept."""
    out, depth, quote = [""], 0, ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "[(":
            depth += 1
        elif ch in "])":
            depth -= 1
        elif depth == 0 and ch in separators:
            out += [ch, ""]
            continue
        out[-1] += ch
    return out


def _complex(text: str) -> Test:
    parts = [p for p in (x.strip() or (" " if x else "") for x in _split(re.sub(r"\s*([>+~])\s*(?![=])", r"\1", text.strip()), " >+~")) if p]
    tests = [(" ", _compound(parts[0]))]
    for k in range(1, len(parts) - 1, 2):
        tests.append((parts[k], _compound(parts[k + 1])))

    def match(n: Node, k: int) -> bool:
        how, test = tests[k]
        if not test(n):
            return False
        if k == 0:
            return True
        if how == ">":
            return n.parent is not None and match(n.parent, k - 1)
        if how == " ":
            p = n.parent
            while p is not None:
                if match(p, k - 1):
                    return True
                p = p.parent
            return False
        before = n.parent.elements[: _place(n)[0] - 1] if n.parent else []
        return any(match(b, k - 1) for b in (before[-1:] if how == "+" else before))

    return lambda n: match(n, len(tests) - 1)


def selector(text: str) -> Test:
    tests = [_complex(t) for t in _split(text, ",") if t.strip() not in ("", ",")]
    if not tests:
        raise ValueError("empty selector")
    return lambda n: any(t(n) for t in tests)


_FUNCTION = re.compile(r"""^(?P<css>.*?)\s*(?:(?P<text>text(?:\{\}|\(\)))|attr(?:\{(?P<a>[\w:-]+)\}|\(\s*["']?(?P<b>[\w:-]+)["']?\s*\)))\s*$""", re.S)


def query(text: str) -> tuple[Test, Callable[[Node], str]]:
    """``SELECTOR text{}``, ``SELECTOR attr{name}`` or ``SELECTOR`` (the element's HTML)."""
    m = _FUNCTION.match(text)
    if not m:
        return selector(text), Node.outer
    css = m["css"].strip() or "*"
    if m["text"]:
        return selector(css), lambda n: n.text().strip()
    name = (m["a"] or m["b"]).lower()
    return selector(css), lambda n: n.attrs.get(name, "")


def _rows_of(table: Node) -> list[list[str]]:
    rows = [r for c in table.elements for r in ([c] if c.tag == "tr" else c.elements if c.tag in ("thead", "tbody", "tfoot") else []) if r.tag == "tr"]
    out = [[c.text().strip() for c in r.elements if c.tag in ("td", "th")] for r in rows]
    return [r for r in out if r]


def from_html(pages: DataFrame, html_col: str = "html", id_col: str | None = None, css: str | None = None, table: str | bool = False, index: int = 1, row: str | None = None, cols: dict[str, str] | None = None) -> DataFrame:
    """Rows of every page: ``css`` gives (n, value), ``table`` (True, or a selector) the index-th table's (n, cells),
    ``row`` with ``cols`` (name: query below the row) one text column a name, empty where nothing is found.
    """
    if sum(x not in (None, False) for x in (css, table, row)) != 1:
        raise ValueError("one of css, table and row is needed")
    if css is not None:
        query(css)  # a bad selector fails here, not in a task
        kind = "value string"
    elif row is not None:
        kind = ", ".join(f"`{c}` string" for c in cols or {})
    else:
        kind = "cells array<string>"
    id_kind = f"id {pages.schema[id_col].dataType.simpleString()}, " if id_col else ""

    def extract(root: Node) -> list[tuple]:
        if css is not None:
            hit, value = query(css)
            return [(value(n),) for n in root.walk() if hit(n)]
        if row is not None:
            hit = selector(row)
            out = []
            for r in (n for n in root.walk() if hit(n)):
                line = []
                for q in (cols or {}).values():
                    inner, value = query(q)
                    line.append(next((value(n) for n in r.walk() if inner(n)), ""))
                out.append(tuple(line))
            return out
        hit = selector("table" if table is True else table)
        found = [n for n in root.walk() if hit(n)]
        return [(r,) for r in _rows_of(found[index - 1])] if len(found) >= index else []

    names = [c.strip().split(" ")[0].strip("`") for c in (id_kind + "n int, " + kind).split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for values in part.itertuples(index=False, name=None):
                if isinstance(values[0], str):
                    rows += [(*values[1:], i, *r) for i, r in enumerate(extract(tree(values[0])), 1)]
            yield pd.DataFrame(rows, columns=names)

    source = pages.select(html_col, *([id_col] if id_col else []))
    out = source.mapInPandas(run, id_kind + "n int, " + kind)
    return out.withColumnRenamed("id", id_col) if id_col else out
