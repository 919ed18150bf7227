"""Templates of fmt(): ``%(...)``, ``%[...]`` or ``%{...}`` with positional, numbered, column and variable references."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

_PLACE = re.compile(r"%(?:\(([^)]*)\)|\[([^\]]*)\]|\{([^}]*)\})")
_SPEC = re.compile(r"(?:(?P<fill>.)?(?P<align>[<>^]))?(?P<sign>[+-])?(?P<alt>#)?(?P<zero>0)?(?P<width>\d+)?(?:\.(?P<precision>\d+))?(?P<type>[boxXeE])?", re.S)


def pieces(template: str) -> list[str | tuple[str, str]]:
    """Text and (reference, format) pairs, in turn; ``%%`` is a percent sign."""
    out: list[str | tuple[str, str]] = []
    at = 0
    for m in _PLACE.finditer(template):
        out.append(template[at : m.start()].replace("%%", "%"))
        body = next(g for g in m.groups() if g is not None)
        ref, _, spec = body.partition(":")
        out.append((ref.strip(), spec))
        at = m.end()
    out.append(template[at:].replace("%%", "%"))
    return out


def format_value(x: Any, spec: str) -> str:
    from .evaluator import show

    m = _SPEC.fullmatch(spec)
    if not m:
        raise ValueError(f"not a format: {spec!r}")
    kind, precision = m["type"], int(m["precision"]) if m["precision"] else None
    numeric = isinstance(x, (int, float)) and not isinstance(x, bool)
    sign = ""
    if numeric:
        sign = "-" if x < 0 else "+" if m["sign"] == "+" else ""
        size = abs(x)
        if kind in ("e", "E"):
            text = format(float(size), f".{precision if precision is not None else 6}{kind}")
        elif kind in ("b", "o", "x", "X"):
            text = format(int(size), kind)
            if precision is not None:
                text = text.rjust(precision, "0")
            if m["alt"]:
                text = "0" + kind + text
        elif precision is not None:
            text = f"{size:.{precision}f}" if isinstance(x, float) else str(size).rjust(precision, "0")
        else:
            text = show(size)
    else:
        text = show(x)
        if precision is not None:
            text = text[:precision]
    width = int(m["width"] or 0)
    if m["zero"] and numeric and not m["align"]:
        return sign + text.rjust(width - len(sign), "0")
    text = sign + text
    align, fill = m["align"] or (">" if numeric else "<"), m["fill"] or " "
    return {"<": text.ljust, ">": text.rjust, "^": text.center}[align](width, fill) if align != "^" else fill * ((width - len(text)) // 2 if width > len(text) else 0) + text + fill * (-((len(text) - width) // 2) if width > len(text) else 0)


def format_template(template: str, args: list, lookup: Callable[[str | int], Any]) -> str:
    out, turn = [], 0
    for p in pieces(template):
        if isinstance(p, str):
            out.append(p)
            continue
        ref, spec = p
        if not ref:
            if turn >= len(args):
                raise ValueError("fmt: too few arguments")
            x, turn = args[turn], turn + 1
        elif ref.isdigit():
            x = args[int(ref) - 1]
        else:
            name = ref.removeprefix("@")
            x = lookup(int(name) if name.isdigit() else name)
        out.append(format_value(x, spec) if spec else format_value(x, ""))
    return "".join(out)
