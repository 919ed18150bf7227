"""The field-list mini-language: ``1,3-5,name,first-last,prefix*,a\\,b`` resolved to column names on the driver."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

MAX_INDEX = 1_048_576


class FieldError(ValueError):
    pass


def _items(spec: str, separator: str = ",") -> list[list[tuple[str, bool]]]:
    """Items as (character, escaped) lists; a backslash escapes what follows it."""
    items: list[list[tuple[str, bool]]] = [[]]
    escaped = False
    for ch in spec:
        if escaped:
            items[-1].append((ch, True))
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == separator:
            items.append([])
        else:
            items[-1].append((ch, False))
    if escaped:
        raise FieldError(f"field list ends in a lone backslash: {spec!r}")
    return items


def _text(item: list[tuple[str, bool]]) -> str:
    return "".join(c for c, _ in item)


def _number(item: list[tuple[str, bool]]) -> int | None:
    return int(_text(item)) if item and all(c.isascii() and c.isdigit() and not e for c, e in item) else None


def _position(item: list[tuple[str, bool]], columns: Sequence[str], whole: str) -> int:
    """0-based position of one end of a range."""
    n = _number(item)
    if n is not None:
        return _checked(n, columns, whole)
    name = _text(item)
    if name not in columns:
        raise FieldError(f"no column named {name!r} in {whole!r}")
    return list(columns).index(name)


def _checked(n: int, columns: Sequence[str], whole: str) -> int:
    if not 1 <= n <= MAX_INDEX:
        raise FieldError(f"field index {n} in {whole!r} is not from 1 to {MAX_INDEX}")
    if n > len(columns):
        raise FieldError(f"field index {n} in {whole!r}: there are {len(columns)} columns")
    return n - 1


def resolve_fields(spec: str | Sequence[str], columns: Sequence[str], zero: bool = False) -> list[str]:
    """Column names of a field list, in its order and with its repetitions.

    Numbers count from 1; a range may run backwards and then descends; ``*`` stands for any characters; an exact name
    wins over a pattern. With ``zero``, the lone item ``0`` stands for all columns.
    """
    if not isinstance(spec, str):
        spec = ",".join(re.sub(r"([\\,\-*])", r"\\\1", s) if s in columns else s for s in spec)
    if zero and spec.strip() == "0":
        return list(columns)
    out: list[str] = []
    for item in _items(spec):
        text = _text(item)
        if not text:
            raise FieldError(f"empty item in field list {spec!r}")
        n = _number(item)
        if n is not None:
            out.append(columns[_checked(n, columns, spec)])
            continue
        if text in columns:
            out.append(text)
            continue
        dashes = [k for k, (c, e) in enumerate(item) if c == "-" and not e]
        ends = [(item[:k], item[k + 1 :]) for k in dashes if 0 < k < len(item) - 1]
        found = None
        for low, high in ends:
            if all(_number(x) is not None or _text(x) in columns for x in (low, high)):
                found = (_position(low, columns, spec), _position(high, columns, spec))
                break
        if found:
            step = 1 if found[1] >= found[0] else -1
            out += [columns[k] for k in range(found[0], found[1] + step, step)]
            continue
        if dashes and not ends:
            raise FieldError(f"incomplete range {text!r} in {spec!r}")
        if any(c == "*" and not e for c, e in item):
            pattern = "".join("*" if c == "*" and not e else f"[{c}]" if c in "*?[" else c for c, e in item)
            matches = [c for c in columns if fnmatch.fnmatchcase(c, pattern)]
            if matches:
                out += matches
                continue
        raise FieldError(f"no column matches {text!r} in {spec!r}")
    return out


def split_last(spec: str, separators: str = ": ") -> tuple[str, str]:
    """``FIELDS:VALUE`` at the last colon, or else at the last space."""
    for sep in separators:
        if sep in spec:
            left, _, right = spec.rpartition(sep)
            return left, right
    raise FieldError(f"expected FIELDS:VALUE, got {spec!r}")
