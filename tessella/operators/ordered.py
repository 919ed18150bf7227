"""Operators that depend on the order of rows: sort, reverse, slice, number, fill down, blank repeats, running sums.

The order is named by ``order_by`` columns. Results carry it by their own sort or by a number column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import resolve_fields
from ..functions.numbers import ascii_lower, num, plain
from ..plans.order import SMALL_ROWS, Ordered


def sort_rows(df: DataFrame, keys: str | None = None, numeric: bool = False, descending: bool = False, order_by: Sequence[str] = ()) -> DataFrame:
    """Sorted by key fields (all of them without ``keys``): as text, bytewise, or as numbers (others count as 0).

    ``order_by`` orders ties, ascending also when ``descending``. NaN sorts after all numbers.
    """
    names = resolve_fields(keys, df.columns) if keys else df.columns
    cols: list[Column] = []
    for c in names:
        x = F.coalesce(num(F.col(f"`{c}`"), df.schema[c].dataType), F.lit(0.0)) if numeric else plain(F.col(f"`{c}`"))
        cols.append(x.desc() if descending else x.asc())
    return df.orderBy(*cols, *order_by)


def reverse(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*(F.col(c).desc() for c in order_by))


def _ranges(spec: str) -> list[tuple[int, int | None]]:
    out = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d*)(-?)(\d*)\s*", part)
        if not m or not (m[1] or m[3]):
            raise ValueError(f"not a row range: {part!r}")
        low = int(m[1]) if m[1] else 1
        high = int(m[3]) if m[3] else None if m[2] else low
        if low < 1 or high is not None and high < low:
            raise ValueError(f"not a row range: {part!r}")
        out.append((low, high))
    return out


def slice_rows(df: DataFrame, ranges: str | None, order_by: Sequence[str], invert: bool = False, header_lines: int = 0, number: str | None = None, small: int = SMALL_ROWS) -> DataFrame:
    """Rows of the given places (``5``, ``5-9``, ``5-``, ``-9``, several by comma), counted from 1 after ``header_lines``.

    If every range ends, only the first rows of the order are read past: a limit, not a full numbering.
    """
    if ranges is None:
        return df if invert else df.limit(0)
    spans = _ranges(ranges)
    name = number or "__n"
    ends = [b for _, b in spans]
    if not invert and all(b is not None for b in ends) and max(ends) - header_lines <= small:
        df = df.orderBy(*order_by).limit(max(0, max(ends) - header_lines))
    numbered = Ordered(df, order_by, small).number(name, 1 + header_lines)
    hit = F.lit(False)
    for a, b in spans:
        hit |= (F.col(name) >= a) & (F.col(name) <= b if b is not None else F.lit(True))
    out = numbered.where(~hit if invert else hit)
    return out if number else out.drop(name)


def nl(df: DataFrame, order_by: Sequence[str], name: str = "line", start: int = 1, small: int = SMALL_ROWS) -> DataFrame:
    """Rows numbered in order; the number comes first."""
    return Ordered(df, order_by, small).number(name, start).select(name, *(F.col(f"`{c}`") for c in df.columns))


def fill(df: DataFrame, fields: str, order_by: Sequence[str] | None = None, value: object = None, na: str = "", small: int = SMALL_ROWS) -> DataFrame:
    """Missing cells (NULL, or text equal to ``na``) take ``value``, or else the last cell that isn't missing."""
    names = resolve_fields(fields, df.columns)
    present = {c: F.when(F.col(f"`{c}`").isNotNull() & (plain(F.col(f"`{c}`")) != na), F.col(f"`{c}`")) for c in names}
    if value is not None:
        return df.withColumns({c: F.coalesce(p, F.lit(value).cast(df.schema[c].dataType)) for c, p in present.items()})
    if order_by is None:
        raise ValueError("filling down depends on the order of rows: say order_by")
    filled = Ordered(df, order_by, small).last_present({f"__f{i}": present[c] for i, c in enumerate(names)})
    where = {c: i for i, c in enumerate(names)}
    # a leading missing cell stays as it is
    return filled.select(*(F.coalesce(F.col(f"__f{where[c]}"), F.col(f"`{c}`")).alias(c) if c in where else F.col(f"`{c}`") for c in df.columns))


def blank(df: DataFrame, fields: str | Sequence[tuple[str, str]], order_by: Sequence[str], replacement: str = "", ignore_case: bool = False, small: int = SMALL_ROWS) -> DataFrame:
    """Cells equal to the row's before are replaced (``fields`` may be (field, replacement) pairs)."""
    pairs = [(f, replacement) for f in resolve_fields(fields, df.columns)] if isinstance(fields, str) else [(c, r) for f, r in fields for c in resolve_fields(f, df.columns)]
    shown = lambda c: ascii_lower(plain(F.col(f"`{c}`"))) if ignore_case else plain(F.col(f"`{c}`"))
    before = Ordered(df, order_by, small).previous({f"__p{i}": shown(c) for i, (c, _) in enumerate(pairs)})
    new = {c: F.when(F.col(f"__p{i}").isNotNull() & (F.col(f"__p{i}.v") == shown(c)), F.lit(r)).otherwise(F.col(f"`{c}`").cast("string")) for i, (c, r) in enumerate(pairs)}
    return before.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns))


def running_sum(df: DataFrame, field: str, order_by: Sequence[str], name: str = "running_sum", small: int = SMALL_ROWS) -> DataFrame:
    c = resolve_fields(field, df.columns)[0]
    return Ordered(df, order_by, small).running_sum({name: num(F.col(f"`{c}`"), df.schema[c].dataType)})
