"""Numbers inside text cells, truth values, and how numbers are written."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))$"
_NUMERIC = (T.NumericType,)


def num(c: Column, kind: T.DataType | None = None) -> Column:
    """A cell as DOUBLE or NULL: the identity on numeric columns, a guarded cast on text.

    The guard rejects what only Java reads as a number (``1d``, ``0x1p3``); white space around is allowed.
    """
    if isinstance(kind, _NUMERIC):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    text = F.trim(F.regexp_replace(c.cast("string"), r"^[\t\n\f\r ]+|[\t\n\f\r ]+$", ""))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def missing(c: Column) -> Column:
    """NULL, or an empty text."""
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def plain(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def ieee(op: str, left: Column, right: Column) -> Column:
    """A comparison in which NaN equals nothing and is neither less nor greater; NULL on either side is NULL.

    A conjunction of plain terms, so that Catalyst can push the comparison itself down to a scan.
    """
    ordinary = ~F.isnan(left) & ~F.isnan(right)
    if op == "ne":
        return ~ordinary | (left != right)
    plain_ops = {"eq": left == right, "lt": left < right, "le": left <= right, "gt": left > right, "ge": left >= right}
    return plain_ops[op] & ordinary


def format_float(x: float | None, precision: int = 4) -> str:
    """A sink's way to write a number: fixed precision, trailing zeros trimmed, nan and inf spelled out."""
    if x is None or math.isnan(x):
        return "nan"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    text = f"{x:.{precision}f}"
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text == "-0" else text


def group_digits(text: str, digits: int | None = None) -> str:
    """A number with thousands separators, rounded to so many digits if given."""
    value = float(text)
    if digits is not None:
        return f"{value:,.{digits}f}"
    whole, dot, rest = text.strip().partition(".")
    return f"{int(whole):,}{dot}{rest}"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
