"""Column selection by field list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import FieldError, resolve_fields


def select(df: DataFrame, fields: str | None = None, exclude: str | None = None, rest: str | None = None) -> DataFrame:
    """Keeps ``fields`` in their order, drops ``exclude``, and puts the others ``first``, ``last`` or nowhere (``none``).

    Without ``rest``, the others are dropped if only fields are given, and kept if anything is excluded. A field that
    is listed twice comes out twice, the second under a name of its own (``name_2``).
    """
    if fields is None and exclude is None:
        raise FieldError("either fields or exclude is needed")
    wanted = resolve_fields(fields, df.columns) if fields is not None else []
    gone = set(resolve_fields(exclude, df.columns)) if exclude is not None else set()
    if both := gone & set(wanted):
        raise FieldError(f"fields both kept and excluded: {sorted(both)}")
    if rest is None:
        rest = "none" if exclude is None else "last" if fields is not None else "first"
    if rest not in ("first", "last", "none"):
        raise ValueError("rest is first, last or none")
    others = [c for c in df.columns if c not in gone and c not in wanted]
    order = {"first": others + wanted, "last": wanted + others, "none": wanted}[rest]
    seen: dict[str, int] = {}
    out = []
    for c in order:
        seen[c] = seen.get(c, 0) + 1
        out.append(F.col(f"`{c}`").alias(c if seen[c] == 1 else f"{c}_{seen[c]}"))
    return df.select(*out)
