"""Pivot, unpivot and transpose."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import FieldError, resolve_fields
from ..functions.numbers import missing, num, plain
from . import stats as S

WIDER_OPS = ("count", "first", "last", "sum", "min", "max", "mean", "median", "mode", "variance", "stdev", "q1", "q3", "iqr", "range", "nunique", "values", "unique_values")


def longer(
    df: DataFrame,
    cols: str,
    names_to: str | Sequence[str] = "name",
    values_to: str = "value",
    names_sep: str | None = None,
    names_pattern: str | None = None,
    names_prefix: str | None = None,
    drop_na: bool = False,
) -> DataFrame:
    """One row for each row and column of ``cols``: the other columns, the column's name (or its parts) and its value.

    The name's parts are computed on the driver, so the plan is one Expand without a shuffle.
    """
    melted = list(dict.fromkeys(resolve_fields(cols, df.columns)))
    ids = [c for c in df.columns if c not in melted]
    targets = [names_to] if isinstance(names_to, str) else list(names_to)
    if clash := {*targets, values_to} & set(ids) or len({*targets, values_to}) <= len(targets):
        raise FieldError(f"names of the new columns are taken: {clash}")

    def parts(name: str) -> list[str]:
        short = name.removeprefix(names_prefix) if names_prefix else name
        if names_pattern:
            m = re.search(names_pattern, short)
            got = [g or "" for g in m.groups()] if m else [short]
        elif names_sep:
            got = short.split(names_sep)
        else:
            got = [short]
        return (got + [""] * len(targets))[: len(targets)]

    kinds = {df.schema[c].dataType.simpleString() for c in melted}
    value = lambda c: F.col(f"`{c}`") if len(kinds) == 1 else F.col(f"`{c}`").cast("string")
    cells = [F.struct(*(F.lit(p).alias(t) for p, t in zip(parts(c), targets, strict=True)), value(c).alias(values_to)) for c in melted]
    out = df.select(*(F.col(f"`{c}`") for c in ids), F.explode(F.array(*cells)).alias("__cell")).select(*(F.col(f"`{c}`") for c in ids), "__cell.*")
    return out.where(~missing(F.col(f"`{values_to}`"))) if drop_na else out


#: The most columns that a pivot or a transposition makes.
MAX_COLUMNS = 10_000


def _cell(op: str, x: Column, n: Column, order: Column | None, delimiter: str) -> Column:
    if op == "count":
        return F.count(F.lit(1))
    if op in ("first", "last"):
        if order is None:
            raise ValueError(f"{op} depends on the order of rows: say order_by")
        pick = F.min_by if op == "first" else F.max_by
        return pick(x, F.when(~missing(x), order))
    if op == "mode":
        return F.mode(F.when(~missing(x), x.cast("string")), True)
    if op in ("values", "unique_values", "nunique"):
        return S._text(op, x, order, delimiter)
    if op in S.QUANTILES:
        probs = S.QUANTILES[op]
        return S._of_quantiles(op, lambda p: S._quantiles(n, probs, None)[probs.index(p)])
    return S._numeric(op, n)


def wider(
    df: DataFrame,
    names_from: str,
    values_from: str | None = None,
    id_cols: str | None = None,
    op: str = "last",
    fill: object = None,
    names_sort: bool = False,
    order_by: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
    delimiter: str = "|",
) -> DataFrame:
    """One row for each combination of ``id_cols``, one column for each value of ``names_from``.

    Names are discovered by one aggregation (first seen first, by ``order_by``; sorted with ``names_sort``) unless
    ``names`` gives them, which saves that job. Cells without a row are ``fill``.
    """
    if op not in WIDER_OPS:
        raise ValueError(f"no operator named {op!r}")
    if values_from is None and op != "count":
        raise ValueError("only count works without values_from")
    name = resolve_fields(names_from, df.columns)[0]
    value = resolve_fields(values_from, df.columns)[0] if values_from else name
    ids = resolve_fields(id_cols, df.columns) if id_cols else [c for c in df.columns if c not in (name, value)]
    order = F.struct(*order_by) if order_by else None
    if names is None:
        seen = df.groupBy(plain(F.col(f"`{name}`")).alias("n")).agg((F.min(order) if order is not None and not names_sort else F.lit(0)).alias("o"))
        names = [r.n for r in seen.orderBy("o", "n").limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"{name} has more than {MAX_COLUMNS} values: too many columns")
    x = F.col(f"`{value}`")
    n = num(x, df.schema[value].dataType)
    cell = _cell(op, x, F.when(~F.isnan(n), n), order, delimiter)
    out = df.withColumn("__name", plain(F.col(f"`{name}`"))).groupBy(*(F.col(f"`{c}`") for c in ids)).pivot("__name", list(names))
    out = out.agg(cell)
    if fill is not None:
        made = [c for c in out.columns if c not in ids]
        out = out.select(*(F.col(f"`{c}`") for c in ids), *(F.coalesce(F.col(f"`{c}`"), F.lit(fill).cast(out.schema[c].dataType)).alias(c) for c in made))
    return out


def transpose(df: DataFrame, order_by: Sequence[str], header: bool = True) -> DataFrame:
    """Rows as columns: for each input column one row (``field``), for each input row one column (``r1``, ``r2``, ...).

    The result has as many columns as there are rows, so it is for small frames; cells stay on the executors.
    """
    from ..plans.order import Ordered

    numbered = Ordered(df, order_by).number("__row")
    n = numbered.agg(F.max("__row")).first()[0] or 0
    if n > MAX_COLUMNS:
        raise ValueError(f"{n} rows are too many columns: at most {MAX_COLUMNS}")
    cells = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("field"), plain(F.col(f"`{c}`")).alias("x")) for i, c in enumerate(df.columns)))
    tall = numbered.select("__row", F.explode(cells).alias("c")).select("__row", "c.*")
    out = tall.groupBy("pos", "field").pivot("__row", list(range(1, n + 1))).agg(F.first("x")).orderBy("pos")
    return out.select("field" if header else "pos", *(F.col(f"`{i}`").alias(f"r{i}") for i in range(1, n + 1)))
