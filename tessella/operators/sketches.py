"""Quantile sketches as columns: made once, kept, and merged over days, windows or groups.

A sketch is a few kilobytes whatever the number of rows, made and merged by Spark's own aggregates, on streams too. Of a
quantile's place the error is a share of the rows that is met with 99 % confidence: for ``error`` the sketch keeps
``size`` items, (2.296 / error) ** (1 / 0.9021), the published bound of this kind of sketch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import resolve_fields
from ..functions.numbers import num

ERROR = 0.01


def size(error: float) -> int:
    return min(65_535, max(8, math.ceil((2.296 / error) ** (1 / 0.9021))))


def sketch(x: Column, error: float = ERROR) -> Column:
    """An aggregate of numbers to a sketch; NULL and NaN are left out, and no numbers at all give NULL."""
    x = F.when(~F.isnan(x), x)
    return F.when(F.count(x) > 0, F.kll_sketch_agg_double(x, F.lit(size(error))))


def merged(x: Column, error: float = ERROR) -> Column:
    """An aggregate of sketches to one."""
    return F.when(F.count(x) > 0, F.kll_merge_agg_double(x, F.lit(size(error))))


def quantile(x: Column, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(x, F.lit(float(p)))


def quantile_sketches(df: DataFrame, group_by: str | None, field: str, name: str = "sketch", error: float = ERROR) -> DataFrame:
    """One row a group (or one in all): the sketch of a field's numbers."""
    keys = resolve_fields(group_by, df.columns) if group_by else []
    c = resolve_fields(field, df.columns)[0]
    return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(sketch(num(F.col(f"`{c}`"), df.schema[c].dataType), error).alias(name))


def merge_sketches(df: DataFrame, group_by: str | None, field: str = "sketch", error: float = ERROR) -> DataFrame:
    """The sketches of each coarser group as one."""
    keys = resolve_fields(group_by, df.columns) if group_by else []
    return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(merged(F.col(f"`{field}`"), error).alias(field))


def sketch_quantiles(df: DataFrame, field: str, probs: Sequence[float]) -> DataFrame:
    """With a column ``{field}_{p}`` for each quantile, in place of the sketch."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != field]
    return df.select(*kept, *(quantile(F.col(f"`{field}`"), p).alias(f"{field}_{p:g}") for p in probs))
