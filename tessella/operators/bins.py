"""Binning, two-dimensional histograms, box-plot statistics and least-squares lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import resolve_fields
from ..functions.numbers import num
from ..plans.order import exact_quantiles
from .stats import stats


def bin_values(df: DataFrame, field: str, width: float, minimum: float = 0.0, new_name: str | None = None) -> DataFrame:
    """floor((v - minimum) / width) * width + minimum, in place (other cells pass through) or as a new column (missing)."""
    if width <= 0:
        raise ValueError("width is over 0")
    c = resolve_fields(field, df.columns)[0]
    kind = df.schema[c].dataType
    v = num(F.col(f"`{c}`"), kind)
    binned = F.floor((v - minimum) / width) * F.lit(float(width)) + minimum
    if new_name:
        return df.withColumn(new_name, binned)
    same = F.col(f"`{c}`").cast("double") if kind.simpleString() != "string" else F.col(f"`{c}`")
    return df.withColumn(c, F.coalesce(binned if kind.simpleString() != "string" else binned.cast("string"), same))


def bin_count(n: int, low: float, high: float, iqr: float, strategy: str) -> int:
    """Number of bins by rule: sqrt, sturges or fd (Freedman-Diaconis)."""
    if n <= 1 or high <= low:
        return 1
    if strategy == "sqrt":
        return math.ceil(math.sqrt(n))
    if strategy == "fd" and iqr > 0:
        return max(1, math.ceil((high - low) / (2 * iqr / n ** (1 / 3))))
    return math.ceil(math.log2(n)) + 1


def bin2d(df: DataFrame, x: str, y: str, bins: tuple[int, int] | int | None = 10, binwidth: tuple[float, float] | float | None = None, strategy: str | None = None) -> DataFrame:
    """(x_bin, y_bin, count) of cells that hold points; the last bin of an axis is closed.

    One aggregation finds the bounds, one counts: floor and least, both in generated code.
    """
    names = [resolve_fields(f, df.columns)[0] for f in (x, y)]
    points = df.select(*(num(F.col(f"`{c}`"), df.schema[c].dataType).alias(a) for c, a in zip(names, "xy", strict=True)))
    points = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    aggs = [f(a) for a in "xy" for f in (F.min, F.max)]
    got = points.agg(F.count("*"), *aggs).first()
    quartiles = [exact_quantiles(points, [], F.col(a), [0.25, 0.75], "q").first() for a in "xy"] if strategy == "fd" and got[0] else [None, None]
    out = points
    for k, a in enumerate("xy"):
        low, high = got[1 + 2 * k], got[2 + 2 * k]
        if low is None:
            low = high = 0.0
        if binwidth is not None:
            w = binwidth[k] if isinstance(binwidth, tuple) else binwidth
            n = max(1, math.ceil((high - low) / w))
        else:
            n = (bins[k] if isinstance(bins, tuple) else bins) or 10
            if strategy:
                q = quartiles[k]
                n = bin_count(got[0], low, high, q.q[1] - q.q[0] if q else 0.0, strategy)
            w = (high - low) / n or 1.0
        out = out.withColumn(f"{a}_bin", F.least(F.floor((F.col(a) - low) / w), F.lit(n - 1)).cast("int"))
    return out.groupBy("x_bin", "y_bin").agg(F.count("*").alias("count"))


def _boxes(df: DataFrame, field: str, by: str | None) -> tuple[list[str], DataFrame]:
    """(grouping columns, every number with its group's statistics and whether it is inside the whiskers)."""
    c = resolve_fields(field, df.columns)[0]
    keys = resolve_fields(by, df.columns) if by else []
    v = num(F.col(f"`{c}`"), df.schema[c].dataType)
    rows = df.select(*(F.col(f"`{k}`") for k in keys), v.alias("__v")).where("__v is not null and not isnan(__v)")
    centre = stats(rows, f"1-{len(keys)}" if keys else None, count="n", **{op: f"{len(keys) + 1}:{op}" for op in ("min", "max", "q1", "median", "q3")})
    named = centre.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), "n", "min", "max", "q1", "median", "q3")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(named, same) if keys else rows.crossJoin(named)  # one row of statistics
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return keys, joined.withColumn("__inside", F.col("__v").between(F.col("q1") - reach, F.col("q3") + reach))


def box_stats(df: DataFrame, field: str, by: str | None = None, outliers: bool = True) -> DataFrame:
    """Quartiles, whiskers (the extreme values within 1.5 interquartile ranges) and outliers, by group if asked.

    ``outliers`` lists a group's outliers in one cell; ``box_outliers`` gives them as rows, for groups that have many.
    """
    keys, joined = _boxes(df, field, by)
    inside = F.col("__inside")
    aggs = [F.first(x).alias(x) for x in ("n", "min", "q1", "median", "q3", "max")]
    aggs += [F.min(F.when(inside, F.col("__v"))).alias("low"), F.max(F.when(inside, F.col("__v"))).alias("high"), F.count_if(~inside).alias("n_outliers")]
    if outliers:
        aggs.append(F.array_sort(F.collect_list(F.when(~inside, F.col("__v")))).alias("outliers"))
    return joined.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*aggs)


def box_outliers(df: DataFrame, field: str, by: str | None = None) -> DataFrame:
    """(groups, outlier): every value outside its group's whiskers, a row each."""
    keys, joined = _boxes(df, field, by)
    return joined.where("not __inside").select(*(F.col(f"`{k}`") for k in keys), F.col("__v").alias("outlier"))


def regression(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """slope, intercept and r2 of the least-squares line, by group if asked."""
    cx, cy = (resolve_fields(f, df.columns)[0] for f in (x, y))
    keys = resolve_fields(by, df.columns) if by else []
    rows = df.select(*(F.col(f"`{k}`") for k in keys), *(num(F.col(f"`{c}`"), df.schema[c].dataType).alias(a) for c, a in ((cx, "__x"), (cy, "__y"))))
    rows = rows.where("not isnan(__x) and not isnan(__y)")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept"), F.regr_r2("__y", "__x").alias("r2"))
