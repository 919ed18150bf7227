"""Grouped summary statistics.

Algebraic operators are one partial and one final hash aggregation. All exact quantiles of a column are one aggregate
over up to SMALL_VALUES rows; beyond that places are picked from range-partitioned value counts, so no group's values
meet. Lists use Spark's object aggregates; those over value counts (mode, mode_count) aggregate twice, so that a
group's distinct values never meet in one buffer. NaN and NULL play no part in numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import resolve_fields
from ..functions.numbers import missing, num, plain
from ..plans.order import exact_quantiles

#: Rows whose exact quantiles may be aggregated in buffers (a buffer holds a group's distinct values).
SMALL_VALUES = 2_000_000
#: Probabilities of the quantiles that operators take.
QUANTILES = {"median": [0.5], "q1": [0.25], "q3": [0.75], "iqr": [0.25, 0.75]}
#: Scale of the median absolute deviation (for a normal distribution).
MAD_SCALE = 1.4826
NUMERIC = ("sum", "min", "max", "range", "mean", "geomean", "harmmean", "variance", "stdev", "cv", "median", "q1", "q3", "iqr", "mad", "quantile")
TEXT = ("first", "last", "nunique", "mode", "mode_count", "unique_values", "values", "rand", "missing_count", "not_missing_count")
ALIASES = {"var": "variance", "retain": "first", "unique_count": "nunique", "unique": "unique_values", "collapse": "values"}


def _quantiles(x: Column, p: list[float], accuracy: int | None) -> Column:
    at = F.array(*map(F.lit, p))
    return F.percentile_approx(x, at, F.lit(accuracy)) if accuracy else F.percentile(x, at)


def _of_quantiles(op: str, q: Callable[[float], Column]) -> Column:
    low, *high = QUANTILES[op]
    return q(high[0]) - q(low) if high else q(low)


def _numeric(op: str, x: Column) -> Column:
    if op == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if op == "geomean":
        return F.exp(F.avg(F.when(x > 0, F.ln(F.when(x > 0, x)))))
    if op == "harmmean":
        other = F.when(x != 0, x)
        return F.count(other) / F.sum(1 / other)
    if op == "cv":
        mean = F.avg(x)
        return F.try_divide(F.stddev_samp(x), F.when(mean != 0, mean))
    return {
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "range": lambda: F.max(x) - F.min(x),
        "mean": lambda: F.avg(x),
        "variance": lambda: F.var_samp(x),
        "stdev": lambda: F.stddev_samp(x),
    }[op]()


def _ordered(op: str, x: Column, order: Column | None, delimiter: str) -> Column:
    if order is None:
        raise ValueError(f"{op} depends on the order of rows: say order_by")
    if op == "first":
        return F.min_by(x, F.when(~missing(x), order))
    if op == "last":
        return F.max_by(x, order)
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), plain(x).alias("x"))))
    return F.array_join(F.transform(pairs, lambda s: s["x"]), delimiter)


def _text(op: str, x: Column, order: Column | None, delimiter: str) -> Column:
    if op in ("first", "last", "values"):
        return _ordered(op, x, order, delimiter)
    return {
        "nunique": lambda: F.count_distinct(plain(x)),
        "unique_values": lambda: F.array_join(F.array_sort(F.collect_set(plain(x))), delimiter),
        "rand": lambda: F.max_by(x, "__rand"),
        "missing_count": lambda: F.count_if(missing(x)),
        "not_missing_count": lambda: F.count_if(~missing(x)),
    }[op]()


def _specs(ops: dict, columns: Sequence[str], custom: set[str]) -> list[tuple[str, str, str, list[float]]]:
    """(operator, column, name of the result, probabilities), in the order given."""
    out = []
    for op, spec in ops.items():
        op = ALIASES.get(op, op)
        if op not in NUMERIC + TEXT and op not in custom:
            raise ValueError(f"no operator named {op!r}")
        for one in spec if isinstance(spec, list) else [spec]:
            fields, _, tail = one.partition(":")
            probs: list[float] = []
            if op == "quantile":
                text, _, tail = tail.partition(":")
                probs = [float(p) for p in text.split(",")]
                if any(not 0 <= p <= 1 for p in probs):
                    raise ValueError(f"probabilities are from 0 to 1: {one!r}")
            names = resolve_fields(fields, columns)
            if tail and (len(names) > 1 or len(probs) > 1):
                raise ValueError(f"a header of one's own needs a single field: {one!r}")
            for c in names:
                for p in probs or [None]:
                    name = tail or (f"{c}_quantile_{p:g}" if p is not None else f"{c}_{op}")
                    out.append((op, c, name, [p] if p is not None else []))
    return out


def stats(
    df: DataFrame,
    group_by: str | None = None,
    count: bool | str = False,
    order_by: Sequence[str] | None = None,
    replace_missing: float | None = None,
    exclude_missing: bool = False,
    values_delimiter: str = "|",
    accuracy: int | None = None,
    seed: int = 0,
    custom: dict[str, Callable[[Column], Column]] | None = None,
    small: int = SMALL_VALUES,
    **ops,
) -> DataFrame:
    """One row a group (one row in all, also for an empty frame, without ``group_by``).

    Operators are keywords with field lists: ``sum="a,b"``, ``mean="x:average"``, ``quantile="x:0.1,0.9"``. ``count``
    is True, or the name of its column. A missing number is skipped, or counts as ``replace_missing``.
    ``custom`` adds operators: functions from a number's Column to an aggregate, called by their names like the others.
    ``accuracy`` takes approximate quantiles instead of exact ones, which are one aggregate a column over up to ``small``
    rows and picked from sorted value counts beyond that. ``order_by`` names the columns that order rows,
    for first, last and values.
    """
    if replace_missing is not None and exclude_missing:
        raise ValueError("replace_missing and exclude_missing exclude each other")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = resolve_fields(group_by, df.columns) if group_by else []
    custom = custom or {}
    specs = _specs(ops, df.columns, set(custom))
    order = F.struct(*order_by) if order_by else None

    def number(c: str) -> Column:
        x = num(F.col(f"`{c}`"), kinds[c])
        x = F.when(~F.isnan(x), x)
        return F.when(missing(F.col(f"`{c}`")), F.lit(float(replace_missing))).otherwise(x) if replace_missing is not None else x

    work = df.withColumns({f"__n_{c}": number(c) for op, c, *_ in specs if op in NUMERIC or op in custom}) if specs else df
    if any(op == "rand" for op, *_ in specs):
        work = work.withColumn("__rand", F.rand(seed))
    asked: dict[str, list[float]] = {}
    for op, c, _, probs in specs:
        if op in QUANTILES or probs:
            asked[c] = sorted({*asked.get(c, []), *QUANTILES.get(op, probs)})
    spread = accuracy is None and (bool(asked) or any(op == "mad" for op, *_ in specs)) and work.count() > small
    aggs: list[Column] = []
    later: list[tuple[str, str, str, list[float]]] = []
    if count:
        aggs.append(F.count("*").alias(count if isinstance(count, str) else "count"))
    for op, c, name, probs in specs:
        x = F.col(f"`{c}`")
        if op in custom:
            aggs.append(custom[op](F.col(f"`__n_{c}`")).alias(name))
        elif op in ("mad", "mode", "mode_count") or spread and (op in QUANTILES or probs):
            later.append((op, c, name, probs))
        elif op in QUANTILES or probs:
            at = lambda p, c=c: _quantiles(F.col(f"`__n_{c}`"), asked[c], accuracy)[asked[c].index(p)]
            aggs.append((at(probs[0]) if probs else _of_quantiles(op, at)).alias(name))
        elif op in NUMERIC:
            aggs.append(_numeric(op, F.col(f"`__n_{c}`")).alias(name))
        else:
            aggs.append(_text(op, F.when(~missing(x), x) if exclude_missing and op != "missing_count" else x, order, values_delimiter).alias(name))
    grouped = work.groupBy(*(F.col(f"`{k}`") for k in keys))
    out = grouped.agg(*aggs) if aggs else grouped.agg(F.count("*").alias("__rows")).drop("__rows")

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        if not keys:
            return left.crossJoin(right)  # one row and one row
        renamed = right.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`") for c in right.columns if c not in keys))
        same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
        return left.join(renamed, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))

    columns = [F.col(f"`{k}`") for k in keys]
    def middle(rows: DataFrame, x: Column, name: str) -> DataFrame:
        if spread:
            return exact_quantiles(rows, keys, x, [0.5], "__m").select(*columns, F.col("__m")[0].alias(name))
        return rows.groupBy(*columns).agg(_quantiles(x, [0.5], accuracy)[0].alias(name))

    for c in dict.fromkeys(c for op, c, *_ in later if op == "mad"):
        x = F.col(f"`__n_{c}`")
        apart = middle(attach(work, middle(work, x, "__centre")), F.abs(x - F.col("__centre")), "__mad")
        for name in [n for op, c2, n, _ in later if op == "mad" and c2 == c]:
            out = attach(out, apart.select(*columns, (F.col("__mad") * MAD_SCALE).alias(name)))
    for c in asked if spread else ():
        picked = exact_quantiles(work, keys, F.col(f"`__n_{c}`"), asked[c], "__q")
        at = lambda p, c=c: F.col("__q")[asked[c].index(p)]
        named = [(at(probs[0]) if probs else _of_quantiles(op, at)).alias(name) for op, c2, name, probs in later if c2 == c and (op in QUANTILES or probs)]
        out = attach(out, picked.select(*columns, *named))
    for c in dict.fromkeys(c for op, c, *_ in later if op in ("mode", "mode_count")):
        x = plain(F.col(f"`{c}`"))
        counted = work.groupBy(*columns, x.alias("__x")).agg(F.count("*").alias("__c"))
        best = counted.groupBy(*columns).agg(F.min(F.struct((-F.col("__c")).alias("c"), F.col("__x").alias("x"))).alias("__best"))
        for op, _, name, _ in [s for s in later if s[0] in ("mode", "mode_count") and s[1] == c]:
            value = F.col("__best.x") if op == "mode" else -F.col("__best.c")
            out = attach(out, best.select(*columns, value.alias(name)))
    ordered = [k for k in keys] + ([count if isinstance(count, str) else "count"] if count else []) + [n for *_, n, _ in specs]
    return out.select(*(F.col(f"`{c}`") for c in ordered))
