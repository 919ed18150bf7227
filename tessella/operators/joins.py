"""Keyed joins: semi, inner with appended fields, left with a fill value, anti; at most one match a row.

The lookup side is joined as Spark sees fit (broadcast while it is small by Spark's own threshold, else by sort and
shuffle), never forced. Keys compare NULL-safely: a missing key equals a missing key, as empty cells do in text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import FieldError, resolve_fields
from ..plans.skew import SKEW_BYTES, large, skew_join


def _lookup(right: DataFrame, keys: list[str], fields: list[str], order_by: Sequence[str] | None, last_wins: bool, mode: str) -> DataFrame:
    key_cols = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    values = F.struct(*(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(fields))) if fields else F.lit(True)
    rows = right.select(*key_cols, values.alias("__v"), *( [F.struct(*(F.col(f"`{c}`") for c in order_by)).alias("__o")] if order_by else []))
    names = [f"__k{i}" for i in range(len(keys))]
    if mode == "all":
        return rows.select(*names, "__v")
    if not fields:
        return rows.select(*names).distinct().withColumn("__v", F.lit(True))
    if last_wins:
        if not order_by:
            raise ValueError("the last of several rows of a key depends on their order: say order_by")
        return rows.groupBy(*names).agg(F.max_by("__v", "__o").alias("__v"))
    checked = rows.groupBy(*names).agg(F.min("__v").alias("__v"), F.max("__v").alias("__w"))
    message = F.concat(F.lit("join: several different rows of one key in the lookup: "), F.to_json(F.struct(*names)))
    return checked.select(*names, F.when(F.col("__v").eqNullSafe(F.col("__w")), F.col("__v")).otherwise(F.raise_error(message)).alias("__v"))


def join_rows(
    data: DataFrame,
    lookup: DataFrame,
    key: str = "0",
    data_key: str | None = None,
    append: str | None = None,
    fill: object = None,
    exclude: bool = False,
    last_wins: bool = False,
    prefix: str = "",
    order_by: Sequence[str] | None = None,
    mode: str = "one",
    skew: bool | None = None,
) -> DataFrame:
    """Rows of ``data`` with a match in ``lookup`` (without one: ``exclude``), with the lookup's ``append`` fields.

    ``key`` names fields of the lookup, ``data_key`` those of the data (the same, by name, if it isn't given); ``0`` is
    the whole row. With ``fill``, rows without a match stay and get that value. Several rows of one key in the lookup
    must agree on the appended fields, or ``last_wins`` (by ``order_by``). ``mode="all"`` keeps every match. With ``skew``,
    keys that very many rows of the data have are looked for first and joined without a task of their own; by default
    where the data is large and the lookup too large for a plain broadcast.
    """
    if exclude and (append or fill is not None):
        raise ValueError("exclude takes neither append nor fill")
    if fill is not None and not append:
        raise ValueError("fill needs append")
    right_keys = resolve_fields(key, lookup.columns, zero=True)
    left_keys = resolve_fields(data_key, data.columns, zero=True) if data_key is not None else right_keys
    if missing := [k for k in left_keys if k not in data.columns]:
        raise FieldError(f"no key columns {missing} in the data")
    if len(left_keys) != len(right_keys):
        raise FieldError("the two key lists differ in length")
    fields = resolve_fields(append, lookup.columns) if append else []
    names = [f"{prefix}{c}" for c in fields]
    if clash := set(names) & set(data.columns):
        raise FieldError(f"appended names are taken: {sorted(clash)}; say a prefix")
    side = _lookup(lookup, right_keys, fields, order_by, last_wins, mode)
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(left_keys)))
    how = "left_anti" if exclude else "left_semi" if not fields else "inner" if fill is None else "left"
    if skew is None:
        limit = int(data.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b"))
        skew = not (data.isStreaming or lookup.isStreaming) and large(data, SKEW_BYTES) and large(lookup, max(limit, 0))
    if skew:
        out = skew_join(data, side, [F.col(f"`{k}`") for k in left_keys], [F.col(f"__k{i}") for i in range(len(right_keys))], same, how, mode != "all")
    else:
        out = data.join(side, same, how)
    if not fields:
        return out
    value = lambda i, c: F.col(f"__v.v{i}") if fill is None else F.when(F.col("__v").isNull(), F.lit(fill).cast(lookup.schema[c].dataType)).otherwise(F.col(f"__v.v{i}"))
    return out.select(*(F.col(f"`{c}`") for c in data.columns), *(value(i, c).alias(n) for i, (c, n) in enumerate(zip(fields, names, strict=True))))
