"""Rows by key: first, n-th or first m of each, with numbers within a key and identifiers of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import resolve_fields
from ..functions.numbers import ascii_lower, plain
from ..plans.order import LOC, PID, SMALL_ROWS, Ordered, materialized


def uniq(
    df: DataFrame,
    key: str = "0",
    order_by: Sequence[str] | None = None,
    ignore_case: bool = False,
    repeated: bool = False,
    at_least: int = 1,
    maximum: int = 0,
    equiv: str | None = None,
    equiv_start: int = 1,
    number: str | None = None,
    small: int = SMALL_ROWS,
) -> DataFrame:
    """The first row of each key (``0``: of each distinct row).

    ``repeated`` gives the second row of each key that has one, ``at_least`` the n-th, ``maximum`` rows up to that
    place. ``number`` and ``equiv`` name columns for a row's place within its key and for the key's identifier, in
    order of first rows; with either and without ``maximum`` all rows come (with ``at_least``, but the first).
    """
    names = resolve_fields(key, df.columns, zero=True)
    if repeated:
        at_least = max(2, at_least)
    tagged = bool(equiv or number)
    if order_by is None and not ignore_case and not tagged and at_least == 1 and maximum == 0:
        return df.dropDuplicates(names)
    if order_by is None:
        raise ValueError("which row of a key comes first depends on the order of rows: say order_by")
    shown = [ascii_lower(plain(F.col(f"`{c}`"))) if ignore_case else F.col(f"`{c}`") for c in names]
    parts = [c.alias(f"__k{i}") for i, c in enumerate(shown)]
    work = df.select("*", *parts)
    keys = [f"__k{i}" for i in range(len(parts))]
    if maximum:
        wanted = F.col("__rn").between(at_least, max(maximum, at_least))
    elif tagged:
        wanted = (F.col("__rn") > 1) | F.lit(at_least <= 1)
    else:
        wanted = F.col("__rn") == at_least
    first_id = max(equiv_start, 1) if equiv_start < 0 else equiv_start
    keyed = Ordered(work, [*keys, *order_by], small) if tagged else None
    if keyed is None or not keyed.distributed:
        # where the place is bounded, every task passes on no more rows of a key than that
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)).cast("long")
        work = work.withColumn("__rn", place)
        if equiv:
            firsts = work.where("__rn = 1").select(*keys, *(F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order_by)))
            ids = Ordered(firsts, [f"__o{i}" for i in range(len(order_by))], small).number(equiv, first_id)
            ids = ids.select(*(F.col(k).alias(f"_{k}") for k in keys), equiv)
            same = F.lit(True)
            for k in keys:
                same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
            work = work.join(ids, same)
    else:
        # rows are in order of (key, order): a key's rows may fill many tasks, and its identifier goes down from its first row
        work = keyed.places(keys, "__rn")
        if equiv:
            work = materialized(work)
            firsts = work.where("__rn = 1").select(F.col(PID).alias("__p"), F.col(LOC).alias("__l"), *(F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order_by)))
            ids = Ordered(firsts, [f"__o{i}" for i in range(len(order_by))], small).number("__id", first_id).select("__p", "__l", "__id")
            keyed.df = work.join(ids, (F.col(PID) == F.col("__p")) & (F.col(LOC) == F.col("__l")), "left").drop("__p", "__l")
            work = keyed.last_present({equiv: F.col("__id")})
    if number:
        work = work.withColumn(number, F.col("__rn"))
    extra = [c for c in (equiv, number) if c]
    return work.where(wanted).select(*(F.col(f"`{c}`") for c in df.columns), *extra)
