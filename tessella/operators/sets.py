"""Set operations over frames with the same columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_rows


def append(frames: Sequence[DataFrame] | dict[str, DataFrame], source: str | None = None, strict: bool = True) -> DataFrame:
    """All rows of all frames, by position; with ``source``, labels (the dict's keys, or numbers) come first.

    Frames of different width or names are refused unless ``strict`` is off; then the first frame's names hold.
    """
    items = list(frames.items()) if isinstance(frames, dict) else [(str(i), f) for i, f in enumerate(frames, 1)]
    names = items[0][1].columns
    for label, f in items[1:]:
        if len(f.columns) != len(names) or strict and f.columns != names:
            raise ValueError(f"frame {label} has other columns than the first")
    parts = [f.toDF(*names) if source is None else f.toDF(*names).select(F.lit(label).alias(source), "*") for label, f in items]
    return reduce(DataFrame.union, parts)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return append(frames).distinct()


def intersect_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left``, repetitions included, that ``right`` has too."""
    return join_rows(left, right, "0")


def except_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left``, repetitions included, that ``right`` doesn't have."""
    return join_rows(left, right, "0", exclude=True)
