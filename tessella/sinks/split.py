"""Rows split into files: by number of rows in order, at random, or by key. Each file is a ``part=N`` folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import resolve_fields
from ..operators.sampling import STATIC_SEED
from ..plans.order import Ordered


def _write(df: DataFrame, path: str, delimiter: str, header: bool, mode: str) -> None:
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns if c != "part"]
    df.select("part", *cells).write.mode(mode).partitionBy("part").csv(path, sep=delimiter, header=header, quote="", escape="", emptyValue="", nullValue="")


def split_lines(df: DataFrame, path: str, rows: int, order_by: Sequence[str], header: bool = True, delimiter: str = "\t", mode: str = "errorifexists") -> None:
    """Files of so many rows each, in order."""
    if rows < 1:
        raise ValueError("rows is 1 at least")
    numbered = Ordered(df, order_by).number("__n", 0).withColumn("part", F.floor(F.col("__n") / rows))
    ranged = numbered.repartitionByRange("__n").sortWithinPartitions("__n").drop("__n")
    _write(ranged, path, delimiter, header, mode)


def split_random(df: DataFrame, path: str, files: int, seed: int = STATIC_SEED, header: bool = True, delimiter: str = "\t", mode: str = "errorifexists") -> None:
    _write(df.withColumn("part", F.floor(F.rand(seed) * files)), path, delimiter, header, mode)


def split_by_key(df: DataFrame, path: str, files: int, key: str, header: bool = True, delimiter: str = "\t", mode: str = "errorifexists") -> None:
    """Rows of one key go to one file."""
    names = resolve_fields(key, df.columns, zero=True)
    _write(df.withColumn("part", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in names)), F.lit(files))), path, delimiter, header, mode)
