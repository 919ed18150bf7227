"""Structure checks over raw lines, and tables of header names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def check(lines: DataFrame, delimiter: str = "\t", value: str = "value", order: str | None = "row") -> DataFrame:
    """One row: number of lines, the width of the first, and the first line (by ``order``) of another width, if any."""
    width = F.size(F.split(F.col(value), F.lit("\\Q" + delimiter + "\\E"), -1))
    sized = lines.select(F.col(order).alias("row") if order else F.monotonically_increasing_id().alias("row"), width.alias("width"))
    first = sized.agg(F.min_by("width", "row")).first()[0]
    bad = F.col("width") != F.lit(first)
    return sized.agg(
        F.count("*").alias("lines"),
        F.lit(first).cast("int").alias("fields"),
        F.min(F.when(bad, F.col("row"))).alias("bad_row"),
        F.min_by("width", F.when(bad, F.col("row"))).alias("bad_fields"),
    )


def header_table(spark: SparkSession, headers: dict[str, list[str]], start: int = 1) -> DataFrame:
    """One row a column of each file: number, name, whether it is duplicated there or differs from the first file's."""
    first = next(iter(headers.values()), [])
    rows = []
    for label, names in headers.items():
        for i, name in enumerate(names):
            rows.append((label, i + start, name, names.count(name) > 1, i >= len(first) or first[i] != name))
    return spark.createDataFrame(rows, "file string, field int, name string, duplicate boolean, diverging boolean")
