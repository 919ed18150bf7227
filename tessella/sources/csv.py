"""RFC-4180 CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, paths, header: bool = True, delimiter: str = ",", quote: str = '"', tab_replacement: str = " ", newline_replacement: str = " ") -> DataFrame:
    """Text columns; tabs and each line break within a field are replaced. Malformed input fails."""
    if len(delimiter) != 1 or len(quote) != 1:
        raise ValueError("delimiter and quote are single characters")
    df = spark.read.csv(paths, sep=delimiter, quote=quote, escape=quote, header=header, multiLine=True, mode="FAILFAST", enforceSchema=False, nullValue="\u0000", emptyValue="")
    df = df.toDF(*(c.removeprefix("﻿") for c in df.columns)) if header else df.toDF(*(f"field{i + 1}" for i in range(len(df.columns))))
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), "\t", tab_replacement), "[\r\n]", newline_replacement)
    return df.select(*(clean(c).alias(c) for c in df.columns))
