"""Union, wide-to-long and long-to-wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_to_long(df: DataFrame, ids: list[str], columns: list[str], key: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, key, value)


def long_to_wide(df: DataFrame, ids: list[str], key: str, names: list[str], value: str) -> DataFrame:
    """One column per name; the names are given, so no pass over the data looks for them."""
    return df.groupBy(*ids).pivot(key, names).agg(F.first(value))


def with_overall_copy(df: DataFrame, column: str, label: str) -> DataFrame:
    """All rows, and all rows once more under one overall label."""
    return df.unionByName(df.withColumn(column, F.lit(label)))
