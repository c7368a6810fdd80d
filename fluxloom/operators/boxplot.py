"""Box-plot statistics: quartiles, whiskers at 1.5 IQR, and the points beyond them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.joins import join_null_safe
from fluxloom.operators.order_stats import ROWS_PER_BUCKET, exact_percentiles, spread_percentiles
from fluxloom.storage import store

REACH = 1.5


def _with_quartiles(df: DataFrame, keys: list[str], value: str, rows_per_bucket: int) -> DataFrame:
    names = {("y", 0.25): "lower", ("y", 0.5): "middle", ("y", 0.75): "upper"}
    found = exact_percentiles(df, keys, {"y": F.col(value)}, [p for _, p in names], rows_per_bucket)
    quartiles = store(spread_percentiles(found, keys, names), "quartiles")
    return join_null_safe(df.where(F.col(value).isNotNull()), quartiles, keys)


def _inside(value: str) -> Column:
    reach = REACH * (F.col("upper") - F.col("lower"))
    return F.col(value).between(F.col("lower") - reach, F.col("upper") + reach)


def boxplot_stats(
    df: DataFrame, keys: list[str], value: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """``ymin, lower, middle, upper, ymax, n, outliers`` per group."""
    inside = _inside(value)
    return (
        _with_quartiles(df, keys, value, rows_per_bucket)
        .groupBy(*keys, "lower", "middle", "upper")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("ymin"),
            F.max(F.when(inside, F.col(value))).alias("ymax"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(~inside).alias("outliers"),
        )
        .select(*keys, "ymin", "lower", "middle", "upper", "ymax", "n", "outliers")
    )


def boxplot_outliers(
    df: DataFrame, keys: list[str], value: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The rows beyond the whiskers, with all their columns."""
    beyond = _with_quartiles(df, keys, value, rows_per_bucket).where(~_inside(value))
    return beyond.drop("lower", "middle", "upper")
