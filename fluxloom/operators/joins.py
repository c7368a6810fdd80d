"""Equi joins by site and day, and the anti join against a stored split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.labels import land_cover_group

DAY_KEY = ["site", "DATE"]


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", where: Column | None = None
) -> DataFrame:
    """Join on ``keys`` where a null key matches a null key; the left key columns are kept."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    condition = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys])
    if where is not None:
        condition = condition & where
    return left.join(renamed, condition, how).drop(*[f"_right_{key}" for key in keys])


def join_satellite(daily: DataFrame, *products: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Left join satellite products onto the daily table.

    All joins share one key, so the daily table is shuffled once and keeps its
    partitioning through every join. A product that has two rows for a day yields
    two rows, as a left join does.
    """
    keys = keys or DAY_KEY
    return reduce(lambda left, product: left.join(product, keys, "left"), products, daily)


def add_land_cover(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join the site table and label each row with its land-cover group.

    A site the metadata does not list has no class and keeps a null group.
    """
    return df.join(metadata, "site", "left").withColumn("IGBP2", land_cover_group(F.col("IGBP")))


def outside_split(df: DataFrame, membership: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key the saved membership does not list under ``part``."""
    return df.join(membership.where(F.col("split") == part).select(*keys), keys, "left_anti")
