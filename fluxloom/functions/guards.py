"""Null- and infinity-aware arithmetic under ANSI mode.

The conditional helpers mention their argument more than once. Give them a plain
column: a deep expression nested in several of them would be repeated many times in
the generated code. Callers therefore compute the value in one projection and guard
it in the next, which Spark keeps apart exactly when merging would repeat work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def nan_to_null(value: Column) -> Column:
    """NaN sorts above every number in Spark, so it is a missing value here."""
    return F.nanvl(value, F.lit(None).cast("double"))


def ieee_div(top: Column, bottom: Column) -> Column:
    """Division that gives a signed infinity at a zero divisor and null for 0/0."""
    at_zero = F.when(top > 0, F.lit(INFINITY)).when(top < 0, F.lit(-INFINITY))
    return F.when(bottom == 0, at_zero).otherwise(F.try_divide(top, bottom))


def at_least(value: Column, low) -> Column:
    """Lower clamp; null stays null (``greatest`` would return the bound)."""
    return F.when(value < low, F.lit(low)).otherwise(value)


def at_most(value: Column, high) -> Column:
    """Upper clamp; null stays null."""
    return F.when(value > high, F.lit(high)).otherwise(value)


def clamp(value: Column, low, high) -> Column:
    """Two-sided clamp; null stays null."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)
