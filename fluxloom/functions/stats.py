"""Aggregates that compare a model with observations; pairs with a null are skipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rmse(observed: Column, modelled: Column) -> Column:
    gap = observed - modelled
    return F.sqrt(F.avg(gap * gap))


def mean_bias(modelled: Column, observed: Column) -> Column:
    return F.avg(modelled - observed)


def stddev_ratio(modelled: Column, observed: Column) -> Column:
    return F.try_divide(F.stddev_samp(modelled), F.stddev_samp(observed))


def r_squared(x: Column, y: Column) -> Column:
    r = F.corr(x, y)
    return r * r


def root_mean_square(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def t_statistic(r: Column, n: Column) -> Column:
    """Test statistic of a Pearson correlation."""
    return r * F.sqrt(F.try_divide(n - 2, 1 - r * r))


def two_sided_p(t: Column, dof: Column) -> Column:
    """P(|T| > t) of Student's t for a whole number of degrees of freedom.

    The probability inside (-t, t) is a finite trigonometric series in
    theta = atan(t / sqrt(dof)). It has dof/2 terms, so this suits a table of
    models (a handful of points), not a table of observations.
    """
    theta = F.atan(F.abs(t) / F.sqrt(dof))
    sine, cosine = F.sin(theta), F.cos(theta)
    odd = dof % 2 == 1
    terms = F.floor((dof - F.when(odd, 1).otherwise(0)) / 2).cast("int") - 1
    steps = F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def grow(state: Column, k: Column) -> Column:
        factor = F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        term = state["term"] * factor * cosine * cosine
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(steps, first, grow, lambda state: state["total"])
    inside_odd = F.when(dof == 1, theta).otherwise(theta + sine * cosine * series) * 2 / F.pi()
    return F.when(dof >= 1, 1 - F.when(odd, inside_odd).otherwise(sine * series))
