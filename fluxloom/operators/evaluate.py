"""Model evaluation tables.

All of them are partially aggregated in one pass over the scored rows. What is
exploded per row is a fixed list (models or extremes), never pairs of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.functions import stats
from fluxloom.functions.hybrid import BY_CODE, MODELS, PURE, FluxModel
from fluxloom.functions.labels import group_with_count
from fluxloom.operators.joins import join_null_safe
from fluxloom.operators.order_stats import ROWS_PER_BUCKET, exact_percentiles, spread_percentiles
from fluxloom.operators.reshape import long_to_wide, wide_to_long, with_overall_copy
from fluxloom.storage import store

OBSERVED = "LE_CORR"


def rows_per_site(df: DataFrame) -> DataFrame:
    return df.groupBy("site").agg(F.count(F.lit(1)).alias("n"))


def head_rows(df: DataFrame, order: list[str], n: int = 6) -> DataFrame:
    """First rows in a stated order."""
    return df.orderBy(*order).limit(n)


def by_model(df: DataFrame) -> DataFrame:
    """One row per scored row and model: observation, estimate, parameter, learnt parameter, sensitivity."""
    entries = [
        F.struct(
            F.lit(m.name).alias("models"),
            F.col(m.estimate).alias("estimate"),
            F.col(m.target).alias("theta"),
            F.col(m.learned).alias("theta_hat"),
            m.slope(F.col(m.learned)).alias("sensitivity"),
        )
        for m in MODELS
    ]
    return df.select(F.col(OBSERVED).alias("observed"), F.inline(F.array(*entries)))


def sensitivity_index(consistent: bool = False) -> Column:
    """Spread of the learnt parameter times its typical effect on the flux.

    The two humidity-form models use the absolute mean effect, all others its root
    mean square; ``consistent`` uses the root mean square everywhere.
    """
    effect = stats.root_mean_square(F.col("sensitivity"))
    if not consistent:
        mean_abs = [m.name for m in MODELS if m.mean_abs_sensitivity]
        effect = F.when(F.col("models").isin(mean_abs), F.abs(F.avg("sensitivity"))).otherwise(effect)
    return F.stddev_samp("theta_hat") * effect


def scorecard(df: DataFrame, consistent: bool = False) -> DataFrame:
    """Seven models with sensitivity index, spread ratio, bias, error and parameter R2."""
    observed, estimate = F.col("observed"), F.col("estimate")
    return by_model(df).groupBy("models").agg(
        sensitivity_index(consistent).alias("partial_stdev"),
        stats.stddev_ratio(estimate, observed).alias("stdev_ratio"),
        stats.mean_bias(estimate, observed).alias("mean_bias"),
        stats.rmse(observed, estimate).alias("rmse"),
        stats.r_squared(F.col("theta"), F.col("theta_hat")).alias("parameter_R2"),
    )


def _excess_error(model: FluxModel) -> Column:
    observed = F.col(OBSERVED)
    return stats.rmse(observed, F.col(model.estimate)) - stats.rmse(observed, F.col(PURE.estimate))


def excess_errors() -> list[Column]:
    """Error of each hybrid minus that of the pure model, as columns H1 to H6."""
    return [_excess_error(model).alias(code) for code, model in BY_CODE.items()]


def rmse_difference_rollup(df: DataFrame) -> DataFrame:
    """H1 to H6 overall, per land-cover group and per group and site, in one aggregation.

    ``grain`` is 0 for a site, 1 for a group and 3 for everything.
    """
    return df.rollup("IGBP2", "site").agg(F.grouping_id().alias("grain"), *excess_errors())


def site_differences(rollup: DataFrame, overall_label: str = "All") -> DataFrame:
    """Per-site differences in long form, once under their group and once under all."""
    sites = rollup.where(F.col("grain") == 0)
    long = wide_to_long(sites, ["IGBP2", "site"], list(BY_CODE), "model", "rmse")
    return with_overall_copy(long, "IGBP2", overall_label)


def group_differences(rollup: DataFrame, overall_label: str = "All") -> DataFrame:
    """Differences of each land-cover group, and of everything, in long form."""
    groups = rollup.where(F.col("grain") > 0).withColumn(
        "IGBP2", F.when(F.col("grain") == 3, overall_label).otherwise(F.col("IGBP2")))
    return wide_to_long(groups, ["IGBP2"], list(BY_CODE), "model", "rmse")


def extreme_points(extremes: DataFrame) -> DataFrame:
    """The table of extremes in long form: ``extreme, model, rmse``."""
    return wide_to_long(extremes, ["model"], list(S.EXTREME_NAMES), "extreme", "rmse")


def group_site_counts(df: DataFrame) -> DataFrame:
    """Land-cover groups labelled with how many sites they have."""
    sites = df.select("IGBP2", "site").distinct().groupBy("IGBP2").agg(F.count(F.lit(1)).alias("sites"))
    return sites.withColumn("label", group_with_count(F.col("IGBP2"), F.col("sites")))


def extreme_thresholds_at(
    df: DataFrame, levels: Sequence[float], rows_per_bucket: int = ROWS_PER_BUCKET
) -> dict[float, DataFrame]:
    """Per-site low and high percentile of every climate variable, one stored table per level, from one search."""
    values = {name: F.col(column) for name, column in S.EXTREME_VARIABLES.items()}
    probabilities = [p for level in levels for p in (level, 1 - level)]
    found = store(exact_percentiles(df, ["site"], values, probabilities, rows_per_bucket), "site_percentiles")
    tables = {}
    for level in levels:
        names = {(name, p): f"{name}_{side}" for name in values for p, side in ((level, "03"), (1 - level, "97"))}
        tables[level] = store(spread_percentiles(found, ["site"], names), "thresholds")
    return tables


def extreme_thresholds(df: DataFrame, level: float = 0.03, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The table of one level."""
    return extreme_thresholds_at(df, [level], rows_per_bucket)[level]


def with_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Left join thresholds by site; a measured small table is broadcast by the planner."""
    return join_null_safe(df, thresholds, ["site"], "left")


def _extreme_tests() -> list[Column]:
    tests = []
    for name, column in S.EXTREME_VARIABLES.items():
        value = F.col(column)
        tests.append((f"{name}_03", value < F.col(f"{name}_03")))
        tests.append((f"{name}_97", value > F.col(f"{name}_97")))
    return [F.when(test, F.lit(name)) for name, test in tests]


def extreme_errors(df: DataFrame, thresholds: DataFrame, exclude_sites: Sequence[str] = ()) -> DataFrame:
    """H1 to H6 under each climate extreme: one row per model, one column per extreme.

    A row counts for every extreme it belongs to; sixteen filters become one
    exploded list and one aggregation.
    """
    kept = df.where(~F.col("site").isin(*exclude_sites)) if exclude_sites else df
    estimates = [m.estimate for m in MODELS]
    met = F.array_compact(F.array(*_extreme_tests()))
    long = with_thresholds(kept, thresholds).select(OBSERVED, *estimates, F.explode(met).alias("extreme"))
    errors = long.groupBy("extreme").agg(*excess_errors())
    melted = wide_to_long(errors, ["extreme"], list(BY_CODE), "model", "rmse")
    return long_to_wide(melted, ["model"], "extreme", S.EXTREME_NAMES, "rmse")


def rmse_by_model(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Error of the seven models in wide form."""
    return df.groupBy(*by).agg(*[stats.rmse(F.col(OBSERVED), F.col(m.estimate)).alias(m.short) for m in MODELS])


def correlation_test(
    df: DataFrame,
    x: str,
    y: str,
    drop_models: Sequence[str] = (),
    x_range: tuple[float, float] | None = None,
    y_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Pearson correlation and p-value between two columns of a model table.

    Points outside a given range do not enter, as points outside plot limits do not.
    """
    inside = [F.col(c).between(*limits) for c, limits in ((x, x_range), (y, y_range)) if limits]
    if drop_models:
        inside.append(~F.col("models").isin(*drop_models))
    kept = df.where(reduce(lambda a, b: a & b, inside)) if inside else df
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    found = kept.where(both).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    tested = found.withColumn("t", stats.t_statistic(F.col("r"), F.col("n")))
    return tested.withColumn("p", stats.two_sided_p(F.col("t"), F.col("n") - 2))


def improvement_table(by_trees: DataFrame, by_mtry: DataFrame, default_mtry: int = 3) -> DataFrame:
    """Error change from (a) more trees, (b) a tuned mtry, (c) the hybrid model.

    ``by_trees`` has ``ntree`` and one error column per model, ``by_mtry`` has
    ``mtry`` and ``rmse``. Both are result tables of a few rows.
    """

    def at_trees(column: str, trees: int) -> Column:
        return F.max(F.when(F.col("ntree") == trees, F.col(column)))

    trees = by_trees.agg(F.min("ntree").alias("few"), F.max("ntree").alias("many")).first()
    grown = by_trees.agg(
        (at_trees("Pure_ML", trees["many"]) - at_trees("Pure_ML", trees["few"])).alias("a"),
        (at_trees("H_PMRH_Frh", trees["few"]) - at_trees("Pure_ML", trees["few"])).alias("c"),
    )
    default = F.max(F.when(F.col("mtry") == default_mtry, F.col("rmse")))
    tuned = by_mtry.agg((F.min("rmse") - default).alias("b"))
    pieces = [
        grown.select(F.lit("a").alias("ImprovementType"), F.col("a").alias("ImprovementValue")),
        tuned.select(F.lit("b").alias("ImprovementType"), F.col("b").alias("ImprovementValue")),
        grown.select(F.lit("c").alias("ImprovementType"), F.col("c").alias("ImprovementValue")),
    ]
    return reduce(DataFrame.unionByName, pieces)
