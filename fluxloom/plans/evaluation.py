"""All result tables from the saved models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.forests.importance import label_importance, permutation_importance
from fluxloom.forests.models import load_models, predict_all, predictors_of, rmse_by_trees
from fluxloom.functions.hybrid import MODELS, PURE
from fluxloom.operators import evaluate as E
from fluxloom.operators.boxplot import boxplot_outliers, boxplot_stats
from fluxloom.operators.joins import add_land_cover
from fluxloom.plans.training import KEYS, TrainedTables, tuning_path
from fluxloom.sources.sinks import write_table
from fluxloom.sources.tables import read_table
from fluxloom.storage import scratch, store


def evaluate_models(
    spark: SparkSession,
    trained: TrainedTables,
    metadata: DataFrame,
    trees: int = 500,
    exclude_sites: tuple[str, ...] = ("US-CS2",),
    limits: dict[str, tuple[float, float]] | None = None,
) -> dict[str, DataFrame]:
    """Score every row once, store the scores, and derive each table from them.

    ``limits`` are plot limits by score column; models beyond them do not enter a correlation.
    """
    models = load_models(trained.models, trees)
    split = read_table(spark, trained.split)
    scored = store(predict_all(models, read_table(spark, trained.targets)).join(split, KEYS), "scored")
    test = scored.where(F.col("split") == "test")
    classed = add_land_cover(test, metadata)
    rollup = store(E.rmse_difference_rollup(classed), "rollup")
    card = store(E.scorecard(test), "scorecard")
    differences = store(E.site_differences(rollup), "site_differences")
    inside = limits or {}

    def correlation(x: str, y: str, **kept) -> DataFrame:
        return E.correlation_test(card, x, y, x_range=inside.get(x), y_range=inside.get(y), **kept)

    tables = {
        "scorecard": card,
        "difference_rollup": rollup,
        "site_differences": differences,
        "difference_points": E.group_differences(rollup),
        "difference_boxes": boxplot_stats(differences, ["IGBP2", "model"], "rmse"),
        "difference_outliers": boxplot_outliers(differences, ["IGBP2", "model"], "rmse"),
        "group_sites": E.group_site_counts(classed),
        "r2_vs_rmse": correlation("parameter_R2", "rmse", drop_models=["Pure-ML"]),
        "gsi_vs_rmse": correlation("partial_stdev", "rmse"),
        "gsi_vs_spread": correlation("partial_stdev", "stdev_ratio"),
    }
    thresholds = E.extreme_thresholds_at(scored, [0.01, 0.03])
    for level, name in ((0.01, "extremes_1"), (0.03, "extremes_3")):
        wide = store(E.extreme_errors(test, thresholds[level], exclude_sites), name)
        long = store(E.extreme_points(wide), f"{name}_points")
        tables |= {name: wide, f"{name}_points": long, f"{name}_boxes": boxplot_stats(long, ["model"], "rmse")}
    for model in MODELS:
        importance = permutation_importance(models[model.target], test, model.target, predictors_of(model), KEYS)
        tables[f"importance_{model.target}"] = label_importance(store(importance, "importance"))
    tables["trees"] = store(trees_table(spark, trained), "trees_table")
    if trained.tuned:
        tables["improvement"] = improvements(spark, trained, tables["trees"])
    return tables


def write_evaluation(
    spark: SparkSession, trained: TrainedTables, metadata: DataFrame, output: str, **options
) -> dict[str, str]:
    """``evaluate_models`` as a job: every table below ``output``, nothing left in the shared folder."""
    with scratch(spark):
        paths = {}
        for name, table in evaluate_models(spark, trained, metadata, **options).items():
            paths[name] = f"{output}/{name}"
            write_table(table, paths[name])
    return paths


def trees_table(spark: SparkSession, trained: TrainedTables) -> DataFrame:
    """Training-set error of every model for each forest size."""
    split = read_table(spark, trained.split).where(F.col("split") == "train")
    rows = read_table(spark, trained.targets).join(split, KEYS, "left_semi")
    return rmse_by_trees(rows, {trees: load_models(trained.models, trees) for trees in trained.tree_counts})


def improvements(spark: SparkSession, trained: TrainedTables, by_trees: DataFrame | None = None) -> DataFrame:
    """Error change from more trees, a tuned mtry and the hybrid model, from the saved models and tuning tables."""
    by_mtry = read_table(spark, tuning_path(trained, PURE.target))
    return E.improvement_table(by_trees or store(trees_table(spark, trained), "trees_table"), by_mtry)
