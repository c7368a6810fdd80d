"""Cap search, final targets, tuning and fitting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.forests.models import (
    ForestSettings, best_mtry, fit_all, predictors_of, save_models, sweep_caps, tune_grids,
)
from fluxloom.functions.hybrid import MODELS
from fluxloom.operators.caps import add_capped_targets, best_caps, cap_grid, caps_as_numbers
from fluxloom.operators.splits import save_split, split_stratified
from fluxloom.sources.sinks import write_numbered_csv, write_table
from fluxloom.sources.tables import read_table
from fluxloom.storage import scratch, store

KEYS = ["site", "DATE"]


@dataclass(frozen=True)
class TrainedTables:
    """Paths written by ``train``."""

    split: str
    cap_table: str
    targets: str
    models: str
    tuning: str
    tree_counts: tuple[int, ...] = (100, 500)
    tuned: bool = True


def tuning_path(trained: TrainedTables, target: str) -> str:
    """Where the cross-validated errors of a target are saved."""
    return f"{trained.tuning}/{target}"


def search_caps(
    df: DataFrame,
    split: DataFrame,
    settings: ForestSettings = ForestSettings(),
    caps_from: str = "all",
    percentiles: Sequence[float] = S.CAP_PERCENTILES,
) -> DataFrame:
    """Cap table with validation errors. ``caps_from='train'`` keeps test rows out of the caps."""
    train = df.join(split.where(F.col("split") == "train"), KEYS, "left_semi")
    grid = cap_grid(train if caps_from == "train" else df, percentiles)
    return store(sweep_caps(train, grid, KEYS, settings), "cap_table")


def tune_all(train: DataFrame, settings: ForestSettings = ForestSettings()) -> dict[str, DataFrame]:
    """Cross-validated error table per target."""
    return tune_grids(train, {m.target: predictors_of(m) for m in MODELS}, KEYS, settings=settings)


def train(
    spark: SparkSession,
    filtered: str,
    output: str,
    settings: ForestSettings = ForestSettings(),
    tune: bool = True,
    tree_counts: tuple[int, ...] = (100, 500),
    percentiles: Sequence[float] = S.CAP_PERCENTILES,
    caps_from: str = "all",
) -> TrainedTables:
    """Split, search caps, derive targets, tune mtry and fit every forest size."""
    paths = TrainedTables(*[f"{output}/{part}" for part in ("split", "max_decision", "targets", "models", "tuning")], tree_counts, tune)
    with scratch(spark):
        rows = read_table(spark, filtered)
        save_split(split_stratified(rows, ["site"], KEYS), KEYS, paths.split)
        split = read_table(spark, paths.split)

        results = search_caps(rows, split, settings, caps_from, percentiles)
        write_numbered_csv(results, paths.cap_table, ["percentile"])
        best = caps_as_numbers(best_caps(results).first())
        write_table(add_capped_targets(rows, best), paths.targets)

        targets = read_table(spark, paths.targets)
        fit_rows = store(targets.join(split.where(F.col("split") == "train"), KEYS, "left_semi"), "fit_rows")
        mtry = {}
        if tune:
            for target, table in tune_all(fit_rows, settings).items():
                write_table(table, tuning_path(paths, target))
                mtry[target] = best_mtry(read_table(spark, tuning_path(paths, target))).first()["mtry"]
        for trees in tree_counts:
            models = fit_all(fit_rows, mtry, replace(settings, trees=trees))
            save_models(models, paths.models, trees)
    return paths
