"""Percentile caps of the learnt parameters and their use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.functions.guards import at_most, clamp
from fluxloom.functions.physics import flux_ratio
from fluxloom.operators.order_stats import exact_percentiles
from fluxloom.storage import store

# ---- fixed values: potential flux, raw parameter and capped parameter of each ratio model ----
RATIO_TARGETS = {
    "PT": ("PET_PT", "PT_stress_cor_raw", "PT_stress_cor"),
    "Penman": ("PET_Penman", "Penman_stress_cor_raw", "Penman_stress_cor"),
    "PMKc": ("PET_PM", "PM_stress_cor_raw", "PM_stress_cor"),
}
CONDUCTANCE = "PMgs"


def _ratios(min_energy: float) -> dict[str, Column]:
    """The three flux ratios, on rows with enough energy only."""
    return {
        name: F.when(F.col("AE") > min_energy, flux_ratio(F.col("LE_CORR"), F.col(potential)))
        for name, (potential, _, _) in RATIO_TARGETS.items()
    }


def _caps(df: DataFrame, values: dict[str, Column], percentiles: Sequence[float], mirrored: bool) -> DataFrame:
    """One search over all variables, each with the row condition that its value carries."""
    probs = [q for p in percentiles for q in ((p / 100, 1 - p / 100) if mirrored else (p / 100,))]
    found = exact_percentiles(df, [], values, probs)
    upper, here = F.col("prob") > 0.5, {name: F.col("variable") == name for name in values}
    columns = {f"{name}_max": match & upper for name, match in here.items()}
    if CONDUCTANCE in here:
        columns[f"{CONDUCTANCE}_min"] = here[CONDUCTANCE] & ~upper
    return _by_percentile(found, columns)


def percentile_caps(
    df: DataFrame, percentiles: Sequence[float] = S.CAP_PERCENTILES, min_energy: float = S.CAP_MIN_ENERGY
) -> DataFrame:
    """Upper percentiles of the three flux ratios over rows with enough energy.

    One row per percentile: ``percentile, PT_max, Penman_max, PMKc_max``.
    """
    return _caps(df, _ratios(min_energy), percentiles, False)


def conductance_caps(df: DataFrame, percentiles: Sequence[float] = S.CAP_PERCENTILES) -> DataFrame:
    """Lower and upper percentiles of surface conductance: ``percentile, PMgs_max, PMgs_min``."""
    return _caps(df, {CONDUCTANCE: F.col("Gs_cor_raw")}, percentiles, True)


def _by_percentile(found: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows per upper percentile; a lower percentile belongs to the upper one it mirrors."""
    prob = F.col("prob")
    percentile = F.round(100 * F.when(prob > 0.5, prob).otherwise(1 - prob), 6)
    return found.groupBy(percentile.alias("percentile")).agg(
        *[F.max(F.when(match, F.col("value"))).alias(name) for name, match in columns.items()]
    )


def cap_grid(
    df: DataFrame, percentiles: Sequence[float] = S.CAP_PERCENTILES, min_energy: float = S.CAP_MIN_ENERGY
) -> DataFrame:
    """The cap table: every percentile with the caps of all four parameters, from one search."""
    values = _ratios(min_energy) | {CONDUCTANCE: F.col("Gs_cor_raw")}
    return store(_caps(df, values, percentiles, True), "cap_grid")


def capped(value: Column, cap: float) -> Column:
    """Training target with its upper tail set to the cap."""
    return at_most(value, cap)


def capped_ratio(ratio: Column, cap) -> Column:
    """Flux ratio held in [0, cap]."""
    return clamp(ratio, 0.0, cap)


def imputed_conductance(low: float, high: float) -> Column:
    """Raw conductance, else the low cap without and the high cap with evaporation."""
    fallback = F.when(F.col("LE_CORR") <= 0, F.lit(low)).when(F.col("LE_CORR") > 0, F.lit(high))
    return F.coalesce(F.col("Gs_cor_raw"), fallback)


def add_capped_targets(df: DataFrame, best: dict[str, float]) -> DataFrame:
    """Final learning targets from the chosen caps (``PT_max``, ..., ``PMgs_max``, ``PMgs_min``)."""
    ratios = {
        f"_{name}": flux_ratio(F.col("LE_CORR"), F.col(potential)) for name, (potential, _, _) in RATIO_TARGETS.items()
    }
    held = {
        target: capped_ratio(F.col(f"_{name}"), best[f"{name}_max"]) for name, (_, _, target) in RATIO_TARGETS.items()
    }
    conductance = imputed_conductance(best["PMgs_min"], best["PMgs_max"])
    targets = df.withColumns(ratios | {"Gs_cor": conductance}).withColumns(held | {"Gs_log_cor": F.ln("Gs_cor")})
    return targets.drop(*ratios)


def best_caps(results: DataFrame) -> DataFrame:
    """Caps with the lowest error of each model; the smallest percentile wins a tie."""
    columns = []
    for name in (*RATIO_TARGETS, CONDUCTANCE):
        order = F.struct(f"{name}_rmse", "percentile")
        kept = [f"{name}_max"] + (["PMgs_min"] if name == CONDUCTANCE else [])
        usable = F.col(f"{name}_rmse").isNotNull()
        columns += [F.min_by(F.when(usable, F.col(c)), F.when(usable, order)).alias(f"{c}_best") for c in kept]
    return results.agg(*columns)


def caps_as_numbers(best: Row) -> dict[str, float]:
    return {name.removesuffix("_best"): best[name] for name in best.asDict()}
