"""The seven latent-heat models: how a learnt parameter becomes a flux.

Each hybrid model owns the name of its learnt parameter, the physical equation
that turns the parameter into a flux, and the derivative of that flux with
respect to the parameter (for the global sensitivity index).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.functions.physics import combination_flux, evaporative_demand


def _demand() -> Column:
    return evaporative_demand(
        F.col("Delta"), F.col("NETRAD") - F.col("G_F_MDS"), F.col("density"),
        F.col("VPD_F") / S.HPA_PER_KPA, F.col("ra_H"),
    )


def _humid_weight() -> Column:
    return F.col("rha") * F.col("Delta")


def _gradient_gain() -> Column:
    """Flux per unit of the humidity-gradient term."""
    capacity = F.col("density") * S.SPECIFIC_HEAT_AIR * F.col("esat_air")
    return F.try_divide(capacity, _humid_weight() + F.col("gamma"))


def _humid_equilibrium() -> Column:
    weight = _humid_weight()
    return F.try_divide(weight * (F.col("NETRAD") - F.col("G_F_MDS")), weight + F.col("gamma"))


def _conductance_flux(theta: Column) -> Column:
    return combination_flux(_demand(), F.col("Delta"), F.col("gamma"), F.col("ra_H"), F.exp(-theta))


def _conductance_slope(theta: Column) -> Column:
    rs = F.exp(-theta)
    damping = F.col("Delta") + F.col("gamma") + F.col("gamma") * rs / F.col("ra_H")
    return F.try_divide(_demand() * F.col("gamma") * rs, F.col("ra_H") * damping * damping)


@dataclass(frozen=True)
class FluxModel:
    name: str
    code: str | None  # short code in difference tables, none for the pure model
    target: str  # what the forest learns
    estimate: str  # column holding the modelled flux
    short: str  # column in the tree-count table
    flux: Callable[[Column], Column]
    slope: Callable[[Column], Column]
    mean_abs_sensitivity: bool = False  # |mean| instead of root mean square

    @property
    def learned(self) -> str:
        return f"{self.target}_RF"


# ---- fixed values: model names, codes, targets and result columns ----
PURE = FluxModel(
    "Pure-ML", None, "LE_CORR", "LE_CORR_RF", "Pure_ML", lambda theta: theta, lambda theta: F.lit(1.0)
)
HYBRIDS = [
    FluxModel(
        "H-PT", "H2", "PT_stress_cor", "LE_CORR_hybrid_PT", "H_PT",
        lambda theta: F.col("PET_PT") * theta, lambda theta: F.col("PET_PT"),
    ),
    FluxModel(
        "H-Penman", "H1", "Penman_stress_cor", "LE_CORR_hybrid_Penman", "H_Penman",
        lambda theta: F.col("PET_Penman") * theta, lambda theta: F.col("PET_Penman"),
    ),
    FluxModel(
        "H-PM-Kc", "H4", "PM_stress_cor", "LE_CORR_hybrid_PMkc", "H_PM_Kc",
        lambda theta: F.col("PET_PM") * theta, lambda theta: F.col("PET_PM"),
    ),
    FluxModel(
        "H-PM-gs", "H3", "Gs_log_cor", "LE_CORR_hybrid_PMgs", "H_PM_gs", _conductance_flux, _conductance_slope,
    ),
    FluxModel(
        "H-PMRH-Frh", "H6", "Frh_cor", "LE_CORR_hybrid_PMRH_Frh", "H_PMRH_Frh",
        lambda theta: _humid_equilibrium() + theta * _gradient_gain(),
        lambda theta: _gradient_gain(), mean_abs_sensitivity=True,
    ),
    FluxModel(
        "H-PMRH-drh", "H5", "drh_cor", "LE_CORR_hybrid_PMRH_drh", "H_PMRH_drh",
        lambda theta: _humid_equilibrium() + theta / F.col("ra_H") * _gradient_gain(),
        lambda theta: _gradient_gain() / F.col("ra_H"), mean_abs_sensitivity=True,
    ),
]
MODELS = [PURE, *HYBRIDS]
BY_NAME = {model.name: model for model in MODELS}
BY_CODE = {model.code: model for model in sorted(HYBRIDS, key=lambda m: m.code)}


def add_flux_estimates(df: DataFrame) -> DataFrame:
    """Push every learnt parameter (``*_RF``) back through its equation."""
    return df.withColumns({model.estimate: model.flux(F.col(model.learned)) for model in HYBRIDS})
