"""Terms of evapotranspiration as column expressions.

Units: temperature degC, pressure and vapour pressure kPa, energy fluxes W m-2,
resistances s m-1. Two published saturation formulas are in use: the FAO-56 one
for humidity derived from a vapour pressure deficit, and the Sonntag (1990) one
everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.functions.guards import at_least, clamp, ieee_div, nan_to_null

# ---- fixed values: (e0 kPa, slope, offset degC) of the two Magnus-type formulas ----
SONNTAG_1990 = (0.6112, 17.62, 243.12)
FAO_56 = (0.6108, 17.27, 237.3)


def _magnus(t: Column, coefficients: tuple[float, float, float]) -> Column:
    e0, slope, offset = coefficients
    return F.lit(e0) * F.exp(slope * t / (offset + t))


def sat_vapor_pressure(t: Column) -> Column:
    """Saturation vapour pressure over water."""
    return _magnus(t, SONNTAG_1990)


def sat_vapor_slope(t: Column, esat: Column) -> Column:
    """Derivative of ``sat_vapor_pressure`` with temperature, given its value."""
    _, slope, offset = SONNTAG_1990
    return esat * slope * offset / ((offset + t) * (offset + t))


def relative_humidity(vpd: Column, t: Column) -> Column:
    """Relative humidity (0-1) from a vapour pressure deficit; negative when the deficit is too big."""
    return 1 - F.try_divide(vpd, _magnus(t, FAO_56))


def specific_humidity(vpd: Column, t: Column, pressure: Column) -> Column:
    """Specific humidity (kg/kg) from a vapour pressure deficit."""
    vapour = _magnus(t, FAO_56) - vpd
    return F.try_divide(S.VAPOUR_MASS_RATIO * vapour, pressure - (1 - S.VAPOUR_MASS_RATIO) * vapour)


def air_density(t: Column, pressure: Column) -> Column:
    """Dry air density from the ideal gas law, kg m-3."""
    return F.try_divide(pressure * 1000, S.GAS_CONSTANT_DRY_AIR * (t + S.KELVIN_OFFSET))


def latent_heat(t: Column) -> Column:
    """Latent heat of vaporisation, J kg-1."""
    return (2.501 - 0.00237 * t) * 1e6


def psychrometric_constant(t: Column, pressure: Column) -> Column:
    """Psychrometric constant, kPa K-1."""
    return F.try_divide(S.SPECIFIC_HEAT_AIR * pressure, S.VAPOUR_MASS_RATIO * latent_heat(t))


def wind_floor(wind: Column) -> Column:
    """Wind speed, kept from falling below its measurable minimum."""
    return at_least(wind, S.MIN_WIND_SPEED)


def unbounded_resistance(wind: Column, ustar: Column) -> Column:
    """Momentum plus boundary-layer resistance.

    A friction velocity of zero gives infinity, a negative one has no
    boundary-layer term and gives null.
    """
    momentum = ieee_div(wind, ustar * ustar)
    boundary = 6.2 * F.pow(ustar, F.lit(-0.667))
    return nan_to_null(momentum + boundary)


def bounded_resistance(resistance: Column) -> Column:
    """Aerodynamic resistance held inside its plausible range."""
    return clamp(resistance, S.MIN_RESISTANCE, S.MAX_RESISTANCE)


def available_energy(net_radiation: Column, ground_heat: Column) -> Column:
    """Net radiation left after ground heat storage."""
    return net_radiation - ground_heat


def evaporative_demand(slope: Column, energy: Column, density: Column, vpd: Column, ra: Column) -> Column:
    """Numerator of the combination equation: radiative plus drying-power term."""
    return slope * energy + density * S.SPECIFIC_HEAT_AIR * vpd / ra


def combination_flux(demand: Column, slope: Column, gamma: Column, ra: Column, surface_resistance=None) -> Column:
    """Combination equation; without a surface resistance it is open-water evaporation."""
    damping = slope + gamma
    if surface_resistance is not None:
        damping = damping + gamma * surface_resistance / ra
    return F.try_divide(demand, damping)


def equilibrium_flux(slope: Column, gamma: Column, energy: Column) -> Column:
    """Radiation-driven potential evaporation with the usual coefficient."""
    return S.PRIESTLEY_TAYLOR_ALPHA * F.try_divide(slope, slope + gamma) * energy


def flux_ratio(flux: Column, potential: Column) -> Column:
    """Actual over potential flux."""
    return ieee_div(flux, potential)


def stress_ratio(ratio: Column) -> Column:
    """Flux ratio with negative values set to zero."""
    return at_least(ratio, 0.0)


def surface_conductance(
    flux: Column, ga: Column, gamma: Column, slope: Column, energy: Column, density: Column, vpd: Column
) -> Column:
    """Combination equation solved for surface conductance, of either sign."""
    shortfall = slope * energy + density * S.SPECIFIC_HEAT_AIR * ga * vpd - flux * (slope + gamma)
    return F.try_divide(flux * ga * gamma, shortfall)


def positive_only(value: Column) -> Column:
    """The value where it is above zero, else null."""
    return F.when(value > 0, value)


def humidity_gradient_rate(
    flux: Column, rha: Column, slope: Column, gamma: Column, energy: Column, density: Column, esat: Column
) -> Column:
    """Humidity-form combination equation solved for its vertical-gradient term, m s-1."""
    weight = F.try_divide(rha * slope, gamma)
    residual = flux * (1 + weight) - weight * energy
    return F.try_divide(residual, density * S.SPECIFIC_HEAT_AIR * esat) * gamma
