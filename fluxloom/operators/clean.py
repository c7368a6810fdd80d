"""Cleaning, date handling, satellite preparation, derived columns and quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom import schema as S
from fluxloom.functions import physics as P
from fluxloom.functions.guards import nan_to_null


def sentinel_to_null(df: DataFrame, sentinel: float = S.SENTINEL) -> DataFrame:
    """Replace the missing-value code, and NaN, by null in every numeric column."""

    def cleaned(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = nan_to_null(column)
        if isinstance(field.dataType, T.NumericType):
            column = F.nullif(column, F.lit(sentinel).cast(field.dataType))
        return column.alias(field.name)

    return df.select(*[cleaned(field) for field in df.schema.fields])


def decode_yyyymmdd(stamp: Column) -> Column:
    """Noon of the day written as an integer ``yyyymmdd``; null for a day that does not exist."""
    return F.try_to_timestamp(F.concat(stamp.cast("int").cast("string"), F.lit("12")), F.lit("yyyyMMddHH"))


def date_parts(df: DataFrame, stamp: str = "PDATE") -> DataFrame:
    """Add ``DATE`` and ``YEAR``."""
    day = F.to_date(F.col(stamp))
    return df.withColumns({"DATE": day, "YEAR": F.year(day)})


def from_date(df: DataFrame, start: str, column: str = "DATE") -> DataFrame:
    """Rows on or after ``start``."""
    return df.where(F.col(column) >= F.lit(start).cast("date"))


def project_required(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(*(columns or S.REQUIRED))


def satellite_product(df: DataFrame) -> DataFrame:
    """Rename a satellite table's key to (site, DATE)."""
    return df.withColumns({"DATE": F.to_date("date_text"), "site": F.col("name")}).drop("date_text", "name")


def scale_fpar(df: DataFrame) -> DataFrame:
    """Stored FPAR is in percent."""
    return df.withColumn("Fpar", F.col("Fpar") * S.FPAR_SCALE)


def add_air_properties(df: DataFrame) -> DataFrame:
    """Available energy, humidity, air and vapour properties, resistance and conductance."""
    t, pressure, vpd = F.col("TA_F"), F.col("PA_F"), F.col("VPD_F") / S.HPA_PER_KPA
    first = {
        "AE": P.available_energy(F.col("NETRAD"), F.col("G_F_MDS")),
        "rha": P.relative_humidity(vpd, t),
        "density": P.air_density(t, pressure),
        "esat_air": P.sat_vapor_pressure(t),
        "q": P.specific_humidity(vpd, t, pressure),
        "gamma": P.psychrometric_constant(t, pressure),
        "Lv": P.latent_heat(t),
        "WS_F": P.wind_floor(F.col("WS_F")),
    }
    second = {
        "Delta": P.sat_vapor_slope(t, F.col("esat_air")),
        "_resistance": P.unbounded_resistance(F.col("WS_F"), F.col("USTAR")),
    }
    bounded = df.withColumns(first).withColumns(second).withColumn("ra_H", P.bounded_resistance(F.col("_resistance")))
    return bounded.withColumn("ga_H", F.try_divide(F.lit(1.0), F.col("ra_H"))).drop("_resistance")


def add_potential_fluxes(df: DataFrame) -> DataFrame:
    """The three potential evaporation estimates."""
    slope, gamma, ra = F.col("Delta"), F.col("gamma"), F.col("ra_H")
    demand = P.evaporative_demand(slope, F.col("AE"), F.col("density"), F.col("VPD_F") / S.HPA_PER_KPA, ra)
    return df.withColumns({
        "PET_Penman": P.combination_flux(demand, slope, gamma, ra),
        "PET_PT": P.equilibrium_flux(slope, gamma, F.col("AE")),
        "PET_PM": P.combination_flux(demand, slope, gamma, ra, S.REFERENCE_SURFACE_RESISTANCE),
    })


def add_parameters(df: DataFrame) -> DataFrame:
    """Intermediate parameters: what each physical equation needs to give the measured flux."""
    flux = F.col("LE_CORR")
    gradient = P.humidity_gradient_rate(
        flux, F.col("rha"), F.col("Delta"), F.col("gamma"), F.col("AE"), F.col("density"), F.col("esat_air")
    )
    conductance = P.surface_conductance(
        flux, F.col("ga_H"), F.col("gamma"), F.col("Delta"), F.col("AE"), F.col("density"),
        F.col("VPD_F") / S.HPA_PER_KPA,
    )
    unguarded = df.withColumns({
        "_Penman": P.flux_ratio(flux, F.col("PET_Penman")),
        "_PT": P.flux_ratio(flux, F.col("PET_PT")),
        "_PM": P.flux_ratio(flux, F.col("PET_PM")),
        "_Gs": conductance,
        "Frh_cor": gradient,
    })
    return unguarded.withColumns({
        "Penman_stress_cor_raw": P.stress_ratio(F.col("_Penman")),
        "PT_stress_cor_raw": P.stress_ratio(F.col("_PT")),
        "Gs_cor_raw": P.positive_only(F.col("_Gs")),
        "PM_stress_cor_raw": P.stress_ratio(F.col("_PM")),
        "drh_cor": F.col("Frh_cor") * F.col("ra_H"),
    }).drop("_Penman", "_PT", "_PM", "_Gs")


def add_physics(df: DataFrame) -> DataFrame:
    """All derived columns; a few projections that Spark runs inside the scan's stage."""
    return add_parameters(add_potential_fluxes(add_air_properties(df)))


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns or S.NOT_NULL_AFTER_QC)


def quality_ok(min_quality: float = 0.8) -> Column:
    """Flux quality high enough and humidity positive."""
    return (F.col("LE_F_MDS_QC") >= min_quality) & (F.col("rha") > 0)


def balance_ok(max_gap: float = 100.0, low: float = -50.0, high: float = 280.0) -> Column:
    """Energy balance closes and available energy is plausible; all bounds are exclusive."""
    energy = F.col("NETRAD") - F.col("G_F_MDS")
    gap = F.abs(energy - F.col("LE_CORR") - F.col("H_CORR"))
    return (gap < max_gap) & (energy < high) & (energy > low)


def quality_control(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Everything that has to hold for a row to be analysed. Runs after the gap fill."""
    return drop_incomplete(df.where(quality_ok()), required).where(balance_ok())
