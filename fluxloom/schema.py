"""Column names, file schemas and constants of the flux data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: physical constants of the published formulas ----
SPECIFIC_HEAT_AIR = 1004.834  # J kg-1 K-1
VAPOUR_MASS_RATIO = 0.622
GAS_CONSTANT_DRY_AIR = 287.0586  # J kg-1 K-1
KELVIN_OFFSET = 273.15
PRIESTLEY_TAYLOR_ALPHA = 1.26
REFERENCE_SURFACE_RESISTANCE = 70.0  # s m-1
MIN_WIND_SPEED = 0.2  # m s-1
MIN_RESISTANCE = 10.0  # s m-1
MAX_RESISTANCE = 1000.0  # s m-1

# ---- fixed values: input conventions ----
SENTINEL = -9999
SITE_NAME_START = 5
SITE_NAME_LENGTH = 6
DAILY_FILE_MARK = "FULLSET_DD"
FPAR_SCALE = 0.01
HPA_PER_KPA = 10.0

# ---- fixed values: required columns of a daily site file, in output order ----
MEASURED = [
    "TA_F", "TA_F_QC", "VPD_F", "VPD_F_QC", "PA_F", "P_F", "CO2_F_MDS", "CO2_F_MDS_QC",
    "NETRAD", "NETRAD_QC", "G_F_MDS", "G_F_MDS_QC", "SW_IN_F_MDS", "SW_IN_F_MDS_QC",
    "H_F_MDS", "H_F_MDS_QC", "H_CORR", "LE_F_MDS", "LE_F_MDS_QC", "LE_CORR",
    "WS_F", "WS_F_QC", "USTAR", "USTAR_QC",
]
REQUIRED = ["site", "PDATE", *MEASURED]

# ---- fixed values: columns that must be present after quality control ----
NOT_NULL_AFTER_QC = [
    "site", "PDATE", "TA_F", "rha", "PA_F", "CO2_F_MDS", "NETRAD", "G_F_MDS", "SW_IN_F_MDS",
    "H_F_MDS", "H_CORR", "LE_F_MDS", "LE_CORR", "WS_F", "USTAR", "soil_moisture", "Fpar", "LC_Type1",
]

# ---- fixed values: predictors, with the label and family used in importance tables ----
PREDICTORS = ["Fpar", "soil_moisture", "VegWC", "TA_F", "CO2_F_MDS", "SW_IN_F_MDS", "ga_H", "rha"]
PREDICTORS_WITH_ENERGY = [*PREDICTORS, "AE"]
PREDICTOR_LABELS = {
    "Fpar": ("FPAR", "Satellite"),
    "soil_moisture": ("SM", "Satellite"),
    "VegWC": ("VegWC", "Satellite"),
    "TA_F": ("T", "Meteo"),
    "CO2_F_MDS": ("CO2", "Meteo"),
    "SW_IN_F_MDS": ("Rg", "Meteo"),
    "ga_H": ("gaH", "Meteo"),
    "rha": ("RH", "Meteo"),
    "AE": ("AE", "Meteo"),
}

# ---- fixed values: variables whose per-site tails define climate extremes ----
EXTREME_VARIABLES = {
    "VWC": "soil_moisture",
    "RH": "rha",
    "T": "TA_F",
    "FPAR": "Fpar",
    "SW_IN": "SW_IN_F_MDS",
    "ga_H": "ga_H",
    "VegWC": "VegWC",
    "CO2": "CO2_F_MDS",
}
EXTREME_NAMES = [f"{name}_{side}" for name in EXTREME_VARIABLES for side in ("03", "97")]

# ---- fixed values: cap percentiles and input files ----
# Twenty cap percentiles, 99 to 99.95 in steps of 0.05.
CAP_PERCENTILES = [round(99 + 0.05 * step, 2) for step in range(20)]
CAP_MIN_ENERGY = 30.0  # W m-2, rows below do not shape a cap

SATELLITE_FILES = {
    "soil_moisture": T.StructType([
        T.StructField("date", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("soil_moisture", T.DoubleType()),
    ]),
    "VegWC": T.StructType([
        T.StructField("date", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("VegWC", T.DoubleType()),
    ]),
    "Fpar": T.StructType([
        T.StructField("date", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("Fpar", T.DoubleType()),
    ]),
}
LAND_COVER = {"LC_Type1": T.IntegerType()}  # with one of the satellite files
SITE_METADATA = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("IGBP", T.StringType()),
])
