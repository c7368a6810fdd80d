"""A daily flux table projected from ``lineitem``, in Spark and as SQL text.

``lineitem`` is grouped by supplier (the site) and ship date (the day); only
maxima are used, so the values do not depend on row order. Suppliers' regions
stand in for land cover, and fixed linear functions of the predictors stand in for
forest estimates so that SQL can check every table made from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.functions.hybrid import MODELS, add_flux_estimates
from fluxloom.operators.caps import add_capped_targets
from fluxloom.operators.clean import add_physics, balance_ok, quality_ok, sentinel_to_null
from fluxloom.operators.joins import add_land_cover
from fluxloom.operators.lookahead import fill_ahead
from fluxloom.operators.splits import split_stratified
from fluxloom.storage import store

KEYS = ["site", "obs_date"]
FILLED = ["soil_moisture", "VegWC", "Fpar"]
REQUIRED_AFTER_QC = ["USTAR", "soil_moisture", "Fpar"]

# ---- fixed values: stand-in caps used where a query is not about finding caps ----
STAND_IN_CAPS = {"PT_max": 2.0, "Penman_max": 1.5, "PMKc_max": 1.75, "PMgs_max": 0.05, "PMgs_min": 0.0001}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One narrow row per site and day, from which every measured column follows."""
    sources = {
        "k": "l_orderkey", "qty": "l_quantity", "price": "l_extendedprice",
        "disc": "l_discount", "tax": "l_tax", "line": "l_linenumber",
    }
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("obs_date"))
        .agg(*[F.max(column).alias(name) for name, column in sources.items()])
    )


def measured(rows: DataFrame, *also: str) -> DataFrame:
    """The measured columns of ``daily`` rows, and what else they carry."""
    k, qty, price, disc, tax = (F.col(name) for name in ("k", "qty", "price", "disc", "tax"))
    line = F.col("line").cast("double")
    quality = 1 - (line - 1) * 0.05
    latent = price / 800 + line * 4 - 10
    sensible = price / 400 - tax * 100 - latent + (disc - 0.05) * 2500
    return rows.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("site"),
        "obs_date", "k",
        (qty - 10).alias("TA_F"), quality.alias("TA_F_QC"),
        (disc * 100).alias("VPD_F"), quality.alias("VPD_F_QC"),
        (95 + tax * 75).alias("PA_F"), (tax * 10).alias("P_F"),
        (380 + qty).alias("CO2_F_MDS"), quality.alias("CO2_F_MDS_QC"),
        (price / 400).alias("NETRAD"), quality.alias("NETRAD_QC"),
        (tax * 100).alias("G_F_MDS"), quality.alias("G_F_MDS_QC"),
        (price / 300).alias("SW_IN_F_MDS"), quality.alias("SW_IN_F_MDS_QC"),
        sensible.alias("H_F_MDS"), quality.alias("H_F_MDS_QC"), sensible.alias("H_CORR"),
        latent.alias("LE_F_MDS"), quality.alias("LE_F_MDS_QC"), latent.alias("LE_CORR"),
        (line * 0.7 - 0.6).alias("WS_F"), quality.alias("WS_F_QC"),
        F.when(k % 17 == 0, F.lit(float(S.SENTINEL))).otherwise(line * 0.1).alias("USTAR"),
        quality.alias("USTAR_QC"), *also,
    )


def flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site and day with the measured columns, missing friction velocity as -9999."""
    return measured(daily(spark, sf_dir))


FLUX_SQL = """
daily AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS obs_date, max(l_orderkey) AS k, max(l_quantity) AS qty,
         max(l_extendedprice) AS price, max(l_discount) AS disc, max(l_tax) AS tax,
         CAST(max(l_linenumber) AS DOUBLE) AS line
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)),
flux AS (
  SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS site, obs_date, k,
         qty - 10 AS TA_F, 1 - (line - 1) * 0.05 AS TA_F_QC,
         disc * 100 AS VPD_F, 1 - (line - 1) * 0.05 AS VPD_F_QC,
         95 + tax * 75 AS PA_F, tax * 10 AS P_F,
         380 + qty AS CO2_F_MDS, 1 - (line - 1) * 0.05 AS CO2_F_MDS_QC,
         price / 400 AS NETRAD, 1 - (line - 1) * 0.05 AS NETRAD_QC,
         tax * 100 AS G_F_MDS, 1 - (line - 1) * 0.05 AS G_F_MDS_QC,
         price / 300 AS SW_IN_F_MDS, 1 - (line - 1) * 0.05 AS SW_IN_F_MDS_QC,
         price / 400 - tax * 100 - (price / 800 + line * 4 - 10) + (disc - 0.05) * 2500 AS H_F_MDS,
         1 - (line - 1) * 0.05 AS H_F_MDS_QC,
         price / 400 - tax * 100 - (price / 800 + line * 4 - 10) + (disc - 0.05) * 2500 AS H_CORR,
         price / 800 + line * 4 - 10 AS LE_F_MDS, 1 - (line - 1) * 0.05 AS LE_F_MDS_QC,
         price / 800 + line * 4 - 10 AS LE_CORR,
         line * 0.7 - 0.6 AS WS_F, 1 - (line - 1) * 0.05 AS WS_F_QC,
         CASE WHEN k % 17 = 0 THEN -9999.0 ELSE line * 0.1 END AS USTAR,
         1 - (line - 1) * 0.05 AS USTAR_QC
  FROM daily)"""


def satellite(df: DataFrame) -> DataFrame:
    """Sparse satellite values on the flux table's own rows."""
    k = F.col("k")
    return df.withColumns({
        "soil_moisture": F.when(k % 3 == 0, 0.05 + (k % 40) * 0.01),
        "VegWC": F.when(k % 4 == 0, 0.5 + (k % 30) * 0.1),
        "Fpar": F.when(k % 5 == 0, (k % 101).cast("double") * S.FPAR_SCALE),
    })


SATELLITE_SQL = """
sat AS (
  SELECT *, CASE WHEN k % 3 = 0 THEN 0.05 + CAST(k % 40 AS DOUBLE) * 0.01 END AS soil_moisture,
         CASE WHEN k % 4 = 0 THEN 0.5 + CAST(k % 30 AS DOUBLE) * 0.1 END AS VegWC,
         CASE WHEN k % 5 = 0 THEN CAST(k % 101 AS DOUBLE) * 0.01 END AS Fpar
  FROM clean)"""

CLEAN_SQL = """
clean AS (SELECT * REPLACE (nullif(USTAR, -9999) AS USTAR) FROM flux)"""


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentinel_to_null(flux(spark, sf_dir))


def physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_physics(clean(spark, sf_dir))


AIR_SQL = """
air AS (
  SELECT * REPLACE (CASE WHEN WS_F < 0.2 THEN 0.2 ELSE WS_F END AS WS_F),
         NETRAD - G_F_MDS AS AE,
         1 - (VPD_F / 10) / (0.6108 * exp(17.27 * TA_F / (237.3 + TA_F))) AS rha,
         PA_F * 1000 / (287.0586 * (TA_F + 273.15)) AS density,
         0.6112 * exp(17.62 * TA_F / (243.12 + TA_F)) AS esat_air,
         (0.622 * (0.6108 * exp(17.27 * TA_F / (237.3 + TA_F)) - VPD_F / 10))
           / (PA_F - 0.378 * (0.6108 * exp(17.27 * TA_F / (237.3 + TA_F)) - VPD_F / 10)) AS q,
         1004.834 * PA_F / (0.622 * ((2.501 - 0.00237 * TA_F) * 1e6)) AS gamma,
         (2.501 - 0.00237 * TA_F) * 1e6 AS Lv
  FROM {source}),
resist AS (
  SELECT *, esat_air * 17.62 * 243.12 / ((243.12 + TA_F) * (243.12 + TA_F)) AS Delta,
         CASE WHEN USTAR IS NULL OR USTAR < 0 THEN NULL WHEN USTAR = 0 THEN 1000.0
              ELSE greatest(10.0, least(1000.0, WS_F / (USTAR * USTAR) + 6.2 * pow(USTAR, -0.667))) END AS ra_H
  FROM air),
potential AS (
  SELECT *, 1 / ra_H AS ga_H,
         (Delta * AE + density * 1004.834 * (VPD_F / 10) / ra_H) / (Delta + gamma) AS PET_Penman,
         1.26 * (Delta / (Delta + gamma)) * AE AS PET_PT,
         (Delta * AE + density * 1004.834 * (VPD_F / 10) / ra_H)
           / (Delta + gamma + gamma * 70 / ra_H) AS PET_PM
  FROM resist),
inverse AS (
  SELECT *, LE_CORR / nullif(PET_Penman, 0) AS r_Penman, LE_CORR / nullif(PET_PT, 0) AS r_PT,
         LE_CORR / nullif(PET_PM, 0) AS r_PM,
         LE_CORR * ga_H * gamma / nullif(Delta * AE + density * 1004.834 * ga_H * (VPD_F / 10)
           - LE_CORR * (Delta + gamma), 0) AS g_raw,
         (LE_CORR * (1 + rha * Delta / gamma) - rha * Delta / gamma * AE)
           / (density * 1004.834 * esat_air) * gamma AS Frh_cor
  FROM potential),
phys AS (
  SELECT *, CASE WHEN r_Penman < 0 THEN 0.0 ELSE r_Penman END AS Penman_stress_cor_raw,
         CASE WHEN r_PT < 0 THEN 0.0 ELSE r_PT END AS PT_stress_cor_raw,
         CASE WHEN r_PM < 0 THEN 0.0 ELSE r_PM END AS PM_stress_cor_raw,
         CASE WHEN g_raw > 0 THEN g_raw END AS Gs_cor_raw,
         Frh_cor * ra_H AS drh_cor
  FROM inverse)"""


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite values with short gaps filled, physics, then quality control.

    Gaps are filled on the narrow daily rows: what is shuffled and sorted for it are six numbers and the satellite values,
    and the columns that follow row by row are made of the result.
    """
    rows = daily(spark, sf_dir).withColumn("k", F.nullif("k", F.lit(int(S.SENTINEL))))
    filled = fill_ahead(satellite(rows), FILLED, ("l_suppkey",), "obs_date", tie=())  # one row a site and day
    filled = add_physics(sentinel_to_null(measured(filled, *FILLED, *[f"{c}_raw" for c in FILLED])))
    return filled.where(quality_ok()).na.drop(subset=REQUIRED_AFTER_QC).where(balance_ok())


ANALYSED_SQL = """
filled AS (
  SELECT * REPLACE (
           first_value(soil_moisture IGNORE NULLS) OVER ahead AS soil_moisture,
           first_value(VegWC IGNORE NULLS) OVER ahead AS VegWC,
           first_value(Fpar IGNORE NULLS) OVER ahead AS Fpar),
         soil_moisture AS soil_moisture_raw, VegWC AS VegWC_raw, Fpar AS Fpar_raw
  FROM phys
  WINDOW ahead AS (PARTITION BY site ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
analysed AS (
  SELECT * FROM filled
  WHERE LE_F_MDS_QC >= 0.8 AND rha > 0 AND USTAR IS NOT NULL AND soil_moisture IS NOT NULL
    AND Fpar IS NOT NULL AND abs(NETRAD - G_F_MDS - LE_CORR - H_CORR) < 100
    AND NETRAD - G_F_MDS < 280 AND NETRAD - G_F_MDS > -50)"""


def with_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysed rows with the learning targets under the stand-in caps."""
    return add_capped_targets(analysed(spark, sf_dir), STAND_IN_CAPS)


TARGETS_SQL = """
targets AS (
  SELECT *, CASE WHEN r_PT < 0 THEN 0.0 WHEN r_PT > 2.0 THEN 2.0 ELSE r_PT END AS PT_stress_cor,
         CASE WHEN r_Penman < 0 THEN 0.0 WHEN r_Penman > 1.5 THEN 1.5 ELSE r_Penman END AS Penman_stress_cor,
         CASE WHEN r_PM < 0 THEN 0.0 WHEN r_PM > 1.75 THEN 1.75 ELSE r_PM END AS PM_stress_cor,
         coalesce(Gs_cor_raw, CASE WHEN LE_CORR <= 0 THEN 0.0001 WHEN LE_CORR > 0 THEN 0.05 END) AS Gs_cor,
         ln(coalesce(Gs_cor_raw, CASE WHEN LE_CORR <= 0 THEN 0.0001 WHEN LE_CORR > 0 THEN 0.05 END)) AS Gs_log_cor
  FROM analysed)"""


def add_stand_ins(df: DataFrame) -> DataFrame:
    """Linear stand-ins for the forests' estimates, and the flux each model makes of them."""
    rha = F.col("rha")
    guesses = {
        "LE_CORR_RF": 0.8 * F.col("LE_CORR") + 0.1 * F.col("AE") + 2,
        "PT_stress_cor_RF": 0.7 * F.col("PT_stress_cor") + 0.2 * rha + 0.05,
        "Penman_stress_cor_RF": 0.75 * F.col("Penman_stress_cor") + 0.1 * rha + 0.03,
        "PM_stress_cor_RF": 0.65 * F.col("PM_stress_cor") + 0.3 * rha + 0.02,
        "Gs_log_cor_RF": 0.8 * F.col("Gs_log_cor") + 0.4 * rha - 1,
        "Frh_cor_RF": 0.9 * F.col("Frh_cor") + 0.0004 * rha,
        "drh_cor_RF": 0.85 * F.col("drh_cor") + 0.02 * rha,
    }
    return add_flux_estimates(df.withColumns(guesses))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_stand_ins(with_targets(spark, sf_dir))


SCORED_SQL = """
guesses AS (
  SELECT *, 0.8 * LE_CORR + 0.1 * AE + 2 AS LE_CORR_RF,
         0.7 * PT_stress_cor + 0.2 * rha + 0.05 AS PT_stress_cor_RF,
         0.75 * Penman_stress_cor + 0.1 * rha + 0.03 AS Penman_stress_cor_RF,
         0.65 * PM_stress_cor + 0.3 * rha + 0.02 AS PM_stress_cor_RF,
         0.8 * Gs_log_cor + 0.4 * rha - 1 AS Gs_log_cor_RF,
         0.9 * Frh_cor + 0.0004 * rha AS Frh_cor_RF,
         0.85 * drh_cor + 0.02 * rha AS drh_cor_RF
  FROM targets),
scored AS (
  SELECT *, PET_PT * PT_stress_cor_RF AS LE_CORR_hybrid_PT,
         PET_Penman * Penman_stress_cor_RF AS LE_CORR_hybrid_Penman,
         PET_PM * PM_stress_cor_RF AS LE_CORR_hybrid_PMkc,
         (Delta * AE + density * 1004.834 * (VPD_F / 10) / ra_H)
           / (Delta + gamma + gamma / exp(Gs_log_cor_RF) / ra_H) AS LE_CORR_hybrid_PMgs,
         rha * Delta * AE / (rha * Delta + gamma)
           + Frh_cor_RF * density * 1004.834 * esat_air / (rha * Delta + gamma) AS LE_CORR_hybrid_PMRH_Frh,
         rha * Delta * AE / (rha * Delta + gamma)
           + drh_cor_RF / ra_H * density * 1004.834 * esat_air / (rha * Delta + gamma) AS LE_CORR_hybrid_PMRH_drh
  FROM guesses)"""


def split_rows(df: DataFrame) -> DataFrame:
    """75/25 split within each site."""
    return split_stratified(df, ["site"], KEYS)


SCORED_COLUMNS = sorted({
    *KEYS, "LE_CORR", "AE", "NETRAD", "G_F_MDS", "VPD_F", "Delta", "density", "gamma", "esat_air", "ra_H",
    "PET_PT", "PET_Penman", "PET_PM", *S.EXTREME_VARIABLES.values(),
    *[column for model in MODELS for column in (model.target, model.learned, model.estimate)],
})


def scored_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows, stored once because the split reads them again, with their side."""
    return split_rows(store(scored(spark, sf_dir).select(*SCORED_COLUMNS), "scored"))


def split_sql(name: str, source: str, strata: str = "site") -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY {strata}
              ORDER BY md5(concat(site, '|', CAST(obs_date AS VARCHAR), '|123')), obs_date)
              <= ceil(0.75 * count(*) OVER (PARTITION BY {strata})) THEN 'train' ELSE 'test' END AS split
  FROM {source})"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site table: a land-cover class per supplier, from its nation and region."""
    sites = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    even = F.col("n_nationkey") % 2 == 0
    region = F.col("n_regionkey")
    igbp = (
        F.when(region == 0, F.when(even, "OSH").otherwise("CSH"))
        .when(region == 1, "CRO")
        .when(region == 2, F.when(even, "DBF").otherwise("ENF"))
        .when(region == 3, "GRA")
        .otherwise("SAV")
    )
    return sites.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("site"), igbp.alias("IGBP")
    )


METADATA_SQL = """
metadata AS (
  SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS site,
         CASE n_regionkey WHEN 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'OSH' ELSE 'CSH' END
              WHEN 1 THEN 'CRO'
              WHEN 2 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'DBF' ELSE 'ENF' END
              WHEN 3 THEN 'GRA' ELSE 'SAV' END AS IGBP
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

GROUP_CASE = """CASE WHEN IGBP IS NULL THEN NULL WHEN IGBP IN ('OSH', 'CSH') THEN 'OSH/CSH' WHEN IGBP = 'CRO' THEN 'CRO'
              WHEN IGBP IN ('DBF', 'ENF') THEN 'DBF/ENF' WHEN IGBP = 'GRA' THEN 'GRA' ELSE 'WET' END"""

CLASSED_SQL = f"""
classed AS (
  SELECT s.*, m.IGBP, {GROUP_CASE} AS IGBP2
  FROM (SELECT * FROM parted WHERE split = 'test') s LEFT JOIN metadata m ON s.site = m.site)"""


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored test rows with their land-cover group."""
    test = scored_split(spark, sf_dir).where(F.col("split") == "test")
    return add_land_cover(test, metadata(spark, sf_dir))


_CHAIN = [
    ("flux", FLUX_SQL),
    ("clean", CLEAN_SQL),
    ("sat", SATELLITE_SQL),
    ("phys", AIR_SQL.format(source="sat")),
    ("analysed", ANALYSED_SQL),
    ("targets", TARGETS_SQL),
    ("scored", SCORED_SQL),
    ("parted", split_sql("parted", "scored")),
    ("classed", METADATA_SQL + "," + CLASSED_SQL),
]


def with_sql(upto: str, select: str, *extra: str) -> str:
    """``select`` over the chain of tables up to ``upto`` (and ``extra`` ones after it)."""
    parts = []
    for name, text in _CHAIN:
        parts.append(text)
        if name == upto:
            break
    return "WITH" + ",".join([*parts, *extra]) + "\n" + select


#: Columns of small numbers are compared to more decimals, so that about nine digits count.
DIGITS = {name: 12 for name in ("q", "gamma", "ga_H", "Gs_cor_raw", "Gs_cor", "Frh_cor", "PMgs_min", "PMgs_max", "PMgs_min_best", "PMgs_max_best")}


def r6(expression: str, name: str | None = None, digits: int | None = None) -> str:
    """SQL: rounded to six decimals (more for small numbers), without a negative zero."""
    name = name or expression
    return f"round({expression}, {digits or DIGITS.get(name, 6)}) + CAST(0 AS DOUBLE) AS {name}"


def rounded(df: DataFrame, keep: list[str], columns: list[str], digits: int | None = None) -> DataFrame:
    """Spark counterpart of ``r6``."""
    return df.select(*keep, *[F.round(F.col(name), digits or DIGITS.get(name, 6)).alias(name) for name in columns])
