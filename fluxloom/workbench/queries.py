"""Every operator as a query over whole driver tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom import schema as S
from fluxloom.forests import importance as I
from fluxloom.forests import models as M
from fluxloom.forests.prepare import MedianImpute
from fluxloom.functions import labels as L
from fluxloom.functions import physics as P
from fluxloom.functions import stats
from fluxloom.functions.hybrid import BY_CODE, BY_NAME, HYBRIDS, MODELS, add_flux_estimates
from fluxloom.operators import caps as C
from fluxloom.operators import clean as K
from fluxloom.operators import evaluate as E
from fluxloom.operators import joins as J
from fluxloom.operators import reshape as R
from fluxloom.operators.boxplot import boxplot_outliers, boxplot_stats
from fluxloom.operators.lookahead import fill_ahead, next_or_last, series_last
from fluxloom.operators.splits import assign_folds, save_split, split_by_target
from fluxloom.sources import daily_files as D
from fluxloom.sources import sinks, versions
from fluxloom.sources.tables import read_satellite, read_site_metadata, read_table
from fluxloom.storage import fresh_path, store
from fluxloom.workbench import views as V

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
KEYS = V.KEYS
START = "1995-04-01"

LIMITS = {"partial_stdev": (12.0, 47.0), "rmse": (5.0, 14.0)}  # plot limits of model_corr_limits
BROKEN_REGION = 2  # sites of this region deliver files that lack a required column


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _rounded(df: DataFrame, *columns: str, keep: list[str] | None = None) -> DataFrame:
    return V.rounded(df, keep or KEYS, list(columns))


# ---------------------------------------------------------------- flagship


@query
def site_potential_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site: error of the three potential fluxes against the measured flux after quality control."""
    daily = V.physical(spark, sf_dir)
    kept = daily.where(K.quality_ok() & F.col("USTAR").isNotNull()).where(K.balance_ok())
    observed = F.col("LE_CORR")
    errors = kept.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"),
        *[stats.rmse(observed, F.col(c)).alias(f"{c}_rmse") for c in ("PET_Penman", "PET_PT", "PET_PM")],
    )
    return _rounded(errors, "PET_Penman_rmse", "PET_PT_rmse", "PET_PM_rmse", keep=["site", "n"])


# ---------------------------------------------------------------- sources and sinks

CSV_TYPES = {"TIMESTAMP": T.IntegerType()} | {name: T.DoubleType() for name in S.MEASURED}


def _stamped(df: DataFrame) -> DataFrame:
    stamp = F.date_format("obs_date", "yyyyMMdd").cast("int")
    return df.withColumn("TIMESTAMP", stamp)


def _site_files(spark: SparkSession, sf_dir: str) -> str:
    """Write the flux table as one marked folder per site, with a file in it: a site has a row a day at most.

    Column order differs between two groups of sites, and the sites of one region
    lack a required column.
    """
    folder = fresh_path(spark, "site-files")
    sites = V.table(spark, sf_dir, "supplier").join(
        V.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    regions = sites.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("site"), "n_regionkey")
    named = F.concat(F.lit("AMF_"), F.rpad("site", 6, "-"), F.lit("_FLUXNET_"), F.lit(S.DAILY_FILE_MARK))
    rows = store(_stamped(V.flux(spark, sf_dir)).join(regions, "site").withColumn("file", named), "site_rows")
    region = F.col("n_regionkey")
    whole = ["TIMESTAMP", *S.MEASURED]
    turned = [*reversed(S.MEASURED), "TIMESTAMP"]
    short = [c for c in whole if c != "USTAR"]
    for part, columns in (
        (region < BROKEN_REGION, whole), (region > BROKEN_REGION, turned), (region == BROKEN_REGION, short)
    ):
        rows.where(part).select(*columns, "file").repartition("file").write.mode("append").option("header", "true").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2"  # tasks move their files, not the driver one after the other
        ).partitionBy("file").csv(folder)
    return folder


def _as_flux(df: DataFrame) -> DataFrame:
    """Site id without file-name padding, day, and a few measured columns."""
    return df.select(
        F.rtrim(F.translate("site", "-", " ")).alias("site"), F.to_date("PDATE").alias("obs_date"),
        "TA_F", "NETRAD", "LE_CORR", "WS_F", "USTAR",
    )


@query
def scan_multi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked site files of different layouts read as one table."""
    daily = _as_flux(D.read_daily_sites(spark, _site_files(spark, sf_dir), start=None))
    return daily


@query
def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per site that survive the required-column gate."""
    daily = _as_flux(D.read_daily_sites(spark, _site_files(spark, sf_dir), start=None))
    return daily.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("first_day"))


@query
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged table written as CSV and read back by column name."""
    path = fresh_path(spark, "merged-csv")
    sinks.write_csv(_stamped(V.clean(spark, sf_dir)).select("site", "TIMESTAMP", *S.MEASURED), path)
    types = {"site": T.StringType()} | CSV_TYPES
    back = D.read_by_name(spark, path, types).withColumn(
        "obs_date", F.to_date(K.decode_yyyymmdd(F.col("TIMESTAMP")))
    )
    return back.select(*KEYS, "TA_F", "H_CORR", "LE_CORR", "USTAR")


@query
def scan_satellite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three satellite CSVs read back; rows and total per site and product."""
    rows = V.satellite(V.clean(spark, sf_dir)).withColumns({
        "date": F.date_format("obs_date", "yyyy-MM-dd"), "name": F.col("site"),
        "percent": F.col("Fpar") / S.FPAR_SCALE, "LC_Type1": (F.col("k") % 17).cast("int"),
    })
    means = []
    for product, source in (("soil_moisture", "soil_moisture"), ("VegWC", "VegWC"), ("Fpar", "percent")):
        path = fresh_path(spark, f"satellite-{product}")
        columns = [F.col(source).alias(product), *(["LC_Type1"] if product == "Fpar" else [])]
        sinks.write_csv(rows.where(F.col(source).isNotNull()).select("date", "name", *columns), path)
        back = read_satellite(spark, path, product)
        means.append(back.groupBy("site").agg(
            F.lit(product).alias("product"), F.count(product).alias("n"),
            F.round(F.sum(product), 6).alias("total"), F.max("DATE").alias("last_day"),
        ))
    return means[0].unionByName(means[1]).unionByName(means[2])


@query
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered table stored, then read back with a pruned projection."""
    path = fresh_path(spark, "filtered")
    sinks.write_table(K.date_parts(V.analysed(spark, sf_dir), "obs_date"), path, partition_by=["YEAR"])
    back = read_table(spark, path)
    return _rounded(back, "PET_PM", keep=[*KEYS, "LE_CORR"])


@query
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV without row numbers written and read back."""
    path = fresh_path(spark, "sink-csv")
    rows = V.clean(spark, sf_dir).select("site", F.date_format("obs_date", "yyyy-MM-dd").alias("day"), "USTAR", "P_F")
    sinks.write_csv(rows, path)
    types = {"site": T.StringType(), "day": T.StringType(), "USTAR": T.DoubleType(), "P_F": T.DoubleType()}
    back = D.read_by_name(spark, path, types)
    return back.select("site", F.to_date("day").alias("obs_date"), "USTAR", "P_F")


@query
def versioned_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read, changed and written back under its own name twice; a frame read before still has the first version."""
    path = fresh_path(spark, "versioned")
    versions.write_version(V.clean(spark, sf_dir).select(*KEYS, "k", "USTAR", "P_F"), path)
    first = versions.read_version(spark, path)
    versions.write_version(first.where(F.col("USTAR").isNotNull()).withColumn("P_F", F.col("P_F") + 1), path, after=1)
    second = versions.read_version(spark, path)
    versions.write_version(second.where(F.col("k") % 2 == 0).withColumn("P_F", F.col("P_F") * 2), path, after=2)
    tables = {1: first, 2: second, 3: versions.read_version(spark, path)}
    return reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("version"), *KEYS, "USTAR", "P_F") for n, t in tables.items()])


@query
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive row numbers in a global order, as the numbered CSV sink writes them."""
    rows = V.flux(spark, sf_dir).select(*KEYS, "k")
    return sinks.number_rows(rows, ["site", "obs_date"])


@query
def derive_site_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site id cut from a file name, for every file a line item could come from."""
    folder = F.concat(F.lit("hdfs:///flux/AMF_"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    path = F.concat(folder, F.lit("_FLUXNET_FULLSET_DD_1995-2001_3-5.csv"))
    return (
        V.table(spark, sf_dir, "lineitem")
        .select(D.site_from_path(path).alias("site_id"))
        .groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    )


@query
def stack_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping files merged: rows in both appear once, rows in one stay."""
    rows = V.flux(spark, sf_dir).select(*KEYS, "TA_F", "LE_CORR", "USTAR", "k")
    early = rows.where(F.col("obs_date") < "1999-01-01").withColumn("_file", F.lit("early"))
    late = rows.where(F.col("obs_date") >= "1998-01-01").withColumn("_file", F.lit("late"))
    return D.stack_sites(early.unionByName(late))


@query
def igbp_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-cover group of every site-day; metadata read from a CSV file."""
    path = fresh_path(spark, "metadata")
    sinks.write_csv(V.metadata(spark, sf_dir), path)
    joined = J.add_land_cover(V.flux(spark, sf_dir), read_site_metadata(spark, path))
    return joined.select(*KEYS, "IGBP", "IGBP2")


# ---------------------------------------------------------------- columns


@query
def sentinel_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sentinel_to_null(V.flux(spark, sf_dir)).select(*KEYS, "k", "USTAR")


@query
def project_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["site", "obs_date", *S.MEASURED]
    return K.project_required(V.clean(spark, sf_dir), columns)


@query
def satellite_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.satellite(V.clean(spark, sf_dir)).select(
        F.col("site").alias("name"), F.date_format("obs_date", "yyyy-MM-dd").alias("date_text"), "VegWC"
    )
    return K.satellite_product(raw).select("site", "DATE", F.round("VegWC", 6).alias("VegWC"))


@query
def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.clean(spark, sf_dir).withColumn("Fpar", (F.col("k") % 101).cast("double"))
    return _rounded(K.scale_fpar(rows).withColumn("vpd_kpa", F.col("VPD_F") / S.HPA_PER_KPA), "Fpar", "vpd_kpa")


@query
def decode_yyyymmdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer day codes decoded; a day beyond its month's end gives null."""
    stamp = F.year("obs_date") * 10000 + F.month("obs_date") * 100 + F.day("obs_date") + 3
    rows = V.flux(spark, sf_dir).withColumn("stamp", stamp)
    decoded = K.decode_yyyymmdd(F.col("stamp"))
    return rows.select("site", "stamp", F.to_date(decoded).alias("day"), F.hour(decoded).alias("hour"))


@query
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders")
    return K.date_parts(orders, "o_orderdate").groupBy("DATE", "YEAR").agg(F.count(F.lit(1)).alias("n"))


@query
def available_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    energy = P.available_energy(F.col("NETRAD"), F.col("G_F_MDS"))
    return V.clean(spark, sf_dir).select(*KEYS, energy.alias("AE"))


@query
def clamp_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.clean(spark, sf_dir).select(*KEYS, P.wind_floor(F.col("WS_F")).alias("WS_F"))


def _physics(*columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(V.physical(spark, sf_dir), *columns)

    return run


PHYSICS_COLUMNS = {
    "aerodynamic_resistance": ["ra_H", "ga_H"],
    "sat_vapor_pressure": ["esat_air"],
    "sat_vapor_slope": ["Delta"],
    "relative_humidity": ["rha"],
    "specific_humidity": ["q"],
    "air_density": ["density"],
    "latent_heat": ["Lv"],
    "psychrometric_constant": ["gamma"],
    "pet_penman": ["PET_Penman"],
    "pet_priestley_taylor": ["PET_PT"],
    "pet_penman_monteith": ["PET_PM"],
    "surface_conductance": ["Gs_cor_raw"],
    "stress_ratio_raw": ["Penman_stress_cor_raw", "PT_stress_cor_raw", "PM_stress_cor_raw"],
    "frh_inverse": ["Frh_cor"],
    "drh_inverse": ["drh_cor"],
}
REGISTRY |= {name: _physics(*columns) for name, columns in PHYSICS_COLUMNS.items()}


@query
def stress_ratio_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.with_targets(spark, sf_dir), "PT_stress_cor", "Penman_stress_cor", "PM_stress_cor")


@query
def gs_impute_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.with_targets(spark, sf_dir), "Gs_cor", "Gs_log_cor")


@query
def hybrid_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six physical models with their exact parameters: each misses the measured flux by nothing."""
    usable = F.col("Gs_cor_raw").isNotNull() & (F.col("LE_CORR") > 0) & (F.col("AE") > 0)
    rows = store(V.physical(spark, sf_dir), "physical").where(usable)
    exact = {
        "PT_stress_cor_RF": F.col("PT_stress_cor_raw"),
        "Penman_stress_cor_RF": F.col("Penman_stress_cor_raw"),
        "PM_stress_cor_RF": F.col("PM_stress_cor_raw"),
        "Gs_log_cor_RF": F.ln("Gs_cor_raw"),
        "Frh_cor_RF": F.col("Frh_cor"),
        "drh_cor_RF": F.col("drh_cor"),
    }
    forward = add_flux_estimates(rows.withColumns(exact))
    misses = {m.estimate: F.col(m.estimate) - F.col("LE_CORR") for m in HYBRIDS}
    return _rounded(forward.withColumns(misses), *misses, keep=[*KEYS, "LE_CORR"])


@query
def hybrid_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fluxes from the six physical models with estimated parameters."""
    return _rounded(V.scored(spark, sf_dir), *[m.estimate for m in HYBRIDS], keep=[*KEYS, "LE_CORR_RF"])


@query
def igbp_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and rows per land-cover group, with the group's site count in its label."""
    classed = J.add_land_cover(V.flux(spark, sf_dir), V.metadata(spark, sf_dir))
    per_site = classed.groupBy("IGBP2", "site").agg(F.count(F.lit(1)).alias("n"))
    counts = per_site.groupBy("IGBP2").agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("n"))
    return counts.withColumn("label", L.group_with_count(F.col("IGBP2"), F.col("sites")))


@query
def model_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display text of every model of the long scored table, with its row count."""
    long = E.by_model(V.scored(spark, sf_dir))
    return (
        long.groupBy("models").agg(F.count("estimate").alias("n"))
        .withColumn("markup", L.model_markup(F.col("models")))
    )


@query
def metric_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = E.scorecard(V.scored(spark, sf_dir))
    return card.select(
        "models", L.rmse_label(F.col("rmse")).alias("rmse_text"), L.ratio_label(F.col("stdev_ratio")).alias("ratio_text")
    )


# ---------------------------------------------------------------- filters


@query
def filter_date_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.from_date(V.flux(spark, sf_dir), START, "obs_date").select(*KEYS, "k")


@query
def qc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.physical(spark, sf_dir).where(K.quality_ok()), "rha", "LE_F_MDS_QC")


@query
def drop_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.satellite(V.clean(spark, sf_dir))
    return K.drop_incomplete(rows, ["USTAR", "soil_moisture"]).select(*KEYS, "k")


@query
def energy_balance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.clean(spark, sf_dir).where(K.balance_ok()).select(*KEYS, "NETRAD", "LE_CORR", "H_CORR")


@query
def quality_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap fill, then every quality rule."""
    return _rounded(V.analysed(spark, sf_dir), *V.FILLED, keep=[*KEYS, "LE_CORR"])


# ---------------------------------------------------------------- joins and splits


@query
def join_satellite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three left joins on site and day."""
    daily = V.clean(spark, sf_dir)
    sparse = V.satellite(daily)
    products = [sparse.where(F.col(c).isNotNull()).select(*KEYS, c) for c in V.FILLED]
    return _rounded(J.join_satellite(daily, *products, keys=KEYS), *V.FILLED, keep=[*KEYS, "LE_CORR"])


@query
def split_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(V.clean(spark, sf_dir).select(*KEYS), "keys")
    return V.split_rows(rows).select(*KEYS, "split")


@query
def split_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the saved training membership."""
    rows = store(V.clean(spark, sf_dir).select(*KEYS, "k"), "keys")
    path = fresh_path(spark, "membership")
    save_split(V.split_rows(rows), KEYS, path)
    return J.outside_split(rows, read_table(spark, path), "train", KEYS).select(*KEYS, "k")


@query
def split_by_target_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(V.clean(spark, sf_dir).select(*KEYS, "LE_CORR"), "target_rows")
    return split_by_target(rows, "LE_CORR", KEYS).select(*KEYS, "split")


# ---------------------------------------------------------------- windows


@query
def gap_fill_nocb(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_ahead(V.satellite(V.clean(spark, sf_dir)), V.FILLED, order="obs_date", tie=())
    return _rounded(filled, *V.FILLED, *[f"{c}_raw" for c in V.FILLED])


@query
def lead_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next value with the series' last value as default, and that last value itself."""
    rows = V.satellite(V.clean(spark, sf_dir)).select(*KEYS, "soil_moisture", "k")
    led = next_or_last(rows, {"k": "next_k", "soil_moisture": "next_sm"}, order="obs_date")
    return _rounded(series_last(led, "k", "last_k", order="obs_date"), "next_sm", keep=[*KEYS, "next_k", "last_k"])


# ---------------------------------------------------------------- caps


@query
def percentile_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty caps of three ratios from one selection."""
    columns = ["AE", "LE_CORR", *[potential for potential, _, _ in C.RATIO_TARGETS.values()]]
    rows = store(V.analysed(spark, sf_dir).select(*columns), "cap_rows")
    return _rounded(C.percentile_caps(rows), "PT_max", "Penman_max", "PMKc_max", keep=["percentile"])


@query
def gs_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(V.analysed(spark, sf_dir).select("Gs_cor_raw"), "cap_rows")
    return _rounded(C.conductance_caps(rows), "PMgs_max", "PMgs_min", keep=["percentile"])


def _cap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["AE", "LE_CORR", "Gs_cor_raw", *[potential for potential, _, _ in C.RATIO_TARGETS.values()]]
    return store(V.analysed(spark, sf_dir).select(*columns), "cap_rows")


@query
def cap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap table of all four parameters."""
    grid = C.cap_grid(_cap_rows(spark, sf_dir))
    return _rounded(grid, "PT_max", "Penman_max", "PMKc_max", "PMgs_max", "PMgs_min", keep=["percentile"])


@query
def best_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps with the lowest error when a damped, capped parameter predicts the flux."""
    rows = _cap_rows(spark, sf_dir)
    grid = C.cap_grid(rows)
    caps = [row.asDict() for row in grid.collect()]  # one row per percentile
    names = [*[f"{name}_max" for name in C.RATIO_TARGETS], "PMgs_max", "PMgs_min"]
    listed = F.array(*[
        F.struct(F.lit(cap["percentile"]).alias("percentile"), *[F.lit(cap[n]).alias(n) for n in names])
        for cap in caps
    ])
    measured = F.col("LE_CORR")
    modelled = {
        name: F.col(potential) * (0.9 * C.capped_ratio(F.col(f"_{name}"), F.col(f"{name}_max")) + 0.05)
        for name, (potential, _, _) in C.RATIO_TARGETS.items()
    } | {C.CONDUCTANCE: 1000 * C.imputed_conductance(F.col("PMgs_min"), F.col("PMgs_max"))}
    errors = [F.round(stats.rmse(measured, flux), 6).alias(f"{name}_rmse") for name, flux in modelled.items()]
    ratios = {
        f"_{name}": P.flux_ratio(measured, F.col(potential)) for name, (potential, _, _) in C.RATIO_TARGETS.items()
    }
    scores = rows.withColumns(ratios).select("*", F.inline(listed)).groupBy("percentile").agg(*errors)
    best = C.best_caps(grid.join(scores, "percentile"))
    return V.rounded(best, [], best.columns)


# ---------------------------------------------------------------- evaluation


@query
def rows_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rows_per_site(V.flux(spark, sf_dir))


@query
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.head_rows(V.flux(spark, sf_dir).select(*KEYS, "k"), KEYS)


@query
def rmse_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = E.rmse_by_model(V.scored_split(spark, sf_dir), ["split"])
    return _rounded(errors, *[m.short for m in MODELS], keep=["split"])


@query
def rmse_diff_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = E.rmse_difference_rollup(V.classed(spark, sf_dir))
    return _rounded(table, *BY_CODE, keep=["IGBP2", "site", "grain"])


@query
def unpivot_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three grains in long form."""
    table = E.rmse_difference_rollup(V.classed(spark, sf_dir))
    keys = ["IGBP2", "site", "grain"]
    return _rounded(R.wide_to_long(table, keys, list(BY_CODE), "model", "rmse"), "rmse", keep=[*keys, "model"])


@query
def difference_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the overall and the group grain, as drawn over the boxes of the sites."""
    rollup = store(E.rmse_difference_rollup(V.classed(spark, sf_dir)), "rollup")
    return _rounded(E.group_differences(rollup), "rmse", keep=["IGBP2", "model"])


@query
def union_all_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = store(E.rmse_difference_rollup(V.classed(spark, sf_dir)), "rollup")
    return _rounded(E.site_differences(rollup), "rmse", keep=["IGBP2", "site", "model"])


def _site_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = store(E.rmse_difference_rollup(V.classed(spark, sf_dir)), "rollup")
    return store(V.rounded(E.site_differences(rollup), ["IGBP2", "site", "model"], ["rmse"]), "differences")


@query
def boxplot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-plot statistics of the per-site differences per group and model."""
    boxes = boxplot_stats(_site_differences(spark, sf_dir), ["IGBP2", "model"], "rmse")
    # quarters of six-decimal numbers have up to eight decimals
    keep, values = ["IGBP2", "model", "n", "outliers"], ["ymin", "lower", "middle", "upper", "ymax"]
    return V.rounded(boxes, keep, values, digits=9)


@query
def boxplot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites beyond the whiskers."""
    return boxplot_outliers(_site_differences(spark, sf_dir), ["IGBP2", "model"], "rmse")


def _card(column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        test = V.scored_split(spark, sf_dir).where(F.col("split") == "test")
        return _rounded(E.scorecard(test), column, keep=["models"])

    return run


CARD_COLUMNS = {
    "stddev_ratio": "stdev_ratio",
    "mean_bias": "mean_bias",
    "param_r2": "parameter_R2",
    "global_sensitivity": "partial_stdev",
}
REGISTRY |= {name: _card(column) for name, column in CARD_COLUMNS.items()}


@query
def model_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = V.scored_split(spark, sf_dir).where(F.col("split") == "test")
    columns = ["partial_stdev", "stdev_ratio", "mean_bias", "rmse", "parameter_R2"]
    return _rounded(E.scorecard(test), *columns, keep=["models"])


@query
def model_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation over the hybrid models of parameter R2 and error."""
    test = V.scored_split(spark, sf_dir).where(F.col("split") == "test")
    found = E.correlation_test(E.scorecard(test), "parameter_R2", "rmse", drop_models=["Pure-ML"])
    return _rounded(found, "r", "t", "p", keep=["n"])


@query
def extreme_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-site 3 % and 97 % of eight climate variables joined back to every row."""
    rows = store(V.analysed(spark, sf_dir).select(*KEYS, *S.EXTREME_VARIABLES.values()), "climate")
    joined = E.with_thresholds(rows, E.extreme_thresholds(rows, 0.03))
    return _rounded(joined, *S.EXTREME_NAMES)


def _extremes(level: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = V.scored_split(spark, sf_dir)
        table = E.extreme_errors(rows.where(F.col("split") == "test"), E.extreme_thresholds(rows, level), ["S7"])
        return _rounded(table, *S.EXTREME_NAMES, keep=["model"])

    return run


REGISTRY |= {"extreme_eval": _extremes(0.03), "extreme_eval_1pct": _extremes(0.01)}


@query
def extreme_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes per model over the sixteen extremes, at both levels, with the thresholds from one search."""
    rows = V.scored_split(spark, sf_dir)
    test, boxes = rows.where(F.col("split") == "test"), []
    for level, thresholds in E.extreme_thresholds_at(rows, [0.01, 0.03]).items():
        points = store(E.extreme_points(E.extreme_errors(test, thresholds, ["S7"])), "extreme_points")
        boxes.append(boxplot_stats(points, ["model"], "rmse").withColumn("level", F.lit(level)))
    columns = ["ymin", "lower", "middle", "upper", "ymax"]
    return _rounded(boxes[0].unionByName(boxes[1]), *columns, keep=["level", "model", "n", "outliers"])


@query
def model_corr_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of sensitivity and error over the models inside plot limits."""
    test = V.scored_split(spark, sf_dir).where(F.col("split") == "test")
    found = E.correlation_test(E.scorecard(test), "partial_stdev", "rmse", x_range=LIMITS["partial_stdev"], y_range=LIMITS["rmse"])
    return _rounded(found, "r", "t", keep=["n"])


@query
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of three predictors filled with medians of the training rows."""
    rows = V.satellite(V.split_rows(store(V.clean(spark, sf_dir).select("k", *KEYS), "keys")))
    model = MedianImpute(inputCols=V.FILLED).fit(rows.where(F.col("split") == "train"))
    return _rounded(model.transform(rows), *[f"{c}_filled" for c in V.FILLED])


# ---------------------------------------------------------------- forests: what SQL can derive, beside what a fit must earn


def _forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        *KEYS, *S.PREDICTORS_WITH_ENERGY, *[m.target for m in MODELS], "Delta", "density", "NETRAD", "G_F_MDS",
        "VPD_F", "ra_H", "gamma", "esat_air", "PET_PT", "PET_Penman", "PET_PM", "Gs_cor_raw",
        *[raw for _, raw, _ in C.RATIO_TARGETS.values()],
    }
    return V.split_rows(store(V.with_targets(spark, sf_dir).select(*sorted(columns)), "targets"))


def _part(rows: DataFrame, part: str) -> DataFrame:
    return rows.where(F.col("split") == part)


def _forests(trees: int) -> M.ForestSettings:
    """Whole trees: depth, bins and rows of a leaf are the library's own."""
    return M.ForestSettings(trees=trees)


def _sound(value: Column) -> Column:
    """A finite number."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


@query
def rf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven forests, saved, loaded and applied: row counts and spread, and what the fits must earn."""
    rows = store(_forest_rows(spark, sf_dir), "forest_rows")
    fitted = M.fit_all(_part(rows, "train"), settings=_forests(100), parallelism=4)
    folder = fresh_path(spark, "models")
    M.save_models(fitted, folder, 100)
    loaded = M.load_models(folder, 100)
    parts = []
    for m in MODELS:
        target, learnt = F.col(m.target), F.col(m.learned)
        applied = M.predict(loaded[m.target], M.predict(fitted[m.target], rows).withColumnRenamed(m.learned, "_before"))
        train, test = F.col("split") == "train", F.col("split") == "test"
        parts.append(applied.agg(
            F.count(F.when(train, target)).alias("n_train"), F.count(F.when(test, F.lit(1))).alias("n_test"),
            F.round(F.stddev_pop(F.when(train, target)), 6).alias("spread"),
            F.sqrt(F.avg(F.when(train, (target - learnt) * (target - learnt)))).alias("_error"),
            F.stddev_pop(F.when(train, target)).alias("_spread"),
            (F.count_if(learnt.isNull()) == 0).alias("complete"), (F.count_if(learnt != F.col("_before")) == 0).alias("same_when_loaded"),
        ).select(F.lit(m.name).alias("models"), F.lit(m.target).alias("target"), "n_train", "n_test", "spread",
                 (F.col("_error") < F.col("_spread")).alias("learns"), "complete", "same_when_loaded"))
    return reduce(DataFrame.unionByName, parts)


@query
def rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven forests applied to every row: each flux is the physics of its learnt parameter."""
    rows = store(_forest_rows(spark, sf_dir), "forest_rows")
    scored = M.predict_all(M.fit_all(_part(rows, "train"), settings=_forests(100), parallelism=4), rows)
    def near(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= F.lit(1e-9) * (1 + F.abs(b))

    return scored.select(
        *KEYS, "split", "LE_CORR",
        reduce(lambda a, b: a & b, [F.col(m.learned).isNotNull() for m in MODELS]).alias("learnt"),
        near(F.col("LE_CORR_hybrid_PT"), F.col("PT_stress_cor_RF") * F.col("PET_PT")).alias("physics_PT"),
        near(F.col("LE_CORR_hybrid_Penman"), F.col("Penman_stress_cor_RF") * F.col("PET_Penman")).alias("physics_Penman"),
        near(F.col("LE_CORR_hybrid_PMkc"), F.col("PM_stress_cor_RF") * F.col("PET_PM")).alias("physics_PMkc"))


@query
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per quarter of the flux and cross-validation fold."""
    rows = store(_forest_rows(spark, sf_dir).select(*KEYS, "split", "LE_CORR"), "fold_rows")
    train = _part(rows, "train")
    folded = assign_folds(train, "LE_CORR", KEYS, quarter="quarter")
    return folded.groupBy("quarter", "fold").agg(F.count(F.lit(1)).alias("n"))


def _tuned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows, and cross-validated errors of every mtry of every target."""
    train = _part(_forest_rows(spark, sf_dir), "train")
    return train, M.tune_grids(train, {m.target: M.predictors_of(m) for m in MODELS}, KEYS, settings=_forests(100))


@query
def rf_cv_mtry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target and mtry: rows and spread of the target, and whether the forest is closer to it than its mean is."""
    train, tables = _tuned(spark, sf_dir)
    spreads = train.agg(*[F.stddev_pop(m.target).alias(m.target) for m in MODELS], *[F.count(m.target).alias(f"n_{m.target}") for m in MODELS])
    spreads = store(spreads, "spreads")
    return reduce(DataFrame.unionByName, [
        table.crossJoin(spreads).select(  # one row on the right
            F.lit(target).alias("target"), "mtry", F.col(f"n_{target}").alias("n"), F.round(target, 6).alias("spread"),
            (F.col("rmse") < F.col(target)).alias("learns"))
        for target, table in tables.items()
    ])


def _made_mtry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error per mtry from damped residuals, for checking the choice by SQL."""
    rows = _part(V.scored_split(spark, sf_dir), "train")
    observed, guess = F.col("LE_CORR"), F.col("LE_CORR_RF")
    sums = [F.round(stats.rmse(observed, observed + (guess - observed) * (0.5 + 0.1 * abs(m - 6))), 6).alias(f"m{m}") for m in range(1, 10)]
    return store(rows.agg(*sums), "mtry_row").select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("mtry"), F.col(f"m{m}").alias("rmse")) for m in range(1, 10)])))


@query
def best_mtry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice over a made table of errors, and over those of the fits."""
    made = M.best_mtry(_made_mtry(spark, sf_dir)).select(F.lit("made").alias("target"), "mtry", "rmse", F.lit(True).alias("least"))
    parts = [made]
    for target, table in _tuned(spark, sf_dir)[1].items():
        best = M.best_mtry(table).select(F.col("mtry").alias("_mtry"), F.col("rmse").alias("_rmse"))
        checked = table.crossJoin(best).agg((  # one row on the right
            (F.min("rmse") == F.first("_rmse")) & (F.min(F.when(F.col("rmse") == F.col("_rmse"), F.col("mtry"))) == F.first("_mtry"))
        ).alias("least"))
        parts.append(checked.select(
            F.lit(target).alias("target"), F.lit(None).cast("int").alias("mtry"), F.lit(None).cast("double").alias("rmse"), "least"))
    return reduce(DataFrame.unionByName, parts)


@query
def cap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest per parameter and cap, for all twenty caps."""
    rows = store(_forest_rows(spark, sf_dir), "forest_rows")
    swept = M.sweep_caps(_part(rows, "train"), C.cap_grid(rows), KEYS, _forests(100))
    errors = [F.col(f"{name}_rmse") for name in (*C.RATIO_TARGETS, C.CONDUCTANCE)]
    scored = reduce(lambda a, b: a & b, [_sound(e) & (e > 0) for e in errors])
    caps = ["PT_max", "Penman_max", "PMKc_max", "PMgs_max", "PMgs_min"]
    numbered = sinks.number_rows(swept.withColumn("scored", scored).drop(*[f"{n}_rmse" for n in (*C.RATIO_TARGETS, C.CONDUCTANCE)]), ["percentile"])
    return _rounded(numbered, *caps, keep=["row", "percentile", "scored"])


@query
def rmse_by_ntree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-set error of the seven models for forests of 100 and 500 trees."""
    rows = store(_part(_forest_rows(spark, sf_dir), "train"), "forest_rows")
    table = M.rmse_by_trees(rows, {trees: M.fit_all(rows, settings=_forests(trees), parallelism=4) for trees in (100, 500)})
    spread = rows.agg(F.stddev_pop("LE_CORR")).first()[0]
    return table.select(
        "ntree", *[(_sound(F.col(m.short)) & (F.col(m.short) > 0)).alias(m.short) for m in MODELS],
        (F.col("Pure_ML") < spread).alias("learns"))


@query
def rmse_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improvement table from error tables of stand-in estimates.

    Damping a residual stands in for a forest size and for an mtry.
    """
    rows = V.scored_split(spark, sf_dir).where(F.col("split") == "train")
    observed = F.col("LE_CORR")

    def damped(column: str, share: float):
        return F.round(stats.rmse(observed, observed + (F.col(column) - observed) * share), 6)

    pairs = (("Pure_ML", "LE_CORR_RF"), ("H_PMRH_Frh", "LE_CORR_hybrid_PMRH_Frh"))
    sums = [damped(c, s).alias(f"{n}_{t}") for n, c in pairs for t, s in ((100, 1.0), (500, 0.9))]
    sums += [damped("LE_CORR_RF", 0.5 + 0.1 * abs(m - 6)).alias(f"mtry_{m}") for m in range(1, 10)]
    wide = store(rows.agg(*sums), "error_row")
    by_trees = wide.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("ntree"), *[F.col(f"{n}_{t}").alias(n) for n, _ in pairs]) for t in (100, 500)
    ])))
    by_mtry = wide.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("mtry"), F.col(f"mtry_{m}").alias("rmse")) for m in range(1, 10)
    ])))
    return _rounded(E.improvement_table(by_trees, by_mtry), "ImprovementValue", keep=["ImprovementType"])


@query
def rf_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forest fitted twice, from rows dealt out in two ways: how many predictions there are and how many agree."""
    rows = store(_forest_rows(spark, sf_dir), "forest_rows")
    train = _part(rows, "train")
    first, second = (M.fit_forest(side, "LE_CORR", S.PREDICTORS_WITH_ENERGY, 3, _forests(100)) for side in (
        train.repartition(3, "obs_date"), train.repartition(29, "site").sortWithinPartitions("LE_CORR")))
    scored = M.predict(second, M.predict(first, rows).withColumnRenamed("LE_CORR_RF", "_first"))
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("LE_CORR_RF") - F.col("_first")) <= 1e-9).alias("n_equal"))


@query
def rmse_improvement_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improvement table from forests of 100 and 500 trees and from the whole mtry grid: rows and spread, and bounds."""
    rows = store(_part(_forest_rows(spark, sf_dir), "train"), "forest_rows")
    settings, errors = {trees: _forests(trees) for trees in (100, 500)}, {}
    for trees, own in settings.items():  # the two models that the table compares
        for m in (m for m in MODELS if m.short in ("Pure_ML", "H_PMRH_Frh")):
            fitted = M.fit_forest(rows, m.target, M.predictors_of(m), M.TUNED_MTRY[m.target], own)
            error = stats.rmse(m.flux(F.col(m.learned)), F.col("LE_CORR"))
            errors[trees, m.short] = M.predict(fitted, rows).agg(error).first()[0]
    by_trees = spark.createDataFrame(
        [(t, errors[t, "Pure_ML"], errors[t, "H_PMRH_Frh"]) for t in settings], "ntree int, Pure_ML double, H_PMRH_Frh double")
    by_mtry = M.tune_grids(rows, {"LE_CORR": S.PREDICTORS_WITH_ENERGY}, KEYS, settings=_forests(100))["LE_CORR"]
    spread = store(rows.agg(F.count("LE_CORR").alias("n"), F.stddev_pop("LE_CORR").alias("spread")), "spread")
    value = F.col("ImprovementValue")
    return E.improvement_table(by_trees, by_mtry).crossJoin(spread).select(  # one row on the right
        "ImprovementType", "n", F.round("spread", 6).alias("spread"), (F.abs(value) < F.col("spread")).alias("within"),
        F.when(F.col("ImprovementType") == "b", value <= 0).alias("no_worse"))


@query
def oob_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance over out-of-bag rows with a planted driver and a planted noise among the predictors."""
    rows = store(_part(_forest_rows(spark, sf_dir), "train").withColumns({
        "driver": F.col("LE_CORR") * 2 + 1, "noise": F.pmod(F.xxhash64(*KEYS), F.lit(10007)).cast("double")}), "forest_rows")
    names = [*S.PREDICTORS_WITH_ENERGY, "driver", "noise"]
    bags = M.fit_bags(rows, "LE_CORR", names, KEYS, 4, M.ForestSettings(trees=100, depth=5, bins=32))
    found = store(I.out_of_bag_importance(bags, rows, "LE_CORR", names, KEYS), "importance")
    n, increase = rows.count(), F.col("increase")
    top = found.where(F.col("variable") == "driver").select(increase.alias("_top"))
    return found.crossJoin(top).select(  # one row on the right
        "variable", F.lit(n).cast("long").alias("n"), (increase < F.col("_top")).alias("below_driver"),
        F.when(F.col("variable") == "noise", F.abs(increase) < 0.01 * F.col("_top")).alias("noise_is_small"))


def _importance(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Importance of every predictor in each of the seven models."""
    rows = store(_forest_rows(spark, sf_dir), "forest_rows")
    fitted = M.fit_all(_part(rows, "train"), settings=_forests(100), parallelism=4)
    test = _part(rows, "test")
    donors = I.shared_donors(test, {m.target: M.predictors_of(m) for m in MODELS}, KEYS)
    return {
        m.target: I.permutation_importance(fitted[m.target], test, m.target, M.predictors_of(m), KEYS, donors=donors[m.target])
        for m in MODELS
    }


@query
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        table.select(F.lit(target).alias("target"), "variable", _sound(F.col("increase")).alias("measured"))
        for target, table in _importance(spark, sf_dir).items()
    ])


@query
def importance_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and ranks over a made table of importances, and over those of the fits (where ranks must be complete)."""
    rows = _part(V.scored_split(spark, sf_dir), "train")
    means = store(rows.agg(*[F.round(F.avg(c), 6).alias(c) for c in S.PREDICTORS_WITH_ENERGY]), "means")
    made = means.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("Overall")) for c in S.PREDICTORS_WITH_ENERGY])))
    parts = [I.label_importance(made).select(F.lit("made").alias("target"), "variable", "varnames", "category", "place")]
    for target, table in _importance(spark, sf_dir).items():
        ranked = store(I.label_importance(table), "ranked")
        whole = ranked.agg(F.sort_array(F.collect_list("place")).alias("p")).first()["p"] == list(range(1, ranked.count() + 1))
        parts.append(ranked.select(
            F.lit(target).alias("target"), "variable", "varnames", "category", F.lit(None if whole else -1).cast("int").alias("place")))
    return reduce(DataFrame.unionByName, parts)
