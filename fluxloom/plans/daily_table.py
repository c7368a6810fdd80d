"""From site files and satellite products to the analysed daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxloom.operators.clean import add_physics, date_parts, quality_control
from fluxloom.operators.joins import join_satellite
from fluxloom.operators.lookahead import fill_ahead
from fluxloom.sources.daily_files import read_daily_sites
from fluxloom.sources.sinks import write_table
from fluxloom.sources.tables import read_satellite, read_table

FILLED = ["soil_moisture", "VegWC", "Fpar"]


def merge_daily(spark: SparkSession, folder: str, start: str | None = "2015-04-01") -> DataFrame:
    """Stacked site files with all derived columns."""
    return add_physics(read_daily_sites(spark, folder, start))


def analysed(daily: DataFrame, *products: DataFrame, max_gap: int = 4) -> DataFrame:
    """Join the satellite products, fill short gaps, then apply quality control."""
    joined = join_satellite(date_parts(daily), *products)
    return quality_control(fill_ahead(joined, FILLED, max_gap=max_gap))


def build_daily_table(
    spark: SparkSession,
    site_folder: str,
    satellite_paths: dict[str, str],
    output: str,
    start: str | None = "2015-04-01",
) -> DataFrame:
    """Run the whole preparation; writes ``<output>/merged`` and ``<output>/filtered``."""
    write_table(merge_daily(spark, site_folder, start), f"{output}/merged")
    merged = read_table(spark, f"{output}/merged")
    products = [read_satellite(spark, path, name) for name, path in satellite_paths.items()]
    write_table(analysed(merged, *products), f"{output}/filtered", partition_by=["YEAR"])
    return read_table(spark, f"{output}/filtered")
