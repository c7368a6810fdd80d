"""Other inputs: satellite products, site metadata, intermediate tables, saved models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom import schema as S
from fluxloom.functions.guards import nan_to_null
from fluxloom.operators.clean import satellite_product, scale_fpar
from fluxloom.sources.daily_files import PATH, read_by_name


def read_named_csv(
    spark: SparkSession, path: str, schema: T.StructType, optional: dict[str, T.DataType] | None = None
) -> DataFrame:
    """A CSV file, or a folder of part files, with its columns bound by name."""
    types = {field.name: field.dataType for field in schema.fields}
    df = read_by_name(spark, path, types, optional).drop(PATH)
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({name: nan_to_null(F.col(name)) for name in doubles})


def read_satellite(spark: SparkSession, path: str, product: str) -> DataFrame:
    """One satellite product keyed by (site, DATE); FPAR comes scaled to 0-1.

    The land-cover class may come with any of the products.
    """
    raw = read_named_csv(spark, path, S.SATELLITE_FILES[product], S.LAND_COVER).withColumnRenamed("date", "date_text")
    prepared = satellite_product(raw)
    return scale_fpar(prepared) if product == "Fpar" else prepared


def read_site_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Site id and land-cover class."""
    return read_named_csv(spark, path, S.SITE_METADATA)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """An intermediate table."""
    return spark.read.parquet(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
