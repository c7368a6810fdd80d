"""Daily site files: find, gate, read and stack.

Site files differ in column order and content, and there may be very many of them. Spark lists them; one scan of
lines keeps only those that name every required column, so a table of (path, header) is left in which a file
without a required column has no row. The driver sees the distinct headers, not files. Cells are then read as text
by place in one scan, and joined to the table of files by their input path, which tells the header and so the
place of every column.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom import schema as S
from fluxloom.operators.clean import decode_yyyymmdd, from_date, sentinel_to_null
from fluxloom.storage import store

READ_OPTIONS = {"header": "false", "nullValue": "NA", "mode": "PERMISSIVE", "recursiveFileLookup": "true"}
BYTE_ORDER_MARK = "\ufeff"
PATH = "_path"


def source_name(path: Column, mark: str = S.DAILY_FILE_MARK) -> Column:
    """The marked part of a path: a file's own name, or its folder's. A site may be a folder of part files."""
    return F.regexp_extract(path, rf"([^/=]*{mark}[^/]*)", 1)


def site_from_path(path: Column, mark: str = S.DAILY_FILE_MARK) -> Column:
    """Site id: fixed characters of the marked file (or folder) name."""
    return F.nullif(F.substring(source_name(path, mark), S.SITE_NAME_START, S.SITE_NAME_LENGTH), F.lit(""))


def split_header(line: str) -> tuple[str, ...]:
    """Column names in a header line."""
    return tuple(name.strip() for name in next(csv.reader([line.lstrip(BYTE_ORDER_MARK)]), []))


def passes_gate(header: Sequence[str], required: Sequence[str]) -> bool:
    """A file is kept only if it has every required column."""
    return set(required) <= set(header)


def gated_files(spark: SparkSession, path: str, required: Sequence[str], mark: str | None = None) -> DataFrame:
    """Stored table of ``_path`` and ``header``: the first line, of each file below ``path``, that names all required columns.

    With ``mark`` only files count whose own name, or whose folder's name, contains it.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias("_start"))
    if mark:
        lines = lines.where(F.col(PATH).rlike(rf"{mark}[^/]*(/[^/]*)?$"))
    named = reduce(lambda a, b: a & b, [F.contains("value", F.lit(name)) for name in required])
    placed = lines.where(named).withColumn("_line", F.monotonically_increasing_id())
    return store(placed.groupBy(PATH).agg(F.min_by("value", F.struct("_start", "_line")).alias("header")), "files")


def read_by_name(
    spark: SparkSession,
    path: str,
    types: dict[str, T.DataType],
    optional: dict[str, T.DataType] | None = None,
    mark: str | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """CSV files below ``path`` read by column name in one scan: the columns of ``types``, and ``_path``.

    ``optional`` columns are read where a header has them, null in files without, and left out if no header has
    them. Other columns are not parsed. ``files``: what ``gated_files`` found there, if it is known.
    """
    files = gated_files(spark, path, list(types), mark) if files is None else files
    lines = [row["header"] for row in files.select("header").distinct().orderBy("header").collect()]
    layouts = {line: split_header(line) for line in lines if passes_gate(split_header(line), list(types))}
    if not layouts:
        raise ValueError("no file has all required columns")
    optional = {name: kind for name, kind in (optional or {}).items() if any(name in names for names in layouts.values())}
    width = max(map(len, layouts.values()))
    cells = spark.read.options(**READ_OPTIONS).schema(", ".join(f"`_c{i}` string" for i in range(width))).csv(path)
    cells = cells.select("*", F.col("_metadata.file_path").alias(PATH)).join(
        files.where(F.col("header").isin(list(layouts))), PATH)

    def text(name: str) -> Column:
        """The cell of a column, at its place in the file's header."""
        places: dict[int, list[str]] = {}
        for line, names in layouts.items():
            if name in names:
                places.setdefault(names.index(name), []).append(line)
        if len(places) == 1 and all(name in names for names in layouts.values()):
            return F.col(f"_c{next(iter(places))}")
        whens = [(F.col("header").isin(own), F.col(f"_c{place}")) for place, own in places.items()]
        return reduce(lambda out, x: out.when(*x), whens[1:], F.when(*whens[0]))

    is_header = reduce(lambda a, b: a & b, [
        F.coalesce(F.trim(F.ltrim(text(name), F.lit(BYTE_ORDER_MARK))) == name, F.lit(False)) for name in types])
    return cells.where(~is_header).select(
        *[text(name).try_cast(kind).alias(name) for name, kind in (types | optional).items()], PATH)


def merge_identical(df: DataFrame, file_column: str = "_file") -> DataFrame:
    """Stack files by a full join on all columns, nulls equal.

    A row that several files share appears once; if files repeat it within
    themselves, the counts multiply as they do in that join.
    """
    columns = [c for c in df.columns if c != file_column]
    within = df.groupBy(*columns, file_column).agg(F.count(F.lit(1)).alias("_rows"))
    times = within.groupBy(*columns).agg(F.round(F.product("_rows")).cast("int").alias("_times"))
    return times.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).drop("_copy")


def stack_sites(df: DataFrame, files: DataFrame | None = None, file_column: str = "_file") -> DataFrame:
    """Union of the site files with the merge rule for sites that have more than one.

    A site with a single file shares no row with another file, so only sites with more
    than one entry in ``files`` (``site``, file name) are merged; without it any site
    may be shared.
    """
    if files is None:
        return merge_identical(df, file_column)
    per_site = files.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    shared = store(per_site.where(F.col("n") > 1).select("site"), "shared_sites")
    alone = df.join(shared, "site", "left_anti").select(*df.columns).drop(file_column)
    return alone.unionByName(merge_identical(df.join(shared, "site", "left_semi").select(*df.columns), file_column))


def read_daily_sites(
    spark: SparkSession,
    folder: str,
    start: str | None = "2015-04-01",
    measured: Sequence[str] = S.MEASURED,
    mark: str = S.DAILY_FILE_MARK,
) -> DataFrame:
    """All gated site files as one daily table: ``site, PDATE`` and the measured columns."""
    types: dict[str, T.DataType] = {"TIMESTAMP": T.IntegerType()}
    types |= {name: T.DoubleType() for name in measured}
    files = gated_files(spark, folder, list(types), mark)
    raw = read_by_name(spark, folder, types, files=files).withColumns(
        {"site": site_from_path(F.col(PATH), mark), "_file": source_name(F.col(PATH), mark)})
    dated = sentinel_to_null(raw.drop(PATH)).withColumn("PDATE", decode_yyyymmdd(F.col("TIMESTAMP")))
    if start:
        dated = from_date(dated, start, "PDATE")
    listed = files.select(site_from_path(F.col(PATH), mark).alias("site"), source_name(F.col(PATH), mark).alias("file")).distinct()
    return stack_sites(dated.select("site", "PDATE", *measured, "_file"), listed)
