"""Row-based look-ahead within a site's daily series.

A window over a whole site would put the site into one task. Looking only a few
rows ahead needs no more than a block of the series and the first rows of what
follows, so the series is cut into blocks of days: almost every row is answered
inside its block, and only the last rows of each block look across its edge, in a
second window that sees nothing but the first and last few rows of the blocks.

Rows of one day are put in order by a hash of all their columns: every window sees
one total order, whatever order the rows arrive in, so none is lost or doubled where
a block ends within a day. Only days that hold more than one row get that hash, so
that elsewhere no column is computed or carried that the result does not need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fluxloom.operators.joins import join_null_safe
from fluxloom.storage import store

BLOCK_DAYS = 256


def with_tie(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] | None = None) -> DataFrame:
    """Add ``_tie``, which orders the rows of one key and day.

    ``tie`` names columns that tell such rows apart; an empty one says that there are none. By default the days
    with several rows are looked up, and only their rows get a hash of all columns.
    """
    if tie is not None:
        return df.withColumn("_tie", F.xxhash64(*tie) if tie else F.lit(0).cast("long"))
    day = [*keys, order]
    repeated = store(df.groupBy(*day).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*day), "repeated_days")
    if repeated.isEmpty():
        return df.withColumn("_tie", F.lit(0).cast("long"))
    alone, several = (join_null_safe(df, repeated, day, how) for how in ("left_anti", "left_semi"))
    return alone.withColumn("_tie", F.lit(0).cast("long")).unionByName(several.withColumn("_tie", F.xxhash64(*df.columns)))


def look_ahead(
    df: DataFrame,
    keys: list[str],
    order: str,
    rows: int,
    make: Callable[[WindowSpec], dict[str, Column]],
    block_days: int = BLOCK_DAYS,
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """Add the columns ``make(window)`` builds from the current and up to ``rows`` following rows.

    ``make`` gets a window ordered by ``order`` (a date or timestamp) and may use
    any frame between the current row and ``rows`` rows ahead. Both branches of the
    union read one shuffle by block; give denser series (many rows a day) fewer days
    per block. ``tie``: see ``with_tie``.
    """
    block = F.floor(F.datediff(F.col(order), F.lit("1970-01-01").cast("date")) / block_days)
    in_block, total = Window.partitionBy(*keys, "_block"), [order, "_tie"]
    placed = (
        with_tie(df, keys, order, tie).withColumn("_block", block)
        .withColumn("_first", F.row_number().over(in_block.orderBy(*total)))
        .withColumn("_after", F.count(F.lit(1)).over(in_block) - F.col("_first"))
    )
    reaches_edge = F.col("_after") < rows
    inner = placed.withColumns(make(in_block.orderBy(*total))).where(~reaches_edge)
    edges = (
        placed.where((F.col("_first") <= rows) | reaches_edge)
        .withColumns(make(Window.partitionBy(*keys).orderBy(*total)))
        .where(reaches_edge)
    )
    return inner.unionByName(edges).drop("_block", "_first", "_after", "_tie")


def fill_ahead(
    df: DataFrame,
    columns: list[str],
    keys: tuple[str, ...] = ("site",),
    order: str = "DATE",
    max_gap: int = 4,
    block_days: int = BLOCK_DAYS,
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """Fill gaps with the next observation at most ``max_gap`` rows ahead.

    The unfilled value stays beside it as ``<column>_raw``.
    """

    def make(window: WindowSpec) -> dict[str, Column]:
        reach = window.rowsBetween(0, max_gap)
        raw = {f"{name}_raw": F.col(name) for name in columns}
        return raw | {name: F.first(name, ignorenulls=True).over(reach) for name in columns}

    return look_ahead(df, list(keys), order, max_gap, make, block_days, tie)


def next_or_last(
    df: DataFrame,
    names: dict[str, str],
    keys: tuple[str, ...] = ("site",),
    order: str = "DATE",
    block_days: int = BLOCK_DAYS,
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """Next row's value of each column, under the name given for it; on the last row of a series its own value.

    All columns are answered in one pass.
    """

    def make(window: WindowSpec) -> dict[str, Column]:
        is_last = F.lead(F.lit(1)).over(window).isNull()
        return {new: F.when(is_last, F.col(old)).otherwise(F.lead(old).over(window)) for old, new in names.items()}

    return look_ahead(df, list(keys), order, 1, make, block_days, tie)


def series_last(
    df: DataFrame, column: str, name: str, keys: tuple[str, ...] = ("site",), order: str = "DATE",
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """Value of a series' last row on every row, null if that row has none.

    An aggregate and a join instead of a window over the whole series.
    """
    newest = F.max_by(F.struct(F.col(column)), F.struct(F.col(order), F.col("_tie")))[column]
    last = store(with_tie(df, keys, order, tie).groupBy(*keys).agg(newest.alias(name)), "series_last")
    return join_null_safe(df, last, list(keys), "left")
