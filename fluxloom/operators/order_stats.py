"""Exact order statistics and percentiles that no single task has to hold.

``percentile`` keeps every distinct value of a group in one buffer, and a ranking
window sorts a whole group in one task; neither works when one site, or the whole
table, is the group. Here a wanted rank is narrowed down instead:

1. count, minimum and maximum per group (partial aggregation);
2. while a wanted rank lies in a range with many rows: count the rows of that range
   in up to 65,536 sub-ranges and keep the one that holds the rank;
3. order only the distinct values left in the kept ranges.

Each pass is a scan with map-side combining; what is shuffled are counts, and only
the counts of the last pass go through a window. Step 2 repeats until a kept range
has few rows or one value, so that window sees a few thousand values per range,
however big a group is. Every count is exact, and so is the result, whatever the
distribution; its shape only decides how many rounds are needed (none for groups of
a few thousand rows, most often one, a second one for groups of many millions).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.functions.guards import nan_to_null
from fluxloom.operators.joins import join_null_safe
from fluxloom.storage import store

MAX_BUCKETS = 1 << 16
ROWS_PER_BUCKET = 256
ENOUGH = 16  # a kept range of up to this many buckets' rows is ordered without another round
_LIMIT = 1.7e308

Ranks = Callable[[Column], Column]


def _log_scale(v: Column) -> Column:
    size = F.log1p(F.abs(v))
    return F.when(v < 0, -size).otherwise(size)


def _linear_scale(v: Column) -> Column:
    return v / 2


def _bucket(v: Column, lo: Column, hi: Column, rows: Column, scale, rows_per_bucket: int) -> Column:
    """Sub-range of ``[lo, hi]`` that ``v`` falls in; never decreases as ``v`` grows."""
    finite = [F.when(x > _LIMIT, _LIMIT).when(x < -_LIMIT, -_LIMIT).otherwise(x) for x in (v, lo, hi)]
    at, start, end = (scale(x) for x in finite)
    share = F.coalesce(F.try_divide(at - start, end - start), F.lit(0.0))
    buckets = F.least(F.lit(MAX_BUCKETS), F.ceil(rows / rows_per_bucket))
    return F.least(buckets - 1, F.floor(share * buckets)).cast("int")


def _running_start(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Rank of the first row of each entry, counted from the start of its range."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", F.col("_base") + F.coalesce(F.sum("_rows").over(window), F.lit(0)))


def _holding_rank(wanted: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    here = (F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + F.col("_rows"))
    return join_null_safe(wanted, entries, [*keys, "_lo", "_hi"], where=here)


def value_at_rank(
    rows: DataFrame,
    keys: list[str],
    ranks: Ranks | DataFrame,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Values at given ranks of the column ``v`` within each group.

    ``ranks(n)`` gives an array of zero-based ranks for a group of n rows; a table has the
    keys and ``rank``. ``v`` is a double without nulls or NaN. The result is a stored table
    of the keys, ``n``, ``rank``, ``v`` and ``first`` (the lowest rank that has the value):
    one row per group and rank. ``rows`` is scanned twice, and
    once more for each narrowing round that a big group needs; pass a stored frame
    when it is costly to compute.
    """
    group = [*keys, "_lo", "_hi"]
    sizes = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        .where(F.col("n") > 0)
        .withColumns({"_base": F.lit(0).cast("long"), "_size": F.col("n")})
    )
    if isinstance(ranks, DataFrame):
        wanted = store(join_null_safe(sizes, ranks.select(*keys, "rank").distinct(), keys), "ranks")
    else:
        wanted = store(sizes.withColumn("rank", F.explode(F.array_distinct(ranks(F.col("n"))))), "ranks")
    inside = (F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi"))
    scale, before = _log_scale, None
    while True:
        wide = (F.col("_size") > ENOUGH * rows_per_bucket) & (F.col("_lo") < F.col("_hi"))
        ranges = wanted.where(wide).select(*group, "_base", "_size").distinct()
        now = ranges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_lo", "_hi", "_size").cast("decimal(38,0)"))).first()
        if not now[0]:
            break
        if now == before:
            raise ArithmeticError("values of a range are too close to the largest double to be told apart")
        before = now
        bucket = _bucket(F.col("v"), F.col("_lo"), F.col("_hi"), F.col("_size"), scale, rows_per_bucket)
        counts = (
            join_null_safe(rows, ranges, keys, where=inside)
            .groupBy(*group, "_base", bucket.alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("_rows"), F.min("v").alias("_from"), F.max("v").alias("_to"))
        )
        entries = _running_start(counts, group, "_bucket").drop("_base", "_bucket")
        narrowed = _holding_rank(wanted.where(wide).drop("_base", "_size"), entries, keys).select(
            *keys, "n", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"),
            F.col("_start").alias("_base"), F.col("_rows").alias("_size"), "rank",
        )
        wanted = store(wanted.where(~wide).unionByName(narrowed), "ranks")
        scale = _linear_scale

    ranges = wanted.select(*group, "_base").distinct()
    counts = (
        join_null_safe(rows, ranges, keys, where=inside)
        .groupBy(*group, "_base", "v")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    entries = _running_start(counts, group, "v").drop("_base")
    return store(_holding_rank(wanted, entries, keys).select(*keys, "n", "rank", "v", F.col("_start").alias("first")), "rank_values")


def pair_at_rank(rows: DataFrame, keys: list[str], ranks: Ranks, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Pairs (``v``, ``w``) at given ranks of each group, ordered by ``v`` and then ``w``: keys, ``n``, ``rank``, ``v``, ``w``.

    For values of more bits than a double holds, in two parts. Ranks are found over
    ``v``; only among rows that share the ``v`` of a wanted rank, and differ in ``w``,
    the rest of the rank is found over ``w``.
    """
    found = value_at_rank(rows.drop("w"), keys, ranks, rows_per_bucket)
    group = [*keys, "v"]
    shared = join_null_safe(rows, found.select(*group).distinct(), group).groupBy(*group).agg(
        F.min("w").alias("_low"), F.max("w").alias("w"))
    shared = store(shared, "rank_pairs")
    settled = join_null_safe(found, shared.where(F.col("_low") == F.col("w")).drop("_low"), group).select(*keys, "n", "rank", "v", "w")
    torn = shared.where(F.col("_low") < F.col("w")).select(*group)
    if torn.isEmpty():
        return settled
    open_ = store(join_null_safe(found, torn, group, "left_semi"), "torn_ranks")
    part = [*keys, "_v"]
    tied = store(join_null_safe(rows, torn, group).withColumnRenamed("v", "_v").select(*part, F.col("w").alias("v")), "torn_rows")
    inner = open_.withColumnRenamed("v", "_v").select(*part, (F.col("rank") - F.col("first")).alias("rank"))
    values = value_at_rank(tied, part, inner, rows_per_bucket).select(*part, F.col("rank").alias("_inner"), F.col("v").alias("w"))
    rest = open_.withColumnRenamed("v", "_v").withColumn("_inner", F.col("rank") - F.col("first"))
    return settled.unionByName(join_null_safe(rest, values, [*part, "_inner"]).select(*keys, "n", "rank", F.col("_v").alias("v"), "w"))


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    probabilities: Iterable[float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Linearly interpolated percentiles (the usual default definition) per group.

    Returns the keys, ``variable``, ``prob``, ``n`` and ``value``; nulls and NaN do
    not count. A group without any value of a variable has no row for it.
    """
    probs = [float(p) for p in probabilities]
    entries = [F.struct(F.lit(name).alias("variable"), value.alias("v")) for name, value in values.items()]
    rows = (
        df.select(*keys, F.inline(F.array(*entries)))
        .withColumn("v", nan_to_null(F.col("v").cast("double")))
        .where(F.col("v").isNotNull())
    )
    group = [*keys, "variable"]

    def ranks(n: Column) -> Column:
        positions = [(n - 1) * F.lit(p) for p in probs]
        return F.array(*[f(x).cast("long") for x in positions for f in (F.floor, F.ceil)])

    at_rank = value_at_rank(rows, group, ranks, rows_per_bucket)
    position = (F.col("n") - 1) * F.col("prob")
    below, above = F.floor(position), F.ceil(position)
    share = position - below
    return (
        at_rank.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
        .groupBy(*group, "prob", "n")
        .agg(
            F.max(F.when(F.col("rank") == below, F.col("v"))).alias("_low"),
            F.max(F.when(F.col("rank") == above, F.col("v"))).alias("_high"),
        )
        .select(
            *group, "prob", "n",
            F.when(F.col("_low") == F.col("_high"), F.col("_low"))
            .otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * share)
            .alias("value"),
        )
    )


def spread_percentiles(percentiles: DataFrame, keys: list[str], names: dict[tuple[str, float], str]) -> DataFrame:
    """One row per group; ``names`` maps (variable, probability) to a column name."""
    return percentiles.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("variable") == variable) & (F.col("prob") == prob), F.col("value"))).alias(name)
            for (variable, prob), name in names.items()
        ]
    )
