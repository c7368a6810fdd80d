"""Deterministic stratified train/test splits.

A row's place is decided by the md5 of its key and a seed, so the split does not
depend on partitioning or on which executor computed it. The share per stratum is
exact: the cut is the hash at rank ceil(fraction * n), found without sorting a
stratum, and rows are then only compared with it. The whole hash counts: it is
compared in two parts, each of which a double holds exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.joins import join_null_safe
from fluxloom.operators.order_stats import ROWS_PER_BUCKET, exact_percentiles, pair_at_rank, spread_percentiles
from fluxloom.storage import store


def hash_place(keys: list[str], seed: int, start: int = 1) -> Column:
    """52 bits of the md5 of ``key|key|...|seed``, from hex digit ``start``, as a double, exact and order-keeping."""
    text = F.concat_ws("|", *[F.col(key).cast("string") for key in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), start, 13), 16, 10).cast("double")


def hash_pair(keys: list[str], seed: int) -> Column:
    """The md5 of ``hash_place`` as two numbers of 52 bits each, compared one after the other."""
    return F.struct(hash_place(keys, seed).alias("v"), hash_place(keys, seed, 14).alias("w"))


def split_stratified(
    df: DataFrame,
    strata: list[str],
    keys: list[str],
    fraction: float = 0.75,
    seed: int = 123,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``split``: ceil(fraction * n) rows of every stratum are ``train``, the rest ``test``.

    ``keys`` identify a row. Rows that share a key share a side.
    """
    place = hash_pair(keys, seed)
    places = store(df.select(*strata, place["v"].alias("v"), place["w"].alias("w")), "places")
    cuts = pair_at_rank(
        places, strata, lambda n: F.array(F.ceil(n * F.lit(fraction)).cast("long") - 1), rows_per_bucket
    ).select(*strata, F.struct("v", "w").alias("_cut"))
    side = F.when(place <= F.col("_cut"), "train").otherwise("test")
    return join_null_safe(df, store(cuts, "cuts"), strata, "left").withColumn("split", side).drop("_cut")


def in_quarter(value: Column, edges: list[float]) -> Column:
    """1-4 by how many of the three edges lie below; null for null."""
    steps = [F.when(value > F.lit(edge), 1).otherwise(0) for edge in edges]
    return F.when(value.isNotNull(), F.lit(1) + steps[0] + steps[1] + steps[2])


def target_quartile(df: DataFrame, target: str, name: str = "stratum") -> DataFrame:
    """Add the quarter of the target's distribution (1-4) a row falls in; null target, null quarter."""
    probs = [0.25, 0.5, 0.75]
    names = {("y", p): f"_q{int(p * 100)}" for p in probs}
    table = spread_percentiles(exact_percentiles(df, [], {"y": F.col(target)}, probs), [], names)
    edges = table.first()
    return df.withColumn(name, in_quarter(F.col(target), [edges[column] for column in names.values()]))


def split_by_target(
    df: DataFrame, target: str, keys: list[str], fraction: float = 0.75, seed: int = 123
) -> DataFrame:
    """Split stratified by the quarters of a numeric target."""
    return split_stratified(target_quartile(df, target), ["stratum"], keys, fraction, seed).drop("stratum")


def save_split(df: DataFrame, keys: list[str], path: str) -> None:
    """Persist split membership, one row per key: rows that share a key share a side."""
    df.select(*keys, "split").distinct().write.parquet(path)


def assign_folds(
    df: DataFrame, target: str, keys: list[str], folds: int = 3, seed: int = 42, rows_per_bucket: int = ROWS_PER_BUCKET,
    quarter: str | None = None,
) -> DataFrame:
    """Add ``fold`` (0-based) for cross-validation, balanced over the quarters of ``target``.

    In each quarter rows are cut into ``folds`` runs of their hash at exact ranks, so
    fold sizes differ by one at most (but for rows that share a key). The quarter is kept
    under the name ``quarter``, if one is given.
    """
    placed = target_quartile(df, target, "_quarter")
    folded = add_folds(placed, ["_quarter"], keys, folds, seed, rows_per_bucket)
    return folded.withColumnRenamed("_quarter", quarter) if quarter else folded.drop("_quarter")


def fold_edges(places: DataFrame, strata: list[str], folds: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``edges`` of each stratum: the ``folds - 1`` hashes (``v``, ``w``) that its runs begin with."""
    def ranks(n: Column) -> Column:
        return F.array(*[F.floor(n * F.lit(k) / F.lit(folds)).cast("long") for k in range(1, folds)])

    found = pair_at_rank(places, strata, ranks, rows_per_bucket).groupBy(*strata).agg(
        F.collect_list(F.struct("rank", F.struct("v", "w").alias("at"))).alias("_at"), F.first("n").alias("n"))
    # two edges at one rank (a stratum of fewer rows than folds) are two edges
    at = F.transform(ranks(F.col("n")), lambda r: F.filter("_at", lambda e: e["rank"] == r)[0]["at"])
    return store(found.select(*strata, at.alias("edges")), "fold_edges")


def in_fold(place: Column, stratum: Column, edges: dict[object, list]) -> Column:
    """0-based fold of a hash by the edges of its stratum, given as values."""
    whens = None
    for value, own in edges.items():
        reached = [F.when(place >= F.struct(F.lit(e["v"]).alias("v"), F.lit(e["w"]).alias("w")), 1).otherwise(0) for e in own]
        fold = sum(reached, F.lit(0))
        whens = F.when(stratum == value, fold) if whens is None else whens.when(stratum == value, fold)
    return F.lit(None).cast("int") if whens is None else whens


def add_folds(
    df: DataFrame, strata: list[str], keys: list[str], folds: int = 3, seed: int = 42, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``fold``: the rows of each stratum in ``folds`` runs of their hash."""
    place = hash_pair(keys, seed)
    places = store(df.select(*strata, place["v"].alias("v"), place["w"].alias("w")), "places")
    fold = F.size(F.filter("edges", lambda edge: edge <= place))
    return join_null_safe(df, fold_edges(places, strata, folds, rows_per_bucket), strata, "left").withColumn("fold", fold).drop("edges")
