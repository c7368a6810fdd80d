"""Permutation importance in percent increase of squared error.

One pass predicts rows that a tree has not seen, with each predictor exchanged in turn: held-out rows, or, for forests
fitted in bags, the rows that a bag did not draw, which the hash of their keys tells. The
exchanged values come from another row of a block: rows are dealt into blocks of a
few thousand by a hash of their key and put into a random order there, and each
row takes the next row's values. Blocks are random subsets of the table, so this
is a random rearrangement of each column without sorting the table in one task.

Errors are averaged per predictor in the same pass as they are made, for ``TREES_AT_ONCE``
trees at a time, so what is shuffled is a row per predictor and task. Rows of forests grown here are not multiplied: a task
exchanges one predictor after the other in its blocks, and asks only the trees that split by it again (all trees, of deep forests).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.forests.deep import DeepForestModel
from fluxloom.forests.models import in_pools, known_together, undrawn_bag
from fluxloom.forests.prepare import FEATURES
from fluxloom.forests.shallow import ShallowForestModel
from fluxloom.operators.splits import hash_pair, hash_place
from fluxloom.storage import store

BLOCK_ROWS = 4096
NONE = "-"
TREES_AT_ONCE = 50


def with_donor(
    df: DataFrame, predictors: Sequence[str], keys: Sequence[str], seed: int, block_rows: int = BLOCK_ROWS,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add ``donor``: the predictors of another row (of the same ``within``), every row giving to exactly one."""
    blocks = max(1, df.count() // block_rows)
    placed = df.withColumns({
        "_block": hash_place(list(keys), seed) % blocks,
        "_order": hash_pair(list(keys), seed + 1),
    })
    ring = Window.partitionBy(*within, "_block").orderBy("_order")
    values = F.struct(*predictors)
    first = F.first(values).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return placed.withColumn("donor", F.coalesce(F.lead(values).over(ring), first)).drop("_block", "_order")


def _variants(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """Every row as it is (``-``) and once per predictor with that predictor exchanged."""
    def variant(exchanged: str):
        values = [F.col(f"donor.{p}" if p == exchanged else p).alias(p) for p in predictors]
        return F.struct(F.lit(exchanged).alias("variable"), *values)

    return df.select(target, F.inline(F.array(*[variant(p) for p in (NONE, *predictors)])))


def _errors_in_tasks(model: PipelineModel, donors: DataFrame, target: str, predictors: Sequence[str], number_from: int) -> DataFrame:
    """``tree_errors`` of a forest grown here: sums per task, of all trees and predictors in one pass."""
    prepare, last = PipelineModel(stages=model.stages[:-1]), model.stages[-1]
    deep = last.exchanged_errors() if isinstance(last, DeepForestModel) else None
    grown = None if deep else last.forests()
    own = prepare.transform(donors.select(F.col(target).cast("double").alias("_y"), *predictors, "donor"))
    both = prepare.transform(own.select("_y", vector_to_array(FEATURES).alias("_own"), "donor.*")).select(
        "_y", "_own", vector_to_array(FEATURES).alias("_given"))
    names = [NONE, *predictors]

    def sums_by_tree(batches):
        for number, errors, n in deep(batches):
            yield pa.RecordBatch.from_pydict({
                "variable": pa.array(names), "tree": pa.array([number_from + number] * len(names), pa.int32()),
                "sum": pa.array(errors), "n": pa.array([n] * len(names), pa.int64())})

    def sums(batches):
        held, n = None, 0
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for errors in grown.exchanged_errors(y, batch.column(1), batch.column(2)):
                held = errors if held is None else held + errors
            n += len(y)
        if n:
            for name, errors in zip(names, held):
                yield pa.RecordBatch.from_pydict({
                    "variable": pa.array([name] * len(errors)), "tree": pa.array(range(number_from, number_from + len(errors)), pa.int32()),
                    "sum": pa.array(errors), "n": pa.array([n] * len(errors), pa.int64())})

    parts = both.mapInArrow(sums_by_tree if deep else sums, "variable string, tree int, sum double, n long")
    return store(parts.groupBy("variable", "tree").agg((F.sum("sum") / F.sum("n")).alias("mse")), "tree_errors")


def tree_errors(model: PipelineModel, donors: DataFrame, target: str, predictors: Sequence[str], number_from: int = 0) -> DataFrame:
    """``tree, variable, mse``: the squared error of every tree, with no predictor (``-``) and with each one exchanged."""
    if isinstance(model.stages[-1], (ShallowForestModel, DeepForestModel)):
        return _errors_in_tasks(model, donors, target, predictors, number_from)
    trees = model.stages[-1].trees
    prepared = PipelineModel(stages=model.stages[:-1]).transform(_variants(donors, target, predictors))
    prepared = prepared.select("variable", F.col(target).alias("_y"), FEATURES)

    def errors_of(first: int) -> DataFrame:
        numbers = range(first, min(first + TREES_AT_ONCE, len(trees)))
        scored = prepared
        for number in numbers:
            scored = trees[number].setFeaturesCol(FEATURES).setPredictionCol(f"_t{number}").transform(scored)
        gaps = {number: F.col("_y") - F.col(f"_t{number}") for number in numbers}
        means = scored.groupBy("variable").agg(*[F.avg(gap * gap).alias(f"_e{number}") for number, gap in gaps.items()])
        entries = [F.struct(F.lit(number_from + number).alias("tree"), F.col(f"_e{number}").alias("mse")) for number in numbers]
        return store(means.select("variable", F.inline(F.array(*entries))), "tree_errors")

    return reduce(DataFrame.unionByName, [errors_of(first) for first in range(0, len(trees), TREES_AT_ONCE)])


def importance_of(errors: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """``variable, Overall, increase`` of trees' errors: mean increase over trees, in standard errors of that mean and as it is."""
    increases = errors.groupBy("tree").pivot("variable", [NONE, *predictors]).agg(F.first("mse"))
    long = increases.select("tree", *[(F.col(p) - F.col(NONE)).alias(p) for p in predictors]).unpivot(
        ["tree"], list(predictors), "variable", "increase"
    )
    deviation = F.stddev_samp("increase") / F.sqrt(F.count(F.lit(1)))
    mean = F.avg("increase")
    return long.groupBy("variable").agg(F.try_divide(mean, deviation).alias("Overall"), mean.alias("increase"))


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    target: str,
    predictors: Sequence[str],
    keys: Sequence[str],
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
    donors: DataFrame | None = None,
) -> DataFrame:
    """Importance of every predictor over ``df``, which should be rows the forest was not fitted on.

    ``donors`` are the rows of ``shared_donors``, if several models are measured.
    """
    if donors is None:
        donors = store(with_donor(df.where(F.col(target).isNotNull()), predictors, keys, seed, block_rows), "donors")
    return importance_of(tree_errors(model, donors, target, predictors), predictors)


def shared_donors(
    df: DataFrame, targets: dict[str, Sequence[str]], keys: Sequence[str], seed: int = 42, block_rows: int = BLOCK_ROWS
) -> dict[str, DataFrame]:
    """Rows with their donors for every target (and its predictors): one stored table for targets that are known in the same rows."""
    found = {}
    for group in known_together(df, list(targets)):
        predictors = list(dict.fromkeys(p for t in group for p in targets[t]))
        columns = dict.fromkeys([*keys, *group, *predictors])
        rows = df.where(F.col(group[0]).isNotNull()).select(*columns)
        found |= dict.fromkeys(group, store(with_donor(rows, predictors, keys, seed, block_rows), "donors"))
    return found


def out_of_bag_importance(
    bags: Sequence[PipelineModel],
    train: DataFrame,
    target: str,
    predictors: Sequence[str],
    keys: Sequence[str],
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
    parallelism: int = 4,
) -> DataFrame:
    """Importance over the rows that each bag of ``fit_bags`` (with this seed) has not drawn, exchanged among themselves."""
    unseen = F.array_compact(F.array(*[undrawn_bag(keys, b, seed) for b in range(len(bags))]))
    known = train.where(F.col(target).isNotNull()).select(*dict.fromkeys([*keys, target, *predictors]), unseen.alias("_bags"))
    rows = store(known, "unseen_rows").select(*dict.fromkeys([*keys, target, *predictors]), F.explode("_bags").alias("_bag"))
    donors = store(with_donor(rows, predictors, keys, seed, block_rows, ["_bag"]), "donors")
    each = bags[0].stages[-1].getNumTrees
    parts = in_pools(train.sparkSession, [
        lambda b=b, m=m: tree_errors(m, donors.where(F.col("_bag") == b), target, predictors, b * each) for b, m in enumerate(bags)
    ], parallelism)
    return importance_of(reduce(DataFrame.unionByName, parts), predictors)


def label_importance(importance: DataFrame) -> DataFrame:
    """Add the display name, family and rank (1 = most important) of each predictor."""
    entries = [F.struct(F.lit(v).alias("v"), F.lit(n).alias("varnames"), F.lit(c).alias("category"))
               for v, (n, c) in S.PREDICTOR_LABELS.items()]
    match = F.filter(F.array(*entries), lambda entry: entry["v"] == F.col("variable"))[0]
    place = F.row_number().over(Window.orderBy(F.desc("Overall"), "varnames"))
    return importance.select(
        "variable", "Overall", match["varnames"].alias("varnames"), match["category"].alias("category")
    ).withColumn("place", place)
