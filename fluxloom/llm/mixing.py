"""Mixing sources to target weights, filled to the word by subset sums.

Sources share ``BUDGET`` times all words by weight, none above ``CAP`` times its own words; the excess is shared
again by weight. A document may be taken ``CAP`` times, and reaching a target is a subset-sum problem over exact lengths:

1. documents are counted by (source, length); only these counts reach the solver, one source per group, so its input
   follows the number of distinct lengths and not the number of documents;
2. each length gives its proportional share of copies, rounded down, so the mix keeps the source's spread of lengths;
3. what rounding left over is brought down to ``DP_BUDGET`` words by single copies, longest first, and filled by
   bounded-knapsack dynamic programming over the copies left: bit sets of reachable sums, whose bound is the
   parameter. Where a gap of over a thousandth remains, as with a few long documents, it is tried again with a half,
   a quarter and nothing of the budget given out in proportion, and the nearest result stays;
4. copies of a length go to its documents in equal numbers, and those that remain to the first by a seeded hash. Hash
   ranks are counted per (source, length, hash bucket), at most ``BUCKETS`` numbers for a length in shelves of
   ``SHELF``, so a length shared by a third of all rows is spread over many tasks.

Defined cases: null texts have size 0 and take 0 words; a null source is one source, ordered last; rows equal in id,
source and text are one unit (their lengths add up) and share one decision; an empty table gives an empty result;
input columns travel in one struct, so their names cannot clash. Equal input gives equal output.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm.text import whole, words_of
from fluxloom.storage import store

BUDGET = 1.5
CAP = 2
WEIGHTS = (3, 1, 2)
SEED = 20
DP_BUDGET = 1 << 16
BUCKETS, SHELF = 4096, 64
PLAN = "g_source string, unit_words long, each long, more long"


@dataclass(frozen=True)
class Mix:
    """Share of all words, highest number of passes, weights by rank of source, seed of the choice."""

    budget: float = BUDGET
    cap: int = CAP
    weights: tuple[int, ...] = WEIGHTS
    seed: int = SEED


def sized(docs: DataFrame, carry: list[str], seed: int, doc_id: str = "doc_id") -> DataFrame:
    """``row`` (carried columns), source, words, and the seeded hash that identifies equal rows."""
    text = whole(docs["text"])
    return docs.select(
        F.struct(*[docs[c] for c in carry]).alias("row"), docs["source"].cast("string").alias("g_source"),
        F.size(words_of(docs["text"])).cast("long").alias("words"),
        F.xxhash64(F.lit(seed), docs[doc_id], text).alias("h"),
    )


def source_targets(totals: DataFrame, mix: Mix) -> DataFrame:
    """Target per source. ``totals`` has one row per source, so its windows see no document.

    Sources are ordered by the number of words at which they reach their cap, per unit of weight. The level is that
    of the first source which stays below its cap once all before it are held at theirs.
    """
    rank = F.row_number().over(Window.orderBy(F.col("g_source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), ((rank - 1) % len(mix.weights) + 1).cast("int"))
    capped = totals.withColumn("weight", weight).withColumn("cap", F.col("source_words").cast("double") * mix.cap)
    by_reach = Window.orderBy(F.col("cap") / F.col("weight"), F.col("g_source").asc_nulls_last())
    before = by_reach.rowsBetween(Window.unboundedPreceding, -1)
    after = by_reach.rowsBetween(0, Window.unboundedFollowing)
    all_words = F.sum("source_words").over(Window.partitionBy()).cast("double") * mix.budget
    levels = capped.withColumn(
        "level", (all_words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    )
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(by_reach.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("held", level).select(
        "g_source", "source_words",
        F.least(F.col("cap"), F.coalesce(F.col("held") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def fill(lengths: list[int], counts: list[int], budget: int, dp_budget: int = DP_BUDGET) -> list[int]:
    """How many copies of each length to take so that their words come as near below ``budget`` as possible.

    ``lengths`` are distinct and positive, in any order; ``counts`` are the copies that may be taken.
    """
    best: tuple[int, list[int]] | None = None
    for spread in (budget, budget // 2, budget // 4, 0):
        taken = _filled(lengths, counts, budget, spread, dp_budget)
        gap = budget - sum(n * t for n, t in zip(lengths, taken))
        if best is None or gap < best[0]:
            best = gap, taken
        if best[0] <= max(1, budget // 1000):
            break
    return best[1]


def _filled(lengths: list[int], counts: list[int], budget: int, spread: int, dp_budget: int) -> list[int]:
    """``spread`` words in proportion, the rest by single copies and dynamic programming."""
    total = sum(n * c for n, c in zip(lengths, counts))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    taken = [counts[i] * spread // total if total else 0 for i in range(len(lengths))]
    rest = budget - sum(n * t for n, t in zip(lengths, taken))
    for i in order:
        if rest <= dp_budget:
            break
        more = min(counts[i] - taken[i], -(-(rest - dp_budget) // lengths[i]), rest // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    mask, reached, came_by = (1 << (rest + 1)) - 1, 1, {}
    for i in order:
        layer = reached
        for _ in range(min(counts[i] - taken[i], rest // lengths[i])):
            layer = (layer << lengths[i]) & mask & ~reached
            if not layer:
                break
            reached |= layer
            bits = layer
            while bits:
                low = bits & -bits
                came_by[low.bit_length() - 1] = i
                bits ^= low
        if reached >> rest & 1:
            break
    total = reached.bit_length() - 1
    while total:
        i = came_by[total]
        taken[i] += 1
        total -= lengths[i]
    return taken


def _planner(cap: int):
    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("unit_words")
        lengths, units = [int(x) for x in group["unit_words"]], [int(x) for x in group["units"]]
        wanted = fill(lengths, [cap * n for n in units], int(group["budget"].iloc[0]))
        return pd.DataFrame({
            "g_source": group["g_source"], "unit_words": lengths, "each": [w // n for w, n in zip(wanted, units)],
            "more": [w % n for w, n in zip(wanted, units)]})

    return plan


def _same(left: str, right: str, *keys: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def quotas(units: DataFrame, plan: DataFrame) -> DataFrame:
    """(g_source, unit_words, bucket, left): what is left of ``plan``'s ``more`` units when a bucket's turn comes, if anything.

    Buckets stand on shelves of ``SHELF``: sums over the shelves before, and over the buckets before on the same shelf, so that
    no task has to number all buckets of a frequent length.
    """
    here = units.groupBy("g_source", "unit_words", "bucket").agg(F.count(F.lit(1)).alias("here"))
    here = store(here.alias("b").join(plan.alias("w"), _same("b", "w", "g_source", "unit_words")).select(
        "b.*", "w.more", F.floor(F.col("b.bucket") / SHELF).alias("shelf")), "mix-buckets")

    def earlier(by: str, *keys: str) -> Column:
        rows = Window.partitionBy("g_source", "unit_words", *keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("here").over(rows), F.lit(0))

    shelves = here.groupBy("g_source", "unit_words", "shelf").agg(F.sum("here").alias("here")).withColumn("earlier", earlier("shelf"))
    shelves = store(shelves.drop("here"), "mix-shelves")
    placed = here.withColumn("on_shelf", earlier("bucket", "shelf")).alias("b").join(
        shelves.alias("s"), _same("b", "s", "g_source", "unit_words", "shelf"))
    left = F.col("b.more") - F.col("s.earlier") - F.col("b.on_shelf")
    return placed.select("b.g_source", "b.unit_words", "b.bucket", left.alias("left")).where("left > 0")


def mixed(docs: DataFrame, carry: list[str], mix: Mix = Mix()) -> DataFrame:
    """Every row with its words, its source's words and target, and ``copies``, how often the mix takes it."""
    rows = store(sized(docs, carry, mix.seed), "mix-sizes")
    units = rows.groupBy("g_source", "words", "h").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "unit_words": F.col("n") * F.col("words"), "bucket": F.pmod(F.col("h"), F.lit(BUCKETS)),
    })
    units = store(units, "mix-units")
    totals = units.groupBy("g_source").agg(F.sum("unit_words").alias("source_words"))
    targets = store(source_targets(totals, mix).withColumn("budget", F.round("target").cast("long")).coalesce(1), "mix-targets")
    by_length = units.where("unit_words > 0").groupBy("g_source", "unit_words").agg(F.count(F.lit(1)).alias("units"))
    problem = by_length.alias("c").join(targets.alias("t"), _same("c", "t", "g_source")).select("c.*", "t.budget")
    plan = store(problem.groupBy("g_source").applyInPandas(_planner(mix.cap), PLAN), "mix-plan")

    quota = quotas(units.where("unit_words > 0"), plan.where("more > 0"))
    place = F.row_number().over(Window.partitionBy("u.g_source", "u.unit_words", "u.bucket").orderBy("u.h", "u.words"))
    chosen = store(units.alias("u").join(quota.alias("q"), _same("u", "q", "g_source", "unit_words", "bucket")).select(
        "u.g_source", "u.words", "u.h", "q.left", place.alias("place")).where("place <= left"), "mix-chosen")
    decided = units.alias("u").join(plan.alias("w"), _same("u", "w", "g_source", "unit_words"), "left").join(
        chosen.alias("k"), _same("u", "k", "g_source", "words", "h"), "left"
    ).select("u.g_source", "u.words", "u.h",
             (F.coalesce("w.each", F.lit(0)) + F.col("k.h").isNotNull().cast("long")).alias("copies"))
    decided = store(decided, "mix-copies")
    picked = rows.alias("r").join(decided.alias("k"), _same("r", "k", "g_source", "words", "h")).select("r.*", "k.copies")
    return picked.alias("p").join(targets.alias("t"), _same("p", "t", "g_source"), "left").select(
        "p.row", "p.g_source", "p.words", "t.source_words", "t.target", "p.copies")


def materialised(docs: DataFrame, carry: list[str], mix: Mix = Mix()) -> DataFrame:
    """The mix itself: each carried row as often as it is taken."""
    taken = mixed(docs, carry, mix).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
