from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import splits
from fluxloom.operators.lookahead import fill_ahead, next_or_last, series_last
from fluxloom.operators.splits import assign_folds, split_by_target, split_stratified

START = datetime.date(2015, 4, 1)


def series(seed=5):
    """Two sites, irregular days, gaps of every length, trailing gaps."""
    rng = random.Random(seed)
    rows = []
    for site in ("A", "B"):
        day = START
        for _ in range(160):
            day += datetime.timedelta(days=rng.choice([1, 1, 1, 2, 40]))
            rows.append((site, day, rng.random() if rng.random() < 0.3 else None, rng.randrange(100)))
    return rows


def literal_fill(values, passes=4):
    for _ in range(passes):
        ahead = values[1:] + [values[-1]]
        values = [a if v is None else v for v, a in zip(values, ahead)]
    return values


@pytest.mark.parametrize("block_days", [1, 3, 64, 100000])
def test_fill_equals_four_passes(spark, block_days):
    rows = series()
    df = spark.createDataFrame(rows, "site string, DATE date, x double, k int").repartition(5)
    got = {(r["site"], r["DATE"]): r for r in fill_ahead(df, ["x"], block_days=block_days).collect()}
    assert len(got) == len(rows)
    for site in ("A", "B"):
        own = [r for r in rows if r[0] == site]
        for (name, day, raw, _), want in zip(own, literal_fill([r[2] for r in own])):
            assert got[(name, day)]["x"] == want
            assert got[(name, day)]["x_raw"] == raw


@pytest.mark.parametrize("block_days", [1, 7, 100000])
def test_next_or_last(spark, block_days):
    rows = series(8)
    df = spark.createDataFrame(rows, "site string, DATE date, x double, k int")
    led = series_last(next_or_last(df, {"x": "ahead"}, block_days=block_days), "x", "final")
    got = {(r["site"], r["DATE"]): r for r in led.collect()}
    for site in ("A", "B"):
        own = [r for r in rows if r[0] == site]
        for this, following in zip(own, own[1:] + [own[-1]]):
            assert got[this[:2]]["ahead"] == following[2]
            assert got[this[:2]]["final"] == own[-1][2]


def keyed(spark):
    rows = [("hot", i, float(i % 97)) for i in range(900)] + [("cold", i, float(i)) for i in range(7)] + [("one", 1, 2.0)]
    return spark.createDataFrame(rows, "site string, k int, y double")


def test_split_is_exact_per_site_and_stable(spark):
    df = keyed(spark)
    split = split_stratified(df, ["site"], ["site", "k"], rows_per_bucket=16)
    counts = {(r["site"], r["split"]): r["count"] for r in split.groupBy("site", "split").count().collect()}
    assert counts == {("hot", "train"): 675, ("hot", "test"): 225, ("cold", "train"): 6, ("cold", "test"): 1, ("one", "train"): 1}
    again = split_stratified(df.repartition(3), ["site"], ["site", "k"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))


def test_split_by_target_covers_every_quarter(spark):
    split = split_by_target(keyed(spark), "y", ["site", "k"])
    assert split.count() == 908
    share = split.where("split = 'train'").count() / 908
    assert 0.75 <= share < 0.76


def test_folds_are_balanced_over_the_target(spark):
    rows = assign_folds(keyed(spark), "y", ["site", "k"], rows_per_bucket=16).collect()
    assert len(rows) == 908 and {r["fold"] for r in rows} == {0, 1, 2}
    edges = np.percentile([r["y"] for r in rows], [25, 50, 75])
    for quarter in range(4):
        sizes = [sum(int((r["y"] > edges).sum()) == quarter and r["fold"] == f for r in rows) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("block_days", [1, 2, 5])
@pytest.mark.parametrize("parts", [1, 5])
def test_rows_of_one_day_are_neither_lost_nor_doubled(spark, block_days, parts):
    start = datetime.date(2000, 1, 1)
    rows = [("A", start + datetime.timedelta(days=i // 4), float(i) if i % 5 else None, i) for i in range(120)]
    df = spark.createDataFrame(rows, "site string, DATE date, x double, k int").repartition(parts)
    filled = fill_ahead(df, ["x"], block_days=block_days).collect()
    assert sorted(r["k"] for r in filled) == list(range(120))
    again = fill_ahead(df.repartition(3, "k"), ["x"], block_days=block_days).collect()
    assert sorted((r["k"], r["x"]) for r in filled) == sorted((r["k"], r["x"]) for r in again)


def test_rows_whose_first_hash_half_ties_are_still_cut_exactly(spark, monkeypatch):
    whole = splits.hash_place
    monkeypatch.setattr(splits, "hash_place", lambda keys, seed, start=1: F.lit(1.0) if start == 1 else whole(keys, seed, start))
    split = split_stratified(keyed(spark), ["site"], ["site", "k"], rows_per_bucket=16)
    counts = {(r["site"], r["split"]): r["count"] for r in split.groupBy("site", "split").count().collect()}
    assert counts == {("hot", "train"): 675, ("hot", "test"): 225, ("cold", "train"): 6, ("cold", "test"): 1, ("one", "train"): 1}


def test_folds_whose_first_hash_half_ties_are_still_cut_exactly(spark, monkeypatch):
    whole = splits.hash_place
    monkeypatch.setattr(splits, "hash_place", lambda keys, seed, start=1: F.lit(1.0) if start == 1 else whole(keys, seed, start))
    rows = assign_folds(keyed(spark), "y", ["site", "k"], rows_per_bucket=16, quarter="quarter").collect()
    assert len(rows) == 908
    for quarter in {r["quarter"] for r in rows}:
        sizes = [sum(r["quarter"] == quarter and r["fold"] == f for r in rows) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [1, 2, 4])
def test_folds_of_few_rows(spark, n):
    rows = splits.add_folds(keyed(spark).where("site = 'hot'").limit(n).withColumn("s", F.lit(1)), ["s"], ["site", "k"]).collect()
    sizes = [sum(r["fold"] == f for r in rows) for f in range(3)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_days_without_repeats_carry_no_tie_hash(spark):
    df = spark.createDataFrame(series(), "site string, DATE date, x double, k int").withColumn("unused", F.sqrt(F.col("k") + 1.5))
    for tie in (None, ()):
        plan = fill_ahead(df, ["x"], tie=tie).select("site", "DATE", "x")._jdf.queryExecution().optimizedPlan().toString()
        assert "xxhash64" not in plan and "SQRT" not in plan.upper()


def test_named_ties(spark):
    start = datetime.date(2000, 1, 1)
    rows = [("A", start + datetime.timedelta(days=i // 3), float(i) if i % 4 == 0 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "site string, DATE date, x double, k int").repartition(4)
    got = fill_ahead(df, ["x"], block_days=2, tie=["k"]).collect()
    assert sorted(r["k"] for r in got) == list(range(60))
    assert series_last(df, "k", "last", tie=["k"]).select("last").distinct().count() == 1
