from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import order_stats as O

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def samples():
    rng = random.Random(3)
    hot = [("hot", rng.gauss(0, 1)) for _ in range(2000)]
    outliers = [("wild", math.copysign(10 ** rng.uniform(-12, 200), rng.random() - 0.5)) for _ in range(700)]
    ties = [("ties", float(rng.randrange(3))) for _ in range(900)]
    narrow = [("narrow", 400 + rng.random() * 1e-9) for _ in range(600)]
    tiny = [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 9.0)]
    return hot + outliers + ties + narrow + tiny


@pytest.mark.parametrize("rows_per_bucket", [2, 16, 1 << 16])
def test_percentiles_match_numpy(spark, rows_per_bucket):
    data = samples()
    df = spark.createDataFrame(data + [("hot", None), ("hot", float("nan")), ("none", None)], "site string, x double")
    found = O.exact_percentiles(df, ["site"], {"x": F.col("x"), "minus": -F.col("x")}, PROBS, rows_per_bucket)
    got = {(r["site"], r["variable"], r["prob"]): (r["value"], r["n"]) for r in found.collect()}
    groups: dict = {}
    for site, x in data:
        groups.setdefault(site, []).append(x)
    assert len(got) == len(groups) * 2 * len(PROBS)
    for site, values in groups.items():
        for name, sign in (("x", 1), ("minus", -1)):
            for p in PROBS:
                value, n = got[(site, name, p)]
                assert n == len(values)
                assert value == pytest.approx(np.quantile(sign * np.array(values), p), rel=1e-9), (site, name, p)


def test_infinite_values_keep_their_place(spark):
    values = [float(i) for i in range(98)] + [math.inf, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = O.exact_percentiles(df, [], {"x": F.col("x")}, [0.5, 0.97, 1.0], 4)
    got = {r["prob"]: r["value"] for r in found.collect()}
    assert got[0.5] == 49.5 and got[1.0] == math.inf
    assert got[0.97] == pytest.approx(96.03)


def test_rank_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([("a", float(i * 37 % 1009)) for i in range(1009)], "site string, v double")
    for parts in (1, 7):
        ranked = O.value_at_rank(df.repartition(parts), ["site"], lambda n: F.array(F.lit(0), n - 1, F.lit(500)), 8)
        assert {r["rank"]: r["v"] for r in ranked.collect()} == {0: 0.0, 1008: 1008.0, 500: 500.0}


def test_no_rows_gives_no_result(spark):
    df = spark.createDataFrame([], "site string, x double")
    assert O.exact_percentiles(df, ["site"], {"x": F.col("x")}, [0.5]).count() == 0
    assert O.exact_percentiles(df, [], {"x": F.col("x")}, [0.5]).count() == 0
