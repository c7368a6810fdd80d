from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import caps as C


def cap_rows(spark):
    rng = np.random.default_rng(2)
    rows = [
        (float(rng.uniform(-20, 200)), float(rng.uniform(-5, 120)), float(rng.uniform(1, 90)), float(rng.uniform(1, 90)),
         float(rng.uniform(1, 90)), float(rng.lognormal()) if rng.random() < 0.8 else None) for _ in range(3000)
    ]
    return rows, spark.createDataFrame(
        rows, "AE double, LE_CORR double, PET_PT double, PET_Penman double, PET_PM double, Gs_cor_raw double"
    )


def test_cap_grid_matches_numpy_and_rises(spark):
    rows, df = cap_rows(spark)
    grid = [r.asDict() for r in C.cap_grid(df).orderBy("percentile").collect()]
    assert [g["percentile"] for g in grid] == [round(99 + 0.05 * i, 2) for i in range(20)]
    used = [r for r in rows if r[0] > 30]
    conductance = [r[5] for r in rows if r[5] is not None]
    for g in grid:
        p = g["percentile"] / 100
        for name, column in (("PT_max", 2), ("Penman_max", 3), ("PMKc_max", 4)):
            assert g[name] == pytest.approx(np.quantile([r[1] / r[column] for r in used], p))
        assert g["PMgs_max"] == pytest.approx(np.quantile(conductance, p))
        assert g["PMgs_min"] == pytest.approx(np.quantile(conductance, 1 - p))
    for lower, upper in zip(grid, grid[1:]):
        assert lower["PT_max"] <= upper["PT_max"] and lower["PMgs_min"] >= upper["PMgs_min"]


def test_targets_stay_inside_their_caps(spark):
    _, df = cap_rows(spark)
    best = {"PT_max": 2.0, "Penman_max": 1.5, "PMKc_max": 1.2, "PMgs_max": 9.0, "PMgs_min": 0.01}
    got = C.add_capped_targets(df, best)
    low, high, nulls = got.agg(F.min("PT_stress_cor"), F.max("PT_stress_cor"), F.count_if(F.isnull("Gs_cor"))).first()
    assert (low, high, nulls) == (0.0, 2.0, 0)
    imputed = got.where("Gs_cor_raw is null").select("LE_CORR", "Gs_cor", "Gs_log_cor").collect()
    assert all(r["Gs_cor"] == (0.01 if r["LE_CORR"] <= 0 else 9.0) for r in imputed)
    assert all(r["Gs_log_cor"] == pytest.approx(math.log(r["Gs_cor"])) for r in imputed)


def test_missing_flux_leaves_conductance_missing(spark):
    df = spark.createDataFrame([(None, None)], "Gs_cor_raw double, LE_CORR double")
    assert df.select(C.imputed_conductance(0.1, 2.0)).first()[0] is None


def test_best_cap_takes_the_smallest_percentile_on_a_tie(spark):
    rows = [(99.0, 1.0, 5.0), (99.5, 2.0, 4.0), (99.9, 3.0, 4.0), (99.95, 9.0, None)]
    wide = []
    for percentile, cap, error in rows:
        wide.append((percentile, *[cap, error] * 4, cap / 10))
    names = "percentile double, " + ", ".join(f"{n}_max double, {n}_rmse double" for n in ("PT", "Penman", "PMKc", "PMgs"))
    best = C.caps_as_numbers(C.best_caps(spark.createDataFrame(wide, names + ", PMgs_min double")).first())
    assert best == {"PT_max": 2.0, "Penman_max": 2.0, "PMKc_max": 2.0, "PMgs_max": 2.0, "PMgs_min": 0.2}
