from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fluxloom.functions import guards, physics as P
from fluxloom.functions.hybrid import HYBRIDS, add_flux_estimates
from fluxloom.operators.clean import add_physics

FIELDS = "TA_F double, VPD_F double, PA_F double, NETRAD double, G_F_MDS double, LE_CORR double, WS_F double, USTAR double"


def one(spark, **values):
    row = {
        "TA_F": 20.0, "VPD_F": 10.0, "PA_F": 100.0, "NETRAD": 200.0, "G_F_MDS": 10.0,
        "LE_CORR": 90.0, "WS_F": 2.0, "USTAR": 0.3,
    } | values
    names = [field.split()[0] for field in FIELDS.split(", ")]
    return add_physics(spark.createDataFrame([tuple(row[n] for n in names)], FIELDS)).first()


def test_golden_point(spark):
    got = one(spark)
    esat = 0.6112 * math.exp(17.62 * 20 / (243.12 + 20))
    allen = 0.6108 * math.exp(17.27 * 20 / (237.3 + 20))
    slope = esat * 17.62 * 243.12 / (243.12 + 20) ** 2
    lv = (2.501 - 0.00237 * 20) * 1e6
    gamma = 1004.834 * 100 / (0.622 * lv)
    density = 100 * 1000 / (287.0586 * 293.15)
    ra = 2.0 / 0.09 + 6.2 * 0.3 ** -0.667
    demand = slope * 190 + density * 1004.834 * 1.0 / ra
    want = {
        "AE": 190.0, "rha": 1 - 1.0 / allen, "esat_air": esat, "Delta": slope, "Lv": lv, "gamma": gamma,
        "density": density, "q": 0.622 * (allen - 1) / (100 - 0.378 * (allen - 1)), "ra_H": ra, "ga_H": 1 / ra,
        "PET_Penman": demand / (slope + gamma), "PET_PT": 1.26 * slope / (slope + gamma) * 190,
        "PET_PM": demand / (slope + gamma + gamma * 70 / ra),
    }
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=1e-12), name
    assert got["PT_stress_cor_raw"] == pytest.approx(90 / want["PET_PT"], rel=1e-12)
    assert got["drh_cor"] == pytest.approx(got["Frh_cor"] * ra, rel=1e-12)


@pytest.mark.parametrize("ustar, expected", [(0.0, 1000.0), (-0.1, None), (None, None), (5.0, 10.0), (0.01, 1000.0)])
def test_resistance_edges(spark, ustar, expected):
    assert one(spark, USTAR=ustar)["ra_H"] == expected


def test_wind_is_floored(spark):
    assert one(spark, WS_F=0.05)["WS_F"] == 0.2
    assert one(spark, WS_F=None)["ra_H"] is None


def test_ratio_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (-4.0, 2.0), (4.0, 2.0)], "a double, b double")
    ratio = df.select(P.flux_ratio(F.col("a"), F.col("b")).alias("r"))
    assert [r["r"] for r in ratio.collect()] == [math.inf, -math.inf, None, None, -2.0, 2.0]
    floored = [r[0] for r in ratio.select(P.stress_ratio(F.col("r"))).collect()]
    assert floored == [math.inf, 0.0, None, None, 0.0, 2.0]


def test_guards_keep_null(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (5.0,)], "x double")
    x = guards.nan_to_null(F.col("x"))
    got = df.select(guards.clamp(x, 1.0, 3.0), guards.at_least(x, 7.0), guards.at_most(x, 2.0)).collect()
    assert [tuple(r) for r in got] == [(None,) * 3, (None,) * 3, (3.0, 7.0, 2.0)]


def test_forward_inverts_inverse(spark):
    rng = random.Random(1)
    rows = [
        (rng.uniform(0, 35), rng.uniform(1, 15), rng.uniform(90, 101), rng.uniform(60, 300), rng.uniform(0, 10),
         rng.uniform(5, 150), rng.uniform(0.5, 5), rng.uniform(0.1, 0.8)) for _ in range(500)
    ]
    df = add_physics(spark.createDataFrame(rows, FIELDS)).where("Gs_cor_raw is not null and rha > 0")
    exact = {
        "PT_stress_cor_RF": F.col("PT_stress_cor_raw"), "Penman_stress_cor_RF": F.col("Penman_stress_cor_raw"),
        "PM_stress_cor_RF": F.col("PM_stress_cor_raw"), "Gs_log_cor_RF": F.ln("Gs_cor_raw"),
        "Frh_cor_RF": F.col("Frh_cor"), "drh_cor_RF": F.col("drh_cor"),
    }
    forward = add_flux_estimates(df.withColumns(exact))
    worst = forward.agg(*[F.max(F.abs(F.col(m.estimate) - F.col("LE_CORR"))) for m in HYBRIDS]).first()
    assert forward.count() > 100
    assert max(worst) < 1e-9


def test_sensitivity_is_the_derivative(spark):
    df = add_physics(spark.createDataFrame([(20.0, 10.0, 100.0, 200.0, 10.0, 90.0, 2.0, 0.3)], FIELDS))
    step = 1e-6
    for model in HYBRIDS:
        theta = F.lit(-4.0) if model.target == "Gs_log_cor" else F.lit(0.4)
        up, down, slope = df.select(
            model.flux(theta + step).alias("u"), model.flux(theta - step).alias("d"), model.slope(theta).alias("s")
        ).first()
        assert slope == pytest.approx((up - down) / (2 * step), rel=1e-5), model.name
