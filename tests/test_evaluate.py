from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.functions import labels, stats
from fluxloom.functions.hybrid import BY_CODE, MODELS
from fluxloom.operators import evaluate as E
from fluxloom.operators.boxplot import boxplot_outliers, boxplot_stats
from fluxloom.operators.joins import add_land_cover, join_satellite


def scored(spark, n=1500):
    rng = np.random.default_rng(4)
    names = sorted({"LE_CORR", *S.EXTREME_VARIABLES.values(), *[m.estimate for m in MODELS]})
    sites = rng.choice(["A", "B", "C"], n, p=[0.6, 0.3, 0.1])
    values = rng.normal(50, 20, (n, len(names)))
    rows = [(str(s), "G1" if s == "A" else "G2", *map(float, v)) for s, v in zip(sites, values)]
    df = spark.createDataFrame(rows, "site string, IGBP2 string, " + ", ".join(f"{c} double" for c in names))
    return df, df.toPandas()


def rmse(frame, column):
    return math.sqrt(((frame["LE_CORR"] - frame[column]) ** 2).mean())


def test_rollup_equals_three_separate_passes(spark):
    df, frame = scored(spark)
    got = {(r["grain"], r["IGBP2"], r["site"]): r for r in E.rmse_difference_rollup(df).collect()}
    assert len(got) == 1 + 2 + 3
    parts = {(3, None, None): frame}
    parts |= {(1, g, None): part for g, part in frame.groupby("IGBP2")}
    parts |= {(0, g, s): part for (g, s), part in frame.groupby(["IGBP2", "site"])}
    for key, part in parts.items():
        for code, model in BY_CODE.items():
            assert got[key][code] == pytest.approx(rmse(part, model.estimate) - rmse(part, "LE_CORR_RF"))
    doubled = E.site_differences(E.rmse_difference_rollup(df), "All (n = 3)")
    assert doubled.count() == 2 * 3 * 6
    assert doubled.where("IGBP2 = 'All (n = 3)'").count() == 18


@pytest.mark.parametrize("level", [0.01, 0.03])
def test_extremes_equal_sixteen_filters(spark, level):
    df, frame = scored(spark)
    got = {r["model"]: r for r in E.extreme_errors(df, E.extreme_thresholds(df, level, 32), ["C"]).collect()}
    assert set(got) == set(BY_CODE)
    kept = frame[frame["site"] != "C"]
    for name, column in S.EXTREME_VARIABLES.items():
        low = kept["site"].map(frame.groupby("site")[column].quantile(level))
        high = kept["site"].map(frame.groupby("site")[column].quantile(1 - level))
        for side, part in (("03", kept[kept[column] < low]), ("97", kept[kept[column] > high])):
            for code, model in BY_CODE.items():
                want = rmse(part, model.estimate) - rmse(part, "LE_CORR_RF")
                assert got[code][f"{name}_{side}"] == pytest.approx(want), (name, side, code)


def p_by_integration(t, dof):
    """Two-sided tail of Student's t by quadrature of its density."""
    grid = np.linspace(0, abs(t), 200_001)
    norm = math.gamma((dof + 1) / 2) / (math.sqrt(dof * math.pi) * math.gamma(dof / 2))
    density = norm * (1 + grid ** 2 / dof) ** (-(dof + 1) / 2)
    return 1 - 2 * float(np.sum((density[1:] + density[:-1]) / 2) * (grid[1] - grid[0]))


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 5, 6, 9, 30])
def test_p_value(spark, dof):
    for t in (-3.2, 0.0, 0.7, 2.5):
        got = spark.range(1).select(stats.two_sided_p(F.lit(t), F.lit(dof).cast("long"))).first()[0]
        assert got == pytest.approx(p_by_integration(t, dof), abs=1e-8)


def test_correlation_drops_models_and_points_outside_limits(spark):
    rows = [("Pure-ML", 100.0, 1.0), ("a", 1.0, 2.0), ("b", 2.0, 4.5), ("c", 3.0, 5.0), ("d", 4.0, 8.5), ("e", 50.0, 0.0)]
    df = spark.createDataFrame(rows, "models string, x double, y double")
    got = E.correlation_test(df, "x", "y", drop_models=["Pure-ML"], x_range=(0.0, 10.0)).first()
    want = np.corrcoef([1, 2, 3, 4], [2, 4.5, 5, 8.5])[0, 1]
    assert got["n"] == 4 and got["r"] == pytest.approx(want)


def test_box_statistics(spark):
    values = [1.0, 2.0, 2.5, 3.0, 4.0, 30.0, -40.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("h", 7.0)], "g string, y double")
    got = {r["g"]: r for r in boxplot_stats(df, ["g"], "y").collect()}
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    box = got["g"]
    assert (box["lower"], box["middle"], box["upper"]) == (q1, q2, q3)
    assert (box["ymin"], box["ymax"], box["n"], box["outliers"]) == (1.0, 4.0, 7, 2)
    assert (got["h"]["ymin"], got["h"]["ymax"], got["h"]["outliers"]) == (7.0, 7.0, 0)
    assert sorted(r["y"] for r in boxplot_outliers(df, ["g"], "y").collect()) == [-40.0, 30.0]


def test_land_cover_groups(spark):
    meta = spark.createDataFrame(
        [("a", "OSH"), ("b", "CRO"), ("c", "ENF"), ("d", "GRA"), ("e", "SAV"), ("f", None)], "site string, IGBP string"
    )
    sites = spark.createDataFrame([(s,) for s in "abcdefg"], "site string")
    got = {r["site"]: r["IGBP2"] for r in add_land_cover(sites, meta).collect()}
    assert got == {"a": "OSH/CSH", "b": "CRO", "c": "DBF/ENF", "d": "GRA", "e": "WET", "f": None, "g": None}


def test_labels(spark):
    row = spark.range(1).select(
        labels.rmse_label(F.lit(17.345)), labels.ratio_label(F.lit(0.9)), labels.model_markup(F.lit("H-PM-gs")),
        labels.model_markup(F.lit("none")), labels.group_with_count(F.lit("CRO"), F.lit(7)),
    ).first()
    assert row[0] in ("RMSE = 17.34", "RMSE = 17.35") and row[1] == "sigma[m]/sigma[o] == 0.900"
    assert tuple(row)[2:] == ("italic('H-PM-' * g[s])", None, "CRO (n = 7)")


def test_improvement_table(spark):
    trees = spark.createDataFrame([(100, 5.0, 6.5), (500, 4.5, 6.0)], "ntree int, Pure_ML double, H_PMRH_Frh double")
    mtry = spark.createDataFrame([(1, 5.5), (3, 5.25), (6, 5.0)], "mtry int, rmse double")
    got = {r["ImprovementType"]: r["ImprovementValue"] for r in E.improvement_table(trees, mtry).collect()}
    assert got == {"a": -0.5, "b": -0.25, "c": 1.5}


def test_satellite_duplicates_fan_out(spark):
    daily = spark.createDataFrame([("a", 1), ("a", 2)], "site string, DATE int")
    water = spark.createDataFrame([("a", 1, 0.1), ("a", 1, 0.2)], "site string, DATE int, VegWC double")
    got = sorted((r["DATE"], r["VegWC"]) for r in join_satellite(daily, water).collect() if r["VegWC"])
    assert got == [(1, 0.1), (1, 0.2)]
    assert join_satellite(daily, water).count() == 3


def test_scorecard_uses_the_stated_effect(spark):
    from fluxloom.workbench import views as V

    df = V.scored(spark, "/root/testdata/sf0.001").select(*V.SCORED_COLUMNS)
    frame = df.toPandas()
    plain = {r["models"]: r for r in E.scorecard(df).collect()}
    consistent = {r["models"]: r["partial_stdev"] for r in E.scorecard(df, consistent=True).collect()}
    gain = frame["density"] * 1004.834 * frame["esat_air"] / (frame["rha"] * frame["Delta"] + frame["gamma"])
    spread = frame["Frh_cor_RF"].std()
    assert plain["H-PMRH-Frh"]["partial_stdev"] == pytest.approx(spread * abs(gain.mean()))
    assert consistent["H-PMRH-Frh"] == pytest.approx(spread * math.sqrt((gain ** 2).mean()))
    assert plain["H-PT"]["partial_stdev"] == pytest.approx(consistent["H-PT"])
    assert plain["Pure-ML"]["partial_stdev"] == pytest.approx(frame["LE_CORR_RF"].std())
    assert plain["Pure-ML"]["mean_bias"] == pytest.approx((frame["LE_CORR_RF"] - frame["LE_CORR"]).mean())
