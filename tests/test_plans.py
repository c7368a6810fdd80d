"""The whole chain on small hand-made inputs: files, satellite products, training, evaluation."""

from __future__ import annotations

import datetime
import os
import random

from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.forests.models import ForestSettings, tune_mtry
from fluxloom.plans import training
from fluxloom.plans.daily_table import build_daily_table
from fluxloom.plans.evaluation import write_evaluation
from fluxloom.plans.training import train

SITES = {"US-Aaa": "CRO", "US-Bbb": "OSH", "US-Ccc": "ENF", "US-Ddd": "SAV"}
DAYS = 220


def write_inputs(folder):
    rng = random.Random(9)
    products = {name: open(os.path.join(folder, f"{name}.csv"), "w") for name in ("soil_moisture", "VegWC", "Fpar")}
    for name, out in products.items():
        out.write(f"date,name,{name}{',LC_Type1' if name == 'Fpar' else ''}\n")
    os.mkdir(os.path.join(folder, "sites"))
    for number, site in enumerate(SITES):
        columns = ["TIMESTAMP", *S.MEASURED] if number % 2 else ["TIMESTAMP", *reversed(S.MEASURED)]
        with open(os.path.join(folder, "sites", f"AMF_{site}_FLUXNET_FULLSET_DD_1.csv"), "w") as out:
            out.write(",".join(columns) + "\n")
            for offset in range(DAYS):
                day = datetime.date(2016, 1, 1) + datetime.timedelta(days=offset)
                net, wet = rng.uniform(40, 250), rng.uniform(0.2, 0.8)
                latent = wet * net + rng.gauss(0, 4)
                row = {
                    "TIMESTAMP": day.strftime("%Y%m%d"), "TA_F": rng.uniform(5, 30), "VPD_F": rng.uniform(1, 8),
                    "PA_F": 99, "CO2_F_MDS": 400 + rng.random() * 20, "NETRAD": net, "G_F_MDS": 3,
                    "SW_IN_F_MDS": net * 1.3, "LE_CORR": latent, "LE_F_MDS": latent, "WS_F": rng.uniform(0.5, 4),
                    "USTAR": rng.uniform(0.1, 0.6), "H_CORR": net - 3 - latent + rng.gauss(0, 10), "H_F_MDS": 1,
                }
                out.write(",".join(str(row.get(c, 1)) for c in columns) + "\n")
                if offset % 3 == 0:
                    products["soil_moisture"].write(f"{day},{site},{wet}\n")
                if offset % 30 == 0:  # a second value for the day: the join keeps both rows
                    products["soil_moisture"].write(f"{day},{site},{wet + 0.01}\n")
                if offset % 4 == 0:
                    products["VegWC"].write(f"{day},{site},{rng.uniform(1, 4)}\n")
                products["Fpar"].write(f"{day},{site},{wet * 100},{number + 1}\n")
    for out in products.values():
        out.close()
    return os.path.join(folder, "sites"), {name: os.path.join(folder, f"{name}.csv") for name in products}


def test_files_to_result_tables(spark, tmp_path, monkeypatch):
    # tune one target over a small grid; the full grids run in the registered queries
    monkeypatch.setattr(training, "tune_all", lambda rows, settings: {
        "LE_CORR": tune_mtry(rows, "LE_CORR", S.PREDICTORS_WITH_ENERGY, training.KEYS, grid=[3, 6], settings=settings)})
    folder = str(tmp_path)
    sites, products = write_inputs(folder)
    output = os.path.join(folder, "out")
    filtered = build_daily_table(spark, sites, products, output)
    n = filtered.count()
    assert 0.7 * DAYS * len(SITES) < n <= (DAYS + DAYS / 30 + 1) * len(SITES)
    assert filtered.where(F.col("soil_moisture").isNull() | F.col("Fpar").isNull() | (F.col("rha") <= 0)).count() == 0
    assert filtered.agg(F.max("Fpar")).first()[0] <= 1.0

    tiny = ForestSettings(trees=3, depth=4, bins=16)
    trained = train(
        spark, f"{output}/filtered", f"{output}/trained", tiny, tree_counts=(2, 4), percentiles=[99.0, 99.9], caps_from="train"
    )
    split, targets = spark.read.parquet(trained.split), spark.read.parquet(trained.targets)
    assert split.count() == targets.select("site", "DATE").distinct().count() < targets.count() == n
    assert targets.join(split, ["site", "DATE"]).count() == n
    numbered = spark.read.option("header", "true").csv(trained.cap_table).collect()
    assert sorted(r[0] for r in numbered) == ["1", "2"]
    meta = spark.createDataFrame(list(SITES.items()), "site string, IGBP string")
    options = {"trees": 4, "exclude_sites": ("US-Ddd",), "limits": {"stdev_ratio": (-1e9, 1e9)}}
    paths = write_evaluation(spark, trained, meta, f"{output}/tables", **options)
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    card = {r["models"]: r["rmse"] for r in tables["scorecard"].collect()}
    spread = filtered.agg(F.stddev("LE_CORR")).first()[0]
    assert len(card) == 7 and card["Pure-ML"] < spread
    assert {r["grain"] for r in tables["difference_rollup"].collect()} == {0, 1, 3}
    assert tables["extremes_3"].count() == 6 and tables["extremes_3_points"].count() <= 6 * 16
    assert {r["model"] for r in tables["extremes_1_boxes"].collect()} <= {f"H{i}" for i in range(1, 7)}
    assert tables["difference_points"].count() == 6 * 5
    assert tables["difference_outliers"].columns == tables["site_differences"].columns
    assert {r["label"] for r in tables["group_sites"].collect()} == {
        "CRO (n = 1)", "OSH/CSH (n = 1)", "DBF/ENF (n = 1)", "WET (n = 1)"
    }
    best = tables["importance_LE_CORR"].orderBy("place").first()
    assert best["varnames"] in ("AE", "Rg", "SM", "FPAR")
    assert tables["r2_vs_rmse"].first()["n"] == 6
    assert {r["ntree"] for r in tables["trees"].collect()} == {2, 4}
    gains = {r["ImprovementType"]: r["ImprovementValue"] for r in tables["improvement"].collect()}
    assert set(gains) == {"a", "b", "c"} and gains["b"] <= 0
    errors = {r["ntree"]: r["Pure_ML"] for r in tables["trees"].collect()}
    assert gains["a"] == errors[4] - errors[2]
