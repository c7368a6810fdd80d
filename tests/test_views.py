from __future__ import annotations

import datetime
import re

from fluxloom.storage import METHOD_LIMIT, store
from fluxloom.workbench import views as V


def folder_of(spark, path, rows):
    columns = ("l_orderkey long, l_suppkey long, l_shipdate date, l_quantity double, l_extendedprice double, "
               "l_discount double, l_tax double, l_linenumber int")
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def rows():
    day = datetime.date(1996, 1, 1)
    return [(k, k % 3, day + datetime.timedelta(days=k % 700), 20.0 + k % 20, 20000.0 + k, 0.05, 0.02, 1 + k % 3)
            for k in range(1, 900)] + [(-9999, 1, datetime.date(1999, 1, 1), 20.0, 20000.0, 0.05, 0.02, 1), (None,) * 8]


def test_series_is_shuffled_once_and_narrow(spark, tmp_path):
    """The gap fill shuffles raw numbers by site and block once, not every derived column for each of its branches."""
    found = V.scored(spark, folder_of(spark, tmp_path, rows())).select(*V.SCORED_COLUMNS)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?m)^[^\n]*(?:- |\) )Exchange hashpartitioning\([^\n]*_block", plan)) == 1
    assert "ReusedExchange" in plan


def test_physics_follow_the_fill(spark, tmp_path):
    """The same rows as with physics made before the fill, sentinel keys and nulls included."""
    sf_dir = folder_of(spark, tmp_path, rows())
    filled = V.fill_ahead(V.satellite(V.physical(spark, sf_dir)), V.FILLED, order="obs_date", tie=())
    before = filled.where(V.quality_ok()).na.drop(subset=V.REQUIRED_AFTER_QC).where(V.balance_ok())
    now = V.analysed(spark, sf_dir)
    assert set(before.columns) == set(now.columns) and now.count() > 0
    assert sorted(map(repr, before.collect())) == sorted(map(repr, now.select(before.columns).collect()))


def test_stored_frames_leave_the_session_as_it_was(spark):
    before = spark.conf.get(METHOD_LIMIT, None)
    store(spark.range(3).toDF("x"), "any")
    assert spark.conf.get(METHOD_LIMIT, None) == before
