from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom import schema as S
from fluxloom.operators.clean import decode_yyyymmdd, satellite_product, sentinel_to_null
from fluxloom.sources import daily_files as D
from fluxloom.sources import sinks, versions
from fluxloom.sources.tables import read_satellite, read_site_metadata

COLUMNS = ["TIMESTAMP", *S.MEASURED]


def write_site(folder, name, rows, columns=None):
    """``rows`` are dicts of the cells that are not 1.0."""
    columns = columns or COLUMNS
    with open(os.path.join(folder, name), "w") as out:
        out.write(",".join(columns) + "\n")
        for row in rows:
            out.write(",".join(str(row.get(c, 1.0)) for c in columns) + "\n")


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_files_are_bound_by_name_and_gated(spark, folder):
    write_site(folder, "AMF_US-Aaa_X_FULLSET_DD_1.csv", [{"TIMESTAMP": 20150401, "TA_F": 3.5, "USTAR": 0.4}])
    write_site(
        folder, "AMF_US-Bbb_X_FULLSET_DD_1.csv", [{"TIMESTAMP": 20150402, "TA_F": 7.5, "USTAR": 0.9}],
        ["extra", *reversed(COLUMNS)],
    )
    write_site(folder, "AMF_US-Ccc_X_FULLSET_DD_1.csv", [{"TIMESTAMP": 20150401}], [c for c in COLUMNS if c != "USTAR"])
    write_site(folder, "AMF_US-Ddd_X_FULLSET_HH_1.csv", [{"TIMESTAMP": 20150401}])
    daily = D.read_daily_sites(spark, folder)
    assert daily.columns == S.REQUIRED
    got = {r["site"]: (r["TA_F"], r["USTAR"], r["PDATE"]) for r in daily.collect()}
    assert got == {
        "US-Aaa": (3.5, 0.4, datetime.datetime(2015, 4, 1, 12)),
        "US-Bbb": (7.5, 0.9, datetime.datetime(2015, 4, 2, 12)),
    }


def test_odd_cells_and_the_first_day(spark, folder):
    rows = [
        {"TIMESTAMP": 20150331, "TA_F": 1}, {"TIMESTAMP": 20150401, "TA_F": "NA"},
        {"TIMESTAMP": 20150402, "TA_F": "Inf"}, {"TIMESTAMP": 20150403, "TA_F": "-Inf"},
        {"TIMESTAMP": 20150404, "TA_F": "NaN"}, {"TIMESTAMP": 20150405, "TA_F": -9999},
        {"TIMESTAMP": 20150406, "TA_F": "-9999.0"}, {"TIMESTAMP": 20150230, "TA_F": 4},
    ]
    write_site(folder, "AMF_US-Aaa_X_FULLSET_DD_1.csv", rows)
    got = {r["PDATE"].day: r["TA_F"] for r in D.read_daily_sites(spark, folder).collect()}
    assert got == {1: None, 2: float("inf"), 3: float("-inf"), 4: None, 5: None, 6: None}


def test_overlapping_files_merge_identical_rows(spark, folder):
    shared = {"TIMESTAMP": 20160101, "TA_F": 2.0, "USTAR": "NA"}
    changed = {"TIMESTAMP": 20160101, "TA_F": 2.5}
    write_site(folder, "AMF_US-Aaa_X_FULLSET_DD_1.csv", [shared, {"TIMESTAMP": 20160102}])
    write_site(folder, "AMF_US-Aaa_X_FULLSET_DD_2.csv", [shared, changed])
    write_site(folder, "AMF_US-Bbb_X_FULLSET_DD_1.csv", [shared, shared])
    got = sorted((r["site"], r["PDATE"].day, r["TA_F"]) for r in D.read_daily_sites(spark, folder).collect())
    assert got == [("US-Aaa", 1, 2.0), ("US-Aaa", 1, 2.5), ("US-Aaa", 2, 1.0), ("US-Bbb", 1, 2.0), ("US-Bbb", 1, 2.0)]


def test_repeats_in_shared_files_multiply(spark):
    rows = [("A", 1, "x")] * 2 + [("A", 1, "y")] * 3 + [("A", 2, "y")] * 2 + [("A", None, "x"), ("A", None, "y")]
    df = spark.createDataFrame(rows, "site string, v int, _file string")
    got = sorted((r["v"] or 0) for r in D.merge_identical(df).collect())
    assert got == [0] + [1] * 6 + [2] * 2


def test_no_usable_file_is_an_error(spark, folder):
    write_site(folder, "AMF_US-Ccc_X_FULLSET_DD_1.csv", [{}], ["TIMESTAMP"])
    with pytest.raises(ValueError):
        D.read_daily_sites(spark, folder)


def test_bad_days_decode_to_null(spark):
    df = spark.createDataFrame([(20150230,), (20160229,), (None,), (0,)], "t int")
    got = [r[0] for r in df.select(decode_yyyymmdd(F.col("t"))).collect()]
    assert got == [None, datetime.datetime(2016, 2, 29, 12), None, None]


def test_sentinel_in_every_numeric_type(spark):
    df = spark.createDataFrame([(-9999, -9999.0, "-9999"), (1, float("nan"), "a")], "i int, d double, s string")
    assert [tuple(r) for r in sentinel_to_null(df).collect()] == [(None, None, "-9999"), (1, None, "a")]


def test_satellite_and_metadata_files(spark, folder):
    fpar, meta = os.path.join(folder, "fpar.csv"), os.path.join(folder, "meta.csv")
    with open(fpar, "w") as out:
        out.write("LC_Type1,name,date,Fpar\n10,US-Aaa,2016-05-01,55\n10,US-Aaa,2016-05-02,NA\n")
    with open(meta, "w") as out:
        out.write("site,other,IGBP\nUS-Aaa,1,CSH\n")
    got = {r["DATE"].day: (r["site"], r["Fpar"], r["LC_Type1"]) for r in read_satellite(spark, fpar, "Fpar").collect()}
    assert got == {1: ("US-Aaa", pytest.approx(0.55), 10), 2: ("US-Aaa", None, 10)}
    assert [tuple(r) for r in read_site_metadata(spark, meta).collect()] == [("US-Aaa", "CSH")]


def test_numbered_csv(spark, folder):
    df = spark.createDataFrame([(float(i), None if i == 3 else i) for i in range(40)], "p double, v int").repartition(6)
    path = os.path.join(folder, "numbered")
    sinks.write_numbered_csv(df, path, ["p"])
    text = spark.read.text(path).where(~F.col("value").contains("p")).collect()
    lines = sorted((int(r[0].split(",")[0]), r[0].split(",")[1:]) for r in text)
    assert [n for n, _ in lines] == list(range(1, 41))
    assert lines[3][1] == ["3.0", "NA"] and lines[0][1] == ["0.0", "0"]
    assert spark.read.text(path).first()[0].split(",")[1:] == ["p", "v"]


def test_writes_never_replace_their_input(spark, folder):
    path = os.path.join(folder, "table")
    sinks.write_table(spark.range(3).toDF("k"), path)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_table(spark.read.parquet(path), path)


def test_headers_of_many_small_files_are_read_in_tasks(spark, folder):
    """20,000 files in two layouts and some without a column; the driver sees three headers at most."""
    whole, turned = COLUMNS, ["extra", *reversed(COLUMNS)]
    texts = [",".join(c) + "\n" + ",".join("20150401" if x == "TIMESTAMP" else "2.5" if x == "TA_F" else "1" for x in c) + "\n"
             for c in (whole, turned, whole[:-1])]
    for i in range(20_000):
        with open(os.path.join(folder, f"AMF_{i:06d}_X_FULLSET_DD_1.csv"), "w") as out:
            out.write(texts[i % 3])
    types = {"TIMESTAMP": T.IntegerType(), "TA_F": T.DoubleType(), COLUMNS[-1]: T.DoubleType()}
    files = D.gated_files(spark, folder, list(types), S.DAILY_FILE_MARK)
    assert files.count() == 13_334 and files.select("header").distinct().count() == 2
    rows = D.read_by_name(spark, folder, types, files=files)
    got = rows.agg(F.count("*"), F.sum("TA_F"), F.min("TIMESTAMP"), F.countDistinct(D.PATH), F.sum(COLUMNS[-1])).first()
    assert tuple(got) == (13_334, 2.5 * 13_334, 20150401, 13_334, 13_334.0)


def test_byte_order_mark_quotes_and_spaces_in_headers(spark, folder):
    with open(os.path.join(folder, "a_FULLSET_DD.csv"), "w") as out:
        out.write('\ufeff"site", v ,w\n"A,1",2,x\nB,NA,3\n')
    with open(os.path.join(folder, "b_FULLSET_DD.csv"), "w") as out:
        out.write("v,site\n7.5,C\nbroken,D\n")
    types = {"site": T.StringType(), "v": T.DoubleType()}
    got = sorted(map(tuple, D.read_by_name(spark, folder, types, {"w": T.StringType(), "none": T.StringType()}).drop(D.PATH).collect()), key=str)
    assert got == [("A,1", 2.0, "x"), ("B", None, "3"), ("C", 7.5, None), ("D", None, None)]


def test_versions_survive_failed_and_late_writers(spark, folder):
    path = os.path.join(folder, "table")
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    assert versions.write_version(spark.range(4).toDF("k"), path) == 1
    old = versions.read_version(spark, path)
    assert versions.write_version(old.where("k > 0"), path) == 2
    broken = versions.read_version(spark, path).select(F.raise_error(F.lit("no")).cast("long").alias("k"))
    with pytest.raises(Exception, match="no"):
        versions.write_version(broken, path)
    assert versions.versions(spark, path) == [1, 2] and versions.read_version(spark, path).count() == 3 and old.count() == 4
    assert versions.write_version(old.where("k > 2"), path, after=2) == 3
    with pytest.raises(versions.VersionConflict):
        versions.write_version(old, path, after=2)
    assert versions.read_version(spark, path).count() == 1 and versions.read_version(spark, path, 2).count() == 3
    versions.drop_versions(spark, path)
    assert versions.versions(spark, path) == [3] and versions.read_version(spark, path).count() == 1
    assert versions.write_version(versions.read_version(spark, path), path) == 4
    assert sorted(n for n in os.listdir(path) if n.startswith("data-")) == sorted(
        open(os.path.join(path, versions.LOG, f"{v:010d}")).read() for v in (3, 4))
