from __future__ import annotations

import datetime
from pathlib import Path

from fluxloom.workbench import queries as Q


def test_a_site_is_one_file_with_all_its_years(spark, tmp_path):
    columns = ("l_orderkey long, l_suppkey long, l_shipdate date, l_quantity double, l_extendedprice double, "
               "l_discount double, l_tax double, l_linenumber int")
    rows = [(k, k % 2, datetime.date(1995 + k % 4, 1, 1 + k % 28), 20.0, 20000.0, 0.05, 0.02, 1) for k in range(200)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, 0), (1, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, 0), (1, 3)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    folder = Path(Q._site_files(spark, str(tmp_path)))
    assert sorted(len(list(site.glob("*.csv"))) for site in folder.glob("file=*")) == [1, 1]
    assert Q.scan_multi_file(spark, str(tmp_path)).count() == len({(r[1], r[2]) for r in rows})
