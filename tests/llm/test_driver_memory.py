from __future__ import annotations

from fluxloom.llm import simhash
from fluxloom.storage import store


def test_keys_of_fingerprints_do_not_pass_through_the_driver(spark):
    prints = store(spark.createDataFrame([(0,), (7,), (15,), (1 << 40,)], "print long"), "prints")
    pairs = simhash.links(prints)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, pairs.collect())) == [(0, 7), (0, 1 << 40), (7, 15)]
