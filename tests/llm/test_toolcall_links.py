from __future__ import annotations

import random
from collections import Counter

import pytest

from fluxloom.llm import toolcalls

CALLS = "conv_id long, call_turn long, place int, call_id string, name string, arguments string"
RESULTS = "conv_id long, result_turn long, call_id string, content string"


def brute(calls, results):
    out, ids = Counter(), Counter((c[0], c[3]) for c in calls)
    for conv, turn, place, id_, _, _ in calls:
        own = [(t, x) for c, t, i, x in results if (c, i) == (conv, id_) and t is not None and id_ is not None]
        after = sorted((t, x) for t, x in own if turn is not None and t > turn)
        status = "linked" if after else "early_result" if own else "no_result"
        out[conv, id_, turn, place, ids[conv, id_], status, *(after[0] if after else (None, None))] += 1
    for conv, turn, id_, content in results:
        if not ids[conv, id_]:
            out[conv, id_, None, None, 0, "no_call", turn, content] += 1
    return out


def found(spark, calls, results):
    rows = toolcalls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS))
    return Counter(map(tuple, rows.select("conv_id", "call_id", "call_turn", "place", "same_id", "status", "result_turn", "content").collect()))


def test_repeated_calls_keep_their_rows(spark):
    calls = [(1, 1, 0, "a", "search", "{}")] * 3 + [(1, 1, 0, None, "search", "{}")] * 2
    results = [(1, 2, "a", "x"), (1, 2, "a", "x"), (1, 4, "b", "y"), (1, 4, "b", "y")]
    got = found(spark, calls, results)
    assert got == brute(calls, results) and sum(got.values()) == 7


@pytest.mark.parametrize("block", [4, 1024])
def test_a_hot_identifier_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(toolcalls, "BLOCK", block, raising=False)
    rng = random.Random(block)
    key = lambda: (None, "call_0") if rng.random() < 0.5 else (rng.choice([None, 1, 2]), rng.choice(["call_0", "b", "c", "d"]))
    turn = lambda: rng.choice([None, *range(-5, 90)])
    calls, results = [], []
    for _ in range(600):
        conv, id_ = key()
        calls.append((conv, turn(), rng.randint(0, 1), rng.choice([id_, id_, id_, None]), "search", "{}"))
    for _ in range(300):
        conv, id_ = key()
        results.append((conv, turn(), id_, f"r{rng.randint(0, 99)}"))
    assert found(spark, calls, results) == brute(calls, results)
