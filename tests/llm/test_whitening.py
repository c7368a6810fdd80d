from __future__ import annotations

import math

import numpy as np
import pytest

from fluxloom.llm import whitening
from fluxloom.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def residual(a, values, x):
    wide = np.longdouble
    return float(abs(a.astype(wide) @ x.astype(wide) - x.astype(wide) * values.astype(wide)).max() / abs(a).max())


@pytest.mark.parametrize("values", [
    np.arange(8) + 1.0, np.r_[np.ones(10) + 1e-7 * np.arange(10), 2 + 1e-12 * np.arange(10), 3, 5, 9], np.ones(6),
    np.r_[[5.0] * 4, 3, 3 + 1e-9, 1, [0.5] * 8], np.r_[1e9, 1, 1e-3, 0, 0], np.array([4.0]),
])
def test_eigenvectors(values):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigenvectors(a)
    x = x.astype(float)
    assert residual(a, got, x) < 1e-15 * len(values)
    assert abs(x.T @ x - np.eye(len(values))).max() < 1e-15
    assert abs(got - np.sort(values)[::-1]).max() <= 1e-14 * abs(a).max() and (np.diff(got) <= 0).all()


def test_start_is_worse_than_the_correction():
    rng = np.random.default_rng(2)
    a = np.cov(rng.normal(size=(64, 500)))
    start = np.linalg.eigh(a.astype(np.float32))
    values, x = whitening.eigenvectors(a)
    assert residual(a, values, x) < 1e-16 * 64 < 1e-9 < residual(a, *(s.astype(float) for s in start))


def brute(vectors, k=32):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    z = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation, z @ u / np.sqrt(e), e / np.trace(v)


def test_query_equals_brute_force(spark):
    source = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, deviation, w, shares = brute(list(source.values()))
    got = REGISTRY["op11_whitening"](spark, SF).collect()
    assert len(got) == 32 * len(source)
    place = {i: k for k, i in enumerate(source)}
    table = np.zeros((len(source), 32))
    for r in got:
        k = place[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation[k])
        assert abs(r["explained"] - shares[r["component"] - 1]) <= 1e-9 * shares[r["component"] - 1]
        table[k, r["component"] - 1] = r["whitened"]
    sign = np.sign((table * w).sum(axis=0))
    assert abs(table - w * sign).max() < 1e-7
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string, x long, w string, n string")


def test_hard_vectors(spark):
    good = [(i, [float(i % 3), float(i), float(i * i % 7)], "a", 1, "b", "c") for i in range(20)]
    bad = [(30, None), (31, [1.0, None, 2.0]), (32, [1.0, float("nan"), 2.0]), (33, [1.0, float("inf"), 2.0]),
           (34, [1.0, 2.0]), (35, []), (36, [1.0, 1e30, 2.0])]
    rows = good + [good[4], (None, [2.0, 2.0, 2.0], None, None, None, None)] + [(i, v, None, None, None, None) for i, v in bad]
    got = whitening.whiten(rows_of(spark, rows), ["vec_id", "row", "x", "w", "n"]).collect()
    assert len(got) == 22 * 3 and {r["n"] for r in got} == {22} and got[0]["identity_error"] < 1e-12
    assert sorted(r["row"]["vec_id"] for r in got if r["row"]["vec_id"] is not None).count(4) == 6


def test_no_variance_nothing_and_long_numbers(spark):
    flat = whitening.whiten(rows_of(spark, [(i, [1.0, float(i), 5.0], "", 0, "", "") for i in range(4)]), ["vec_id"]).collect()
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: (r["row"]["vec_id"], r["component"]))] == [False, True, True] * 4
    one = whitening.whiten(rows_of(spark, [(1, [1.0, 2.0], "", 0, "", "")]), ["vec_id"]).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, None, None, None)] * 2
    assert whitening.whiten(rows_of(spark, []), ["vec_id"]).collect() == []
    assert whitening.whiten(rows_of(spark, [(1, [], "", 0, "", "")]), ["vec_id"]).collect() == []
    long = whitening.whiten(rows_of(spark, [(i, [float(2.0**50 * i), float(i % 2)], "", 0, "", "") for i in range(6)]), ["vec_id"]).collect()
    assert all(r["deviation"] is None for r in long) and long[0]["identity_error"] < 1e-4


def test_whole_sums_of_any_length():
    total = -(1 << 130) + 12345
    assert sum(v << whitening.LIMB * k for k, v in enumerate(whitening._limbs(total))) == total
    z = np.array([[1 << 40, 3], [-(1 << 41), 5]])
    assert whitening._gram(z).tolist() == [[(1 << 80) + (1 << 82), 3 * (1 << 40) - 5 * (1 << 41)], [3 * (1 << 40) - 5 * (1 << 41), 34]]
