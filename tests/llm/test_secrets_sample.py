from __future__ import annotations

import random
import string

import pytest
import xxhash

from fluxloom.llm import secrets


def texts(n, seed=11):
    rng = random.Random(seed)
    key = lambda size: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(size)) + "7"
    return [f"words before password = {key(16)} and after" for _ in range(n)] + [f"see file-{rng.randint(0, 9**9):09d}-page.html there" for _ in range(n)]


def test_a_finding_repeated_thousands_of_times_counts_once(spark):
    distinct = spark.createDataFrame([(t,) for t in texts(40)], "text string")
    plain = secrets.fit(distinct, per_label=20)
    first = [secrets.labelled_findings(distinct).where(f"label = {n}").orderBy("place").first() for n in (0, 1)]
    copied = [t for t in texts(40) if any(r["value"] in t for r in first)]
    rows = [(t,) for t in texts(40) + copied * 3000]
    repeated = secrets.fit(spark.createDataFrame(rows, "text string"), per_label=20)
    assert plain is not None and repeated is not None
    assert (plain.slope, plain.shift, plain.threshold) == (repeated.slope, repeated.shift, repeated.threshold)


def test_both_parts_hold_both_labels():
    rng = random.Random(2)
    for n in (2, 3, 5, 9):
        rows = [(1, "token=", f"k{rng.random()}", "") for _ in range(n)] + [(0, "see ", f"p{rng.random()}", "") for _ in range(60)]
        assert secrets.train(rows) is not None
    assert secrets.train(rows[-60:]) is None


@pytest.mark.parametrize(("keys", "others"), [(12, 400), (60, 300), (200, 40)])
def test_held_out_recall_at_any_base_rate(keys, others):
    """Keys and page names of much the same letters, so that the recall needs its own cut; values stand without a keyword."""
    rng = random.Random(keys)
    value = lambda n, ends: "".join(rng.choice("abcdefgh0123456789") for _ in range(n)) + ends
    rows = [(1, "token=", value(14, rng.choice(["", "", "xyz"])), " end") for _ in range(keys)]
    rows += [(0, "see ", value(14, rng.choice(["", ".html", ".html", ".html"])), " end") for _ in range(others)]
    network = secrets.train(rows)
    ordered = sorted(set(rows), key=lambda r: (xxhash.xxh64_intdigest("\0".join(r[1:]).encode(), 1), r))
    held = [r for n in (0, 1) for i, r in enumerate(x for x in ordered if x[0] == n) if i % 4 == 3]
    p = network.probability([("", r[2], r[3]) if r[0] else r[1:] for r in held])
    found = [x >= network.threshold for x, r in zip(p, held) if r[0] == 1]
    wrong = sum(x >= network.threshold for x, r in zip(p, held) if r[0] == 0)
    assert sum(found) / len(found) >= secrets.RECALL - 1 / len(found) and network.recall >= secrets.RECALL - 1 / len(found)
    assert network.n_held == (len(found), len(held) - len(found)) and network.precision == sum(found) / (sum(found) + wrong)


def test_an_assignment_is_learnt_by_its_value(spark):
    docs = spark.createDataFrame([('x api_key: "abc123def456ghi" y',), ("AKIA" + "Q1" * 8,)], "text string")
    found = sorted(tuple(r)[:4] for r in secrets.labelled_findings(docs).collect())
    assert found == [(1, "", "AKIA" + "Q1" * 8, ""), (1, 'x api_key: "', "abc123def456ghi", '" y')]


def test_one_shard_is_the_plain_training(spark):
    docs = spark.createDataFrame([(t,) for t in texts(60)], "text string")
    rows = [tuple(r)[:4] for r in secrets.labelled_findings(docs).distinct().collect()]
    plain, made = secrets.train(rows), secrets.fit(docs)
    assert abs(plain.threshold - made.threshold) < 1e-9 and plain.n_held == made.n_held and plain.recall == made.recall


def test_every_finding_counts(spark):
    docs = spark.createDataFrame([(t,) for t in texts(1300)], "text string").repartition(4)
    network = secrets.fit(docs, shard_rows=1000)  # three shards, both labels beyond the few that all shards see
    assert network.n_held == (325, 325) and network.recall >= secrets.RECALL - 0.01 and network.precision > 0.95
    assert (network.slope, network.threshold) == ((again := secrets.fit(docs, shard_rows=1000)).slope, again.threshold)
