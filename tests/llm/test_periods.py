from __future__ import annotations

import hashlib
import random

import numpy as np

from fluxloom.llm import periods
from fluxloom.llm.queries import REGISTRY
from fluxloom.llm.recompression import Grammar

SF = "/root/testdata/sf0.001"


def brute(words: list) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by comparing the text with itself at every distance."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda x: (x[0], x[2]))


def some_text(rng: random.Random) -> list[int]:
    n, kinds = rng.choice([0, 1, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 3, 50])
    words = [rng.randrange(kinds) for _ in range(n)]
    if n > 10 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        texts = [some_text(rng) for _ in range(rng.randint(1, 6))]
        got = periods.runs([np.array(t, np.int64) for t in texts])
        for k, text in enumerate(texts):
            assert [tuple(r) for r in got[k].tolist()] == brute(text) if k in got else not brute(text)


def test_extensions_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        texts = [some_text(rng) or [0] for _ in range(3)]
        symbols = [x for t in texts for x in (0, *t)] + [0]
        barrier = np.zeros(len(symbols), bool)
        barrier[np.cumsum([0] + [len(t) + 1 for t in texts])] = True
        grammar = Grammar(np.array(symbols), barrier)
        named = grammar.levels[0].symbols.tolist()
        pairs = [tuple(sorted(rng.sample(range(1, len(symbols) - 1), 2))) for _ in range(50) if len(symbols) > 3]
        a, b = (np.array(x) for x in zip(*pairs))
        for back in (False, True):
            for i, j, n in zip(a.tolist(), b.tolist(), grammar.extend(a, b, back).tolist()):
                step, want = -1 if back else 1, 0
                while named[i + step * want] == named[j + step * want]:
                    want += 1
                assert n == want


def test_portions_of_candidates_change_nothing(monkeypatch):
    texts = [np.array(x, np.int64) for x in ([1, 2] * 40 + [3] * 30, list(range(50)), [4] * 100)]
    whole = periods.runs(texts)
    monkeypatch.setattr(periods, "CANDIDATES", 7)
    parts = periods.runs(texts)
    assert whole.keys() == parts.keys() == {0, 2}
    assert all((whole[k] == parts[k]).all() for k in whole)


def expected(doc_id, text):
    words = (text or "").encode().split()
    places = periods.planted(doc_id, len(words))
    words = words if places is None else [words[k] for k in places.tolist()]
    rows = brute(words)
    dropped = {k for s, n, p in rows for k in range(s + p, s + n)}
    best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=None)
    line = (len(rows), *(best or (None, None, None)), best and 1000 * best[1] // best[2])
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in rows)
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    return (*line, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_hard_documents(spark, hard, nothing):
    extra = spark.createDataFrame([(150, "a b a b a b a b a c c c c c c", "en", "a", 0), (151, "x x x x x", "en", "a", 0)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    rows = hard.select(extra.columns).unionByName(extra)
    got = periods.detected(rows, ["doc_id", "text"], periods.planted).collect()
    assert len(got) == rows.count()
    for r in got:
        assert tuple(r)[1:8] == expected(r["row"]["doc_id"], r["row"]["text"])
    short = next(r for r in got if r["row"]["doc_id"] == 150)
    if periods.planted(150, 15) is None:
        assert [tuple(x) for x in short["runs"]] == [(0, 9, 2), (9, 6, 1)] and short["collapsed"] == "a b c"
    assert periods.detected(nothing, nothing.columns).count() == 0
    assert periods.detected(hard, hard.columns).select("row.words", "runs").count() == hard.count()


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = REGISTRY["op12_periodic_runs"](spark, SF).collect()
    assert len(got) == len(docs)
    assert all(tuple(r)[1:] == expected(r["doc_id"], docs[r["doc_id"]]) for r in got)
    assert sum(r["n_runs"] > 0 for r in got) >= 5
