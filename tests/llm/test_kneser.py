from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fluxloom.llm import hasharrays, kneser
from fluxloom.llm.queries import REGISTRY
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
END = "</end>"


def words_of(text):
    raw = (text or "").encode().lower().split()
    return [*raw, END]


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for text in texts:
            tokens = words_of(text)
            self.words.update(tokens)
            self.pairs.update(zip([END, *tokens], tokens))
        self.followers, self.forerunners = defaultdict(list), Counter()
        for (u, w), n in self.pairs.items():
            self.followers[u].append(n)
            self.forerunners[w] += 1
        self.n = sum(self.words.values())
        counts = [Counter(x.values()) for x in (self.forerunners, self.pairs)]
        self.low, self.high = (kneser.discounts(*(c[k] for k in (1, 2, 3, 4))) for c in counts)
        self.left = sum(self.cut(n, self.low) for n in self.forerunners.values())

    @staticmethod
    def cut(n, by):
        return by[min(n, 3) - 1] if n else 0.0

    def lowest(self, w):
        if not self.pairs:
            return 1.0
        n = self.forerunners[w]
        return (n - self.cut(n, self.low) + self.left / (len(self.words) + 1)) / len(self.pairs)

    def probability(self, u, w):
        if not self.words[u]:
            return self.lowest(w)
        n, left = self.pairs[u, w], sum(self.cut(k, self.high) for k in self.followers[u])
        return (n - self.cut(n, self.high) + left * self.lowest(w)) / self.words[u]

    def score(self, text):
        tokens = words_of(text)
        base = sum(math.log10((self.words[t] + 0.5) / (self.n + 0.5 * (len(self.words) + 1))) for t in tokens)
        return (len(tokens), sum(self.words[t] > 0 for t in tokens), self.n, base,
                sum(math.log10(self.probability(u, w)) for u, w in zip([END, *tokens], tokens)))


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def same(row, want):
    return tuple(row)[:3] == want[:3] and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(tuple(row)[3:], want[3:]))


def test_query_equals_plain_model(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain = Plain([t for i, t in docs.items() if not held_out(i)])
    got = REGISTRY["op13_lm_scoring"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == held_out(r["doc_id"]) and same(tuple(r)[2:], plain.score(docs[r["doc_id"]]))


def test_probabilities_after_any_word_sum_to_one():
    rng = random.Random(4)
    plain = Plain([" ".join(rng.choices("abcdefghij", weights=range(1, 11), k=rng.randint(0, 30))) for _ in range(40)])
    for before in (END, b"a", b"j", "never seen"):
        assert math.isclose(sum(plain.probability(before, w) for w in plain.words) + plain.probability(before, "unknown"), 1)


def test_hard_documents_in_many_shards_and_blocks(spark, hard, nothing, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()]
    plain = Plain([t for i, t in rows if not held_out(i)])
    for block, shard, chunk in ((1 << 23, 1 << 24, 1 << 20), (40000, 20000, 50)):
        monkeypatch.setattr(kneser, "BLOCK", block)
        monkeypatch.setattr(kneser, "SHARD", shard)
        monkeypatch.setattr(kneser, "CHUNK", chunk)
        frame = hard.withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
        got = kneser.scored(frame, frame.columns, ~kneser.is_held_out(frame["doc_id"])).collect()
        assert len(got) == len(rows)
        assert all(same(tuple(r)[1:], plain.score(r["row"]["text"])) for r in got)
    assert kneser.scored(nothing, ["doc_id"], F.lit(True)).collect() == []


def test_without_training_rows(spark, hard):
    got = kneser.scored(hard, ["doc_id"], F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got} == {(0, 0, 0.0, 0.0)}


def test_model_beats_words_alone_on_held_out_texts(spark):
    got = REGISTRY["op13_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_tokens(monkeypatch, chunk):
    monkeypatch.setattr(kneser, "CHUNK", chunk)
    texts = ["", " \t ", "one", "a bb  ccc\na", "é 日本語 " * 9, "x" * 300 + " a", "a"]
    hashes, sizes = kneser.tokens([t.encode().lower() for t in texts])
    names = [w for t in texts for w in words_of(t)]
    assert sizes.tolist() == [len(words_of(t)) for t in texts]
    assert len(set(zip(hashes.tolist(), names))) == len(set(names)) == len(set(hashes.tolist()))
    before, both = kneser.pairs(hashes)
    assert (kneser.second_word(before, both) == hashes).all()


def test_hash_arrays():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 56, 500, np.uint64))
    values = [rng.integers(0, 1 << k, len(keys), np.uint64) for k in (1, 17, 60)]
    assert all((a == b).all() for a, b in zip(hasharrays.unpack(hasharrays.pack(keys, *values)), [keys, *values]))
    parts = hasharrays.by_shard(7, keys, values[0])
    assert [s for s, _ in parts] == list(range(7)) and sum(len(hasharrays.unpack(c)[0]) for _, c in parts) == len(keys)
    shard = hasharrays.MappedShard(hasharrays.pack(keys, *values), 3)
    asked = np.sort(np.append(keys[::3], keys[::5] + np.uint64(1)))
    known = dict(zip(keys.tolist(), zip(*(v.tolist() for v in values))))
    assert list(zip(*(v.tolist() for v in shard.find(asked)))) == [known.get(k, (0, 0, 0)) for k in asked.tolist()]
    assert hasharrays.MappedShard(None, 2).find(asked)[1].tolist() == [0] * len(asked)
