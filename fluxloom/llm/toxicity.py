"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

**Terms.** Words and their first 4, 5 and 6 letters, in lower case. The vocabulary is those that occur clearly more often
in toxic examples (chi-squared and share, below); a text without any of them resembles no toxic example. Examples that
are copies of each other (equal least hash of their word triples) count once there, so that a copied text does not make
its own words terms.

**Examples.** Of each label the first ``PER_LABEL`` labelled training rows by hash of their id: a bounded, documented
sample for fitting. Their vectors are ``(1 + ln tf) * idf``, of length one, where document frequencies are counted over
all documents.

**Search.** Examples stand in blocks of ``BLOCK``; each term has its postings by block and the largest weight in every
block. The sum of query weight times block maximum bounds every cosine in a block, so blocks are visited by falling bound
until the bound does not exceed the ``K``-th best so far. The cosines are those of comparing all examples; among equal
ones at the last place the first visited stays.

**Score.** Neighbours vote with their squared cosine, times the length of the text's own terms' vector (its evidence,
before it is made one) and times the number of rows that an example stands for; the other side of the vote has a constant
``DOUBT`` besides. The votes' log-odds are calibrated by logistic regression on the examples, each left out of its own
vote. Texts without terms get the share of toxic rows among such examples. Evidence lists the nearest examples.

Labels are learnt only from rows whose crc32 of the id modulo ``FOLDS`` is not ``HELD_OUT``; language, source and id are
no inputs of a score.

Defined cases: null and empty texts have no terms and get that share; without toxic examples every score is the smoothed
share of toxic labels; repeated rows get equal scores; a null id is never held out and never an example; an empty table
gives an empty result; carried columns travel in one struct.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm.text import whole
from fluxloom.storage import store

FOLDS, HELD_OUT = 4, 2
PER_LABEL = 1500
PREFIXES = (4, 5, 6)
MIN_ROWS, MIN_CHI, MIN_SHARE = 3, 15.0, 0.95
ONE_TERM = 0.9
BLOCK = 64
K = 15
DOUBT = 0.3
THRESHOLD = 0.3
AT_ONCE = 512
FULL = 400_000
PART = re.compile(r"[^\W\d_]+")


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def terms_of(token: str) -> list[str]:
    """Terms of a stretch without white space: each word and its beginnings (marked by a star)."""
    out = []
    for word in PART.findall(token.lower()):
        out.append(word)
        out += [word[:n] + "*" for n in PREFIXES if len(word) > n]
    return out


def least_triple(text: str) -> int:
    """Least hash of three words in a row; near copies mostly share it."""
    words = text.lower().split()
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) >> 1 for i in range(max(1, len(words) - 2)))


class Counter:
    """Occurrences of vocabulary terms, by a store of the stretches seen so far; emptied when full."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.known = vocabulary, {}

    def counts(self, text: str) -> tuple[list[int], list[int]]:
        tokens = text.split()
        new = set(tokens).difference(self.known)
        if len(self.known) + len(new) > FULL:
            self.known.clear()
            new = set(tokens)
        for token in new:
            self.known[token] = tuple(self.vocabulary[t] for t in terms_of(token) if t in self.vocabulary)
        found: dict[int, int] = {}
        for ids in filter(None, map(self.known.__getitem__, tokens)):
            for i in ids:
                found[i] = found.get(i, 0) + 1
        return list(found), list(found.values())


def examples_of(labels: DataFrame, per_label: int) -> DataFrame:
    """(id, toxic) of the sample: training rows of each label, first by hash."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    single = usable.groupBy(F.col("doc_id").alias("example")).agg(F.max("toxic").cast("int").alias("toxic"))
    first = [single.where(F.col("toxic") == n).orderBy(F.xxhash64("example"), "example").limit(per_label) for n in (0, 1)]
    return first[0].unionByName(first[1])


def vocabulary_of(sample: DataFrame) -> list[str]:
    """Terms tied to toxic examples, strongest first; counts are summed per task before they are shuffled."""
    def run(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in {t for token in set(text.split()) for t in terms_of(token)}:
                    seen.setdefault(term, [0, 0])[toxic] += 1
        rows = [(t, n[0], n[1]) for t, n in seen.items()]
        for at in range(0, len(rows), 10_000):
            term, clean, toxic = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_pydict({"term": list(term), "clean": pa.array(clean, pa.int64()), "toxic": pa.array(toxic, pa.int64())})

    @F.arrow_udf(T.LongType())
    def sketch(texts: pa.Array) -> pa.Array:
        return pa.array([least_triple(text) for text in texts.to_pylist()], pa.int64())

    sample = sample.withColumn("sketch", sketch("text")).groupBy("sketch", "toxic").agg(F.min_by("text", "example").alias("text"))
    sample = store(sample, "toxic-texts")
    totals = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not totals[0] or not totals[1]:
        return []
    positive, negative = float(totals[0]), float(totals[1])
    counted = sample.select("toxic", "text").mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n, rate = F.col("clean") + F.col("toxic"), positive / (positive + negative)
    chi = F.pow(F.col("toxic") - n * rate, 2) / (n * rate * (1 - rate))
    share = (F.col("toxic") / positive) / (F.col("toxic") / positive + F.col("clean") / negative)
    strong = counted.where((F.col("toxic") >= MIN_ROWS)).withColumns({"chi": chi, "share": share}).where(
        (F.col("chi") >= MIN_CHI) & (F.col("share") >= MIN_SHARE))
    found = [(r["term"], r["toxic"]) for r in strong.orderBy(F.col("chi").desc(), "term").collect()]  # of a bounded sample
    return most_specific(found)


def most_specific(found: list[tuple[str, int]]) -> list[str]:
    """Without beginnings that stand for one longer term: it has ``ONE_TERM`` of their rows."""
    most: dict[str, list[tuple[int, str]]] = {}  # per beginning its two commonest terms
    for other, m in found:
        for size in {n for n in PREFIXES if len(other) >= n}:
            most[other[:size]] = sorted([*most.get(other[:size], []), (m, other)], reverse=True)[:2]
    return [term for term, n in found if not (term.endswith("*") and any(
        other != term and m >= ONE_TERM * n for m, other in most[term[:-1]]))]


def logistic(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift by Newton steps, each halved until the weighted, lightly held-back loss falls."""
    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((v * (np.logaddexp(0, z) - y * z)).sum() + 0.1 * (a - 1) ** 2 + 0.05 * b * b)

    a, b = 1.0, 0.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        c = v * p * (1 - p)
        g = np.array([(v * (p - y) * x).sum() + 0.2 * (a - 1), (v * (p - y)).sum() + 0.1 * b])
        h = np.array([[(c * x * x).sum() + 0.2, (c * x).sum()], [(c * x).sum(), c.sum() + 0.1]])
        step, here = np.linalg.solve(h, g), loss(a, b)
        while np.abs(step).max() > 1e-9 and loss(a - step[0], b - step[1]) > here:
            step = step / 2
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


@dataclass
class Index:
    """Block-max inverted index over unit vectors."""

    places: list[np.ndarray]  # per term: examples, ascending
    weights: list[np.ndarray]
    edges: np.ndarray  # terms x (blocks + 1): where each block's postings begin
    highest: np.ndarray  # terms x blocks
    idf: np.ndarray
    ids: list[int]
    labels: np.ndarray
    stands_for: np.ndarray  # rows of the corpus per example, by label
    slope: float = 1.0
    shift: float = 0.0
    without: float = 0.0

    @classmethod
    def build(cls, vectors, idf, ids, labels, stands_for):
        n, terms = len(ids), len(idf)
        blocks = max(1, -(-n // BLOCK))
        postings: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for place, (some, weights, _) in enumerate(vectors):
            for t, w in zip(some, weights, strict=True):
                postings[t].append((place, w))
        places = [np.array([p for p, _ in x], np.int64) for x in postings]
        weights = [np.array([w for _, w in x]) for x in postings]
        edges = np.stack([np.searchsorted(p, np.arange(blocks + 1) * BLOCK) for p in places]) if terms else np.zeros((0, blocks + 1), int)
        highest = np.zeros((terms, blocks))
        for t in range(terms):
            np.maximum.at(highest[t], places[t] // BLOCK, weights[t])
        return cls(places, weights, edges, highest, idf, ids, labels, stands_for)

    def vector(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
        t = np.array(terms, np.int64)
        w = (1 + np.log(np.array(counts, float))) * self.idf[t]
        size = float(np.sqrt((w * w).sum()))
        return t, w / size, size

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the ``k`` nearest with a cosine above 0; ``leave`` is left out."""
        bound = weights @ self.highest[terms]
        best_p, best_c = np.zeros(0, np.int64), np.zeros(0)
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or len(best_c) == k and bound[block] <= best_c[-1] + 1e-9:
                break
            cosine = np.zeros(BLOCK)
            for t, w in zip(terms, weights):
                a, z = self.edges[t, block], self.edges[t, block + 1]
                cosine[self.places[t][a:z] - block * BLOCK] += w * self.weights[t][a:z]
            inside = np.flatnonzero(cosine)
            inside = inside[inside + block * BLOCK != leave]
            p, c = np.concatenate([best_p, inside + block * BLOCK]), np.concatenate([best_c, cosine[inside]])
            order = np.argsort(-c, kind="stable")[:k]
            best_p, best_c = p[order], c[order]
        return best_p, best_c

    def vote(self, places: np.ndarray, cosines: np.ndarray, size: float) -> float:
        """Log-odds of the weighted vote."""
        w = cosines**2 * size * self.stands_for[places] / self.stands_for.mean()
        return float(np.log((w * self.labels[places]).sum() + 1e-2) - np.log((w * (1 - self.labels[places])).sum() + DOUBT))

    def calibrate(self, vectors) -> None:
        raw, y, v, without = [], [], [], [1.0, 20.0]
        for i, (terms, weights, size) in enumerate(vectors):
            found = self.nearest(np.array(terms, np.int64), np.array(weights), leave=i) if len(terms) else None
            if found is None or not len(found[0]):
                without[0] += self.stands_for[i] * self.labels[i]
                without[1] += self.stands_for[i]
                continue
            raw.append(self.vote(*found, size))
            y.append(self.labels[i])
            v.append(self.stands_for[i])
        self.without = without[0] / without[1]
        if raw:
            self.slope, self.shift = logistic(np.array(raw), np.array(y, float), np.array(v) / np.mean(v))

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, str]:
        """Score and evidence: ``id:label:cosine`` of the three nearest examples."""
        if not terms or not self.ids:
            return self.without, ""
        t, w, size = self.vector(terms, counts)
        places, cosines = self.nearest(t, w)
        if not len(places):
            return self.without, ""
        logit = np.clip(self.slope * self.vote(places, cosines, size) + self.shift, -30, 30)
        nearest = ",".join(f"{self.ids[p]}:{int(self.labels[p])}:{c:.4f}" for p, c in zip(places[:3], cosines[:3]))
        return float(1 / (1 + np.exp(-logit))), nearest


def counted(docs: DataFrame, carry: list[str], vocabulary: list[str]) -> DataFrame:
    """``row``, the id, and the vocabulary terms of every text with their counts."""
    number = {term: i for i, term in enumerate(vocabulary)}

    @F.arrow_udf("struct<terms: array<int>, counts: array<int>>")
    def run(texts: pa.Array) -> pa.Array:
        counter = _counter(tuple(number))
        pairs = [counter.counts(text) for text in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.int32()))],
            names=["terms", "counts"])

    made = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), docs["doc_id"].alias("id"), run(whole(docs["text"])).alias("found"))
    return made.select("row", "id", "found.terms", "found.counts")


_counters: dict[int, tuple[tuple[str, ...], Counter]] = {}


def _counter(terms: tuple[str, ...]) -> Counter:
    """One per worker, so that its store outlives a batch."""
    if _counters.get(0, ((), None))[0] != terms:
        _counters[0] = (terms, Counter({t: i for i, t in enumerate(terms)}))
    return _counters[0][1]


def fit(docs: DataFrame, labels: DataFrame, carry: list[str], per_label: int = PER_LABEL) -> tuple[DataFrame, Index]:
    """Term counts of all documents, stored, and the calibrated index."""
    examples = store(examples_of(labels, per_label).coalesce(1), "toxic-examples")
    all_rows = labels.where(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"))).groupBy("toxic").count().collect()
    rows_of = {int(r["toxic"]): r["count"] for r in all_rows}
    texts = docs.select(docs["doc_id"].alias("id"), whole(docs["text"]).alias("text"))
    sample = texts.join(examples, F.col("id") == F.col("example")).select("example", "toxic", "text")
    vocabulary = vocabulary_of(sample)
    rows = store(counted(docs, carry, vocabulary), "toxic-counts")
    df = np.zeros(len(vocabulary))
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    n = rows.count()
    idf = np.log((1 + n) / (1 + df)) + 1
    drawn = rows.join(examples, F.col("id") == F.col("example")).select("example", "toxic", "terms", "counts").distinct().collect()
    drawn.sort(key=lambda r: (sorted(r["terms"], key=lambda t: (-idf[t], t))[:2], r["toxic"], r["example"], r["counts"]))
    y = np.array([r["toxic"] for r in drawn], float)
    stands_for = np.array([rows_of[r["toxic"]] / max(1, (y == r["toxic"]).sum()) for r in drawn])
    bare = Index.build([], idf, [], y, stands_for)
    vectors = [bare.vector(r["terms"], r["counts"]) if r["terms"] else ([], [], 0.0) for r in drawn]
    index = Index.build(vectors, idf, [r["example"] for r in drawn], y, stands_for)
    index.calibrate(vectors)
    if not vocabulary:
        index.without = (rows_of.get(1, 0) + 1) / (sum(rows_of.values()) + 20)
    return rows, index


def scored(rows: DataFrame, index: Index) -> DataFrame:
    """``row``, ``id``, ``score``, ``predicted`` and ``evidence`` of counted documents."""
    @F.arrow_udf("struct<score: double, evidence: string>")
    def run(terms: pa.Array, counts: pa.Array) -> pa.Array:
        known: dict[tuple, tuple[float, str]] = {}
        pairs = []
        for t, c in zip(terms.to_pylist(), counts.to_pylist()):
            key = tuple(sorted(zip(t, c)))
            if key not in known:
                known[key] = index.score([x[0] for x in key], [x[1] for x in key])
            pairs.append(known[key])
        return pa.StructArray.from_arrays(
            [pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.string())], names=["score", "evidence"])

    made = rows.select("row", "id", run("terms", "counts").alias("x"))
    return made.select("row", "id", "x.score", (F.col("x.score") >= THRESHOLD).cast("int").alias("predicted"), "x.evidence")
