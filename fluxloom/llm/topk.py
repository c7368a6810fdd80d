"""Exact top-k inner products through a pivot-distance index.

**Index.** Vectors are whole numbers. One coordinate more, ``sqrt(M^2 - |x|^2)``, gives all of them the norm ``M`` and a
query keeps 0 there; a higher score is then a smaller distance: ``d^2 = |q|^2 + M^2 - 2 q.x``. Every vector is keyed by its
nearest pivot and its distance to it. There is a pivot for every ``CHUNK`` rows, ``PIVOTS`` at least and ``MOST_PIVOTS`` at
most: vectors that are first by hash (a bounded sample; every vector is indexed). A pivot's vectors are cut into chunks of about ``CHUNK`` rows, so a pivot that attracts a third of all rows
just has more chunks, and a chunk sorts its rows by distance into annuli of ``ANNULUS`` rows.

**Search.** By the triangle inequality a vector at distance ``r`` from its pivot is ``|d(q, p) - r|`` away from the query at
least, which bounds its score. A query first searches its nearest pivot's chunks, which gives a lower bound of its
``k``-th score; then it goes to the other pivots whose bound reaches that score. In a chunk, annuli are expanded from the
query's distance outwards and the search stops at the first whose bound lies below the ``k``-th score. Chunks of queries
and of vectors meet by a shuffle; scores are exact integer products of blocks. A chunk that no query visits is not moved, and a
visited one is copied once for every ``QUERIES`` queries that visit it, so what is shuffled follows the visits.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do rows without id and
vectors of another length than the most frequent (then longest) one; a query has no result if it is alone; rows with
the query's own id are not its candidates; equal query rows are answered once; repeated candidates count each; ties go
to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.storage import store

PIVOTS, MOST_PIVOTS = 32, 4096
CHUNK = 4096
ANNULUS = 512
QUERIES = 4096
TOGETHER = 256
EXACT = float(1 << 53)
FOUND = "query_id long, query_key long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): ``floor(scale * x)`` of every usable vector."""
    usable = F.forall(vectors[embedding], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(vectors[vec_id].isNotNull() & F.coalesce(usable, F.lit(False))).select(
        vectors[vec_id].cast("long").alias("vec_id"),
        F.transform(vectors[embedding], lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Inner products of rows, exact: in doubles while every one fits, else in unbounded integers."""
    if exact_floats:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


class Space:
    """Pivots with the common norm; distances from vectors and from queries to them."""

    def __init__(self, pivots: np.ndarray, square: float):
        self.pivots, self.square = pivots.astype(float), square
        self.lift = np.sqrt(np.maximum(square - (self.pivots**2).sum(axis=1), 0))
        self.exact = square < EXACT

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(float)
        lift = np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.square - 2 * (x @ self.pivots.T + np.outer(lift, self.lift)), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        x = q.astype(float)
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + self.square - 2 * x @ self.pivots.T, 0))

    def highest(self, q_square: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Highest score at a distance of ``gap`` or more, with room for rounding."""
        return (q_square + self.square - np.maximum(gap - 1e-6 * np.sqrt(self.square + 1), 0) ** 2) / 2 + 1e-9 * self.square + 1e-6


def indexed(vectors: DataFrame, space: Space, dim: int) -> DataFrame:
    """(vec_id, v, pivot, r, slot); ``slot`` only spreads a pivot's rows over its chunks."""
    def run(batches):
        slot, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            distance = space.of_vectors(_matrix(batch.column(1), dim))
            nearest = distance.argmin(axis=1)
            slots = np.arange(slot, slot + len(nearest)) + part
            slot += len(nearest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nearest.astype(np.int32)),
                 pa.array(distance[np.arange(len(nearest)), nearest]), pa.array(slots)],
                names=["vec_id", "v", "pivot", "r", "slot"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, pivot int, r double, slot long")


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """The first ``k`` of each row number, by falling score, then id."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[rank < k], scores[rank < k], ids[rank < k]


def search_chunk(space: Space, pivot: int, ids, v, r, q_ids, q, floor, k: int):
    """(query row, score, id) of the best in one chunk, none below ``floor``; annuli go outwards from each query."""
    order = np.argsort(r, kind="stable")
    ids, v, r = ids[order], v[order], r[order]
    starts = np.arange(0, len(r), ANNULUS)
    low, high = r[starts], r[np.minimum(starts + ANNULUS, len(r)) - 1]
    to_pivot = space.of_queries(q)[:, pivot]
    gap = np.maximum(np.maximum(low - to_pivot[:, None], to_pivot[:, None] - high), 0)
    q_square = (q.astype(float) ** 2).sum(axis=1)
    bound = space.highest(q_square[:, None], gap)
    turn = np.argsort(gap, axis=1, kind="stable")
    floor = floor.copy()
    rows, scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for step in range(len(starts)):
        at = turn[:, step]
        active = bound[np.arange(len(q)), at] >= floor
        for annulus in np.unique(at[active]):
            some = np.flatnonzero(active & (at == annulus))
            part = slice(starts[annulus], starts[annulus] + ANNULUS)
            score = products(q[some], v[part], space.exact)
            i, j = np.nonzero((score >= floor[some][:, None]) & (ids[part][None, :] != q_ids[some][:, None]))
            rows = np.concatenate([rows, some[i]])
            scores = np.concatenate([scores, score[i, j]])
            found = np.concatenate([found, ids[part][j]])
        rows, scores, found = _best(rows, scores, found, k)
        full = np.flatnonzero(np.bincount(rows, minlength=len(q)) == k)
        last = np.searchsorted(rows, full, side="right") - 1
        floor[full] = np.maximum(floor[full], scores[last])
    return rows, scores, found


def copies_of_chunks(visits: DataFrame) -> DataFrame:
    """(pivot, chunk, copies) of the visited chunks: one copy for every ``QUERIES`` visits, or part of them."""
    return visits.groupBy("pivot", "chunk").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("copies"))


def copied(index: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows of the visited chunks, once for each ``part`` of the queries that visit theirs."""
    parts = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    return index.join(copies, ["pivot", "chunk"]).select("pivot", "chunk", parts.alias("part"), "vec_id", "v", "r")


def _searched(index: DataFrame, visits: DataFrame, space: Space, dim: int, k: int) -> DataFrame:
    """Chunks of vectors and of queries meet; ``visits`` has one row per query and (pivot, chunk) to visit."""
    copies = store(copies_of_chunks(visits), "topk-copies")
    left = copied(index, copies)
    part = F.pmod(F.xxhash64("vec_id", "query_key"), F.col("copies")).cast("int")
    queries = visits.join(copies, ["pivot", "chunk"]).withColumn("part", part).drop("copies")
    keys = ["pivot", "chunk", "part"]

    def run(key, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not vectors.num_rows or not asked.num_rows:
            return schema.empty_table()
        column = lambda t, name: t.column(name).combine_chunks()
        ids, r = column(vectors, "vec_id").to_numpy(), column(vectors, "r").to_numpy()
        v, q = _matrix(column(vectors, "v"), dim), _matrix(column(asked, "v"), dim)
        q_ids, q_keys = column(asked, "vec_id").to_numpy(), column(asked, "query_key").to_numpy()
        floor = column(asked, "floor").to_numpy()
        out = []
        for at in range(0, len(q), TOGETHER):
            part = slice(at, at + TOGETHER)
            rows, scores, found = search_chunk(space, key[0].as_py(), ids, v, r, q_ids[part], q[part], floor[part], k)
            out.append((q_ids[part][rows], q_keys[part][rows], found, scores))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return left.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, scale: int = 64, k: int = 20, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query; ``is_query`` is a condition on ``vec_id``.

    ``pivots`` is their number; without it, it follows the number of rows.
    """
    spark = vectors.sparkSession
    usable = store(whole_numbers(vectors, scale), "topk-vectors")
    lengths = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    if lengths is None or lengths["n"] == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = lengths["n"]
    usable = usable.where(F.size("v") == dim)
    square = usable.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    pivots = pivots or min(max(PIVOTS, -(-lengths["count"] // CHUNK)), MOST_PIVOTS)
    first = usable.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(pivots).collect()
    space = Space(np.array([r["v"] for r in first], np.int64), float(square))
    index = store(indexed(usable, space, dim), "topk-index")
    ranges = index.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()
    chunks = {r["pivot"]: -(-r["n"] // CHUNK) for r in ranges}
    low, high = np.full(len(first), np.inf), np.full(len(first), np.inf)
    for r in ranges:
        low[r["pivot"]], high[r["pivot"]] = r["low"], r["high"]
    numbers = F.split(F.lit(",".join(str(chunks.get(p, 1)) for p in range(len(first)))), ",").cast("array<int>")
    per_pivot = F.element_at(numbers, F.col("pivot") + 1)
    index = index.withColumn("chunk", F.pmod(F.xxhash64("slot"), per_pivot).cast("int"))
    asked = usable.where(is_query).withColumn("query_key", F.xxhash64("v")).dropDuplicates(["vec_id", "query_key"])
    asked = store(asked, "topk-queries")

    def visits(rows: DataFrame, home: bool) -> DataFrame:
        """One row per query and chunk: of its nearest pivot, or of all others that may hold a score from ``floor`` on."""
        def run(batches):
            for batch in batches:
                q = _matrix(batch.column(1), dim)
                distance = space.of_queries(q)
                open_ = np.where(np.isfinite(low), distance, np.inf)
                nearest = open_.argmin(axis=1)
                floors = batch.column(3).to_numpy()
                if home:
                    row, pivot = np.arange(len(q)), nearest
                else:
                    gap = np.maximum(np.maximum(low - distance, distance - high), 0)
                    bound = space.highest((q.astype(float) ** 2).sum(axis=1)[:, None], gap)
                    reach = np.isfinite(low)[None, :] & (bound >= floors[:, None])
                    reach[np.arange(len(q)), nearest] = False
                    row, pivot = np.nonzero(reach)
                n = np.array([chunks.get(p, 1) for p in range(len(first))])[pivot]
                row, pivot = np.repeat(row, n), np.repeat(pivot, n)
                chunk = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(pivot.astype(np.int32)), pa.array(chunk.astype(np.int32))],
                    names=["vec_id", "v", "query_key", "floor", "pivot", "chunk"])

        return rows.select("vec_id", "v", "query_key", "floor").mapInArrow(
            run, "vec_id long, v array<long>, query_key long, floor long, pivot int, chunk int")

    least = F.lit(-(1 << 62)).cast("long")
    near = _searched(index, visits(asked.withColumn("floor", least), True), space, dim, k)
    near = store(_ranked(near, k), "topk-near")
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_key").alias("key"), F.col("score").alias("kth"))
    bounded = asked.join(floors, (F.col("vec_id") == F.col("id")) & (F.col("query_key") == F.col("key")), "left").withColumn(
        "floor", F.coalesce("kth", least)).select("vec_id", "v", "query_key", "floor")
    far = _searched(index, visits(store(bounded, "topk-bounded"), False), space, dim, k)
    return _ranked(near.drop("rank").unionByName(far), k).select("query_id", "rank", "vec_id", "score")
