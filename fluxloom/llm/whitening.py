"""Whitening of embeddings by mixed-precision eigenvectors of their distributed covariance.

**Covariance.** Entries are whole numbers ``x = floor(SCALE * c) + OFFSET``. One pass sums them; a second one centres every
vector on the rounded-down mean before it multiplies, in tasks, and sums products of whole numbers, so counts, sums and
covariance are exact, whatever the order. A task sends the upper triangle of its sums, not vectors; the driver gets one matrix.

**Eigenvectors.** The float32 solution of the covariance is only a start. Ogita-Aishima steps correct it: with
``R = I - X'X`` and ``S = X'AX`` each pair of columns is rotated by ``(S + l R) / (l_j - l_i)``, matrix products only, first in
double and then in extended precision, until a step moves nothing that a double can show. Columns whose eigenvalues are too
close for a step form a cluster; a cluster is solved for itself, shifted by its mean, and goes on with the others.

**Whitening.** Vectors are centred exactly, projected and scaled in tasks; the covariance of the result is taken again, by
the same two passes, and compared with the identity.

Defined cases: vectors that are null, or hold null, NaN or infinite entries, take no part, nor do vectors of another length
than the most frequent (then longest) one and vectors with an entry beyond 62 bits; rows that repeat, and rows without id,
count and are returned as often as they stand; a component without variance has the whitened value null and no place in the
comparison; a deviation beyond 63 bits is null; an empty table gives an empty result. Input columns travel in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.storage import store

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
NEAR = 2.0**-17  # eigenvalues closer than this part of the matrix's size are a cluster
LIMB = 40  # bits per part of a sum too long for 64 bits
EXACT_FLOAT, EXACT_LONG = 1 << 53, 1 << 62
SUMS = "i int, j int, limb int, v long"


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: counts and sums, whole centre, and the components with their eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # one column each
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]

    @property
    def has_variance(self) -> np.ndarray:
        return self.values > len(self.sums) * 2.0**-52 * self.trace


def usable(vectors: DataFrame, carry: list[str], embedding: str = "embedding") -> DataFrame:
    """``row`` and ``x`` of every vector that takes part, stored."""
    low, high = F.lit(-float(EXACT_LONG)), F.lit(float(EXACT_LONG))
    fine = F.forall(vectors[embedding], lambda c: c.isNotNull() & (SCALE * c.cast("double") > low) & (SCALE * c.cast("double") < high))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.struct(*[vectors[c] for c in carry]).alias("row"),
        F.transform(vectors[embedding], lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + OFFSET).alias("x"))
    rows = store(rows, "whitening-vectors")
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("x") == (lengths["length"] if lengths else 0))


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind, copy=False)


def _bound(z: np.ndarray) -> int:
    return max(int(z.max(initial=0)), -int(z.min(initial=0)))


def _gram(z: np.ndarray) -> np.ndarray:
    """Products of whole numbers, summed over rows: in doubles where each is exact, else in unbounded integers."""
    if _bound(z) ** 2 * len(z) < EXACT_FLOAT:
        x = z.astype(float)
        return (x.T @ x).astype(np.int64)
    return z.astype(object).T @ z.astype(object)


def _limbs(total: int) -> list[int]:
    if -EXACT_LONG < total < EXACT_LONG:
        return [total]
    return [total & ((1 << LIMB) - 1), *_limbs(total >> LIMB)]


def _whole_sums(part) -> pa.RecordBatch:
    """Rows (i, j, limb, v) of ``part``: per (i, j) a whole number of any length."""
    rows = [(i, j, k, v) for i, j, total in part for k, v in enumerate(_limbs(int(total)))]
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "limb", "v"])


def _collected(partial: DataFrame) -> dict[tuple[int, int], int]:
    """Sum per (i, j) over all tasks: one matrix, whatever the number of rows."""
    summed = partial.groupBy("i", "j", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).toArrow()
    out: dict[tuple[int, int], int] = {}
    for i, j, k, v in zip(*(summed.column(c).to_pylist() for c in ("i", "j", "limb", "v"))):
        out[i, j] = out.get((i, j), 0) + (int(v) << LIMB * k)
    return out


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and the sum of every dimension."""

    def run(batches):
        n, total = 0, 0
        for batch in batches:
            x = _matrix(batch.column(0))
            n += len(x)
            small = _bound(x) * max(len(x), 1) < EXACT_LONG
            total = total + (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
        if n:
            yield _whole_sums([(-1, -1, n), *((j, -1, s) for j, s in enumerate(total))])

    sums = _collected(rows.select("x").mapInArrow(run, SUMS))
    n = sums.pop((-1, -1), 0)
    return n, [sums[j, -1] for j in range(len(sums))]


def _products(rows: DataFrame, centre: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums of products of vectors less ``centre``, upper triangle."""
    upper = np.triu_indices(len(centre))

    def flushed(total):
        return _whole_sums(zip(upper[0].tolist(), upper[1].tolist(), total[upper].tolist()))

    def run(batches):
        total, bound = None, 0
        for batch in batches:
            gram = _gram(_matrix(batch.column(0)) - centre)
            more = int(abs(gram).max(initial=0))
            if total is not None and bound + more >= EXACT_LONG:
                yield flushed(total)
                total, bound = None, 0
            total, bound = gram if total is None else total + gram, bound + more
        if total is not None:
            yield flushed(total)

    return _collected(rows.select("x").mapInArrow(run, SUMS))


def covariance(products: dict[tuple[int, int], int], n: int, rest: list[int]) -> np.ndarray:
    """The exact covariance, rounded to extended precision; ``rest / n`` is what the whole centre lacks to the mean."""
    v = np.zeros((len(rest), len(rest)), np.longdouble)
    for (i, j), total in products.items():
        whole, part = divmod(n * total - rest[i] * rest[j], n * n)
        v[i, j] = v[j, i] = np.longdouble(whole) + np.longdouble(part / (n * n))
    return v


def _size(m: np.ndarray):
    return np.sqrt((m * m).sum())


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], float]:
    """One Ogita-Aishima correction: the columns, their clusters, and the largest entry of the change."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    near = max(20 * (_size(s - np.diag(np.diag(s))) + _size(a) * _size(r)), NEAR * _size(a))
    apart = values[None, :] - values[:, None]
    far = abs(apart) > near
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    order = np.argsort(values, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(values[order]) > near) + 1)
    return x + x @ e, [p for p in parts if len(p) > 1], float(abs(e).max(initial=0))


def _solve_cluster(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The columns of one cluster, turned within their span: the same problem, shifted and scaled up."""
    shift = np.diag(x.T @ (a @ x)).mean()
    inner = x.T @ (a @ x - shift * x)
    inner = (inner + inner.T) / 2
    if abs(inner).max() <= len(a) * np.finfo(a.dtype).eps * abs(a).max():
        return x  # equal eigenvalues: any basis serves
    turn = np.linalg.eigh(inner.astype(float))[1] if len(inner) == len(a) else eigenvectors(inner)[1]
    return x @ turn.astype(x.dtype)


def eigenvectors(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit columns) of a symmetric matrix, falling, correct to double precision."""
    scale = abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = a.astype(np.longdouble) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1]
    for kind, enough in ((np.float64, 1e-10), (np.longdouble, 2.0**-56)):
        exact, x = a.astype(kind), x.astype(kind)
        for _ in range(rounds):
            x, groups, change = _step(exact, x)
            for group in groups:
                x[:, group] = _solve_cluster(exact, x[:, group])
            if change <= enough:
                break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.diag(x.T @ (a @ x))
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.where(x[abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)
    return (values[order] * scale).astype(float), x


def fit(rows: DataFrame) -> Whitening | None:
    """Counts, sums and components of stored ``usable`` vectors; None without any."""
    n, sums = _totals(rows)
    if not n:
        return None
    centre, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    v = covariance(_products(rows, centre), n, rest)
    values, components = eigenvectors(v)
    return Whitening(n, tuple(sums), components.astype(float), values, float(np.trace(v)))


def _deviations(z: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Per row the exact sum of ``(n x - S)^2``."""
    if (n * (_bound(z) + 1)) ** 2 * max(z.shape[1], 1) < EXACT_LONG:
        d = n * z - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * z.astype(object) - np.array(rest, object)
    return [x if x < 1 << 63 else None for x in (d * d).sum(axis=1)]


def project(rows: DataFrame, fitted: Whitening, components: int = COMPONENTS) -> DataFrame:
    """``row``, ``deviation`` and ``w`` (an array of up to ``components`` whitened values) of every vector, stored."""
    k = min(components, len(fitted.sums))
    alive = fitted.has_variance[:k]
    weights = fitted.components[:, :k] / np.sqrt(np.where(alive, fitted.values[:k], 1))
    n, centre, rest = fitted.n, fitted.centre, fitted.rest
    share = np.array([r / n for r in rest])

    def run(batches):
        for batch in batches:
            z = _matrix(batch.column("x")) - centre
            w = (z - share) @ weights
            offsets = pa.array(np.arange(0, w.size + 1, max(k, 1)) if k else np.zeros(len(z) + 1, int), pa.int32())
            flat = pa.array(w.ravel(), mask=np.tile(~alive, len(z)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(_deviations(z, n, rest), pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                names=["row", "deviation", "w"])

    kind = rows.schema["row"].dataType.simpleString()
    return store(rows.mapInArrow(run, f"row {kind}, deviation long, w array<double>"), "whitened")


def identity_error(projected: DataFrame, n: int, alive: list[int]) -> float | None:
    """Largest absolute entry of the whitened values' covariance less the identity."""
    if not alive:
        return None

    def sums(shift: np.ndarray | None) -> dict[tuple[int, int], float]:
        def run(batches):
            total = 0
            for batch in batches:
                w = _matrix(batch.column(0), float)[:, alive]
                total = total + (w.sum(axis=0)[:, None] if shift is None else (w - shift).T @ (w - shift))
            if np.ndim(total):
                i, j = (x.ravel() for x in np.indices(total.shape))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

        parts = projected.select("w").mapInArrow(run, "i int, j int, s double")
        return {(r["i"], r["j"]): r["s"] for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}

    means = np.array([s / n for _, s in sorted(sums(None).items())])
    return max(abs(s / n - (i == j)) for (i, j), s in sums(means).items())


def whiten(vectors: DataFrame, carry: list[str], components: int = COMPONENTS, embedding: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``row``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = usable(vectors, carry, embedding)
    fitted = fit(rows)
    if fitted is None:
        empty = "int component, long n, long deviation, double whitened, double explained, double identity_error".split(", ")
        return rows.select("row", *[F.lit(None).cast(c.split()[0]).alias(c.split()[1]) for c in empty])
    projected = project(rows, fitted, components)
    k = min(components, len(fitted.sums))
    error = identity_error(projected, fitted.n, np.flatnonzero(fitted.has_variance[:k]).tolist())
    shares = [float(v) / fitted.trace if fitted.trace else None for v in fitted.values[:k]]
    explained = reduce(lambda out, i: out.when(F.col("p") == i, F.lit(shares[i])), range(1, k), F.when(F.col("p") == 0, F.lit(shares[0]))) if k else F.lit(None)
    return projected.select("row", "deviation", F.posexplode("w").alias("p", "whitened")).select(
        "row", (F.col("p") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        explained.cast("double").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
