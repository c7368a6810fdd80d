"""Runs of repeated words: maximal stretches of a smallest period ``q`` that hold at least ``TIMES`` periods.

A run of period ``p`` covers four places in a row of the grid 0, p, 2p, ... of its text, which hold the same word. Such
places are the candidates: their number is harmonic, n (1/1 + 1/2 + ...), and they are compared as arrays. A candidate's run
follows from how far the text agrees with itself, ``p`` words on, to the right and to the left; these extensions are
answered exactly by a recompression grammar (``recompression``), which is built for all texts of a block that have
candidates. Multiples of a period find the same stretch again, so the smallest one that finds a stretch is its period.

Texts are independent, so nothing is shuffled; a block holds about ``BLOCK`` bytes of text, or one longer text.

Defined cases: null, empty and white texts have no words and no run; a null id is not rewritten by ``planted``; rows that
repeat are answered each; an empty table gives an empty result; input columns travel in one struct column.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.recompression import Grammar

LEAST, TIMES = 6, 4
BLOCK = 1 << 21
CANDIDATES = 1 << 20

Rewrite = Callable[[int | None, int], np.ndarray | None]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a text that every tenth document has instead of its own; None: its own."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def grid(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid places whose word stands at the next ``TIMES - 1`` places of the grid too, in portions."""
    n = len(words)
    periods = np.arange(1, n // TIMES + 1)
    sizes = (n - 1) // periods - (TIMES - 2)
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends, np.arange(CANDIDATES, int(ends[-1]) if n >= TIMES else 0, CANDIDATES))
    for some, size in zip(np.split(periods, cuts), np.split(sizes, cuts)):
        if not len(some):
            continue
        p = np.repeat(some, size)
        i = (np.arange(len(p)) - np.repeat(np.cumsum(size) - size, size)) * p
        for k in range(1, TIMES):
            same = words[i] == words[i + k * p]
            i, p = i[same], p[same]
        if len(i):
            yield i, p


def runs(texts: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Per text with runs its (start, length, period) rows, by start and period."""
    found = [(t, i, p) for t, words in enumerate(texts) if len(words) >= LEAST for i, p in grid(words)]
    if not found:
        return {}
    used = sorted({t for t, _, _ in found})
    lengths = np.array([len(texts[t]) for t in used])
    starts = np.cumsum(lengths + 1) - lengths  # a barrier before every text and after the last
    symbols = np.zeros(int(lengths.sum()) + len(used) + 1, np.int64)
    barrier = np.zeros(len(symbols), bool)
    barrier[starts - 1] = barrier[-1] = True
    for t, at in zip(used, starts.tolist()):
        symbols[at : at + len(texts[t])] = texts[t]
    grammar, base = Grammar(symbols, barrier), dict(zip(used, starts.tolist()))
    out, held = [], 0
    portion: list[tuple[np.ndarray, np.ndarray]] = []

    def extended() -> None:
        i, p = (np.concatenate(x) for x in zip(*portion))
        left, right = grammar.extend(i - 1, i + p - 1, back=True), grammar.extend(i, i + p)
        start, length = i - left, left + p + right
        long = length >= np.maximum(LEAST, TIMES * p)
        rows = np.stack([start[long], length[long], p[long]], axis=1)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        out.append(rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows)

    for t, i, p in found:
        portion.append((i + base[t], p))
        held += len(i)
        if held >= CANDIDATES:
            extended()
            portion, held = [], 0
    if portion:
        extended()
    rows = np.concatenate(out)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    text = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows[:, 0] -= starts[text]
    parts = np.split(rows, np.flatnonzero(np.diff(text)) + 1) if len(rows) else []
    return dict(zip((used[t] for t in dict.fromkeys(text.tolist())), parts))


def _block(ids: list, texts: list[bytes | None], rewrite: Rewrite | None) -> tuple[list[list[bytes]], list[np.ndarray], dict]:
    words = [(x or b"").split() for x in texts]
    codes = pa.array([w for some in words for w in some], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    numbers = np.split(codes.astype(np.int64), np.cumsum([len(w) for w in words])[:-1])
    if rewrite:
        for k, doc in enumerate(ids):
            places = rewrite(doc, len(words[k]))
            if places is not None:
                numbers[k], words[k] = numbers[k][places], [words[k][x] for x in places.tolist()]
    return words, numbers, runs(numbers)


def _kept(words: list[bytes], rows: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


RESULT = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def detected(docs: DataFrame, carry: list[str], rewrite: Rewrite | None = None, doc_id: str = "doc_id") -> DataFrame:
    """``row`` and, per document: how many runs, the longest one, digests of all runs and of the text without repetitions, and
    ``runs`` (all of them) and ``collapsed`` (that text)."""
    row = F.struct(*[docs[c] for c in carry])
    schema = f"row {docs.select(row.alias('row')).schema['row'].dataType.simpleString()}, {RESULT}, " \
             "runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def answered(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, _, found = _block(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), rewrite)
        rows, every, collapsed = [], [], []
        for k, text in enumerate(words):
            own = found.get(k)
            if own is None:
                line, kept = (0, None, None, None, None), text
            else:
                best = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()
                line, kept = (len(own), *best, 1000 * best[1] // best[2]), _kept(text, own)
            collapsed.append(b" ".join(kept))
            listed = own.tolist() if own is not None else []
            every.append([{"start": s, "length": n, "period": p} for s, n, p in listed])
            digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in listed).encode())
            rows.append((*line, digest.hexdigest(), hashlib.sha256(collapsed[-1]).hexdigest()))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        names = [c.split()[0] for c in RESULT.split(", ")]
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *columns, pa.array(every, pa.list_(run)), pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=["row", *names, "runs", "collapsed"])

    def work(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            turn = (np.cumsum(sizes) - sizes) // BLOCK
            edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                if stop > start:
                    yield answered(batch.slice(start, stop - start))

    return docs.select(row.alias("row"), docs[doc_id].cast("long").alias("id"), docs["text"].cast("string").alias("text")).mapInArrow(work, schema)
