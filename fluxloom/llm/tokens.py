"""Token ids of documents in wavelet-matrix shards, in ascending order of ids.

Documents are dealt out by ranges of (id, hash of text), so that even one id with very many rows is split, sorted in
their range, encoded, and cut into shards of about ``SHARD_TOKENS`` tokens. A shard is one row with its bytes; Spark's
own writer commits the files, so lost executors and repeated tasks leave no half-written shard, and no task writes to
a local disk. Offsets come from the shards' token counts: sums over parts, then over the shards of each part.

Defined cases: a null text is empty and has the end id only; null ids come first; repeated rows follow each other; an
empty table gives no shard; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm.text import whole
from fluxloom.llm.wavelet import WaveletShard, build
from fluxloom.llm.wordpieces import encoder

END_ID = 2
SHARD_TOKENS = 1 << 20
AT_ONCE = 1024
SHARDS = "part long, shard long, tokens long, docs long, content binary"


def shards_of(docs: DataFrame, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
              doc_id: str = "doc_id") -> DataFrame:
    """One row per shard: its part and number in the part, its counts and its bytes."""
    text = whole(docs["text"])
    ordered = docs.select(docs[doc_id].cast("long").alias("id"), text.alias("text")).repartitionByRange(
        F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches):
        code = encoder(vocabulary)
        end = np.array([end_id], code.kind).tobytes()
        size, part, number = code.kind.itemsize, TaskContext.get().partitionId(), 0
        ids, parts, lengths, held = [], [], [], 0

        def shard():
            nonlocal ids, parts, lengths, held, number
            tokens = np.frombuffer(b"".join(parts), code.kind)
            row = [part, number, len(tokens), len(ids), build(tokens, ids, np.array(lengths, np.int64))]
            ids, parts, lengths, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_pydict({c.split()[0]: [v] for c, v in zip(SHARDS.split(", "), row)})

        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                piece = batch.slice(at, AT_ONCE)
                coded = code.encode(piece.column(1).cast(pa.binary()).to_pylist())
                for one, raw in zip(piece.column(0).to_pylist(), coded):
                    ids.append(one)
                    parts += (raw, end)
                    lengths.append(len(raw) // size + 1)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield shard()
        if ids:
            yield shard()

    return ordered.mapInArrow(run, SHARDS)


def per_document(shards: DataFrame) -> DataFrame:
    """Read back from the shards: id, place of the first token among all, number of tokens, CRC-32 of the 32-bit ids."""
    sums = shards.groupBy("part").agg(F.sum("tokens").alias("all"))
    whole_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("part", "shard", "tokens").join(
        sums.select("part", F.coalesce(F.sum("all").over(whole_parts), F.lit(0)).alias("base")), "part"
    ).select("part", "shard", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("base"))

    def run(batches):
        for batch in batches:
            for part, number, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held = WaveletShard(content)
                tokens = held.tokens().astype("<u4")
                ids, lengths = held.documents()
                stops = np.cumsum(lengths)
                crc = [zlib.crc32(tokens[a:z]) for a, z in zip((stops - lengths).tolist(), stops.tolist())]
                n = len(ids)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * n, pa.int64()), "shard": pa.array([number] * n, pa.int64()),
                    "doc_id": pa.array(ids, pa.int64()), "inside": pa.array(stops - lengths),
                    "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    read = shards.select("part", "shard", "content").mapInArrow(
        run, "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(offsets, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
