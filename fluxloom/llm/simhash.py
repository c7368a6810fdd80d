"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

**Fingerprints.** 64 bits per text: a bit is 1 if it is set in over half of the XXH64 values of the word shingles.

**Keys.** Two fingerprints link at ``MAX_BITS`` = 3 or fewer differing bits. Of four 16-bit blocks at least one is then
equal, and of the two halves of the other 48 bits at least one differs in one bit at most. The first 23 bits of a half
are a word of the perfect binary Golay code (23, 12, 7). Every word has exactly one codeword within 3 bits and, if that
one is 3 bits away, five more at 4 bits. When words ``u`` and ``v`` differ in one bit at most, the nearest codeword of
``v`` lies within 4 bits of ``u``. So one side of the join carries the nearest codeword of each half (8 keys of 28 bits:
block, half and their 16 + 12 bits), the other side all codewords within 4 bits (1 or 6 instead of each), and no link
is lost. Candidates are verified inside the join condition; a pair of texts that differ is never emitted before that.

**Classes.** Exact copies have one fingerprint and are merged before keys are made, so links are only between different
fingerprints. Classes are the connected components of the links, by rounds of large-star and small-star edge rewriting;
each round is written to the shared folder. Hubs are joined, not gathered.

Defined cases: null and empty texts have fingerprint zero and link like any other; rows that repeat share a class; a
null id never names a class unless all its members lack an id; an empty table gives an empty result; input columns
travel in one struct column, so names cannot clash.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.storage import store

SEED = 42
WORDS = 3
MAX_BITS = 3
BLOCK = 16
CODE_BITS = 23
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the binary Golay code
CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> bytes:
    """Eight bytes, highest bit first."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_digest(joined, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words].tolist()
    stops = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        raw = b"".join([digest(joined[a:z], seed) for a, z in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(starts)).tobytes()


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    raw = b"".join([fingerprint(x) for x in texts.cast(pa.binary()).to_pylist()])
    return pa.array(np.frombuffer(raw, ">i8").astype(np.int64))


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndrome: remainder by the generator polynomial."""
    words = words.copy()
    for bit in range(CODE_BITS - 1, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


@lru_cache
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome the error patterns of up to 4 bits, lightest first (2048 x 6), and how many count (1 or 6)."""
    patterns = [np.array([0], np.int64)] + [
        np.array([sum(1 << b for b in bits) for bits in combinations(range(CODE_BITS), n)], np.int64) for n in (1, 2, 3, 4)
    ]
    table, used = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for group in patterns[:4]:
        at = _remainder(group)
        table[at, 0], used[at] = group, 1
    for pattern, at in zip(patterns[4], _remainder(patterns[4])):
        table[at, used[at]] = pattern
        used[at] += 1
    return table, used


def codewords(words: np.ndarray, near_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``words``, 12-bit codeword index): the nearest codeword, or all within 4 bits."""
    table, used = error_patterns()
    at = _remainder(words)
    n = np.ones(len(words), np.int64) if near_only else used[at]
    place = np.repeat(np.arange(len(words)), n)
    which = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    return place, (words[place] ^ table[at[place], which]) >> 11


def keys_of(prints: np.ndarray, near_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, key) rows for every block and half."""
    prints = prints.astype(np.uint64)
    found, keys = [], []
    for block in range(4):
        shift = np.uint64(BLOCK * block)
        value = (prints >> shift & np.uint64(0xFFFF)).astype(np.int64)
        low = prints & ((np.uint64(1) << shift) - np.uint64(1))
        high = prints >> shift >> np.uint64(BLOCK)
        rest = low | high << shift
        for half in range(2):
            word = (rest >> np.uint64(24 * half) & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)
            place, code = codewords(word, near_only)
            found.append(prints[place])
            keys.append((2 * block + half) << 28 | value[place] << 12 | code)
    return np.concatenate(found).astype(np.int64), np.concatenate(keys)


def _keyed(prints: DataFrame, near_only: bool, name: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            found, keys = keys_of(batch.column(0).to_numpy(), near_only)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found)], names=["key", name])

    return prints.select("print").mapInArrow(run, f"key long, {name} long")


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``low`` < ``high`` of distinct fingerprints with ``MAX_BITS`` or fewer differing bits, each once.

    Keys are 8 and more rows a fingerprint and made in Python, so Spark takes them to be as small as the fingerprints and
    would send them through the driver; the hint has them sorted and merged.
    """
    near, wide = _keyed(prints, True, "low"), _keyed(prints, False, "high")
    close = F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= MAX_BITS
    pairs = near.hint("merge").join(wide, (near["key"] == wide["key"]) & (F.col("low") < F.col("high")) & close)
    return pairs.select("low", "high").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node of the component, itself included."""
    edges = store(edges, "simhash-links")
    state = _state(edges)
    while True:
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).where(
            "low < high").distinct()
        large = store(large, "simhash-large-star")
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high")
        small = small.select(F.col("m").alias("low"), F.col("low").alias("high")).where("low < high").unionByName(
            least.select(F.col("m").alias("low"), "high")).distinct()
        edges = store(small, "simhash-small-star")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("low").alias("root"))).distinct()


def classes_of(rows: DataFrame) -> DataFrame:
    """(print, root, component_id) of every distinct fingerprint among ``rows`` (id, print)."""
    prints = store(rows.groupBy("print").agg(F.min("id").alias("first_id")), "simhash-distinct")
    roots = store(components(links(prints)), "simhash-roots")
    linked = roots.join(prints, F.col("node") == F.col("print")).select("node", "root", "first_id")
    named = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = roots.join(named, "root").select("node", "root", "class_id")
    known = prints.join(classes, F.col("print") == F.col("node"), "left").select(
        "print", F.coalesce("root", "print").alias("root"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("component_id"))
    return store(known, "simhash-classes")  # a plain join follows, whose hot fingerprints can be split


def printed(docs: DataFrame, carry: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``row``, ``id`` and ``print`` of every document, stored; ``h`` tells the rows of a fingerprint apart."""
    row = F.struct(*[docs[c] for c in carry])
    return store(docs.select(
        row.alias("row"), docs[doc_id].alias("id"), F.xxhash64(row).alias("h"),
        _fingerprints(docs["text"].cast("string")).alias("print")), "simhash-prints")


def classified(docs: DataFrame, carry: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Every row with ``print``, ``root`` (the class, as its smallest fingerprint) and ``component_id``."""
    rows = printed(docs, carry, doc_id)
    return rows.join(classes_of(rows), "print").select("row", "id", "print", "root", "component_id")


def one_of_each(docs: DataFrame, carry: list[str], doc_id: str = "doc_id") -> DataFrame:
    """One carried row per class: the smallest id, ids before nulls, equal ids by a hash of their columns.

    The choice is made over narrow rows; the carried columns are shuffled once, spread by fingerprint and row.
    """
    rows = printed(docs, carry, doc_id)
    rank = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("h"), F.col("print"))
    best = rows.select("id", "h", "print").join(classes_of(rows), "print").groupBy("root").agg(F.min(rank).alias("b"))
    best = best.select(F.col("b.print").alias("b_print"), F.col("b.h").alias("b_h"))
    chosen = rows.join(best, (F.col("print") == F.col("b_print")) & (F.col("h") == F.col("b_h")), "left_semi")
    return chosen.dropDuplicates(["print", "h"]).select("row.*")


def hexadecimal(bits):
    """16 lowercase hexadecimal digits of a long."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
