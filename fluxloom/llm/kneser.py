"""Interpolated modified Kneser-Ney word model of order 2: counted in Spark, kept as sorted hash arrays, looked up in shards.

**Tokens.** Texts with A-Z lower-cased, words without ASCII white space, one end after the last. The end of a text is also
what stands before its first word, so every token has one before it and a text without words is one end.

**Blocks.** Equal texts are counted together once and packed, about ``BLOCK`` bytes a row. A word is a 56-bit hash of its bytes;
a pair's hash is built so that the pair's second word can be told from it and its first word.

**Counts.** A task sends, for each block and shard (a range of the hash space), its distinct hashes in ascending order with
their counts, packed to differences. A shard adds them up: pairs give their counts, how many words follow each word once,
twice and more often, and how many different words stand before each word. Words that are very frequent have one entry a block.

**Model.** Per shard one row: ascending hashes and their counts, of words and of pairs. Discounts follow from the
numbers of pairs seen once to four times, and of words that follow one to four different ones; the lowest level is
interpolated with a uniform distribution over all known words and one unknown one, so the probabilities after any word sum to 1.

**Scores.** Blocks ask shards for their distinct hashes; a worker maps a shard's arrays into memory, answers with counts, and
the block adds up the logarithms of its texts. Only hashes and counts are shuffled; no task or driver holds the model.

Defined cases: a null text is empty; a null id counts as the empty text where rows are chosen by its checksum; rows that
repeat count each; without training rows every token has the probability of the uniform distribution, which is 1; an empty
table gives an empty result; input columns travel in one struct column.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.hasharrays import MASK, MappedShard, by_shard, pack, summed, unpack
from fluxloom.llm.text import whole
from fluxloom.storage import fresh_path, scratch, store, write

BLOCK = 1 << 23
SHARD = 1 << 23  # bytes of text; a task holds all counts of a shard, and an executor runs several tasks
CHUNK = 1 << 20
WORD, PAIR = 0, 1
COLUMNS = {WORD: 5, PAIR: 1}

_random = np.random.default_rng(42)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.where(_SPACE, 0, _random.integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1))
_BASE, _PAIR = (int(x) << 1 | 1 for x in _random.integers(0, 1 << 62, 2))
_UNPAIR = np.uint64(pow(_PAIR, -1, 1 << 64))
END = np.uint64(int(_random.integers(0, 1 << 56)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return (x ^ x >> np.uint64(33)) & MASK


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(_BASE)
    return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word."""
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, sizes)
    terms = _BYTES[raw[starts[0] :]] * _powers(int(sizes.max()))[place]
    return starts, _mixed(np.add.reduceat(terms, starts - starts[0]))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number per text) of the tokens of ``texts`` one after another, their ends included."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    gaps = np.flatnonzero(_SPACE[raw])
    starts, hashes, at = [], [], 0
    while at < len(raw):
        k = np.searchsorted(gaps, at + CHUNK, "right") - 1  # the last gap in reach, or the next one
        stop = at + CHUNK if at + CHUNK >= len(raw) else int(gaps[k]) if k >= 0 and gaps[k] > at else int(gaps[k + 1]) if k + 1 < len(gaps) else len(raw)
        found, values = word_hashes(raw[at:stop])
        starts.append(found + at)
        hashes.append(values)
        at = stop
    starts, hashes = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (starts, hashes))
    text = np.searchsorted(begins, starts, "right") - 1
    counts = np.bincount(text, minlength=len(texts)) + 1
    out = np.full(len(hashes) + len(texts), END)
    out[np.arange(len(hashes)) + text] = hashes
    return out, counts


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word before, hash of both) of every token."""
    before = np.append(END, words[:-1])
    return before, (_mixed(before) + words * np.uint64(_PAIR)) & MASK


def second_word(before: np.ndarray, both: np.ndarray) -> np.ndarray:
    return (both - _mixed(before)) * _UNPAIR & MASK


def block_table(docs: DataFrame, learn: Column) -> DataFrame:
    """Distinct texts in packed rows, stored: ``block``, ``size``, ``texts``, and per text its key and how many rows of it teach."""
    text = whole(docs["text"])
    counted = docs.select(text.alias("text"), learn.cast("long").alias("learn")).groupBy("text").agg(F.sum("learn").alias("learn"))
    keyed = counted.select("text", F.xxhash64("text").alias("key"), F.hash("text").alias("more"), "learn")

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def row():
            nonlocal held, size, number
            texts, key, more, learn = zip(*held)
            raw = b"\n".join(texts)
            out = [part << 32 | number, len(raw), np.array([len(t) for t in texts]).astype("<i8").tobytes(),
                   pa.compress(raw, "zstd", asbytes=True), list(key), list(more), list(learn)]
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, BLOCKS_ARROW)], schema=BLOCKS_ARROW)

        for batch in batches:
            columns = [batch.column(0).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (1, 2, 3))]
            for one in zip(*columns):
                held.append((one[0].lower(), *one[1:]))
                size += len(one[0]) + 64
                if size >= BLOCK:
                    yield row()
        if held:
            yield row()

    return store(keyed.mapInArrow(run, BLOCKS), "lm-blocks")


BLOCKS = "block long, size long, lengths binary, texts binary, key array<long>, more array<int>, learn array<long>"
BLOCKS_ARROW = pa.schema([
    ("block", pa.int64()), ("size", pa.int64()), ("lengths", pa.binary()), ("texts", pa.binary()), ("key", pa.list_(pa.int64())),
    ("more", pa.list_(pa.int32())), ("learn", pa.list_(pa.int64()))])


def _texts(lengths: bytes, size: int, packed: bytes) -> list[bytes]:
    raw, at, out = pa.decompress(packed, size, "zstd", asbytes=True) if size else b"", 0, []
    for n in np.frombuffer(lengths, "<i8").tolist():
        out.append(raw[at : at + n])
        at += n + 1
    return out


def _rows(kind: int, block: int, parts: Iterable[tuple[int, bytes]]) -> list[tuple]:
    return [(kind, shard, block, content) for shard, content in parts]


PARTS = "kind int, shard long, block long, content binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _counts(blocks: DataFrame, shards: int) -> DataFrame:
    """Per block and shard the packed counts of words, and of pairs with the word before, in the texts that teach."""

    def run(batches):
        for batch in batches:
            for block, size, lengths, packed, learn in zip(*(batch.column(i).to_pylist() for i in range(5))):
                some = [(t, n) for t, n in zip(_texts(lengths, size, packed), learn) if n]
                if not some:
                    continue
                words, sizes = tokens([t for t, _ in some])
                weight = np.repeat(np.array([n for _, n in some], np.uint64), sizes)
                before, both = pairs(words)
                rows = _rows(WORD, block, by_shard(shards, *summed(words, weight)))
                order = np.argsort(both, kind="stable")
                both, before, weight = both[order], before[order], weight[order]
                at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
                rows += _rows(PAIR, block, by_shard(shards, both[at], before[at], np.add.reduceat(weight, at)))
                yield from _table(rows, PARTS).to_batches()

    return blocks.select("block", "size", "lengths", "texts", "learn").mapInArrow(run, PARTS)


COUNTED = "kind int, shard long, role int, content binary, entries long, c1 long, c2 long, c3 long, c4 long, total long"
MODEL, BEFORE, AFTER = 0, 1, 2  # roles of counted rows: a shard's own sums, followers of each word, forerunners of each word


def _levels(counts: np.ndarray) -> tuple[int, ...]:
    """Entries, how many of them count 1, 2, 3 and 4, and their sum."""
    return (len(counts), *((counts == k).sum().item() for k in (1, 2, 3, 4)), int(counts.sum()))


def _joined(contents: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(unpack(c) for c in contents))]


def _add_up(shards: int):
    def run(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        arrays = _joined(table.column("content").to_pylist())
        if kind == WORD:
            keys, counts = summed(*arrays)
            return _table([(WORD, shard, MODEL, pack(keys, counts), *_levels(counts))], COUNTED)
        both, before, weight = arrays
        order = np.argsort(both, kind="stable")
        both, before, weight = both[order], before[order], weight[order]
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        both, before, counts = both[at], before[at], np.add.reduceat(weight, at)
        rows = [(PAIR, shard, MODEL, pack(both, counts), *_levels(counts))]
        once, twice, more = ((counts == 1), (counts == 2), (counts > 2))
        followers = summed(before, *(x.astype(np.uint64) for x in (once, twice, more)))
        forerunners = summed(second_word(before, both), np.ones(len(both), np.uint64))
        for role, parts in ((BEFORE, followers), (AFTER, forerunners)):
            rows += [(WORD, s, role, content, 0, 0, 0, 0, 0, 0) for s, content in by_shard(shards, *parts)]
        return _table(rows, COUNTED)

    return run


MERGED = "kind int, shard long, content binary, entries long, c1 long, c2 long, c3 long, c4 long, total long, tokens long"


def _merge_words(table: pa.Table) -> pa.Table:
    """A shard's words with their count, forerunners, and followers seen once, twice and more often."""
    shard, roles, contents = table.column("shard")[0].as_py(), table.column("role").to_pylist(), table.column("content").to_pylist()
    keys, count = _joined([c for c, r in zip(contents, roles) if r == MODEL])
    columns = [count] + [np.zeros(len(keys), np.uint64) for _ in range(4)]
    for role, where in ((AFTER, [1]), (BEFORE, [2, 3, 4])):
        parts = [c for c, r in zip(contents, roles) if r == role]
        if parts:
            found, *values = summed(*_joined(parts))
            at = np.searchsorted(keys, found)
            for k, v in zip(where, values):
                columns[k][at] = v
    return _table([(WORD, shard, pack(keys, *columns), *_levels(columns[1]), int(count.sum()))], MERGED)


@dataclass(frozen=True)
class Model:
    """Stored shards (``kind``, ``shard``, ``content``) and the few numbers that all of them share."""

    table: DataFrame
    shards: int
    n_tokens: int
    n_words: int
    n_pairs: int
    word_discounts: tuple[float, ...]  # of words after one, two, and three or more different words
    pair_discounts: tuple[float, ...]
    lowest: float  # what the discounts of the lowest level leave for the uniform distribution


def discounts(c1: int, c2: int, c3: int, c4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many entries count 1 to 4; of an even 0.75 where one is missing."""
    if not (c1 and c2 and c3 and c4):
        return (0.75, 0.75, 0.75)
    y = c1 / (c1 + 2 * c2)
    raw = (1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3)
    return tuple(min(max(d, 0.0), k) for k, d in enumerate(raw, 1))


def fit(blocks: DataFrame) -> Model:
    """The model of all texts of ``block_table`` that teach."""
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD))
    path = fresh_path(blocks.sparkSession, "lm-shards")
    with scratch(blocks.sparkSession):
        counted = store(_counts(blocks, shards).groupBy("kind", "shard").applyInArrow(_add_up(shards), COUNTED), "lm-counted")
        merged = counted.where(F.col("kind") == WORD).groupBy("shard").applyInArrow(_merge_words, MERGED)
        own = counted.where(F.col("kind") == PAIR).select(
            *[F.lit(0).cast("long").alias(c.split()[0]) if c.startswith("tokens") else F.col(c.split()[0]) for c in MERGED.split(", ")])
        table = write(merged.unionByName(own), path)
    sums = {r["kind"]: r for r in table.groupBy("kind").agg(
        *[F.sum(c).alias(c) for c in ("entries", "c1", "c2", "c3", "c4", "total", "tokens")]).collect()}
    if not sums:
        return Model(table, shards, 0, 0, 0, (0.75,) * 3, (0.75,) * 3, 0.0)
    word, pair = sums[WORD], sums[PAIR]
    lower, upper = (discounts(x["c1"], x["c2"], x["c3"], x["c4"]) for x in (word, pair))
    left = sum(d * n for d, n in zip(lower, (word["c1"], word["c2"], word["entries"] - word["c1"] - word["c2"])))
    return Model(table.select("kind", "shard", "content"), shards, word["tokens"], word["entries"], pair["entries"], lower, upper, left)


def _requests(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, size, lengths, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words, _ = tokens(_texts(lengths, size, packed))
                rows = _rows(WORD, block, by_shard(shards, np.unique(words)))
                rows += _rows(PAIR, block, by_shard(shards, np.unique(pairs(words)[1])))
                yield from _table(rows, PARTS).to_batches()

    return blocks.select("block", "size", "lengths", "texts").mapInArrow(run, PARTS)


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """The counts that one shard has for every block."""
    if not asked.num_rows:
        return _table([], PARTS)
    kind = asked.column("kind")[0].as_py()
    shard = MappedShard(model.column("content")[0].as_py() if model.num_rows else None, COLUMNS[kind])
    rows = []
    for number, block, content in zip(*(asked.column(c).to_pylist() for c in ("shard", "block", "content"))):
        found = shard.find(unpack(content)[0])
        rows.append((kind, number, block, pack(np.zeros(len(found[0]), np.uint64), *found)))
    return _table(rows, PARTS)


def _discounted(count: np.ndarray, by: tuple[float, ...]) -> np.ndarray:
    return np.maximum(count - np.array((0.0, *by))[np.minimum(count, 3).astype(np.int64)], 0)


def log_probabilities(model: Model, count, forerunners, followers, before_count, both_count) -> np.ndarray:
    """log10 of the probability of tokens; ``followers``: of the word before, seen once, twice, more often."""
    uniform = 1 / (model.n_words + 1)
    low = (_discounted(forerunners, model.word_discounts) + model.lowest * uniform) / model.n_pairs if model.n_pairs else np.full(len(count), uniform)
    left = sum(d * n for d, n in zip(model.pair_discounts, followers))
    high = (_discounted(both_count, model.pair_discounts) + left * low) / np.maximum(before_count, 1)
    return np.log10(np.where(before_count > 0, high, low))


SCORES = "key long, more int, n_tokens long, n_known long, base_score double, score double"


def _evaluate(model: Model):
    numbers = Model(None, *[getattr(model, f) for f in list(Model.__dataclass_fields__)[1:]])

    def run(answers: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for size, lengths, packed, key, more in zip(*(blocks.column(c).to_pylist() for c in ("size", "lengths", "texts", "key", "more"))):
            words, sizes = tokens(_texts(lengths, size, packed))
            (_, word), (_, both) = (np.unique(x, return_inverse=True) for x in (words, pairs(words)[1]))
            found = {}
            for kind in (WORD, PAIR):
                mine = sorted((s, c) for k, s, c in zip(*(answers.column(x).to_pylist() for x in ("kind", "shard", "content"))) if k == kind)
                found[kind] = [x.astype(float) for x in _joined([c for _, c in mine])[1:]]
            before = np.append(word[sizes[0] - 1], word[:-1])  # an end stands before the first text, too
            count, forerunners, *followers = found[WORD]
            value = log_probabilities(
                numbers, count[word], forerunners[word], [f[before] for f in followers], count[before], found[PAIR][0][both])
            base = np.log10((count[word] + 0.5) / (numbers.n_tokens + 0.5 * (numbers.n_words + 1)))
            at = np.cumsum(sizes) - sizes
            out += zip(key, more, sizes.tolist(), np.add.reduceat((count[word] > 0).astype(np.int64), at).tolist(),
                       np.add.reduceat(base, at).tolist(), np.add.reduceat(value, at).tolist())
        return _table(out, SCORES)

    return run


def scores(blocks: DataFrame, model: Model) -> DataFrame:
    """Per distinct text: its key, tokens, known tokens, and log10 probabilities by words alone and by the model."""
    asked = _requests(blocks, model.shards)
    answers = asked.groupBy("kind", "shard").cogroup(model.table.groupBy("kind", "shard")).applyInArrow(_answer, PARTS)
    return answers.groupBy("block").cogroup(blocks.drop("learn").groupBy("block")).applyInArrow(_evaluate(model), SCORES)


def is_held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def scored(docs: DataFrame, carry: list[str], learn: Column) -> DataFrame:
    """Every row's ``row``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``; the rows of ``learn`` teach."""
    spark = docs.sparkSession
    path = fresh_path(spark, "lm-scores")
    with scratch(spark):
        blocks = block_table(docs, learn)
        model = fit(blocks)
        by_text = write(scores(blocks, model), path)
    text = whole(docs["text"])
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), F.xxhash64(text).alias("key"), F.hash(text).alias("more"))
    return rows.join(by_text, ["key", "more"]).select(
        "row", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
