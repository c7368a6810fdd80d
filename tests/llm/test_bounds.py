from __future__ import annotations

import random

from pyspark.sql import functions as F

from fluxloom.llm import kneser, toxicity


def word(k):
    return "".join(chr(97 + k // 26**i % 26) for i in range(3))  # three letters: no beginnings


def test_every_strong_term_is_in_the_vocabulary(spark):
    """1,300 words tied to toxic examples: all are terms."""
    words = [word(k) for k in range(1300)]
    rows = [(i, 1, " ".join(random.Random(i).sample(words, len(words)))) for i in range(40)]
    rows += [(100 + i, 0, f"{word(9000 + i)} {word(9500 + i)} {word(10_000 + i)}") for i in range(400)]
    found = toxicity.vocabulary_of(spark.createDataFrame(rows, "example long, toxic int, text string"))
    assert set(words) <= set(found)


def test_beginnings_that_stand_for_one_longer_term():
    found = [("abcd*", 10), ("abcdef", 9), ("abcde*", 8), ("wxyz*", 10), ("wxyzu", 5), ("wxyzv", 5)]
    assert toxicity.most_specific(found) == ["abcdef", "wxyz*", "wxyzu", "wxyzv"]


def test_shards_hold_the_counts_of_8_mb_of_text(spark):
    docs = spark.range(24).select(
        F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word"), F.col("id"), F.lit(" ")), 150_000).alias("text"))
    blocks = kneser.block_table(docs, F.lit(True))
    size = blocks.agg(F.sum("size")).first()[0]
    assert kneser.fit(blocks).shards >= size // (1 << 23)
