from __future__ import annotations

import random

import pytest

WORDS = "the of and to in river stone house light garden winter music paper cloud market silver forest window bread".split()

#: Names that operators use inside; input columns of these names must do no harm.
CLASHING = ("row", "words", "h", "print", "root", "kept", "n_words", "measure", "bucket", "score", "spans", "copies")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(f"{rng.choice(WORDS)}{rng.choice(['', '', 'ing', 'er', 'ly'])}{rng.choice(['', '', '', ',', '.'])}" for _ in range(n))


def hard_documents() -> list[tuple]:
    """Nulls, empty and white texts, ties, repeated rows, copies, one very long text, one hot source."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(1, 160)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), 0) for i in range(60)]
    base = rows[3][1]
    rows += [(100 + i, base, "en", "a", 0) for i in range(8)]
    rows += [(120, base + " tail", "en", "a", 0), (121, None, "en", "a", None), (122, "", None, None, 0), (123, " \n\t ", "de", "b", 3)]
    rows += [rows[5], rows[5], (None, rows[6][1], "en", "b", 1), (None, None, None, None, None)]
    rows += [(130, prose(rng, 6000), "en", "a", 0), (131, "line one here\nline one here\nother ###", "en", "a", 0)]
    rows += [(132, "É é ß 日本語 𝄞 x", "de", "b", 0), (133, "one two", "de", "b", 0), (134, "ONE Two", "de", "b", 0)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(hard_documents(), schema)
    from pyspark.sql import functions as F

    return frame.withColumns({name: F.lit(name) for name in CLASHING}).cache()


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.where("false")
