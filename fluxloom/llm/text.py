"""Column expressions over words. A word is a run of characters that are no ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text; empty for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words; empty for null and for texts of white space."""
    trimmed = F.btrim(whole(text), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def without_spaces(text: Column) -> Column:
    """The text with its ASCII white space cut out; each step is a plain byte search."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def n_matching(text: Column, characters: str) -> Column:
    """How many code points fall into a regex class of single ASCII characters."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"{characters}+", ""))).cast("long")
