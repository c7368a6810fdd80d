"""Quality rules with thresholds learnt per language and source.

Every document gets a handful of measures. Each measure of each (language, source) group is summed up in a
quantile sketch: counts of logarithmic buckets (value bounds grow by 2 %, so a quantile is off by 2 % at most).
Such a sketch merges by adding counts, in any order and at any number of partitions, so Spark builds it as a plain
partial aggregation and one hot group costs no more than any other. A group's sketch is merged with that of its
language, scaled down to ``PRIOR`` documents; a group of a few documents thereby follows its language and a large
one itself, with no switch between the two.

A measure is out of range beyond ``upper quartile + SPREADS * (upper - lower quartile) + slack``: the cut-off adapts
to each group, and ``slack`` is the resolution below which differences of that measure mean nothing. The cut-offs
are joined to the documents, which fail when any measure is out of range.

Defined cases: a null text counts as empty; null languages and sources are groups of their own; repeated rows are
judged alike and all stay; an empty table gives an empty result; input columns travel inside one struct column,
so no name of theirs can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from fluxloom.llm.text import n_matching, whole, without_spaces, words_of
from fluxloom.storage import store

SYMBOLS = r"[#*$%&|<>]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: share -> slack
SLACK = {"symbol_share": 0.05, "punctuation_share": 0.10, "capital_share": 0.15, "same_line_share": 0.30,
         "repeat_share": 0.40}
PRIOR = 200
SPREADS = 3
GROWTH = 1.02
SMALLEST = 1e-4
GROUP = ["g_lang", "g_source"]


@dataclass(frozen=True)
class Rules:
    """Parameters: pseudo-documents lent by the language, width of the fence, slack per measure."""

    prior: int = PRIOR
    spreads: float = SPREADS
    slack: tuple[tuple[str, float], ...] = tuple(SLACK.items())


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are sorted by (hash, place), so equal ones stand side by side; the places of those that have an equal
    neighbour are sorted again and their overlapping spans summed up.
    """
    windows = F.slice(
        F.transform(words, lambda w, i: F.struct(
            F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))),
        F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)),
    )
    return F.sort_array(windows)


def _span_total(ordered: Column) -> Column:
    twins = F.filter(ordered, lambda x, k: F.coalesce(x["h"] == F.get(ordered, k - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get(ordered, k + 1)["h"], F.lit(False)))
    places = F.sort_array(F.transform(twins, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last"))
    return F.aggregate(
        places, start,
        lambda seen, p: F.struct((seen["total"] + F.least(F.lit(3), p - seen["last"])).alias("total"), p.alias("last")),
        lambda seen: seen["total"],
    )


def measure(docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: ``row`` (struct of the carried columns), its group, counts and shares."""
    base = docs.select(
        F.struct(*[docs[c] for c in carry]).alias("row"), docs[lang].cast("string").alias("g_lang"),
        docs[source].cast("string").alias("g_source"), whole(docs[text]).alias("t"),
    )
    split = base.withColumns({"words": words_of(F.col("t")), "solid": without_spaces(F.col("t"))})
    ordered = split.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length("solid").cast("long"),
        "n_symbols": n_matching(F.col("solid"), SYMBOLS),
        "n_marks": n_matching(F.col("solid"), PUNCTUATION),
        "n_capitals": n_matching(F.col("solid"), "[A-Z]"),
        "lines": F.filter(F.split(F.col("t"), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""),
        "ordered": _repeated_words(F.col("words")),
    })
    counted = ordered.select(
        "row", *GROUP, "n_words", "word_chars", "n_symbols", "n_marks", "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _span_total(F.col("ordered")).cast("long").alias("n_repeat_words"),
    )
    share = lambda top, bottom: F.col(top) / F.greatest(F.col(bottom), F.lit(1))
    return counted.withColumns({
        "symbol_share": share("n_symbols", "word_chars"),
        "punctuation_share": share("n_marks", "word_chars"),
        "capital_share": share("n_capitals", "word_chars"),
        "same_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
    })


def bucket_of(value: Column) -> Column:
    """Number of the value's bucket: 0 up to ``SMALLEST``, then bounds that grow by ``GROWTH``."""
    return F.when(value <= SMALLEST, 0).otherwise(
        F.ceil(F.log(value / SMALLEST) / F.log(F.lit(GROWTH))).cast("int"))


def bound_of(bucket: Column) -> Column:
    """Upper bound of a bucket."""
    return F.when(bucket <= 0, 0.0).otherwise(SMALLEST * F.pow(F.lit(GROWTH), bucket.cast("double")))


def sketches(measured: DataFrame, measures: list[str]) -> DataFrame:
    """Per group and measure, the counts of its buckets."""
    long = measured.select(*GROUP, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in measures
    ])).alias("x"))
    return long.groupBy(*GROUP, "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, prior: int) -> DataFrame:
    """Each group's sketch plus its language's, scaled to ``prior`` documents; weights are whole numbers."""
    exact = T.DecimalType(38, 0)
    groups = sketch.groupBy(*GROUP, "measure").agg(F.sum("n").cast(exact).alias("group_n"))
    by_lang = sketch.groupBy("g_lang", "measure", "bucket").agg(F.sum("n").cast(exact).alias("lent"))
    lang = sketch.groupBy("g_lang", "measure").agg(F.sum("n").cast(exact).alias("lang_n"))
    totals = groups.alias("a").join(
        lang.alias("b"), F.col("a.g_lang").eqNullSafe(F.col("b.g_lang")) & (F.col("a.measure") == F.col("b.measure"))
    ).select("a.g_lang", "a.g_source", "a.measure", "lang_n")
    own = sketch.alias("s").join(
        totals.alias("t"), F.col("s.g_lang").eqNullSafe(F.col("t.g_lang"))
        & F.col("s.g_source").eqNullSafe(F.col("t.g_source")) & (F.col("s.measure") == F.col("t.measure"))
    ).select("s.g_lang", "s.g_source", "s.measure", "s.bucket",
             (F.col("s.n").cast("decimal(18,0)") * F.col("lang_n").cast("decimal(18,0)")).cast(exact).alias("w"))
    lent = totals.alias("t").join(
        by_lang.alias("l"), F.col("t.g_lang").eqNullSafe(F.col("l.g_lang")) & (F.col("t.measure") == F.col("l.measure"))
    ).select("t.g_lang", "t.g_source", "t.measure", "l.bucket", (F.col("lent") * F.lit(prior)).cast(exact).alias("w"))
    return own.unionByName(lent).groupBy(*GROUP, "measure", "bucket").agg(F.sum("w").cast(exact).alias("w"))


def thresholds(weights: DataFrame, rules: Rules) -> DataFrame:
    """One row per group with the highest value that each measure may have."""
    by = Window.partitionBy(*GROUP, "measure")
    running = weights.withColumns({
        "upto": F.sum("w").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("w").over(by),
    })
    quarter = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    cuts = running.groupBy(*GROUP, "measure").agg(quarter(1).alias("lower"), quarter(3).alias("upper"))
    top = bound_of(F.col("upper"))
    limit = top + rules.spreads * (top - bound_of(F.col("lower")))
    slack = F.coalesce(*[F.when(F.col("measure") == m, F.lit(s)) for m, s in rules.slack])
    return cuts.withColumn("limit", limit + slack).groupBy(*GROUP).agg(*[
        F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(f"max_{m}") for m, _ in rules.slack
    ])


def judge(docs: DataFrame, carry: list[str], rules: Rules = Rules()) -> DataFrame:
    """Measures, cut-offs and verdict of every document; ``kept`` is false after a failed base rule.

    The measures are stored once (with the carried columns), so texts are read and split once only.
    """
    measures = [m for m, _ in rules.slack]
    measured = store(measure(docs, carry), "quality-measures")
    limits = store(thresholds(merged(sketches(measured, measures), rules.prior), rules).coalesce(1), "quality-limits")
    held = F.lit(True)
    for m in measures:
        held = held & (F.col(m) <= F.col(f"max_{m}"))
    joined = measured.alias("d").join(
        limits.alias("l"), F.col("d.g_lang").eqNullSafe(F.col("l.g_lang"))
        & F.col("d.g_source").eqNullSafe(F.col("l.g_source")), "left",
    ).drop(F.col("l.g_lang"), F.col("l.g_source"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(held, F.lit(False)))
