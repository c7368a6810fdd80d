"""Documents to token ids in five stages, each an operator of ``fluxloom.llm``.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next stage's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm import mixing, quality, secrets, sentences, simhash
from fluxloom.llm.queries import PIECE_MODEL, vocabulary
from fluxloom.storage import fresh_path, remove, scratch, write


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the cut-offs of their language and source; the others go.

    Null, empty and white texts fail the base rule. A null language or source is a group of its own. Rows that repeat
    are judged each, and alike.
    """
    return quality.judge(docs, docs.columns).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of three-word shingles that 3 bits or fewer link.

    The smallest id stays, ids before nulls, equal ids by a hash of their columns; of rows that repeat one stays. Null,
    empty and white texts have one fingerprint, so one of them stays.
    """
    return simhash.one_of_each(docs, docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret masked in its text, whose length is counted anew. Null texts stay null, with a null length."""
    return secrets.masked(docs, secrets.fit(docs)).withColumn("n_chars", F.char_length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, which may be never.

    Documents without words have no size and are not taken. A null source is a source, the last one.
    """
    return mixing.materialised(docs, docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number, checksum, parity and round trip. A null text is empty."""
    return sentences.encoded(docs, ["doc_id", "source"], vocabulary(PIECE_MODEL), ids="ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: None: fingerprints, the character network, the knapsack and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage read goes once its own result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage stored on its way goes, too
            docs = write(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
