"""The operators as queries over whole driver tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm import kneser, mixing, pages, periods, quality, secrets, sentences, simhash, tokens, toolcalls, topk, toxicity, whitening
from fluxloom.storage import store

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mix = mixing.mixed(table(spark, sf_dir, "documents"), ["doc_id"])
    return mix.select(
        "row.doc_id", F.col("words").alias("size"), F.col("source_words").alias("source_size"), "target",
        (F.col("words") * F.col("copies")).alias("taken"))


@query
def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    rows = simhash.classified(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select(
        F.col("id").alias("doc_id"), simhash.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


@query
def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's tokens, read back from the shards."""
    shards = store(tokens.shards_of(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY)), "token-shards")
    return tokens.per_document(shards)


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, their checksum, parity with the original library, and the round trip."""
    return sentences.encoded(table(spark, sf_dir, "documents"), ["doc_id"], vocabulary(PIECE_MODEL))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans with those that the network adds."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, ["doc_id"], secrets.fit(docs)).select("row.doc_id", *secrets.RESULT)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, with the examples that it rests on."""
    rows, index = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return toxicity.scored(rows, index).select(
        F.col("id").alias("doc_id"), toxicity.is_held_out(F.col("id")).alias("held_out"), "score", "predicted", "evidence")


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = table(spark, sf_dir, "pages")
    text = pages.extracted(rows, ["page_id", "url"], pages.fit(rows))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), ["vec_id"]).select(
        "row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, every tenth of which is given some."""
    found = periods.detected(table(spark, sf_dir, "documents"), ["doc_id"], periods.planted)
    return found.select(
        "row.doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by a word model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = kneser.is_held_out(docs["doc_id"])
    return kneser.scored(docs, ["doc_id"], ~held_out).select(
        "row.doc_id", kneser.is_held_out(F.col("row.doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


TOOLS: toolcalls.Schemas = {
    "search": (
        toolcalls.Argument("query", "string", required=True), toolcalls.Argument("limit", "integer", low=1, high=50),
        toolcalls.Argument("after", "string")),
    "measure": (
        toolcalls.Argument("length", "integer", required=True, low=0), toolcalls.Argument("unit", "string", options=("chars", "words")),
        toolcalls.Argument("after", "string")),
    "translate": (
        toolcalls.Argument("text", "string", required=True), toolcalls.Argument("target", "string", required=True),
        toolcalls.Argument("after", "string")),
}


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats as an agent's: every user turn becomes a call, every reply the result of the turn before.

    Calls and results hold the whole texts; other turns stay prose, and a null text leaves out what it would fill. A call
    refers to that of turn ``turn div 2``; some arguments break their schema.
    """
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    length = F.length("text")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    after = F.when(F.col("turn") > 0, F.concat(F.lit("${"), name(F.floor(F.col("turn") / 2)), F.lit("}")))
    search = F.to_json(F.struct(F.col("text").alias("query"), (length % 60).alias("limit"), after.alias("after")))
    measure = F.to_json(F.struct(
        after.alias("after"), F.when(length % 2 == 0, "words").when(length % 3 == 0, "bytes").otherwise("chars").alias("unit"),
        F.when(length % 5 == 0, length.cast("string")).alias("size"), F.when(length % 5 != 0, length).alias("length")))
    translate = F.to_json(F.struct(F.lit("en").alias("target"), "text", F.lit(1.50).alias("rate")))
    kind = F.col("turn") % 4
    tool = F.when(kind == 0, "search").when(kind == 1, "measure").when(kind == 2, "translate").otherwise("search")
    arguments = F.when(tool == "search", search).when(tool == "measure", measure).otherwise(translate)
    call = F.to_json(F.struct(F.array(F.struct(name(F.col("turn")).alias("id"), tool.alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    user = F.col("role") == "user"
    return chats.select(
        "conv_id", "turn", F.when(user, "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"))


@query
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with its result, level, errors and canonical JSON, and every other turn."""
    return toolcalls.formatted(tool_messages(spark, sf_dir), TOOLS)
