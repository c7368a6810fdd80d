"""Tool calls of chats: linked to their results, ordered, validated and written as canonical JSON. Columns only, no Python.

Messages are ``(conv_id, turn, role, text)``. A message of role ``assistant`` whose text is ``{"tool_calls": [{"id", "name",
"arguments"}, ...]}`` makes calls; one of role ``tool`` whose text is ``{"tool_call_id", "content"}`` is a result. Any other
message is prose: one row of status ``prose`` with its turn as ``call_turn`` and its role and whole text as canonical JSON.

* **Link**: the turns of a (conversation, identifier) stand in blocks; each call's turn gets the next result by two short
  windows, and calls are joined with that one row, never with all results of their identifier. ``status`` is ``linked``, ``no_result``,
  ``no_call`` or ``early_result`` (all results precede the call). Of several results the first after the call counts; of
  several calls with one identifier all are kept, each with ``same_id`` calls beside it.
* **Order**: arguments refer to another call by ``${identifier}``. ``level`` is 0 for calls that wait for none, else one
  more than the highest level they wait for; (level, turn, place) is a topological order. Levels are found in rounds,
  each an anti-join of the waiting edges with the calls settled before; there are as many rounds as levels, each over
  the edges that are left. Calls on a cycle, or behind one, have no level.
* **Validation** is row by row against the schemas, a parameter: missing and unknown arguments, wrong types, values
  outside bounds or options; arguments that are no JSON object are ``not_an_object``.
* **Canonical JSON**: keys in order, no spaces, numbers in shortest form.

Contents are whole; the windows carry turns only, and a content joins its call at the end. A value beyond Spark's limit for
parsed JSON is ``not_an_object``.

Defined cases: null conversations, turns and roles are values like any other (null texts are prose without a text); calls without an
identifier link to nothing and get level 0 or that of what they wait for; repeated messages repeat their rows; very
long texts and conversations need nothing held together; an empty table gives an empty result. Only the four named
columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.storage import store

CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>>"
RESULT = "struct<tool_call_id: string, content: string>"
REFERENCE = r"\$\{([^{}\"\\]+)\}"
NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL")
BLOCK = 1024  # turns


@dataclass(frozen=True)
class Argument:
    """One argument of a tool: its JSON kind, whether it must be there, bounds of a number, options of a text."""

    name: str
    kind: str  # string, integer, number, boolean, array, object
    required: bool = False
    low: float | None = None
    high: float | None = None
    options: tuple[str, ...] = ()


Schemas = dict[str, tuple[Argument, ...]]


def calls_and_results(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (with their place in the message) and results."""
    rows = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    calls = rows.where("role = 'assistant' and text like '{%'").select(
        "conv_id", "turn", F.posexplode(F.from_json("text", CALLS)["tool_calls"]).alias("place", "c")
    ).select("conv_id", F.col("turn").alias("call_turn"), "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"),
             F.col("c.arguments").alias("arguments"))
    results = rows.where("role = 'tool' and text like '{%'").withColumn("r", F.from_json("text", RESULT)).where(
        "r.tool_call_id is not null").select(
        "conv_id", F.col("turn").alias("result_turn"), F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    return calls, results


def prose(messages: DataFrame) -> DataFrame:
    """Messages that make no call and are no result."""
    rows = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    makes = (F.col("role") == "assistant") & F.col("text").startswith("{") & (F.size(F.from_json("text", CALLS)["tool_calls"]) > 0)
    ends = (F.col("role") == "tool") & F.col("text").startswith("{") & F.from_json("text", RESULT)["tool_call_id"].isNotNull()
    return rows.where(~F.coalesce(makes, F.lit(False)) & ~F.coalesce(ends, F.lit(False)))


def following(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(n_conv, n_id, n_turn, next_turn) of every (conversation, identifier, turn) of a call that a result follows, once.

    Calls and results of one turn are one point, so a hot identifier has as many points as turns. The next result is
    looked for in the point's block of turns, then among the first results of later blocks.
    """
    key = ["n_conv", "n_id", "n_turn"]
    kind = calls.schema["call_turn"].dataType
    block = F.floor(F.col("n_turn") / BLOCK) if isinstance(kind, T.NumericType) else F.lit(0).cast("long")
    ends = results.where("call_id is not null and result_turn is not null").select(
        F.col("conv_id").alias("n_conv"), F.col("call_id").alias("n_id"), F.col("result_turn").alias("n_turn"),
        F.col("result_turn").alias("here")).distinct()
    starts = calls.where("call_id is not null and call_turn is not null").select(
        F.col("conv_id").alias("n_conv"), F.col("call_id").alias("n_id"), F.col("call_turn").alias("n_turn")).distinct()
    points = starts.withColumns({"asks": F.lit(True), "here": F.lit(None).cast(ends.schema["here"].dataType)}).unionByName(
        ends.withColumn("asks", F.lit(False))).groupBy(*key).agg(
        F.max("asks").alias("asks"), F.max("here").alias("here")).withColumn("block", block)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    near = F.last("here", ignorenulls=True).over(before("n_conv", "n_id", "block").orderBy(F.col("n_turn").desc()))
    points = store(points.withColumn("near", near), "calls-points")
    blocks = points.groupBy(F.col("n_conv").alias("b_conv"), F.col("n_id").alias("b_id"), F.col("block").alias("b_block")).agg(F.min("here").alias("first"))
    far = F.last("first", ignorenulls=True).over(before("b_conv", "b_id").orderBy(F.col("b_block").desc()))
    blocks = blocks.withColumn("far", far).where("far is not null").drop("first")
    asked = points.where("asks").join(
        blocks, F.col("n_conv").eqNullSafe(F.col("b_conv")) & (F.col("n_id") == F.col("b_id")) & (F.col("block") == F.col("b_block")), "left")
    return asked.select(*key, F.coalesce("near", "far").alias("next_turn")).where("next_turn is not null")


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their result, and results without a call; one row per row of either."""
    both = calls.select("conv_id", "call_id", F.lit(1).alias("call"), F.lit(0).alias("end")).unionByName(
        results.select("conv_id", "call_id", F.lit(0).alias("call"), F.col("result_turn").isNotNull().cast("int").alias("end")))
    by_id = store(both.groupBy(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id")).agg(
        F.sum("call").alias("same_id"), F.sum("end").alias("n_results")), "calls-ids")
    numbered = calls.join(by_id, F.col("conv_id").eqNullSafe(F.col("k_conv")) & F.col("call_id").eqNullSafe(F.col("k_id")))
    next_ = store(following(calls, results), "calls-results")
    with_call = numbered.join(
        next_, F.col("conv_id").eqNullSafe(F.col("n_conv")) & (F.col("call_id") == F.col("n_id")) & (F.col("call_turn") == F.col("n_turn")), "left"
    ).withColumn("status", F.when(F.col("next_turn").isNotNull(), "linked").when(
        F.col("call_id").isNotNull() & (F.col("n_results") > 0), "early_result").otherwise("no_result"))
    contents = results.where("call_id is not null and result_turn is not null").groupBy(
        F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), "result_turn").agg(F.min(F.struct("content")).alias("result"))
    with_call = with_call.join(
        contents, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_id")) & (F.col("next_turn") == F.col("result_turn")), "left")
    alone = results.join(
        by_id.where("same_id > 0"), F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("call_id") == F.col("k_id")), "left_anti")
    return with_call.select(
        "conv_id", "call_id", "name", "arguments", "call_turn", "place", "same_id", "status",
        "result_turn", F.col("result.content").alias("content"),
    ).unionByName(alone.select(
        "conv_id", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit(None).cast(calls.schema["call_turn"].dataType).alias("call_turn"), F.lit(None).cast("int").alias("place"),
        F.lit(0).cast("long").alias("same_id"), F.lit("no_call").alias("status"), "result_turn", "content"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every identifier that a call has and that waits for no cycle."""
    nodes = calls.where("call_id is not null").select("conv_id", "call_id").distinct()
    wanted = calls.where("call_id is not null").select(
        "conv_id", "call_id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("needs")).distinct()
    edges = wanted.alias("e").join(
        nodes.alias("n"), F.col("e.conv_id").eqNullSafe(F.col("n.conv_id")) & (F.col("e.needs") == F.col("n.call_id")), "left_semi")
    nodes, edges = store(nodes, "calls"), store(edges, "calls-waiting")
    level = 0
    ready = nodes.alias("n").join(edges.alias("e"), _same("n.call_id", "e.call_id"), "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"))
    ready = store(ready, "calls-level")
    settled = ready
    while not edges.isEmpty() and not ready.isEmpty():
        level += 1
        left = edges.alias("e").join(ready.alias("n"), _same("e.needs", "n.call_id", "e", "n"), "left_anti")
        left = store(left.select("conv_id", "call_id", "needs"), "calls-waiting")
        freed = edges.select("conv_id", "call_id").distinct().alias("n").join(
            left.alias("e"), _same("n.call_id", "e.call_id"), "left_anti")
        ready = store(freed.select("conv_id", "call_id", F.lit(level).alias("level")), "calls-level")
        settled, edges = settled.unionByName(ready), left
    return settled


def _same(one: str, other: str, left: str = "n", right: str = "e") -> Column:
    return F.col(f"{left}.conv_id").eqNullSafe(F.col(f"{right}.conv_id")) & (F.col(one) == F.col(other))


def _kind_fits(argument: Argument, kind: Column) -> Column:
    if argument.kind == "string":
        return kind == "STRING"
    if argument.kind == "boolean":
        return kind == "BOOLEAN"
    if argument.kind == "integer":
        return kind == "BIGINT"
    if argument.kind == "number":
        return F.split(kind, r"\(")[0].isin(*NUMBERS)
    return kind.startswith("ARRAY" if argument.kind == "array" else "OBJECT")


def _errors_of(arguments: tuple[Argument, ...], held: Column, keys: Column) -> Column:
    """Errors of one tool's arguments, in the order of the schema, then unknown keys by name."""
    found = []
    for a in arguments:
        value = F.try_variant_get(held, f"$.{a.name}", "variant")
        there = F.array_contains(keys, a.name)
        kind = F.schema_of_variant(value)
        problem = F.when(~there, F.lit(f"missing:{a.name}") if a.required else F.lit(None)).when(
            ~F.coalesce(_kind_fits(a, kind), F.lit(False)), F.lit(f"type:{a.name}"))
        if a.low is not None or a.high is not None:
            number = F.try_variant_get(held, f"$.{a.name}", "double")
            outside = F.lit(False)
            if a.low is not None:
                outside = outside | (number < a.low)
            if a.high is not None:
                outside = outside | (number > a.high)
            problem = problem.when(outside, F.lit(f"range:{a.name}"))
        if a.options:
            problem = problem.when(~F.try_variant_get(held, f"$.{a.name}", "string").isin(*a.options), F.lit(f"option:{a.name}"))
        found.append(problem)
    known = F.array(*[F.lit(a.name) for a in arguments]).cast("array<string>")
    unknown = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unknown:"), k))
    return F.concat(F.filter(F.array(*found).cast("array<string>"), lambda x: x.isNotNull()), unknown)


def validated(calls: DataFrame, schemas: Schemas) -> DataFrame:
    """``errors`` (array) of every row with a tool name, and ``held``, its arguments as a value."""
    keys = F.json_object_keys("arguments")
    with_value = calls.withColumns({"held": F.try_parse_json("arguments"), "keys": keys})
    errors = F.when(F.col("name").isNull(), F.array().cast("array<string>"))
    errors = errors.when(F.col("held").isNull() | F.col("keys").isNull(), F.array(F.lit("not_an_object")))
    for tool, arguments in schemas.items():
        errors = errors.when(F.col("name") == tool, _errors_of(arguments, F.col("held"), F.col("keys")))
    return with_value.withColumn("errors", errors.otherwise(F.array(F.lit("unknown_tool")))).drop("keys")


def canonical(rows: DataFrame) -> Column:
    """One JSON object per call: arguments, id, name, result; absent parts are left out."""
    return F.when(F.col("name").isNotNull(), F.to_json(F.struct(
        F.col("held").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"))))


def formatted(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, per result without one, and per message of prose."""
    calls, results = calls_and_results(messages)
    calls = store(calls, "tool-calls")
    order = levels(calls)
    rows = validated(linked(calls, results), schemas)
    rows = rows.alias("n").join(order.alias("e"), _same("n.call_id", "e.call_id"), "left").select("n.*", "e.level")
    made = rows.select(
        "conv_id", "call_id", "name", "call_turn", "place", "result_turn", "same_id", "status",
        F.when((F.col("status") != "no_call") & F.col("call_id").isNull(), 0).otherwise(F.col("level")).alias("level"),
        F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("valid"), canonical(rows).alias("canonical"))
    told = prose(messages).select(
        "conv_id", F.col("turn").alias("call_turn"), F.lit("prose").alias("status"), F.lit(0).cast("long").alias("same_id"),
        F.lit("").alias("errors"), F.lit(True).alias("valid"), F.to_json(F.struct("role", "text")).alias("canonical"))
    return made.unionByName(told, allowMissingColumns=True)
