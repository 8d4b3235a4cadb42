"""Chat formatting with linked tool calls.

A message is text, or JSON: an assistant's ``{"content"?, "tool_calls": [{"id", "name", "arguments", "after"?}]}``
or a tool's ``{"tool_call_id", "content"}``. Calls and results meet in a hash join on conversation and
identifier; ``after`` names calls that must come first, and calls are put in topological order: inside their
conversation where it names few, else by rounds of joins that peel off a level each; arguments are checked against schemas; every message and call becomes one line of
canonical JSON (keys sorted, no spaces, arguments by way of VARIANT, which keeps keys sorted). Output is one
row a line with the keys that order it, so no task ever holds a whole conversation. All DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larkfield.runtime import Scratch, read_table

#: constraints of a conversation that are ordered inside one row; with more, by joins
FEW = 64

#: tool -> parameter -> (JSON type, required)
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True)},
}
#: JSON type -> how VARIANT names it
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
_CALLS = "content string, tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
_RESULT = "tool_call_id string, content string"


def _valid(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """Null if the arguments fit the tool's schema, else the reason."""
    args = F.try_parse_json(arguments)
    reason = F.lit("unknown tool")
    for tool, params in schemas.items():
        why = F.lit(None).cast("string")
        for param, (kind, required) in reversed(params.items()):
            value = F.try_variant_get(args, f"$.{param}", "variant")
            of = F.schema_of_variant(value)
            fits = F.lit(False)
            for prefix in _TYPES[kind]:
                fits = fits | F.startswith(of, F.lit(prefix))
            if kind == "number":
                fits = fits | F.startswith(of, F.lit("DECIMAL"))
            missing = value.isNull() | F.is_variant_null(value)
            why = F.when(missing & F.lit(required), f"missing {param}").when(~missing & ~fits, f"type of {param}").otherwise(why)
        reason = F.when(name == tool, why).otherwise(reason)
    known = F.startswith(F.schema_of_variant(args), F.lit("OBJECT"))
    return F.when(args.isNull() | ~known, "arguments are no object").otherwise(reason)


def parse(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages under fixed names, with calls or result parsed where there are any."""
    out = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    json = F.startswith(F.ltrim("text"), F.lit("{"))
    calls = F.when(json & (F.col("role") == "assistant"), F.from_json("text", _CALLS, {"mode": "PERMISSIVE"}))
    result = F.when(json & (F.col("role") == "tool"), F.from_json("text", _RESULT, {"mode": "PERMISSIVE"}))
    return out.withColumn("calls", calls).withColumn("result", result)


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level): the topological level of each call; null for calls on or behind a cycle.

    A call without predecessors has level 0, any other one more than the highest before it. Names of calls
    that don't exist are no constraint. ``conv_id`` must not be null. A conversation with FEW constraints at most is ordered in
    one row; each round over the others settles one level.
    """
    nodes = calls.select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("needs")).distinct()
    edges = scratch.save(edges.join(nodes.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"]), "edges")
    if edges.isEmpty():
        return nodes.withColumn("level", F.lit(0))
    size = scratch.save(edges.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    few = _ordered(edges.join(size.where(F.col("n") <= FEW).select("conv_id"), "conv_id", "left_semi"))
    many = size.where(F.col("n") > FEW).select("conv_id")
    known = few
    if not many.isEmpty():
        large = lambda rows: rows.join(many, "conv_id", "left_semi")
        known = known.unionByName(_peeled(large(nodes), scratch.save(large(edges), "edges"), scratch))
    rows = nodes.join(known.withColumn("known", F.lit(True)), ["conv_id", "call_id"], "left")
    return rows.select("conv_id", "call_id", F.when(F.col("known").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"))


def _ordered(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of all calls that edges name, by relaxing a conversation's edges as often as it has calls.

    The level of a call on or behind a cycle then reaches the number of calls, which no other's does.
    """
    rows = edges.groupBy("conv_id").agg(F.collect_list(F.struct("needs", "call_id")).alias("e"))  # FEW at most
    names = F.array_distinct(F.concat(F.transform("e", lambda x: x["needs"]), F.transform("e", lambda x: x["call_id"])))
    rows = rows.select("conv_id", "e", names.alias("names"))

    def relaxed(held: Column, _: Column) -> Column:
        best = lambda call: F.aggregate(
            F.filter("e", lambda x: x["call_id"] == call), F.lit(0), lambda most, x: F.greatest(most, F.element_at(held, x["needs"]) + 1)
        )
        return F.transform_values(held, lambda call, level: F.greatest(level, best(call)))

    start = F.map_from_entries(F.transform("names", lambda n: F.struct(n.alias("key"), F.lit(0).alias("value"))))
    done = F.aggregate(F.sequence(F.lit(1), F.size("names")), start, relaxed)
    out = rows.select("conv_id", F.size("names").alias("n"), F.explode(done).alias("call_id", "level"))
    return out.select("conv_id", "call_id", F.when(F.col("level") < F.col("n"), F.col("level")).alias("level"))


def _peeled(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The same by rounds: each takes the calls that wait for none that is left."""
    done = scratch.save(nodes.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    level, left = 0, edges
    while True:
        level += 1
        last = done.where(F.col("level") == level - 1).select("conv_id", F.col("call_id").alias("needs"))
        new_left = scratch.save(left.join(last, ["conv_id", "needs"], "left_anti"), "edges")
        waiting = left.select("conv_id", "call_id").distinct()
        freed = waiting.join(new_left.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level))
        freed = scratch.save(freed, "levels")
        if not freed.limit(1).count():
            break
        done, left = done.unionByName(freed), new_left
    return nodes.join(done, ["conv_id", "call_id"], "left")


def format_chat(
    messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS, conv_col: str = "conv_id",
    turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row for each message, and one for each tool call: (conv_id, turn, seq, level, kind, call_id, status, line).

    By turn, level and seq the rows of a conversation are in order: a call stands where it was made, calls
    of one message by topological level, and a linked result inside its call's line. kind: message, call
    or result. status of a call: ok, invalid: reason, pending (no result), duplicate (not the first of its
    identifier) or cycle; of a result: linked, repeated (not its call's first) or orphan; of a message: ok.
    Null roles and texts are empty; null conversations and turns are values like others; text that is no
    JSON of the forms above is plain; calls without an id are pending. Repeated rows repeat lines, and
    their calls are duplicates. Other columns are ignored; an empty table has no lines.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    parsed = parse(messages, conv_col, turn_col, role_col, text_col)
    is_call, is_result = F.coalesce(F.size("calls.tool_calls") > 0, F.lit(False)), F.col("result.tool_call_id").isNotNull()
    content = F.when(is_call, F.coalesce(F.col("calls.content"), F.lit(""))).otherwise(F.col("text"))
    plain = parsed.where(~(is_call & (content == "")) & ~is_result).select(
        "conv_id", "turn", F.lit(-1).alias("seq"), F.lit(-1).alias("level"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit("ok").alias("status"), F.to_json(F.struct(content.alias("content"), "role", "turn")).alias("line"),
    )
    made = parsed.where(is_call).select("conv_id", "turn", F.posexplode("calls.tool_calls").alias("seq", "c")).select(
        "conv_id", "turn", "seq", F.col("c.id").alias("call_id"), F.coalesce("c.name", F.lit("")).alias("name"), F.coalesce("c.arguments", F.lit("")).alias("arguments"),
        F.coalesce("c.after", F.array().cast("array<string>")).alias("after"),
    )
    given = parsed.where(is_result).select("conv_id", "turn", F.col("result.tool_call_id").alias("call_id"), F.coalesce("result.content", F.lit("")).alias("content"))
    made, given = scratch.save(made, "calls"), scratch.save(given, "results")
    named = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))  # null conversations are one
    key = [F.col("conv_id"), F.col("call_id")]
    first = Window.partitionBy(*key)
    made = made.withColumn("rank", F.row_number().over(first.orderBy("turn", "seq", "name", "arguments")))
    given = given.withColumn("rank", F.row_number().over(first.orderBy("turn", "content")))
    order = levels(made.where("call_id is not null").select(named.alias("conv_id"), "call_id", "after"), scratch)
    made = made.withColumn("named", named)
    m, g, o = made.alias("m"), given.where("rank = 1").alias("g"), order.alias("o")
    linked = m.join(g, F.col("m.conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("m.call_id") == F.col("g.call_id")) & (F.col("m.rank") == 1), "left")
    linked = linked.join(o, (F.col("m.named") == F.col("o.conv_id")) & (F.col("m.call_id") == F.col("o.call_id")), "left")
    why = _valid(F.col("m.name"), F.col("m.arguments"), schemas)
    status = (
        F.when(F.col("m.call_id").isNotNull() & (F.col("m.rank") > 1), "duplicate")
        .when(F.col("m.call_id").isNotNull() & F.col("o.level").isNull(), "cycle")
        .when(why.isNotNull(), F.concat(F.lit("invalid: "), why))
        .when(F.col("g.content").isNull(), "pending").otherwise("ok")
    )
    arguments = F.coalesce(F.to_json(F.try_parse_json("m.arguments")), F.to_json(F.struct(F.col("m.arguments").alias("text"))))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    body = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"id":'), F.when(F.col("m.call_id").isNull(), "null").otherwise(quoted(F.col("m.call_id"))), F.lit(',"name":'), quoted(F.col("m.name")),
        F.lit(',"result":'), F.when(F.col("g.content").isNull(), "null").otherwise(quoted(F.col("g.content"))),
        F.lit(',"role":"assistant","turn":'), F.coalesce(F.col("m.turn").cast("string"), F.lit("null")), F.lit("}"),
    )
    calls = linked.select("m.conv_id", "m.turn", "m.seq", F.coalesce("o.level", F.lit(0)).alias("level"), F.lit("call").alias("kind"), "m.call_id", status.alias("status"), body.alias("line"))
    owner = made.where("rank = 1").select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    results = given.join(owner, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    known = F.when(F.col("i").isNull(), "orphan").when(F.col("rank") == 1, "linked").otherwise("repeated")
    results = results.select(
        "conv_id", "turn", F.lit(-1).alias("seq"), F.lit(-1).alias("level"), F.lit("result").alias("kind"), "call_id", known.alias("status"),
        F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"), "turn")).alias("line"),
    )
    return plain.unionByName(calls).unionByName(results)


def op7_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(read_table(spark, sf_dir, "conversations"))
