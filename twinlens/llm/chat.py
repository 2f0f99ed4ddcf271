"""Chat formatting: tool calls linked with their results, with DataFrame functions only.

Calls and results are hash-joined by (conversation, identifier). Calls are put
in topological order of their dependencies, their arguments are validated
against schemas as variants, and each is serialised as canonical JSON: sorted
keys, no white space. A row stays a row of its call throughout, so a conversation
of any length is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.sources.scratch import drop, materialise, scratch_path

#: Schema types and the variant types that they admit.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def arguments_valid(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Whether JSON arguments fit the schema of their tool; null and broken JSON and unknown tools don't.

    A schema has ``properties`` {parameter: type}, ``required`` [parameter] and
    ``additional`` (whether others are admitted; default no).
    """
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.lit(False)
    for tool, schema in sorted(schemas.items()):
        checks = keys.isNotNull() & parsed.isNotNull()
        for parameter, kind in sorted(schema.get("properties", {}).items()):
            found = F.schema_of_variant(F.try_variant_get(parsed, f'$["{parameter}"]', "variant"))
            fits = F.coalesce(found.rlike(f"^(?:{_KINDS[kind]})$"), F.lit(False))
            absent = ~F.coalesce(F.array_contains(keys, parameter), F.lit(False))
            checks = checks & (fits | (F.lit(parameter not in schema.get("required", ())) & absent))
        if not schema.get("additional", False):
            known = F.array(*[F.lit(p) for p in sorted(schema.get("properties", {}))]).cast("array<string>")
            checks = checks & (F.size(F.array_except(keys, known)) == 0)
        out = F.when(name == tool, F.coalesce(checks, F.lit(False))).otherwise(out)
    return out


def _levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, call, level): the longest chain of dependencies below each call; calls on and behind cycles are left out.

    A round gives a level to every call whose dependencies all have one. Before
    that, a dependency on a call that itself waits for one call only is passed on
    to that call (pointer jumping), so a chain of n calls takes log(n) rounds
    and not n. Calls that wait for several calls at each of n levels take up to n.
    Ends when a round gives no level, which on acyclic rest never happens.
    """
    spark = calls.sparkSession
    key = ["conv", "call"]
    known = calls.select(*key).distinct()
    links, links_path = materialise(edges.groupBy(*key, "dep").agg(F.lit(1).cast("long").alias("steps")), "level-links")
    # base: the least level that what is known so far allows; open: the number of dependencies without a level.
    nodes, nodes_path = materialise(known.withColumn("base", F.lit(0).cast("long")), "level-nodes")
    found, serial = scratch_path(spark, "levels"), 0
    while True:
        waits = links.groupBy(*key).agg(F.count(F.lit(1)).alias("open"), F.max(F.struct("steps", "dep")).alias("only"))
        state, state_path = materialise(nodes.join(waits, key, "left").select(*key, "base", F.coalesce("open", F.lit(0)).alias("open"), "only"), "level-state")
        # Calls with a level leave: what depends on them takes it over in this round.
        state.where("open = 0").select(*key, F.col("base").alias("level")).write.parquet(f"{found}/round={serial}")
        counts = state.agg(F.count_if(F.col("open") == 0), F.count_if(F.col("open") > 0)).first()
        if not counts[0] or not counts[1]:
            drop(spark, links_path, nodes_path, state_path)
            types = {f.name: f.dataType.simpleString() for f in known.schema.fields}
            return spark.read.schema(f"conv {types['conv']}, call {types['call']}, level long, round int").parquet(found).select(*key, "level")
        serial += 1
        of_dep = state.select("conv", F.col("call").alias("dep"), F.col("base").alias("dep_base"), F.col("open").alias("dep_open"), F.col("only").alias("dep_only"))
        # A call whose only dependency gets its level now gets its own in the next round: nothing is passed over it to a call that leaves.
        leaving = state.where("open = 0").select("conv", F.col("call").alias("next"), F.lit(True).alias("leaves"))
        seen, seen_path = materialise(links.join(of_dep, ["conv", "dep"]).withColumn("next", F.col("dep_only.dep")).join(leaving, ["conv", "next"], "left"), "level-seen")
        # What a dependency's base asks for holds at once, and is all that a dependency with a level or with one link asks for besides.
        bounds = seen.where("dep_open <= 1").groupBy(*key).agg(F.max(F.col("steps") + F.col("dep_base")).alias("bound"))
        after_nodes, after_nodes_path = materialise(state.where("open > 0").select(*key, "base").join(bounds, key, "left").select(*key, F.greatest("base", F.coalesce("bound", F.lit(0))).alias("base")), "level-nodes")
        one = (F.col("dep_open") == 1) & F.col("leaves").isNull()
        passed = seen.where("dep_open > 0").select(*key, F.when(one, F.col("dep_only.dep")).otherwise(F.col("dep")).alias("dep"), F.when(one, F.least(F.col("steps") + F.col("dep_only.steps"), F.lit(1 << 40))).otherwise(F.col("steps")).alias("steps"))
        after_links, after_links_path = materialise(passed.groupBy(*key, "dep").agg(F.max("steps").alias("steps")), "level-links")
        drop(spark, links_path, nodes_path, state_path, seen_path)
        links, links_path, nodes, nodes_path = after_links, after_links_path, after_nodes, after_nodes_path


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per call: conv, call, position, level, linked, valid, record.

    ``calls``: conv, call, name, arguments (JSON text), position, depends_on
    (array of identifiers). ``results``: conv, call, content, position. Level is
    the longest chain of known dependencies below a call, null on and behind
    cycles; sorting a conversation by (level, position) is a topological order.
    A call is linked if a result with its identifier stands
    after it; of several the earliest counts. It is valid if its arguments fit
    the schema, its identifier is its own, its dependencies exist and it is on
    no cycle. Null identifiers link with nothing and are not valid. Empty tables
    give an empty result, or calls that aren't linked; further columns are not read.
    """
    base, _ = materialise(
        calls.select("conv", "call", "name", "arguments", "position", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")), "calls"
    )
    known = base.where("conv is not null and call is not null").groupBy("conv", "call").agg(F.count(F.lit(1)).alias("uses"), F.min("position").alias("at"))
    edges = base.where("conv is not null and call is not null").select("conv", "call", F.explode(F.array_distinct("depends_on")).alias("dep"))
    placed, _ = materialise(edges.where("dep is not null").join(known.select("conv", F.col("call").alias("dep"), F.col("at").alias("dep_at")), ["conv", "dep"], "left"), "edges")
    of_call = placed.groupBy("conv", "call").agg(F.bool_or(F.col("dep_at").isNull()).alias("missing"))
    levels = _levels(known, placed.where("dep_at is not null"))
    # The first result after a call: both are put in order of position and each call takes the least that comes later.
    timeline = base.where("conv is not null and call is not null").select("conv", "call", "position", F.lit(1).alias("side"), F.lit(None).cast("string").alias("content")).distinct().unionByName(
        results.select("conv", "call", "position", F.lit(0).alias("side"), F.col("content").cast("string").alias("content")).groupBy("conv", "call", "position", "side").agg(F.min("content").alias("content"))
    )
    behind = Window.partitionBy("conv", "call").orderBy("position").rangeBetween(1, Window.unboundedFollowing)
    answers = timeline.withColumn("answer", F.first(F.when(F.col("side") == 0, F.struct(F.col("position").alias("answered"), "content")), ignorenulls=True).over(behind)).where("side = 1").select("conv", "call", "position", "answer")
    row = base.join(known.select("conv", "call", "uses"), ["conv", "call"], "left").join(of_call, ["conv", "call"], "left").join(answers, ["conv", "call", "position"], "left").join(levels, ["conv", "call"], "left")
    level = F.when(F.col("call").isNull() | F.col("conv").isNull(), F.lit(0)).otherwise(F.col("level"))
    canonical = F.to_json(F.try_parse_json("arguments"))
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical, F.lit("null")),
        F.lit(',"call_id":'), _quoted("call"), F.lit(',"depends_on":'), F.to_json(F.array_sort("depends_on")),
        F.lit(',"name":'), _quoted("name"), F.lit(',"result":'), _quoted("answer.content"), F.lit("}"),
    )
    return row.withColumn("level", level).select(
        "conv", "call", "position", "level",
        F.col("answer").isNotNull().alias("linked"),
        (arguments_valid(F.col("name"), F.col("arguments"), schemas) & F.coalesce(F.col("uses") == 1, F.lit(False)) & ~F.coalesce(F.col("missing"), F.lit(False)) & F.col("level").isNotNull()).alias("valid"),
        record.alias("record"),
    )


def _quoted(column: str) -> Column:
    """A string as JSON, null as null."""
    text = F.to_json(F.array(F.col(column)))
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


#: Schema of the call that a user's turn stands for.
TURN_SCHEMAS = {"reply": {"properties": {"text": "string", "turn": "integer"}, "required": ["text", "turn"]}}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as calls and results: each user turn asks for a reply, and the assistant's next turn answers it.

    In conversations of even number a call depends on the user turn before; in
    those of odd number on the user turn after, if there is one, so that the
    order of the turns isn't the order of the calls. Null conversations and turns
    give calls without an identifier. Rows repeated under one conversation and
    turn give calls of one identifier. An empty table gives empty tables.
    """
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    asked = turns.where("role = 'user'")
    last = asked.groupBy("conv_id").agg(F.max("turn").alias("last"))
    none = F.array().cast("array<string>")
    before = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(none)
    after = F.when(F.col("turn") + 2 <= F.col("last"), F.array(name(F.col("turn") + 2))).otherwise(none)
    calls = asked.join(last, "conv_id", "left").select(
        F.col("conv_id").alias("conv"), F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), name(F.col("turn"))).alias("call"), F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"), F.col("turn").alias("position"),
        F.when(F.col("conv_id").isNull(), none).when(F.col("conv_id") % 2 == 0, before).otherwise(after).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), name(F.col("turn") - 1).alias("call"), F.col("text").alias("content"), F.col("turn").alias("position"))
    return calls, results
