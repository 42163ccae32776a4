"""Tool-call linking in conversations, with DataFrame functions only.

A message of role ``assistant`` may hold tool calls, as JSON
``{"tool_calls": [{"id", "name", "arguments", "after": [ids]}]}``; one of role
``tool`` holds a result, ``{"tool_call_id", "content"}``. Calls and results of a
conversation are linked by a hash join on the identifier. Calls are ordered
topologically, so that each comes after those it names: its place is that of its message
or, if greater, the next after those of the calls before it. A log in order takes
no round at all; else each round settles the calls that wait for settled ones
only, and halves chains of calls that wait for one other each. There are never more
rounds than calls. Places come from joins, never
from a conversation gathered in one task. Arguments are validated against the
tool's schema (a table of parameters), and each linked call is written as
canonical JSON: keys in order, no spaces.

Defined results: a call without result is ``pending``; a result without call is
an ``orphan`` with a null name; with several results for a call the earliest
message counts; calls that repeat an id each get the result. A name without
schema, arguments that are no JSON object, missing, ill-typed or unknown
parameters make a call invalid, and the first reason is named. Calls named in
``after`` that don't exist are passed over; calls on a cycle, or after one, are
``cyclic`` and keep the place of their message. Texts that are no such JSON are
plain messages and hold no calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Places of calls in one message.
PER_MESSAGE = 1 << 20


def calls_of(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, name, arguments (variant), after, place."""
    said = messages.where("role = 'assistant' and text is not null").select("conv_id", "turn", F.try_parse_json("text").alias("v"))
    each = said.select("conv_id", "turn", F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')").alias("calls")).select("conv_id", "turn", F.posexplode("calls").alias("at", "call"))
    return each.select(
        "conv_id",
        "turn",
        F.expr("try_variant_get(call, '$.id', 'string')").alias("call_id"),
        F.expr("try_variant_get(call, '$.name', 'string')").alias("name"),
        F.expr("try_variant_get(call, '$.arguments', 'variant')").alias("arguments"),
        F.coalesce(F.expr("try_variant_get(call, '$.after', 'array<string>')"), F.array().cast("array<string>")).alias("after"),
        (F.col("turn").cast("long") * PER_MESSAGE + F.col("at")).alias("place"),
    ).where("call_id is not null")


def results_of(messages: DataFrame) -> DataFrame:
    """conv_id, call_id, content and result_turn of each call's earliest result."""
    said = messages.where("role = 'tool' and text is not null").select("conv_id", "turn", F.try_parse_json("text").alias("v"))
    each = said.select("conv_id", "turn", F.expr("try_variant_get(v, '$.tool_call_id', 'string')").alias("call_id"), F.expr("try_variant_get(v, '$.content', 'string')").alias("content"))
    return each.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"), F.min_by("content", F.struct("turn", "content")).alias("content"))


def ordered(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and place of the calls that have to move, and whether they are cyclic."""
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("before"))
    places = calls.groupBy("conv_id", "call_id").agg(F.min("place").alias("place"))
    before = places.select("conv_id", F.col("call_id").alias("before"), F.col("place").alias("before_place"))
    known = edges.join(before, ["conv_id", "before"]).join(places, ["conv_id", "call_id"])
    late = stored(known.where("before_place >= place").select("conv_id").distinct())
    moved = "conv_id long, call_id string, place long, cyclic boolean"
    if not late.limit(1).count():
        return calls.sparkSession.createDataFrame([], moved)
    # A node's place is ``a`` at least, and once it waits for no other call (``waits`` is 0) exactly that. An edge says
    # that a call comes ``w`` places or more after another.
    edges = stored(known.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "before", F.lit(1).cast("long").alias("w")).distinct())
    start = stored(places.join(late, "conv_id", "left_semi"))
    own = ["conv_id", "call_id"]
    nodes = stored(start.withColumnRenamed("place", "a").join(edges.groupBy(*own).agg(F.count("*").alias("waits")), own, "left").fillna(0, ["waits"]))
    while True:
        # An edge from a settled call is done with. One from a call that waits for a single other is led on to that one, so that chains shrink to half.
        single = edges.groupBy(*own).agg(F.min("before").alias("next"), F.max("w").alias("further"), F.count("*").alias("n")).where("n = 1")
        ahead = nodes.select("conv_id", F.col("call_id").alias("before"), F.col("a").alias("before_a"), F.col("waits").alias("before_waits"))
        ahead = ahead.join(single.select("conv_id", F.col("call_id").alias("before"), "next", "further"), ["conv_id", "before"], "left")
        met = stored(edges.join(ahead, ["conv_id", "before"]))
        led = F.col("next").isNotNull()
        settled = F.col("before_waits") == 0
        least = met.where(settled | led).groupBy(*own).agg(F.max(F.col("before_a") + F.col("w")).alias("least"))
        kept = met.where(~settled).select(*own, F.coalesce("next", "before").alias("before"), (F.col("w") + F.coalesce("further", F.lit(0))).alias("w"))
        edges = stored(kept.groupBy(*own, "before").agg(F.max("w").alias("w")))
        waits = edges.groupBy(*own).agg(F.count("*").alias("waits"))
        nodes = stored(nodes.drop("waits").join(least, own, "left").join(waits, own, "left").select(*own, F.greatest("a", F.coalesce("least", "a")).alias("a"), F.coalesce("waits", F.lit(0)).alias("waits")))
        # While anything waits for settled calls alone, some edge goes; where none does, all that is left is on a cycle or after one.
        if not met.where(settled).limit(1).count():
            break
    return start.join(nodes, own).select(*own, F.when(F.col("waits") > 0, F.col("place")).otherwise(F.col("a")).alias("place"), (F.col("waits") > 0).alias("cyclic"))


def _checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds ``problem``: why the arguments don't fit the schema, null if they do.

    ``schemas`` has a row for each parameter: name, param, type (as in
    schema_of_variant, such as BIGINT or STRING), required. A tool without
    parameters has one row with a null param.
    """
    tools = schemas.groupBy("name").agg(F.map_from_entries(F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", F.struct("type", "required"))))).alias("params"))
    fields = F.expr("try_cast(arguments as map<string, variant>)")
    rows = calls.join(tools, "name", "left").withColumn("fields", fields)
    names = F.array_sort(F.map_keys("params"))
    given = F.transform_values("fields", lambda k, v: F.schema_of_variant(v))
    rows = rows.withColumn("given", given)
    missing = F.filter(names, lambda p: F.try_element_at("params", p)["required"] & ~F.array_contains(F.map_keys("given"), p))
    unknown = F.filter(F.array_sort(F.map_keys("given")), lambda p: ~F.array_contains(F.map_keys("params"), p))
    wrong = F.filter(names, lambda p: F.array_contains(F.map_keys("given"), p) & (F.try_element_at("given", p) != F.try_element_at("params", p)["type"]))
    first = lambda what, found: F.when(F.size(found) > 0, F.concat(F.lit(f"{what}: "), F.get(found, F.lit(0))))
    problem = F.when(F.col("params").isNull(), F.lit("no schema")).when(F.col("fields").isNull(), F.lit("no object")).otherwise(F.coalesce(first("missing", missing), first("type", wrong), first("unknown", unknown)))
    return rows.withColumn("problem", problem).drop("params", "fields", "given")


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per orphan result: conv_id, call_id, place, name, status, problem and ``json``.

    ``messages`` has conv_id, turn, role and text; rows without conv_id or turn
    are passed over. Sorting by (conv_id, place) orders each conversation's calls.
    """
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null and turn is not null")
    calls, results = calls_of(messages), results_of(messages)
    moved = ordered(calls).withColumnRenamed("place", "moved_to")
    checked = _checked(calls, schemas).join(moved, ["conv_id", "call_id"], "left").withColumn("place", F.coalesce("moved_to", "place")).withColumn("is_call", F.lit(True))
    both = checked.join(results, ["conv_id", "call_id"], "full_outer")
    status = F.when(F.col("is_call").isNull(), "orphan").when(F.coalesce("cyclic", F.lit(False)), "cyclic").when(F.col("result_turn").isNull(), "pending").otherwise("linked")
    both = both.withColumn("status", status).withColumn("place", F.coalesce("place", F.col("result_turn") * PER_MESSAGE))
    canonical = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", "problem", F.col("content").alias("result"), "status"), {"ignoreNullFields": "false"})
    return both.select("conv_id", "call_id", "place", "name", "status", "problem", canonical.alias("json"))


def schema_rows(spark: SparkSession, rows: list[tuple[str, str | None, str | None, bool]]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, param string, type string, required boolean")
