"""Linking of tool calls and their results in chat turns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import checkpoint

#: What arguments a tool takes: {tool: {argument: (type, required)}}; types are JSON's.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "fetch": {"url": ("string", True)},
}
CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant>>>"
RESULT = "struct<tool_call_id:string,content:string>"
LOOKS = {"string": r'^"', "integer": r"^-?[0-9]+$", "number": r"^-?[0-9.]+([eE][-+]?[0-9]+)?$", "boolean": "^(true|false)$", "object": r"^\{", "array": r"^\["}
#: A string value "$id" anywhere in canonical JSON, not a key.
REFERENCE = r'"\$([^"\\]+)"(?!:)'


def problems(name: Column, values: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments (values: a map of canonical JSON), sorted; an unknown tool is one problem."""
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, fields in schemas.items():
        checks = [F.transform(F.array_except(F.map_keys(values), F.array(*map(F.lit, fields))), lambda k: F.concat(F.lit("unexpected "), k))] if fields else [F.transform(F.map_keys(values), lambda k: F.concat(F.lit("unexpected "), k))]
        for field, (kind, required) in sorted(fields.items()):
            value = values.getItem(field)
            bad = F.when(value.isNull(), F.lit(f"missing {field}") if required else F.lit(None).cast("string")).when(~value.rlike(LOOKS[kind]), F.lit(f"{field} is not {kind}"))
            checks.append(F.array_compact(F.array(bad)))
        found = F.when(values.isNull(), F.array(F.lit("arguments are not an object"))).otherwise(F.array_sort(F.flatten(F.array(*checks))))
        out = F.when(name == tool, found).otherwise(out)
    return out


def levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, id, level) of the nodes that need others: 2 for each step of the longest chain, -1 in or behind a cycle."""
    waiting = needs.select("conv_id", "id").distinct()
    placed = checkpoint(nodes.select("conv_id", "id").distinct().join(waiting, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)))
    level, new = 0, waiting.limit(1).count()
    while new:
        level += 2
        blocked = needs.join(placed.select("conv_id", F.col("id").alias("on")), ["conv_id", "on"], "left_anti").select("conv_id", "id").distinct()
        step = checkpoint(waiting.join(placed, ["conv_id", "id"], "left_anti").join(blocked, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(level)))
        new = step.limit(1).count()
        placed = checkpoint(placed.union(step)) if new else placed
    return waiting.join(placed, ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("level", F.lit(-1)).alias("level"))


def link(turns: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, role, n_calls, n_linked, level, problems, json.

    An assistant turn whose text is ``{"tool_calls": [{id, name, arguments}]}`` makes calls; a tool turn
    ``{"tool_call_id", "content"}`` answers one. Calls and results are joined by (conv_id, id) hash join.
    A call whose arguments hold the string "$id" of another call, at any depth, depends on that call (ids with
    quotes or backslashes can't be named so). level is the longest chain of dependencies before a turn: 0 for
    plain turns and free calls, a result is one above its call; turns in a cycle, or behind one, get -1.
    (level, turn) is a topological order. problems lists failed schema checks, calls without id or answer
    and results without call. json is canonical: sorted keys at every depth, no spaces, without nulls; calls
    keep their order and hold their arguments and their results' contents. n_linked counts (call, result)
    pairs: repeated ids link all their pairs, and of equal ids all results are shown. Rows with null conv_id,
    turn, role or text keep nulls and link nothing. Malformed JSON is plain text. Every input row gives one
    row, repeats included. Other columns are left out.
    """
    schemas = SCHEMAS if schemas is None else schemas
    object_ = F.col("text").startswith("{")
    t = turns.select("conv_id", "turn", "role", "text").withColumns({
        "calls": F.when((F.col("role") == "assistant") & object_, F.from_json("text", CALLS).getField("tool_calls")),
        "answer": F.when((F.col("role") == "tool") & object_, F.from_json("text", RESULT)),
    })
    calling, answering = F.coalesce(F.size("calls"), F.lit(0)) > 0, F.col("answer.tool_call_id").isNotNull()
    none = F.array().cast("array<string>")
    body = lambda **more: F.to_json(F.struct(*[c.alias(k) for k, c in sorted({"role": F.col("role"), "turn": F.col("turn"), **more}.items())]))
    columns = ["conv_id", "turn", "role", "n_calls", "n_linked", "level", "problems", "json"]
    plain = t.where(~calling & ~answering).select("conv_id", "turn", "role", F.lit(0).alias("n_calls"), F.lit(0).alias("n_linked"), F.lit(0).alias("level"), none.alias("problems"), body(content=F.col("text")).alias("json"))
    # the turns that call or answer, each with a number of its own
    special = checkpoint(t.where(calling | answering).drop("text").withColumn("row", F.monotonically_increasing_id()))
    calls = special.where(calling).select("row", "conv_id", "turn", "role", F.posexplode("calls").alias("i", "c"))
    calls = calls.select("row", "conv_id", "turn", "role", "i", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    calls = calls.withColumn("canonical", F.to_json("arguments"))
    values = F.transform_values(F.from_json("canonical", "map<string,variant>"), lambda k, v: F.to_json(v))
    calls = checkpoint(calls.withColumn("values", F.when(F.col("canonical").startswith("{"), values)).drop("arguments"))
    results = special.where(answering).select("row", "conv_id", "turn", "role", F.col("answer.tool_call_id").alias("id"), F.col("answer.content").alias("content"))
    named = calls.where(F.col("id").isNotNull() & F.col("conv_id").isNotNull()).select("conv_id", "id", "canonical")
    needs = named.select("conv_id", "id", F.explode(F.regexp_extract_all("canonical", F.lit(REFERENCE), F.lit(1))).alias("on")).distinct()
    needs = checkpoint(needs.join(named.select("conv_id", F.col("id").alias("on")).distinct(), ["conv_id", "on"], "left_semi"))
    calls = calls.join(levels(named, needs), ["conv_id", "id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    answers = results.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("found"))
    calls = calls.join(answers, ["conv_id", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    missing = F.when(F.col("id").isNull(), F.array(F.lit("missing id"))).when(F.col("n") == 0, F.array(F.concat(F.lit("unanswered "), "id"))).otherwise(none)
    calls = calls.withColumn("bad", F.concat(problems(F.col("name"), F.col("values"), schemas), missing))
    item = F.struct("i", F.to_json(F.struct(F.try_parse_json("canonical").alias("arguments"), "id", "name", F.transform("found", lambda f: f["content"]).alias("results"))).alias("json"))
    made = calls.groupBy("row", "conv_id", "turn", "role").agg(
        F.count("*").cast("int").alias("n_calls"), F.sum("n").cast("int").alias("n_linked"), F.when(F.min("level") < 0, -1).otherwise(F.max("level")).alias("level"),
        F.array_sort(F.flatten(F.collect_list("bad"))).alias("problems"), F.array_sort(F.collect_list(item)).alias("items"),
    )
    listed = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["json"]), ","), F.lit("]"))
    made = made.withColumn("json", body(tool_calls=F.try_parse_json(listed))).select(*columns)
    owners = calls.groupBy("conv_id", "id").agg(F.min("level").alias("at"), F.count("*").alias("n_calls_of"))
    answered = results.join(owners, ["conv_id", "id"], "left").select(
        "conv_id", "turn", "role", F.lit(0).alias("n_calls"), F.coalesce("n_calls_of", F.lit(0)).cast("int").alias("n_linked"), F.when(F.col("at").isNull(), 0).when(F.col("at") < 0, -1).otherwise(F.col("at") + 1).alias("level"),
        F.when(F.col("at").isNull(), F.array(F.concat(F.lit("no call "), "id"))).otherwise(none).alias("problems"), body(content=F.col("content"), tool_call_id=F.col("id")).alias("json"),
    )
    return plain.unionByName(made).unionByName(answered)


def canonical(value) -> str:
    """The form that link() writes, for brute-force tests."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
