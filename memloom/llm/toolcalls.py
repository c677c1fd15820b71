"""Linking tool calls to their results, natively.

Calls and results meet in a hash join on (conversation, identifier); calls get a level, the length of the
longest chain of calls that they depend on; their arguments are checked against a schema for each tool;
and each call becomes one line of canonical JSON (sorted keys, no spaces; numbers as they are written).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, scratch

#: JSON types and how schema_of_variant names them.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "object": "OBJECT.*", "array": "ARRAY.*"}

#: The tool that a dialogue's user turns call (see dialogue_calls).
ASK = {
    "ask": {
        "required": ["n_chars", "reply_to", "text", "turn"],
        "properties": {"n_chars": {"type": "integer", "minimum": 60}, "reply_to": {"type": "string"}, "text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}},
    }
}


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no spaces; null if it isn't valid or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def _unlike(kind: str):
    """Whether a type's name is not of a kind."""
    return lambda name: ~F.coalesce(name.rlike(f"^{kind}$"), F.lit(False))


def _checks(v: Column, schema: dict, path: str) -> list[Column]:
    """Errors (or null) of the properties of the object at path, nested ones included, by sorted names."""
    checks = []
    for name, spec in sorted(schema.get("properties", {}).items()):
        at = f"{path}.{name}"
        value = F.try_variant_get(v, f"${at}", "variant")
        kind = F.schema_of_variant(value)
        given = kind.isNotNull()
        say = lambda what, at=at: F.lit(f"{what}:{at[1:]}")
        if name in schema.get("required", []):
            # a nested property is missing only from an object that is there
            there = F.lit(True) if not path else F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"${path}", "variant")).startswith("OBJECT"), F.lit(False))
            checks.append(F.when(there & ~given, say("missing")))
        checks.append(F.when(given & ~kind.rlike(f"^{TYPES[spec['type']]}$"), say("type")))
        number = F.try_variant_get(v, f"${at}", "double")
        if "minimum" in spec:
            checks.append(F.when(number < spec["minimum"], say("minimum")))
        if "maximum" in spec:
            checks.append(F.when(number > spec["maximum"], say("maximum")))
        if "enum" in spec:
            checks.append(F.when(given & ~F.coalesce(F.try_variant_get(v, f"${at}", "string").isin(spec["enum"]), F.lit(False)), say("enum")))
        if "properties" in spec:
            checks += _checks(v, spec, at)
        if "items" in spec:
            wanted = F.transform(F.try_variant_get(v, f"${at}", "array<variant>"), F.schema_of_variant)
            odd = F.filter(wanted, _unlike(TYPES[spec["items"]["type"]]))
            checks.append(F.when(F.size(odd) > 0, say("items")))
    return checks


def argument_errors(arguments: Column, schema: dict) -> Column:
    """What is wrong with a JSON object of arguments, as an array of short texts in a fixed order.

    Properties are checked for presence, type, minimum, maximum and enum, nested objects likewise and
    arrays for the type of their items; unknown keys of the object itself are listed last. A text that is
    no JSON object, or repeats a key, is 'not an object'.
    """
    v = F.try_parse_json(arguments)
    checks = _checks(v, schema, "")
    extra = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*[F.lit(p) for p in sorted(schema.get("properties", {}))]).cast("array<string>"))), lambda k: F.concat(F.lit("extra:"), k))
    listed = F.concat(F.array_compact(F.array(F.lit(None).cast("string"), *checks)), extra)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    return F.when(F.coalesce(is_object, F.lit(False)), listed).otherwise(F.array(F.lit("not an object")))


def errors_by_tool(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    out = F.array(F.lit("unknown tool"))
    for tool, schema in sorted(schemas.items()):
        out = F.when(name == tool, argument_errors(arguments, schema)).otherwise(out)
    return out


KEY = ["conv_id", "call_id"]


def _jump(chains: DataFrame) -> DataFrame:
    """chains(conv_id, call_id, to, steps, at_end) with every call moved to the end of its chain.

    Each round doubles the steps taken, so a chain of n calls takes log2(n) rounds; calls on a cycle, or
    led to one, never get there: a round in which no call arrives is the last.
    """
    ends = chains.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("at_end").alias("there"))
    left = chains.filter("NOT at_end").count()
    while left:
        new = materialize(chains.join(ends, ["conv_id", "to"]).select("conv_id", "call_id", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("at_end")))
        discard(chains)
        chains, before = new, left
        left = chains.filter("NOT at_end").count()
        if left == before:
            break
        ends = chains.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("at_end").alias("there"))
    return chains


def order_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for each identified call of calls(conv_id, call_id, after).

    level is the length of the longest chain of calls that a call depends on (named in after), so calls
    in the order of their levels follow all they depend on; null in and behind a cycle. Calls with one
    dependency form chains, which are followed by doubling; calls with several ('forks') then take one
    round for each fork on a path.
    """
    with scratch() as keep:
        ids = materialize(calls.select(*KEY).dropna().dropDuplicates())
        named = calls.select(*KEY, F.explode("after").alias("dep")).dropna().dropDuplicates()
        edges = materialize(named.join(ids.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"]))
        deps = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep"))
        one = F.coalesce(F.col("n") == 1, F.lit(False))
        to = F.when(one, F.col("dep")).otherwise(F.col("call_id"))
        chains = _jump(materialize(ids.join(deps, KEY, "left").select(*KEY, to.alias("to"), one.cast("long").alias("steps"), (~one).alias("at_end"))))
        forks = materialize(deps.filter("n > 1").select(*KEY, "n"))
        if not forks.count():
            return keep(materialize(chains.select(*KEY, F.when(F.col("at_end"), F.col("steps")).cast("int").alias("level"))))
        # each fork waits for the ends of its dependencies' chains
        via = chains.filter("at_end").select("conv_id", F.col("call_id").alias("dep"), "to", "steps")
        waits = materialize(edges.join(forks, KEY).join(via, ["conv_id", "dep"]).select(*KEY, "n", "to", "steps"))
        known = materialize(chains.filter("at_end AND to = call_id").join(forks, KEY, "left_anti").select("conv_id", F.col("call_id").alias("to"), F.lit(0).cast("long").alias("base")))
        while True:
            ready = waits.join(known, ["conv_id", "to"]).groupBy(*KEY, "n").agg(F.count(F.lit(1)).alias("got"), F.max(F.col("base") + F.col("steps") + 1).alias("base")).filter("got = n")
            ready = materialize(ready.select("conv_id", F.col("call_id").alias("to"), "base").join(known, ["conv_id", "to"], "left_anti"))
            if not ready.count():
                break
            known = materialize(known.unionByName(ready))
        levels = chains.filter("at_end").join(known, ["conv_id", "to"]).select(*KEY, (F.col("base") + F.col("steps")).cast("int").alias("level"))
        return keep(materialize(ids.join(levels, KEY, "left")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call, one for each result without a call, and one for each further result of a call.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (identifiers it depends on);
    results: conv_id, call_id, turn, content (JSON text). Gives conv_id, call_id, turn, level, name,
    linked, result_turn, errors (array, empty for valid arguments) and json.

    Null identifiers or conversations link to nothing and have no level; of several results of a call the
    one with the least (turn, content) is linked, the others are rows of their own, equal ones one;
    repeated calls each get their row; dependencies on unknown calls are ignored; arguments that are no
    JSON object give an error and appear as null in json; very long texts are carried whole; empty tables
    give an empty result; other columns are ignored, whatever their names.
    """
    calls = calls.select(*KEY, "turn", "name", "arguments", "after")
    results = results.select(*KEY, "turn", "content").distinct()
    least = results.dropna(subset=KEY).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r"))
    found = least.select(*KEY, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.lit(True).alias("hit"))
    joined = calls.join(order_levels(calls), KEY, "left").join(found.hint("shuffle_hash"), KEY, "left")
    row = F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("call_id"), "name", F.try_parse_json("content").alias("result"), "turn",
    )
    called = joined.select(
        *KEY, "turn", "level", "name", F.coalesce("hit", F.lit(False)).alias("linked"), "result_turn",
        errors_by_tool(F.col("name"), F.col("arguments"), schemas).alias("errors"), F.to_json(row, {"ignoreNullFields": "false"}).alias("json"),
    )
    known = calls.select(*KEY).dropna().dropDuplicates().withColumn("called", F.lit(True))
    rest = results.join(known, KEY, "left").join(least, KEY, "left")
    rest = rest.filter(F.col("called").isNull() | ~F.struct("turn", "content").eqNullSafe(F.col("r")))
    alone = F.struct(F.lit(None).cast("string").alias("arguments"), F.col("call_id").alias("call_id"), F.lit(None).cast("string").alias("name"), F.try_parse_json("content").alias("result"), "turn")
    others = rest.select(
        *KEY, "turn", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("linked"),
        F.col("turn").alias("result_turn"), F.array(F.when(F.col("called"), F.lit("further result")).otherwise(F.lit("no call"))).alias("errors"), F.to_json(alone, {"ignoreNullFields": "false"}).alias("json"),
    )
    return called.unionByName(others)


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls and results of messages(conv_id, turn, role, text) in the common chat format.

    An assistant's text {"tool_calls": [{"id", "name", "arguments", "after"}]} holds calls, a tool's text
    {"tool_call_id", "content"} a result; other texts hold neither.
    """
    v = F.try_parse_json("text")
    listed = F.from_json(F.to_json(F.try_variant_get(v, "$.tool_calls", "variant")), "array<struct<id string, name string, arguments string, after array<string>>>")
    calls = messages.filter("role = 'assistant'").select("conv_id", "turn", F.explode(listed).alias("c")).select(
        "conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after")
    )
    results = messages.filter("role = 'tool'").select("conv_id", F.try_variant_get(v, "$.tool_call_id", "string").alias("call_id"), "turn", F.to_json(F.try_variant_get(v, "$.content", "variant")).alias("content"))
    return calls, results.filter("call_id IS NOT NULL")


def dialogue_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls and results of a plain dialogue: a user turn calls the tool ask, any other turn is the result of
    the turn before it. A call replies to, so depends on, the user turn two before it; the first has none to
    reply to. A text of several lines is passed as the array of its lines; a null text has neither n_chars
    nor text. Null turns have no identifier."""
    ident = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit(":"), n.cast("string"))
    reply = F.when(F.col("turn") >= 2, ident(F.col("turn") - 2)).alias("reply_to")
    args = lambda text: F.to_json(F.struct(F.length("text").alias("n_chars"), reply, text.alias("text"), "turn"))
    arguments = F.when(F.contains("text", F.lit("\n")), args(F.split("text", "\n"))).otherwise(args(F.col("text")))
    calls = messages.filter("role = 'user'").select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.lit("ask").alias("name"), arguments.alias("arguments"), F.array_compact(F.array(reply)).alias("after"))
    content = F.to_json(F.struct("role", "text", "turn"), {"ignoreNullFields": "false"})
    results = messages.filter("role IS DISTINCT FROM 'user'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", content.alias("content"))
    return calls, results


def op5_chat(spark, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = link_calls(*dialogue_calls(messages), ASK)
    return out.withColumn("errors", F.array_join("errors", ",")).withColumns({"level": F.coalesce("level", F.lit(-1)).cast("int"), "result_turn": F.coalesce("result_turn", F.lit(-1))})


ORACLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END AS reply_to, turn, text FROM conversations WHERE role = 'user'
), a AS (
  SELECT *, '{' || concat_ws(',',
      '"n_chars":' || length(text), '"reply_to":' || to_json(reply_to),
      '"text":' || CASE WHEN contains(text, chr(10)) THEN to_json(string_split(text, chr(10))) ELSE to_json(text) END, '"turn":' || turn) || '}' AS arguments,
    concat_ws(',',
      CASE WHEN text IS NULL THEN 'missing:n_chars' WHEN length(text) < 60 THEN 'minimum:n_chars' END, CASE WHEN reply_to IS NULL THEN 'missing:reply_to' END,
      CASE WHEN text IS NULL THEN 'missing:text' WHEN contains(text, chr(10)) THEN 'type:text' END) AS errors
  FROM c
), i AS (
  SELECT DISTINCT conv_id, call_id, reply_to FROM c WHERE call_id IS NOT NULL
), v AS (
  SELECT conv_id, call_id, 0 AS level FROM i WHERE NOT EXISTS (SELECT 1 FROM i AS p WHERE p.conv_id = i.conv_id AND p.call_id = i.reply_to)
  UNION ALL SELECT i.conv_id, i.call_id, v.level + 1 FROM i JOIN v ON i.conv_id = v.conv_id AND i.reply_to = v.call_id
), r AS (
  SELECT DISTINCT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn,
    '{"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}' AS content
  FROM conversations WHERE role IS DISTINCT FROM 'user'
), f AS (
  SELECT conv_id, call_id, min({'turn': turn, 'content': content}) AS r FROM r WHERE call_id IS NOT NULL GROUP BY 1, 2
)
SELECT a.conv_id, a.call_id, a.turn, coalesce(v.level, -1)::INTEGER AS level, 'ask' AS name, f.r IS NOT NULL AS linked, coalesce(f.r.turn, -1) AS result_turn, a.errors,
       '{"arguments":' || a.arguments || ',"call_id":' || to_json(a.call_id) || ',"name":"ask","result":' || coalesce(f.r.content, 'null') || ',"turn":' || a.turn || '}' AS json
FROM a LEFT JOIN v USING (conv_id, call_id) LEFT JOIN f USING (conv_id, call_id)
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, -1, NULL, false, r.turn, CASE WHEN k.call_id IS NULL THEN 'no call' ELSE 'further result' END,
       '{"arguments":null,"call_id":' || to_json(r.call_id) || ',"name":null,"result":' || r.content || ',"turn":' || r.turn || '}'
FROM r LEFT JOIN (SELECT DISTINCT conv_id, call_id FROM i) k USING (conv_id, call_id) LEFT JOIN f USING (conv_id, call_id)
WHERE k.call_id IS NULL OR {'turn': r.turn, 'content': r.content} IS DISTINCT FROM f.r
"""

QUERIES = {"op5_tool_calls": op5_chat}
ORACLES = {"op5_tool_calls": ORACLE_SQL}
