"""Chat formatting: tool calls and their results, linked, ordered, validated, serialised.

Turns are read into events: calls (with an identifier, a tool's name, arguments as JSON and
the identifiers of calls that must come before), results (with the identifier of their call)
and plain messages. Calls and results meet in hash joins by (conversation, identifier), where
each identifier has one row whatever number of turns name it, and identifiers with more than
1/4096 of all events meet a broadcast instead of being moved. Calls get their level of the
topological order: calls that wait for one other hang in trees, which pointer jumping settles
in a logarithmic number of rounds; those that wait for several are then contracted, and so on.
Arguments are held against their tool's schema; and each event becomes canonical JSON: no
white space, keys by code point, null members left out. Everything is SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, attach, cut, drop_cut, packed

#: Tool -> member -> (JSON type, whether it is required). Other members are not allowed.
Schemas = dict[str, dict[str, tuple[str, bool]]]

#: JSON type -> pattern of what schema_of_variant calls it.
TYPES = {
    "string": "STRING",
    "integer": "(TINYINT|SMALLINT|INT|BIGINT)",
    "number": "(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)",
    "boolean": "BOOLEAN",
    "null": "VOID",
    "array": "ARRAY<.*",
    "object": "OBJECT<.*",
}

#: The tool of dialogue turns: a user's turn asks for a reply.
REPLY: Schemas = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def events_of_json(turns: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Events of turns whose text is JSON where it calls a tool or gives a result.

    An assistant's text ``{"tool_calls": [{"id", "name", "arguments", "after"}]}`` is a call for
    each entry; a tool's text ``{"tool_call_id", "content"}`` is a result; all other turns are
    messages, texts that are no such JSON included.
    """
    shape = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, tool_call_id string, content string"
    read = F.from_json("text", shape)
    base = turns.select(packed(turns, carry).alias("row"), F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    base = base.withColumn("j", F.when(F.col("role").isin("assistant", "tool"), read))
    calls = base.where("role = 'assistant' and size(j.tool_calls) > 0").select("row", "conv", "turn", "role", F.posexplode("j.tool_calls").alias("place", "c"))
    calls = calls.select("row", "conv", "turn", "place", "role", F.lit("call").alias("kind"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.lit(None).cast("string").alias("content"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    rest = base.where("not coalesce(role = 'assistant' and size(j.tool_calls) > 0, false)")
    is_result = F.coalesce((F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull(), F.lit(False))
    rest = rest.select(
        "row", "conv", "turn", F.lit(0).alias("place"), "role", F.when(is_result, "result").otherwise("message").alias("kind"), F.when(is_result, F.col("j.tool_call_id")).alias("call_id"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.when(is_result, F.col("j.content")).otherwise(F.col("text")).alias("content"), F.array().cast("array<string>").alias("after"),
    )
    return calls.unionByName(rest)


def events_of_dialogue(turns: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Events of plain dialogue: a user's turn calls ``reply``, the assistant's next turn is its result.

    The identifier is ``conversation:turn`` of the user's turn. A call waits for the user's turn
    before the reply before it (``conversation:turn-2``), if there is one. Other turns are messages.
    """
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("long")
    call, result = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False))
    name = lambda back: F.concat(conv, F.lit(":"), (turn - back).cast("string"))
    arguments = F.to_json(F.struct(F.col("text").cast("string").alias("text"), turn.alias("turn")))
    return turns.select(
        packed(turns, carry).alias("row"), conv.alias("conv"), turn.alias("turn"), F.lit(0).alias("place"), "role",
        F.when(call, "call").when(result, "result").otherwise("message").alias("kind"),
        F.when(call, name(0)).when(result, name(1)).alias("call_id"),
        F.when(call, "reply").alias("name"), F.when(call, arguments).alias("arguments"), F.when(~call, F.col("text").cast("string")).alias("content"),
        F.when(call & (turn >= 2), F.array_compact(F.array(name(2)))).otherwise(F.array().cast("array<string>")).alias("after"),
    )


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments are an object with all members that the tool requires, of its types, and no others."""
    parsed = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, members in schemas.items():
        good = F.coalesce(F.schema_of_variant(parsed).rlike("^OBJECT<"), F.lit(False))
        allowed = F.array(*[F.lit(m) for m in members]).cast("array<string>")
        good = good & F.coalesce(F.size(F.array_except(F.json_object_keys(arguments), allowed)) == 0, F.lit(False))
        for member, (kind, required) in members.items():
            at = F.schema_of_variant(F.try_variant_get(parsed, "$['" + member.replace("'", "\\'") + "']", "variant"))
            good = good & F.coalesce(at.rlike(f"^{TYPES[kind]}$"), F.lit(not required))
        out = F.when(name == tool, good).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _levels(first: DataFrame) -> DataFrame:
    """(conv, call_id, level) of calls that wait for others; null level: in a cycle, or after one.

    Each round: calls with one forerunner left (``up``, so many levels above) jump to their
    forerunner's forerunner until they hang from a call that has none or several (or find
    themselves in a circle); what hangs from one without is settled; links to what hangs from one
    with several are led up to it, and parallel links become the longest, so that a diamond is
    one link in the next round. The rounds end when nothing is settled or led up any more: what
    is left lies in cycles or after them.
    """
    key = ["conv", "call_id"]
    above = lambda df, *more: df.select("conv", F.col("call_id").alias("up"), *more).hint("shuffle_hash")
    edges = first.select(*key, F.explode(F.array_distinct("after")).alias("up")).where("up is not null")
    edges = cut(edges.join(above(first), ["conv", "up"], "left_semi").select(*key, "up", F.lit(1).alias("far")))
    waiting = edges.select(*key).distinct()
    known = cut(waiting.withColumn("level", F.lit(None).cast("int")).limit(0))  # null level: never
    while not edges.isEmpty():
        tree = cut(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("up").alias("up"), F.first("far").alias("far")).where("n = 1").select(*key, "up", "far"))
        several = cut(edges.join(tree.select(*key).hint("shuffle_hash"), key, "left_anti"))
        old = [edges, known, tree, several]
        for _ in range(tree.count().bit_length() + 1):
            jumped = tree.join(above(tree, F.col("up").alias("to"), F.col("far").alias("more")), ["conv", "up"], "left")
            now = cut(jumped.select(*key, F.coalesce("to", "up").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("to").isNotNull().alias("moved")))
            tree = now.select(*key, "up", "far", "moved")
            old.append(now)
            if now.where("moved").isEmpty():
                break
        # Who still moves after that many jumps goes in circles.
        found = above(known, "level", F.lit(True).alias("found"))
        level = F.when(F.col("found"), F.col("level")).otherwise(0) + F.col("far")
        tops = tree.where("not moved").join(above(several.select(*key).distinct()), ["conv", "up"], "left_anti").join(found, ["conv", "up"], "left")
        settled = tops.select(*key, level.cast("int").alias("level")).unionByName(tree.where("moved").select(*key, F.lit(None).cast("int").alias("level")))
        settled = cut(settled)
        led = several.join(above(tree, F.col("up").alias("to"), F.col("far").alias("more"), F.col("moved").alias("circle")), ["conv", "up"], "left")
        led = led.groupBy(*key, F.coalesce("to", "up").alias("up")).agg(F.max(F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.max(F.col("to").isNotNull()).alias("led"), F.max(F.coalesce("circle", F.lit(False))).alias("circle"))
        led = led.join(above(several.select(*key).distinct(), F.lit(True).alias("open")), ["conv", "up"], "left").join(found, ["conv", "up"], "left")
        led = cut(led.select(*key, "up", "far", "led", "open", level.alias("level"), (F.col("circle") | F.coalesce(F.col("found") & F.col("level").isNull(), F.lit(False))).alias("never")))
        ready = led.groupBy(*key).agg(F.max("level").cast("int").alias("level"), F.max("never").alias("never"), F.max(F.coalesce("open", F.lit(False))).alias("open"))
        ready = cut(ready.where("never or not open").select(*key, F.when(~F.col("never"), F.col("level")).alias("level")))
        known = cut(known.unionByName(settled).unionByName(ready))
        links = tree.select(*key, "up", "far").unionByName(led.select(*key, "up", "far"))
        edges = cut(links.join(known.select(*key).hint("shuffle_hash"), key, "left_anti"))
        stuck = settled.isEmpty() and ready.isEmpty() and led.where("led").isEmpty()
        drop_cut(*old[1:], settled, led, ready)
        if stuck:
            break
    return waiting.join(known.hint("shuffle_hash"), key, "left").select(*key, "level")


def linked(events: DataFrame, schemas: Schemas) -> DataFrame:
    """Each event, linked, with its place in the order and its JSON.

    Adds ``linked_turn`` (a call's first result, a result's call), ``level`` (calls: twice their
    depth in the order of calls, results: one more than their call, messages: 0; null in cycles),
    ``status`` (call: answered, open, duplicate or cyclic; result: linked or orphan; else
    message), ``valid`` (of calls: see valid_arguments; else null) and ``json``. Of calls that
    repeat an identifier in a conversation, the first counts and the others are duplicates: the
    first by turn (null last), place in the turn, name, arguments and forerunners; calls that are
    equal in all of these are one call, given several times, and all count. Events without
    identifier or conversation are open or orphan. Ordering by (level of the call's depth, turn)
    is topological; nothing is gathered by conversation. Texts are never cut; an empty table
    gives an empty result; extra columns travel inside ``row`` only.
    """
    keyed, call, result = F.col("call_id").isNotNull() & F.col("conv").isNotNull(), F.col("kind") == "call", F.col("kind") == "result"
    order = F.struct(F.col("turn").isNull().alias("late"), "turn", "place", F.coalesce("name", F.lit("")).alias("name"), F.sha2(F.coalesce("arguments", F.lit("")), 256).alias("arguments"), F.col("after").alias("after"))
    named, key = events.where(keyed).withColumn("order", order), ["conv", "call_id"]
    counted = named.groupBy(*key).agg(
        F.min(F.when(call, F.col("order"))).alias("call"), F.min(F.when(result, F.col("turn"))).alias("result_turn"),
        F.max(result).alias("result"), F.count(F.lit(1)).alias("n"),
    )
    links = cut(counted)
    total = links.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = links.where(F.col("n") * HOT_KEYS > total).select(*key)
    levels = _levels(links.where("call is not null").select(*key, "call.after"))
    links = links.join(levels.withColumn("settled", F.lit(True)).hint("shuffle_hash"), key, "left").select(*key, "call", "result", "result_turn", "level", "settled")
    joined = attach(named, links.hint("shuffle_hash"), key, hot)
    none = {c: F.lit(None).cast(joined.schema[c].dataType) for c in ("order", "call", "result", "result_turn", "level", "settled")}
    joined = joined.unionByName(events.where(~F.coalesce(keyed, F.lit(False))).withColumns(none))
    cyclic = F.coalesce("settled", F.lit(False)) & F.col("level").isNull()
    depth = F.when(~cyclic, 2 * F.coalesce("level", F.lit(0)))
    status = (
        F.when(call & (F.col("order") != F.col("call")), "duplicate").when(call & cyclic, "cyclic")
        .when(call, F.when(F.col("result"), "answered").otherwise("open"))
        .when(result, F.when(F.col("call").isNotNull(), "linked").otherwise("orphan")).otherwise("message")
    )
    parsed = F.try_parse_json(F.col("arguments"))
    tool_call = F.to_json(F.struct(F.coalesce(parsed, F.to_variant_object(F.struct(F.col("arguments").alias("raw")))).alias("arguments"), F.col("call_id").alias("id"), "name"))
    said = F.to_json(F.struct("content", "role", F.when(result, F.col("call_id")).alias("tool_call_id")))
    return joined.select(
        "row", "conv", "turn", "role", "kind", "call_id", F.when(call, F.col("result_turn")).when(result, F.col("call.turn")).alias("linked_turn"),
        F.when(call, depth).when(result, depth + 1).otherwise(0).cast("int").alias("level"), status.alias("status"),
        F.when(call, valid_arguments(F.col("name"), F.col("arguments"), schemas)).alias("valid"), F.when(call, tool_call).otherwise(said).alias("json"),
    )


def op4_tool_calls(conversations: DataFrame) -> DataFrame:
    """Each turn of each conversation as a call of ``reply``, its result, or a message."""
    got = linked(events_of_dialogue(conversations, carry=["conv_id"]), REPLY)
    return got.select("row.conv_id", "turn", "role", "kind", "call_id", "linked_turn", "level", "status", "valid", "json")


OP4_SQL = """
WITH e AS (
  SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id,
         '{' || coalesce('"text":' || CAST(to_json(text) AS VARCHAR) || ',', '') || '"turn":' || turn || '}' AS arguments
  FROM conversations),
k AS (
  SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS call_turn, min(sha256(arguments)) FILTER (kind = 'call') AS first,
         min(turn) FILTER (kind = 'result') AS result_turn
  FROM e WHERE call_id IS NOT NULL GROUP BY ALL),
c AS (SELECT conv_id, call_id, call_turn, call_turn // 2 - row_number() OVER (PARTITION BY conv_id, call_turn % 2 ORDER BY call_turn) AS island FROM k WHERE call_turn IS NOT NULL),
l AS (SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, call_turn % 2, island ORDER BY call_turn) - 1 AS level FROM c)
SELECT e.conv_id, e.turn, e.role, e.kind, e.call_id,
  CASE e.kind WHEN 'call' THEN result_turn WHEN 'result' THEN call_turn END AS linked_turn,
  CAST(CASE e.kind WHEN 'call' THEN 2 * level WHEN 'result' THEN 2 * coalesce(level, 0) + 1 ELSE 0 END AS INTEGER) AS level,
  CASE WHEN kind = 'call' AND sha256(arguments) > first THEN 'duplicate' WHEN kind = 'call' AND result_turn IS NOT NULL THEN 'answered' WHEN kind = 'call' THEN 'open'
       WHEN kind = 'result' AND call_turn IS NOT NULL THEN 'linked' WHEN kind = 'result' THEN 'orphan' ELSE 'message' END AS status,
  CASE WHEN kind = 'call' THEN text IS NOT NULL END AS valid,
  CASE WHEN kind = 'call' THEN '{"arguments":' || arguments || ',"id":"' || e.call_id || '","name":"reply"}'
       ELSE '{' || coalesce('"content":' || CAST(to_json(text) AS VARCHAR) || ',', '') || '"role":"' || role || '"' || CASE WHEN kind = 'result' THEN ',"tool_call_id":"' || e.call_id || '"' ELSE '' END || '}' END AS json
FROM e LEFT JOIN k ON e.conv_id = k.conv_id AND e.call_id = k.call_id LEFT JOIN l ON e.conv_id = l.conv_id AND e.call_id = l.call_id
"""
