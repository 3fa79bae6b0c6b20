"""Chat formatting: tool calls linked to results, ordered, validated, canonical JSON.

DataFrame operations only.  An assistant message whose text is a JSON object with
a ``tool_calls`` array holds calls ``{id, name, arguments}``, or ``{id, function: {name,
arguments}}`` (arguments an object, or a string of JSON); a tool message whose text is an object with
``tool_call_id`` is a result.

* Results are hash-joined to calls by (conversation, identifier); of several calls
  with one identifier the first counts.
* Messages are put in a topological order of the graph whose edges are the turn
  order of all messages but results and, for each result, the edge from its call:
  a result stands right after the message with its call, results of one message in
  the order of its calls.  The position is a running count over (conversation,
  order), so one very long conversation is spread over tasks.
* Arguments are checked against ``tools`` (name, parameter, type, required).
* Every message becomes one line of canonical JSON: keys in order, no spaces, null
  written out, numbers spelled as given, non-ASCII characters as they are; calls of
  either form are written ``{arguments, id, name}``.  So that numbers keep their
  spelling, they are strings between two marks while a text is parsed.

Defined cases: null or unparsable text is plain content; so is a JSON object that
repeats a key anywhere, whose meaning is open, with the status ``ambiguous`` for
assistants and tools; texts are parsed whole up to the 128 MB that a variant holds, and
longer ones are plain content; a result without a call
is ``orphan`` and stays at its turn, a call without a result is counted open; null
conversations, turns and roles are kept, nulls first; rows that repeat
(conversation, turn) are messages of their own in a fixed order by role and text;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.prefix import running_sum
from millrace.plans.scratch import materialize

# A string and a number in JSON.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
#: Names of JSON types in schemas, as the start of what ``schema_of_variant`` says.
JSON_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def _fits(kind: Column, seen: Column) -> Column:
    known = F.lit(False)
    for name, prefix in JSON_TYPES.items():
        known = known | ((kind == name) & seen.startswith(prefix))
    return known | ((kind == "number") & seen.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")) | ~F.coalesce(kind, F.lit("any")).isin(*JSON_TYPES, "number")


@dataclass(frozen=True)
class Marks:
    """Two marks that no text holds, between which numbers stand as strings."""

    begin: str = field(default_factory=lambda: "n" + uuid.uuid4().hex)
    end: str = field(default_factory=lambda: "n" + uuid.uuid4().hex)

    def set(self, json: Column) -> Column:
        """The text with its numbers marked: strings get an empty pair of marks, which goes again."""
        both = F.regexp_replace(json, f"({STRING})|({NUMBER})", f"$1{self.begin}$2{self.end}")
        return F.regexp_replace(F.replace(both, F.lit(self.begin + self.end), F.lit("")), f"{self.begin}({NUMBER}){self.end}", f'"{self.begin}$1{self.end}"')

    def unset(self, json: Column) -> Column:
        """JSON with its numbers bare."""
        return F.regexp_replace(json, f'"{self.begin}({NUMBER}){self.end}"', "$1")

    def plain(self, value: Column) -> Column:
        """The spelling of a value that may be a number."""
        return F.regexp_replace(value, f"^{self.begin}({NUMBER}){self.end}$", "$1")

    def kind(self, value: Column) -> Column:
        """The type of a variant, as ``schema_of_variant`` says it."""
        text = F.try_variant_get(value, "$", "string")
        number = F.when(text.rlike(f"^{self.begin}-?[0-9]+{self.end}$"), "BIGINT").when(text.startswith(self.begin), "DOUBLE")
        return F.coalesce(number, F.schema_of_variant(value))


def _parsed(messages: DataFrame, marks: Marks, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    formed = F.ltrim("text").startswith("{")
    rows = rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("v", F.when(formed, F.try_parse_json(marks.set(F.col("text")))))
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    answers = F.when(F.col("role") == "tool", marks.plain(F.try_variant_get("v", "$.tool_call_id", "string")))
    # a text that is JSON, but for a key that comes twice
    twice = formed & F.col("v").isNull() & F.col("role").isin("assistant", "tool") & F.get_json_object("text", "$").isNotNull()
    return rows.withColumn("calls", calls).withColumn("answers", answers).withColumn("twice", F.coalesce(twice, F.lit(False)))


def _errors(calls: DataFrame, tools: DataFrame, marks: Marks) -> DataFrame:
    """rid, place, errors of every call that breaks its tool's schema."""
    t = tools.select(F.col("name").alias("tool"), "parameter", "type", "required")
    given = calls.select("rid", "place", "name", F.explode(F.map_entries(F.coalesce(F.try_variant_get("args", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))).alias("e"))
    given = given.select("rid", "place", "name", F.col("e.key").alias("key"), marks.kind(F.col("e.value")).alias("seen"))
    names = t.select(F.col("tool").alias("known")).distinct()
    unknown = calls.join(names, F.col("name") == F.col("known"), "left_anti").select("rid", "place", F.lit("unknown tool").alias("error"))
    shape = calls.where(~F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False))).select("rid", "place", F.lit("arguments are no object").alias("error"))
    typed = given.join(t, (F.col("name") == F.col("tool")) & (F.col("key") == F.col("parameter")), "left")
    wrong = typed.where(F.col("parameter").isNotNull() & ~_fits(F.col("type"), F.col("seen"))).select("rid", "place", F.concat(F.lit("type of "), "key").alias("error"))
    stray = typed.join(names, F.col("name") == F.col("known"), "left_semi").where("parameter is null").select("rid", "place", F.concat(F.lit("unexpected "), "key").alias("error"))
    due = calls.join(t.where("required and parameter is not null"), F.col("name") == F.col("tool")).select("rid", "place", "parameter")
    there = given.select(F.col("rid").alias("r"), F.col("place").alias("p"), "key")
    missing = due.join(there, (F.col("rid") == F.col("r")) & (F.col("place") == F.col("p")) & (F.col("parameter") == F.col("key")), "left_anti").select("rid", "place", F.concat(F.lit("missing "), "parameter").alias("error"))
    every = unknown.unionByName(shape).unionByName(wrong).unionByName(stray).unionByName(missing)
    return every.groupBy("rid", "place").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def chat_lines(messages: DataFrame, tools: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per message: conv_id, turn, role, position, n_calls, n_open, call_turn, status, errors, line."""
    marks = Marks()
    rows = materialize(_parsed(messages, marks, conv_col, turn_col, role_col, text_col), "chat")
    each = rows.where("calls is not null").select("rid", "conv_id", "turn", F.posexplode("calls").alias("place", "c"))
    inner = lambda name, kind: F.coalesce(F.try_variant_get("c", f"$.{name}", kind), F.try_variant_get("c", f"$.function.{name}", kind))
    args = inner("arguments", "variant")
    args = F.when(F.schema_of_variant(args) == "STRING", F.coalesce(F.try_parse_json(marks.set(inner("arguments", "string"))), args)).otherwise(args)
    each = each.select("rid", "conv_id", "turn", "place", marks.plain(F.try_variant_get("c", "$.id", "string")).alias("call_id"), marks.plain(inner("name", "string")).alias("name"), args.alias("args"))
    each = materialize(each, "chat-calls")

    first = each.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "rid", "place")).alias("at"))
    first = first.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("at.turn").alias("call_turn"), F.col("at.rid").alias("call_rid"), F.col("at.place").alias("call_place"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("answers") == F.col("i"))
    linked = materialize(rows.where("answers is not null").select("rid", "conv_id", "answers").join(first, same).select("rid", "call_turn", "call_rid", "call_place"), "chat-links")

    done = linked.select(F.col("call_rid").alias("r"), F.col("call_place").alias("p")).distinct()
    state = each.join(done, (F.col("rid") == F.col("r")) & (F.col("place") == F.col("p")), "left").withColumn("open", F.col("r").isNull()).drop("r", "p")
    if tools is not None:
        bad = _errors(each, tools, marks).select(F.col("rid").alias("r"), F.col("place").alias("p"), "errors")
        state = state.join(bad, (F.col("rid") == F.col("r")) & (F.col("place") == F.col("p")), "left").drop("r", "p")
    else:
        state = state.withColumn("errors", F.lit(None).cast("array<string>"))
    per = state.groupBy("rid").agg(  # bounded by the calls of one message
        F.count(F.lit(1)).alias("n_calls"),
        F.sum(F.col("open").cast("long")).alias("n_open"),
        F.array_sort(F.flatten(F.collect_list(F.coalesce("errors", F.array().cast("array<string>"))))).alias("errors"),
        F.collect_list(F.struct("place", F.struct(marks.unset(F.to_json("args")).alias("arguments"), F.col("call_id").alias("id"), "name").alias("call"))).alias("made"),
    )
    all_rows = rows.join(per, "rid", "left").join(linked, "rid", "left")

    said = F.when(F.col("calls").isNotNull() | F.col("answers").isNotNull(), marks.plain(F.try_variant_get("v", "$.content", "string"))).otherwise(F.col("text"))
    made = F.transform(F.array_sort("made"), lambda x: F.concat(F.lit('{"arguments":'), F.coalesce(x["call"]["arguments"], F.lit("null")), F.lit(',"id":'), _quoted(x["call"]["id"]), F.lit(',"name":'), _quoted(x["call"]["name"]), F.lit("}")))
    line = F.concat(F.lit('{"content":'), _quoted(said), F.lit(',"role":'), _quoted(F.col("role")))
    line = F.when(F.col("calls").isNotNull(), F.concat(line, F.lit(',"tool_calls":['), F.array_join(F.coalesce(made, F.array().cast("array<string>")), ","), F.lit("]}"))).when(
        F.col("answers").isNotNull(), F.concat(line, F.lit(',"tool_call_id":'), _quoted(F.col("answers")), F.lit("}"))
    ).otherwise(F.concat(line, F.lit("}")))

    status = F.when(F.col("call_rid").isNotNull(), "linked").when(F.col("answers").isNotNull(), "orphan").when(F.size("errors") > 0, "invalid").when(F.col("calls").isNotNull(), "call").when(F.col("twice"), "ambiguous").otherwise("message")
    ready = all_rows.select(
        "rid", "conv_id", "turn", "role", "text", "call_turn",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_open", F.lit(0)).alias("n_open"), status.alias("status"),
        F.array_join(F.coalesce("errors", F.array().cast("array<string>")), "; ").alias("errors"), line.alias("line"),
        F.when(F.col("call_rid").isNotNull(), F.col("call_turn")).otherwise(F.col("turn")).alias("anchor"),
        F.coalesce("call_place", F.lit(-1)).alias("after"), F.lit(1).alias("one"),
    )
    placed = running_sum(ready, "one", ["anchor", "after", "turn", "role", "text", "rid"], group_by=["conv_id"], into="position")
    return placed.select("conv_id", "turn", "role", "position", "n_calls", "n_open", "call_turn", "status", "errors", "line")


def _quoted(x: Column) -> Column:
    """A JSON string, or null: what stands in {"x":...} after the colon."""
    whole = F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)
