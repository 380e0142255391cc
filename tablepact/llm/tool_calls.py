"""Tool calls and results of conversations: linked, ordered, validated, serialised.

Calls meet their results in a hash join on (conversation, identifier). Order is topological: a
result stands after its call, a call after the calls whose results it uses. Where every
dependency points back in turns, turns are such an order already, and only conversations with
one that points ahead are ordered by peeling: each round places what waits for nothing, and
what never gets free is a cycle. Arguments are checked against the tool's schema and written
as canonical JSON (sorted keys, no blanks), one row at a time, so a conversation of any length
is never held in one place.

Defined results: a call without a result is ``open``, a result without a call is ``orphan``, a
row with neither kind or without an identifier is a plain ``message``; of several calls (or
results) with one identifier the first by turn and content is linked and the others are
``repeated``, equal rows included; arguments that are null, empty, not JSON or against the
schema (or of an unknown tool) are invalid and kept as a JSON string; null turns come first;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import stored

MESSAGES = "conv_id, turn, kind, call_id, name, arguments, content, uses"
CALL, RESULT, MESSAGE = "call", "result", "message"


# ---- arguments

def _is(kind: str, value: object) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    types = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
    return kind in types and isinstance(value, types[kind])


def conforms(value: object, schema: dict) -> bool:
    """Whether a value keeps to a schema: type, enum, bounds, lengths, items, properties, required."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(k, value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, int | float) and not isinstance(value, bool):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if isinstance(value, list):
        return "items" not in schema or all(conforms(v, schema["items"]) for v in value)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())):
            return False
        if schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(conforms(value[k], s) for k, s in known.items() if k in value)
    return True


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _finite(word: str) -> float:
    raise ValueError(word)


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[bool, object]:
    """Whether arguments are valid, and what is serialised for them."""
    try:
        value = json.loads(arguments or "", parse_constant=_finite)
    except (ValueError, RecursionError):
        return False, arguments
    return name in schemas and conforms(value, schemas[name]), value


def serialised(linked: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``linked`` with ``valid`` and ``record``: the canonical JSON of each call with its result."""
    keep = [c for c in linked.columns if c not in ("arguments", "content", "result")]
    kinds = ", ".join(f"`{c}` {linked.schema[c].dataType.simpleString()}" for c in keep)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, records = [], []
            rows = batch.select(["kind", "status", "call_id", "name", "arguments", "content", "result"]).to_pylist()
            for row in rows:
                ok, record = None, {"content": row["content"], "status": row["status"]}
                if row["call_id"] is not None and row["kind"] != MESSAGE:
                    record["id"] = row["call_id"]
                if row["kind"] == CALL:
                    ok, value = checked(row["name"], row["arguments"], schemas)
                    record |= {"arguments": value, "name": row["name"], "result": row["result"], "valid": ok}
                valid.append(ok)
                records.append(canonical(record))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(valid, pa.bool_()), pa.array(records, pa.string())],
                names=[*keep, "valid", "record"])

    return linked.mapInArrow(write, f"{kinds}, valid boolean, record string")


# ---- links

def _content(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in ("turn", "name", "arguments", "content")])


def linked(messages: DataFrame) -> DataFrame:
    """Every message with ``status``, and calls with the ``result`` linked to them."""
    rows = messages.select(*[F.col(c) for c in MESSAGES.split(", ")]).withColumn(
        "kind", F.when(F.col("kind").isin(CALL, RESULT) & F.col("call_id").isNotNull(), F.col("kind")).otherwise(MESSAGE))
    # equal rows are told apart by number; a partition holds one identifier's rows of one kind
    same = Window.partitionBy("conv_id", "call_id", "kind").orderBy("turn", "name", "arguments", "content")
    tools = rows.filter(F.col("kind") != MESSAGE).withColumn("nth", F.row_number().over(same))
    firsts = tools.filter("nth = 1")
    key = ["conv_id", "call_id"]
    calls = firsts.filter(F.col("kind") == CALL).select(*key, F.lit(True).alias("called"))
    results = firsts.filter(F.col("kind") == RESULT).select(*key, F.col("content").alias("result"), F.lit(True).alias("answered"))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"conv_id": "other_conv", "call_id": "other_call"})
        on = F.col("conv_id").eqNullSafe(F.col("other_conv")) & (F.col("call_id") == F.col("other_call"))
        return left.join(right.hint("shuffle_hash"), on, "left").drop("other_conv", "other_call")

    of_calls = meet(tools.filter(F.col("kind") == CALL), results)
    of_calls = of_calls.withColumn("status", F.when(F.col("nth") > 1, "repeated").when(F.col("answered"), "linked").otherwise("open"))
    of_calls = of_calls.withColumn("result", F.when(F.col("nth") == 1, F.col("result"))).drop("nth", "answered")
    of_results = meet(tools.filter(F.col("kind") == RESULT), calls)
    of_results = of_results.withColumn("status", F.when(F.col("nth") > 1, "repeated").when(F.col("called"), "linked").otherwise("orphan"))
    of_results = of_results.withColumn("result", F.lit(None).cast("string")).drop("nth", "called")
    plain = rows.filter(F.col("kind") == MESSAGE).withColumn("result", F.lit(None).cast("string")).withColumn("status", F.lit(MESSAGE))
    return of_calls.unionByName(of_results).unionByName(plain)


# ---- order

def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``: sorting a conversation by it puts nothing before what it needs; null in a cycle.

    Places are turns; in conversations where a dependency points ahead, the round of peeling
    comes after the largest turn.
    """
    node = F.when(F.col("status").isin("linked", "open", "orphan"), F.concat_ws(" ", "kind", "call_id"))
    named = rows.withColumn("node", node)
    uses = named.filter("status IN ('linked', 'open') AND kind = 'call'").select(
        "conv_id", "node", "turn", F.explode(F.array_distinct("uses")).alias("used")).select(
        "conv_id", "node", "turn", F.concat_ws(" ", F.lit(RESULT), "used").alias("needs"))
    answers = named.filter("kind = 'result' AND status = 'linked'").select(
        "conv_id", "node", "turn", F.concat_ws(" ", F.lit(CALL), "call_id").alias("needs"))
    targets = named.filter("node IS NOT NULL").select("conv_id", F.col("node").alias("needs"), F.col("turn").alias("needs_turn"))
    needs = uses.unionByName(answers).join(targets, ["conv_id", "needs"])  # what is not there is not waited for
    ahead = needs.filter("needs_turn >= turn").select("conv_id").distinct()
    ahead = stored(ahead, "calls-ahead")
    if ahead.isEmpty():
        return rows.withColumn("place", F.col("turn").cast("long"))

    waiting = stored(needs.join(ahead, "conv_id", "left_semi").select("conv_id", "node", "needs"), "calls-needs")
    left = stored(named.filter("node IS NOT NULL").join(ahead, "conv_id", "left_semi").select("conv_id", "node"), "calls-left")
    rounds, placed = 0, None
    while True:
        blocked = waiting.select("conv_id", "node").distinct()
        free = stored(left.join(blocked, ["conv_id", "node"], "left_anti").withColumn("round", F.lit(rounds).cast("long")), "calls-free")
        if free.isEmpty():
            break
        placed = free if placed is None else placed.unionByName(free)
        done = free.select("conv_id", F.col("node").alias("needs"))
        waiting = stored(waiting.join(done, ["conv_id", "needs"], "left_anti"), "calls-needs")
        left = stored(left.join(free, ["conv_id", "node"], "left_anti"), "calls-left")
        rounds += 1
    last = rows.join(ahead, "conv_id", "left_semi").groupBy("conv_id").agg(F.max("turn").cast("long").alias("last"))
    late = left.withColumn("round", F.lit(None).cast("long"))
    late = (late if placed is None else placed.unionByName(late)).join(last, "conv_id").select(
        "conv_id", "node", F.lit(True).alias("peeled"), (F.col("last") + 1 + F.col("round")).alias("at"))
    return (named.join(late, ["conv_id", "node"], "left")
            .withColumn("place", F.when(F.col("peeled"), F.col("at")).otherwise(F.col("turn").cast("long")))
            .select(*rows.columns, "place"))


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, kind, call_id, name, uses, status, place, valid, record per message.

    ``messages`` has the columns of ``MESSAGES``; ``uses`` lists the identifiers whose results a
    call depends on; ``schemas`` has a JSON schema by tool name.
    """
    return serialised(ordered(linked(messages)), schemas)


# ---- from plain conversations

ASK = {
    "type": "object", "required": ["lang_hint", "n_chars", "prompt"], "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 1000},
                   "n_chars": {"type": "integer", "minimum": 1}, "lang_hint": {"enum": ["ascii", "other"]}},
}


def messages_of_turns(turns: DataFrame) -> DataFrame:
    """Plain chat turns as tool traffic: what a user asks is a call of ``ask``, the assistant's
    next turn is its result, and a call uses the result of the call two turns before."""
    call_at = F.when(F.col("role") == "user", F.col("turn")).when(F.col("role") == "assistant", F.col("turn") - 1)
    ident = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    is_call = F.col("role") == "user"
    ascii_only = F.octet_length("text") == F.length("text")
    arguments = F.to_json(F.struct(
        F.when(ascii_only, "ascii").otherwise("other").alias("lang_hint"), F.length("text").alias("n_chars"), F.col("text").alias("prompt")))
    return turns.select(
        "conv_id", "turn", F.when(is_call, CALL).when(F.col("role") == "assistant", RESULT).otherwise(MESSAGE).alias("kind"),
        ident(call_at).alias("call_id"), F.when(is_call, "ask").alias("name"),
        F.when(is_call, arguments).alias("arguments"),
        F.when(~is_call | F.col("role").isNull(), F.col("text")).alias("content"),
        F.when(is_call & (F.col("turn") >= 2), F.array(ident(F.col("turn") - 2))).alias("uses"))
