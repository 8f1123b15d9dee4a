"""Chat formatting with linked tool calls.

A turn may hold tool calls (``{"tool_calls": [{"id", "name", "arguments"}]}``) or one
result (role ``tool``, ``{"tool_call_id", "content"}``), as JSON in its text. Calls and
results are hash-joined by conversation and identifier; arguments are checked against
the schemas of the tools; turns are put in an order in which each result follows its
call, and every conversation is written as canonical JSON: keys sorted, no blanks,
numbers in their shortest form.

Links are made per call, so a conversation of any length spreads over tasks. Only the
last step, whose result is one text per conversation, brings its turns together; a
conversation is written in parts of ``TURNS_PER_PART`` turn numbers, and a part with
more messages than that in several pieces, cut at every ``TURNS_PER_PART``-th message of
its order, so that parts and pieces in turn give the whole conversation in order.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

#: Turn numbers of one part, and messages of one output row up to which it is not cut.
TURNS_PER_PART = 1_000

#: Types of the schema language and the Python types they stand for.
TYPES = {
    "string": str, "boolean": bool, "object": dict, "array": list, "null": type(None), "number": (int, float),
    "integer": int,
}


def canonical(value: object) -> str:
    """JSON with sorted keys, without blanks, whole floats as integers; NaN and infinities are null."""

    def plain(v: object) -> object:
        if isinstance(v, float):
            if not math.isfinite(v):
                return None
            return int(v) if v.is_integer() and abs(v) < 1 << 53 else v
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def same(a: object, b: object) -> bool:
    """Equal as JSON: true is not 1."""
    return canonical(a) == canonical(b)


#: Words of the schema language that are looked at; others are reported as not checked.
CHECKED = {
    "type", "enum", "const", "anyOf", "oneOf", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength",
    "minItems", "maxItems", "pattern", "uniqueItems", "properties", "required", "additionalProperties", "items",
    "title", "description", "default", "examples", "format", "$schema", "$id", "$comment",
}


def faults(value: object, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a schema, and which words of the schema are not checked (see ``CHECKED``)."""
    out: list[str] = []
    kind = schema.get("type")
    if kind is not None:
        kinds = kind if isinstance(kind, list) else [kind]
        fits = [
            isinstance(value, TYPES.get(k, object)) and not (isinstance(value, bool) and k in ("number", "integer"))
            or k == "integer" and isinstance(value, float) and value.is_integer()
            for k in kinds
        ]
        if not any(fits):
            return [f"{path}: not {'/'.join(map(str, kinds))}"]
    if "enum" in schema and not any(same(value, e) for e in schema["enum"]):
        out.append(f"{path}: not in enum")
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{path}: not the constant")
    for word, least, most in (("anyOf", 1, None), ("oneOf", 1, 1)):
        if word in schema:
            n = sum(not faults(value, s, path) for s in schema[word])
            if n < least or most is not None and n > most:
                out.append(f"{path}: {n} of {word} fit")
    out += [f"{path}: {word} not checked" for word in sorted(schema.keys() - CHECKED)]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{path}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{path}: above maximum")
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            out.append(f"{path}: below minimum")
        if "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            out.append(f"{path}: above maximum")
    size = len(value) if isinstance(value, (str, list)) else None
    if size is not None:
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if size < schema.get(low, 0):
            out.append(f"{path}: shorter than {low}")
        if size > schema.get(high, size):
            out.append(f"{path}: longer than {high}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{path}: does not match the pattern")
    if isinstance(value, list) and schema.get("uniqueItems") and len({canonical(v) for v in value}) < len(value):
        out.append(f"{path}: repeated items")
    if isinstance(value, dict):
        known = schema.get("properties") or {}
        out += [f"{path}.{k}: missing" for k in schema.get("required") or () if k not in value]
        for k, v in value.items():
            if k in known:
                out += faults(v, known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            out += faults(v, schema["items"], f"{path}[{i}]")
    return out


def loaded(text: str) -> object:
    """The JSON of a text, or None where there is none that can be written again: lone surrogates, nesting too deep."""
    try:
        found = json.loads(text)
        canonical(found).encode("utf-8")
    except (ValueError, RecursionError):  # an encoding error is a ValueError
        return None
    return found


def parse_turn(role: str | None, text: str | None) -> tuple[dict | None, dict | None]:
    """The object of a turn's text, as one with calls or as a result; a text that is no such JSON is neither."""
    if not text or "{" not in text or '"tool_call' not in text:
        return None, None
    found = loaded(text)
    if not isinstance(found, dict):
        return None, None
    if role == "tool":
        return None, found if isinstance(found.get("tool_call_id"), str) else None
    calls = found.get("tool_calls")
    return found if isinstance(calls, list) and any(isinstance(c, dict) for c in calls) else None, None


def call_body(call: dict) -> dict:
    """Where name and arguments stand: in the call, or in its ``function`` object."""
    inner = call.get("function")
    return inner if isinstance(inner, dict) and "name" not in call else call


def check_call(call: dict, schemas: dict[str, dict] | None) -> tuple[str | None, str, str, str]:
    """(id, name, canonical arguments, faults joined by '; ') of a call."""
    body = call_body(call)
    arguments = body.get("arguments")
    wrong: list[str] = []
    if isinstance(arguments, str):
        found = loaded(arguments)
        if found is None and arguments.strip() != "null":
            wrong.append("$: not JSON")
        else:
            arguments = found
    name = body.get("name") if isinstance(body.get("name"), str) else ""
    if schemas is not None and not wrong:
        wrong += faults(arguments, schemas[name]) if name in schemas else ["unknown tool"]
    identifier = call.get("id") if isinstance(call.get("id"), str) else None
    return identifier, name, canonical(arguments), "; ".join(wrong)


def _object(fields: dict[str, str]) -> str:
    return "{" + ",".join(f"{canonical(k)}:{fields[k]}" for k in sorted(fields)) + "}"


def message_json(role: str, text: str, calling: dict | None, checked: list[tuple], result: dict | None) -> str:
    """Canonical message: content and role, what it calls or answers, and all further fields of its text."""
    if result is not None:
        return canonical({"content": None, **result, "role": role})
    if calling is not None:
        made, done = [], iter(checked)
        for c in calling["tool_calls"]:
            if isinstance(c, dict):
                body = call_body(c)
                inner = {k: canonical(v) for k, v in {"name": "", **body}.items()} | {"arguments": next(done)[2]}
                outer = {"id": canonical(None)} | {k: canonical(v) for k, v in c.items()}
                made.append(_object(outer | ({"function": _object(inner)} if body is not c else inner)))
            else:
                made.append(canonical(c))
        fields = {k: canonical(v) for k, v in calling.items()}
        return _object(fields | {"role": canonical(role), "tool_calls": f"[{','.join(made)}]"})
    return canonical({"content": text, "role": role})


def _parsed(turns: DataFrame, schemas: dict[str, dict] | None) -> DataFrame:
    """The turns with their calls, their result's identifier and their message."""
    call = "struct<id:string,name:string,arguments:string,faults:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.string()) for n in ("id", "name", "arguments", "faults")]))
        for batch in batches:
            calls, answers, messages = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                calling, result = parse_turn(role, text)
                checked = [check_call(c, schemas) for c in calling["tool_calls"] if isinstance(c, dict)] if calling else []
                calls.append([dict(zip(("id", "name", "arguments", "faults"), c)) for c in checked])
                answers.append(result["tool_call_id"] if result else None)
                messages.append(message_json(role, text, calling, checked, result))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(calls, kind), pa.array(answers, pa.string()), pa.array(messages, pa.string())],
                names=[*batch.schema.names, "calls", "answers", "message"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema)
    return turns.mapInArrow(run, f"{fields}, calls array<{call}>, answers string, message string")


def _turns(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct messages under fixed names; null texts are empty, null roles ``user``."""
    return df.select(
        F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull()).distinct()


def link_tool_calls(
    df: DataFrame, schemas: dict[str, dict] | None = None, conversation: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, call_id, name, arguments, faults, call_turn, result_turn, status) of every call and every lone result.

    ``status`` is ``linked``, ``no result``, ``no call`` (a result of an unknown call),
    or ``repeated`` (a further call or result with an identifier that was used before in
    the conversation; the first of each, by turn, is the one that is linked). Calls
    without an identifier are never linked. Equal rows count once; rows with a null
    conversation are left out; an empty table gives an empty result.
    """
    return _links(_parsed(_turns(df, conversation, turn, role, text), schemas))


def _links(parsed: DataFrame) -> DataFrame:
    calls = parsed.select("conv_id", "turn", F.posexplode("calls").alias("place", "call")).select(
        "conv_id", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"),
        F.col("call.arguments").alias("arguments"), F.col("call.faults").alias("faults"),
        F.col("turn").alias("call_turn"), "place",
    )
    results = parsed.where("answers IS NOT NULL").select(
        "conv_id", F.col("answers").alias("call_id"), F.col("turn").alias("result_turn"), "message"
    )
    keys = ["conv_id", "call_id"]
    first_call = calls.where("call_id IS NOT NULL").groupBy(*keys).agg(
        F.min(F.struct("call_turn", "place")).alias("first"))
    first_result = results.groupBy(*keys).agg(F.min(F.struct("result_turn", "message")).alias("answer"))
    known = calls.join(first_call, keys, "left").join(first_result, keys, "left")
    is_first = F.col("call_id").isNull() | (F.struct("call_turn", "place") == F.col("first"))
    linked = known.select(
        *keys, "name", "arguments", "faults", "call_turn",
        F.when(is_first, F.col("answer.result_turn")).alias("result_turn"),
        F.when(~is_first, "repeated").when(F.col("answer").isNull(), "no result").otherwise("linked").alias("status"),
    )
    lone = results.join(first_call, keys, "left").join(first_result, keys, "left").where(
        F.col("first").isNull() | (F.struct("result_turn", "message") != F.col("answer"))
    )
    text_ = F.lit(None).cast("string")
    return linked.unionByName(lone.select(
        *keys, text_.alias("name"), text_.alias("arguments"), text_.alias("faults"),
        F.lit(None).cast(parsed.schema["turn"].dataType).alias("call_turn"), "result_turn",
        F.when(F.col("first").isNull(), "no call").otherwise("repeated").alias("status"),
    ))


def _pieces(placed: DataFrame) -> DataFrame:
    """The messages with their piece: their rank in the part's order over TURNS_PER_PART, ranked without one task per part."""
    part, order = ["conv_id", "part"], ["at", "moved", "turn", "role", "text"]
    long_ = settle(placed.groupBy(*part).agg(F.count("*").alias("n")).where(F.col("n") > TURNS_PER_PART).drop("n"), "long")
    zero = F.lit(0).cast("long")
    if long_.isEmpty():
        return placed.withColumn("piece", zero)
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = settle(
        placed.join(long_, part, "left_semi").repartitionByRange(parts, *part, *order)
        .withColumn("range", F.spark_partition_id()), "ranges",
    )
    counts = ranges.groupBy(*part, "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*part).orderBy("range")) - F.col("n")
    within = F.row_number().over(Window.partitionBy(*part, "range").orderBy(*order)) - 1
    ranked = ranges.withColumn("within", within).join(
        counts.select(*part, "range", before.alias("before")), [*part, "range"]
    ).withColumn("piece", F.floor((F.col("before") + F.col("within")) / TURNS_PER_PART).cast("long"))
    short = placed.join(long_, part, "left_anti").withColumn("piece", zero)
    return short.unionByName(ranked.select(*short.columns))


def format_conversations(
    df: DataFrame, schemas: dict[str, dict] | None = None, conversation: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, part, piece, n_turns, n_calls, n_linked, n_faulty, json) of every conversation.

    Turns keep their order, but a result that does not stand behind its call is moved there
    (the order is topological: a call before its result, else by turn). ``json`` is the
    canonical array of messages with the keys content, role, tool_call_id and
    tool_calls and what else the turn's object holds, absent ones left out; ``n_calls``, ``n_linked`` and ``n_faulty`` count
    the conversation's calls, those with a result, and those whose arguments break
    their schema. Null texts are empty, null roles are ``user``; null turns come first;
    equal turns are ordered by role and text; equal rows count once. Rows with a null
    conversation are left out, other columns ignored; an empty table gives an empty
    result. Parts and pieces are numbered from 0 (see the module's text).
    """
    parsed = _parsed(_turns(df, conversation, turn, role, text), schemas)
    links = _links(parsed)
    early = F.col("result_turn").isNull() | (F.col("result_turn") <= F.col("call_turn"))
    late = links.where((F.col("status") == "linked") & early).select(
        F.col("conv_id").alias("late_conv"), F.col("call_id").alias("late_id"), F.col("result_turn").alias("late_turn"),
        "call_turn",
    ).distinct()
    counted = links.where("call_turn IS NOT NULL").groupBy("conv_id").agg(
        F.count("*").alias("n_calls"), F.sum((F.col("status") == "linked").cast("long")).alias("n_linked"),
        F.sum((F.col("faults") != "").cast("long")).alias("n_faulty"),
    )
    same = (F.col("conv_id") == F.col("late_conv")) & (F.col("answers") == F.col("late_id"))
    placed = parsed.join(late, same & F.col("turn").eqNullSafe(F.col("late_turn")), "left").select(
        "conv_id", F.coalesce("call_turn", "turn").alias("at"), F.col("late_conv").isNotNull().alias("moved"), "turn",
        "role", "text", "message",
    ).withColumn("part", F.floor(F.coalesce("at", F.lit(0)) / TURNS_PER_PART).cast("long"))
    dealt = _pieces(placed)
    order = F.struct("at", "moved", "turn", "role", "text", "message")
    written = dealt.groupBy("conv_id", "part", "piece").agg(
        F.count("*").alias("n_turns"), F.sort_array(F.collect_list(order)).alias("turns")
    )
    none = F.lit(0).cast("long")
    return written.join(counted, "conv_id", "left").select(
        "conv_id", "part", "piece", "n_turns",
        *[F.coalesce(c, none).alias(c) for c in ("n_calls", "n_linked", "n_faulty")],
        F.concat(F.lit("["), F.array_join("turns.message", ","), F.lit("]")).alias("json"),
    )
