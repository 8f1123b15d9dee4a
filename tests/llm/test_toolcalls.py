"""Tool calls: linking, order, schemas and canonical text."""

import json

import pytest

from tabloom.llm import toolcalls
from tabloom.llm.toolcalls import canonical, faults

SCHEMAS = {"add": {
    "type": "object", "properties": {"x": {"type": "integer", "minimum": 0}, "y": {"type": "number"}},
    "required": ["x", "y"], "additionalProperties": False,
}}
KIND = "conv_id long, turn long, role string, text string"


def calls(*made):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), m)) for m in made]})


def result(identifier, content):
    return json.dumps({"tool_call_id": identifier, "content": content})


ROWS = [
    (1, 0, "user", "hi \"you\"\n"), (1, 0, "user", "hi \"you\"\n"),
    (1, 1, "assistant", calls(("a", "add", {"y": 2.0, "x": 1}), ("b", "add", '{"x":"no"}'))),
    (1, 2, "tool", result("b", {"z": 1, "a": [1.5]})), (1, 3, "tool", result("c", 5)),
    (2, 0, "tool", result("a", "early")), (2, 1, "assistant", calls(("a", "other", {}))),
    (2, 2, "tool", result("a", "late")), (2, 3, "assistant", calls(("a", "add", {"x": 1, "y": 1}), (None, "add", None))),
    (None, 0, "user", "x"), (3, None, None, None), (4, 0, "assistant", '{"tool_calls": broken'),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(ROWS, KIND).selectExpr("*", "1 AS calls", "2 AS message", "3 AS part")


def test_links(turns):
    rows = {(r.conv_id, r.call_id, r.call_turn, r.result_turn, r.status) for r in toolcalls.link_tool_calls(turns, SCHEMAS).collect()}
    assert rows == {
        (1, "a", 1, None, "no result"), (1, "b", 1, 2, "linked"), (1, "c", None, 3, "no call"),
        (2, "a", 1, 0, "linked"), (2, "a", None, 2, "repeated"), (2, "a", 3, None, "repeated"),
        (2, None, 3, None, "no result"),
    }
    wrong = {(r.conv_id, r.call_id, r.call_turn): r.faults for r in toolcalls.link_tool_calls(turns, SCHEMAS).collect()}
    assert wrong[1, "a", 1] == "" and wrong[1, "b", 1] == "$.y: missing; $.x: not integer"
    assert wrong[2, "a", 1] == "unknown tool"


def test_conversations(turns):
    rows = {r.conv_id: r for r in toolcalls.format_conversations(turns, SCHEMAS).collect()}
    assert rows.keys() == {1, 2, 3, 4}
    assert (rows[1].n_turns, rows[1].n_calls, rows[1].n_linked, rows[1].n_faulty) == (4, 2, 1, 1)
    messages = json.loads(rows[1].json)
    assert messages[0] == {"content": "hi \"you\"\n", "role": "user"}
    assert [c["id"] for c in messages[1]["tool_calls"]] == ["a", "b"]
    assert '"arguments":{"x":1,"y":2}' in rows[1].json and '{"content":{"a":[1.5],"z":1},"role":"tool"' in rows[1].json
    order = [m.get("content", "call") for m in json.loads(rows[2].json)]
    assert order == ["call", "early", "late", "call"]
    assert rows[3].json == '[{"content":"","role":"user"}]'
    assert toolcalls.format_conversations(turns.where("false")).count() == 0


def test_long_conversations_are_cut(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "TURNS_PER_PART", 10)
    rows = [(1, k, "user", f"t{k}") for k in range(35)] + [(2, 0, "user", f"s{k}") for k in range(45)]
    out = toolcalls.format_conversations(spark.createDataFrame(rows, KIND)).collect()
    first = sorted((r.part, r.json) for r in out if r.conv_id == 1)
    assert [m["content"] for _, j in first for m in json.loads(j)] == [f"t{k}" for k in range(35)]
    second = [r for r in out if r.conv_id == 2]
    assert len(second) > 1 and sorted(m["content"] for r in second for m in json.loads(r.json)) == sorted(f"s{k}" for k in range(45))


def test_pieces_follow_the_order(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "TURNS_PER_PART", 10)
    rows = [(1, turn, "user", f"{k:03}") for k in range(60) for turn in (None, 0)]
    rows += [(1, None, "tool", result("a", "answer")), (1, 0, "user", calls(("a", "add", {})))]
    out = toolcalls.format_conversations(spark.createDataFrame(rows, KIND)).collect()
    pieces = sorted(out, key=lambda r: (r.part, r.piece))
    assert [r.piece for r in pieces] == list(range(13)) and {r.n_turns for r in pieces[:-1]} == {10}
    messages = [m for r in pieces for m in json.loads(r.json)]
    plain = [f"{k:03}" for k in range(60)]
    assert [m.get("content", "call") for m in messages] == [*plain, *plain, "call", "answer"]


def test_call_turns_lose_nothing(spark):
    text = {"content": "let me see", "tool_calls": [{"id": "a", "name": "add", "arguments": "{}", "type": "f"}, 7], "n": 1.0}
    answer = {"tool_call_id": "a", "content": 3, "ok": True}
    rows = [(1, 0, "assistant", json.dumps(text)), (1, 1, "tool", json.dumps(answer))]
    out = toolcalls.format_conversations(spark.createDataFrame(rows, KIND)).first()
    assert out.json == (
        '[{"content":"let me see","n":1,"role":"assistant","tool_calls":[{"arguments":{},"id":"a","name":"add","type":"f"},7]},'
        '{"content":3,"ok":true,"role":"tool","tool_call_id":"a"}]'
    )
    assert (out.n_calls, out.n_linked) == (1, 1)


@pytest.mark.parametrize("value, text", [
    ({"b": 1.0, "a": [True, None, "é"]}, '{"a":[true,null,"é"],"b":1}'), (float("nan"), "null"), (1e300, "1e+300"), (0.5, "0.5"),
])
def test_canonical(value, text):
    assert canonical(value) == text


@pytest.mark.parametrize("value, schema, n", [
    (1, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), (1.0, {"type": "integer"}, 0), ("a", {"enum": ["a"]}, 0),
    ("b", {"enum": ["a"]}, 1), ([1, "x"], {"type": "array", "items": {"type": "number"}}, 1), (None, {"type": ["null", "string"]}, 0),
    ({"x": -1, "q": 0}, SCHEMAS["add"], 3),
])
def test_schemas(value, schema, n):
    assert len(faults(value, schema)) == n


def test_json_that_cannot_be_written_again_stays_text():
    deep = '{"tool_calls":[{"a":' + "[" * 5_000 + "]" * 5_000 + "}]}"
    for text in (deep, '{"tool_calls":[{"id":"\\ud800"}]}', '{"tool_calls":'):
        assert toolcalls.parse_turn("assistant", text) == (None, None)
    assert toolcalls.parse_turn("tool", '{"tool_call_id":"\\udfff"}') == (None, None)
    call = {"id": "c", "name": "f", "arguments": "[" * 5_000 + "]" * 5_000}
    assert toolcalls.check_call(call, None)[3] == "$: not JSON"


def test_odd_json_runs_through_spark(spark):
    long = "x" * 200_000
    rows = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"\\ud800","name":"f"}]}'), (1, 1, "tool", '{"tool_call_id":"\\ud800"}'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"a","type":"function","function":{"name":"f","arguments":"{\\"q\\":1}"}}]}'),
        (1, 3, "tool", '{"tool_call_id":"a"}'), (2, 0, "user", long),
    ]
    got = {r.conv_id: r for r in toolcalls.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].n_calls, got[1].n_linked) == (1, 1) and '"function":{"arguments":{"q":1},"name":"f"}' in got[1].json
    assert long in got[2].json


@pytest.mark.parametrize("value, schema, n", [
    (True, {"enum": [1]}, 1), (1.0, {"enum": [1]}, 0), ("b", {"const": "a"}, 1), (5, {"exclusiveMaximum": 5, "exclusiveMinimum": 4}, 1),
    ("abc", {"minLength": 4}, 1), ("abc", {"maxLength": 2}, 1), ([1], {"minItems": 2}, 1), ([1, 1], {"uniqueItems": True}, 1),
    ([1, True], {"uniqueItems": True}, 0), ("ax", {"pattern": "^a.$"}, 0), ("bx", {"pattern": "^a"}, 1),
    (1, {"anyOf": [{"type": "string"}, {"minimum": 2}]}, 1), (3, {"oneOf": [{"type": "integer"}, {"minimum": 2}]}, 1),
    ({}, {"$ref": "#/x", "title": "t"}, 1),
])
def test_more_words_of_a_schema(value, schema, n):
    assert len(toolcalls.faults(value, schema)) == n
