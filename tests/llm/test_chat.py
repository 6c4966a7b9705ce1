"""Tool-call linking, order, validation and canonical JSON."""

from __future__ import annotations

import json
import random
import re

import pytest

from plumbline.llm.chat import Check, canonical, conforms, format_chats, parse_message

TOOLS = '<tools>[{"name":"f","parameters":{"type":"object","required":["x"],"properties":{"x":{"type":"integer","minimum":1}},"additionalProperties":false}}]</tools>'


def call(i: str, name: str = "f", arguments: str = '{"x": 1}') -> str:
    return f'<tool_call>{{"id": "{i}", "name": "{name}", "arguments": {arguments}}}</tool_call>'


def result(i: str, text: str = "ok") -> str:
    return f'<tool_result id="{i}">{text}</tool_result>'


def rows(spark, data, extra=""):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    return sorted(format_chats(df).collect(), key=lambda r: (r.conv_id is None, r.conv_id, r.place or 0, r.depth, r.turn or 0))


def test_links_order_and_validation(spark):
    got = rows(
        spark,
        [
            (1, 0, "system", TOOLS),
            (1, 1, "tool", result("a")),  # before its call
            (1, 2, "assistant", "Hm. " + call("a") + call("b", arguments='{"x": 0}')),
            (1, 3, "tool", '{"tool_call_id": "b", "content": {"v": 1}}'),
            (1, 4, "assistant", call("c", "g") + call("d", arguments="[1]") + "<tool_call>{bad</tool_call>"),
            (1, 5, "tool", result("zz")),
            (2, 0, "user", "plain é"),
        ],
    )
    one = [r for r in got if r.conv_id == 1]
    assert [r.turn for r in one] == [0, 2, 1, 3, 4, 5]
    assert [(r.place, r.depth) for r in one] == [(0, 0), (2, 0), (2, 1), (3, 0), (4, 0), (5, 0)]
    assert [(r.n_calls, r.n_results, r.n_linked, r.n_invalid) for r in one] == [(0, 0, 0, 0), (2, 0, 2, 1), (0, 1, 1, 0), (0, 1, 1, 0), (2, 0, 0, 3), (0, 1, 0, 0)]
    calls = json.loads(one[1].message)["tool_calls"]
    assert [c.get("problem") for c in calls] == [None, "arguments don't meet the schema"]
    assert json.loads(one[3].message)["tool_results"] == [{"id": "b", "content": '{"v":1}', "linked": True}]
    assert "<tool_call>{bad</tool_call>" in json.loads(one[4].message)["content"]
    assert got[-1].message == '{"content":"plain é","role":"user"}'


def test_chain_and_cycle(spark):
    chain = [(1, 0, "tool", result("b")), (1, 1, "tool", result("a") + call("b")), (1, 5, "assistant", call("a"))]
    got = rows(spark, chain)
    assert [r.turn for r in got] == [5, 1, 0]
    cycle = [(1, 0, "tool", result("b") + call("a")), (1, 1, "tool", result("a") + call("b"))]
    got = rows(spark, cycle)
    assert sorted(r.turn for r in got) == [0, 1] and all(r.n_linked == 2 for r in got)


def test_cycle_beside_other_links(spark):
    cycle = [(1, 0, "tool", result("b") + call("a")), (1, 1, "tool", result("a") + call("b")), (1, 2, "tool", result("c")), (1, 3, "assistant", call("c") + result("d")), (1, 4, "tool", call("d") + result("a"))]
    others = [x for k in range(2, 12) for x in ((k, 0, "tool", result("x")), (k, 1, "assistant", call("x")))]
    for data in (cycle, cycle + others[:2], cycle + others):
        got = rows(spark, data)
        assert [(r.turn, r.place, r.depth) for r in got if r.conv_id == 1] == [(0, 0, 0), (1, 1, 0), (4, 4, 0), (3, 4, 1), (2, 4, 2)]
        assert all((r.place, r.depth) == (1, 1 - r.turn) for r in got if r.conv_id != 1)


def test_repeats_nulls_empty(spark):
    got = rows(spark, [(1, 0, "assistant", call("a")), (1, 0, "assistant", call("a")), (1, 1, "tool", result("a")), (1, 1, "tool", result("a")), (None, None, None, None), (3, 0, "user", "")])
    assert len(got) == 6
    assert sum(r.n_linked for r in got if r.turn == 0) == 1 and all(r.n_linked == 1 for r in got if r.turn == 1 and r.conv_id == 1)
    assert got[-1].message == '{"content":"","role":null}'
    assert rows(spark, []) == []


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "clash", 5)], "conv_id long, turn long, role string, text string, message string, place long")
    assert format_chats(df).collect()[0].message == '{"content":"x","role":"user"}'


def test_schema_and_json():
    assert canonical({"b": 1, "a": [1.5, "é"]}) == '{"a":[1.5,"é"],"b":1}'
    assert conforms({"x": [1, 2]}, {"type": "object", "properties": {"x": {"type": "array", "items": {"enum": [1, 2]}}}})
    assert not conforms(True, {"type": "integer"}) and conforms(None, {"type": ["null", "string"]})
    assert not conforms("abc", {"maxLength": 2}) and not conforms({"y": 1}, {"additionalProperties": False})
    assert parse_message("tool", "{nonsense") == {"content": "{nonsense", "calls": [], "results": [], "tools": [], "broken": 0}


DEEP = "[" * 300 + "]" * 300


@pytest.mark.parametrize(
    ("schema", "arguments", "good", "skipped"),
    [
        ('{"properties":{"x":{"type":"integer"}}}', '{"x":' + "9" * 400 + "}", True, set()),
        ('{"properties":{"x":{"minLength":"3"}}}', '{"x":"a"}', True, {"minLength"}),
        ('{"properties":{"x":{"minItems":null}}}', '{"x":[]}', True, {"minItems"}),
        ('{"properties":{"x":{"minimum":"0"}}}', '{"x":-1}', True, {"minimum"}),
        ('{"required":[{"a":1},"b"]}', '{"a":1}', False, set()),
        ('{"type":{"a":1}}', "{}", True, {"type"}),
        ('{"properties":{"x":{"pattern":"^a(?=b)"}}}', '{"x":"ab"}', True, {"pattern"}),
        ('{"properties":{"x":{"pattern":"^(a+)+$"}}}', '{"x":"' + "a" * 5000 + 'b"}', False, set()),
        ('{"properties":{"x":{"$ref":"#/$defs/n"}},"$defs":{"n":{"type":"number","exclusiveMinimum":0}}}', '{"x":0}', False, set()),
        ('{"$ref":"#"}', "{}", True, {"$ref"}),
        ('{"properties":{"x":{"anyOf":[{"type":"string"},{"const":1}]}}}', '{"x":1.0}', True, set()),
        ('{"properties":{"x":{"oneOf":[{"type":"integer"},{"minimum":0}]}}}', '{"x":1}', False, set()),
        ('{"allOf":[{"required":["x"]},{"not":{"required":["y"]}}]}', '{"x":1,"y":1}', False, set()),
        ('{"properties":{"x":{"uniqueItems":true,"multipleOf":1}}}', '{"x":[1,1.0]}', False, set()),
        ('{"properties":{"x":{"dependentRequired":{}}}}', '{"x":1}', True, {"dependentRequired"}),
        ("5", "{}", True, {"schema"}),
        ('{"properties":{"x":{"items":{"items":{"items":{"type":"string"}}}}}}', '{"x":[[[1]]]}', False, set()),
    ],
)
def test_schemas(schema, arguments, good, skipped):
    check = Check(json.loads(schema))
    assert (check.conforms(json.loads(arguments)), check.skipped) == (good, skipped)


def test_deep_schema_is_checked_or_said_to_be_skipped():
    schema, value = {"type": "string"}, 1
    for _ in range(100):
        schema, value = {"items": schema}, [value]
    assert not conforms(value, schema)
    for _ in range(5000):
        schema, value = {"items": schema}, [value]
    check = Check(schema)
    assert check.conforms(value) and check.skipped == {"nested too deeply"}


def test_hostile_messages_stay_rows(spark):
    tools = '<tools>[{"name":"f","parameters":{"properties":{"x":{"minimum":"0","pattern":"("}},"required":[{}]}},{"name":"\\ud800"},7]</tools>'
    hostile = [
        (1, 0, "system", tools),
        (1, 1, "assistant", '<tool_call>{"id": 7, "name": "f", "arguments": {"x": %s}}</tool_call>' % ("9" * 400)),
        (1, 2, "tool", '{"tool_call_id": 7, "content": "\\ud800"}'),
        (1, 3, "tool", result("7")),
        (1, 4, "assistant", '<tool_call>{"id": "\\udc00", "name": "f", "arguments": {"\\ud83d": "\\ude00"}}</tool_call>'),
        (1, 5, "assistant", '<tool_call>{"id": {"a": 1}, "name": "f", "arguments": {}}</tool_call><tool_call>{"id": "n", "arguments": 1e999}</tool_call>'),
        (1, 6, "assistant", '<tool_call>{"id": "d", "name": "f", "arguments": {"x": %s}}</tool_call>' % DEEP),
        (1, 7, "assistant", "<tool_call>" + "[" * 200_000 + "</tool_call>"),
        (1, 8, "tool", '{"tool_call_id": "\\udc00", "content": [1, "\\ud800"]}'),
        (1, 9, "user", "x" * 300_000),
    ]
    got = rows(spark, hostile)
    assert [r.turn for r in got] == list(range(10))
    read = [json.loads(r.message) for r in got]
    assert read[1]["tool_calls"][0]["id"] == 7 and read[1]["tool_calls"][0]["answered"] and read[1]["tool_calls"][0]["unchecked"] == "minimum"
    assert read[2]["tool_results"] == [{"id": 7, "content": "\\ud800", "linked": True}] and read[3]["tool_results"][0]["linked"]
    assert read[4]["tool_calls"][0]["id"] == "\udc00" and read[4]["tool_calls"][0]["answered"] and read[8]["tool_results"][0]["linked"]
    assert read[5]["tool_calls"][0]["id"] == {"a": 1} and read[5]["tool_calls"][0]["problem"] == "no id or name" and got[5].n_invalid == 2
    assert read[6]["tool_calls"][0]["arguments"]["x"] == json.loads(DEEP) and got[7].n_invalid == 1
    assert len(read[9]["content"]) == 300_000


def brute(messages):
    """(row, place, depth, linked parts) by following every need of one conversation after the other."""
    out = {}
    for conv in {m[0] for m in messages}:
        mine = [(i, m) for i, m in enumerate(messages) if m[0] == conv]
        calls, need, linked = {}, {}, {i: 0 for i, _ in mine}
        for i, m in sorted(mine, key=lambda x: (x[1][1], x[0])):
            for c in re.findall(r'<tool_call>\{"id": "(\w+)"', m[3]):
                calls.setdefault(c, i)
        answered = set()
        for i, m in mine:
            for c in re.findall(r'<tool_result id="(\w+)"', m[3]):
                if c in calls:
                    linked[i] += 1
                    answered.add(c)
                    if calls[c] != i:
                        need.setdefault(i, set()).add(calls[c])
        for c in answered:
            linked[calls[c]] += 1

        def reach(a, need=need):
            seen, todo = set(), list(need.get(a, ()))
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += need.get(x, ())
            return seen

        ahead = {i: reach(i) for i, _ in mine}
        on = {i for i, _ in mine if i in ahead[i]}
        knot = {i for i, _ in mine if i in on or ahead[i] & on and any(i in ahead[j] for j in on)}
        turn = {i: m[1] for i, m in mine}
        place = {i: (turn[i], 0) for i, _ in mine}
        moved = True
        while moved:
            moved = False
            for i, _ in mine:
                for b in need.get(i, ()) if i not in knot else ():
                    p, d = place[b]
                    if (p, d) > place[i] or (p, d) == place[i] and (d > 0 or b > i):
                        place[i], moved = (p, d + 1), True
        out |= {i: (*place[i], linked[i]) for i, _ in mine}
    return out


def test_against_brute_force(spark):
    rng, messages = random.Random(3), []
    for conv in range(40):
        ids = [f"i{k}" for k in range(rng.randint(1, 6))]
        for turn in range(rng.randint(1, 9)):
            messages.append((conv, turn, "tool", "".join((call if rng.random() < 0.5 else result)(rng.choice(ids)) for _ in range(rng.randint(0, 3)))))
    want = brute(messages)
    got = rows(spark, messages)
    assert sorted((r.conv_id, r.turn, r.place, r.depth, r.n_linked) for r in got) == sorted((*messages[i][:2], *x) for i, x in want.items())


def test_long_reversed_chain_takes_few_tables(spark, monkeypatch):
    from plumbline.llm import chat

    n, tables = 5000, []
    monkeypatch.setattr(chat, "cut", lambda df, real=chat.cut: tables.append(1) or real(df))
    # every message answers the call of the next one
    data = [(1, k, "tool", result(f"c{k + 1}") + call(f"c{k}")) for k in range(n)] + [(2, 0, "user", "hello")]
    got = [r for r in rows(spark, data) if r.conv_id == 1]
    assert len(tables) < 20
    assert [r.turn for r in got] == list(range(n - 1, -1, -1))
    assert {(r.place, r.depth) for r in got} == {(n - 1, d) for d in range(n)}


def test_large_conversations_are_settled_alike(spark, monkeypatch):
    from plumbline.llm import chat

    rng = random.Random(4)
    data = []
    for conv in range(12):
        ids = [f"i{k}" for k in range(8)]
        for _ in range(14):
            parts = [rng.choice([call, result])(rng.choice(ids)) for _ in range(rng.randint(0, 3))]
            data.append((conv, rng.randint(0, 5), rng.choice(["tool", "assistant", None]), "".join(parts)))
    one_call = [tuple(r) for r in rows(spark, data)]
    monkeypatch.setattr(chat, "SETTLE", 0)
    in_rounds = [tuple(r) for r in rows(spark, data)]
    assert sorted(map(str, one_call)) == sorted(map(str, in_rounds))


def test_order_of_rows_changes_nothing(spark):
    rng = random.Random(9)
    data = []
    for conv in range(6):
        for turn in range(4):  # several messages of a turn share ids
            data += [(conv, turn, rng.choice(["tool", "assistant"]), f"t{k} " + rng.choice([call, result])(rng.choice("ab"))) for k in range(4)]
    first = sorted(map(str, rows(spark, data)))
    for _ in range(2):
        rng.shuffle(data)
        assert sorted(map(str, rows(spark, data))) == first
