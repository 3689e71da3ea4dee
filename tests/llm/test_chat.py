"""Tool-call linking against a brute-force version, with identifiers that repeat and dependencies within messages."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat

SCHEMAS = {"add": [("x", "integer", True, {"minimum": 0, "maximum": 9}), ("y", "integer", True)], "say": [("s", "string", False, {"minLength": 2, "maxLength": 4})]}
ROWS = "conv_id long, turn long, role string, text string"


def call(ident, name="add", arguments='{"x":1,"y":2}', after=()):
    return {"id": ident, "name": name, "arguments": arguments, "after": list(after)}


def say(*calls):
    return json.dumps({"tool_calls": calls})


def answer(ident, content):
    return json.dumps({"tool_call_id": ident, "content": content})


def brute(rows):
    """(conv, turn, place, level, id, result turn, in order, result) of every call, one conversation after another."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        told = [(t, k, c, json.loads(x)["tool_calls"]) for _, t, role, x in own if role == "assistant" for k, c in enumerate(json.loads(x)["tool_calls"])]
        replies = [(t, json.loads(x)["tool_call_id"], json.loads(x)["content"]) for _, t, role, x in own if role == "tool"]
        for turn, place, c, message in told:
            def depth(i, path):
                if i in path:
                    return None
                needs = [j for j, o in enumerate(message) if j != i and o["id"] in message[i]["after"]]
                deep = [depth(j, path | {i}) for j in needs]
                return None if None in deep else max(deep, default=-1) + 1

            inside = {o["id"] for j, o in enumerate(message) if j != place}
            met = all(n in inside or any(o["id"] == n and t < turn for t, _, o, _ in told) for n in c["after"])
            again = min((t for t, _, o, _ in told if o["id"] == c["id"] and t > turn), default=10**9)
            got = min(((t, x) for t, i, x in replies if i == c["id"] and turn < t <= again), default=(None, None))
            level = depth(place, frozenset())
            out.append((conv, turn, place, level, c["id"], got[0], level is not None and met, got[1]))
    return Counter(out)


def linked(spark, rows, schemas=SCHEMAS):
    return chat.link(spark.createDataFrame(rows, ROWS).repartition(3), schemas).collect()


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        for turn in range(rng.randrange(2, 10)):
            for _ in range(rng.choice([1, 1, 2])):
                if rng.random() < 0.5:
                    n = rng.choice([1, 1, 2, 3, 5])
                    calls = [call(f"call_{rng.randrange(4)}", after=[f"call_{rng.randrange(4)}" for _ in range(rng.choice([0, 0, 1, 2]))]) for _ in range(n)]
                    rows.append((conv, turn, "assistant", say(*calls)))
                else:
                    rows.append((conv, turn, "tool", answer(f"call_{rng.randrange(4)}", f"r{conv}.{turn}.{rng.random():.3f}")))
    rng.shuffle(rows)
    got = Counter((r.conv_id, r.turn, r.place, r.level, r.call_id, r.result_turn, r.in_order, json.loads(r.json)["result"]) for r in linked(spark, rows))
    assert got == brute(rows)


def test_identifiers_belong_to_their_conversation(spark):
    rows = [(c, t, "assistant", say(call("call_0"))) for c, t in ((1, 0), (2, 0), (2, 4), (3, 0))]
    rows += [(1, 1, "tool", answer("call_0", "ONE")), (2, 5, "tool", answer("call_0", "TWO")), (3, 0, "tool", answer("call_0", "early"))]
    got = {(r.conv_id, r.turn): (r.result_turn, json.loads(r.json)["result"]) for r in linked(spark, rows)}
    assert got == {(1, 0): (1, "ONE"), (2, 0): (None, None), (2, 4): (5, "TWO"), (3, 0): (None, None)}


def test_order_within_a_message(spark):
    chain = say(call("c", after=["b"]), call("a"), call("b", after=["a", "z"]), call("p", after=["q"]), call("q", after=["p"]), call("r", after=["q"]), call("s", after=["s"]))
    rows = [(1, 0, "assistant", say(call("z"))), (1, 2, "assistant", chain)]
    got = {r.call_id: (r.level, r.in_order) for r in linked(spark, rows) if r.turn == 2}
    assert got == {"c": (2, True), "a": (0, True), "b": (1, True), "p": (None, False), "q": (None, False), "r": (None, False), "s": (0, False)}


def test_arguments_are_validated_and_canonical(spark):
    rows = [
        (1, 0, "assistant", say(call("a", arguments='{"y": 2, "x":1}'), call("b", arguments='{"x": "no"}'))),
        (1, 1, "tool", answer("a", "3")),
        (1, 2, "assistant", say(call("c", "other", "not json", ["a"]), call("d", arguments='{"x":10,"y":-1}', after=["z"]), call("e", "say", '{"s":"abcde"}'), call("f", "say", '{"s":"a"}'), call("g", "say", '{"s":7}'), call("h", "say", "{}"))),
        (1, 3, "tool", answer("q", "orphan")),
    ]
    got = {r.call_id: r for r in linked(spark, rows)}
    assert got["a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"3"}' and got["a"].errors == "" and got["a"].result_turn == 1
    errors = {k: r.errors for k, r in got.items() if k != "a"}
    assert errors == {
        "b": "x: not integer; y: missing", "c": "arguments: not JSON; name: unknown tool", "d": "x: too large",
        "e": "s: too long", "f": "s: too short", "g": "s: not string", "h": "",
    }
    assert not got["b"].linked and got["c"].in_order and not got["d"].in_order and json.loads(got["c"].json)["arguments"] is None


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "x"), (2, 0, None, "x"), (3, 0, "user", None), (3, 1, "assistant", None), (4, 0, "user", 'q"\\\n\x01é'), (4, 0, "user", "twice"), (4, 0, "user", "twice"), (5, 3, "user", "late"), (6, 0, "user", "long " * 60_000)]
    df = spark.createDataFrame(rows, ROWS).withColumns({"place": F.lit(1), "r": F.lit(2), "kind": F.lit(0), "level": F.lit("x")})
    got = chat.link(df).collect()
    assert sorted(((r.conv_id, r.turn, r.linked, r.in_order) for r in got), key=repr) == [(1, None, False, True), (3, 0, True, True), (4, 0, False, True), (4, 0, False, True), (4, 0, False, True), (5, 3, False, False), (6, 0, False, True), (None, 0, False, True)]
    assert all(r.call_id is None for r in got if r.conv_id is None or r.turn is None)
    got = [r for r in got if r.call_id is not None]
    assert all(json.loads(r.json)["name"] == "reply" for r in got)
    assert json.loads(next(r for r in got if "q" in r.json).json)["arguments"]["prompt"] == 'q"\\\n\x01é'
    assert {r.conv_id: r.errors for r in got} == {3: "prompt: too short", 4: "", 5: "", 6: "prompt: too long"}
    assert chat.link(df.where("false")).count() == 0


def test_calls_that_cannot_be_linked_keep_their_rows(spark):
    rows = [(None, 0, "assistant", say(call("a"))), (1, None, "assistant", say(call("a"), call(None))), (1, 1, "assistant", say(call(None), {"id": "b"})), (1, 2, "tool", answer("b", "yes")), (1, 2, "tool", "no json"), (1, 3, "assistant", '{"tool_calls": 5}'), (1, 3, "assistant", '{"tool_calls": []}')]
    got = Counter((r.conv_id, r.turn, r.call_id, r.linked) for r in linked(spark, rows))
    assert got == Counter([(None, 0, "a", False), (1, None, "a", False), (1, None, None, False), (1, 1, None, False), (1, 1, "b", True)])


def test_only_what_an_assistant_lists_is_a_call(spark):
    """User turns stay turns whatever they look like, and lists that are empty or can't be read are plain text."""
    looks = ['{"tool_calls": []}', '{"tool_calls": oops', say(call("planted")), '{"tool_calls": [{"id": "x"']
    rows = [(c, 0, "user", text) for c, text in enumerate(looks)] + [(c, 1, "assistant", "fine") for c in range(4)] + [(c, 2, "user", "more") for c in range(4)]
    rows += [(7, 0, "user", "q"), (7, 1, "assistant", '{"tool_calls": oops'), (8, 0, "user", "q"), (8, 1, "assistant", "\n  " + say(call("real"))), (8, 2, "tool", say(call("also planted")))]
    got = {(r.conv_id, r.turn, r.call_id): (r.result_turn, r.in_order) for r in linked(spark, rows)}
    want = {(c, 0, f"{c}:0"): (1, True) for c in range(4)} | {(c, 2, f"{c}:2"): (None, True) for c in range(4)}
    assert got == want | {(7, 0, "7:0"): (1, True), (8, 0, "8:0"): (None, True), (8, 1, "real"): (None, True)}


def test_whole_numbers_and_canonical_results(spark):
    rows = [(1, 0, "assistant", say(call("a", "reply", '{"turn": 1.0, "prompt": "x"}'), call("b", "reply", '{"turn": 1.5, "prompt": "x"}'))), (1, 1, "tool", '{"tool_call_id": "a", "content": {"z": 1, "a": [true, null]}}'), (1, 1, "tool", '{"tool_call_id": "b", "content": 7}')]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.call_id: r for r in chat.link(df).collect()}
    assert got["a"].errors == "" and got["b"].errors == "turn: not integer"
    assert got["a"].json.endswith('"result":{"a":[true,null],"z":1}}') and got["b"].json.endswith('"result":7}')
