"""Chains, private values, strict numbers, support routes and caps against brute force."""

import itertools
import json
import random

import pytest

from tidemark.functions import text
from tidemark.operators import contracts, graph, planning


def failing(nodes, needs):
    bad = {n for n, ok in nodes.items() if not ok} | {a for a, b in needs if b not in nodes and a in nodes}
    while True:
        more = {a for a, b in needs if b in bad and a in nodes} - bad
        if not more:
            return bad
        bad |= more


def spread(spark, nodes, needs):
    n = spark.createDataFrame(list(nodes.items()), "node long, ok boolean")
    return {r.node for r in graph.spread_failure(n, spark.createDataFrame(needs, "node long, needs long")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_failures_spread_over_any_graph(spark, seed):
    rng = random.Random(seed)
    nodes = {i: rng.random() < 0.9 for i in range(60)}
    needs = [(rng.randrange(60), rng.randrange(62)) for _ in range(50)] + [(k, k - 1) for k in range(20, 40)] + [(50, 51), (51, 52), (52, 50), (55, 55)]
    assert spread(spark, nodes, needs) == failing(nodes, needs)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    settle = graph._settle
    monkeypatch.setattr(graph, "_settle", lambda df: rounds.append(1) or settle(df))
    claims = spark.range(600).withColumnRenamed("id", "node")
    evidence = claims.selectExpr("node", "node <> 90 AS adequate")
    needs = claims.where("node > 0").selectExpr("node", "node - 1 AS needs")
    got = {r.node: r.state for r in graph.reconcile(claims, evidence, needs, claims.where("false")).collect()}
    assert got == {i: "SUPPORTED" if i < 90 else "UNRESOLVED" for i in range(600)} and len(rounds) < 60


def test_strict_numbers(spark):
    texts = ['{"sha":"3e412aa"}', '{"s":"take 2e301 and \\"1e999\\""}', "1e300", "-1e308", "1e1000", "[1, -2e999]", '{"a":1,"a":2}', "NaN", "9" * 320, '{"long":"' + "x\\\\" * 50_000 + '"}', ""]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = [r.ok for r in df.select(text.strict_json(df.raw).isNotNull().alias("ok")).collect()]
    assert got == [True, True, True, True, False, False, False, False, False, True, False]


def test_private_values(spark):
    bad = ["C:\\Users\\ann\\a.wav", "C:/work/a.wav", "/root/a.wav", "see /home/x", "\\\\host\\share", "key sk-abcdefghijkl", "SESS-abcdefghijklm", "data:audio/wav", "x" * 9000, "say input_audio", "http://h/x"]  # the colon and slash of a URL look like a drive to this rule
    good = ["", None, "plain text", "a/b", "sk-short", "12:30", "// comment"]
    df = spark.createDataFrame([(v, "ok") for v in bad + good] + [("fine", "C:/x")], "a string, b string")
    got = contracts.private_leaks(df, ["a", "b"]).collect()
    assert {r.a for r in got} == {*bad, "fine"} and {tuple(r.leaks) for r in got} == {("a",), ("b",)}
    named = spark.createDataFrame([("v",), (None,)], "my_API_key string")
    assert contracts.private_leaks(named, ["my_API_key"]).count() == 1


def best_route(proposition, members):
    """Every product of the slots, as plainly as can be."""
    direct = proposition not in ("interpretation", "emotion")
    slots = {}
    for m in members:
        slots.setdefault(m["slot"], []).append(m)
    own = slots.pop(0, [])
    single = len(own) + len(slots) == 1
    usable = lambda m: m["adequate"] and (not direct or m["covered"]) and not (single and m["insufficient_alone"])
    missing = {m["node"] for m in own if not usable(m)}
    lists = []
    for ms in slots.values():
        good = [m for m in ms if usable(m)]
        if good:
            lists.append(good)
        else:
            missing |= {m["node"] for m in ms}
    choices = []
    for pick in itertools.product(*lists):
        chosen = own + list(pick)
        state = 0
        for m in chosen:
            if usable(m):
                state |= m["same_proposition"] + 2 * m["temporal_visual"] + 4 * m["event_timing"]
        choices.append((tuple(sorted(m["node"] for m in chosen)), state, chosen))
    need = 6 if proposition == "av_sync" else 1 if direct else 0
    viable = [c for c in choices if c[1] & need == need]
    route = min(c[0] for c in viable or choices)
    cover = {m["node"]: m["covered"] for m in members}
    reasons = []
    if proposition == "av_sync" and not viable:
        reasons.append("NO_REVIEWED_SYNCHRONISATION")
    if direct and any(not cover[n] for n in route):
        reasons.append("INTERVAL_NOT_COVERED")
    if direct and proposition != "av_sync" and not viable:
        reasons.append("NOT_COMPETENT")
    return sorted(set(route)), sorted(missing), "OPEN" if missing or reasons else "SURVIVES", reasons


def test_routes_equal_the_product(spark):
    rng = random.Random(4)
    routes, members, want = [], [], {}
    for i in range(80):
        proposition = rng.choice(["av_sync", "delivery", "interpretation"])
        mine = [{"slot": s, "node": f"n{k}", **{f: rng.random() < p for f, p in (("adequate", 0.8), ("covered", 0.85), ("same_proposition", 0.5), ("temporal_visual", 0.4), ("event_timing", 0.4), ("insufficient_alone", 0.3))}} for k, s in enumerate(rng.choice([[0], [1, 1], [0, 1, 1], [0, 0, 1, 1, 2], [1, 1, 1, 2, 2, 3, 3, 3]]))]
        routes.append((f"c{i}", "r", proposition))
        members += [{"claim": f"c{i}", "route": "r", **m} for m in mine]
        want[f"c{i}"] = best_route(proposition, mine)
    schema = "claim string, route string, slot int, node string, adequate boolean, covered boolean, same_proposition boolean, temporal_visual boolean, event_timing boolean, insufficient_alone boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    got = planning.assess_routes(spark.createDataFrame(routes, "claim string, route string, proposition string"), spark.createDataFrame([tuple(m[n] for n in names) for m in members], schema))
    assert {r.claim: (r.selected, r.missing, r.status, r.reasons) for r in got.collect()} == want


def test_many_interchangeable_slots_are_not_multiplied_out(spark):
    """Thirty slots of three: 3^30 products, eight states."""
    rows = [("c", "r", s, f"n{s:02d}{k}", True, True, s == 17 and k == 2, False, False, False) for s in range(1, 31) for k in range(3)]
    schema = "claim string, route string, slot int, node string, adequate boolean, covered boolean, same_proposition boolean, temporal_visual boolean, event_timing boolean, insufficient_alone boolean"
    r = planning.assess_routes(spark.createDataFrame([("c", "r", "delivery")], "claim string, route string, proposition string"), spark.createDataFrame(rows, schema)).first()
    assert r.selected == [f"n{s:02d}{2 if s == 17 else 0}" for s in range(1, 31)] and r.status == "SURVIVES"


def test_caps_tell_what_they_cut(spark):
    rows = [("a", i) for i in range(7)] + [("b", 1), ("b", 2)]
    got = planning.cap_matches(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"], 2).collect()
    assert sorted((r.k, r.v, r["rank"], r.truncated) for r in got) == [("a", 0, 1, True), ("a", 1, 2, True), ("b", 1, 1, False), ("b", 2, 2, False)]
    assert json.dumps([r.truncated for r in planning.cap_matches(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"], 9).collect()]).count("true") == 0
