"""Identity groups, ledger revisions and counting, on small hand-made cases."""

import pytest

from tidemark.operators import contours, reuse

OCC = "occurrence_id string, introduced long, source_start_s double, source_end_s double, rate int, speaker string, quality string, unit_kind string, vocal_status string"
MATCH = "match_id string, observed long, a_id string, a_start double, a_end double, b_id string, b_start double, b_end double, classification string, exact_pcm boolean, auto_link boolean, tolerance double"


def occ(name, at, size=4.0, speaker="ana", quality="clean_scene", kind="performance", voice="verified_voice"):
    return (f"occ-{name}", at, 0.0, size, 16000, speaker, quality, kind, voice)


def match(name, a, b, a_span=(0.0, 4.0), b_span=(0.0, 4.0), at=1, kind="EXACT", pcm=False, auto=True):
    return (name, at, f"occ-{a}", *a_span, f"occ-{b}", *b_span, kind, pcm, auto, 0.01)


def build(spark, occs, matches, decisions=(), promotions=(), revision=None):
    o = spark.createDataFrame(occs, OCC)
    m = spark.createDataFrame(matches, MATCH)
    keys = {r.match_id: r.correspondence for r in reuse.with_keys(m).collect()}
    d = spark.createDataFrame([(r, keys[k], v) for r, k, v in decisions], "revision long, correspondence string, decision string")
    p = spark.createDataFrame(list(promotions), "revision long, performance_id string, occurrence_id string, feature string")
    e = reuse.edges(m, o, d, revision)
    return e, reuse.identities(e, o, p), o


def groups(members):
    return {r.occurrence_id: (r.identity_id, r.canonical) for r in members.collect()}


def test_whole_matches_join_and_fragments_do_not(spark):
    e, m, o = build(
        spark,
        [occ("a", 1), occ("b", 2, quality="isolated_voice_asset"), occ("c", 3, size=9.0, kind="composite", voice="unknown")],
        [match("m1", "a", "b"), match("m2", "b", "c", b_span=(2.0, 6.0))],
    )
    assert {r.match_id: (r.identity_decision, r.whole_unit) for r in e.collect()} == {"m1": ("same_performance", True), "m2": ("same_performance", False)}
    got = groups(m)
    assert got["occ-a"] == got["occ-b"] == ("perf-a", "occ-b") and got["occ-c"] == ("edit-c", "occ-c")


def test_a_late_better_witness_keeps_the_name(spark):
    _, m, _ = build(spark, [occ("a", 1), occ("z", 9, quality="isolated_voice_asset")], [match("m", "z", "a")])
    assert set(groups(m).values()) == {("perf-a", "occ-z")}
    _, m, _ = build(spark, [occ("a", 1), occ("z", 9, quality="isolated_voice_asset")], [match("m", "z", "a")], promotions=[(3, "perf-z", "occ-a", "default"), (2, "perf-a", "occ-z", "default")])
    assert set(groups(m).values()) == {("perf-a", "occ-a")}


def test_composites_never_bridge(spark):
    occs = [occ("a", 1), occ("b", 2), occ("mix", 3, kind="composite")]
    e, m, o = build(spark, occs, [match("m1", "a", "mix"), match("m2", "b", "mix")], decisions=[(1, "m1", "same_performance"), (2, "m2", "same_performance")])
    assert len({v[0] for v in groups(m).values()}) == 3
    got = {r.identity_id: (r.contribution, r.relationship) for r in reuse.audit(e, m, o).collect()}
    assert got == {"perf-a": (1, "whole_unit_group"), "perf-b": (1, "whole_unit_group"), "edit-mix": (0, "composite")}


def test_decisions_by_revision_and_reset(spark):
    occs, ms = [occ("a", 1, voice="unknown"), occ("b", 2, voice="unknown")], [match("m", "a", "b", auto=False)]
    steps = [(1, "m", "same_performance"), (2, "m", "reset"), (3, "m", "different")]
    state = lambda r: build(spark, occs, ms, steps, revision=r)[0].first().identity_decision
    assert [state(r) for r in (0, 1, 2, 3)] == ["audio_only", "same_performance", "audio_only", "different"]


def test_other_speakers_stay_apart_and_non_matches_unresolved(spark):
    e, m, _ = build(
        spark,
        [occ("a", 1, quality="isolated_voice_asset"), occ("b", 2, speaker="bob"), occ("c", 3)],
        [match("m1", "a", "b"), match("m2", "a", "c", kind="POSSIBLE", auto=False)],
    )
    assert {r.match_id: r.identity_decision for r in e.collect()} == {"m1": "audio_only", "m2": "unresolved"}
    assert len({v[0] for v in groups(m).values()}) == 3


def test_key_has_no_direction_and_the_last_observation_counts(spark):
    m = spark.createDataFrame([match("m1", "a", "b", at=1), match("m2", "b", "a", at=2, kind="POSSIBLE")], MATCH)
    r = reuse.latest_observations(m).collect()
    assert len(r) == 1 and r[0].match_id == "m2" and r[0].n_observations == 2


def test_ends_matter_more_than_shares(spark):
    e, _, _ = build(spark, [occ("a", 1, size=100.0, quality="isolated_voice_asset"), occ("b", 2, size=100.0)], [match("m", "a", "b", (0.5, 99.5), (0.5, 99.5))], decisions=[(1, "m", "same_performance")])
    assert not e.first().whole_unit


def test_partial_reuse_is_counted_once(spark):
    e, m, o = build(
        spark,
        [occ("a", 1), occ("f", 2, size=2.0, kind="fragment")],
        [match("m1", "a", "f", (0.0, 2.0), (0.0, 2.0)), match("m2", "a", "f", (0.5, 1.5), (0.5, 1.5), at=2)],
        decisions=[(1, "m1", "same_performance"), (2, "m2", "same_performance")],
    )
    got = {r.identity_id: (r.contribution, r.relationship, r.reused_seconds) for r in reuse.audit(e, m, o).collect()}
    assert got == {"perf-a": (1, "whole_unit_group", 0.0), "perf-f": (0, "partial_or_trimmed_reuse", 2.0)}
    base = spark.createDataFrame([(0, "occ-f"), (1, "occ-a"), (2, "occ-a"), (3, "occ-x")], "row_no int, occurrence_id string")
    assert {r.row_no: r.status for r in reuse.baseline_status(base, m, e).collect()} == {0: "PARTIAL_REUSE_REVIEW", 1: "INDEXED", 2: "DUPLICATE_WHOLE_UNIT", 3: "NOT_INDEXED"}


def test_speaker_view_keeps_what_is_linked(spark):
    e, m, o = build(spark, [occ("a", 1), occ("b", 2, speaker="bob"), occ("c", 3, speaker="cy")], [match("m1", "a", "b")])
    assert {r.occurrence_id for r in reuse.speaker_view(e, m, o, "ana").collect()} == {"occ-a", "occ-b"}


def test_candidate_roles(spark):
    shared = spark.createDataFrame([("r", "t"), ("t", "r"), ("r", "r2"), ("x", "y"), ("t", "x"), ("x", "x")], "a string, b string")
    roles = spark.createDataFrame([("r", "reference"), ("r2", "reference"), ("t", "target"), ("x", "both"), ("y", "both")], "id string, role string")
    assert sorted(tuple(r) for r in reuse.candidate_pairs(shared, roles).collect()) == [("r", "t"), ("x", "t"), ("x", "y")]


CONT = "source string, segment_id int, sample_start long, sample_end long, time_s double, pitch_hz double, pitch_strength double, rms_dbfs double"


@pytest.fixture
def track(spark):
    rows = []
    for seg, (t0, n) in enumerate([(3.0, 200), (7.0, 400)]):
        for i in range(n):
            t = t0 + 0.005 + i * 0.01
            rows.append(("s", seg, i * 160, i * 160 + 640, t, 100.0 * 2 ** ((t - 3.0) / 12) if i % 10 else None, 0.9, -20.0 if i % 2 else -240.0))
    segs = [("s", 0, 0, 32000, 3.0, 5.0), ("s", 1, 0, 64000, 7.0, 11.0)]
    return spark.createDataFrame(rows, CONT), spark.createDataFrame(segs, "source string, segment_id int, sample_start long, sample_end long, start_s double, end_s double")


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, source string, start_s double, end_s double, boundary_origin string, source_class string")


def test_contour_query(spark, track):
    q = ask(spark, ("one", "s", 3.0, 5.0, "manual_verified", "isolated_voice_asset"), ("gap", "s", 4.0, 8.0, "manual_verified", "mixed"), ("out", "s", 20.0, 21.0, "subtitle_boundary", "mixed"))
    got = {r.query_id: r for r in contours.query(*track, q, 16000).collect()}
    one = got["one"]
    assert one.status == "MEASURED" and (one.n_rows, one.n_voiced) == (200, 180) and one.baseline_eligible and one.flags == []
    assert one.slope_st_per_s == pytest.approx(1.0) and one.final_slope_st_per_s == pytest.approx(1.0)
    assert one.power_mean_dbfs == pytest.approx(-23.0102999566) and one.fraction_below == 0.5
    assert got["gap"].status == "UNCOVERED" and got["gap"].n_rows is None
    assert got["out"].status == "UNCOVERED" and "SUBTITLE_BOUNDARY_ONLY" in got["out"].flags


def test_contained_windows_are_fewer(spark, track):
    q = ask(spark, ("one", "s", 3.0, 5.0, "estimated_boundary", "isolated_voice_asset"))
    all_, inside = (contours.query(*track, q, 16000, selection=s).first() for s in ("centers", "contained_rms_windows"))
    assert inside.n_rows < all_.n_rows and inside.flags == ["ALIGNMENT_UNCERTAIN"]


def test_cue_summary_and_separation(spark, track):
    cues = spark.createDataFrame([(1, "s", 3.0, 5.0), (2, "s", 5.5, 6.0)], "cue_id int, source string, start_s double, end_s double")
    got = {r.cue_id: r for r in contours.cue_summary(track[0], cues).collect()}
    assert got[1].plain_mean_dbfs == -130 and got[1].power_mean_dbfs == pytest.approx(-23.0102999566) and got[2].n_rows is None
    up = track[0].withColumn("pitch_hz", track[0]["pitch_hz"] * 1.2)
    r = contours.separation(track[0], up, ["source"]).first()
    assert r.flag == "SEPARATION_ARTIFACT" and r.change_st == pytest.approx(3.156, abs=0.01)


def test_vocal_baseline(spark):
    row = lambda i, p, v, q=True, **k: ("ana", p, i, "verified_voice", "performance", k.get("quality", "isolated_voice_asset"), "non_singing_dialogue", 0, q, v)
    rows = [row(1, "p1", 1.0), row(2, "p1", 50.0), row(3, "p2", 2.0), row(4, "p3", 9.0), row(5, "p4", None), row(6, "p5", 7.0, q=False), row(7, "p6", 7.0, quality="mixed_scene"), row(8, None, 3.0)]
    df = spark.createDataFrame(rows, "speaker string, performance_id string, row_no int, vocal_status string, unit_kind string, quality string, segment_type string, n_flags int, quality_reviewed boolean, f0 double")
    assert {r.row_no: r.reason for r in contours.admitted(df).where("reason is not null").collect()} == {2: "DUPLICATE_RECORDED_PERFORMANCE", 6: "QUALITY_NOT_ACCEPTED", 7: "NOT_VERIFIED_ISOLATED_NON_SINGING_DIALOGUE", 8: "UNKNOWN_PERFORMANCE_OR_SPEAKER"}
    r = contours.vocal_baseline(df, 3, ["f0"]).first()
    assert (r.n, r.median, r.mad, r.status) == (3, 2.0, 1.0, "MEASURED_DISTRIBUTION")
    assert contours.vocal_baseline(df, 4, ["f0"]).first().status == "OPEN"


def test_comparison_units(spark):
    a = spark.createDataFrame([("p", 0.6, 0), ("p", 0.6, 1)], "pair string, size double, channel int")
    b = spark.createDataFrame([("p", 0)], "pair string, channel int")
    got = sorted((r.channel_a, round(r.window_s, 2), round(r.from_s, 2)) for r in reuse.comparisons(a, b).collect())
    one = [(0.24, 0.0), (0.24, 0.12), (0.24, 0.24), (0.24, 0.36), (0.5, 0.0), (0.6, 0.0)]
    assert got == [(c, *x) for c in (0, 1) for x in one]


def test_rebinding_and_stages(spark):
    from tidemark.operators import contracts

    p = spark.createDataFrame([("r1", "h1"), ("r2", "h2")], "ref string, sha256 string")
    local = spark.createDataFrame([("/b", "h1"), ("/a", "h1")], "path string, sha256 string")
    assert {r.ref: (r.path, r.status) for r in contracts.rebind(p, local).collect()} == {"r1": ("/a", "BOUND"), "r2": (None, "MISSING")}
    first = spark.createDataFrame([("h", ["x", "y"], "t")], "sha256 string, clips array<string>, task string")
    second = spark.createDataFrame([(1, "h", ["x", "y"], "t"), (2, "h", ["y", "x"], "t"), (3, "h", ["x", "y"], "u"), (4, "g", ["x"], "t")], "id int, parent_sha256 string, clips array<string>, task string")
    assert {r.id: r.status for r in contracts.stage_parents(second, first).collect()} == {1: "BOUND", 2: "OTHER_CLIPS", 3: "OTHER_TASK", 4: "NO_PARENT"}
