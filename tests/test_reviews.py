import pytest

from tidemark.operators import reviews


def test_tracks(spark):
    t = [("a", "h", 10, 1, 1, "mono", 0.01), ("b", "h", 10, 1, 1, "mono", 0.0), ("c", "h", 10, 1, 1, None, 0.0), ("d", "g", 10, 1, 1, "mono", 0.0)]
    tracks = spark.createDataFrame(t, "track string, pcm_sha256 string, frames int, rate int, channels int, layout string, tolerance double")
    seg = [("a", 0, 0, 10, 0.0, 1.0), ("b", 0, 0, 10, 0.005, 1.0), ("c", 0, 0, 10, 0.0, 1.0), ("d", 0, 0, 10, 0.0, 1.0)]
    segments = spark.createDataFrame(seg, "track string, segment_no int, sample_start int, sample_end int, start_s double, end_s double")
    pairs = spark.createDataFrame([("ab", "a", "b"), ("ac", "a", "c"), ("ad", "a", "d"), ("bc", "b", "c")], "pair string, a string, b string")
    got = {r.pair: r.status for r in reviews.compare_tracks(tracks, segments, pairs).collect()}
    assert got == {"ab": "MATCH", "ac": "INDETERMINATE", "ad": "DIFFERENT", "bc": "DIFFERENT"}


def test_temporal_reviews(spark):
    frames = spark.createDataFrame([(r, f, f * 0.1) for r in "abcd" for f in range(10)], "review string, frame int, t double")
    schema = "review string, question string, declared boolean, mode string, answered boolean, inspected_start double, inspected_end double, critical_start double, critical_end double, inspected array<int>, audio_event double, visual_frame int, audio_start double, audio_end double"
    base = (True, "source_frame_sequence", True, 0.0, 1.0, 0.15, 0.45)
    rows = [
        ("a", "GENERAL_MOTION", *base, [2, 3], None, None, None, None),
        ("b", "EXACT_CONTACT", *base, [2, 3], None, None, None, None),
        ("c", "AV_SYNC", True, "synchronized_av", True, 0.0, 1.0, 0.15, 0.45, [2, 3, 4], 0.35, 3, 0.0, 1.0),
        ("d", "AV_SYNC", True, "synchronized_av", True, 0.0, 1.0, 0.15, 0.45, [2, 3, 4], 0.45, 7, 0.2, 1.0),
    ]
    got = {r.review: r for r in reviews.temporal_review(spark.createDataFrame(rows, schema), frames).collect()}
    assert got["a"].status == "ADEQUATE_DECLARED" and got["b"].reasons == ["NOT_EVERY_CRITICAL_FRAME"]
    assert got["c"].status == "ADEQUATE_DECLARED" and got["c"].audio_minus_visual_s == pytest.approx(0.05)
    assert got["d"].reasons == ["AUDIO_NOT_INSPECTED", "AUDIO_EVENT_OUTSIDE", "VISUAL_EVENT_OUTSIDE"]


def test_trials(spark):
    ex = spark.createDataFrame([(i, "EXACT_WORD_TIMING", "held_out", "POSITIVE", "PRESENT", ["r1"]) for i in range(4)], "example int, task string, split string, control string, expected string, voters array<string>")
    tr = spark.createDataFrame([(0, True, "PRESENT", 0.01, "r2", True), (1, True, "PRESENT", 0.03, "r1", True), (2, True, "PRESENT", 0.0, "x", True), (2, True, "PRESENT", 0.0, "x", True)], "example int, valid boolean, predicted string, timing_error double, reviewer string, reference_independent boolean")
    got = {r.example: (r.state, r.correct, r.independent) for r in reviews.judge_trials(ex, tr).collect()}
    assert got == {0: ("JUDGED", True, True), 1: ("JUDGED", False, False), 2: ("REPEATED", None, True), 3: ("MISSING", None, False)}


def test_alignment(spark):
    cues = spark.createDataFrame([(1, "s", "speech", "hi", 3.1, 4.0), (2, "s", "speech", "hi", 4.9, 5.1), (3, "s", "non_speech_caption", "x", 3.0, 4.0), (4, "s", "speech", "hi", 7.0, 60.0)], "cue int, source string, kind string, text string, start_s double, end_s double")
    seg = spark.createDataFrame([("s", 0, 32000, 3.0, 5.0), ("s", 32000, 992000, 7.0, 67.0)], "source string, sample_start long, sample_end long, start_s double, end_s double")
    win = reviews.alignment_windows(cues, seg, 16000)
    got = {r.cue: r for r in win.collect()}
    assert {k: v.status for k, v in got.items()} == {1: "ELIGIBLE", 2: "SKIPPED_AUDIO_GAP_OR_PARTIAL_COVERAGE", 3: "SKIPPED_NON_SPEECH", 4: "SKIPPED_WINDOW_TOO_LONG"}
    assert (got[1].sample_first, got[1].sample_last, got[1].crop_start_s) == (0, 19200, 3.0)
    units = spark.createDataFrame([(1, 0, "h", 0.1, 0.3), (1, 1, "i", 0.3, 0.5)], "cue int, unit_no int, text string, start_s double, end_s double")
    assert [(r.start_s, r.status) for r in reviews.accept_alignment(units, win, 16000).orderBy("unit_no").collect()] == [(pytest.approx(3.1), "ALIGNED_CANDIDATE"), (pytest.approx(3.3), "ALIGNED_CANDIDATE")]
    back = units.union(spark.createDataFrame([(1, 2, "!", 0.2, 0.6)], units.schema))
    assert {(r.start_s, r.status) for r in reviews.accept_alignment(back, win, 16000).collect()} == {(None, "REJECTED_TIMING")}


def test_relations_either_way(spark):
    rel = spark.createDataFrame([(1, "SAME_RECORDED_PERFORMANCE", "m", "x", 0.0, 1.0, "y", 2.0, 3.0), (2, "SAME_RECORDED_PERFORMANCE", "m", "y", 2.0, 3.0, "x", 0.0, 1.0), (3, "EDITED_RECORDING_REUSE", "m", "x", 0.0, 1.5, "y", 2.0, 3.0), (4, "SAME_RECORDED_PERFORMANCE", "n", "x", 0.0, 1.0, "y", 2.0, 3.0)], "relation_id int, relation string, match_id string, a_source string, a0 double, a1 double, b_source string, b0 double, b1 double")
    edges = spark.createDataFrame([("m", "x", 0.0, 1.0, "y", 2.0, 3.0, 16000, True, "same_performance"), ("n", "x", 0.0, 1.0, "y", 2.0, 3.0, 16000, False, "audio_only")], "match_id string, a_source string, a0 double, a1 double, b_source string, b0 double, b1 double, rate int, whole_unit boolean, identity_decision string")
    assert {r.relation_id: r.linked for r in reviews.recording_relations(rel, edges).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_packets_keep_the_segments_own_offset(spark):
    rows = [("c", 10.0 + i, 11.0 + i, i * 1.0004, 1.0, False) for i in range(4)]
    df = spark.createDataFrame(rows, "clip string, p_start double, p_end double, c_start double, duration double, estimated boolean")
    got = reviews.merge_packets(df, 0.0009).orderBy("segment").collect()
    # Neighbours differ by 0.0004 only; the third is 0.0012 from where the segment began.
    assert [(r.parent_start, r.parent_end) for r in got] == [(10.0, 13.0), (13.0, 14.0)] and got[0].offset_spread == pytest.approx(0.0012)


def test_design_receipts_and_responses(spark):
    d = reviews.probe_design(spark, 24).collect()
    assert sorted(r.trial for r in d) == list(range(24)) and sum(r.answer for r in d) == 12 and len({r.pair for r in d}) == 12
    assert d == reviews.probe_design(spark, 24).collect()
    rec = spark.createDataFrame([(1, 12, 12, 1.0, 1 / 4096), (2, 12, 6, 0.5, 0.61279296875), (3, 12, 12, 0.9, 0.0)], "receipt int, n int, k int, told_accuracy double, told_p double")
    assert {r.receipt: r.status for r in reviews.capability(rec).collect()} == {1: "PROBE_PASSED", 2: "PROBE_FAILED", 3: "RECEIPT_DIFFERS"}
    body = spark.createDataFrame([("r", "h", '{"a": [{"t": "The SONG of x"}]}')], "response string, sha256 string, body string")
    sel = spark.createDataFrame([("r", "h", "$.a[0].t", "song"), ("r", "h", "$.a[0].t", "tune"), ("r", "g", "$.a[0].t", "song"), ("q", "h", "$", "x")], "response string, sha256 string, path string, title string")
    assert [r.status for r in reviews.candidates_from_responses(body, sel).orderBy("response", "sha256", "title").collect()] == ["NO_RESPONSE", "RESPONSE_CHANGED", "FOUND", "NOT_THERE"]


def test_clips(spark):
    clips = spark.createDataFrame([(c,) for c in "abcde"], "clip string")
    m = spark.createDataFrame([("a", 1), ("b", 1), ("b", 9), ("c", 1), ("d", 1)], "clip string, at int")
    gaps, spread = spark.createDataFrame([("c",)], "clip string"), spark.createDataFrame([("d", 1.0)], "clip string, spread double")
    assert {r.clip: r.status for r in reviews.admit_clip(clips, m, gaps, spread, 0.1).collect()} == {"a": "ADMITTED", "b": "AMBIGUOUS", "c": "PARTIAL", "d": "DRIFTING", "e": "UNMATCHED"}


def test_observations(spark):
    o = spark.createDataFrame([("o1", "s", 1.0, 2.0), ("o2", "s", 4.0, 6.0)], "observation string, source string, start_s double, end_s double")
    c = spark.createDataFrame([("c", "s", 0.0, 5.0)], "claim string, source string, start_s double, end_s double")
    assert {(r.observation, r.relation) for r in reviews.observations_to_claims(o, c, 2.0).collect()} == {("o1", "CONTAINED"), ("o2", "CROSSING")}
