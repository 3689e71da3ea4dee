from tidemark.operators import music

D = "decision int, level string, subjects array<string>, source string, stream int, start_s double, end_s double, status string"
E = "decision int, evidence string, kind string, level string, source string, stream int, inspected boolean, audio_inspected boolean, subjects array<string>, artifact string, match_id string, reference_source string, reference_stream int, all_channels boolean, performance_basis string, comparison_basis string"
M = "match_id string, a_source string, a_stream int, a0 double, a1 double, b_source string, b_stream int, b0 double, b1 double, status string, native boolean, sufficient boolean, exact_pcm boolean"


def ev(decision, kind, level, **k):
    return (decision, k.get("name", "e"), kind, level, k.get("source", "s"), 0, k.get("inspected", True), k.get("heard"), k.get("subjects", ["c"]), k.get("artifact", "h"), k.get("match"), k.get("ref"), 0 if k.get("ref") else None, k.get("all"), k.get("perf"), k.get("comp"))


def test_levels(spark):
    levels = ["RECORDING"] * 4 + ["COMPOSITION"] * 3 + ["PERFORMANCE"] * 2 + ["UNKNOWN", "PHRASE", "RECORDING"]
    decisions = spark.createDataFrame([(i, lv, [] if i == 11 else ["c"], "s", 0, 1.0, 2.0, "SUPPORTED") for i, lv in enumerate(levels)], D)
    evidence = spark.createDataFrame(
        [
            ev(0, "REFERENCE_IDENTITY", "RECORDING", match="m", ref="r"),
            ev(1, "REFERENCE_IDENTITY", "RECORDING", match="short", ref="r"),
            ev(2, "REFERENCE_IDENTITY", "RECORDING", match="turned", ref="r", all=True),
            ev(3, "REFERENCE_IDENTITY", "RECORDING", match="turned", ref="r"),
            ev(4, "OFFICIAL_CREDIT", "COMPOSITION", artifact="h1"), ev(4, "SOURCE_VISIBLE_CREDIT", "COMPOSITION", artifact="h2", name="f"),
            ev(5, "OFFICIAL_CREDIT", "COMPOSITION", artifact="h1"), ev(5, "SOURCE_VISIBLE_CREDIT", "COMPOSITION", artifact="h1", name="f"),
            ev(6, "OFFICIAL_CREDIT", "RECORDING"),
            ev(7, "SCOPED_IDENTITY_REVIEW", "PERFORMANCE", heard=True, perf="same breath"),
            ev(8, "SCOPED_IDENTITY_REVIEW", "PERFORMANCE", heard=True),
            ev(9, "SCOPED_IDENTITY_REVIEW", "UNKNOWN", heard=True),
            ev(10, "SCOPED_IDENTITY_REVIEW", "PHRASE", heard=True, comp="tune"), ev(10, "SCOPED_IDENTITY_REVIEW", "PHRASE", heard=False, comp="tune", name="f"),
        ],
        E,
    )
    matches = spark.createDataFrame(
        [("m", "s", 0, 1.0, 2.0, "r", 0, 0.0, 1.0, "EXACT", True, True, True), ("short", "s", 0, 1.0, 1.5, "r", 0, 0.0, 0.5, "EXACT", True, True, True), ("turned", "r", 0, 0.0, 1.0, "s", 0, 1.001, 2.0, "NEAR_EXACT", True, True, False)],
        M,
    )
    support = music.identity_support(decisions, evidence, matches)
    got = {r.decision: r.reason for r in support.collect()}
    assert got == {
        0: None, 1: "NO_REFERENCE_WITH_FULL_MATCH", 2: None, 3: "NO_REFERENCE_WITH_FULL_MATCH", 4: None, 5: "CANDIDATE_ONLY", 6: "NO_SCOPED_EVIDENCE",
        7: None, 8: "NO_PERFORMANCE_BASIS", 9: "UNKNOWN_LEVEL", 10: "CANDIDATE_ONLY", 11: "NO_SUBJECT",
    }
    assert {r.decision for r in music.unsupported_closures(decisions, support).collect()} == {k for k, v in got.items() if v}
