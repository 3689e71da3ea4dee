from tidemark.operators import readings

VERSIONS = "reading string, version int, text string, speaker string"


def test_a_decision_holds_for_the_state_it_was_made_on(spark):
    rows = [("r", 1, "hello", "a"), ("r", 2, "hallo", "a"), ("s", 1, "x", None), ("s", 2, "x", None), ("t", 1, "p", "b"), ("t", 1, "q", "b")]
    frozen = readings.freeze(spark.createDataFrame(rows, VERSIONS), "reading", "version", ["text", "speaker"])
    at = {(r.reading, r.version, r.text): r.digest for r in frozen.collect()}
    assert at["s", 1, "x"] == at["s", 2, "x"] and at["r", 1, "hello"] != at["r", 2, "hallo"]
    told = [("r", "ACCEPT", at["r", 1, "hello"]), ("r", "REJECT", at["r", 2, "hallo"]), ("s", "ACCEPT", at["s", 1, "x"]), ("s", "ACCEPT", "0" * 64), ("t", "ACCEPT", at["t", 1, "p"]), ("u", "ACCEPT", at["s", 1, "x"]), ("r", "ACCEPT", None)]
    judged = readings.judge(spark.createDataFrame(told, "reading string, decision string, told_digest string"), frozen, "reading")
    assert sorted((r.reading, r.decision, r.status) for r in judged.collect()) == [
        ("r", "ACCEPT", "STALE"), ("r", "ACCEPT", "UNKNOWN_DIGEST"), ("r", "REJECT", "APPLIES"), ("s", "ACCEPT", "APPLIES"), ("s", "ACCEPT", "UNKNOWN_DIGEST"), ("t", "ACCEPT", "AMBIGUOUS"), ("u", "ACCEPT", "NO_READING"),
    ]
    assert {r.reading: (r.state, r.n_stale) for r in readings.projected(frozen, judged, "reading", "decision").collect()} == {"r": ("REJECT", 1), "s": ("ACCEPT", 0)}


def test_conflict_and_open(spark):
    frozen = readings.freeze(spark.createDataFrame([("r", 1, "x", None), ("o", 1, "y", None)], VERSIONS), "reading", "version", ["text"])
    own = {r.reading: r.digest for r in frozen.collect()}
    judged = readings.judge(spark.createDataFrame([("r", "ACCEPT", own["r"]), ("r", "REJECT", own["r"])], "reading string, decision string, told_digest string"), frozen, "reading")
    assert {r.reading: r.state for r in readings.projected(frozen, judged, "reading", "decision").collect()} == {"r": "CONFLICT", "o": "OPEN"}
