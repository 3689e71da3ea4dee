import json

from pyspark.sql import functions as F

from tidemark.operators import admission

ID = "0a1b2c3d-0000-4000-8000-00000000000{}"


def test_features_of_odd_cues(spark):
    cues = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 2.0), (3, None, 3.0), (4, 4.0, 5.0)], "k int, start_s double, end_s double")
    told = spark.createDataFrame([(1, 1e-7, 1.0, None), (3, 2.0, 3.0, "OK"), (4, 4.0, 5.1, "OK"), (5, 0.0, 1.0, "OK")], "k int, start_s double, end_s double, status string")
    got = {r.k: (r.feature_status, r.violation) for r in admission.cue_features(cues, told, ["k"]).collect()}
    assert got == {1: ("UNKNOWN", None), 2: ("NOT_PROVIDED", None), 3: (None, "INTERVAL_DIFFERS"), 4: (None, "INTERVAL_DIFFERS"), 5: (None, "UNKNOWN_CUE")}
    assert admission.cue_features(cues, told.limit(0), ["k"]).where("feature_status = 'NOT_PROVIDED'").count() == 4


def test_streams_of_unknown_properties(spark):
    nothing = "width int, side_data array<string>, side_rotation double, rotate string, sample_aspect_ratio string, color_transfer string, color_primaries string, color_space string, pix_fmt string, bits_per_raw_sample string"
    rows = [(None,) * 10, (0,) + (None,) * 9, (640, ["Display Matrix"], None, "0", "1:1", None, "bt2020", None, None, "10")]
    got = [r[0] for r in spark.createDataFrame(rows, nothing).select(admission.frame_refusals()).collect()]
    assert got == [["WIDTH"], [], ["DISPLAY_MATRIX", "HDR_OR_HIGH_DEPTH"]]
    unknown = spark.createDataFrame([(None,) * 5], "video_codec string, pix_fmt string, audio_codec string, origin_s double, report_origin_s double")
    assert unknown.select(admission.copy_refusals()).first()[0] == ["VIDEO_CODEC", "AUDIO_CODEC", "ORIGIN"]


def test_recordings_that_are_malformed(spark):
    own = ID.format(1)
    good = {"id": own, "title": "t", "relations": [{"target-type": "work", "type": "performance", "work": {"id": ID.format(2), "title": None}}, 7]}
    cases = {
        "good": (json.dumps(good), []),
        "none": (None, ["NOT_JSON"]),
        "twice": ('{"id": "a", "id": "a"}', ["NOT_JSON"]),
        "other": (json.dumps(good | {"id": ID.format(3)}), ["OTHER_RECORDING"]),
        "number": (json.dumps(good | {"id": 5}), ["OTHER_RECORDING"]),
        "many": (json.dumps(good | {"relations": [{}] * 201}), ["RELATIONS"]),
        "long": (json.dumps(good | {"title": "x" * 2049}), ["TEXT"]),
        "release": (json.dumps(good | {"releases": [{"id": ID.format(4), "release-group": {"id": "x"}}]}), ["RELEASES"]),
    }
    df = spark.createDataFrame([(k, v[0], own) for k, v in cases.items()], "k string, response string, expected_id string")
    out = admission.catalogue_recordings(df).collect()
    assert {r.k: r.violations for r in out} == {k: v[1] for k, v in cases.items()}
    works = next(r.works for r in out if r.k == "good")
    assert [(w.id, w.title, w.relation_type, w.attributes) for w in works] == [(ID.format(2), None, "performance", [])]


def test_a_whole_packet_has_no_violations(spark):
    scenes = spark.createDataFrame([("s", 0.0, 10.0, 20.0)], "scene string, start_s double, end_s double, duration_s double")
    refs = "scene string, id string, channel string, stream int, start_s double, end_s double, pointer string, stage1_id string, context_ids array<string>"
    evidence = spark.createDataFrame([("s", "a", "AO_STAGE1", 1, 0.0, 5.0, "/x~0", None, None), ("s", "b", "AO_STAGE2", 1, 0.0, 5.0, None, "a", ["a"])], refs)
    observations = spark.createDataFrame([("s", "o", ["a", "b"])], "scene string, id string, evidence_ids array<string>")
    claims = spark.createDataFrame([("s", "c", ["o"], False)], "scene string, id string, observation_ids array<string>, has_routes boolean")
    edges = spark.createDataFrame([("s", "o", "c", "SUPPORTS", None)], "scene string, src string, dst string, relation string, role string")
    assert admission.packet_violations(scenes, evidence, observations, claims, edges).collect() == []
    moved = evidence.withColumn("end_s", F.when(F.col("id") == "b", 12.0).otherwise(F.col("end_s")))
    found = admission.packet_violations(scenes, moved, observations.limit(0), claims, edges.withColumn("role", F.lit("CORROBORATING"))).collect()
    assert {(r.id, r.violation) for r in found} == {("b", "OUTSIDE_SCENE"), ("b", "STAGE1_LOCATOR"), ("c", "PREMISE_MISSING"), ("c", "OPTIONAL_WITHOUT_ROUTES")}


def test_reviews_requests_and_costs(spark):
    reviews = spark.createDataFrame([(1, "owner", "ann", "x", "uncertain", "2024-02-29"), (2, None, None, None, None, None)], "review int, reviewer_type string, reviewer string, scope string, judgment string, date string")
    spans = "review int, source string, stream int, start_s double, end_s double"
    seen, clips = spark.createDataFrame([(1, "s", 0, 1.0, 4.0)], spans), spark.createDataFrame([(1, "s", 0, 0.0, 2.0), (1, "s", 0, 2.0, 4.0)], spans)
    got = {r.review: r.violations for r in admission.scoped_review_violations(reviews, seen, clips).collect()}
    assert got == {1: [], 2: ["REVIEWER_TYPE", "REVIEWER", "SCOPE", "JUDGMENT", "DATE", "INTERVALS"]}
    assert admission.scoped_review_violations(reviews.limit(1), seen, clips.withColumn("stream", F.lit(1))).first().violations == ["BEYOND_OBSERVATION"]
    requests = spark.createDataFrame([(1, "PERFORMANCE_MUSIC", "coherent_section", True, 1.0), (2, None, None, None, None), (3, "EVENT", "microclip", None, None)], "request int, profile string, mode string, allow_long boolean, budget double")
    lengths = spark.createDataFrame([(1, 120.0), (3, 30.0), (3, float("nan"))], "request int, duration_s double")
    assert {r.request: r.violations for r in admission.request_violations(requests, lengths).collect()} == {1: [], 2: ["MODE", "BOUNDS"], 3: ["BOUNDS"]}
    usage = spark.createDataFrame([("m", "in", 10), ("m-2", "in", -1), ("mm", "in", 5), (None, "in", 5)], "model string, kind string, tokens long")
    tariff = spark.createDataFrame([("m", "in", 2.5)], "model string, kind string, usd_per_million double")
    assert sorted(((r.model or ""), r.usd and float(r.usd)) for r in admission.usage_cost(usage, tariff, ["m"]).collect()) == [("", None), ("m", 2.5e-5), ("m-2", None), ("mm", None)]
