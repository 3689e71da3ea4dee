"""Checks of declared reviews and recorded results: tracks, temporal reviews, trials, alignments, relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals


def compare_tracks(tracks: DataFrame, segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, samples_equal, layout, timing_equal, status) of pairs(pair, a, b) of decoded tracks.

    tracks(track, pcm_sha256, frames, rate, channels, layout, tolerance); segments(track, segment_no,
    sample_start, sample_end, start_s, end_s). An unknown layout makes an otherwise equal pair INDETERMINATE.
    """
    side = lambda s: tracks.select(*[F.col(c).alias(s if c == "track" else f"{s}_{c}") for c in tracks.columns])
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    same = F.lit(True)
    for c in ("pcm_sha256", "frames", "rate", "channels"):
        same = same & (F.col("a_" + c) == F.col("b_" + c))
    layout = F.when(F.col("a_layout").isNull() | F.col("b_layout").isNull(), "UNKNOWN").when(F.col("a_layout") == F.col("b_layout"), "MATCH").otherwise("DIFFERENT")
    rows = rows.select("pair", "a", "b", same.alias("samples_equal"), layout.alias("layout"), F.greatest("a_tolerance", "b_tolerance").alias("tolerance"))
    part = lambda s: rows.select("pair", "tolerance", F.col(s).alias("track")).join(segments, "track").select("pair", "tolerance", "segment_no", F.struct("sample_start", "sample_end", "start_s", "end_s").alias(s))
    both = part("a").join(part("b").drop("tolerance"), ["pair", "segment_no"], "full")
    a, b = F.col("a"), F.col("b")
    near = lambda c: F.abs(a[c] - b[c]) <= F.col("tolerance")
    ok = (a["sample_start"] == b["sample_start"]) & (a["sample_end"] == b["sample_end"]) & near("start_s") & near("end_s")
    timing = both.groupBy("pair").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("timing_equal"))
    out = rows.join(timing, "pair", "left").withColumn("timing_equal", F.coalesce("timing_equal", F.lit(True)))
    differs = ~F.col("samples_equal") | ~F.col("timing_equal") | (F.col("layout") == "DIFFERENT")
    status = F.when(differs, "DIFFERENT").when(F.col("layout") == "UNKNOWN", "INDETERMINATE").otherwise("MATCH")
    return out.select("pair", "samples_equal", "layout", "timing_equal", status.alias("status"))


def temporal_review(reviews: DataFrame, frames: DataFrame) -> DataFrame:
    """(review, status, reasons): OPEN with its reasons, or ADEQUATE_DECLARED.

    reviews(review, question, declared, mode, answered, inspected_start, inspected_end, critical_start,
    critical_end, inspected array of frame numbers, audio_event, visual_frame, audio_start, audio_end); frames
    (review, frame, t) are the frames at hand. Exact questions need every frame of the critical interval.
    """
    inside = frames.join(reviews.select("review", "critical_start", "critical_end"), "review").where((F.col("t") >= F.col("critical_start")) & (F.col("t") < F.col("critical_end")))
    expected = inside.groupBy("review").agg(F.collect_set("frame").alias("expected"))
    everything = frames.groupBy("review").agg(F.collect_set("frame").alias("available"), F.map_from_entries(F.collect_set(F.struct("frame", "t"))).alias("times"))
    r = reviews.join(expected, "review", "left").join(everything, "review", "left")
    none = F.array().cast("array<int>")
    r = r.withColumns({c: F.coalesce(F.col(c).cast("array<int>"), none) for c in ("expected", "available", "inspected")})
    exact = F.col("question").isin("CONTACT_ORDER", "EXACT_CONTACT", "AV_SYNC")
    sync = F.col("question") == "AV_SYNC"
    seen = F.try_element_at("times", F.col("visual_frame"))
    within = lambda t: F.coalesce((t >= F.col("critical_start")) & (t < F.col("critical_end")), F.lit(False))
    bare = F.col("inspected_start").isNull() | (F.col("inspected_start") > F.col("critical_start") + 1e-9) | (F.col("inspected_end") < F.col("critical_end") - 1e-9)
    heard = F.coalesce((F.col("audio_start") <= F.col("critical_start") + 1e-9) & (F.col("audio_end") >= F.col("critical_end") - 1e-9), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(~F.col("declared") | ~F.coalesce(F.col("mode").isin("source_frame_sequence", "synchronized_av"), F.lit(False)), "NOT_DECLARED"),
        F.when(~F.coalesce("answered", F.lit(False)), "NOT_ANSWERED"),
        F.when(bare | (F.size("inspected") == 0), "CRITICAL_INTERVAL_NOT_COVERED"),
        F.when(F.size(F.array_except("inspected", "available")) > 0, "UNKNOWN_FRAMES"),
        F.when(F.size(F.array_intersect("expected", "inspected")) < 2, "UNDER_TWO_CRITICAL_FRAMES"),
        F.when(exact & ((F.size("expected") == 0) | (F.size(F.array_except("expected", "inspected")) > 0)), "NOT_EVERY_CRITICAL_FRAME"),
        F.when(sync & ((F.col("mode") != "synchronized_av") | ~heard), "AUDIO_NOT_INSPECTED"),
        F.when(sync & ~within(F.col("audio_event")), "AUDIO_EVENT_OUTSIDE"),
        F.when(sync & (~F.coalesce(F.array_contains("inspected", F.col("visual_frame")), F.lit(False)) | ~within(seen)), "VISUAL_EVENT_OUTSIDE"),
    ))
    out = r.withColumn("reasons", reasons)
    return out.select("review", F.when(F.size("reasons") > 0, "OPEN").otherwise("ADEQUATE_DECLARED").alias("status"), "reasons", F.when(sync, F.col("audio_event") - seen).alias("audio_minus_visual_s"))


#: Seconds by which an event may be off, by task.
TIMING = {"AUDITORY_EVENT_TIMING": 0.05, "EXACT_WORD_TIMING": 0.02}


def judge_trials(examples: DataFrame, trials: DataFrame) -> DataFrame:
    """One row for each example, with its only trial judged, missing or REPEATED.

    examples(example, task, split, control, expected, voters array), trials(example, valid, predicted,
    timing_error, reviewer, reference_independent).
    """
    counted = trials.withColumn("_n", F.count("*").over(Window.partitionBy("example")))
    rows = examples.join(counted.dropDuplicates(["example"]), "example", "left")
    limit = F.when(F.col("task") == "AUDITORY_EVENT_TIMING", TIMING["AUDITORY_EVENT_TIMING"]).when(F.col("task") == "EXACT_WORD_TIMING", TIMING["EXACT_WORD_TIMING"])
    on_time = limit.isNull() | (F.col("control") != "POSITIVE") | F.coalesce(F.col("timing_error") <= limit, F.lit(False))
    independent = F.coalesce("reference_independent", F.lit(False)) & ~F.coalesce(F.array_contains("voters", F.col("reviewer")), F.lit(False))
    state = F.when(F.col("_n").isNull(), "MISSING").when(F.col("_n") > 1, "REPEATED").otherwise("JUDGED")
    correct = F.coalesce(F.col("valid") & (F.col("predicted") == F.col("expected")) & on_time, F.lit(False))
    return rows.select("example", "split", "control", state.alias("state"), F.when(state == "JUDGED", correct).alias("correct"), on_time.alias("timing_correct"), independent.alias("independent"), F.col("predicted").alias("prediction"))


def alignment_windows(cues: DataFrame, segments: DataFrame, rate: int, pad: float = 0.2, most: float = 30.0, width: float = 60.0) -> DataFrame:
    """cues(cue, source, kind, text, start_s, end_s) with a status and, if ELIGIBLE, first and last sample and the crop's start.

    A cue must lie within exactly one segment, to a sample. Its middle then lies in that segment too, which is looked
    up by buckets of `width` seconds.
    """
    seg = segments.select("source", F.col("start_s").alias("g0"), F.col("end_s").alias("g1"), F.col("sample_start").alias("n0"), F.col("sample_end").alias("n1"))
    speech = (F.length("text") > 0) & (F.col("kind") != "non_speech_caption")
    wide = seg.withColumns({"_w0": F.col("g0") - 1 / rate, "_w1": F.col("g1") + 2 / rate})
    middle = cues.withColumn("_mid", (F.col("start_s") + F.col("end_s")) / 2)
    held = intervals.point_join(middle, wide, ["source"], "_mid", "_w0", "_w1", width).where((F.col("g0") <= F.col("start_s") + 1 / rate) & (F.col("g1") >= F.col("end_s") - 1 / rate))
    one = held.groupBy("cue").agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in ("g0", "g1", "n0", "n1")])
    rows = cues.join(one, "cue", "left")
    lo, hi = F.greatest(F.col("g0"), F.col("start_s") - pad), F.least(F.col("g1"), F.col("end_s") + pad)
    first = F.col("n0") + F.ceil((lo - F.col("g0")) * rate - 1e-6)
    last = F.least(F.col("n1"), F.col("n0") + F.ceil((hi - F.col("g0")) * rate - 1e-6))
    status = (
        F.when(~F.coalesce(speech, F.lit(False)), "SKIPPED_NON_SPEECH")
        .when(F.coalesce("_n", F.lit(0)) != 1, "SKIPPED_AUDIO_GAP_OR_PARTIAL_COVERAGE")
        .when((last - first) / rate > most, "SKIPPED_WINDOW_TOO_LONG")
        .otherwise("ELIGIBLE")
    )
    keep = lambda c: F.when(F.col("status") == "ELIGIBLE", c)
    out = rows.withColumns({"status": status, "_f": first, "_l": last})
    return out.select("cue", "status", keep(F.col("_f")).alias("sample_first"), keep(F.col("_l")).alias("sample_last"), keep(F.col("g0") + (F.col("_f") - F.col("n0")) / rate).alias("crop_start_s"))


def accept_alignment(units: DataFrame, windows: DataFrame, rate: int) -> DataFrame:
    """Units(cue, unit_no, text, start_s, end_s on the crop's clock) on the source clock, all of a cue or none:
    REJECTED_TIMING where any is empty, outside the crop, or before the end of the one before."""
    w = Window.partitionBy("cue").orderBy("unit_no")
    size = (F.col("sample_last") - F.col("sample_first")) / rate
    rows = units.join(windows.where("status = 'ELIGIBLE'"), "cue")
    before = F.coalesce(F.lag("end_s").over(w), F.lit(0.0))
    good = (F.length(F.trim("text")) > 0) & (F.col("start_s") >= 0) & (F.col("start_s") <= F.col("end_s")) & (F.col("end_s") <= size + 1 / rate) & (F.col("start_s") >= before - 1e-6)
    rows = rows.withColumn("_ok", F.coalesce(good & ~F.isnan("start_s") & ~F.isnan("end_s"), F.lit(False)))
    rows = rows.withColumn("_all", F.bool_and("_ok").over(Window.partitionBy("cue")))
    at = lambda c: F.when(F.col("_all"), F.col("crop_start_s") + F.col(c))
    return rows.select("cue", "unit_no", "text", at("start_s").alias("start_s"), at("end_s").alias("end_s"), F.when(F.col("_all"), "ALIGNED_CANDIDATE").otherwise("REJECTED_TIMING").alias("status"))


def recording_relations(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """relations(relation_id, relation, match_id, a_source, a0, a1, b_source, b0, b1) with `linked`: an accepted
    edge of that match has both spans, either way round, to within a sample.

    Two joins by match and source, one for each way round, instead of an OR.
    """
    e = edges.select("match_id", *[F.col(c).alias("e_" + c) for c in ("a_source", "a0", "a1", "b_source", "b0", "b1", "rate", "whole_unit", "identity_decision")])
    slack = 1 / F.col("e_rate") + 1e-6

    def way(x: str, y: str) -> DataFrame:
        near = lambda s, o: (F.abs(F.col(s + "0") - F.col(f"e_{o}0")) <= slack) & (F.abs(F.col(s + "1") - F.col(f"e_{o}1")) <= slack)
        turned = e.withColumnsRenamed({f"e_{x}_source": "a_source", f"e_{y}_source": "b_source"})
        return relations.join(turned, ["match_id", "a_source", "b_source"]).where(near("a", x) & near("b", y))

    met = way("a", "b").select("relation_id", "relation", "e_whole_unit", "e_identity_decision").unionByName(way("b", "a").select("relation_id", "relation", "e_whole_unit", "e_identity_decision"))
    good = F.when(F.col("relation") == "SAME_RECORDED_PERFORMANCE", F.col("e_whole_unit")).otherwise(F.col("e_identity_decision").isin("same_performance", "audio_only"))
    linked = met.where(good).select("relation_id").distinct().withColumn("linked", F.lit(True))
    return relations.join(linked, "relation_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


SEGMENT = "clip string, segment int, parent_start double, parent_end double, child_start double, child_end double, confidence string, offset_spread double"


def merge_packets(matched: DataFrame, tolerance: float, slack: float = 1e-7) -> DataFrame:
    """Segments of matched packets(clip, p_start, p_end, c_start, duration, estimated), one call for each clip.

    A packet joins the segment before it if it touches it, keeps its offset and has the same confidence. The offset
    compared with is the segment's own, from its start, so this is no plain comparison of neighbours.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        offsets = []
        for r in frame.sort_values(["p_start", "c_start"], kind="stable").itertuples():
            offset = r.p_start - r.c_start
            offsets.append(offset)
            confidence = "ESTIMATED" if r.estimated else "SOURCE_DERIVED"
            if out:
                s = out[-1]
                if abs(s[3] - r.p_start) <= slack and abs(offset - (s[2] - s[4])) <= tolerance and s[6] == confidence:
                    s[5] = r.p_end - (s[2] - s[4])
                    s[3] = r.p_end
                    continue
            out.append([r.clip, len(out), r.p_start, r.p_end, r.c_start, r.c_start + r.duration, confidence, 0.0])
        spread = max(offsets) - min(offsets) if offsets else 0.0
        for s in out:
            s[7] = spread
        return pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENT.split(", ")])

    return matched.groupBy("clip").applyInPandas(run, SEGMENT)


def admit_clip(clips: DataFrame, matches: DataFrame, gaps: DataFrame, spread: DataFrame, most_spread: float) -> DataFrame:
    """(clip, status): UNMATCHED, AMBIGUOUS with several places, DRIFTING, PARTIAL with gaps, ADMITTED."""
    n = matches.groupBy("clip").agg(F.count("*").alias("places"))
    out = clips.select("clip").join(n, "clip", "left").join(gaps.select("clip").distinct().withColumn("gap", F.lit(True)), "clip", "left").join(spread, "clip", "left")
    status = (
        F.when(F.coalesce("places", F.lit(0)) == 0, "UNMATCHED")
        .when(F.col("places") > 1, "AMBIGUOUS")
        .when(F.coalesce("spread", F.lit(0.0)) > most_spread, "DRIFTING")
        .when(F.coalesce("gap", F.lit(False)), "PARTIAL")
        .otherwise("ADMITTED")
    )
    return out.select("clip", status.alias("status"))


def probe_design(spark, trials: int = 24, seed: int = 9271) -> DataFrame:
    """(trial, family, answer, pair): both answers of each pair of each family, in a seeded order."""
    if not 12 <= trials <= 200 or trials % 4:
        raise ValueError("12 to 200 trials, divisible by four")
    pairs = spark.range(trials // 4).withColumnRenamed("id", "n")
    kinds = pairs.select("n", F.explode(F.array(F.lit("pitch_direction"), F.lit("signal_presence"))).alias("family"))
    both = kinds.select("n", "family", F.explode(F.array(F.lit(0), F.lit(1))).alias("answer"))
    # A design has 200 rows at most.
    order = Window.orderBy(F.xxhash64(F.lit(seed), "n", "family", "answer"))
    return both.select((F.row_number().over(order) - 1).alias("trial"), "family", "answer", F.format_string("pair-%03d-%s", "n", "family").alias("pair"))


def capability(results: DataFrame) -> DataFrame:
    """Hosted probe receipts(receipt, n, k, told_accuracy, told_p) checked against what they recompute to."""
    from .scoring import binomial_tail

    out = results.withColumns({"accuracy": F.col("k") / F.col("n"), "p_value": binomial_tail(F.col("n"), F.col("k"))})
    same = (F.abs(F.col("accuracy") - F.col("told_accuracy")) <= 1e-9) & (F.abs(F.col("p_value") - F.col("told_p")) <= 1e-9)
    passed = (F.col("n") >= 12) & (F.col("accuracy") >= 0.8) & (F.col("p_value") <= 0.01)
    return out.withColumn("status", F.when(~same, "RECEIPT_DIFFERS").when(passed, "PROBE_PASSED").otherwise("PROBE_FAILED"))


def candidates_from_responses(responses: DataFrame, selections: DataFrame) -> DataFrame:
    """Texts at JSON paths of immutable responses(response, sha256, body), for selections(response, sha256, path,
    title): FOUND where the text there holds the title, whatever the case; the hash must be the response's."""
    rows = selections.join(responses, "response", "left").select("response", "path", "title", selections["sha256"].alias("told"), responses["sha256"].alias("own"), "body")
    text = F.expr("get_json_object(body, path)")
    status = (
        F.when(F.col("own").isNull(), "NO_RESPONSE")
        .when(F.col("told") != F.col("own"), "RESPONSE_CHANGED")
        .when(F.coalesce(F.contains(F.lower(text), F.lower("title")), F.lit(False)), "FOUND")
        .otherwise("NOT_THERE")
    )
    return rows.select("response", F.col("told").alias("sha256"), "path", "title", text.alias("text"), status.alias("status"))


def observations_to_claims(observations: DataFrame, claims: DataFrame, width: float) -> DataFrame:
    """Observations with each claim of their source that holds them; a claim they only cross is a diagnostic."""
    from .intervals import contained

    o = observations.select("observation", "source", F.col("start_s").alias("o0"), F.col("end_s").alias("o1"))
    c = claims.select("claim", "source", F.col("start_s").alias("c0"), F.col("end_s").alias("c1"))
    return contained(o, c, ["source"], "o0", "o1", "c0", "c1", width).select("observation", "claim", "relation")
