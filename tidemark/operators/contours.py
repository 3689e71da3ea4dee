"""Bounded queries over contour tracks: one row of pitch, energy and quality for each named interval.

contours(source, segment_id, sample_start, sample_end, time_s, pitch_hz, pitch_strength, rms_dbfs), segments
(source, segment_id, sample_start, sample_end, start_s, end_s), queries(query_id, source, start_s, end_s,
boundary_origin, source_class). Unvoiced is null. An interval that the segments don't cover is UNCOVERED and
one without finite energy NO_ROWS; neither gets figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals
from .tracks import power_mean, semitones

#: Boundary origins that count as phonetic, and flags that bar a row from baselines.
PHONETIC = ["forced_aligned_verified", "manual_verified"]
BARRING = ["LOW_F0_CONFIDENCE", "SPEAKER_OVERLAP", "SEPARATION_ARTIFACT", "BGM_CONTAMINATION"]


def query(contours: DataFrame, segments: DataFrame, queries: DataFrame, rate: int, selection: str = "centers", hop_s: float = 0.01, below: float = -50.0, floor: float = 75.0, ceiling: float = 600.0, width: float = 1.0) -> DataFrame:
    if selection not in ("centers", "contained_rms_windows"):
        raise ValueError("selection must be centers or contained_rms_windows")
    asked = queries.select("query_id", "source", F.col("start_s").alias("q0"), F.col("end_s").alias("q1"), "boundary_origin", "source_class")
    rows = intervals.point_join(contours, asked, ["source"], "time_s", "q0", "q1", width)
    if selection == "contained_rms_windows":
        own = segments.select("source", "segment_id", F.col("sample_start").alias("s0"), F.col("start_s").alias("t0"))
        at = lambda c: F.col("t0") + (F.col(c) - F.col("s0")) / rate
        rows = rows.join(own, ["source", "segment_id"]).where((at("sample_start") >= F.col("q0")) & (at("sample_end") <= F.col("q1")))
    w = Window.partitionBy("query_id").orderBy("time_s")
    f0 = F.when(F.col("pitch_hz") > 0, F.col("pitch_hz"))
    near = F.col("time_s") - F.lag("time_s").over(w) <= 1.5 * hop_s
    rows = rows.withColumn("f0", f0)
    rows = rows.withColumns({
        "st": 12 * F.log2("f0"),
        "jump": F.coalesce(near & (F.abs(12 * F.log2(F.col("f0") / F.lag("f0").over(w))) >= 10), F.lit(False)),
        "tail": F.col("time_s") >= F.col("q1") - F.least(F.lit(0.5), (F.col("q1") - F.col("q0")) * 0.2),
        "edge": (F.col("f0") < floor * 1.03) | (F.col("f0") > ceiling / 1.03),
    })
    voiced = F.count("f0")
    final_t, final_y = F.when(F.col("tail") & F.col("f0").isNotNull(), F.col("time_s")), F.when(F.col("tail"), F.col("st"))
    slope = lambda y, t: F.when((F.count(y) >= 5) & (F.max(t) > F.min(t)), F.regr_slope(y, t))
    enough = lambda c: F.when(voiced >= 5, c)
    q = F.percentile("f0", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    found = rows.groupBy("query_id").agg(
        F.count("*").alias("n_rows"),
        voiced.alias("n_voiced"),
        (voiced / F.count("*")).alias("voiced_fraction"),
        enough(q).alias("_q"),
        enough(slope(F.col("st"), F.when(F.col("f0").isNotNull(), F.col("time_s")))).alias("slope_st_per_s"),
        enough(slope(final_y, final_t)).alias("final_slope_st_per_s"),
        F.count_if("jump").alias("octave_jumps"),
        F.percentile(F.when(F.col("f0").isNotNull(), F.col("pitch_strength")), F.lit(0.5)).alias("strength_median"),
        F.avg(F.col("edge").cast("double")).alias("_edge"),
        F.percentile("rms_dbfs", F.lit(0.5)).alias("median_dbfs"),
        power_mean(F.col("rms_dbfs")).alias("power_mean_dbfs"),
        F.max("rms_dbfs").alias("peak_dbfs"),
        F.avg((F.col("rms_dbfs") < below).cast("double")).alias("fraction_below"),
        F.count_if(F.col("rms_dbfs").isNull()).alias("_bad"),
    )
    need = asked.select("query_id", "source", F.col("q0").alias("start_s"), F.col("q1").alias("end_s"))
    gaps = need.select("query_id", "source", "start_s", "end_s")
    # Segments are looked up by buckets, so a query meets only those that it touches.
    own = segments.select("source", F.col("start_s").alias("s0"), F.col("end_s").alias("s1"))
    cover = intervals.overlap_join(need, own, ["source"], "start_s", "end_s", "s0", "s1", 30 * width).select("query_id", F.col("s0").alias("start_s"), F.col("s1").alias("end_s"))
    bare = intervals.missing(gaps.drop("source"), cover, ["query_id"]).select("query_id").distinct().withColumn("_gap", F.lit(True))
    out = asked.join(found, "query_id", "left").join(bare, "query_id", "left")
    low = (F.col("voiced_fraction") < 0.4) | (F.col("n_voiced") < 5) | (F.col("_edge") > 0.1) | (F.col("octave_jumps") > 0) | (F.col("strength_median") < 0.6)
    flags = F.array_compact(F.array(
        F.when(F.col("boundary_origin") == "subtitle_boundary", "SUBTITLE_BOUNDARY_ONLY").when(~F.col("boundary_origin").isin(*PHONETIC), "ALIGNMENT_UNCERTAIN"),
        F.when(F.col("source_class") != "isolated_voice_asset", "SPEAKER_ISOLATION_NOT_ESTABLISHED"),
        F.when(F.coalesce(low, F.lit(False)), "LOW_F0_CONFIDENCE"),
        F.when(F.coalesce(F.col("_edge") > 0.1, F.lit(False)), "F0_BOUNDARY_SATURATION"),
        F.when(F.col("octave_jumps") > 0, "F0_DISCONTINUITY"),
    ))
    status = F.when(F.col("_gap"), "UNCOVERED").when(F.col("n_rows").isNull() | (F.col("_bad") > 0), "NO_ROWS").otherwise("MEASURED")
    out = out.withColumns({"status": status, "flags": F.sort_array(flags)})
    out = out.withColumns({"p10_hz": F.col("_q")[0], "median_hz": F.col("_q")[1], "p90_hz": F.col("_q")[2]})
    out = out.withColumn("span_st", 12 * F.log2(F.col("p90_hz") / F.col("p10_hz")))
    bars = F.arrays_overlap("flags", F.array(*[F.lit(b) for b in BARRING]))
    out = out.withColumn("baseline_eligible", (F.col("status") == "MEASURED") & (F.col("source_class") == "isolated_voice_asset") & ~bars)
    measured = ["n_rows", "n_voiced", "voiced_fraction", "p10_hz", "median_hz", "p90_hz", "span_st", "slope_st_per_s", "final_slope_st_per_s", "octave_jumps", "strength_median", "median_dbfs", "power_mean_dbfs", "peak_dbfs", "fraction_below"]
    return out.select("query_id", "status", *[F.when(F.col("status") == "MEASURED", F.col(c)).alias(c) for c in measured], "flags", "baseline_eligible")


def _voiced(unvoiced: float | None) -> Column:
    """pitch_hz where it is over `unvoiced`; wherever it isn't null, if that is None."""
    return F.col("pitch_hz") if unvoiced is None else F.when(F.col("pitch_hz") > unvoiced, F.col("pitch_hz"))


def cue_summary(contours: DataFrame, cues: DataFrame, width: float = 1.0, unvoiced: float | None = 0.0) -> DataFrame:
    """Pitch of cues with at least three voiced rows, and both means of energy."""
    rows = intervals.point_join(contours, cues.select("cue_id", "source", F.col("start_s").alias("c0"), F.col("end_s").alias("c1")), ["source"], "time_s", "c0", "c1", width)
    f0 = _voiced(unvoiced)
    g = rows.groupBy("cue_id").agg(
        F.count("*").alias("n_rows"), F.count(f0).alias("n_voiced"), F.when(F.count(f0) >= 3, F.percentile(f0, F.lit(0.5))).alias("median_hz"),
        power_mean(F.col("rms_dbfs")).alias("power_mean_dbfs"), F.avg("rms_dbfs").alias("plain_mean_dbfs"),
    )
    return cues.select("cue_id").join(g, "cue_id", "left")


def separation(before: DataFrame, after: DataFrame, keys: list[str], most: float = 1.0, unvoiced: float | None = 0.0) -> DataFrame:
    """Median pitch change in semitones of a separated track, and whether it is an artifact."""
    med = lambda df, name: df.groupBy(*keys).agg(F.percentile(_voiced(unvoiced), F.lit(0.5)).alias(name))
    out = med(before, "f0_before").join(med(after, "f0_after"), keys, "full").withColumn("change_st", semitones(F.col("f0_after"), F.col("f0_before")))
    return out.withColumn("flag", F.when(F.col("change_st").isNull(), "UNMEASURED").when(F.abs("change_st") > most, "SEPARATION_ARTIFACT").otherwise("NONE"))


def vocal_baseline(measurements: DataFrame, least: int, features: list[str]) -> DataFrame:
    """Admitted measurements, one for each speaker and performance, unpivoted: n, median, MAD, p10, p90 or OPEN.

    measurements: speaker, performance_id, row_no, vocal_status, unit_kind, quality, segment_type, n_flags,
    quality_reviewed and the features.
    """
    if least < 3:
        raise ValueError("at least three independent performances")
    kept = measurements.where("reason IS NULL") if "reason" in measurements.columns else admitted(measurements).where("reason IS NULL")
    long = kept.unpivot(["speaker"], features, "feature", "value")
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    long = long.withColumn("value", finite)
    with_median = long.withColumn("_m", F.percentile("value", F.lit(0.5)).over(Window.partitionBy("speaker", "feature")))
    g = with_median.groupBy("speaker", "feature").agg(
        F.count("value").alias("n"), F.first("_m").alias("median"), F.percentile(F.abs(F.col("value") - F.col("_m")), F.lit(0.5)).alias("mad"),
        F.percentile("value", F.lit(0.1)).alias("p10"), F.percentile("value", F.lit(0.9)).alias("p90"),
    )
    enough = F.col("n") >= least
    return g.select("speaker", "feature", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("median", "mad", "p10", "p90")], F.when(enough, "MEASURED_DISTRIBUTION").otherwise("OPEN").alias("status"))


def admitted(measurements: DataFrame) -> DataFrame:
    """measurements with `reason` for those left out, in the order the rules are asked."""
    unknown = F.col("performance_id").isNull() | F.col("speaker").isNull() | ~F.coalesce(F.col("vocal_status") == "verified_voice", F.lit(False)) | ~F.coalesce(F.col("unit_kind") == "performance", F.lit(False))
    other = ~F.coalesce((F.col("quality") == "isolated_voice_asset") & (F.col("segment_type") == "non_singing_dialogue"), F.lit(False))
    poor = (F.col("n_flags") > 0) | ~F.coalesce("quality_reviewed", F.lit(False))
    first = F.when(unknown, "UNKNOWN_PERFORMANCE_OR_SPEAKER").when(other, "NOT_VERIFIED_ISOLATED_NON_SINGING_DIALOGUE").when(poor, "QUALITY_NOT_ACCEPTED")
    rows = measurements.withColumn("reason", first)
    rank = F.row_number().over(Window.partitionBy("speaker", "performance_id", F.col("reason").isNull()).orderBy("row_no"))
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & (rank > 1), "DUPLICATE_RECORDED_PERFORMANCE").otherwise(F.col("reason")))
