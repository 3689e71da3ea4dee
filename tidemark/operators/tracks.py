"""Statistics of measured tracks: one row per window centre, grouped by query or cue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def power_mean(level: Column) -> Column:
    """Mean of powers, back in decibels; not the mean of decibels."""
    return 10 * F.log10(F.avg(F.pow(F.lit(10.0), level / 10)))


def slope(y: Column, t: Column, least: int = 5) -> Column:
    """Least-squares slope; null under `least` points or where t doesn't vary."""
    return F.when((F.count(F.when(y.isNotNull() & t.isNotNull(), 1)) >= least) & (F.max(t) > F.min(t)), F.regr_slope(y, t))


def describe(df: DataFrame, keys: list[str], value: str, t: str, quiet_below: float) -> DataFrame:
    """Rows, voiced share, quantiles, span, slope, power mean, peak, quiet share and quality flags of each group."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    flags = F.array_compact(F.array(F.when(F.count(v) < 3, F.lit("FEW_VALUES")), F.when(F.count(v) < F.count("*"), F.lit("UNVOICED_ROWS"))))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.avg(v.isNotNull().cast("double")).alias("voiced_fraction"),
        q.alias("_q"),
        slope(v, F.col(t)).alias("slope"),
        power_mean(v).alias("power_mean"),
        F.max(v).alias("peak"),
        F.avg((v < quiet_below).cast("double")).alias("quiet_fraction"),
        flags.alias("flags"),
    )
    out = out.withColumns({"p10": F.col("_q")[0], "median": F.col("_q")[1], "p90": F.col("_q")[2], "span": F.col("_q")[2] - F.col("_q")[0]})
    return out.withColumn("eligible", (F.col("n_rows") >= 3) & (F.col("voiced_fraction") > 0)).drop("_q")


def contrast(df: DataFrame, key: str, a: str, b: str, level: str, pitch: str) -> DataFrame:
    """Decibel and semitone difference of two named intervals."""
    part = lambda name, c: F.when(F.col(key) == name, F.col(c))
    return df.agg(
        power_mean(part(a, level)).alias("level_a"),
        power_mean(part(b, level)).alias("level_b"),
        F.percentile(part(a, pitch), F.lit(0.5)).alias("pitch_a"),
        F.percentile(part(b, pitch), F.lit(0.5)).alias("pitch_b"),
    ).withColumns({"level_change_db": F.expr("level_b - level_a"), "semitones": semitones(F.col("pitch_b"), F.col("pitch_a"))})


def semitones(b: Column, a: Column) -> Column:
    """The step from a to b: infinite where one of them is zero, NaN between zeros, null where one is under zero."""
    inf = float("inf")
    step = F.when((a == 0) & (b == 0), float("nan")).when((a == 0) & (b > 0), inf).when((b == 0) & (a > 0), -inf)
    return step.otherwise(F.when((a > 0) & (b > 0), 12 * F.log2(F.try_divide(b, a))))


def jumps(df: DataFrame, keys: list[str], t: str, value: str, most_gap: float, least_semitones: float, ties: list[str] | None = None) -> DataFrame:
    """Neighbouring rows, close in time, whose values are at least so many semitones apart. Rows of one time go by `ties`."""
    order = Window.partitionBy(*keys).orderBy(t, *(ties or []))
    with_prev = df.withColumns({"prev_t": F.lag(t).over(order), "prev_value": F.lag(value).over(order)})
    step = semitones(F.col(value), F.col("prev_value"))
    return with_prev.withColumn("semitones", step).where((F.col(t) - F.col("prev_t") <= most_gap) & (F.abs(step) >= least_semitones))


def quiet_runs(df: DataFrame, keys: list[str], t: str, value: str, below: float, most_gap: float) -> DataFrame:
    """Maximal runs of rows under the threshold; a longer gap between neighbours also ends a run."""
    order = Window.partitionBy(*keys).orderBy(t)
    quiet = F.col(value) < below
    cut = F.when(quiet & (~F.coalesce(F.lag(quiet).over(order), F.lit(False)) | (F.col(t) - F.lag(t).over(order) > most_gap)), 1).otherwise(0)
    marked = df.withColumns({"_quiet": quiet, "_cut": cut}).withColumn("run", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("_quiet").groupBy(*keys, "run")
    return runs.agg(F.min(t).alias("start_s"), F.max(t).alias("end_s"), F.count("*").alias("n_rows"), F.min(value).alias("floor"))


def final_slope(df: DataFrame, keys: list[str], t: str, value: str, tail_s: float, share: float, least: int = 5) -> DataFrame:
    """Slope over the last min(tail_s, share of the span) of each group."""
    # A window rather than a join with the ends, so that the track is read and dealt out once.
    over = Window.partitionBy(*keys)
    held = df.withColumns({"_a": F.min(t).over(over), "_z": F.max(t).over(over)})
    tail = held.where(F.col(t) >= F.col("_z") - F.least(F.lit(tail_s), share * (F.col("_z") - F.col("_a"))))
    return tail.groupBy(*keys).agg(F.count("*").alias("n_points"), slope(F.col(value), F.col(t), least).alias("final_slope"))


def adjacent_duplicates(df: DataFrame, keys: list[str], order: list[str], text: str, start: str | None = None, end: str | None = None, gap: float = 0.05) -> DataFrame:
    """df with `duplicate`: equal text right before or right after. With start and end, the later of two must also start at
    most `gap` after the earlier one's end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.col(text) == F.lag(text).over(w), F.col(text) == F.lead(text).over(w)
    if start and end:
        before = before & (F.col(start) <= F.lag(end).over(w) + gap)
        after = after & (F.lead(start).over(w) <= F.col(end) + gap)
    same = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    return df.withColumn("duplicate", F.coalesce(same, F.lit(False)))


def fill_extent(df: DataFrame, keys: list[str], pts: str, duration: str, endpoint: str) -> DataFrame:
    """df with extent and method: a positive duration, the next distinct start, the stream's end, or, for the
    last row alone, the step before it as an estimate; UNKNOWN where none gives a positive extent."""
    w = Window.partitionBy(*keys).orderBy(F.desc(pts))
    later = F.lag(pts).over(w)
    # Read backwards, the start after a run of equal starts is carried through the run.
    marked = df.withColumn("_later", F.when(later != F.col(pts), later))
    marked = marked.withColumn("_next", F.last("_later", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_before", F.lead(pts).over(w))
    to_next, to_end, step = F.col("_next") - F.col(pts), F.col(endpoint) - F.col(pts), F.col(pts) - F.col("_before")
    method = (
        F.when(F.col(duration) > 0, "EXPLICIT")
        .when(to_next.isNotNull(), "NEXT_PTS")
        .when(to_end > 0, "STREAM_END")
        .when(step > 0, "PREVIOUS_DELTA")
        .otherwise("UNKNOWN")
    )
    extent = F.when(F.col(duration) > 0, F.col(duration)).when(to_next.isNotNull(), to_next).when(to_end > 0, to_end).when(step > 0, step)
    return marked.withColumns({"extent": extent, "method": method}).drop("_later", "_next", "_before")


def sessions(df: DataFrame, keys: list[str], t: str, end: str, tolerance: float) -> DataFrame:
    """Segments of rows that follow the one before within the tolerance; gaps stay gaps."""
    w = Window.partitionBy(*keys).orderBy(t, end)
    fresh = F.when(F.abs(F.col(t) - F.lag(end).over(w)) <= tolerance, 0).otherwise(1)
    marked = df.withColumn("_f", fresh).withColumn("segment", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "segment").agg(F.min(t).alias("start_s"), F.max(end).alias("end_s"), F.count("*").alias("n_rows"))


def response_gaps(df: DataFrame, keys: list[str], start: str, end: str, verified: str) -> DataFrame:
    """Gap to the utterance before; a latency only where both boundaries are verified."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    gap = F.col(start) - F.lag(end).over(w)
    return df.withColumns({"gap": gap, "latency": F.when(F.col(verified) & F.lag(verified).over(w), gap)})


def first_seen(df: DataFrame, keys: list[str], order: list[str], ident: str) -> DataFrame:
    """df with `duplicate_of`: the first row of the same key, null for that row itself."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(ident).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("duplicate_of", F.when(F.col(ident) != first, first))


def spans_from_points(points: DataFrame, keys: list[str], t: str, lo: float, hi: float) -> DataFrame:
    """Spans between neighbouring cut points and the two bounds."""
    inner = points.where((F.col(t) > lo) & (F.col(t) < hi)).select(*keys, F.col(t).alias("start_s"))
    every = inner.unionByName(points.select(*keys).distinct().withColumn("start_s", F.lit(lo))).distinct()
    w = Window.partitionBy(*keys).orderBy("start_s")
    return every.withColumn("end_s", F.coalesce(F.lead("start_s").over(w), F.lit(hi)))


def stereo(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Mid and side energy and the correlation of two channels; null where one is constant."""
    l, r = F.col(left), F.col(right)  # noqa: E741
    cov = F.avg(l * r) - F.avg(l) * F.avg(r)
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.avg(l * l) - F.pow(F.avg(l), F.lit(2))) * (F.avg(r * r) - F.pow(F.avg(r), F.lit(2)))))
    return df.groupBy(*keys).agg(
        F.avg(F.pow((l + r) / 2, F.lit(2))).alias("mid_energy"),
        F.avg(F.pow((l - r) / 2, F.lit(2))).alias("side_energy"),
        F.try_divide(cov, spread).alias("correlation"),
    )


def waveform(df: DataFrame, keys: list[str], index: str, value: str, bin_size: int) -> DataFrame:
    """Minimum, maximum and rms of bins of samples."""
    v = F.col(value)
    return df.groupBy(*keys, F.floor(F.col(index) / bin_size).alias("bin")).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.sqrt(F.avg(v * v)).alias("rms"))


def channel_power(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Power of two channels and of their mean; a mean far under both warns of cancellation."""
    pa, pb, pm = F.avg(F.col(a) * F.col(a)), F.avg(F.col(b) * F.col(b)), F.avg(F.pow((F.col(a) + F.col(b)) / 2, F.lit(2)))
    return df.groupBy(*keys).agg(pa.alias("power_a"), pb.alias("power_b"), pm.alias("power_mix")).withColumn("cancels", F.expr("power_mix < 0.1 * least(power_a, power_b)"))


def zero_crossings(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Rms, peak and zero-crossing rate of each group."""
    w = Window.partitionBy(*keys).orderBy(index)
    sign = F.when(F.col(value) >= 0, 1).otherwise(-1)
    marked = df.withColumn("_x", F.when(sign != F.lag(sign).over(w), 1).otherwise(0))
    v = F.col(value)
    return marked.groupBy(*keys).agg(F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"), F.try_divide(F.sum("_x"), F.count("*") - 1).alias("zcr"))


def pooled(df: DataFrame, keys: list[str], index: str, value: str, bins: int, total: int) -> DataFrame:
    """Largest value in each of `bins` equal index ranges."""
    at = F.least(F.floor(F.col(index) * bins / total), F.lit(bins - 1)).cast("long")
    return df.groupBy(*keys, at.alias("bin")).agg(F.max(value).alias("peak"), F.count("*").alias("n"))


def every_kth(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.expr(f"(rn - 1) % {k} = 0"))


def monotone_violations(df: DataFrame, keys: list[str], order: str, t: str) -> DataFrame:
    """Rows whose clock doesn't move forward."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("prev_t", F.lag(t).over(w)).where(F.col(t) <= F.col("prev_t"))


def robust_baseline(df: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """n, median, median absolute deviation, p10 and p90; OPEN where n is under the minimum."""
    over = Window.partitionBy(*keys)
    centred = df.where(F.col(value).isNotNull()).withColumn("_m", F.percentile(value, F.lit(0.5)).over(over))
    out = centred.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.first("_m").alias("median"),
        F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("mad"),
        F.percentile(value, F.lit(0.1)).alias("p10"),
        F.percentile(value, F.lit(0.9)).alias("p90"),
    )
    return out.withColumn("status", F.when(F.col("n") < least, "OPEN").otherwise("READY"))


def trailing(df: DataFrame, keys: list[str], t: str, value: str, seconds: float) -> DataFrame:
    """Power mean over the trailing window; null until the track is that old."""
    w = Window.partitionBy(*keys).orderBy(t)
    state = 10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col(value) / 10)).over(w.rangeBetween(-seconds, 0)))
    warm = F.col(t) - F.min(t).over(w.rowsBetween(Window.unboundedPreceding, 0)) >= seconds
    return df.withColumn("trailing", F.when(warm, state))


def onsets(df: DataFrame, keys: list[str], t: str, strength: str) -> DataFrame:
    """Local maxima over median + max(3 MAD, a tenth of the maximum), before any suppression."""
    over, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(t)
    s = F.col(strength)
    m = df.withColumns({"_m": F.percentile(strength, F.lit(0.5)).over(over), "_top": F.max(strength).over(over)})
    m = m.withColumn("_d", F.percentile(F.abs(s - F.col("_m")), F.lit(0.5)).over(over))
    m = m.withColumns({"_p": F.lag(strength).over(w), "_n": F.lead(strength).over(w)})
    peak = (s > F.col("_m") + F.greatest(3 * F.col("_d"), 0.1 * F.col("_top"))) & (s > F.coalesce("_p", F.lit(float("-inf")))) & (s >= F.coalesce("_n", F.lit(float("-inf"))))
    return m.where(peak).drop("_m", "_top", "_d", "_p", "_n")
