"""Half-open intervals [start, end) as two columns: union, gaps, overlap and containment joins, validity.

Functions take and return DataFrames. `keys` names the columns that intervals must share (source, stream).
Joins on time are equi-joins on time buckets with the exact condition as a residual, never nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-7


def islands(df: DataFrame, keys: list[str], start: str, end: str, slack: float = EPS) -> DataFrame:
    """df with `island`: rows whose start is within `slack` of what came before share one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + F.lit(slack)), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def union(df: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s", slack: float = EPS) -> DataFrame:
    """Maximal intervals of the union; empty and reversed intervals don't count."""
    valid = df.where(F.col(start) < F.col(end)).select(*keys, start, end)
    marked = islands(valid, keys, start, end, slack)
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def covered(df: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Measure of the union for each key."""
    return union(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"), F.count("*").alias("n_intervals"))


def missing(required: DataFrame, cover: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s", slack: float = EPS) -> DataFrame:
    """What of the required intervals the cover leaves open, with open heads and tails.

    One sweep: both sides become signed boundary events, and the running counts say where required time is bare.
    """
    need = union(required, keys, start, end, slack)
    have = union(cover, keys, start, end, slack).join(need.select(*keys).distinct(), keys, "left_semi")

    def events(df: DataFrame, r: int, c: int) -> DataFrame:
        at = lambda t, sign: df.select(*keys, F.col(t).alias("t"), F.lit(sign * r).alias("r"), F.lit(sign * c).alias("c"))
        return at(start, 1).unionByName(at(end, -1))

    steps = events(need, 1, 0).unionByName(events(have, 0, 1)).groupBy(*keys, "t").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    order = Window.partitionBy(*keys).orderBy("t")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select(*keys, "t", F.sum("r").over(run).alias("r"), F.sum("c").over(run).alias("c"), F.lead("t").over(order).alias("until"))
    bare = swept.where((F.col("r") > 0) & (F.col("c") == 0) & F.col("until").isNotNull()).select(*keys, F.col("t").alias(start), F.col("until").alias(end))
    return union(bare, keys, start, end, slack).where(F.col(end) - F.col(start) > slack)


def _buckets(df: DataFrame, start: Column, end: Column, width: float, name: str) -> DataFrame:
    """One row for each bucket that [start, end) touches."""
    first = F.floor(start / width).cast("long")
    last = F.greatest(first, (F.ceil(end / width) - 1).cast("long"))
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], ls: str, le: str, rs: str, re: str, width: float) -> DataFrame:
    """Pairs that overlap, with `overlap_start` and `overlap_end`. Choose width near the median length.

    A pair that shares several buckets is kept in the first of them only, so no distinct is needed.
    """
    a = _buckets(left.where(F.col(ls) < F.col(le)), F.col(ls), F.col(le), width, "_b")
    b = _buckets(right.where(F.col(rs) < F.col(re)), F.col(rs), F.col(re), width, "_b")
    joined = a.join(b, [*on, "_b"])
    lo, hi = F.greatest(ls, rs), F.least(le, re)
    return (
        joined.where((lo < hi) & (F.col("_b") == F.floor(lo / width).cast("long")))
        .withColumns({"overlap_start": lo, "overlap_end": hi})
        .drop("_b")
    )


def point_join(points: DataFrame, spans: DataFrame, on: list[str], t: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Points with each interval that holds them."""
    spread = _buckets(spans.where(F.col(start) < F.col(end)), F.col(start), F.col(end), width, "_b")
    placed = points.withColumn("_b", F.floor(F.col(t) / width).cast("long"))
    inside = (F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))
    same = [placed[k] == spread[k] for k in [*on, "_b"]]
    joined = placed.join(spread, [*same, inside] if how != "inner" else same, how)
    if how == "inner":
        joined = joined.where(inside)
    for k in [*on, "_b"]:
        joined = joined.drop(spread[k])
    return joined.drop(placed["_b"])


def contained(left: DataFrame, right: DataFrame, on: list[str], ls: str, le: str, rs: str, re: str, width: float) -> DataFrame:
    """Overlapping pairs with `relation`: CONTAINED where left lies within right, else CROSSING."""
    pairs = overlap_join(left, right, on, ls, le, rs, re, width)
    inside = (F.col(ls) >= F.col(rs)) & (F.col(le) <= F.col(re))
    return pairs.withColumn("relation", F.when(inside, "CONTAINED").otherwise("CROSSING"))


def intersect3(a: DataFrame, b: DataFrame, c: DataFrame, on: list[str], width: float, least: float = EPS) -> DataFrame:
    """Three-way intersection of (start, end) tables longer than `least`."""
    ab = overlap_join(a.select(*on, F.col("start_s").alias("as_"), F.col("end_s").alias("ae_")), b.select(*on, F.col("start_s").alias("bs_"), F.col("end_s").alias("be_")), on, "as_", "ae_", "bs_", "be_", width)
    ab = ab.select(*on, F.col("overlap_start").alias("xs_"), F.col("overlap_end").alias("xe_"))
    abc = overlap_join(ab, c.select(*on, F.col("start_s").alias("cs_"), F.col("end_s").alias("ce_")), on, "xs_", "xe_", "cs_", "ce_", width)
    return abc.where(F.col("overlap_end") - F.col("overlap_start") > least).select(*on, F.col("overlap_start").alias("start_s"), F.col("overlap_end").alias("end_s"))


def map_affine(spans: DataFrame, segments: DataFrame, on: list[str], width: float) -> DataFrame:
    """Spans of a derivative clock on the parent's clock, piece by piece through its segments.

    segments: child_start, child_end, parent_start, parent_end.
    """
    pieces = overlap_join(spans, segments, on, "start_s", "end_s", "child_start", "child_end", width)
    rate = (F.col("parent_end") - F.col("parent_start")) / (F.col("child_end") - F.col("child_start"))
    at = lambda t: F.col("parent_start") + (F.col(t) - F.col("child_start")) * rate
    return pieces.withColumns({"parent_from": at("overlap_start"), "parent_to": at("overlap_end")})


def segment_violations(segments: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Segment maps checked as rows: positive length, rate one within 2 * tolerance, no overlap on either clock."""
    child, parent = Window.partitionBy(*keys).orderBy("child_start", "child_end"), Window.partitionBy(*keys).orderBy("parent_start", "parent_end")
    length, own = F.col("child_end") - F.col("child_start"), F.col("parent_end") - F.col("parent_start")
    checks = F.array(
        F.when((length <= 0) | (own <= 0), F.lit("not positive")),
        F.when(F.abs(length - own) > 2 * tolerance, F.lit("rate")),
        F.when(F.col("child_start") < F.lag("child_end").over(child) - tolerance, F.lit("child overlap")),
        F.when(F.col("parent_start") < F.lag("parent_end").over(parent) - tolerance, F.lit("parent overlap")),
    )
    return segments.withColumn("violations", F.array_compact(checks)).where(F.size("violations") > 0)


def onset_spread(df: DataFrame, keys: list[str], start: str, end: str, offset: str) -> DataFrame:
    """Largest spread of an offset within each run of connected intervals."""
    marked = islands(df, keys, start, end)
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), (F.max(offset) - F.min(offset)).alias("spread"), F.count("*").alias("n"))


def selection_status(segments: DataFrame, requests: DataFrame, on: list[str], width: float, rate: str = "rate") -> DataFrame:
    """Samples that each half-open request selects, and COMPLETE, PARTIAL or MISSING."""
    pieces = overlap_join(requests, segments, on, "req_start", "req_end", "start_s", "end_s", width)
    lo = F.ceil((F.col("overlap_start") - F.col("start_s")) * F.col(rate) - 1e-6)
    hi = F.ceil((F.col("overlap_end") - F.col("start_s")) * F.col(rate) - 1e-6)
    sums = pieces.groupBy("req_id").agg(F.sum(hi - lo).alias("samples"), F.sum(F.col("overlap_end") - F.col("overlap_start")).alias("have"), F.max(rate).alias("_r"))
    out = requests.join(sums, "req_id", "left")
    left = F.col("req_end") - F.col("req_start") - F.coalesce("have", F.lit(0.0))
    status = F.when(F.coalesce("samples", F.lit(0)) == 0, "MISSING").when(left <= 1 / F.col("_r") + 1e-8, "COMPLETE").otherwise("PARTIAL")
    return out.select(*requests.columns, F.coalesce("samples", F.lit(0)).alias("samples"), status.alias("status"))
