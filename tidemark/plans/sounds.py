"""Queries over sampled series: events of a user are a series on its own sample clock, in blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import kernels, signals, tracks
from ..operators.graph import _settle
from ..operators.grouped import by_group
from .base import TRACK, query, r6, table, track

SIZE, RATE = 32, 100.0
#: Buckets of a day, in microseconds, for numbering.
DAY_US = 86_400_000_000

NUMBERED = f"""{TRACK}, s AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS k, value AS v FROM track),
l AS (SELECT series, count(*) AS n, list(v ORDER BY k) AS x FROM s GROUP BY series)"""


def samples(spark, d):
    """(series, sample_index, value) of every user's events in the order of time."""
    rows = track(spark, d).select(F.col("user_id").alias("series"), F.struct("us", "event_id").alias("at"), "value")
    return signals.number(rows, ["series"], "at", F.floor(F.col("at.us") / DAY_US)).select("series", "sample_index", "value")


def _named(df, name):
    return df.select(F.concat(F.lit(name), F.col("series").cast("string")).alias("series"), F.lit(0).alias("channel"), "sample_index", "value")


def planted(spark, d):
    """Blocks of every user's series u and of series c made from them: by fives, one's own; one's own turned round at half
    the level; one's own with a saw on it; the next user's. c leaves the first seven samples out."""
    own = samples(spark, d)
    kind = F.col("series") % 5
    value = F.when(kind == 1, F.col("value") * -0.5).when(kind == 2, F.col("value") * (1 + 0.2 * (F.col("sample_index") % 3))).otherwise(F.col("value"))
    copies = own.where((F.col("sample_index") >= 7) & (kind != 3)).select(F.when(kind == 4, F.col("series") - 1).otherwise(F.col("series")).alias("series"), (F.col("sample_index") - 7).alias("sample_index"), value.alias("value"))
    both = _named(own, "u").unionByName(_named(copies, "c"))
    told = own.where(kind != 4).select("series").distinct().select(F.col("series").cast("string").alias("pair"), F.concat(F.lit("u"), "series").alias("a"), F.concat(F.lit("c"), "series").alias("b"))
    return told, signals.blocks(both, ["series", "channel"], SIZE)


@query(f"""WITH {NUMBERED},
q AS (SELECT series, n, x, w, least(a, n - w) AS a FROM (SELECT *, unnest(range(0, (n - w) + w // 2, w // 2)) AS a FROM l, (VALUES (12), (24)) t(w) WHERE n > w)),
y AS (SELECT series, w, a, list_transform(x[a + 1:a + w], lambda v: v - list_avg(x[a + 1:a + w])) AS t, x, n FROM (SELECT DISTINCT * FROM q)),
o AS (SELECT series, w, a, t, unnest(range(0, n - w + 1)) AS k, x FROM y),
z AS (SELECT series, w, a, k, t, list_transform(x[k + 1:k + w], lambda v: v - list_avg(x[k + 1:k + w])) AS u FROM o),
c AS (SELECT series, w, a, k, abs(list_inner_product(t, u)) / sqrt(list_inner_product(t, t) * list_inner_product(u, u)) AS c FROM z WHERE abs(k - a) >= w),
r AS (SELECT *, row_number() OVER (PARTITION BY series, w, a ORDER BY round(c, 9) DESC, k) AS place FROM c WHERE c >= 0.6)
SELECT series, a AS query_start, a + w AS query_end, k AS target_start, round(c, 6) AS score FROM r WHERE place = 1""")
def self_similar_windows(spark, d):
    """For every window of every series the stretch of the rest that it correlates with most, at 0.6 or more."""
    df = signals.blocks(_named(samples(spark, d), ""), ["series", "channel"], SIZE)
    told = df.select("series").distinct().select(F.col("series").alias("pair"), F.col("series").alias("query"), F.col("series").alias("target"), F.lit(False).alias("same"))
    found = signals.candidates(told, df, SIZE, RATE, fragments=(0.12, 0.24), least=0.6, whole_s=0.0, distance=0.0, apart_from_query=True)
    best = found.groupBy("pair", "query_start", "query_end").agg(F.min(F.struct((-F.round("score", 9)).alias("first"), "target_start", "score")).alias("b"))
    return best.select(F.col("pair").cast("long").alias("series"), "query_start", "query_end", F.col("b.target_start").alias("target_start"), r6("b.score").alias("score"))


@query()
def pair_comparison(spark, d):
    """Every user's series against its planted copy: places, classes and measures of what matches."""
    told, df = planted(spark, d)
    df = _settle(df)
    rows = signals.compare(told, df, SIZE, RATE, fragments=(0.24,))
    return rows.select("pair", "query_start", "query_end", "target_start", "target_end", r6("native_ncc").alias("ncc"), r6("gain").alias("gain"), "kind", "exact", "search_was_reversed")


@query(f"""WITH {NUMBERED}, h AS (SELECT s.series, s.k, l.n FROM s JOIN l USING (series) WHERE s.k % 5 = 0 AND s.k >= 10 AND s.k + 10 <= l.n)
SELECT h.series, h.k AS sample_center, h.k - 10 AS sample_start, h.k + 10 AS sample_end, round(20 * log10(greatest(sqrt(avg(s.v * s.v)), 1e-12)), 6) AS rms_dbfs
FROM h JOIN s ON s.series = h.series AND s.k >= h.k - 10 AND s.k < h.k + 10 GROUP BY ALL""")
def hop_levels(spark, d):
    df = signals.blocks(samples(spark, d), ["series"], 40)
    track_ = signals.hop_track(df, ["series"], 40, RATE, hop_s=0.05, window_s=0.2, floor=12.5, ceiling=40.0)
    return track_.select("series", "sample_center", "sample_start", "sample_end", r6("rms_dbfs").alias("rms_dbfs"))


@query()
def hop_pitch(spark, d):
    """Pitch at hop centres; days without an event cut a series into segments, which no frame crosses."""
    rows = track(spark, d).select("user_id", F.struct("us", "event_id").alias("at"), "value")
    numbered = signals.number(rows, ["user_id"], "at", F.floor(F.col("at.us") / DAY_US))
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("sample_index")
    day = F.floor(F.col("at.us") / DAY_US)
    cut = F.coalesce((day - F.lag(day).over(order) > 1).cast("int"), F.lit(0))
    marked = numbered.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy("user_id", "segment")
    placed = marked.withColumns({"_first": F.min("sample_index").over(first), "start_s": F.min(F.col("at.us") / 1e6).over(first)})
    own = placed.select("user_id", "segment", "start_s", (F.col("sample_index") - F.col("_first")).alias("sample_index"), "value")
    df = signals.blocks(own, ["user_id", "segment", "start_s"], 20)
    found = signals.hop_track(df, ["user_id", "segment", "start_s"], 20, RATE, hop_s=0.02, window_s=0.08, floor=25.0, ceiling=50.0, starts="start_s")
    return found.select("user_id", "segment", "sample_center", r6("time_s").alias("time_s"), r6("pitch_hz").alias("pitch_hz"), r6("pitch_strength").alias("pitch_strength"))


@query("SELECT user_id AS series, epoch_us(ts) // 86400000000 AS sample_index, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def channel_mean(spark, d):
    """The mean of a user's channels, one for each type of event, on a clock of days."""
    rows = track(spark, d).select(F.col("user_id").alias("series"), F.col("event_type").alias("channel"), F.floor(F.col("us") / DAY_US).alias("sample_index"), "value")
    return signals.channel(rows, ["series"]).select("series", "sample_index", r6("value").alias("value"))


@query(f"""WITH {TRACK}, e AS (SELECT *, us / 1e6 AS a, us / 1e6 + 3600 * (1 + event_id % 12) AS z FROM track),
l AS (SELECT *, lag(event_type) OVER w AS bt, lag(z) OVER w AS bz, lead(event_type) OVER w AS ft, lead(a) OVER w AS fa FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, coalesce(event_type = bt AND a <= bz + 0.05, false) OR coalesce(event_type = ft AND fa <= z + 0.05, false) AS duplicate FROM l""")
def adjacent_repeats(spark, d):
    """Events of one type that follow each other before the earlier one's hours are over."""
    e = track(spark, d).withColumns({"a": F.col("us") / 1e6, "z": F.col("us") / 1e6 + 3600 * (1 + F.col("event_id") % 12)})
    return tracks.adjacent_duplicates(e, ["user_id"], ["us", "event_id"], "event_type", "a", "z").select("event_id", "duplicate")


EDGES = """e AS (SELECT o_custkey AS a, o_orderpriority AS b, l_orderkey * 8 + l_linenumber AS edge, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS a0, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))::DOUBLE AS a1,
  CASE WHEN l_linenumber % 3 = 0 THEN 1.05 ELSE 1.0 END AS ratio, 50.0 * (l_suppkey % 2) AS off, l_returnflag = 'R' AS same FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


@query(f"""WITH {EDGES}, f AS (SELECT *, max(a1) OVER w AS reach FROM e WHERE a0 < a1 WINDOW w AS (PARTITION BY a, b, ratio, off ORDER BY a0, edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a0 > reach + 0.002 THEN 1 ELSE 0 END) OVER (PARTITION BY a, b, ratio, off ORDER BY a0, edge ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT a::VARCHAR AS a, b, string_agg(edge::VARCHAR, ',' ORDER BY edge) AS edges, round(ratio * (max(a1) - min(a0)), 6) AS matched,
  CASE WHEN bool_or(same) THEN 'ACCEPTED_PERFORMANCE_REUSE' ELSE 'AUDIO_CORRESPONDENCE_OR_CANDIDATE' END AS status FROM g GROUP BY g.a, b, ratio, off, i""")
def fragment_appearances(spark, d):
    """Line items as matches of a customer's time within a priority's, at two speeds and two offsets."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    ratio = F.when(F.col("l_linenumber") % 3 == 0, 1.05).otherwise(1.0)
    e = rows.select(
        F.col("o_custkey").cast("string").alias("a"), F.col("o_orderpriority").alias("b"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge"), day("o_orderdate").alias("a_start"), day("l_shipdate").alias("a_end"),
        ratio.alias("ratio"), (50.0 * (F.col("l_suppkey") % 2)).alias("off"), F.lit(0.0).alias("tolerance"), (F.col("l_returnflag") == "R").alias("same")
    ).where("a_start < a_end")
    e = e.withColumns({"b_start": F.col("ratio") * F.col("a_start") + F.col("off"), "b_end": F.col("ratio") * F.col("a_end") + F.col("off")}).drop("off")
    found = signals.appearances(e)
    return found.select("a", "b", F.array_join("edges", ",").alias("edges"), r6("matched").alias("matched"), "status")


@query()
def transform_search(spark, d):
    """Each type's series against a copy that runs 1.05 times as fast."""
    rows = track(spark, d).select(F.col("event_type").alias("series"), F.struct("us", "event_id").alias("at"), "value")
    own = signals.number(rows, ["series"], "at", F.floor(F.col("at.us") / 3_600_000_000)).select("series", "sample_index", "value")
    # A copy's sample k lies at 1.05 k, between two samples.
    at = F.floor(F.col("sample_index") / 1.05 + 1).cast("long")
    k = F.explode(F.sequence(F.floor(F.col("sample_index") / 1.05).cast("long"), at))
    near = own.select("series", "sample_index", "value", k.alias("k")).withColumn("weight", 1 - F.abs(F.col("k") * 1.05 - F.col("sample_index"))).where("weight > 0")
    fast = near.groupBy("series", F.col("k").alias("sample_index")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    both = _named(own, "").unionByName(_named(fast, "fast "))
    told = own.select("series").distinct().select(F.col("series").alias("pair"), F.col("series").alias("query"), F.concat(F.lit("fast "), "series").alias("target"))
    found = signals.transformed(told, signals.blocks(both, ["series", "channel"], 8000), 8000, lengths=(0.125,), whole_s=0.25, least_s=0.12)
    return found.select("pair", "query_start", "query_end", "target_start", "target_end", r6("ratio").alias("ratio"), r6("semitones").alias("semitones"), r6("score").alias("score"), "kind")


def _series(spark, d):
    """Values of every user's series in order, as columns for passes over groups."""
    return track(spark, d).select("user_id", "us", "event_id", "value")


ORDER = ["us", "event_id"]


@query(f"""WITH {NUMBERED}, z AS (SELECT s.series, s.k, s.v - l.m AS v, l.n FROM s JOIN (SELECT series, avg(v) AS m, count(*) AS n FROM s GROUP BY series) l USING (series)),
r AS (SELECT p.series, q.k - p.k AS lag, sum(p.v * q.v) AS r, any_value(p.n) AS n FROM z p JOIN z q ON p.series = q.series AND q.k >= p.k GROUP BY p.series, q.k - p.k),
c AS (SELECT r.series, r.lag, r.r / o.r AS c, r.n FROM r JOIN r o ON o.series = r.series AND o.lag = 0 WHERE o.r > 0 AND r.lag < r.n // 2 OR r.lag = 0),
p AS (SELECT series, lag, c, n, lag(c) OVER w AS b, lead(c) OVER w AS e FROM c WHERE lag < n // 2 WINDOW w AS (PARTITION BY series ORDER BY lag)),
t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(c, 9) DESC, lag) AS place FROM p WHERE lag >= 2 AND c > b AND c >= e AND c > 0)
SELECT series, lag::INTEGER AS lag, round(c, 6) AS strength FROM t WHERE place <= 5""")
def series_periods(spark, d):
    """The five strongest lags of every user's series."""

    def step(g):
        found = kernels.periodicity(g["value"])
        return {"series": [g["user_id"][0]] * len(found), "lag": [k for k, _ in found], "strength": [round(s, 6) + 0.0 for _, s in found]}

    return by_group(_series(spark, d), ["user_id"], ORDER, step, "series long, lag int, strength double")


@query()
def series_warping(spark, d):
    """How far the halves of every user's series are apart along their best alignment."""

    def step(g):
        x = g["value"]
        f = np.column_stack([x[:-1], x[1:]])
        r = kernels.warp_distance(f[: len(f) // 2], f[len(f) // 2 :])
        return {"series": [g["user_id"][0]], "distance": [None if r is None else round(r, 6)]}

    return by_group(_series(spark, d), ["user_id"], ORDER, step, "series long, distance double")


@query()
def series_tempo(spark, d):
    """Beats a minute of every user's series, at a hundred samples a second."""

    def step(g):
        found = kernels.tempo(np.abs(np.diff(g["value"])), RATE, 300.0, 1500.0)
        return {"series": [g["user_id"][0]] * len(found), "place": list(range(1, len(found) + 1)), "bpm": [round(f, 6) for f in found]}

    return by_group(_series(spark, d), ["user_id"], ORDER, step, "series long, place int, bpm double")
