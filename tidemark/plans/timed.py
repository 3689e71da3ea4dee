"""Queries over intervals and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, intervals, tracks
from .base import HOUR, ISLANDS, SPAN_DAYS, SPANS, TRACK, day, query, r6, spans, table, track


@query(f"WITH {SPANS}, {ISLANDS} SELECT custkey, sum(end_s - start_s)::BIGINT AS covered, count(*) AS n_intervals FROM merged GROUP BY custkey")
def interval_union_by_source(spark, d):
    return intervals.covered(spans(spark, d), ["custkey"])


LO, HI = 8000, 11500


@query(f"""WITH {SPANS}, {ISLANDS}, clipped AS (SELECT custkey, greatest(start_s, {LO}) AS a, least(end_s, {HI}) AS z FROM merged WHERE start_s < {HI} AND end_s > {LO}),
edges AS (SELECT custkey, a, z, lag(z, 1, {LO}) OVER (PARTITION BY custkey ORDER BY a) AS before FROM clipped),
gaps AS (SELECT custkey, before AS start_s, a AS end_s FROM edges WHERE before < a
UNION ALL SELECT custkey, max(z), {HI} FROM clipped GROUP BY custkey HAVING max(z) < {HI}
UNION ALL SELECT DISTINCT custkey, {LO}, {HI} FROM spans WHERE custkey NOT IN (SELECT custkey FROM clipped))
SELECT custkey, start_s::BIGINT AS start_s, end_s::BIGINT AS end_s FROM gaps""")
def interval_gaps(spark, d):
    s = spans(spark, d)
    need = s.select("custkey").distinct().withColumns({"start_s": F.lit(LO).cast("long"), "end_s": F.lit(HI).cast("long")})
    return intervals.missing(need, s, ["custkey"], slack=0).select("custkey", "start_s", "end_s")


@query(f"""WITH {SPANS}, win AS (SELECT custkey, min(start_s) + 100 AS ws, min(start_s) + 400 AS we FROM spans GROUP BY custkey)
SELECT s.custkey, s.orderkey, s.line, greatest(s.start_s, ws) AS overlap_start, least(s.end_s, we) AS overlap_end, s.start_s >= ws AND s.end_s <= we AS whole
FROM spans s JOIN win w ON s.custkey = w.custkey AND s.start_s < we AND s.end_s > ws""")
def interval_overlap_join(spark, d):
    s = spans(spark, d)
    win = s.groupBy("custkey").agg((F.min("start_s") + 100).alias("ws"), (F.min("start_s") + 400).alias("we"))
    out = intervals.overlap_join(s, win, ["custkey"], "start_s", "end_s", "ws", "we", SPAN_DAYS)
    return out.select("custkey", "orderkey", "line", "overlap_start", "overlap_end", F.expr("start_s >= ws AND end_s <= we").alias("whole"))


@query(f"""WITH {SPANS}, win AS (SELECT custkey, min(start_s) + 100 AS ws, min(start_s) + 400 AS we FROM spans GROUP BY custkey)
SELECT CASE WHEN s.start_s >= ws AND s.end_s <= we THEN 'CONTAINED' ELSE 'CROSSING' END AS relation, count(*) AS n
FROM spans s JOIN win w ON s.custkey = w.custkey AND s.start_s < we AND s.end_s > ws GROUP BY 1""")
def contained_or_crossing(spark, d):
    s = spans(spark, d)
    win = s.groupBy("custkey").agg((F.min("start_s") + 100).alias("ws"), (F.min("start_s") + 400).alias("we"))
    return intervals.contained(s, win, ["custkey"], "start_s", "end_s", "ws", "we", SPAN_DAYS).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"""WITH {SPANS}, pts AS (SELECT o_custkey AS custkey, o_orderkey AS pkey, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS t FROM orders)
SELECT p.custkey, p.pkey, count(*) AS n_holding FROM pts p JOIN spans s ON p.custkey = s.custkey AND p.t >= s.start_s AND p.t < s.end_s GROUP BY ALL""")
def point_in_interval(spark, d):
    pts = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("pkey"), day("o_orderdate").alias("t"))
    return intervals.point_join(pts, spans(spark, d), ["custkey"], "t", "start_s", "end_s", SPAN_DAYS).groupBy("custkey", "pkey").agg(F.count("*").alias("n_holding"))


_AB = f"""WITH {SPANS}, a AS (SELECT custkey, start_s, end_s FROM spans WHERE line = 1), b AS (SELECT custkey, start_s, end_s FROM spans WHERE line = 2), c AS (SELECT custkey, start_s, end_s FROM spans WHERE line = 3)
SELECT a.custkey, greatest(a.start_s, b.start_s, c.start_s) AS start_s, least(a.end_s, b.end_s, c.end_s) AS end_s FROM a JOIN b ON a.custkey = b.custkey AND a.start_s < b.end_s AND b.start_s < a.end_s
JOIN c ON a.custkey = c.custkey AND greatest(a.start_s, b.start_s, c.start_s) < least(a.end_s, b.end_s, c.end_s)"""


@query(_AB)
def three_way_intersection(spark, d):
    s = spans(spark, d)
    a, b, c = (s.where(F.col("line") == k).select("custkey", "start_s", "end_s") for k in (1, 2, 3))
    return intervals.intersect3(a, b, c, ["custkey"], SPAN_DAYS)


@query(f"""WITH {SPANS}, seg AS (SELECT custkey, orderkey, min(start_s) AS child_start, max(end_s) AS child_end FROM spans GROUP BY ALL),
j AS (SELECT s.custkey, s.orderkey, s.line, greatest(s.start_s, child_start) AS a, least(s.end_s, child_end) AS z, child_start, g.orderkey AS segment FROM spans s JOIN seg g ON s.custkey = g.custkey AND s.start_s < child_end AND s.end_s > child_start)
SELECT custkey, orderkey, line, segment, round(1000.0 + (a - child_start) * 2.0, 6) AS parent_from, round(1000.0 + (z - child_start) * 2.0, 6) AS parent_to FROM j""")
def affine_mapping(spark, d):
    s = spans(spark, d)
    seg = s.groupBy("custkey", F.col("orderkey").alias("segment")).agg(F.min("start_s").alias("child_start"), F.max("end_s").alias("child_end"))
    seg = seg.withColumns({"parent_start": F.lit(1000.0), "parent_end": F.lit(1000.0) + 2 * (F.col("child_end") - F.col("child_start"))})
    out = intervals.map_affine(s, seg, ["custkey"], SPAN_DAYS)
    return out.select("custkey", "orderkey", "line", "segment", r6("parent_from").alias("parent_from"), r6("parent_to").alias("parent_to"))


@query(f"""WITH {SPANS}, {ISLANDS} SELECT custkey, start_s, spread, n FROM (SELECT custkey, island, min(start_s) AS start_s, max(line) - min(line) AS spread, count(*) AS n FROM marked GROUP BY custkey, island)""")
def onset_spread(spark, d):
    return intervals.onset_spread(spans(spark, d), ["custkey"], "start_s", "end_s", "line").select("custkey", "start_s", "spread", "n")


@query(f"""WITH {SPANS}, {ISLANDS}, req AS (SELECT o_orderkey AS req_id, o_custkey AS custkey, (datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 20)::DOUBLE AS req_start, (datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 90)::DOUBLE AS req_end FROM orders),
p AS (SELECT req_id, sum((least(req_end, end_s) - greatest(req_start, start_s)) * 10)::BIGINT AS samples FROM req JOIN merged USING (custkey) WHERE start_s < req_end AND end_s > req_start GROUP BY req_id)
SELECT req_id, coalesce(samples, 0) AS samples, CASE WHEN samples IS NULL THEN 'MISSING' WHEN samples >= 699 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM req LEFT JOIN p USING (req_id)""")
def sample_selection(spark, d):
    seg = intervals.union(spans(spark, d), ["custkey"]).select("custkey", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), F.lit(10.0).alias("rate"))
    req = table(spark, d, "orders").select(F.col("o_orderkey").alias("req_id"), F.col("o_custkey").alias("custkey"), (day("o_orderdate") + 20).cast("double").alias("req_start"), (day("o_orderdate") + 90).cast("double").alias("req_end"))
    return intervals.selection_status(seg, req, ["custkey"], SPAN_DAYS).select("req_id", "samples", "status")


_ASOF = f"""WITH {TRACK}, l AS (SELECT * FROM track WHERE event_type = 'view'), r AS (SELECT user_id, us AS t, min(event_id) AS id FROM track WHERE event_type = 'purchase' GROUP BY ALL),
b AS (SELECT l.event_id, l.user_id, l.us, r.t AS before_t, r.id AS before_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.t),
x AS (SELECT b.*, r.t AS after_t, r.id AS after_id FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.us <= r.t),
n AS (SELECT *, CASE WHEN after_t IS NULL OR (before_t IS NOT NULL AND us - before_t <= after_t - us) THEN before_id ELSE after_id END AS near_id,
  CASE WHEN after_t IS NULL OR (before_t IS NOT NULL AND us - before_t <= after_t - us) THEN before_t ELSE after_t END AS near_t FROM x)"""


def _view_purchase(spark, d):
    t = track(spark, d)
    left = t.where("event_type = 'view'").select("event_id", "user_id", "us")
    right = t.where("event_type = 'purchase'").select("user_id", F.col("us").alias("t"), F.col("event_id").alias("id"))
    return left, right


@query(_ASOF + " SELECT event_id, near_id, abs(us - near_t) AS distance_us FROM n")
def asof_nearest(spark, d):
    out = asof.choose(asof.nearest(*_view_purchase(spark, d), ["user_id"], "us", "t", "id"), "us", 6 * HOUR)
    return out.select("event_id", "near_id", F.abs(F.col("us") - F.col("near_t")).alias("distance_us"))


@query(_ASOF + " SELECT event_id, after_id, CASE WHEN after_id IS NULL THEN 'NO_FRAME' ELSE 'FOUND' END AS status FROM n")
def asof_forward(spark, d):
    return asof.forward(*_view_purchase(spark, d), ["user_id"], "us", "t", "id").select("event_id", "after_id", "status")


@query(_ASOF + f" SELECT CASE WHEN before_t IS NULL OR after_t IS NULL THEN 'OUTSIDE_FRAME_POINT_RANGE' WHEN abs(us - near_t) <= {6 * HOUR} THEN 'NEARBY' ELSE 'DISTANT' END AS status, count(*) AS n FROM n GROUP BY 1")
def asof_status(spark, d):
    out = asof.choose(asof.nearest(*_view_purchase(spark, d), ["user_id"], "us", "t", "id"), "us", 6 * HOUR)
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {TRACK}, w AS (SELECT user_id, min(us) + {24 * HOUR} AS a, min(us) + {96 * HOUR} AS z FROM track GROUP BY user_id)
SELECT user_id, count(*) FILTER (us >= a AND us < z) AS n_centers, count(*) FILTER (us - {HOUR} >= a AND us + {HOUR} <= z) AS n_contained FROM track JOIN w USING (user_id) GROUP BY user_id""")
def window_contained_vs_centers(spark, d):
    t = track(spark, d)
    w = t.groupBy("user_id").agg((F.min("us") + 24 * HOUR).alias("a"), (F.min("us") + 96 * HOUR).alias("z"))
    return t.join(w, "user_id").groupBy("user_id").agg(F.count_if(F.expr("us >= a AND us < z")).alias("n_centers"), F.count_if(F.expr(f"us - {HOUR} >= a AND us + {HOUR} <= z")).alias("n_contained"))


@query(f"""WITH {TRACK}, q AS (SELECT user_id, event_type, count(*) AS n_rows, 1.0::DOUBLE AS voiced_fraction, quantile_cont(value, 0.1) AS p10, median(value) AS median, quantile_cont(value, 0.9) AS p90,
  CASE WHEN count(*) >= 5 AND max(us) > min(us) THEN regr_slope(value, us / {HOUR}.0) END AS slope, 10 * log10(avg(pow(10.0, value / 10))) AS power_mean, max(value) AS peak, avg((value < 20)::INT::DOUBLE) AS quiet_fraction FROM track GROUP BY ALL)
SELECT user_id, event_type, n_rows, voiced_fraction, round(p10, 6) AS p10, round(median, 6) AS median, round(p90, 6) AS p90, round(p90 - p10, 6) AS span, round(slope, 6) AS slope, round(power_mean, 6) AS power_mean, peak, round(quiet_fraction, 6) AS quiet_fraction,
  n_rows >= 3 AS eligible FROM q""")
def track_query_stats(spark, d):
    t = track(spark, d).withColumn("h", F.col("us") / float(HOUR))
    out = tracks.describe(t, ["user_id", "event_type"], "value", "h", 20.0)
    return out.select("user_id", "event_type", "n_rows", "voiced_fraction", *[r6(c).alias(c) for c in ("p10", "median", "p90", "span", "slope", "power_mean")], "peak", r6("quiet_fraction").alias("quiet_fraction"), "eligible")


@query(f"WITH {TRACK} SELECT user_id, round(10 * log10(avg(pow(10.0, value / 10))), 6) AS power_mean, round(avg(value), 6) AS plain_mean FROM track GROUP BY user_id")
def power_mean_level(spark, d):
    return track(spark, d).groupBy("user_id").agg(r6(tracks.power_mean(F.col("value"))).alias("power_mean"), r6(F.avg("value")).alias("plain_mean"))


@query("""WITH g AS (SELECT 10 * log10(avg(pow(10.0, value / 10)) FILTER (event_type = 'view')) AS la, 10 * log10(avg(pow(10.0, value / 10)) FILTER (event_type = 'click')) AS lb,
  median(value) FILTER (event_type = 'view') AS pa, median(value) FILTER (event_type = 'click') AS pb FROM events)
SELECT round(lb - la, 6) AS level_change_db, round(12 * log2(pb / pa), 6) AS semitones FROM g""")
def interval_contrast(spark, d):
    out = tracks.contrast(track(spark, d), "event_type", "view", "click", "value", "value")
    return out.select(r6("level_change_db").alias("level_change_db"), r6("semitones").alias("semitones"))


@query(f"""WITH {TRACK}, l AS (SELECT event_id, us, value, lag(us) OVER w AS pu, lag(value) OVER w AS pv FROM track WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT event_id, round(12 * log2(value / pv), 6) AS semitones FROM l WHERE us - pu <= {12 * HOUR} AND abs(12 * log2(value / pv)) >= 10""")
def adjacent_jumps(spark, d):
    return tracks.jumps(track(spark, d), ["user_id"], "us", "value", 12 * HOUR, 10.0, ties=["event_id"]).select("event_id", r6("semitones").alias("semitones"))


@query(f"""WITH {TRACK}, l AS (SELECT *, value < 30 AS quiet, lag(value < 30) OVER w AS pq, us - lag(us) OVER w AS gap FROM track WINDOW w AS (PARTITION BY user_id ORDER BY us)),
c AS (SELECT *, sum(CASE WHEN quiet AND (NOT coalesce(pq, false) OR gap > {24 * HOUR}) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_rows, min(value) AS floor FROM c WHERE quiet GROUP BY user_id, run""")
def quiet_runs(spark, d):
    runs = tracks.quiet_runs(track(spark, d), ["user_id"], "us", "value", 30.0, 24 * HOUR)
    return runs.select("user_id", F.col("start_s").alias("start_us"), F.col("end_s").alias("end_us"), "n_rows", "floor")


@query(f"""WITH {TRACK}, e AS (SELECT *, us / {HOUR}.0 AS h, min(us / {HOUR}.0) OVER (PARTITION BY user_id) AS a, max(us / {HOUR}.0) OVER (PARTITION BY user_id) AS z FROM track)
SELECT user_id, count(*) AS n_points, round(CASE WHEN count(*) >= 5 AND max(h) > min(h) THEN regr_slope(value, h) END, 6) AS final_slope FROM e WHERE h >= z - least(100.0, 0.2 * (z - a)) GROUP BY user_id""")
def phrase_final_slope(spark, d):
    t = track(spark, d).withColumn("h", F.col("us") / float(HOUR))
    return tracks.final_slope(t, ["user_id"], "h", "value", 100.0, 0.2).withColumn("final_slope", r6("final_slope"))


@query("""SELECT conv_id, turn, role, coalesce(text = lag(text) OVER w, false) OR coalesce(text = lead(text) OVER w, false) AS duplicate FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def adjacent_duplicates(spark, d):
    return tracks.adjacent_duplicates(table(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], "text").select("conv_id", "turn", "role", "duplicate")


@query(f"""WITH {TRACK}, e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 60000000 END AS dur, max(us) OVER (PARTITION BY user_id) AS fin FROM track),
l AS (SELECT *, lead(us) OVER w - us AS nx, us - lag(us) OVER w AS pv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT event_id, coalesce(dur, nx, nullif(greatest(fin - us, 0), 0), pv) AS extent, CASE WHEN dur IS NOT NULL THEN 'EXPLICIT' WHEN nx IS NOT NULL THEN 'NEXT_PTS' WHEN fin > us THEN 'STREAM_END' WHEN pv IS NOT NULL THEN 'PREVIOUS_DELTA' ELSE 'UNKNOWN' END AS method FROM l""")
def extent_fill(spark, d):
    from pyspark.sql.window import Window

    t = track(spark, d).withColumns({"dur": F.when(F.col("event_id") % 3 == 0, F.lit(60_000_000).cast("long")), "fin": F.max("us").over(Window.partitionBy("user_id"))})
    return tracks.fill_extent(t, ["user_id"], "us", "dur", "fin").select("event_id", "extent", "method")


@query(f"""WITH {TRACK}, l AS (SELECT *, CASE WHEN abs(us - lag(us + {2 * HOUR}) OVER w) <= {8 * HOUR} THEN 0 ELSE 1 END AS fresh FROM track WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS segment FROM l)
SELECT user_id, min(us) AS start_us, max(us) + {2 * HOUR} AS end_us, count(*) AS n_rows FROM s GROUP BY user_id, segment""")
def segment_islands(spark, d):
    t = track(spark, d).withColumn("e", F.col("us") + 2 * HOUR)
    out = tracks.sessions(t, ["user_id"], "us", "e", 8 * HOUR)
    return out.select("user_id", F.col("start_s").alias("start_us"), F.col("end_s").alias("end_us"), "n_rows")


@query(f"""WITH {TRACK}, l AS (SELECT event_id, us - lag(us + {HOUR}) OVER w AS gap, event_type <> 'error' AND lag(event_type <> 'error') OVER w AS ok FROM track WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT event_id, gap, CASE WHEN ok THEN gap END AS latency FROM l""")
def response_gap(spark, d):
    t = track(spark, d).withColumns({"e": F.col("us") + HOUR, "ok": F.col("event_type") != "error"})
    return tracks.response_gaps(t, ["user_id"], "us", "e", "ok").select("event_id", "gap", "latency")


@query(f"""WITH {TRACK}, c AS (SELECT user_id, us AS s FROM track WHERE event_type = 'error'), m AS (SELECT min(us) AS lo, max(us) + 1 AS hi FROM track),
e AS (SELECT user_id, s FROM c, m WHERE s > lo AND s < hi UNION SELECT DISTINCT user_id, lo FROM c, m)
SELECT user_id, s AS start_us, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s), hi) AS end_us FROM e, m""")
def shot_spans(spark, d):
    t = track(spark, d)
    lo, hi = t.agg(F.min("us"), F.max("us") + 1).first()
    out = tracks.spans_from_points(t.where("event_type = 'error'"), ["user_id"], "us", lo, hi)
    return out.select("user_id", F.col("start_s").alias("start_us"), F.col("end_s").alias("end_us"))


@query(f"""WITH {TRACK}, b AS (SELECT floor(event_id / 64)::BIGINT AS frame, value AS l, coalesce((json_extract(props, '$.k'))::DOUBLE, 0) AS r FROM track),
a AS (SELECT frame, avg(pow((l + r) / 2, 2)) AS mid_energy, avg(pow((l - r) / 2, 2)) AS side_energy, avg(l * r) - avg(l) * avg(r) AS c, sqrt(greatest(0, (avg(l * l) - pow(avg(l), 2)) * (avg(r * r) - pow(avg(r), 2)))) AS s FROM b GROUP BY frame)
SELECT frame, round(mid_energy, 4) AS mid_energy, round(side_energy, 4) AS side_energy, round(CASE WHEN s = 0 THEN NULL ELSE c / s END, 4) AS correlation FROM a""")
def stereo_correlation(spark, d):
    t = track(spark, d).select(F.floor(F.col("event_id") / 64).alias("frame"), F.col("value").alias("l"), F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)).alias("r"))
    return tracks.stereo(t, ["frame"], "l", "r").select("frame", *[F.round(c, 4).alias(c) for c in ("mid_energy", "side_energy", "correlation")])


@query("SELECT user_id, floor(event_id / 500)::BIGINT AS bin, min(value) AS low, max(value) AS high, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY ALL")
def waveform_bins(spark, d):
    return tracks.waveform(table(spark, d, "events"), ["user_id"], "event_id", "value", 500).withColumn("rms", r6("rms"))


@query(f"""WITH {TRACK}, s AS (SELECT user_id, value, CASE WHEN value - 50 >= 0 THEN 1 ELSE -1 END AS g, lag(CASE WHEN value - 50 >= 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY us) AS p FROM track)
SELECT user_id, round(sqrt(avg((value - 50) * (value - 50))), 6) AS rms, round(max(abs(value - 50)), 6) AS peak, round(CASE WHEN count(*) = 1 THEN NULL ELSE sum(CASE WHEN g <> p THEN 1 ELSE 0 END) / (count(*) - 1) END, 6) AS zcr FROM s GROUP BY user_id""")
def zero_crossings(spark, d):
    t = track(spark, d).withColumn("v", F.col("value") - 50)
    return tracks.zero_crossings(t, ["user_id"], "us", "v").select("user_id", *[r6(c).alias(c) for c in ("rms", "peak", "zcr")])


@query("""WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events)
SELECT user_id, least(floor(i * 10 / 100), 9)::BIGINT AS bin, max(value) AS peak, count(*) AS n FROM n GROUP BY ALL""")
def pooled_overview(spark, d):
    from pyspark.sql.window import Window

    n = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1)
    return tracks.pooled(n, ["user_id"], "i", "value", 10, 100)


@query("SELECT event_id, rn::INTEGER AS rn FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events) WHERE (rn - 1) % 7 = 0")
def downsample(spark, d):
    return tracks.every_kth(table(spark, d, "events"), ["user_id"], ["ts"], 7).select("event_id", "rn")


@query(f"""WITH {TRACK}, l AS (SELECT event_id, us, lag(us) OVER (PARTITION BY user_id ORDER BY value, event_id) AS p FROM track) SELECT event_id FROM l WHERE us <= p""")
def clock_violations(spark, d):
    from pyspark.sql.window import Window

    n = track(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")))
    return tracks.monotone_violations(n, ["user_id"], "k", "us").select("event_id")


@query("""WITH m AS (SELECT *, median(value) OVER (PARTITION BY event_type) AS md FROM events)
SELECT event_type, count(*) AS n, round(any_value(md), 6) AS median, round(median(abs(value - md)), 6) AS mad, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, CASE WHEN count(*) < 2000 THEN 'OPEN' ELSE 'READY' END AS status FROM m GROUP BY event_type""")
def robust_baseline(spark, d):
    out = tracks.robust_baseline(table(spark, d, "events"), ["event_type"], "value", 2000)
    return out.select("event_type", "n", *[r6(c).alias(c) for c in ("median", "mad", "p10", "p90")], "status")


@query(f"""WITH {TRACK}, w AS (SELECT event_id, us, min(us) OVER (PARTITION BY user_id) AS a, 10 * log10(avg(pow(10.0, value / 10)) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {48 * HOUR} PRECEDING AND CURRENT ROW)) AS s FROM track)
SELECT event_id, round(CASE WHEN us - a >= {48 * HOUR} THEN s END, 4) AS trailing FROM w""")
def trailing_level(spark, d):
    return tracks.trailing(track(spark, d), ["user_id"], "us", "value", 48 * HOUR).select("event_id", F.round("trailing", 4).alias("trailing"))


@query(f"""WITH {TRACK}, m AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS md, max(value) OVER (PARTITION BY user_id) AS top, lag(value) OVER w AS p, lead(value) OVER w AS n FROM track WINDOW w AS (PARTITION BY user_id ORDER BY us)),
x AS (SELECT *, median(abs(value - md)) OVER (PARTITION BY user_id) AS mad FROM m)
SELECT event_id, value FROM x WHERE value > md + greatest(3 * mad, 0.1 * top) AND value > coalesce(p, '-infinity'::DOUBLE) AND value >= coalesce(n, '-infinity'::DOUBLE)""")
def onset_candidates(spark, d):
    return tracks.onsets(track(spark, d), ["user_id"], "us", "value").select("event_id", "value")
