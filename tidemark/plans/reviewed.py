"""Queries over declared reviews, compared tracks, clips, typed edges and baselines; rows of orders and events stand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contours, graph, readings, reviews
from .base import query, r6, table


@query("""WITH m AS (SELECT user_id % 40 AS speaker, user_id || '/' || (event_id % 3) AS performance, event_id AS row_no, value,
    CASE WHEN event_type = 'error' THEN 1 WHEN NOT (event_id % 11 <> 0) THEN 2 WHEN event_type = 'view' THEN 3 END AS reason FROM events),
f AS (SELECT speaker, value FROM (SELECT *, row_number() OVER (PARTITION BY speaker, performance ORDER BY row_no) AS k FROM m WHERE reason IS NULL) WHERE k = 1),
w AS (SELECT speaker, value, median(value) OVER (PARTITION BY speaker) AS mid FROM f),
g AS (SELECT speaker, count(value) AS n, any_value(mid) AS median, median(abs(value - mid)) AS mad, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM w GROUP BY speaker)
SELECT speaker, n, CASE WHEN n >= 4 THEN round(median, 6) END AS median, CASE WHEN n >= 4 THEN round(mad, 6) END AS mad, CASE WHEN n >= 4 THEN round(p10, 6) END AS p10, CASE WHEN n >= 4 THEN round(p90, 6) END AS p90,
  CASE WHEN n >= 4 THEN 'MEASURED_DISTRIBUTION' ELSE 'OPEN' END AS status FROM g""")
def vocal_distributions(spark, d):
    """Baselines of speakers over performances that count once each; errors, unreviewed and flagged rows are left out."""
    e = table(spark, d, "events")
    rows = e.select(
        (F.col("user_id") % 40).alias("speaker"), F.concat_ws("/", "user_id", F.col("event_id") % 3).alias("performance_id"), F.col("event_id").alias("row_no"),
        F.when(F.col("event_type") != "error", "verified_voice").otherwise("unknown").alias("vocal_status"), F.lit("performance").alias("unit_kind"), F.lit("isolated_voice_asset").alias("quality"),
        F.lit("non_singing_dialogue").alias("segment_type"), F.when(F.col("event_type") == "view", 1).otherwise(0).alias("n_flags"), (F.col("event_id") % 11 != 0).alias("quality_reviewed"), F.col("value").alias("f0"),
    )
    found = contours.vocal_baseline(rows, 4, ["f0"])
    return found.select("speaker", "n", *[r6(c).alias(c) for c in ("median", "mad", "p10", "p90")], "status")


@query("""WITH t AS (SELECT o_orderkey AS k, o_custkey % 900 AS frames, CASE WHEN o_orderkey % 5 > 0 THEN 'stereo' END AS la, CASE WHEN o_orderkey % 9 = 0 THEN 'mono' ELSE 'stereo' END AS lb, 0.001 * (o_orderkey % 3) AS tol FROM orders),
s AS (SELECT l_orderkey AS k, l_linenumber AS n, 0.001 * (l_linenumber % 3) AS moved, CASE WHEN l_suppkey % 50 = 0 THEN 1 ELSE 0 END AS more, trunc(l_quantity)::BIGINT AS q FROM lineitem),
g AS (SELECT t.k, bool_and(y.moved <= t.tol + 1e-12 AND x.q = y.q + y.more) AS ok FROM t JOIN s x ON x.k = t.k JOIN s y ON y.k = t.k AND y.n = x.n GROUP BY t.k),
f AS (SELECT t.k, t.k % 7 <> 0 AS samples_equal, CASE WHEN la IS NULL THEN 'UNKNOWN' WHEN la = lb THEN 'MATCH' ELSE 'DIFFERENT' END AS layout, coalesce(g.ok, true) AS timing_equal FROM t LEFT JOIN g USING (k))
SELECT k AS pair, samples_equal, layout, timing_equal, CASE WHEN NOT samples_equal OR NOT timing_equal OR layout = 'DIFFERENT' THEN 'DIFFERENT' WHEN layout = 'UNKNOWN' THEN 'INDETERMINATE' ELSE 'MATCH' END AS status FROM f""")
def track_comparisons(spark, d):
    """Every order as a track with its lines as segments, against a copy with other frames, layouts and clocks here and there."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    k = F.col("o_orderkey")
    own = F.struct(F.concat(F.lit("a"), k).alias("track"), (F.col("o_custkey") % 900).alias("frames"), F.when(k % 5 > 0, "stereo").alias("layout"))
    copy = F.struct(F.concat(F.lit("b"), k).alias("track"), (F.col("o_custkey") % 900 + F.when(k % 7 == 0, 1).otherwise(0)).alias("frames"), F.when(k % 9 == 0, "mono").otherwise("stereo").alias("layout"))
    tolerance = (k % 3) * 0.001 + 1e-12
    tracks = o.select(F.explode(F.array(own, copy)).alias("t"), tolerance.alias("tolerance")).select("t.track", F.lit("x").alias("pcm_sha256"), "t.frames", F.lit(48000).alias("rate"), F.lit(2).alias("channels"), "t.layout", "tolerance")
    lk, n, q = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("long")
    a = F.struct(F.concat(F.lit("a"), lk).alias("track"), (n * 100).cast("long").alias("sample_start"), (n * 100 + q).alias("sample_end"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"))
    moved = (n % 3) * 0.001
    b = F.struct(F.concat(F.lit("b"), lk).alias("track"), (n * 100).cast("long").alias("sample_start"), (n * 100 + q + F.when(F.col("l_suppkey") % 50 == 0, 1).otherwise(0)).alias("sample_end"), moved.alias("start_s"), F.lit(1.0).alias("end_s"))
    segments = li.select(F.explode(F.array(a, b)).alias("s"), n.alias("segment_no")).select("s.track", "segment_no", "s.sample_start", "s.sample_end", "s.start_s", "s.end_s")
    pairs = o.select(k.alias("pair"), F.concat(F.lit("a"), k).alias("a"), F.concat(F.lit("b"), k).alias("b"))
    return reviews.compare_tracks(tracks, segments, pairs)


@query("""WITH m AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), g AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_tax > 0.07), s AS (SELECT l_orderkey AS k, max(l_discount) AS d FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS clip, CASE WHEN coalesce(m.n, 0) = 0 THEN 'UNMATCHED' WHEN m.n > 1 THEN 'AMBIGUOUS' WHEN coalesce(s.d, 0) > 0.085 THEN 'DRIFTING' WHEN g.k IS NOT NULL THEN 'PARTIAL' ELSE 'ADMITTED' END AS status
FROM orders LEFT JOIN m ON m.k = o_orderkey LEFT JOIN g ON g.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey""")
def clip_admission(spark, d):
    """Orders as clips: returned lines are places where one matches, high taxes are gaps, discounts the spread of its clock."""
    li = table(spark, d, "lineitem").withColumn("clip", F.col("l_orderkey"))
    clips = table(spark, d, "orders").select(F.col("o_orderkey").alias("clip"))
    spread = li.groupBy("clip").agg(F.max("l_discount").cast("double").alias("spread"))
    return reviews.admit_clip(clips, li.where("l_returnflag = 'R'"), li.where("l_tax > 0.07"), spread, 0.085)


@query("""WITH n AS (SELECT l_orderkey * 8 + l_linenumber AS node, l_orderkey AS k FROM lineitem), h AS (SELECT k, min(node) AS first FROM n GROUP BY k),
g AS (SELECT h.k, least(h.first, coalesce(p.first, h.first)) AS grp FROM h LEFT JOIN h p ON p.k = CASE WHEN h.k % 2 = 0 THEN h.k + 1 ELSE h.k - 1 END)
SELECT n.node, g.grp AS "group" FROM n JOIN g USING (k)""")
def dependent_observations(spark, d):
    """Lines that share an order have one origin; an even order leads to the odd one after it."""
    li = table(spark, d, "lineitem")
    nodes = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node"), F.col("l_orderkey").alias("origin"), F.lit(None).cast("long").alias("assumption"))
    heads = nodes.groupBy("origin").agg(F.min("node").alias("head"))
    src, dst = heads.where("origin % 2 = 0").select(F.col("head").alias("src"), (F.col("origin") + 1).alias("origin")), heads.select("origin", F.col("head").alias("dst"))
    return graph.dependence_groups(nodes, src.join(dst, "origin").select("src", "dst"))


@query("""WITH n AS (SELECT 'p' || p_partkey AS node, CASE WHEN p_partkey % 3 = 0 THEN 'claim' ELSE 'observation' END AS kind FROM part WHERE p_partkey % 50 <> 0 UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'observation' ELSE 'claim' END FROM supplier),
e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS relation, count(*) AS n FROM lineitem GROUP BY ALL),
v AS (SELECT e.src, e.dst, e.relation, list_filter([CASE WHEN e.n > 1 THEN 'repeated' END, CASE WHEN a.kind IS NULL OR b.kind IS NULL THEN 'dangling' END, CASE WHEN a.kind = 'claim' AND b.kind = 'observation' THEN 'claim to observation' END], lambda x: x IS NOT NULL) AS v
  FROM e LEFT JOIN n a ON a.node = e.src LEFT JOIN n b ON b.node = e.dst) SELECT src, dst, relation, array_to_string(v, ',') AS violations FROM v WHERE len(v) > 0""")
def typed_edges(spark, d):
    """Lines as edges from parts to suppliers: repeated ones, ones to parts that aren't kept, and claims that lead to observations."""
    parts = table(spark, d, "part").where("p_partkey % 50 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.when(F.col("p_partkey") % 3 == 0, "claim").otherwise("observation").alias("kind"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 2 == 0, "observation").otherwise("claim").alias("kind"))
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"))
    found = graph.edge_violations(edges, parts.unionByName(suppliers))
    return found.select("src", "dst", "relation", F.array_join("violations", ",").alias("violations"))


READINGS = """v AS (SELECT l_orderkey AS reading, l_linenumber AS version, l_suppkey % 4 AS place, sha256('{"reading":' || l_orderkey || ',"place":' || (l_suppkey % 4) || '}') AS digest FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
t AS (SELECT *, version = max(version) OVER (PARTITION BY reading) AS latest FROM v),
x AS (SELECT l_orderkey AS reading, l_partkey * 8 + l_linenumber AS decision_id, CASE WHEN l_returnflag = 'R' THEN 'REJECT' ELSE 'ACCEPT' END AS decision, sha256('{"reading":' || l_orderkey || ',"place":' || (l_partkey % 5) || '}') AS digest FROM lineitem),
s AS (SELECT reading, digest, max(latest) AS latest FROM t GROUP BY ALL),
j AS (SELECT x.reading, decision_id, decision, CASE WHEN s.latest IS NULL THEN 'UNKNOWN_DIGEST' WHEN s.latest THEN 'APPLIES' ELSE 'STALE' END AS status FROM x LEFT JOIN s ON s.reading = x.reading AND s.digest = x.digest)"""


def _readings(spark, d):
    li = table(spark, d, "lineitem")
    own = li.groupBy(F.col("l_orderkey").alias("reading"), F.col("l_linenumber").alias("version")).agg((F.max("l_suppkey") % 4).alias("place"))
    frozen = readings.freeze(own, "reading", "version", ["place"])
    told = F.sha2(F.to_json(F.struct(F.col("l_orderkey").alias("reading"), (F.col("l_partkey") % 5).alias("place"))), 256)
    decisions = li.select(F.col("l_orderkey").alias("reading"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("decision_id"), F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("ACCEPT").alias("decision"), told.alias("told_digest"))
    return frozen, readings.judge(decisions, frozen, "reading")


@query(f"WITH {READINGS} SELECT reading, decision_id, decision, status FROM j")
def judged_readings(spark, d):
    """Lines as versions of an order's reading, and decisions that were made on one of its states or on none."""
    return _readings(spark, d)[1].select("reading", "decision_id", "decision", "status")


@query(f"""WITH {READINGS}, g AS (SELECT reading, min(decision) FILTER (status = 'APPLIES') AS a, max(decision) FILTER (status = 'APPLIES') AS z, count(*) FILTER (status = 'STALE') AS n_stale FROM j GROUP BY reading)
SELECT t.reading, t.digest, CASE WHEN a IS NULL THEN 'OPEN' WHEN a = z THEN a ELSE 'CONFLICT' END AS state, coalesce(n_stale, 0) AS n_stale FROM t LEFT JOIN g ON g.reading = t.reading WHERE t.latest""")
def projected_readings(spark, d):
    """The latest state of every reading under the decisions that still apply to it."""
    return readings.projected(*_readings(spark, d), "reading", "decision")
