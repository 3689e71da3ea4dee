import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, intervals


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, start_s double, end_s double")


def draw(rng, n):
    rows = []
    for _ in range(n):
        a = rng.randrange(0, 60)
        rows.append((rng.choice("xy"), float(a), float(a + rng.randrange(-1, 9))))
    return rows


def cells(rows):
    return {(k, t) for k, a, z in rows for t in range(int(a), int(z))}


@pytest.mark.parametrize("seed", range(4))
def test_union_and_missing_equal_a_grid(spark, seed):
    rng = random.Random(seed)
    need, have = draw(rng, 12), draw(rng, 15)
    merged = [tuple(r) for r in intervals.union(frame(spark, have), ["k"]).collect()]
    assert cells(merged) == cells(have)
    assert len(merged) == len({(k, a) for k, a, _ in merged})
    gaps = [tuple(r) for r in intervals.missing(frame(spark, need), frame(spark, have), ["k"]).collect()]
    assert cells(gaps) == cells(need) - cells(have)


@pytest.mark.parametrize("width", [1.0, 7.0, 100.0])
def test_overlap_join_equals_nested_loops(spark, width):
    rng = random.Random(3)
    left, right = draw(rng, 30), draw(rng, 30)
    a = frame(spark, left).withColumnsRenamed({"start_s": "ls", "end_s": "le"})
    b = frame(spark, right).withColumnsRenamed({"start_s": "rs", "end_s": "re"})
    got = sorted(tuple(r) for r in intervals.overlap_join(a, b, ["k"], "ls", "le", "rs", "re", width).select("k", "ls", "le", "rs", "re").collect())
    want = sorted((k, x, y, u, v) for k, x, y in left if x < y for j, u, v in right if u < v and j == k and x < v and u < y)
    assert got == want


def test_point_join(spark):
    pts = spark.createDataFrame([("x", 0.0), ("x", 2.0), ("x", 5.0), ("y", 1.0)], "k string, t double")
    spans = frame(spark, [("x", 0.0, 2.0), ("x", 1.0, 5.0)])
    got = sorted((r.k, r.t, r.start_s) for r in intervals.point_join(pts, spans, ["k"], "t", "start_s", "end_s", 2.0).collect())
    assert got == [("x", 0.0, 0.0), ("x", 2.0, 1.0)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert intervals.union(none, ["k"]).count() == 0
    assert intervals.missing(none, none, ["k"]).count() == 0


def test_segment_violations(spark):
    rows = [("a", 0.0, 1.0, 0.0, 1.0), ("a", 0.5, 1.5, 2.0, 3.0), ("b", 0.0, 1.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, child_start double, child_end double, parent_start double, parent_end double")
    got = {(r.k, tuple(r.violations)) for r in intervals.segment_violations(df, ["k"], 0.01).collect()}
    assert got == {("a", ("child overlap",)), ("b", ("rate",))}


def test_asof_ties_and_ends(spark):
    left = spark.createDataFrame([(1, "x", 5.0), (2, "x", 0.5), (3, "y", 1.0)], "id int, k string, t double")
    right = spark.createDataFrame([("x", 4.0, 9), ("x", 6.0, 7), ("x", 6.0, 3)], "k string, ft double, fid int")
    out = {r.id: (r.near_id, r.status) for r in asof.choose(asof.nearest(left, right, ["k"], "t", "ft", "fid"), "t", 1.0).collect()}
    assert out[1] == (9, "NEARBY")
    assert out[2] == (9, "OUTSIDE_FRAME_POINT_RANGE")
    assert out[3] == (None, "OUTSIDE_FRAME_POINT_RANGE")
    ahead = {r.id: (r.after_id, r.status) for r in asof.forward(left, right, ["k"], "t", "ft", "fid").collect()}
    assert ahead == {1: (3, "FOUND"), 2: (9, "FOUND"), 3: (None, "NO_FRAME")}


def test_caption_proximity_pins(spark):
    cues = spark.createDataFrame([(1, 0.4), (2, 2.85)], "id int, t double").withColumn("k", F.lit("s"))
    frames = spark.createDataFrame([("s", 0.0, 0), ("s", 2.0, 1)], "k string, ft double, fid int")
    out = {r.id: r.status for r in asof.choose(asof.nearest(cues, frames, ["k"], "t", "ft", "fid"), "t", 0.1).collect()}
    assert out == {1: "DISTANT", 2: "OUTSIDE_FRAME_POINT_RANGE"}
