"""Queries against their SQL on small tables of odd rows."""

import math
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from test_queries import norm
from tidemark.plans import catalogue


def agree(spark, name, folder, **tables):
    """The rows of a query over tables(name=DataFrame), after a comparison with its SQL."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    found = con.execute(catalogue.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert sorted(tuple(norm(v) for v in r) for r in got) == sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall())
    return got


def events(spark, values, kinds=("view",), step=timedelta(hours=1)):
    rows = [(i, datetime(2024, 1, 1) + i * step, 7, kinds[i % len(kinds)], v, "{}") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_jumps_from_and_to_zero(spark, tmp_path):
    got = agree(spark, "adjacent_jumps", tmp_path, events=events(spark, [20.0, 0.0, 0.0, 20.0, 21.0, 45.0, None, 3.0]))
    assert [r.event_id for r in sorted(got, key=lambda r: r.event_id)] == [1, 2, 3, 5]


def test_jumps_between_equal_times(spark, tmp_path):
    tied = events(spark, [20.0, 80.0, 30.0, 3.0, 50.0, 9.0], step=timedelta(0))
    for name, order in (("up", "event_id"), ("down", "-event_id")):
        tied.orderBy(F.expr(order)).coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = catalogue.queries()["adjacent_jumps"](spark, f"{tmp_path}/{name}").collect()
        assert {r.event_id: r.semitones for r in got} == {i: pytest.approx(12 * math.log2(b / a), abs=1e-6) for i, a, b in ((1, 20, 80), (2, 80, 30), (3, 30, 3), (4, 3, 50), (5, 50, 9))}


def test_cues_and_medians_with_zeros(spark, tmp_path):
    values = [20.0, 0.0, 30.0, 0.0, 0.0, 0.0, 5.0, 0.0]
    got = agree(spark, "cue_contours", tmp_path / "a", events=events(spark, values))
    assert sorted((r.n_rows, r.median_hz) for r in got) == [(2, None), (6, 0.0)]
    for name, kinds in (("b", ("view", "click")), ("c", ("click", "view")), ("d", ("view", "view", "click"))):
        assert len(agree(spark, "separation_change", tmp_path / name, events=events(spark, values, kinds))) == 1


def test_usage_of_many_tokens(spark, tmp_path):
    rows = [(1, 2_000_000, 5.0, "A", "F"), (2, 7, 5.0, "A", "F"), (3, 9_000_000_000_000, 5.0, "N", "O"), (4, 3, 1.0, "N", "O"), (5, 3, 2.0, "R", "F")]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string")
    got = agree(spark, "usage_costs", tmp_path, lineitem=li)
    assert {(r.model, r.n_priced) for r in got} == {("A", 2), ("N", 1), ("R", 0)}
