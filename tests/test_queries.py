"""Every registered query against its SQL in DuckDB on the smallest tables; order doesn't matter."""

import itertools
import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, list | tuple):
        return str([norm(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, D)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in catalogue.oracle_sql():
        assert columns
        return
    found = duck.execute(catalogue.oracle_sql()[name])
    named = [c[0] for c in found.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    want = sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in rows) == want


def test_joins_avoid_nested_loops(spark):
    for name in ("interval_overlap_join", "point_in_interval", "search_with_reuse"):
        plan = catalogue.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_scans_prune_columns(spark):
    plan = catalogue.queries()["run_join"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,5000.0)" in plan
    assert "c_mktsegment" not in plan


def test_support_routes_read_every_line(spark, duck):
    """Against brute force over the whole table: three channels at most, so at most three groups."""
    options = {}
    for claim, channel, grp, ok in duck.execute("SELECT l_orderkey, l_returnflag, l_suppkey % 9, l_tax < 0.06 FROM lineitem").fetchall():
        options.setdefault(claim, {}).setdefault(channel, set()).update([grp] if ok else [])
    sets = [s for k in (1, 2, 3) for s in itertools.combinations(range(9), k)]
    want = {c: next((",".join(map(str, s)) for s in sets if all(g & set(s) for g in o.values())), None) for c, o in options.items()}
    assert {r.claim: r.route for r in catalogue.queries()["support_routes"](spark, D).collect()} == want
