"""Joins over lineitem's spans deal a span once or twice, not to every bucket of a narrow width."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import intervals
from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, day, d = random.Random(6), datetime(1992, 1, 1), tmp_path_factory.mktemp("spans")
    at = {k: day + timedelta(days=rng.randrange(2400)) for k in range(120)}
    spark.createDataFrame([(k, k % 9, t, "1-URGENT") for k, t in at.items()], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    lines = [(k, n, day + timedelta(days=rng.randrange(2500))) for k in at for n in range(1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    return str(d), at, lines


@pytest.mark.parametrize("name", ["affine_mapping", "interval_overlap_join", "contained_or_crossing", "point_in_interval", "three_way_intersection", "sample_selection", "interval_evidence", "search_with_reuse"])
def test_rows_dealt(spark, folder, monkeypatch, name):
    dealt, inner = [], intervals._buckets
    monkeypatch.setattr(intervals, "_buckets", lambda df, *rest: (dealt.append((df, out := inner(df, *rest))), out)[1])
    catalogue.queries()[name](spark, folder[0]).count()
    assert dealt and sum(out.count() for _, out in dealt) <= 2.5 * sum(df.count() for df, _ in dealt)


def test_affine_mapping_keeps_every_pair(spark, folder):
    d, at, lines = folder
    ends = {k: max((z for o, _, z in lines if o == k and z > at[k]), default=None) for k in at}
    want = sorted((k % 9, k, n, g) for k, n, z in lines if z > at[k] for g in at if g % 9 == k % 9 and ends[g] and at[k] < ends[g] and z > at[g])
    assert sorted((r.custkey, r.orderkey, r.line, r.segment) for r in catalogue.queries()["affine_mapping"](spark, d).collect()) == want
