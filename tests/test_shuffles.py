"""What queries deal out between tasks, by their plans over tables that are too large to broadcast."""

import re

import pytest

from tidemark.plans import catalogue

D = "/root/testdata/sf0.001"


def dealt(spark, name):
    """The keys of every exchange in a query's plan without broadcasts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


@pytest.mark.parametrize("name", ["judged_readings", "projected_readings"])
def test_digests_are_dealt_by_reading_only(spark, name):
    keys = dealt(spark, name)
    assert keys and not any("digest" in k for k in keys)
