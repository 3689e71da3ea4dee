"""Registration of queries and the tables they see.

The driver's tables stand in for evidence: `events` is a measured track (user = source, type = kind), orders
with their lineitems are intervals [order day, ship day) of a customer, `documents` and `conversations` are
cues, `embeddings` are descriptors, `labels` against a rule are trials.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    """Computed doubles are rounded on both sides."""
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


def track(spark: SparkSession, d: str) -> DataFrame:
    """events with us, microseconds of the epoch as a whole number, whatever the session's time zone is."""
    return table(spark, d, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))


TRACK = "track AS (SELECT *, epoch_us(ts) AS us FROM events)"


def day(c: str):
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """(custkey, orderkey, line, start_s, end_s) in days, positive ones only."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    joined = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    out = joined.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), day("o_orderdate").alias("start_s"), day("l_shipdate").alias("end_s"))
    return out.where("start_s < end_s")


#: Width in days of the buckets that spans meet in: near their median length (733 at sf0.1, 992 for whole orders), so that most
#: are dealt once or twice; with 64 days a span went to 14 buckets. No row depends on it.
SPAN_DAYS = 1024
SPANS = """spans AS (SELECT o_custkey AS custkey, o_orderkey AS orderkey, l_linenumber AS line, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS start_s,
  datediff('day', DATE '1970-01-01', l_shipdate::DATE) AS end_s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate::DATE < l_shipdate::DATE)"""
ISLANDS = """marked AS (SELECT *, sum(fresh) OVER (PARTITION BY custkey ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY custkey ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans)),
merged AS (SELECT custkey, min(start_s) AS start_s, max(end_s) AS end_s FROM marked GROUP BY custkey, island)"""
HOUR = 3_600_000_000
