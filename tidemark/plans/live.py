"""Streaming queries, each run to the end of what is there, against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import scratch
from ..streaming import streams
from .base import query, table


def _shared(spark) -> str:
    return scratch(spark, "stream")


def _events(spark, d):
    schema = table(spark, d, "events").schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    # A stream reads folders: a table of one file is its folder, narrowed to that name.
    reader = spark.readStream.schema(schema)
    e = reader.parquet(f"{d}/events.parquet") if whole else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM l)
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def session_stream(spark, d):
    out = streams.sessions(_events(spark, d), ["user_id"], "ts", "12 hours", "400 days")
    # Complete output keeps sessions that the watermark hasn't closed.
    where = _shared(spark)
    return streams.run_to_latest(out, where + "/rows", where + "/state").select("user_id", "n", F.round("total", 4).alias("total"))


@query("""SELECT event_type, (epoch_us(ts) // 21600000000) AS six_hours, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def window_stream(spark, d):
    out = streams.windows(_events(spark, d), ["event_type"], "ts", "6 hours", "6 hours", "400 days")
    where = _shared(spark)
    streams.run_updates(out, where + "/rows", where + "/state")
    done = streams.merged(spark, where + "/rows", out.schema, ["event_type", "start_ts"])
    # A window's number, from the wall clock the time stamps were read with.
    number = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(start_ts as timestamp_ntz)) div 6")
    return done.select("event_type", number.alias("six_hours"), "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY ALL")
def dedup_stream(spark, d):
    out = streams.once(_events(spark, d), ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type")
    where = _shared(spark)
    streams.run_to_parquet(out, where + "/rows", where + "/state")
    return spark.read.parquet(where + "/rows").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def running_ledger_stream(spark, d):
    out = streams.running_latest(_events(spark, d), ["user_id"], "event_id", ["event_type"])
    where = _shared(spark)
    streams.run_updates(out, where + "/rows", where + "/state")
    return streams.merged(spark, where + "/rows", out.schema, ["user_id"]).select("user_id", "event_id", "event_type", "n")


@query("""SELECT user_id, max(event_id) AS revision, arg_max(event_type, event_id) AS action, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'UNDECIDED' ELSE upper(arg_max(event_type, event_id)) END AS state, count(*) AS n_events
FROM events GROUP BY user_id""")
def decision_state_stream(spark, d):
    """Each user's last event as a decision that is kept as keyed state; an error takes it back."""
    out = streams.decisions(_events(spark, d), ["user_id"], "event_id", "event_type", "error")
    where = _shared(spark)
    streams.run_updates(out, where + "/rows", where + "/state")
    return streams.merged(spark, where + "/rows", out.schema, ["user_id"])
