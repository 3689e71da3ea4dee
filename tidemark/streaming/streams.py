"""Structured Streaming forms: sessions, windows, duplicate suppression, running ledger state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def read_events(spark, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Count and value of sessions that a gap ends; rows later than the watermark are dropped by Spark."""
    g = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "total")


def windows(events: DataFrame, keys: list[str], ts: str, size: str, slide: str, late: str) -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(*keys, F.window(ts, size, slide).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("start_ts"), "n", "total")


def once(events: DataFrame, ident: list[str], ts: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(ident)


def running_latest(events: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Latest fields of each key so far, for complete or update output."""
    return events.groupBy(*keys).agg(F.max(F.struct(order, *fields)).alias("_e"), F.count("*").alias("n")).select(*keys, "_e.*", "n")


def run_to_latest(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run what is there now to its end, with every batch's whole result written as Parquet by the executors; the last
    one. For results that windows and sessions not yet closed belong to."""
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.append(number)

    q = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch={max(last)}")


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there now to a Parquet table, exactly once."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def decisions(events: DataFrame, keys: list[str], revision: str, action: str, reset: str) -> DataFrame:
    """Each key's decision as a keyed state: (keys, revision, action, state, n_events), a row whenever it changes.

    The state holds the highest revision seen, its action and the number of events, so batches may come in any order; of
    equal revisions the greater action counts, and a reset restores UNDECIDED. Events without a revision only count.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    held = "revision long, action string, n long"
    out = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["revision long, action string, state string, n_events long"])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, what, n = state.get if state.exists else (None, None, 0)
        for frame in frames:
            n += len(frame)
            fit = frame[frame["revision"].notna()]
            for r, a in zip(fit["revision"].astype("int64").tolist(), fit["action"].tolist(), strict=True):
                if last is None or (r, a or "") > (last, what or ""):
                    last, what = r, a
        state.update((last, what, n))
        told = None if last is None else "UNDECIDED" if what == reset else None if what is None else what.upper()
        row = dict(zip(keys, key, strict=True)) | {"revision": last, "action": what, "state": told, "n_events": n}
        yield pd.DataFrame([row]).astype({"revision": "Int64"})

    rows = events.select(*keys, F.col(revision).cast("long").alias("revision"), F.col(action).cast("string").alias("action"))
    return rows.groupBy(*keys).applyInPandasWithState(step, out, held, "update", GroupStateTimeout.NoTimeout)


def run_updates(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run what is there now to its end in update mode: every batch writes the rows that it changed, and only those.

    A batch that runs again after a failure replaces its own folder, so each counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(spark, path: str, schema, keys: list[str]) -> DataFrame:
    """The last row of each key over all batches that `run_updates` wrote: one aggregate, no batch is rewritten."""
    rest = [f.name for f in schema.fields if f.name not in keys]
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
