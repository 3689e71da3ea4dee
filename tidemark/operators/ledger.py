"""Append-only event ledger and snapshots as functions of a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def at_revision(events: DataFrame, revision: int, column: str = "revision") -> DataFrame:
    return events.where(F.col(column) <= revision)


def append(ledger: DataFrame, event: DataFrame, identity: str = "run_identity") -> DataFrame:
    """The rows to append: next revision for events whose identity the ledger doesn't hold. One writer at a time."""
    fresh = event.join(ledger.select(identity).distinct(), identity, "left_anti")
    last = ledger.agg(F.coalesce(F.max("revision"), F.lit(0)).alias("_last"))
    # Batches of events are what a user enters by hand; the numbering is over them, not over the ledger.
    number = F.row_number().over(Window.orderBy(identity))
    return fresh.crossJoin(F.broadcast(last)).withColumn("revision", (F.col("_last") + number).cast("long")).drop("_last")


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key, with the number of all; an aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    pick = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_e")
    return events.groupBy(*keys).agg(pick, F.count("*").alias("n_events")).select(*keys, *[F.col("_e")[c].alias(c) for c in rest], "n_events")


def decisions(events: DataFrame, keys: list[str], order: list[str], action: str, reset: str) -> DataFrame:
    """Latest decision of each key; a reset restores UNDECIDED."""
    out = latest(events, keys, order)
    return out.withColumn("state", F.when(F.col(action) == reset, "UNDECIDED").otherwise(F.upper(action)))


def replay(events: DataFrame, keys: list[str], order: str, field: str, value: str) -> DataFrame:
    """Annotations folded in order: for each field the last value, as a sorted list of entries."""
    last = events.groupBy(*keys, field).agg(F.max(F.struct(order, value)).alias("_v"))
    return last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(field), F.col("_v")[value].alias(value)))).alias("annotations"))
