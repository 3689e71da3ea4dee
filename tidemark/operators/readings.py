"""Frozen readings: versions of what an observer read, each with a digest, and decisions that hold for one digest only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def freeze(versions: DataFrame, reading: str, version: str, fields: list[str]) -> DataFrame:
    """versions with `digest`, the SHA-256 of the reading's identity and fields as canonical JSON, and `latest`.

    The version's number is no part of the digest: a later version that says the same is the same state. Fields go by name,
    nulls are written. Of a reading's versions the greatest number is the latest; rows that repeat a number count as one
    state only if they say the same, else the reading has no latest one (AMBIGUOUS in `judge`).
    """
    held = F.struct(F.col(reading), *[F.col(f) for f in sorted(fields)])
    # Dealt by reading before digests are made, which are wider than what they are made of.
    rows = versions.repartition(reading).withColumn("digest", F.sha2(F.to_json(held, {"ignoreNullFields": "false"}), 256))
    per = Window.partitionBy(reading)
    top = rows.withColumn("_top", F.max(version).over(per))
    one = F.min(F.when(F.col(version) == F.col("_top"), F.col("digest"))).over(per) == F.max(F.when(F.col(version) == F.col("_top"), F.col("digest"))).over(per)
    return top.withColumn("latest", (F.col(version) == F.col("_top")) & one).drop("_top")


def judge(decisions: DataFrame, frozen: DataFrame, reading: str) -> DataFrame:
    """decisions(decision, reading, told_digest, ..) with `status`: APPLIES where the digest is the latest state's, STALE
    where an earlier one's, AMBIGUOUS where the reading has no latest state, UNKNOWN_DIGEST and NO_READING. Only those
    that apply may change a state; the others are violations."""
    # States and decisions are stacked, so that both are dealt once, by reading, and both windows run there.
    rest = [c for c in decisions.columns if c not in (reading, "told_digest")]
    told = decisions.select(reading, "told_digest", F.lit(None).cast("boolean").alias("latest"), F.struct(*rest).alias("_held"))
    states = frozen.select(reading, F.col("digest").alias("told_digest"), "latest", F.lit(None).cast(told.schema["_held"].dataType).alias("_held"))
    known = F.col(reading).isNotNull()
    rows = told.unionByName(states).withColumns({
        "_some": F.when(known, F.max("latest").over(Window.partitionBy(reading))),
        "_latest": F.when(known & F.col("told_digest").isNotNull(), F.max("latest").over(Window.partitionBy(reading, "told_digest"))),
    })
    rows = rows.where("_held IS NOT NULL").select(reading, "told_digest", "_held.*", "_some", "_latest")
    status = (
        F.when(F.col("_some").isNull(), "NO_READING")
        .when(F.col("_latest").isNull(), "UNKNOWN_DIGEST")
        .when(~F.col("_some"), "AMBIGUOUS")
        .when(F.col("_latest"), "APPLIES")
        .otherwise("STALE")
    )
    return rows.withColumn("status", status).drop("_some", "_latest")


def projected(frozen: DataFrame, judged: DataFrame, reading: str, decision: str) -> DataFrame:
    """(reading, digest, state, n_stale): the latest state of each reading under the decisions that apply to it: their
    common decision, CONFLICT where they differ, OPEN where none applies."""
    now = frozen.where("latest").select(reading, "digest").distinct()
    g = judged.groupBy(reading).agg(
        F.min(F.when(F.col("status") == "APPLIES", F.col(decision))).alias("_a"), F.max(F.when(F.col("status") == "APPLIES", F.col(decision))).alias("_z"), F.count_if(F.col("status") == "STALE").alias("n_stale")
    )
    state = F.when(F.col("_a").isNull(), "OPEN").when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise("CONFLICT")
    return now.join(g, reading, "left").select(reading, "digest", state.alias("state"), F.coalesce("n_stale", F.lit(0)).cast("long").alias("n_stale"))
