"""Claims and their evidence: readiness, next steps, coverage, deltas, observation containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals


def readiness(claims: DataFrame, evidence: DataFrame, required: DataFrame) -> DataFrame:
    """claims(claim, kind), evidence(claim, modality), required(kind, modality): what is met, what is missing."""
    have = evidence.groupBy("claim").agg(F.sort_array(F.collect_set("modality")).alias("have"))
    need = required.groupBy("kind").agg(F.sort_array(F.collect_set("modality")).alias("need"))
    out = claims.join(need, "kind", "left").join(have, "claim", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"have": F.coalesce("have", none), "need": F.coalesce("need", none)})
    out = out.withColumn("missing", F.sort_array(F.array_except("need", "have")))
    status = F.when(F.size("have") == 0, "UNSUPPORTED").when(F.size("missing") == 0, "READY").otherwise("PARTIAL")
    return out.withColumn("status", status)


def next_steps(ready: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One request for each missing modality, with the claims that ask for it, by priority."""
    rank = F.lit(99)
    for name, value in priority.items():
        rank = F.when(F.col("modality") == name, value).otherwise(rank)
    asked = ready.select("claim", F.explode("missing").alias("modality"))
    return asked.groupBy("modality").agg(F.count("*").alias("n_claims"), F.min("claim").alias("first_claim")).withColumn("priority", rank)


def with_flags(df: DataFrame, wanted: list[str], column: str = "flags") -> DataFrame:
    return df.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted])))


def interval_evidence(claims: DataFrame, evidence: DataFrame, on: list[str], width: float) -> DataFrame:
    """Claims' intervals against the union of their evidence: seconds covered and SUPPORTED, PARTIAL or MISSING."""
    spans = intervals.union(evidence, on, "ev_start", "ev_end")
    met = intervals.overlap_join(claims, spans, on, "start_s", "end_s", "ev_start", "ev_end", width)
    sums = met.groupBy("claim").agg(F.sum(F.col("overlap_end") - F.col("overlap_start")).alias("covered"))
    out = claims.join(sums, "claim", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    whole = F.col("end_s") - F.col("start_s")
    return out.withColumn("status", F.when(F.col("covered") == 0, "MISSING").when(F.col("covered") >= whole - 1e-6, "SUPPORTED").otherwise("PARTIAL"))


def coverage(required: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Required and missing measure of each key, and COMPLETE or INCOMPLETE."""
    need = intervals.covered(required, keys).select(*keys, F.col("covered").alias("required"))
    gaps = intervals.missing(required, reviewed, keys)
    gaps = gaps.groupBy(*keys).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("missing"), F.count("*").alias("n_gaps"))
    out = need.join(gaps, keys, "left").withColumns({"missing": F.coalesce("missing", F.lit(0)), "n_gaps": F.coalesce("n_gaps", F.lit(0))})
    return out.withColumn("status", F.when(F.col("missing") == 0, "COMPLETE").otherwise("INCOMPLETE"))


def preferred(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """Keys without exactly one preferred row."""
    n = F.count_if(F.col(flag))
    return rows.groupBy(key).agg(n.alias("n_preferred"), F.count("*").alias("n_rows")).where("n_preferred <> 1")


def delta(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """ADDED, REMOVED, CHANGED or SAME for every key of two snapshots."""
    a = old.select(key, F.struct(*fields).alias("_a"))
    b = new.select(key, F.struct(*fields).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.col("_a").eqNullSafe(F.col("_b")), "SAME").otherwise("CHANGED")
    return a.join(b, key, "full").select(key, kind.alias("change"))


def family_status(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """The one status of a key, or UNRESOLVED if they differ."""
    return rows.groupBy(*keys).agg(F.when(F.count_distinct(status) == 1, F.min(status)).otherwise("UNRESOLVED").alias("summary"), F.count("*").alias("n"))


def unit_audit(units: DataFrame, key: str, seconds: str, usable: str) -> DataFrame:
    """Count once per identity: units, usable ones, unique seconds by the longest member, and a reason where none."""
    g = units.groupBy(key).agg(F.count("*").alias("n_members"), F.count_if(F.col(usable)).alias("n_usable"), F.max(seconds).alias("unique_seconds"))
    return g.withColumn("reason", F.when(F.col("n_usable") == 0, "NO_USABLE_MEMBER").when(F.col("n_members") > 1, "REPEATED").otherwise("UNIQUE"))


def exclusion(rows: DataFrame, rules: list[tuple[str, str]], once: list[str], order: str) -> DataFrame:
    """rows with `excluded`: the first rule (condition, reason) that holds, else DUPLICATE for later rows of a key."""
    from pyspark.sql.window import Window

    reason = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        reason = F.when(F.expr(condition), name).otherwise(reason)
    marked = rows.withColumn("excluded", reason)
    rank = F.row_number().over(Window.partitionBy(*once, F.col("excluded").isNull()).orderBy(order))
    return marked.withColumn("excluded", F.when(F.col("excluded").isNull() & (rank > 1), "DUPLICATE").otherwise(F.col("excluded")))
