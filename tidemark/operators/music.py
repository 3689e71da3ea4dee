"""Support of musical identity decisions, by level; lookups, families and negatives never close one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS_WITH_COMPARISON = ["ARRANGEMENT", "PHRASE", "COMPOSITION"]


def identity_support(decisions: DataFrame, evidence: DataFrame, matches: DataFrame, slack: float = 0.002) -> DataFrame:
    """(decision, supported, reason).

    decisions(decision, level, subjects array, source, stream, start_s, end_s); evidence(decision, evidence, kind,
    level, source, stream, inspected, audio_inspected, subjects array, artifact, match_id, reference_source,
    reference_stream, all_channels, performance_basis, comparison_basis), one row for each evidence and match named;
    matches(match_id, a_source, a_stream, a0, a1, b_source, b_stream, status, native, sufficient, exact_pcm).

    A recording needs a credited reference and a native-verified match that covers the whole query; a composition
    needs two separate credits or a review; every other level needs a listening review with its own basis.
    """
    d = decisions.select("decision", "level", "subjects", "source", "stream", "start_s", "end_s")
    e = evidence.select(*[F.col(c).alias(c if c in ("decision", "match_id") else "e_" + c) for c in evidence.columns])
    scoped = d.join(e, "decision").where(
        (F.col("e_level") == F.col("level"))
        & F.coalesce("e_inspected", F.lit(False))
        & (F.col("e_source") == F.col("source"))
        & (F.col("e_stream") == F.col("stream"))
        & (F.size(F.array_except("subjects", "e_subjects")) == 0)
    )
    # A match supports a reference from either side: two equi-joins by match, not an OR.
    verified = matches.where(F.col("status").isin("EXACT", "NEAR_EXACT") & F.col("native") & F.col("sufficient"))
    reference = scoped.where((F.col("level") == "RECORDING") & (F.col("e_kind") == "REFERENCE_IDENTITY"))

    def side(own: str, other: str) -> DataFrame:
        m = verified.select("match_id", "exact_pcm", F.col(own + "_source").alias("m_source"), F.col(own + "_stream").alias("m_stream"), F.col(own + "0").alias("m0"), F.col(own + "1").alias("m1"), F.col(other + "_source").alias("r_source"), F.col(other + "_stream").alias("r_stream"))
        met = reference.join(m, "match_id")
        whole = (F.col("m0") <= F.col("start_s") + slack) & (F.col("m1") >= F.col("end_s") - slack)
        bound = (F.col("m_source") == F.col("source")) & (F.col("m_stream") == F.col("stream")) & (F.col("r_source") == F.col("e_reference_source")) & (F.col("r_stream") == F.col("e_reference_stream"))
        return met.where(whole & bound & (F.col("exact_pcm") | F.coalesce("e_all_channels", F.lit(False)))).select("decision")

    covered = side("a", "b").unionByName(side("b", "a")).distinct().withColumn("covered", F.lit(True))
    credit = F.col("e_kind").isin("SOURCE_VISIBLE_CREDIT", "OFFICIAL_CREDIT")
    review = F.col("e_kind") == "SCOPED_IDENTITY_REVIEW"
    every = lambda c: F.coalesce(F.bool_and(F.when(review, F.coalesce(c, F.lit(False)))), F.lit(False))
    told = scoped.groupBy("decision").agg(
        F.count_distinct(F.when(credit, F.col("e_kind"))).alias("credit_kinds"),
        F.count_distinct(F.when(credit, F.col("e_artifact"))).alias("credits"),
        every(F.col("e_audio_inspected")).alias("heard"),
        every(F.col("e_performance_basis").isNotNull()).alias("performed"),
        every(F.col("e_comparison_basis").isNotNull()).alias("compared"),
    )
    rows = d.join(told, "decision", "left").join(covered, "decision", "left")
    level = F.col("level")
    reason = (
        F.when(F.size("subjects") == 0, "NO_SUBJECT")
        .when(F.col("heard").isNull(), "NO_SCOPED_EVIDENCE")
        .when(level == "RECORDING", F.when(~F.coalesce("covered", F.lit(False)), "NO_REFERENCE_WITH_FULL_MATCH"))
        .when((level == "COMPOSITION") & (F.col("credit_kinds") == 2) & (F.col("credits") >= 2), F.lit(None))
        .when(~F.col("heard"), "CANDIDATE_ONLY")
        .when((level == "PERFORMANCE") & ~F.col("performed"), "NO_PERFORMANCE_BASIS")
        .when(level.isin(*LEVELS_WITH_COMPARISON) & ~F.col("compared"), "NO_COMPARISON_BASIS")
        .when(level == "UNKNOWN", "UNKNOWN_LEVEL")
    )
    return rows.select("decision", reason.isNull().alias("supported"), reason.alias("reason"))


def unsupported_closures(decisions: DataFrame, support: DataFrame) -> DataFrame:
    """Decisions that close a proposition without support; must be empty before a result is published."""
    closing = decisions.where(F.col("status").isin("CONFIRMED", "SUPPORTED", "CONTRADICTED"))
    return closing.join(support.where(~F.col("supported")), "decision").select("decision", "status", "reason")
