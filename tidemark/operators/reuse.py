"""Recording reuse: correspondences, decisions, identity groups, canonical members and the counting audit.

Tables: occurrences(occurrence_id, introduced, source_start_s, source_end_s, rate, speaker, quality, unit_kind,
vocal_status), matches(match_id, observed, a_id, a_start, a_end, b_id, b_start, b_end, classification,
exact_pcm, auto_link, tolerance), decisions(revision, correspondence, decision), promotions(revision,
performance_id, occurrence_id, feature). Spans of matches are on the occurrence's own clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph, intervals

#: Qualities of a recording, the best first.
QUALITY = ["isolated_voice_asset", "clean_scene", "clean_derived", "mixed_scene", "edited", "unknown"]
UNITS = ("performance", "fragment")


def quality_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(q) for q in QUALITY]), c) - 1


def correspondence(a: Column, b: Column) -> Column:
    """A key that doesn't depend on which side is called a."""
    return F.concat(F.lit("link-"), F.substring(F.sha2(F.to_json(F.sort_array(F.array(a, b))), 256), 1, 24))


def with_keys(matches: DataFrame) -> DataFrame:
    side = lambda s: F.to_json(F.struct(F.col(s + "_id").alias("id"), F.col(s + "_start").alias("start"), F.col(s + "_end").alias("end")))
    return matches.withColumn("correspondence", correspondence(side("a"), side("b")))


def latest_observations(matches: DataFrame) -> DataFrame:
    """The last observation of each correspondence, with how many there were."""
    keyed = with_keys(matches)
    rest = [c for c in keyed.columns if c not in ("correspondence", "observed")]
    g = keyed.groupBy("correspondence").agg(F.max(F.struct("observed", *rest)).alias("m"), F.count("*").alias("n_observations"))
    return g.select("correspondence", "m.*", "n_observations")


def whole(prefix: str) -> Column:
    """Both ends reached within the tolerance and 98 % covered: a share alone is never enough."""
    start, end, size = F.col(prefix + "_start"), F.col(prefix + "_end"), F.col(prefix + "_size")
    slack = F.greatest(2 / F.col(prefix + "_rate"), F.least(F.lit(0.04), F.coalesce("tolerance", F.lit(0.0))))
    return (start <= slack) & (end >= size - slack) & (end - start >= 0.98 * size)


def edges(matches: DataFrame, occurrences: DataFrame, decisions: DataFrame, revision: int | None = None) -> DataFrame:
    """Latest correspondences with `identity_decision` and `whole_unit`.

    A decision stands before the rule and a reset gives the rule back. The rule links performances only when the
    match is fit for it and the voices are verified and compatible; equal sound alone is audio_only; everything
    else is unresolved, never different.
    """
    own = occurrences.select("occurrence_id", "introduced", (F.col("source_end_s") - F.col("source_start_s")).alias("size"), "rate", "speaker", "quality", "unit_kind", "vocal_status")
    side = lambda s: own.select(*[F.col(c).alias(s + "_id" if c == "occurrence_id" else f"{s}_{c}") for c in own.columns])
    rows = latest_observations(matches).join(side("a"), "a_id").join(side("b"), "b_id")
    known = decisions if revision is None else decisions.where(F.col("revision") <= revision)
    last = known.groupBy("correspondence").agg(F.max(F.struct("revision", "decision")).alias("d")).select("correspondence", F.col("d.decision").alias("override"))
    rows = rows.join(last, "correspondence", "left")

    sa, sb = F.col("a_speaker"), F.col("b_speaker")
    verified = lambda s: F.coalesce(F.col(s + "_vocal_status") == "verified_voice", F.lit(False))
    isolated = lambda s: F.coalesce(F.col(s + "_quality") == "isolated_voice_asset", F.lit(False))
    both, same = verified("a") & verified("b"), F.coalesce(sa == sb, F.lit(False))
    compatible = ~F.coalesce(sa != sb, F.lit(False))
    gate = both & same & (isolated("a") | isolated("b"))
    reference = compatible & (
        (isolated("a") & verified("a") & sa.isNotNull() & whole("a")) | (isolated("b") & verified("b") & sb.isNotNull() & whole("b"))
    )
    exact_mix = F.col("exact_pcm") & compatible & both & sa.isNotNull() & sb.isNotNull() & whole("a") & whole("b")
    rule = (
        F.when(F.col("auto_link") & (gate | reference | exact_mix), "same_performance")
        .when(F.col("classification").isin("EXACT", "NEAR_EXACT"), "audio_only")
        .otherwise("unresolved")
    )
    state = F.when(F.col("override").isNull() | (F.col("override") == "reset"), rule).otherwise(F.col("override"))
    rows = rows.withColumn("identity_decision", state)
    units = F.col("a_unit_kind").isin(*UNITS) & F.col("b_unit_kind").isin(*UNITS)
    said = F.coalesce(F.col("override") == "same_performance", F.lit(False))
    joined = (F.col("identity_decision") == "same_performance") & units & ((both & same) | said) & whole("a") & whole("b")
    return rows.withColumn("whole_unit", F.coalesce(joined, F.lit(False)))


def identities(found: DataFrame, occurrences: DataFrame, promotions: DataFrame) -> DataFrame:
    """(occurrence_id, identity_id, performance_id, canonical): groups joined by whole-unit edges only.

    A group is named by its member introduced first, so a better witness that comes late changes the canonical
    member and not the name. The last promotion under any alias of the group decides the canonical member.
    """
    order = occurrences.select("occurrence_id", "introduced")
    a, b = order.select(F.col("occurrence_id").alias("a_id"), F.col("introduced").alias("x")), order.select(F.col("occurrence_id").alias("b_id"), F.col("introduced").alias("y"))
    pairs = found.where("whole_unit").select("a_id", "b_id").join(a, "a_id").join(b, "b_id").select("x", "y")
    roots = graph.components(pairs, "x", "y").select(F.col("node").alias("introduced"), F.col("component").alias("root"))
    members = occurrences.join(roots, "introduced", "left").withColumn("root", F.coalesce("root", "introduced"))
    members = members.withColumn("size", F.col("source_end_s") - F.col("source_start_s"))
    named = members.join(order.select(F.col("introduced").alias("root"), F.col("occurrence_id").alias("root_id")), "root")
    unit = F.max(F.col("unit_kind").isin(*UNITS)).alias("unit")
    best = F.min(F.struct(quality_rank(F.col("quality")), -F.col("size"), F.col("introduced"), F.col("occurrence_id").alias("id"))).alias("best")
    groups = named.groupBy("root", "root_id").agg(unit, best)
    tail = F.regexp_replace("root_id", "^occ-", "")
    groups = groups.withColumns({"performance_id": F.when(F.col("unit"), F.concat(F.lit("perf-"), tail)), "identity_id": F.concat(F.when(F.col("unit"), "perf-").otherwise("edit-"), tail)})
    # A promotion names a group by any member's alias and must pick one of its members.
    alias = named.select("root", F.concat(F.lit("perf-"), F.regexp_replace("occurrence_id", "^occ-", "")).alias("performance_id"))
    picked = promotions.where("feature = 'default'").join(alias, "performance_id").join(named.select(F.col("root").alias("r2"), "occurrence_id"), "occurrence_id").where("root = r2")
    picked = picked.groupBy("root").agg(F.max(F.struct("revision", "occurrence_id")).alias("p")).select("root", F.col("p.occurrence_id").alias("promoted"))
    groups = groups.join(picked, "root", "left").select("root", "identity_id", "performance_id", F.coalesce("promoted", F.col("best.id")).alias("canonical"))
    return named.join(groups, "root").select("occurrence_id", "identity_id", "performance_id", "canonical")


def fragment_owner() -> Column:
    """'a' or 'b': which side of a partial correspondence owns what both share, for counting only."""
    ka, kb = F.col("a_unit_kind"), F.col("b_unit_kind")
    units_a, units_b = ka.isin(*UNITS), kb.isin(*UNITS)
    by_size = F.struct(-F.col("a_size"), quality_rank(F.col("a_quality")), F.col("a_id")) <= F.struct(-F.col("b_size"), quality_rank(F.col("b_quality")), F.col("b_id"))
    by_quality = F.struct(quality_rank(F.col("a_quality")), -F.col("a_size"), F.col("a_id")) <= F.struct(quality_rank(F.col("b_quality")), -F.col("b_size"), F.col("b_id"))
    return (
        F.when((ka == "composite") & (kb != "composite"), "b")
        .when((kb == "composite") & (ka != "composite"), "a")
        .when((ka == "performance") & kb.isin("fragment", "window"), "a")
        .when((kb == "performance") & ka.isin("fragment", "window"), "b")
        .when(units_a & units_b, F.when(by_size, "a").otherwise("b"))
        .when(whole("a") & ~whole("b"), "a")
        .when(whole("b") & ~whole("a"), "b")
        .otherwise(F.when(by_quality, "a").otherwise("b"))
    )


def partial_links(found: DataFrame) -> DataFrame:
    """(match_id, owner, occurrence_id, start_s, end_s): accepted but partial reuse, on the target's clock."""
    part = found.where((F.col("identity_decision") == "same_performance") & ~F.col("whole_unit")).withColumn("own", fragment_owner())
    pick = lambda other, c: F.when(F.col("own") == "a", F.col(f"b_{c}") if other else F.col(f"a_{c}")).otherwise(F.col(f"a_{c}") if other else F.col(f"b_{c}"))
    return part.select("match_id", pick(False, "id").alias("owner"), pick(True, "id").alias("occurrence_id"), pick(True, "start").alias("start_s"), pick(True, "end").alias("end_s"))


def audit(found: DataFrame, members: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row for each identity: whether it counts as an independent unit, how it relates, and its seconds.

    Ranges are united for each occurrence on its own clock and never added over witnesses.
    """
    parts = partial_links(found)
    cover = intervals.union(parts.select("occurrence_id", "start_s", "end_s"), ["occurrence_id"])
    cover = cover.groupBy("occurrence_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("reused"))
    owners = parts.join(members.select(F.col("occurrence_id").alias("owner"), F.col("performance_id").alias("owner_performance")), "owner", "left")
    links = owners.groupBy("occurrence_id").agg(F.collect_set("owner_performance").alias("from_performances"), F.count("*").alias("links"))
    own = occurrences.withColumn("size", F.col("source_end_s") - F.col("source_start_s"))
    rows = members.join(own, "occurrence_id").join(cover, "occurrence_id", "left").join(links, "occurrence_id", "left")
    reused = F.least(F.col("size"), F.coalesce("reused", F.lit(0.0)))
    head = F.col("occurrence_id") == F.col("canonical")
    g = rows.groupBy("identity_id", "performance_id", "canonical").agg(
        F.count("*").alias("n_occurrences"),
        F.max(reused >= F.col("size") - 2 / F.col("rate")).alias("derived"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("from_performances", F.array().cast("array<string>"))))).alias("_from"),
        F.max(F.when(head, F.col("unit_kind"))).alias("_kind"),
        F.max(F.when(head, F.col("speaker"))).alias("speaker"),
        F.max(F.when(head, F.col("vocal_status"))).alias("_voice"),
        F.max(F.when(head, F.col("size"))).alias("_size"),
        F.sum(reused).alias("reused_seconds"),
    )
    composite = (F.col("_kind") == "composite") | (F.size("_from") > 1)
    voice = F.coalesce(F.col("_voice") == "verified_voice", F.lit(False)) & F.col("speaker").isNotNull()
    countable = voice & F.col("performance_id").isNotNull() & ~F.col("derived") & (F.col("n_links") == 0) & ~composite
    relation = F.when(composite, "composite").when(F.col("n_links") > 0, "partial_or_trimmed_reuse").otherwise("whole_unit_group")
    return g.select(
        "identity_id", "performance_id", "canonical", "speaker", "n_occurrences", "reused_seconds",
        countable.cast("int").alias("contribution"), relation.alias("relationship"), F.when(countable, F.col("_size")).otherwise(0.0).alias("unique_seconds"),
    )


def baseline_status(baseline: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """baseline(row_no, occurrence_id) with NOT_INDEXED, DUPLICATE_WHOLE_UNIT, PARTIAL_REUSE_REVIEW or INDEXED."""
    part = partial_links(found).select("occurrence_id").distinct().withColumn("partial", F.lit(True))
    rows = baseline.join(members.select("occurrence_id", "identity_id"), "occurrence_id", "left").join(part, "occurrence_id", "left")
    first = F.min("row_no").over(Window.partitionBy("identity_id"))
    status = (
        F.when(F.col("identity_id").isNull(), "NOT_INDEXED")
        .when(F.col("row_no") > first, "DUPLICATE_WHOLE_UNIT")
        .when(F.col("partial"), "PARTIAL_REUSE_REVIEW")
        .otherwise("INDEXED")
    )
    return rows.select("row_no", "occurrence_id", "identity_id", status.alias("status"))


def speaker_view(found: DataFrame, members: DataFrame, occurrences: DataFrame, speaker: str) -> DataFrame:
    """Occurrences of a speaker, with those linked to them and all members of the identities they touch."""
    own = occurrences.where(F.col("speaker") == speaker).select("occurrence_id")
    both = found.select(F.col("a_id").alias("occurrence_id"), F.col("b_id").alias("other")).unionByName(found.select(F.col("b_id").alias("occurrence_id"), F.col("a_id").alias("other")))
    near = own.unionByName(both.join(own, "occurrence_id", "left_semi").select(F.col("other").alias("occurrence_id"))).distinct()
    touched = members.join(near, "occurrence_id", "left_semi").select("identity_id").distinct()
    return members.join(touched, "identity_id", "left_semi").select("occurrence_id").unionByName(near).distinct()


def candidate_pairs(shared: DataFrame, roles: DataFrame, self_pairs: bool = False) -> DataFrame:
    """Unordered pairs whose roles allow them, the reference first: target with reference or both, both with both.

    shared(a, b) are ids that share a bucket; roles(id, role) with reference, target or both.
    """
    ra, rb = roles.select(F.col("id").alias("a"), F.col("role").alias("ra")), roles.select(F.col("id").alias("b"), F.col("role").alias("rb"))
    rows = shared.join(ra, "a").join(rb, "b").where((F.col("ra") != F.col("rb")) | (F.col("ra") == "both"))
    if not self_pairs:
        rows = rows.where("a <> b")
    turn = (F.col("ra") == "target") | ((F.col("ra") == "both") & ((F.col("rb") == "reference") | ((F.col("rb") == "both") & (F.col("b") < F.col("a")))))
    return rows.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b")).distinct()


def correspondences_of(found: DataFrame, occurrences: DataFrame, source: str, start: float, end: float, slack: float = 0.002) -> DataFrame:
    """Edges that touch a source's interval, to 2 ms, on either side: (match_id, occurrence_id, other_id, kind)."""
    here = occurrences.where((F.col("source") == source) & (F.col("source_start_s") < end + slack) & (F.col("source_end_s") > start - slack))
    here = here.select("occurrence_id", "source_start_s")
    side = lambda s, o: found.select("match_id", F.col(s + "_id").alias("occurrence_id"), F.col(o + "_id").alias("other_id"), F.col(s + "_start").alias("m0"), F.col(s + "_end").alias("m1"), F.col("classification").alias("kind"))
    rows = side("a", "b").unionByName(side("b", "a")).join(here, "occurrence_id")
    touching = (F.col("source_start_s") + F.col("m0") < end + slack) & (F.col("source_start_s") + F.col("m1") > start - slack)
    return rows.where(touching).select("match_id", "occurrence_id", "other_id", "kind")


def comparisons(a: DataFrame, b: DataFrame, windows: tuple[float, ...] = (0.24, 0.5, 1.0)) -> DataFrame:
    """Units to compare for pairs(pair, size) of channels(pair, side, channel): every channel pair with the whole
    and every half-overlapping window. Channels and windows of a pair are a handful; the product feeds one kernel."""
    left = a.select("pair", "size", F.col("channel").alias("channel_a"))
    rows = left.join(b.select("pair", F.col("channel").alias("channel_b")), "pair")
    starts = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - w) / (w / 2)).cast("int"))), lambda k: F.struct(F.lit(w).alias("window_s"), (k * (w / 2)).alias("from_s")))
    fit = [F.when(F.col("size") > w, starts(w)).otherwise(F.array().cast("array<struct<window_s:double,from_s:double>>")) for w in windows]
    whole_ = F.array(F.struct(F.col("size").cast("double").alias("window_s"), F.lit(0.0).alias("from_s")))
    return rows.select("pair", "channel_a", "channel_b", F.inline(F.concat(whole_, *fit)))
