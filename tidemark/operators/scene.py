"""Scene evidence as tables: competence, adequacy, conflicts, change propagation, prerequisites, query plans.

nodes(scene, node, kind, proposition, status, start_s, end_s) with kind observation or claim; refs(scene, node,
evidence, channel, authority, role, covered) of evidence; edges(scene, src, dst, relation, role) from premise to
dependent; decisions(scene, node, state). States are texts and undecided is OPEN, never false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph
from .grouped import by_group

#: What each evidence channel can establish.
COMPETENCE = {
    "TXT": ["wording"],
    "VIS": ["visual_fact"],
    "TVIS": ["visual_fact", "motion", "contact", "event_order", "av_sync"],
    "AM": ["sound_level", "speech_timing"],
    "MID": ["recording_identity", "composition_identity", "arrangement_identity", "performance_identity", "musical_reference"],
    "AO_STAGE1": ["wording", "delivery", "nonverbal_vocal", "music_structure", "performance_music", "soundscape", "speech_timing", "auditory_event_timing"],
    "AO_STAGE2": ["wording", "delivery", "nonverbal_vocal", "music_structure", "performance_music", "soundscape", "speech_timing", "auditory_event_timing"],
    "HL": ["delivery", "nonverbal_vocal", "music_structure", "performance_music", "soundscape", "speaker_identity", "speech_timing", "auditory_event_timing"],
    "VO": ["visual_fact", "motion", "contact", "event_order"],
    "AVO": ["visual_fact", "motion", "contact", "event_order", "av_sync", "delivery", "soundscape"],
}
#: Relations that carry a change, and states that affirm.
PROPAGATING = ["SUPPORTS", "CONSTRAINS", "DEPENDS_ON", "REQUIRES_RECHECK_IF_CHANGED"]
AFFIRMATIVE = ["SUPPORTED", "CONFIRMED"]
#: Acquisition routes and profiles by proposition.
ROUTES = {
    "recording_identity": [("MUSIC_IDENTITY", "RECORDING")],
    "composition_identity": [("MUSIC_IDENTITY", "COMPOSITION")],
    "arrangement_identity": [("MUSIC_IDENTITY", "ARRANGEMENT")],
    "performance_identity": [("MUSIC_IDENTITY", "PERFORMANCE")],
    "musical_reference": [("MUSIC_IDENTITY", "PHRASE")],
    "wording": [("TEXT_WITNESS", None)],
    "delivery": [("AUDITORY", "SPEECH_PERFORMANCE")],
    "nonverbal_vocal": [("AUDITORY", "NONVERBAL_VOCAL")],
    "music_structure": [("AUDITORY", "MUSIC_STRUCTURE")],
    "performance_music": [("AUDITORY", "PERFORMANCE_MUSIC"), ("TEMPORAL", "TEMPORAL_HIGH"), ("TEXT_WITNESS", "LYRICS_SECTIONS")],
    "soundscape": [("AUDITORY", "SOUNDSCAPE")],
    "auditory_event_timing": [("AUDITORY", "AV_SYNC")],
    "av_sync": [("AUDITORY", "AV_SYNC"), ("TEMPORAL", "TEMPORAL_LOW")],
    "motion": [("TEMPORAL", "TEMPORAL_LOW")],
    "contact": [("TEMPORAL", "TEMPORAL_LOW")],
    "event_order": [("TEMPORAL", "TEMPORAL_LOW")],
    "visual_fact": [("STATIC", None)],
    "sound_level": [("ACOUSTIC_MEASUREMENT", None)],
    "speech_timing": [("ALIGNMENT_REVIEW", None)],
    "speaker_identity": [("SOURCE_ATTRIBUTION_REVIEW", None)],
    "emotion": [("AUDITORY", "SPEECH_PERFORMANCE"), ("TEMPORAL", "TEMPORAL_LOW"), ("TEXT_WITNESS", None)],
    "interpretation": [("PREMISE_REVIEW", None)],
}


def competent(channel: Column, proposition: Column) -> Column:
    table = F.create_map(*[x for k, v in COMPETENCE.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    return F.coalesce(F.array_contains(F.element_at(table, channel), proposition), F.lit(False))


def assess(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs with `competent`, `adequate` and the first reason against support.

    Text is adequate by declared authority; other channels by their recorded review (`eligible`). Evidence that
    can't establish the proposition or doesn't cover the interval never is.
    """
    rows = refs.join(nodes.select("scene", "node", "proposition"), ["scene", "node"])
    able = competent(F.col("channel"), F.col("proposition"))
    text = (F.col("channel") == "TXT") & F.col("authority").isin("canonical_text", "best_available_text")
    other = (F.col("channel") != "TXT") & F.coalesce("eligible", F.lit(False))
    context = (F.col("channel") == "AO_STAGE2") & (F.col("proposition") == "wording")
    reason = F.when(~able, "NOT_COMPETENT").when(~F.col("covered"), "NOT_COVERED").when(context, "CONTEXT_ONLY").when(~(text | other), "NOT_QUALIFIED")
    return rows.withColumns({"competent": able, "adequate": reason.isNull(), "reason": reason})


def observation_adequacy(assessed: DataFrame) -> DataFrame:
    """(scene, node, adequate): some positive evidence is adequate, all that is REQUIRED is, and no adequate
    evidence contradicts. A missing role counts as SUPPORTING."""
    role = F.coalesce("role", F.lit("SUPPORTING"))
    good = F.col("adequate")
    g = assessed.groupBy("scene", "node").agg(
        F.coalesce(F.bool_or(F.when(role.isin("REQUIRED", "SUPPORTING"), good)), F.lit(False)).alias("_some"),
        F.coalesce(F.bool_and(F.when(role == "REQUIRED", good)), F.lit(True)).alias("_all"),
        F.coalesce(F.bool_or(F.when(role == "CONTRADICTORY", good)), F.lit(False)).alias("_against"),
    )
    return g.select("scene", "node", (F.col("_some") & F.col("_all") & ~F.col("_against")).alias("adequate"))


def _qualified(df: DataFrame, *columns: str) -> list[Column]:
    """Nodes named with their scene, for graph functions on one column."""
    return [F.concat_ws("\x1f", "scene", c).alias(c) for c in columns]


def propagate(nodes: DataFrame, edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """nodes with `after` and `changed`: decided nodes take their state; what a changed one reaches is RECHECK."""
    live = edges.where(F.col("relation").isin(*PROPAGATING))
    chosen = decisions.groupBy("scene", "node").agg(F.max("state").alias("decided"))
    rows = nodes.join(chosen, ["scene", "node"], "left")
    moved = rows.where(F.col("decided").isNotNull() & (F.col("decided") != F.col("status")))
    # What follows a changed node, one step at least: reach from its dependents.
    first = live.join(moved.select("scene", F.col("node").alias("src")), ["scene", "src"], "left_semi")
    hit = graph.reachable(live.select(*_qualified(live, "src", "dst")), first.select(*_qualified(first, "dst")), "src", "dst", "dst")
    hit = hit.select(F.split("node", "\x1f")[0].alias("_scene"), F.split("node", "\x1f")[1].alias("node"), F.lit(True).alias("_hit"))
    out = rows.join(hit, (rows["scene"].cast("string") == hit["_scene"]) & (rows["node"] == hit["node"]), "left").drop(hit["node"]).drop("_scene")
    changed = F.coalesce("_hit", F.lit(False))
    after = F.when(F.col("decided").isNotNull(), F.col("decided")).when(changed, "RECHECK").otherwise(F.col("status"))
    return out.withColumns({"changed": changed, "after": after}).drop("_hit", "decided")


def gate(states: DataFrame, edges: DataFrame) -> DataFrame:
    """states(scene, node, after, changed): no affirmative node stands on a required premise that isn't one.

    Every required propagating edge gates, changed or not; RECHECK goes on as RECHECK, anything else as OPEN. A round
    is a level of premises; as a node falls once, there are no more rounds than nodes.
    """
    need = edges.where(F.col("relation").isin(*PROPAGATING) & (F.coalesce("role", F.lit("REQUIRED")) == "REQUIRED")).select("scene", "src", "dst").distinct()
    need = graph._settle(need)
    while True:
        premise = need.join(states.select("scene", F.col("node").alias("src"), F.col("after").alias("p")), ["scene", "src"], "left")
        bad = premise.where(~F.coalesce(F.col("p").isin(*AFFIRMATIVE), F.lit(False)))
        bad = bad.groupBy("scene", F.col("dst").alias("node")).agg(F.bool_or(F.coalesce(F.col("p") == "RECHECK", F.lit(False))).alias("re"))
        joined = states.join(bad, ["scene", "node"], "left")
        falls = F.col("after").isin(*AFFIRMATIVE) & F.col("re").isNotNull()
        new = F.when(falls, F.when(F.col("re") | F.col("changed"), "RECHECK").otherwise("OPEN")).otherwise(F.col("after"))
        stepped = graph._settle(joined.select("scene", "node", "changed", F.col("after").alias("old"), new.alias("after")))
        states = stepped.select("scene", "node", "after", "changed")
        if stepped.where("old <> after").isEmpty():
            return states


def reconcile(nodes: DataFrame, refs: DataFrame, edges: DataFrame, conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(scene, node, kind, before, after): adequacy first, then conflicts, propagation and prerequisites.

    An affirmative observation needs adequate evidence and an explicit decision. A conflict(scene, conflict,
    node) stays open unless all its rivals are decided and exactly one is affirmative; its rivals then support
    nothing. An affirmative decision doesn't override a changed premise.
    """
    fit = observation_adequacy(assess(refs, nodes))
    chosen = decisions.groupBy("scene", "node").agg(F.max("state").alias("state"))
    obs = nodes.where("kind = 'observation'").join(fit, ["scene", "node"], "left").join(chosen, ["scene", "node"], "left")
    proposed = F.coalesce("state", "status")
    weak = proposed.isin(*AFFIRMATIVE) & (~F.coalesce("adequate", F.lit(False)) | F.col("state").isNull())
    settled = obs.select("scene", "node", F.when(weak, "OPEN").otherwise(F.col("state")).alias("state"), F.when(weak, "OPEN").otherwise(proposed).alias("now"), F.col("state").isNotNull().alias("explicit"))
    rivals = conflicts.join(settled, ["scene", "node"], "left")
    done = F.bool_and(F.coalesce("explicit", F.lit(False)) & F.coalesce(F.col("now").isin(*AFFIRMATIVE, "CONTRADICTED"), F.lit(False)))
    judged = rivals.groupBy("scene", "conflict").agg(done.alias("all_said"), F.count_if(F.coalesce(F.col("now").isin(*AFFIRMATIVE), F.lit(False))).alias("n"))
    open_ = conflicts.join(judged.where("NOT (all_said AND n = 1)"), ["scene", "conflict"], "left_semi").select("scene", "node").distinct().withColumn("rival", F.lit(True))
    held = settled.join(open_, ["scene", "node"], "left").select("scene", "node", F.when(F.col("rival") & F.col("now").isin(*AFFIRMATIVE), "OPEN").otherwise(F.col("state")).alias("state"))
    claims = chosen.join(nodes.where("kind = 'claim'").select("scene", "node"), ["scene", "node"], "left_semi")
    final = held.where("state is not null").unionByName(claims.select("scene", "node", "state"))
    spread = propagate(nodes, edges, final)
    spread = spread.withColumn("after", F.when(F.col("changed") & F.col("after").isin(*AFFIRMATIVE), "RECHECK").otherwise(F.col("after")))
    gated = gate(spread.select("scene", "node", "after", "changed"), edges)
    return nodes.select("scene", "node", "kind", F.col("status").alias("before")).join(gated.select("scene", "node", "after"), ["scene", "node"])


def agreement(refs: DataFrame) -> DataFrame:
    """For each scene and proposition: whether its observations share origins, and how their agreement counts.

    refs(scene, proposition, node, origin, contextual, declared). Groups are no votes.
    """
    shared = refs.groupBy("scene", "proposition", "origin").agg(F.count_distinct("node").alias("n")).groupBy("scene", "proposition").agg(F.max("n").alias("most"))
    g = refs.groupBy("scene", "proposition").agg(F.count_distinct("node").alias("n_nodes"), F.bool_or("contextual").alias("contextual"), F.bool_and("declared").alias("declared"))
    kind = (
        F.when(F.col("contextual"), "CONTEXT_INFLUENCED_OBSERVATION")
        .when(F.col("most") > 1, "DEPENDENT_CONSISTENCY")
        .when(F.col("declared") & (F.col("n_nodes") > 1), "INDEPENDENT_CORROBORATION")
        .otherwise("INDEPENDENCE_NOT_ESTABLISHED")
    )
    return g.join(shared, ["scene", "proposition"]).select("scene", "proposition", "n_nodes", kind.alias("agreement"))


def route_table(spark) -> DataFrame:
    rows = [(p, k, r, f) for p, routes in ROUTES.items() for k, (r, f) in enumerate(routes)]
    return spark.createDataFrame(rows, "proposition string, k int, route string, profile string")


def plan_queries(claims: DataFrame, max_requests: int = 60, max_frames: int = 360, max_audio: float = 120.0) -> DataFrame:
    """(scene, claim, route, profile, status, request, frames, audio_s) for claims(scene, claim, ord, proposition,
    start_s, end_s, state) that aren't affirmed.

    Routes come by a join, limits and costs are expressions, and equal requests merge into the first by a window.
    Only the ceilings are a greedy pass over what is left: a request that doesn't fit stays open and a later,
    smaller one may still be taken, which no running sum can say.
    """
    size = F.col("end_s") - F.col("start_s")
    temporal, auditory = F.col("route") == "TEMPORAL", F.col("route") == "AUDITORY"
    longest = F.when(F.col("route") == "MUSIC_IDENTITY", 120.0).when(auditory, F.when(F.col("profile") == "PERFORMANCE_MUSIC", 120.0).otherwise(30.0)).otherwise(float("inf"))
    asked = F.when(F.col("proposition") == "av_sync", "AV_SYNC").when(F.col("proposition") == "contact", "EXACT_CONTACT").when(F.col("proposition") == "event_order", "CONTACT_ORDER").otherwise("GENERAL_MOTION")
    rate = F.when(F.col("profile") == "TEMPORAL_LOW", 2).when(F.col("profile") == "TEMPORAL_HIGH", 12).otherwise(0)
    rows = claims.where(~F.col("state").isin(*AFFIRMATIVE)).join(F.broadcast(route_table(claims.sparkSession)), "proposition")
    rows = rows.withColumns({
        "subject": F.when(temporal, asked).otherwise(F.col("proposition")),
        "frames": F.when(temporal, F.ceil(size * rate)).when(F.col("route") == "STATIC", 1).otherwise(0).cast("int"),
        "audio_s": F.when(auditory, size).otherwise(0.0),
        "long": size > longest,
    })
    same = Window.partitionBy("scene", "route", "profile", "start_s", "end_s", "subject", "long").orderBy("ord", "k")
    rows = rows.withColumn("nth", F.row_number().over(same))
    fields = [f for f in rows.schema.fields if f.name not in ("status", "request")]

    def admit(g: dict) -> dict:
        number, left_frames, left_audio = 0, max_frames, max_audio
        taken: list[int | None] = []
        for first, is_long, n, s in zip(g["nth"] == 1, g["long"], g["frames"].tolist(), g["audio_s"].tolist(), strict=True):
            fits = first and not is_long and number < max_requests and n <= left_frames and s <= left_audio
            if fits:
                number, left_frames, left_audio = number + 1, left_frames - n, left_audio - s
            taken.append(number if fits else None)
        return {f.name: g[f.name] for f in fields} | {"request": taken}

    planned = by_group(rows, ["scene"], ["ord", "k"], admit, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", `request` int")
    # Those merged take the number of the request they are equal to, if that one was admitted.
    key = Window.partitionBy("scene", "route", "profile", "start_s", "end_s", "subject", "long")
    owner = F.max("request").over(key)
    status = (
        F.when(F.col("long"), "OPEN_REFINE_INTERVAL").when(F.col("request").isNotNull(), "PLANNED").when(owner.isNotNull(), "MERGED").otherwise("OPEN_RESOURCE_CEILING")
    )
    cost = lambda c, none: F.when(F.col("request").isNotNull(), F.col(c)).otherwise(none)
    return planned.select("scene", "claim", "route", "profile", status.alias("status"), owner.alias("request"), cost("frames", 0).alias("frames"), cost("audio_s", 0.0).alias("audio_s"))


def delta(before: DataFrame, after: DataFrame, witnesses_before: DataFrame, witnesses_after: DataFrame) -> DataFrame:
    """(scene, node, change, new_evidence): what changed between two snapshots of states, and whether the change
    rests on evidence whose origin and united span weren't there before. Renamed or repeated evidence isn't new."""
    a, b = before.select("scene", "node", F.col("after").alias("a")), after.select("scene", "node", F.col("after").alias("b"))
    kind = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(F.col("a") == F.col("b"), "SAME").otherwise("CHANGED")
    rows = a.join(b, ["scene", "node"], "full").withColumn("change", kind)
    from . import intervals

    keys = ["scene", "node", "origin"]
    old, new = (intervals.union(w, keys) for w in (witnesses_before, witnesses_after))
    fresh = intervals.missing(new, old, keys).select("scene", "node").distinct().withColumn("new_evidence", F.lit(True))
    return rows.join(fresh, ["scene", "node"], "left").select("scene", "node", "a", "b", "change", F.coalesce("new_evidence", F.lit(False)).alias("new_evidence"))
