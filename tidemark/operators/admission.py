"""Admission: which features, streams, responses, packets, reviews and decisions may be used, with reasons as values.

Nothing is raised inside executors; what may not be used keeps its row and names why. A null input is not known, so it
never passes a check that needs a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strict_json
from . import intervals
from .contracts import UUID

# Channels that need a selected stream, judgments, dispositions and bounds of requests.
STREAM_CHANNELS = ["AO_STAGE1", "AO_STAGE2", "HL", "AM", "TVIS", "VO", "AVO", "MID"]
JUDGMENTS = ["broadly_accurate", "partly_accurate", "inaccurate", "uncertain", "abstain"]
DISPOSITIONS = ["SUPPORT", "CONSTRAIN", "CONTRADICT", "FAIL_TO_DISCRIMINATE"]
AGREEMENTS = ["AGREES", "DISAGREES", "NOT_COMPARABLE", "NOT_REVIEWED"]
LONGEST_SCENE, LONGEST_SECTION = 600.0, 120.0
MICROCLIP = {"clips": 4, "each": 30.0, "together": 60.0}
MOST_RELATIONS, MOST_RELEASES, MOST_ATTRIBUTES, MOST_CODES, LONGEST_TEXT = 200, 100, 20, 100, 2048


def reasons(*found: tuple[Column, str]) -> Column:
    """Texts of the conditions that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in found]))


def unknown(c: Column) -> Column:
    """c doesn't hold, or isn't known."""
    return ~F.coalesce(c, F.lit(False))


def blank(c: str) -> Column:
    return unknown(F.length(F.trim(F.col(c))) > 0)


# cues and streams


def cue_features(cues: DataFrame, features: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Features(keys, start_s, end_s, status) of cues(keys, start_s, end_s), one to one, where the intervals are equal.

    A cue without features is NOT_PROVIDED. Features of an unknown cue, several of one cue and features of another
    interval are violations and give no status.
    """
    own = cues.select(*keys, "start_s", "end_s", F.lit(True).alias("_cue"))
    told = features.groupBy(*keys).agg(F.count("*").alias("n_features"), F.min("start_s").alias("_a"), F.max("end_s").alias("_z"), F.min("status").alias("_status"))
    near = (F.abs(F.col("_a") - F.col("start_s")) <= tolerance) & (F.abs(F.col("_z") - F.col("end_s")) <= tolerance)
    many = F.coalesce("n_features", F.lit(0))
    wrong = F.when(F.col("_cue").isNull(), "UNKNOWN_CUE").when(many > 1, "DUPLICATE_FEATURE").when((many == 1) & unknown(near), "INTERVAL_DIFFERS")
    status = F.when(wrong.isNotNull(), None).when(many == 0, "NOT_PROVIDED").otherwise(F.coalesce("_status", F.lit("UNKNOWN")))
    return own.join(told, keys, "full").select(*keys, many.alias("n_features"), status.alias("feature_status"), wrong.alias("violation"))


def points_within(wanted: Column, available: Column, tolerance: float = 1e-6) -> Column:
    """Every wanted point is near an available one."""
    return F.forall(wanted, lambda x: F.exists(available, lambda y: F.abs(x - y) <= tolerance))


def frame_refusals(most_width: int = 8192) -> Column:
    """Why frames of a video stream can't be taken as they are.

    Reads width, side_data (array of types), side_rotation, rotate, sample_aspect_ratio, color_transfer,
    color_primaries, color_space, pix_fmt and bits_per_raw_sample; null is unknown, which only the width may not be.
    """
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    wide = text("color_transfer").isin("smpte2084", "arib-std-b67") | text("color_primaries").contains("2020") | text("color_space").contains("2020")
    deep = (F.coalesce(F.col("bits_per_raw_sample").cast("int"), F.lit(0)) > 8) | text("pix_fmt").rlike("(p|gray)(9|10|12|14|16)(le|be)?$")
    turned = F.exists(F.coalesce("side_data", F.array().cast("array<string>")), lambda x: F.lower(x).contains("display matrix"))
    return reasons(
        (unknown(F.col("width").between(0, most_width)), "WIDTH"),
        (turned | (F.coalesce("side_rotation", F.lit(0.0)) != 0), "DISPLAY_MATRIX"),
        (F.coalesce(F.col("rotate").cast("double"), F.lit(0.0)) != 0, "ROTATED"),
        (~F.coalesce("sample_aspect_ratio", F.lit("N/A")).isin("N/A", "0:1", "1:1"), "NON_SQUARE_PIXELS"),
        (wide | deep, "HDR_OR_HIGH_DEPTH"),
    )


def copy_refusals() -> Column:
    """Why packets can't be copied: reads video_codec, pix_fmt, audio_codec, origin_s and report_origin_s."""
    zero = lambda c: F.abs(c) <= 1e-9
    return reasons(
        (unknown((F.col("video_codec") == "h264") & (F.col("pix_fmt") == "yuv420p")), "VIDEO_CODEC"),
        (unknown(F.col("audio_codec") == "aac"), "AUDIO_CODEC"),
        (unknown(zero("origin_s") & zero("report_origin_s")), "ORIGIN"),
    )


# catalogue responses


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _text(v: Column, path: str) -> Column:
    """Texts only; numbers and objects are none."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def _unprintable(c: Column) -> Column:
    return c.isNotNull() & ((F.length(F.trim(c)) == 0) | (F.length(c) > LONGEST_TEXT) | c.rlike(r"[\x00-\x1f]"))


def catalogue_recordings(responses: DataFrame, response: str = "response", expected: str = "expected_id") -> DataFrame:
    """Recording responses (JSON) in one form: title, artist, isrcs, works, releases and violations.

    A relation is a work only with a target type of work and a proper work id; others are left out. Violations: not
    the recording that was asked for, lists that are too long, texts that are blank, long or unprintable, bad ids.
    """
    v = F.col("_v")
    none = F.array().cast("array<variant>")
    is_id = lambda c: F.coalesce(c.rlike(UUID), F.lit(False))
    names = F.transform(F.coalesce(_list(v, "$['artist-credit']"), none), lambda x: F.coalesce(_text(x, "$.name"), _text(x, "$.artist.name")))
    artist = F.array_join(F.array_compact(names), "; ")
    asked = F.filter(F.coalesce(_list(v, "$.relations"), none), lambda x: (_text(x, "$['target-type']") == "work") & is_id(_text(x, "$.work.id")))

    def work(x: Column) -> Column:
        attributes = F.transform(F.coalesce(_list(x, "$.attributes"), none), lambda y: F.try_variant_get(y, "$", "string"))
        return F.struct(_text(x, "$.work.id").alias("id"), _text(x, "$.work.title").alias("title"), _text(x, "$.type").alias("relation_type"), attributes.alias("attributes"))

    def release(x: Column) -> Column:
        return F.struct(_text(x, "$.id").alias("id"), _text(x, "$.title").alias("title"), _text(x, "$['release-group'].id").alias("release_group_id"))

    out = responses.withColumn("_v", strict_json(F.col(response))).withColumns(
        {
            "title": _text(v, "$.title"),
            "artist": F.when(F.length(artist) > 0, artist),
            "isrcs": F.transform(F.coalesce(_list(v, "$.isrcs"), none), lambda x: F.try_variant_get(x, "$", "string")),
            "works": F.transform(asked, work),
            "releases": F.transform(F.coalesce(_list(v, "$.releases"), none), release),
            "_own": _text(v, "$.id"),
            "_relations": F.size(F.coalesce(_list(v, "$.relations"), none)),
        }
    )
    texts = F.exists("works", lambda w: _unprintable(w["title"]) | _unprintable(w["relation_type"]) | F.exists(w["attributes"], _unprintable))
    ids = F.exists("releases", lambda r: ~is_id(r["id"]) | (r["release_group_id"].isNotNull() & ~is_id(r["release_group_id"])))
    found = reasons(
        (F.col("_v").isNull(), "NOT_JSON"),
        (F.col("_v").isNotNull() & (unknown(F.col("_own") == F.col(expected)) | ~is_id(F.col(expected))), "OTHER_RECORDING"),
        ((F.col("_relations") > MOST_RELATIONS) | F.exists("works", lambda w: F.size(w["attributes"]) > MOST_ATTRIBUTES), "RELATIONS"),
        ((F.size("releases") > MOST_RELEASES) | ids, "RELEASES"),
        (F.size("isrcs") > MOST_CODES, "ISRCS"),
        (_unprintable(F.col("title")) | _unprintable(F.col("artist")) | F.exists("isrcs", _unprintable) | F.exists("releases", lambda r: _unprintable(r["title"])) | texts, "TEXT"),
    )
    return out.withColumn("violations", found).drop("_v", "_own", "_relations")


# packets


def packet_violations(scenes: DataFrame, evidence: DataFrame, observations: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene, kind, id, violation) of everything that a scene packet may not hold.

    scenes(scene, start_s, end_s, duration_s), evidence(scene, id, channel, stream, start_s, end_s, pointer, stage1_id,
    context_ids), observations(scene, id, evidence_ids), claims(scene, id, observation_ids, has_routes),
    edges(scene, src, dst, relation, role). References are equi-joins on scene and id.
    """
    from .scene import PROPAGATING

    def rows(df: DataFrame, kind: str, bad: Column) -> DataFrame:
        return df.select("scene", F.lit(kind).alias("kind"), "id", F.explode(bad).alias("violation"))

    def one(df: DataFrame, kind: str, text: str) -> DataFrame:
        return df.select("scene", F.lit(kind).alias("kind"), "id", F.lit(text).alias("violation")).distinct()

    def unresolved(df: DataFrame, ids: str, kind: str, target: DataFrame, text: str) -> DataFrame:
        wanted = df.select("scene", "id", F.explode(ids).alias("_id"))
        return one(wanted.join(target.select("scene", F.col("id").alias("_id")).distinct(), ["scene", "_id"], "left_anti"), kind, text)

    bounds = scenes.groupBy("scene").agg(F.min("start_s").alias("_a"), F.max("end_s").alias("_z"))
    span = scenes.withColumn("id", F.col("scene").cast("string"))
    out = [
        rows(
            span,
            "scene",
            reasons(
                (unknown((F.col("start_s") >= 0) & (F.col("start_s") < F.col("end_s"))), "INTERVAL"),
                (F.col("end_s") - F.col("start_s") > LONGEST_SCENE, "TOO_LONG"),
                (F.col("end_s") > F.col("duration_s") + 1e-9, "BEYOND_SOURCE"),
            ),
        )
    ]
    placed = evidence.join(bounds, "scene", "left")
    pointer = F.col("pointer")
    out.append(
        rows(
            placed,
            "evidence",
            reasons(
                (unknown((F.col("start_s") >= F.col("_a") - 1e-9) & (F.col("end_s") <= F.col("_z") + 1e-9) & (F.col("start_s") < F.col("end_s"))), "OUTSIDE_SCENE"),
                (F.col("channel").isin(*STREAM_CHANNELS) & F.col("stream").isNull(), "NO_STREAM"),
                (pointer.isNotNull() & (~pointer.startswith("/") | pointer.rlike("~(?![01])")), "POINTER"),
                ((F.col("channel") == "AO_STAGE2") & (F.size(F.coalesce("context_ids", F.array().cast("array<string>"))) == 0), "NO_CONTEXT"),
            ),
        ).distinct()
    )
    for df, kind in ((evidence, "evidence"), (observations.select("scene", "id").unionByName(claims.select("scene", "id")), "node")):
        out.append(one(df.groupBy("scene", "id").agg(F.count("*").alias("n")).where("n > 1"), kind, "DUPLICATE"))
    out.append(unresolved(evidence, "context_ids", "evidence", evidence, "CONTEXT_MISSING"))
    first = evidence.where("channel = 'AO_STAGE1'").select("scene", F.col("id").alias("stage1_id"), F.struct("stream", "start_s", "end_s").alias("_first"))
    second = evidence.where("channel = 'AO_STAGE2'").select("scene", "id", "stage1_id", F.struct("stream", "start_s", "end_s").alias("_own"))
    held = second.join(first, ["scene", "stage1_id"], "left").groupBy("scene", "id").agg(F.bool_or(F.coalesce(F.col("_first") == F.col("_own"), F.lit(False))).alias("ok"))
    out.append(one(held.where("not ok"), "evidence", "STAGE1_LOCATOR"))
    out.append(one(observations.where("coalesce(size(evidence_ids), 0) < 1"), "observation", "NO_EVIDENCE"))
    out.append(unresolved(observations, "evidence_ids", "observation", evidence, "EVIDENCE_MISSING"))
    out.append(one(claims.where("coalesce(size(observation_ids), 0) < 1"), "claim", "NO_PREMISE"))
    out.append(unresolved(claims, "observation_ids", "claim", observations, "PREMISE_MISSING"))
    live = edges.where(F.col("relation").isin(*PROPAGATING)).select("scene", F.col("src").alias("_id"), F.col("dst").alias("id"))
    premises = claims.select("scene", "id", F.explode("observation_ids").alias("_id"))
    out.append(one(premises.join(live.distinct(), ["scene", "id", "_id"], "left_anti"), "claim", "PREMISE_WITHOUT_EDGE"))
    optional = edges.where("coalesce(role, 'REQUIRED') <> 'REQUIRED'").select("scene", F.col("src").alias("_id"), F.col("dst").alias("id")).distinct()
    out.append(one(claims.where("not coalesce(has_routes, false)").select("scene", "id", F.explode("observation_ids").alias("_id")).join(optional, ["scene", "id", "_id"], "left_semi"), "claim", "OPTIONAL_WITHOUT_ROUTES"))
    return reduce(DataFrame.unionByName, out)


# requests, reviews and decisions


def request_violations(requests: DataFrame, clips: DataFrame) -> DataFrame:
    """requests(request, profile, mode, allow_long, budget) and their clips(request, duration_s) against the bounds.

    A coherent section needs a musical profile, an explicit consent and a budget, and is one clip; consent and budget
    have no place in other requests.
    """
    d = F.col("duration_s")
    proper = (d > 0) & ~F.isnan(d) & (d < float("inf"))
    sums = clips.groupBy("request").agg(F.count("*").alias("n_clips"), F.sum(d).alias("_sum"), F.max(d).alias("_max"), F.bool_and(F.coalesce(proper, F.lit(False))).alias("_proper"))
    section, n = F.col("mode") == "coherent_section", F.coalesce("n_clips", F.lit(0))
    limit = lambda long, short: F.when(section, F.lit(long)).otherwise(F.lit(short))
    inside = n.between(1, limit(1, MICROCLIP["clips"])) & F.col("_proper") & (F.col("_max") <= limit(LONGEST_SECTION, MICROCLIP["each"])) & (F.col("_sum") <= limit(LONGEST_SECTION, MICROCLIP["together"]))
    paid = (F.col("budget") > 0) & ~F.isnan("budget") & (F.col("budget") < float("inf"))
    found = reasons(
        (unknown(F.col("mode").isin("microclip", "coherent_section")), "MODE"),
        (section & unknown((F.col("profile") == "PERFORMANCE_MUSIC") & F.col("allow_long")), "SECTION_NOT_ALLOWED"),
        (section & unknown(paid), "NO_BUDGET"),
        (~section & (F.col("allow_long").isNotNull() | F.col("budget").isNotNull()), "SECTION_FIELDS"),
        (unknown(inside), "BOUNDS"),
    )
    return requests.join(sums, "request", "left").select("request", n.alias("n_clips"), found.alias("violations"))


def scoped_review_violations(reviews: DataFrame, inspected: DataFrame, clips: DataFrame) -> DataFrame:
    """reviews(review, reviewer_type, reviewer, scope, judgment, date) of intervals(review, source, stream, start_s,
    end_s) that must lie in the union of the reviewed observation's clips(the same columns)."""
    key = ["review", "source", "stream"]
    beyond = intervals.missing(inspected, clips, key).select("review").distinct().withColumn("_beyond", F.lit(True))
    told = inspected.groupBy("review").agg(F.bool_and(F.coalesce((F.col("start_s") >= 0) & (F.col("start_s") < F.col("end_s")), F.lit(False))).alias("_proper"))
    day = F.col("date")
    found = reasons(
        (unknown(F.col("reviewer_type").isin("owner", "human")), "REVIEWER_TYPE"),
        (blank("reviewer"), "REVIEWER"),
        (blank("scope"), "SCOPE"),
        (unknown(F.col("judgment").isin(*JUDGMENTS)), "JUDGMENT"),
        (unknown(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr("try_cast(date AS date)").isNotNull()), "DATE"),
        (unknown(F.col("_proper")), "INTERVALS"),
        (F.coalesce("_beyond", F.lit(False)), "BEYOND_OBSERVATION"),
    )
    return reviews.join(told, "review", "left").join(beyond, "review", "left").select("review", found.alias("violations"))


def auditory_dispositions(claims: DataFrame, witnesses: DataFrame, decisions: DataFrame) -> DataFrame:
    """What decisions make of claims(claim, status) that have witnesses(claim, evidence_id; null: not admitted).

    decisions(claim, disposition, agreement, reviewer, reason, consequence). Without a decision the status stays and
    the witness awaits one; a witness alone promotes nothing. CONSTRAIN and CONTRADICT open the claim. A decision with
    violations has no effect. Decisions of claims without a witness come out with a null status.
    """
    met = witnesses.groupBy("claim").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    w = F.struct("disposition", "agreement", "reviewer", "reason", "consequence")
    made = decisions.groupBy("claim").agg(F.count("*").alias("_n"), F.min(w).alias("_d")).select("claim", "_n", "_d.*")
    known = claims.join(met, "claim").select("claim", F.col("status").alias("before_status"), "evidence_ids")
    out = known.join(made, "claim", "full")
    given = F.col("_n").isNotNull()
    found = F.when(
        given,
        reasons(
            (F.col("evidence_ids").isNull(), "NO_WITNESS"),
            (F.col("_n") > 1, "SEVERAL_DECISIONS"),
            (unknown(F.col("disposition").isin(*DISPOSITIONS)), "DISPOSITION"),
            (unknown(F.col("agreement").isin(*AGREEMENTS)), "AGREEMENT"),
            (blank("reviewer") | blank("reason") | blank("consequence"), "TEXT"),
            (F.col("disposition").isin("SUPPORT", "CONTRADICT") & (F.size("evidence_ids") == 0), "NO_AFFIRMATIVE_WITNESS"),
        ),
    ).otherwise(F.array().cast("array<string>"))
    ok = given & (F.size("violations") == 0)
    out = out.withColumn("violations", found)
    waiting = F.when(F.size("evidence_ids") > 0, "AWAITING_ADJUDICATION").when(F.size("evidence_ids") == 0, "FAIL_TO_DISCRIMINATE")
    opened = ok & F.col("disposition").isin("CONSTRAIN", "CONTRADICT")
    return out.select(
        "claim",
        "before_status",
        F.when(opened, "OPEN").otherwise(F.col("before_status")).alias("after_status"),
        F.when(ok, F.col("disposition")).otherwise(waiting).alias("disposition"),
        "evidence_ids",
        F.when(ok & (F.col("disposition") == "SUPPORT"), "EVIDENCE").when(ok & (F.col("disposition") == "CONTRADICT"), "COUNTEREVIDENCE").otherwise("PENDING").alias("attached_as"),
        "violations",
    )


def delta_dispositions(deltas: DataFrame) -> DataFrame:
    """Adds disposition and violation to deltas(before_statement, after_statement, changed, n_new_evidence, adequate,
    after_state, decision). Undecided changes are OPEN, what is unchanged is PRESERVE."""
    same = F.coalesce(F.col("before_statement") == F.col("after_statement"), F.lit(False))
    gone = F.col("after_statement").isNull()
    strong = (F.col("n_new_evidence") > 0) & F.col("after_state").isin("SUPPORTED", "CONFIRMED") & F.col("adequate")
    wanted = F.col("decision")
    wrong = (
        F.when((wanted == "PRESERVE") & ~same, "PRESERVE_HIDES_A_CHANGE")
        .when((wanted == "STRENGTHEN") & (gone | unknown(strong)), "STRENGTHEN_WITHOUT_SUPPORT")
        .when((wanted == "REVISE") & (gone | same), "REVISE_WITHOUT_FORMULATION")
        .when(wanted.isin("STRENGTHEN", "PRESERVE") & ~gone & F.col("changed") & F.col("after_state").isin("RECHECK", "OPEN"), "PREMISES_NOT_REVIEWED")
    )
    automatic = F.when(F.coalesce("changed", F.lit(True)), "OPEN").otherwise("PRESERVE")
    return deltas.withColumn("violation", wrong).withColumn("disposition", F.when(wanted.isNotNull() & F.col("violation").isNull(), wanted).otherwise(automatic))


def usage_cost(usage: DataFrame, tariff: DataFrame, aliases: list[str], most: int | None = 10**9) -> DataFrame:
    """usage(model, kind, tokens) in decimal dollars by tariff(model, kind, usd_per_million).

    A dated revision of a model in `aliases` has its price; other names must be equal. Counts under 0 or over `most` (None:
    no limit) and unknown models have no cost, which is null and not 0.
    """
    base = F.col("model")
    for alias in aliases:
        base = F.when(F.col("model").startswith(alias + "-"), alias).otherwise(base)
    price = tariff.select(F.col("model").alias("_model"), "kind", F.col("usd_per_million").cast("decimal(12,6)").alias("_price"))
    priced = usage.withColumn("_model", base).join(price, ["_model", "kind"], "left")
    n = F.col("tokens")
    tokens = F.when((n >= 0) if most is None else n.between(0, most), n).cast("decimal(19,0)")
    return priced.withColumn("usd", (tokens * F.col("_price") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,12)")).drop("_model", "_price")
