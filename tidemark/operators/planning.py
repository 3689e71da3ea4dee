"""Planners: ceilings, escalation, interval proposals, request merges, preflight tables, support routes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped import by_group


def under_ceiling(requests: DataFrame, keys: list[str], order: list[str], cost: str, ceiling: float) -> DataFrame:
    """requests with `admitted`: in order, each that still fits is taken and the others are passed over.

    No running sum can say this, as a later, smaller request can fit after a larger one didn't; so each group's
    requests, a plan of bounded size, are passed through once in order, thousands of groups to a Python call. A null cost is never admitted.
    """
    fields = [f for f in requests.schema.fields if f.name != "admitted"]
    rows = requests.select(*[f.name for f in fields])

    def admit(g: dict) -> dict:
        used, taken = 0.0, []
        for price in g[cost].astype(float).tolist():
            fits = used + price <= ceiling
            taken.append(fits)
            used += price if fits else 0.0
        return {f.name: g[f.name] for f in fields} | {"admitted": taken}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", `admitted` boolean"
    return by_group(rows, keys, order, admit, schema)


def merge_requests(requests: DataFrame, keys: list[str], claim: str) -> DataFrame:
    return requests.groupBy(*keys).agg(F.sort_array(F.collect_set(claim)).alias("claims"))


def escalation(windows: DataFrame, frames: str, rate: str, chain: tuple[int, ...] = (2, 8, 12)) -> DataFrame:
    """Next sampling rate of the chain for windows that aren't settled, COMPLETE after the last."""
    step = F.lit("COMPLETE")
    for low, high in reversed(list(zip((0, *chain[:-1]), chain, strict=True))):
        step = F.when(F.col(rate) <= low, F.concat(F.lit(str(high)), F.lit(" fps"))).otherwise(step)
    return windows.withColumn("next_step", F.when(F.col(frames) == 0, "NO_FRAMES").when(F.col("settled"), "SETTLED").otherwise(step))


def request_limits(clips: DataFrame, key: str, seconds: str, most: int, each: float, total: float) -> DataFrame:
    """Requests whose clips break a limit: how many, the longest, their sum."""
    g = clips.groupBy(key).agg(F.count("*").alias("n_clips"), F.max(seconds).alias("longest"), F.sum(seconds).alias("total"))
    bad = F.array_compact(
        F.array(
            F.when((F.col("n_clips") < 1) | (F.col("n_clips") > most), F.lit("clips")),
            F.when(F.col("longest") > each, F.lit("clip length")),
            F.when(F.col("total") > total, F.lit("total length")),
        )
    )
    return g.withColumn("violations", bad)


def proposals(spans: DataFrame, pad: float, bound: str) -> DataFrame:
    """Padded, before and after proposals of each span, clipped to [0, bound) and without empty ones."""
    lo, hi = F.col("start_s"), F.col("end_s")
    rows = F.array(
        F.struct(F.lit("PADDED").alias("kind"), F.greatest(F.lit(0.0), lo - pad).alias("from_s"), F.least(F.col(bound), hi + pad).alias("to_s")),
        F.struct(F.lit("BEFORE").alias("kind"), F.greatest(F.lit(0.0), lo - pad).alias("from_s"), lo.alias("to_s")),
        F.struct(F.lit("AFTER").alias("kind"), hi.alias("from_s"), F.least(F.col(bound), hi + pad).alias("to_s")),
    )
    return spans.select("*", F.inline(rows)).where(F.col("from_s") < F.col("to_s"))


def preflight(streams: DataFrame) -> DataFrame:
    """Capability of each source and modality from its streams(source, kind, attached, codec)."""
    live = streams.where(~F.col("attached")).groupBy("source", "kind").agg(F.count("*").alias("n"))
    state = F.when(F.col("n") == 1, "AVAILABLE").when(F.col("n") > 1, "AMBIGUOUS_SELECTION")
    kinds = streams.select("source").distinct().crossJoin(F.broadcast(streams.sparkSession.createDataFrame([("audio",), ("video",), ("subtitle",)], "kind string")))
    return kinds.join(live, ["source", "kind"], "left").select("source", "kind", F.coalesce(state, F.lit("MISSING")).alias("capability"))


def select_stream(streams: DataFrame, key: str, kind: str) -> DataFrame:
    """The single stream of a kind that isn't an attached picture, or OPEN_SELECTION_REQUIRED."""
    live = streams.where((F.col("kind") == kind) & ~F.col("attached"))
    return live.groupBy(key).agg(F.when(F.count("*") == 1, F.min("stream").cast("string")).otherwise("OPEN_SELECTION_REQUIRED").alias("selection"))


def support_routes(routes: DataFrame) -> DataFrame:
    """The smallest set of groups, then the first in order, with one adequate member for every channel of a claim.

    routes(claim, channel, grp, adequate). A claim has a few channels; one row holds its groups. The best set is kept
    for every set of channels still open, from the last group to the first; no group is left out.
    """

    by_channel = routes.groupBy("claim", "channel").agg(F.collect_set(F.when(F.col("adequate"), F.col("grp"))).alias("grps"))
    options = by_channel.groupBy("claim").agg(F.sort_array(F.collect_list(F.struct("channel", "grps"))).alias("options"))
    kind = dict(routes.dtypes)["grp"]
    groups = F.reverse(F.array_sort(F.array_distinct(F.flatten(F.transform("options", lambda o: o["grps"])))))
    covers = lambda g: F.aggregate("options", F.struct(F.lit(0).alias("k"), F.lit(0).alias("m")), lambda a, o: F.struct((a["k"] + 1).alias("k"), (a["m"] + F.when(F.array_contains(o["grps"], g), F.pow(F.lit(2), a["k"]).cast("int")).otherwise(0)).alias("m")))["m"]
    listed = options.select("claim", F.pow(F.lit(2), F.size("options")).cast("int").alias("full"), F.transform(groups, lambda g: F.struct(covers(g).alias("m"), g.alias("g"))).alias("gs"))
    start = F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("n"), F.array().cast(f"array<{kind}>").alias("route")))

    def step(best: Column, x: Column) -> Column:
        """The best selection for every set of channels, with or without one more group."""
        more = F.transform(best, lambda e: F.struct(e["m"].bitwiseOR(x["m"]).alias("m"), (e["n"] + 1).alias("n"), F.concat(F.array(x["g"]), e["route"]).alias("route")))
        every = F.concat(best, more)
        least = F.transform(F.array_distinct(F.transform(every, lambda e: e["m"])), lambda m: F.array_min(F.filter(every, lambda e: e["m"] == m)))
        return least

    best = listed.select("claim", F.get(F.filter(F.aggregate("gs", start, step), lambda e: e["m"] == F.col("full") - 1), F.lit(0)).alias("r"))
    return best.select("claim", F.array_join(F.col("r.route").cast("array<string>"), ",").alias("route"), F.coalesce("r.n", F.lit(0)).alias("n_groups"))


#: Bits of what a selection must show, and what a direct claim and an av_sync claim need.
SAME_PROPOSITION, TEMPORAL_VISUAL, EVENT_TIMING = 1, 2, 4


def assess_routes(routes: DataFrame, members: DataFrame) -> DataFrame:
    """(claim, route, selected, missing, status, reasons) of support routes(claim, route, proposition).

    members(claim, route, slot, node, adequate, covered, same_proposition, temporal_visual, event_timing,
    insufficient_alone): slot 0 holds what is essential, every other slot observations that can stand for each other.
    A member is usable if it is adequate, covers a direct claim, and isn't the only one where it can't stand alone.
    One selection is kept for each of the eight states of the three flags, so slots aren't multiplied out; of those
    that show what the proposition needs the first in order is taken, else the first of all.
    """
    key = ["claim", "route"]
    direct = ~F.col("proposition").isin("interpretation", "emotion")
    rows = members.join(routes.select(*key, "proposition"), key)
    alone = rows.groupBy(*key).agg((F.count_if(F.col("slot") == 0) + F.count_distinct(F.when(F.col("slot") != 0, F.col("slot"))) == 1).alias("single"))
    rows = rows.join(alone, key)
    usable = F.col("adequate") & (~direct | F.col("covered")) & ~(F.col("single") & F.col("insufficient_alone"))
    bits = F.when(F.col("same_proposition"), SAME_PROPOSITION).otherwise(0) + F.when(F.col("temporal_visual"), TEMPORAL_VISUAL).otherwise(0) + F.when(F.col("event_timing"), EVENT_TIMING).otherwise(0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("flags", F.when(F.col("ok"), bits).otherwise(0))
    slots = rows.groupBy(*key, "slot").agg(F.sort_array(F.collect_list(F.struct("node", "flags", "ok", "covered"))).alias("ms"))
    whole = slots.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("slot", "ms"))).alias("slots"))
    none = F.array().cast("array<string>")
    own = F.coalesce(F.flatten(F.transform(F.filter("slots", lambda s: s["slot"] == 0), lambda s: s["ms"])), F.array())
    whole = whole.withColumn("own", own)
    shown = F.aggregate("own", F.lit(0), lambda a, m: a.bitwiseOR(m["flags"]))
    first = F.array(F.struct(shown.alias("state"), F.transform("own", lambda m: m["node"]).alias("sel")))
    start = F.struct(first.alias("sels"), F.transform(F.filter("own", lambda m: ~m["ok"]), lambda m: m["node"]).alias("missing"))

    def step(acc: Column, s: Column) -> Column:
        good = F.filter(s["ms"], lambda m: m["ok"])
        every = F.flatten(F.transform(acc["sels"], lambda e: F.transform(good, lambda m: F.struct(e["state"].bitwiseOR(m["flags"]).alias("state"), F.array_sort(F.concat(e["sel"], F.array(m["node"]))).alias("sel")))))
        least = F.transform(F.array_distinct(F.transform(every, lambda e: e["state"])), lambda k: F.array_min(F.filter(every, lambda e: e["state"] == k)))
        lost = F.concat(acc["missing"], F.transform(s["ms"], lambda m: m["node"]))
        empty = F.size(good) == 0
        return F.struct(F.when(empty, acc["sels"]).otherwise(least).alias("sels"), F.when(empty, lost).otherwise(acc["missing"]).alias("missing"))

    done = whole.withColumn("r", F.aggregate(F.filter("slots", lambda s: s["slot"] != 0), start, step))
    out = routes.join(done.select(*key, "slots", "r"), key, "left")
    need = F.when(F.col("proposition") == "av_sync", TEMPORAL_VISUAL + EVENT_TIMING).when(direct, SAME_PROPOSITION).otherwise(0)
    out = out.withColumn("viable", F.filter("r.sels", lambda e: e["state"].bitwiseAND(need) == need))
    pick = F.array_min(F.transform(F.when(F.size("viable") > 0, F.col("viable")).otherwise(F.col("r.sels")), lambda e: e["sel"]))
    out = out.withColumns({"picked": F.coalesce(pick, none), "no_viable": F.size("viable") <= 0})
    bare = F.exists(F.flatten(F.transform("slots", lambda s: s["ms"])), lambda m: F.array_contains("picked", m["node"]) & ~m["covered"])
    av = F.col("proposition") == "av_sync"
    reasons = F.array_compact(F.array(
        F.when(av & F.col("no_viable"), "NO_REVIEWED_SYNCHRONISATION"), F.when(direct & F.coalesce(bare, F.lit(False)), "INTERVAL_NOT_COVERED"), F.when(direct & ~av & F.col("no_viable"), "NOT_COMPETENT"),
    ))
    out = out.withColumns({"selected": F.array_sort(F.array_distinct("picked")), "missing": F.array_sort(F.array_distinct(F.coalesce("r.missing", none))), "reasons": reasons})
    status = F.when((F.size("missing") == 0) & (F.size("reasons") == 0), "SURVIVES").otherwise("OPEN")
    return out.select(*key, "selected", "missing", status.alias("status"), "reasons")


def first_viable(selections: Column) -> Column:
    """Lexicographically smallest of an array of selections."""
    return F.array_min(selections)


def frame_grid(requests: DataFrame, start: str, end: str, rate: float) -> DataFrame:
    """Sample times of each request at a rate, its start included and its end not."""
    n = F.greatest(F.lit(1), F.ceil((F.col(end) - F.col(start)) * rate - 1e-9).cast("int"))
    return requests.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).withColumn("sample_t", F.col(start) + F.col("k") / F.lit(rate))


def greedy_suppress(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], most_overlap: float) -> DataFrame:
    """In the given order, keep an interval unless a kept one of its group covers more than that share of it.

    Intervals without a bound aren't kept. Only intervals that overlap decide on each other, so a group is cut where
    none does and every part is passed through alone; within it only kept intervals near by are looked at.
    """
    from . import intervals

    names = df.columns

    def run(g: dict) -> dict:
        begins, ends, longest, rows = [], [], 0, []
        for i, (a, z) in enumerate(zip(g[start].tolist(), g[end].tolist(), strict=True)):
            size = max(z - a, 1e-12)
            near = range(bisect_left(begins, a - longest), bisect_left(begins, z))
            if all(min(z, ends[k]) - max(a, begins[k]) <= most_overlap * size for k in near):
                k = bisect_right(begins, a)
                begins.insert(k, a)
                ends.insert(k, z)
                longest = max(longest, z - a)
                rows.append(i)
        return {k: g[k][rows] for k in names}

    parts = intervals.islands(df.where(F.col(start).isNotNull() & F.col(end).isNotNull()), keys, start, end, 0.0)
    return by_group(parts, [*keys, "island"], order, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))


def cap_matches(df: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    """The first rows of each group in order, with `truncated` where there were more."""
    from pyspark.sql.window import Window

    # One rank more than asked for tells whether there were more; Spark cuts every task's rows to that before it shuffles.
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= cap + 1)
    return ranked.withColumn("truncated", F.max("rank").over(Window.partitionBy(*keys)) > cap).where(F.col("rank") <= cap)
