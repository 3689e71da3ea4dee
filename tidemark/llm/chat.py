"""Tool-call linking for chats, with DataFrame functions only.

Calls and results are joined by conversation and identifier, put in topological order, their arguments validated
against schemas and serialised as canonical JSON (sorted keys, no spaces).

A message of role `assistant` carries calls if its text is a JSON object, whatever white space stands before it, whose
`tool_calls` (id, name, arguments, after) can be read and list one call at least; no other role calls tools. A message of
role `tool` with a `tool_call_id` is a result. Every user turn, whatever its text looks like, is a call of the tool
`reply` with identifier `conversation:turn`, answered by the assistant's plain message of the next turn and depending on
the user turn two before. So a text that only looks like calls, or lists none, is a plain message of its role.

Linking: identifiers belong to their conversation. A result answers the last call of its identifier in an earlier
turn, and a call takes the first result it gets, so an identifier that is used again starts anew.

Topological order: (turn, level, place). A dependency leads to a call of the same message, or else to a call of an
earlier turn. `level` is the longest chain of dependencies within the message, found by relaxing the levels of a
message's calls until none changes; calls that stand on a cycle, or follow one, have none. A call is `in_order` if
it has a level and all it depends on exists in its message or earlier.

A result's content that is a JSON text counts as that text; any other JSON value is serialised canonically as itself.

Defined results: null texts are empty; calls and results without a conversation, a turn or an identifier link with
nothing, and such calls, plain user turns among them, keep their rows and have a null call_id if it can't be formed; ties: calls that repeat an identifier in one turn all get the same result,
and of results of one turn the smallest text counts; repeated rows keep their rows; results without an earlier call
are left out; an empty table gives no rows; texts of any length are read whole; columns beside conv_id, turn, role and
text are not looked at. A task sorts at most the calls and results of one identifier of one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tools, with (argument, JSON type, required, limits); limits are minLength, maxLength, minimum and maximum.
SCHEMAS = {"reply": [("prompt", "string", True, {"minLength": 1, "maxLength": 240}), ("turn", "integer", True, {"minimum": 0})]}
_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
_TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


def messages(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _identifier(turn: Column) -> Column:
    return F.concat_ws(":", F.col("conv_id"), turn)


def _told() -> Column:
    """The calls that an assistant's message lists; null where it lists none."""
    start = F.regexp_replace("text", r"^[ \t\r\n]+", "")
    found = F.from_json(start, _CALLS, {"mode": "PERMISSIVE"})["tool_calls"]
    looks = (F.col("role") == "assistant") & F.contains("text", F.lit('"tool_calls"')) & F.startswith(start, F.lit("{"))
    return F.when(looks & F.try_parse_json(start).isNotNull() & (F.size(found) > 0), found)


def _levels(listed: Column) -> Column:
    """For each call of a message (level, outside): its level, null on or after a cycle, and the identifiers that it
    needs from other messages. The relaxation stops as soon as a round changes nothing."""
    size = F.size(listed)
    places = F.sequence(F.lit(0), size - 1)
    inside = F.transform(listed, lambda c, i: F.filter(places, lambda j: (j != i) & F.array_contains(c["after"], F.get(listed, j)["id"])))

    def relaxed(needs: Column) -> Column:
        start = F.struct(F.transform(needs, lambda _: F.lit(0)).alias("level"), F.lit(True).alias("moved"))

        def step(state: Column, _: Column) -> Column:
            level = F.transform(needs, lambda n: F.aggregate(n, F.lit(0), lambda most, j: F.greatest(most, F.get(state["level"], j) + 1)))
            return F.when(~state["moved"], state).otherwise(F.struct(level.alias("level"), (level != state["level"]).alias("moved")))

        return F.aggregate(F.sequence(F.lit(1), F.size(needs)), start, step)["level"]

    # Bound to a variable, so that dependencies are looked up once.
    levels = F.transform(F.array(inside), relaxed)[0]
    other = lambda c, i: F.filter(c["after"], lambda n: n.isNotNull() & ~F.exists(places, lambda j: (j != i) & F.get(listed, j)["id"].eqNullSafe(n)))
    outside = F.transform(listed, lambda c, i: F.coalesce(other(c, i), F.array().cast("array<string>")))
    return F.zip_with(levels, outside, lambda v, o: F.struct(F.when(v < size, v).alias("level"), o.alias("outside")))


def calls(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, call_id, name, arguments, level, outside) of every call."""
    rows = messages(rows)
    told = rows.where(F.contains("text", F.lit('"tool_calls"'))).select("conv_id", "turn", _told().alias("c")).where(F.size("c") > 0)
    told = told.select("conv_id", "turn", F.posexplode(F.arrays_zip(F.col("c").alias("c"), _levels(F.col("c")).alias("o"))).alias("place", "x"))
    told = told.select("conv_id", "turn", "place", F.col("x.c.id").alias("call_id"), "x.c.name", "x.c.arguments", "x.o.level", "x.o.outside")
    plain = rows.where(F.col("role") == "user")
    plain = plain.select(
        "conv_id",
        "turn",
        F.lit(0).alias("place"),
        F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), _identifier(F.col("turn"))).alias("call_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"))).alias("arguments"),
        F.lit(0).alias("level"),
        F.when((F.col("turn") >= 2) & F.col("conv_id").isNotNull(), F.array(_identifier(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("outside"),
    )
    return told.unionByName(plain)


def results(rows: DataFrame) -> DataFrame:
    """(conv_id, call_id, result_turn, content, raw) of every result that can be linked; raw content is JSON already."""
    rows = messages(rows)
    value = F.try_variant_get(F.try_parse_json("text"), "$.content", "variant")
    raw = value.isNotNull() & (F.schema_of_variant(value) != "STRING")
    told = rows.where(F.col("role") == "tool").select(
        "conv_id",
        F.get_json_object("text", "$.tool_call_id").alias("call_id"),
        F.col("turn").alias("result_turn"),
        F.coalesce(F.when(raw, F.to_json(value)), F.get_json_object("text", "$.content"), F.lit("")).alias("content"),
        F.coalesce(raw, F.lit(False)).alias("raw"),
    )
    plain = rows.where((F.col("role") == "assistant") & _told().isNull())
    plain = plain.select("conv_id", _identifier(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("result_turn"), F.col("text").alias("content"), F.lit(False).alias("raw"))
    return told.unionByName(plain).where("conv_id is not null and result_turn is not null and call_id is not null")


def _unmet(call: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, need) where a call depends on something no earlier turn has. No texts are moved for it."""
    edges = call.where(F.size("outside") > 0).select("conv_id", "turn", "call_id", F.explode("outside").alias("need"))
    known = call.where("conv_id is not null and turn is not null and call_id is not null").groupBy("conv_id", F.col("call_id").alias("need")).agg(F.min("turn").alias("first_turn"))
    late = edges.join(known, ["conv_id", "need"], "left").where(~F.coalesce(F.col("first_turn") < F.col("turn"), F.lit(False)))
    return late.select("conv_id", "call_id", "turn", "need").distinct()


def violations(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """What is wrong with a call's arguments, as sorted texts."""
    parsed = F.try_parse_json(arguments)
    known = F.lit(False)
    found = [F.when(parsed.isNull(), F.lit("arguments: not JSON"))]
    for tool, fields in schemas.items():
        own = F.coalesce(name == tool, F.lit(False))
        known = known | own
        for field, kind, required, *limits in fields:
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            type_ = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
            wrong = value.isNotNull() & ~type_.isin(*_TYPES[kind])
            if kind == "integer":  # a whole number is one however it is written
                real = F.try_variant_get(parsed, f"$.{field}", "double")
                wrong = wrong & ~(type_.isin(*_TYPES["number"]) & F.coalesce(real == F.floor(real), F.lit(False)))
            if required:
                found.append(F.when(own & parsed.isNotNull() & value.isNull(), F.lit(f"{field}: missing")))
            found.append(F.when(own & wrong, F.lit(f"{field}: not {kind}")))
            size = F.char_length(F.try_variant_get(parsed, f"$.{field}", "string"))
            number = F.try_variant_get(parsed, f"$.{field}", "double")
            breaks = {
                "minLength": lambda most, s=size: (s < most, "too short"),
                "maxLength": lambda most, s=size: (s > most, "too long"),
                "minimum": lambda most, v=number: (v < most, "too small"),
                "maximum": lambda most, v=number: (v > most, "too large"),
            }
            for limit, most in (limits[0] if limits else {}).items():
                bad, text = breaks[limit](most)
                found.append(F.when(own & ~wrong & bad, F.lit(f"{field}: {text}")))
    found.append(F.when(~known, F.lit("name: unknown tool")))
    return F.sort_array(F.array_compact(F.array(*found)))


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys and without spaces; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(arguments))


def link(rows: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call: (conv_id, turn, place, level, call_id, result_turn, linked, in_order, errors, json).

    Calls, results and unmet dependencies are stacked and dealt once by conversation and identifier; one sort by
    falling turn gives each call the nearest result and the nearest call of its identifier after it.
    """
    call = calls(rows)
    own = F.struct("place", "level", "name", "arguments", "outside")
    call_rows = call.select("conv_id", "call_id", "turn", own.alias("c"), F.lit(None).cast("string").alias("content"), F.lit(False).alias("raw"), F.lit(0).alias("kind"))
    no_call = F.lit(None).cast(call_rows.schema["c"].dataType)
    result_rows = results(rows).select("conv_id", "call_id", F.col("result_turn").alias("turn"), no_call.alias("c"), "content", "raw", F.lit(1).alias("kind"))
    unmet_rows = _unmet(call).select("conv_id", "call_id", "turn", no_call.alias("c"), F.col("need").alias("content"), F.lit(False).alias("raw"), F.lit(2).alias("kind"))
    stacked = call_rows.unionByName(result_rows).unionByName(unmet_rows)
    # Calls that can't be linked are dealt by their arguments, so that they don't meet in one task.
    loose = F.col("conv_id").isNull() | F.col("call_id").isNull() | F.col("turn").isNull()
    stacked = stacked.withColumn("alone", F.when(loose, F.xxhash64("c", "turn")))
    falling = Window.partitionBy("conv_id", "call_id", "alone").orderBy(F.desc("turn"))
    later, same = falling.rangeBetween(Window.unboundedPreceding, -1), falling.rangeBetween(Window.currentRow, Window.currentRow)
    placed = stacked.withColumns({
        "r": F.min(F.when(F.col("kind") == 1, F.struct(F.col("turn").alias("result_turn"), "content", "raw"))).over(later),
        "again": F.min(F.when(F.col("kind") == 0, F.col("turn"))).over(later),
        "unmet": F.collect_set(F.when(F.col("kind") == 2, F.col("content"))).over(same),
    }).where("kind = 0")
    answered = ~loose & F.col("r").isNotNull() & F.coalesce(F.col("r.result_turn") <= F.col("again"), F.lit(True))
    placed = placed.withColumn("r", F.when(answered, F.col("r")))

    clean = canonical(F.col("c.arguments"))
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    # {"v":...} without its first five characters and its last one.
    value = lambda c: F.substring(quoted(c), F.lit(6), F.length(quoted(c)) - 6)
    text = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(value(c))
    body = F.concat(
        F.lit('{"arguments":'),
        F.coalesce(clean, F.lit("null")),
        F.lit(',"id":'),
        text(F.col("call_id")),
        F.lit(',"name":'),
        value(F.coalesce("c.name", F.lit(""))),
        F.lit(',"result":'),
        F.when(F.col("r.raw"), F.col("r.content")).otherwise(text(F.col("r.content"))),
        F.lit("}"),
    )
    return placed.select(
        "conv_id",
        "turn",
        F.col("c.place").alias("place"),
        F.col("c.level").alias("level"),
        "call_id",
        F.col("r.result_turn").alias("result_turn"),
        F.col("r").isNotNull().alias("linked"),
        (F.col("c.level").isNotNull() & ~F.arrays_overlap("c.outside", "unmet")).alias("in_order"),
        F.array_join(violations(F.col("c.name"), F.col("c.arguments"), schemas), "; ").alias("errors"),
        body.alias("json"),
    )
