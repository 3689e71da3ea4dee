"""Contracts as rows: every check adds a text to `violations`; nothing is raised inside executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strict_json

# Patterns of identifiers, digests, times and private values.
IDENTIFIER = r"[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}"
SHA256 = r"^[0-9a-f]{64}$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
PRIVATE_VALUE = r"(?i)(?:[A-Za-z]:[\\/]|(?:^|[\s\"'])/(?!/)\S+|\\\\|data:(?:audio|video|image)|audio_base64|input_audio|(?:sk-|sess-)[A-Za-z0-9_-]{12,})"
PRIVATE_NAMES = ["api_key", "credential", "authorization_header", "base64", "input_audio", "audio_data"]
LONGEST_PUBLIC = 8192


def when_not(condition: Column, text: str) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), F.lit(text))


def is_id(c: str) -> Column:
    return when_not(F.col(c).rlike(rf"^{IDENTIFIER}\z"), f"{c}: identifier")


def is_hash(c: str) -> Column:
    return when_not(F.col(c).rlike(SHA256), f"{c}: sha256")


def is_uuid(c: str) -> Column:
    return when_not(F.col(c).rlike(UUID), f"{c}: uuid")


def is_zoned(c: str) -> Column:
    return when_not(F.col(c).rlike(ZONED), f"{c}: time without zone")


def is_text(c: str, most: int = 10_000) -> Column:
    return when_not((F.length(F.trim(F.col(c))) > 0) & (F.length(c) <= most), f"{c}: text")


def is_choice(c: str, choices: list[str]) -> Column:
    return when_not(F.col(c).isin(*choices), f"{c}: choice")


def is_number(c: str, low: float | None = None, high: float | None = None) -> Column:
    value = F.col(c).cast("double")
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return when_not(ok, f"{c}: number")


def is_interval(a: str, b: str) -> Column:
    return when_not((F.col(a) >= 0) & (F.col(a) < F.col(b)), f"{a}, {b}: interval")


def check(df: DataFrame, *checks: Column) -> DataFrame:
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def unknown_fields(df: DataFrame, json: str, allowed: list[str]) -> DataFrame:
    """JSON objects with fields outside the closed set, with duplicates or non-finite numbers (not parsable)."""
    keys = F.json_object_keys(json)
    extra = F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))
    parsed = strict_json(F.col(json))
    return df.withColumns({"parsable": parsed.isNotNull(), "extra": F.coalesce(extra, F.array().cast("array<string>"))})


def manifest_diff(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Artifacts of manifests against files: MISSING, UNLISTED or CHANGED; empty if all match."""
    a = artifacts.select("run_id", "path", F.col("sha256").alias("told"))
    b = files.select("run_id", "path", F.col("sha256").alias("found"))
    kind = F.when(F.col("found").isNull(), "MISSING").when(F.col("told").isNull(), "UNLISTED").when(F.col("told") != F.col("found"), "CHANGED")
    return a.join(b, ["run_id", "path"], "full").withColumn("problem", kind).where("problem is not null")


def ordered_disjoint(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals that overlap the one before them in their group."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("_z", F.lag(end).over(w)).where(F.col(start) < F.col("_z")).drop("_z")


def private_leaks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of which a portable column can't be published, with `leaks`, the columns; must be empty before an export.

    A value leaks if it holds a path with a drive, an absolute or a network path, a media payload, a key, or is longer
    than LONGEST_PUBLIC; a column also by its name.
    """
    found = []
    for c in columns:
        named = any(part in c.casefold() for part in PRIVATE_NAMES)
        value = F.col(c).cast("string")
        leak = value.isNotNull() if named else F.coalesce(value.rlike(PRIVATE_VALUE) | (F.char_length(value) > LONGEST_PUBLIC), F.lit(False))
        found.append(F.when(leak, F.lit(c)))
    return df.withColumn("leaks", F.array_compact(F.array(*found))).where(F.size("leaks") > 0)


def rebind(portable: DataFrame, local: DataFrame) -> DataFrame:
    """Portable references(ref, sha256) with a local path(path, sha256) of equal content, or MISSING."""
    found = local.groupBy("sha256").agg(F.min("path").alias("path"))
    out = portable.join(found, "sha256", "left")
    return out.select("ref", "sha256", "path", F.when(F.col("path").isNull(), "MISSING").otherwise("BOUND").alias("status"))


def stage_parents(second: DataFrame, first: DataFrame) -> DataFrame:
    """Second-stage observations(id, parent_sha256, clips array, task) against their first stage(sha256, clips,
    task): clips must be equal, in order, and so must the task."""
    f = first.select(F.col("sha256").alias("parent_sha256"), F.col("clips").alias("first_clips"), F.col("task").alias("first_task"))
    status = (
        F.when(F.col("first_task").isNull(), "NO_PARENT")
        .when(F.col("clips") != F.col("first_clips"), "OTHER_CLIPS")
        .when(F.col("task") != F.col("first_task"), "OTHER_TASK")
        .otherwise("BOUND")
    )
    return second.join(f, "parent_sha256", "left").select("id", status.alias("status"))
