"""Readers for the table contracts. Paths are whatever Spark can read."""

from __future__ import annotations

import io
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as text_functions


def file_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, size, sha256, kind) of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.lit(kind).alias("kind"))


def strict_json(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, as text and variant; null where keys repeat or numbers aren't finite."""
    docs = spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")
    return docs.withColumn("doc", text_functions.strict_json(F.col("raw")))


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Strings unless a schema says otherwise; a byte-order mark in front of the first name goes."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", False).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences from JSON (a list or {"occurrences": [...]}), CSV, TSV or Parquet, by suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("csv", "tsv"):
        return csv(spark, path, sep="\t" if suffix == "tsv" else ",")
    if suffix == "json":
        df = spark.read.option("multiLine", True).json(path)
        return df.select(F.explode("occurrences").alias("o")).select("o.*") if df.columns == ["occurrences"] else df
    raise ValueError(f"no reader for {path}")


def json_records(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """Records of JSON arrays, or of JSON lines."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def subrip(spark: SparkSession, path: str) -> DataFrame:
    """(path, cue_index, start_s, end_s, text, malformed) of SRT files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    blocks = files.select("path", F.posexplode(F.split(F.trim("v"), r"\n[ \t]*\n+")).alias("cue_index", "b"))
    stamp = r"(\d+):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})"
    part = lambda k: F.regexp_extract("b", stamp, k).try_cast("double")
    at = lambda k: part(k) * 3600 + part(k + 1) * 60 + part(k + 2) + part(k + 3) / 1000
    body = F.trim(F.regexp_replace("b", r"^(\s*\d+[ \t]*\n)?[^\n]*-->[^\n]*\n?", ""), F.lit(" \t\n"))
    out = blocks.select("path", "cue_index", at(1).alias("start_s"), at(5).alias("end_s"), text_functions.strip_tags(body).alias("text"))
    return out.withColumn("malformed", F.coalesce(F.col("start_s") >= F.col("end_s"), F.lit(True)))


def substation(spark: SparkSession, path: str) -> DataFrame:
    """(path, cue_index, start_s, end_s, name, text_raw, text_plain) of the Dialogue lines of ASS and SSA files."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "v"))
    f = F.split(F.regexp_replace("v", r"^Dialogue:\s*", ""), ",", 10)
    said = lines.where(F.col("v").startswith("Dialogue:")).where(F.size(f) == 10)
    return said.select(
        "path",
        F.col("line").alias("cue_index"),
        text_functions.timecode(F.trim(f[1])).alias("start_s"),
        text_functions.timecode(F.trim(f[2])).alias("end_s"),
        F.trim(f[4]).alias("name"),
        f[9].alias("text_raw"),
        text_functions.plain_caption(f[9]).alias("text_plain"),
    )


def caption_ledger(cues: DataFrame, listed: list[str]) -> DataFrame:
    """cues with `excluded`: MALFORMED, BLANK, LISTED, or null for those retained."""
    bad = F.col("start_s").isNull() | F.col("end_s").isNull() | (F.col("start_s") >= F.col("end_s"))
    return cues.withColumn("excluded", F.when(bad, "MALFORMED").when(F.trim("text") == "", "BLANK").when(F.col("text").isin(*listed) if listed else F.lit(False), "LISTED"))


WAV = "path string, format int, channels int, rate long, bits int, data_bytes long, frames long, problem string"


def _wav(path: str, raw: bytes) -> tuple:
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return (path, None, None, None, None, None, None, "not RIFF/WAVE")
    at, fmt, data = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(raw):
            fmt = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            data = min(size, len(raw) - at - 8)
            if data < size:
                return (path, None, None, None, None, data, None, "data is cut off")
        at += 8 + size + size % 2
    if not fmt or data is None or not fmt[4]:
        return (path, None, None, None, None, None, None, "no fmt or data chunk")
    return (path, fmt[0], fmt[1], fmt[2], fmt[5], data, data // fmt[4], None)


def _wav_rows(frames):
    for frame in frames:
        yield pd.DataFrame([_wav(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=[c.split()[0] for c in WAV.split(", ")])


def wav_identity(spark: SparkSession, path: str) -> DataFrame:
    """Format fields of WAV files, or what is wrong with them."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_wav_rows, WAV)


def _npz_rows(frames):
    import numpy as np

    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                sizes = {len(z[k]) for k in z.files}
                if len(sizes) != 1:
                    raise ValueError(f"{path}: columns of different length")
                for k in z.files:
                    yield pd.DataFrame({"path": path, "field": k, "i": np.arange(len(z[k])), "value": z[k].astype(float)})


def track_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, field, i, value) of NPZ tracks; NaN becomes null."""
    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_npz_rows, "path string, field string, i long, value double")
    return df.withColumn("value", F.nanvl("value", F.lit(None)))


def tags(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """(source, tag, value, conflict) of allowed tags from a map column; conflict: several values."""
    pairs = rows.select("source", F.explode(F.map_entries("tags")).alias("e")).select("source", F.lower("e.key").alias("tag"), F.trim("e.value").alias("value"))
    kept = pairs.where(F.col("tag").isin(*allowed))
    return kept.groupBy("source", "tag").agg(F.min("value").alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def stream_bounds(packets: DataFrame) -> DataFrame:
    """Bounds of each stream from packets(source, stream, pts, duration, tb_num, tb_den)."""
    at = lambda c: c * F.col("tb_num") / F.col("tb_den")
    return packets.groupBy("source", "stream").agg(
        F.min(at(F.col("pts"))).alias("start_s"),
        F.max(at(F.col("pts") + F.coalesce("duration", F.lit(0)))).alias("end_s"),
        F.bool_or(F.col("duration").isNull()).alias("estimated"),
        F.count("*").alias("n_packets"),
    )


def cues_of_runs(runs: DataFrame) -> DataFrame:
    """One row for each cue of runs with an array of cues."""
    return runs.select("run_id", F.posexplode("cues").alias("cue_no", "c")).select("run_id", "cue_no", "c.*")
