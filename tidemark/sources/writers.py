"""Writers: create-exclusive tables, JSON lines, WebVTT, staged runs with a manifest as commit mark, archives."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import vtt_stamp


def create(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a table that must not exist yet; NaN and infinity are refused."""
    for name, kind in df.dtypes:
        if kind in ("double", "float") and not df.where(F.isnan(name) | (F.abs(name) == float("inf"))).isEmpty():
            raise ValueError(f"{name} holds a value that isn't finite")
    df.write.mode("errorifexists").format(fmt).option("header", True).save(path)


def webvtt(cues: DataFrame) -> DataFrame:
    """(value) blocks of WebVTT, one for each cue; write with lineSep two line breaks after a WEBVTT header."""
    return cues.orderBy("start_s", "end_s").select(F.concat_ws("\n", F.concat(vtt_stamp(F.col("start_s")), F.lit(" --> "), vtt_stamp(F.col("end_s"))), F.col("text")).alias("value"))


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def publish(tables: dict[str, DataFrame], root: str, run_id: str) -> dict[str, int]:
    """Write a run's tables under _staging, count and digest them as read back, rename, and write the manifest last.

    A run without a COMMITTED manifest isn't committed; one that fails leaves a FAILED one. Returns rows by table.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, final = _fs(spark, f"{root}/{run_id}")
    if fs.exists(final):
        raise FileExistsError(run_id)
    staged = f"{root}/_staging/{run_id}"
    found: dict[str, tuple[int, str]] = {}

    def manifest(state: str) -> None:
        listed = [(run_id, k, *found.get(k, (None, None)), state) for k in tables]
        spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/_manifests")

    try:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{staged}/{name}")
            found[name] = digest(spark.read.parquet(f"{staged}/{name}"))
        _, source = _fs(spark, staged)
        if not fs.rename(source, final):
            raise OSError(f"can't rename {staged}")
    except Exception:
        manifest("FAILED")
        raise
    manifest("COMMITTED")
    return {k: n for k, (n, _) in found.items()}


MANIFEST = "run_id string, artifact string, n_rows long, digest string, state string"


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever the order of its rows and files: the sum of its rows' hashes, in one pass."""
    held = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    # Two hashes of a row, so that equal sums of different tables don't happen by chance.
    a, b = F.xxhash64(*held), F.xxhash64(F.lit("row"), *held)
    r = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(x.cast("decimal(20,0)")), F.lit(0)).cast("string").alias(k) for k, x in (("a", a), ("b", b))]).first()
    return r["n"], hashlib.sha256(f"{r['n']}/{r['a']}/{r['b']}/{df.schema.simpleString()}".encode()).hexdigest()


def committed(spark: SparkSession, root: str, run_id: str, table: str, verify: bool = False) -> DataFrame:
    """A table of a committed run; with verify, one that isn't what was published is an error."""
    manifest = spark.read.schema(MANIFEST).json(f"{root}/_manifests")
    mark = manifest.where((F.col("run_id") == run_id) & (F.col("artifact") == table) & (F.col("state") == "COMMITTED")).first()
    if mark is None:
        raise FileNotFoundError(f"{run_id} has no committed {table}")
    df = spark.read.parquet(f"{root}/{run_id}/{table}")
    if verify and digest(df)[1] != mark["digest"]:
        raise ValueError(f"{table} of {run_id} isn't what was published")
    return df


def pack(files: list[Path], target: Path) -> str:
    """A ZIP whose bytes depend on names and contents alone; its SHA-256. A few report files, on the driver."""
    with zipfile.ZipFile(target, "x", zipfile.ZIP_DEFLATED) as z:
        listed = {}
        for f in sorted(files, key=lambda p: p.name):
            if f.name.startswith(("/", ".")) or ".." in f.name:
                raise ValueError(f"unsafe name {f.name}")
            data = f.read_bytes()
            listed[f.name] = hashlib.sha256(data).hexdigest()
            z.writestr(zipfile.ZipInfo(f.name, (1980, 1, 1, 0, 0, 0)), data)
        z.writestr(zipfile.ZipInfo("MANIFEST.json", (1980, 1, 1, 0, 0, 0)), json.dumps(listed, sort_keys=True))
    return hashlib.sha256(target.read_bytes()).hexdigest()


def verify_pack(target: Path) -> list[str]:
    """Names in a ZIP that are missing, unlisted or changed."""
    with zipfile.ZipFile(target) as z:
        listed = json.loads(z.read("MANIFEST.json"))
        found = {n: hashlib.sha256(z.read(n)).hexdigest() for n in z.namelist() if n != "MANIFEST.json"}
    return sorted(n for n in listed.keys() | found.keys() if listed.get(n) != found.get(n))
