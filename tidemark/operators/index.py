"""A stored index of vectors, extended in generations.

Each generation adds Parquet files: its vectors under path/vectors/generation=n and its pairs under path/pairs/generation=n;
nothing that stands is rewritten. New vectors meet old ones and each other, old ones don't meet again, so the pairs of all
generations are those of one run over everything. They meet in blocks, as matrix products (`search.alike`, `search.within`),
and none is missed. Buckets by signs of projections, as `kernels.lsh_bands` makes them, met a fifth of all pairs at a
cosine of 0.8 in 64 dimensions before they missed few enough, and dealt every one of those.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search


def generations(spark: SparkSession, path: str) -> int:
    """How many generations stand: those whose mark was written last."""
    fs, where = _place(spark, f"{path}/done")
    return len(fs.listStatus(where)) if fs.exists(where) else 0


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _read(spark: SparkSession, path: str, part: str, upto: int, schema: str) -> DataFrame:
    # A schema, as a generation may have no rows and so no files.
    return spark.read.schema(schema).option("basePath", f"{path}/{part}").parquet(*[f"{path}/{part}/generation={n}" for n in range(upto)])


def extend(vectors: DataFrame, path: str, ident: str, vector: str, bits: int, bands: int, dim: int, least: float, most: int = 512) -> DataFrame:
    """Add a generation and return its pairs (a, b, cosine) of at least that cosine, a < b; also kept under path/pairs.

    Ids that the index holds are passed over, so adding a table twice adds nothing. A generation counts once its mark is
    written, which happens last and fails where another writer took the number; what a failed run left is not read.
    Vectors of another length than `dim` are held and have no pairs. bits, bands and most are from the time of buckets; they
    change nothing.
    """
    spark = vectors.sparkSession
    number = generations(spark, path)
    kinds = dict(vectors.dtypes)
    held_as = f"id {kinds[ident]}, v {kinds[vector]}"
    new = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    new = new.groupBy("id").agg(F.min("v").alias("v"))
    if number:
        new = new.join(_read(spark, path, "vectors", number, held_as).select("id"), "id", "left_anti")
    own = uuid.uuid4().hex
    staged = f"{path}/staged-{own}"
    new.write.parquet(f"{staged}/vectors")
    new = spark.read.schema(held_as).parquet(f"{staged}/vectors")
    fit = new.where(F.size("v") == dim)
    found = search.alike(fit, "id", "v", least)
    if number:
        old = _read(spark, path, "vectors", number, held_as).select("id", "v").where(F.size("v") == dim)
        met = search.within(fit, old, "id", "v", least)
        found = found.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine"))
    found.write.parquet(f"{staged}/pairs")

    fs, mark = _place(spark, f"{path}/done/{number}")
    fs.mkdirs(mark.getParent())
    fs.create(mark, False).close()  # refuses a number that another writer took
    for part in ("vectors", "pairs"):
        _, to = _place(spark, f"{path}/{part}/generation={number}")
        fs.mkdirs(to.getParent())
        if not fs.rename(_place(spark, f"{staged}/{part}")[1], to):
            raise OSError(f"can't rename to {to}")
    fs.delete(_place(spark, staged)[1], True)
    return spark.read.schema(_paired(kinds[ident])).parquet(f"{path}/pairs/generation={number}")


def _paired(kind: str) -> str:
    return f"a {kind}, b {kind}, cosine double"


def pairs(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """The pairs of all generations; kind is the type of the ids."""
    return _read(spark, path, "pairs", generations(spark, path), _paired(kind)).select("a", "b", "cosine")
