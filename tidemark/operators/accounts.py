"""A shared ledger that several writers append to, and accounts whose limit no two of them can pass together.

Rows are written first, under a name of their own. They count once a mark with the next revision's number exists, which is
created exclusively (as exclusively as the store creates files): of two writers one gets the number, the other looks at the ledger again and asks its guard anew. So
revisions have no gaps and no twins, a guard's answer holds for exactly the ledger that its rows follow, and what a lost
writer left behind is never read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

ENTRY = "account string, request string, kind string, amount decimal(18,9)"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _marks(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed parts by revision."""
    fs, where = _place(spark, f"{path}/revisions")
    if not fs.exists(where):
        return []
    numbers = sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())
    out = []
    for n in numbers:
        for _ in range(100):  # a mark that was only just created is about to get its content
            stream = fs.open(_place(spark, f"{path}/revisions/{n}")[1])
            name = bytes(stream.readAllBytes()).decode()
            stream.close()
            if name:
                break
            time.sleep(0.02)
        out.append(name)
    return out


def read(spark: SparkSession, path: str, schema: str = ENTRY, upto: int | None = None) -> DataFrame:
    """The rows of all revisions, or of the first `upto`, with their revision from 1."""
    typed = spark.createDataFrame([], schema).schema
    whole = StructType([*typed.fields, StructField("revision", LongType())])
    marks = _marks(spark, path)[:upto]
    parts = [spark.read.schema(typed).parquet(f"{path}/parts/{name}").withColumn("revision", F.lit(n + 1).cast("long")) for n, name in enumerate(marks) if name]
    out = spark.createDataFrame([], whole)
    for part in parts:
        out = out.unionByName(part)
    return out


def append(rows: DataFrame, path: str, guard: Callable[[DataFrame], bool] | None = None, attempts: int = 100) -> int | None:
    """Append rows as the next revision and return its number; None if the guard, asked with the ledger that they would
    follow, says no. A number that another writer took is asked for again with the ledger as it is then."""
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    name = uuid.uuid4().hex
    written = False
    for _ in range(attempts):
        last = len(_marks(spark, path))
        if guard is not None and not guard(read(spark, path, schema, last)):
            return None
        if not written:
            rows.write.parquet(f"{path}/parts/{name}")
            written = True
        fs, mark = _place(spark, f"{path}/revisions/{last}")
        fs.mkdirs(mark.getParent())
        try:
            out = fs.create(mark, False)
        except Exception as e:
            if "exist" not in str(e).lower():
                raise
            continue
        out.write(bytearray(name.encode()))
        out.close()
        return last + 1
    raise TimeoutError(f"another writer took every number for {attempts} times")


def balances(ledger: DataFrame) -> DataFrame:
    """(account, held, spent) of entries: a reservation holds its amount until the request is settled; then the settled
    amount is spent. A request's first entry of a kind counts, so a repeated one changes nothing."""
    first = ledger.groupBy("account", "request", "kind").agg(F.min_by("amount", "revision").alias("amount"))
    each = first.groupBy("account", "request").agg(F.max(F.when(F.col("kind") == "reserve", F.col("amount"))).alias("reserved"), F.max(F.when(F.col("kind") == "settle", F.col("amount"))).alias("settled"))
    zero = F.lit(Decimal(0)).cast("decimal(18,9)")
    held = F.when(F.col("settled").isNull(), F.coalesce("reserved", zero)).otherwise(zero)
    return each.groupBy("account").agg(F.sum(held).alias("held"), F.sum(F.coalesce("settled", zero)).alias("spent"))


def reserve(spark: SparkSession, path: str, account: str, request: str, amount: Decimal, limit: Decimal) -> int | None:
    """Hold an amount if what is held and spent leaves room for it; None if not. A request that is held already gets the
    revision it has."""
    if amount < 0:
        raise ValueError("an amount is not below zero")
    taken: list[int] = []

    def fits(ledger: DataFrame) -> bool:
        own = ledger.where((F.col("account") == account) & (F.col("request") == request) & (F.col("kind") == "reserve")).agg(F.min("revision")).first()[0]
        taken[:] = [own] if own else []
        used = balances(ledger.where(F.col("account") == account)).select(F.col("held") + F.col("spent")).first()
        return not taken and (used[0] if used else Decimal(0)) + amount <= limit

    number = append(spark.createDataFrame([(account, request, "reserve", amount)], ENTRY), path, fits)
    return taken[0] if number is None and taken else number


def settle(spark: SparkSession, path: str, account: str, request: str, amount: Decimal) -> int | None:
    """What a reserved request came to. None if it isn't reserved or is settled; more than was reserved is refused."""

    def open_(ledger: DataFrame) -> bool:
        own = ledger.where((F.col("account") == account) & (F.col("request") == request))
        kinds = {r["kind"]: r["amount"] for r in own.groupBy("kind").agg(F.min_by("amount", "revision").alias("amount")).collect()}
        return "reserve" in kinds and "settle" not in kinds and Decimal(0) <= amount <= kinds["reserve"]

    return append(spark.createDataFrame([(account, request, "settle", amount)], ENTRY), path, open_)
