"""As-of joins by one sort: both sides are stacked and the nearest row of the other side is carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _stack(left: DataFrame, right: DataFrame, on: list[str], lt: str, rt: str, rid: str) -> DataFrame:
    a = left.select(*on, F.col(lt).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(rt, rid)).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"))
    b = right.select(*on, F.col(rt).alias("_t"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(F.col(rt).alias("_rt"), F.col(rid).alias("_rid")).alias("_r"), F.lit(0).alias("_side"))
    return a.unionByName(b.withColumn("_r", F.col("_r").cast(a.schema["_r"].dataType)))


def nearest(left: DataFrame, right: DataFrame, on: list[str], lt: str, rt: str, rid: str) -> DataFrame:
    """left with before_t, before_id (last at or before) and after_t, after_id (first at or after).

    Rows of right at one time are taken by the smallest id. Nulls where there is none.
    """
    own = right.where(F.col(rt).isNotNull()).groupBy(*on, rt).agg(F.min(rid).alias(rid))
    stacked = _stack(left, own, on, lt, rt, rid)
    back = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*on).orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = stacked.select("_l", F.last("_r", ignorenulls=True).over(back).alias("_b"), F.last("_r", ignorenulls=True).over(ahead).alias("_a"))
    return both.where("_l is not null").select(
        "_l.*",
        F.col("_b")[rt].alias("before_t"),
        F.col("_b")[rid].alias("before_id"),
        F.col("_a")[rt].alias("after_t"),
        F.col("_a")[rid].alias("after_id"),
    )


def choose(joined: DataFrame, t: str, most: float) -> DataFrame:
    """The nearer neighbour (the earlier of two as near) and its proximity status."""
    db, da = F.col(t) - F.col("before_t"), F.col("after_t") - F.col(t)
    earlier = F.col("after_t").isNull() | (F.col("before_t").isNotNull() & (db <= da))
    picked = joined.withColumns({"near_t": F.when(earlier, F.col("before_t")).otherwise(F.col("after_t")), "near_id": F.when(earlier, F.col("before_id")).otherwise(F.col("after_id"))})
    status = (
        F.when(F.col("before_t").isNull() | F.col("after_t").isNull(), "OUTSIDE_FRAME_POINT_RANGE")
        .when(F.abs(F.col(t) - F.col("near_t")) <= most, "NEARBY")
        .otherwise("DISTANT")
    )
    return picked.withColumn("status", status)


def forward(left: DataFrame, right: DataFrame, on: list[str], lt: str, rt: str, rid: str) -> DataFrame:
    """left with the first row of right at or after it; no such row: nulls and NO_FRAME."""
    found = nearest(left, right, on, lt, rt, rid).drop("before_t", "before_id")
    return found.withColumn("status", F.when(F.col("after_id").isNull(), "NO_FRAME").otherwise("FOUND"))
