"""Connected components by contraction, for graphs of any size.

Every round each label adopts its smallest neighbour if that is smaller, chains of adoptions are followed to
their roots by doubling, and edges are drawn between roots. Rounds number about the logarithm of the longest
chain of local minima. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node of an edge. Nulls, loops and repeats don't matter."""
    left, right = F.col(a), F.col(b)
    pairs = edges.where(left.isNotNull() & right.isNotNull() & (left != right)).select(
        F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi")
    )
    pairs = materialise(pairs.distinct(), "edges")
    labels = None
    while not pairs.isEmpty():
        parent = pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up"))
        parent = materialise(parent, "parents")
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialise(
                parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")),
                "parents",
            )
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            roots = pairs.select(F.col("lo").alias("node")).join(parent, "node", "left_anti").distinct()
            labels = parent.select("node", F.col("up").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
        else:
            labels = labels.join(parent.select(F.col("node").alias("label"), "up"), "label", "left").select(
                "node", F.coalesce("up", "label").alias("label")
            )
        labels = materialise(labels, "labels")
        drawn = (
            pairs.join(parent.select(F.col("node").alias("lo"), F.col("up").alias("lo_up")), "lo", "left")
            .join(parent.select(F.col("node").alias("hi"), F.col("up").alias("hi_up")), "hi", "left")
            .select(F.coalesce("lo_up", "lo").alias("x"), F.coalesce("hi_up", "hi").alias("y"))
            .where("x <> y")
            .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
            .distinct()
        )
        pairs = materialise(drawn, "edges")
    if labels is None:
        labels = pairs.select(F.col("lo").alias("node"), F.col("hi").alias("label"))
    return labels
