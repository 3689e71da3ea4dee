"""Graphs as edge tables: components, reachability, order, cycles, dependence groups.

Loops run on the driver and look only at whether a table is empty or at its count; each round's table is written as
Parquet to the shared folder, so lineage stays short, lost executors cost one round, and joins know their sizes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what lies there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM has gone already; the folder's owner clears it
            pass

    atexit.register(remove)
    return path


def _settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back; the folder's tables go when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, "round")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Contraction: every node takes its smallest neighbour for a parent where that is smaller, parents are followed to
    their roots by doubling, and edges are drawn between roots. Each round has fewer edges, and rounds number about
    the logarithm of the longest chain of local minima. A node of loops only is its own component.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    left = _settle(known.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
    nodes = known.select(F.col("x").alias("node")).unionByName(known.select(F.col("y").alias("node"))).distinct()
    labels = _settle(nodes.select("node", F.col("node").alias("component")))
    while not left.isEmpty():
        up = _settle(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            stepped = _settle(up.join(over, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
            up = stepped.select("node", "root")
            if stepped.where("moved").isEmpty():
                break
        labels = _settle(labels.join(up.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        rooted = left.join(up.select(F.col("node").alias("lo"), F.col("root").alias("lr")), "lo", "left").join(up.select(F.col("node").alias("hi"), F.col("root").alias("hr")), "hi", "left")
        ends = rooted.select(F.coalesce("lr", "lo").alias("p"), F.coalesce("hr", "hi").alias("q")).where("p <> q")
        left = _settle(ends.select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).distinct())
    return labels


def shared_key_components(members: DataFrame, ident: str, keys: list[str]) -> DataFrame:
    """Components of rows that share any of the keys: a bipartite graph of rows and key values."""
    edges = None
    for k in keys:
        part = members.where(F.col(k).isNotNull()).groupBy(F.col(k)).agg(F.min(ident).alias("hub"))
        part = members.join(part, k).select(F.col(ident).alias("a"), F.col("hub").alias("b"))
        edges = part if edges is None else edges.unionByName(part)
    return components(edges, "a", "b")


def reachable(edges: DataFrame, roots: DataFrame, src: str, dst: str, ident: str, most: int | None = None) -> DataFrame:
    """(node, depth) reachable from the roots, with the least number of steps; up to `most` steps if that is given.

    A round is a step: depths need one for each level of the graph.
    """
    step = _settle(edges.select(F.col(src).alias("node"), F.col(dst).alias("to")).distinct())
    seen = front = _settle(roots.select(F.col(ident).alias("node")).distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while most is None or depth < most:
        depth += 1
        new = front.join(step, "node").select(F.col("to").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = _settle(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front) if depth % 16 else _settle(seen.unionByName(front))
    return seen


def ancestors(edges: DataFrame, claims: DataFrame, src: str, dst: str, ident: str) -> DataFrame:
    return reachable(edges, claims, dst, src, ident)


def cyclic_nodes(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node) that lie on a cycle or between two: empty for a DAG. Edges whose source nothing enters, or whose end
    nothing leaves, are peeled off from both sides until none goes."""
    left = _settle(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    before = left.count()
    while before:
        entered, left_from = left.select(F.col("d").alias("s")).distinct(), left.select(F.col("s").alias("d")).distinct()
        left = _settle(left.join(entered, "s", "left_semi").join(left_from, "d", "left_semi"))
        now = left.count()
        if now == before:
            break
        before = now
    return left.select(F.col("s").alias("node")).unionByName(left.select(F.col("d").alias("node"))).distinct()


#: Edges that a task of edge_violations takes, about.
EDGES_TOGETHER = 500_000


def edge_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Typed edges checked as rows: repeated, dangling, or from a claim to an observation.

    Edges are dealt to as many tasks as hold EDGES_TOGETHER each; left to itself, Spark joins partitions up to a size in
    compressed bytes, of which a task's memory is a large multiple.
    """
    parts = max(1, -(-edges.count() // EDGES_TOGETHER))
    kind = lambda end: nodes.select(F.col("node").alias(end), F.col("kind").alias(end + "_kind"))
    counted = edges.repartition(parts, "src", "dst", "relation").groupBy("src", "dst", "relation").agg(F.count("*").alias("n"))
    typed = counted.repartition(parts, "src").join(kind("src"), "src", "left").repartition(parts, "dst").join(kind("dst"), "dst", "left")
    checks = F.array(
        F.when(F.col("n") > 1, F.lit("repeated")),
        F.when(F.col("src_kind").isNull() | F.col("dst_kind").isNull(), F.lit("dangling")),
        F.when((F.col("src_kind") == "claim") & (F.col("dst_kind") == "observation"), F.lit("claim to observation")),
    )
    return typed.select("src", "dst", "relation", F.array_compact(checks).alias("violations")).where(F.size("violations") > 0)


def propagate_changes(edges: DataFrame, changed: DataFrame, states: DataFrame) -> DataFrame:
    """states with `state` RECHECK for everything that depends on a changed node, the node itself apart."""
    hit = reachable(edges, changed, "src", "dst", "node").where("depth > 0").select("node", F.lit(True).alias("_hit"))
    return states.join(hit, "node", "left").withColumn("state", F.when(F.col("_hit"), "RECHECK").otherwise(F.col("state"))).drop("_hit")


def dependence_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Observations with their group: shared origin, shared assumption or one reached from the other."""
    shared = nodes.select("node", "origin", "assumption")
    by_key = None
    for k in ("origin", "assumption"):
        hub = shared.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("node").alias("b"))
        part = shared.join(hub, k).select(F.col("node").alias("a"), "b")
        by_key = part if by_key is None else by_key.unionByName(part)
    linked = by_key.unionByName(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    found = components(linked, "a", "b")
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("group"))


def agreement(observations: DataFrame, groups: DataFrame) -> DataFrame:
    """For each proposition: independent groups, verdicts, and whether they agree."""
    g = observations.join(groups, "node").groupBy("proposition")
    n, v = F.count_distinct("group"), F.count_distinct("verdict")
    kind = F.when(v > 1, "CONFLICT").when(n > 1, "INDEPENDENT_AGREEMENT").otherwise("DEPENDENT")
    return g.agg(n.alias("n_groups"), v.alias("n_verdicts"), kind.alias("agreement"))


def spread_failure(nodes: DataFrame, requires: DataFrame) -> DataFrame:
    """(node) that aren't ok, or require one that isn't, directly or through others.

    nodes(node, ok), requires(node, needs); a required node that doesn't exist isn't ok. Every round fails what
    requires a failed node, drops requirements that are met for good, and lets a node that requires one with a single
    requirement require that one instead. Chains so take the logarithm of their length, other graphs one round for a
    level. Nodes that only require each other in a circle stay ok.
    """
    ids = _settle(nodes.groupBy("node").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")))
    edges = requires.select("node", "needs").distinct().join(ids.select("node"), "node", "left_semi")
    loose = edges.join(ids.select(F.col("node").alias("needs")), "needs", "left_anti").select("node")
    failed = _settle(ids.where("NOT ok").select("node").unionByName(loose).distinct())
    edges = _settle(edges)
    idle, size, enough = 0, edges.count(), ids.count().bit_length() + 2
    # Without a new failure or an edge less in that many rounds, what is left are circles.
    while size and idle <= enough:
        hit = edges.join(failed.select(F.col("node").alias("needs")), "needs", "left_semi").select("node").distinct()
        fresh = _settle(hit.join(failed, "node", "left_anti"))
        found = not fresh.isEmpty()
        if found:
            failed = _settle(failed.unionByName(fresh))
        # Who has failed needs nothing more.
        live = _settle(edges.join(failed, "node", "left_anti"))
        single = live.groupBy("node").agg(F.count("*").alias("n"), F.min("needs").alias("next")).where("n = 1").select(F.col("node").alias("needs"), "next")
        own = live.select(F.col("node").alias("needs")).distinct().withColumn("waits", F.lit(True))
        bad = failed.select(F.col("node").alias("needs"), F.lit(True).alias("bad"))
        seen = live.join(own, "needs", "left").join(bad, "needs", "left").join(single, "needs", "left")
        kept = seen.where("waits OR bad").select("node", F.when(F.col("bad"), F.col("needs")).otherwise(F.coalesce("next", "needs")).alias("needs"))
        edges = _settle(kept.where("node <> needs").distinct())
        now = edges.count()
        idle = 0 if found or now < size else idle + 1
        size = now
    return failed


def reconcile(claims: DataFrame, evidence: DataFrame, requires: DataFrame, conflicts: DataFrame) -> DataFrame:
    """States of claims by a fixpoint: adequacy first, conflicts next, then required claims.

    claims(node), evidence(node, adequate), requires(node, needs), conflicts(node). A claim is SUPPORTED with
    adequate evidence, no conflict and every required claim SUPPORTED; OPEN without evidence; UNRESOLVED else.
    """
    have = evidence.groupBy("node").agg(F.bool_or("adequate").alias("ok"))
    state = claims.select("node").distinct().join(have, "node", "left").join(conflicts.select("node").distinct().withColumn("c", F.lit(True)), "node", "left")
    state = _settle(
        state.select("node", F.when(F.col("ok").isNull(), "OPEN").when(F.col("c") | ~F.col("ok"), "UNRESOLVED").otherwise("SUPPORTED").alias("state"))
    )
    failed = spread_failure(state.select("node", (F.col("state") == "SUPPORTED").alias("ok")), requires).withColumn("f", F.lit(True))
    fell = (F.col("state") == "SUPPORTED") & F.coalesce("f", F.lit(False))
    return state.join(failed, "node", "left").select("node", F.when(fell, "UNRESOLVED").otherwise(F.col("state")).alias("state"))
