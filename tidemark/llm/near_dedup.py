"""Near-duplicate detection: bottom-k sketches of one hash, inverted lists, union-sketch estimates, exact Jaccard.

1. A document's distinct five-word shingles are hashed to 64 bits; equal sets are one class from then on. The SKETCH
   smallest hashes of a class are its sketch, in the hash's own order.
2. A pair's estimate is the share of the smallest values of its union that both sketches retain. Pairs whose estimate
   is more than DEVIATIONS standard deviations under the threshold are no candidates, so a candidate's sketches share
   at least `_least_shared` values. A class that shares fewer with all others together is done.
3. Full sets of the classes left are spelled out once. A class whose values are shared by others to less than the
   threshold has no link and is done too; this bound is exact. The rest get a wide sketch of WIDE values, which for
   most is their whole set and makes the estimate exact.
4. Inverted lists of retained values, ordered by rarity, generate the overlaps: candidates share a value among the
   rarest |sketch| - least + 1 of both (prefix filter), where values nobody shares use up places.
5. Every list has a pivot, the member with the fewest unshared values. Pairs with the pivot, linear in the list, are
   filtered by their union-sketch estimate and verified by exact Jaccard of the full sets; components are found.
6. Only pairs of different components remain. They are generated from the same lists, each where its prefixes meet
   first, under bounds of size and of what can follow from there, filtered by their estimate and verified. Nothing is capped: groups of copies end in step 1, groups of near
   copies mostly in step 5, and chance meetings under the bounds of steps 2 to 4.

Links are confirmed on full sets: 100 * intersection >= percent * union. Sets are of 64-bit hashes: two different
shingles of a set of n are one value with a chance of n^2 / 2^65.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; fewer than five words are
one shingle; very long texts are read whole, and their sets live in one row; rows that repeat an id are judged by
their own texts; ties are decided by the smaller id, then by the smaller set digest; a null id is never the smallest,
so rows with one link others and only name a component (as null) if no member has an id; an empty table gives no
rows; columns beside doc_id and text are not looked at and come through `keep_one` unchanged.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, RunHashes, materialise, release
from .components import connected

WORDS = 5
#: Links of op7; a stage takes STAGE_PERCENT.
PERCENT, STAGE_PERCENT = 85, 80
#: Values of the sketch that every document gets, and of the one that is made of the classes left.
SKETCH, WIDE, DEVIATIONS = 32, 1024, 5.0
#: Up to so many ids (about 60 bytes each in the join's table) are broadcast to pick texts in the scan; more ids make
#: it a shuffled join.
BROADCAST_IDS = 1_000_000


class Shingler:
    """Hashes of the distinct shingles of a text, ascending."""

    def __init__(self):
        self.runs = RunHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []
        return np.unique(self.runs(words, min(WORDS, len(words))))


SKETCHES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("sig", T.BinaryType()),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]
)


def _digest(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    """Hashes as signed numbers in the same order."""
    at = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
    values = (np.concatenate(sets) ^ np.uint64(1 << 63)).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def _sketch_rows(batches):
    shingle = Shingler()
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            n, sig, kept = [], [], []
            for text in part.column(1).to_pylist():
                h = shingle(text)
                n.append(len(h))
                sig.append(_digest(h))
                kept.append(h[:SKETCH])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), _lists(kept)], names=SKETCHES.names)
    release()


def _set_rows(batches):
    """The set of each text that isn't empty, under its digest."""
    shingle = Shingler()
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            sets = [h for text in batch.slice(start, 1024).column(0).to_pylist() if len(h := shingle(text))]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(h) for h in sets], pa.binary()), _lists(sets)], names=["sig", "members"])
    release()


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, n, sig, sketch): set size, digest of the set (null if empty) and its smallest hashes."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_sketch_rows, SKETCHES)


def _needed(n: str, percent: int) -> Column:
    """The least overlap with any partner: ceil(t * n)."""
    return F.expr(f"cast(ceil({n} * {percent} / 100.0) as long)")


def _least_shared(size: Column, percent: int) -> Column:
    """Of so many smallest values of a union, how many both sketches of a candidate retain at least."""
    t = percent / 100
    return F.greatest(F.lit(1), F.floor(size * t - DEVIATIONS * F.sqrt(size * t * (1 - t)))).cast("int")


def _least_of(n: str, s: str, percent: int) -> Column:
    """How many of its s retained values a set of n shares with any candidate: exact where every partner's union with it
    is retained whole."""
    return F.when(100 * F.col(n) <= percent * WIDE, _needed(n, percent)).otherwise(_least_shared(F.col(s), percent)).cast("int")


def chance_of_loss(percent: int, size: int = SKETCH) -> float:
    """The chance that a pair just at the threshold falls under `_least_shared`, from the binomial distribution."""
    t = percent / 100
    least = max(1, math.floor(size * t - DEVIATIONS * math.sqrt(size * t * (1 - t))))
    return sum(math.comb(size, k) * t**k * (1 - t) ** (size - k) for k in range(least))


def estimated(a: Column, b: Column, n: Column, m: Column, percent: int, size: int = WIDE) -> Column:
    """Whether the estimate from the bottom of the sketches' union lets a pair of sets of n and m be a candidate; the
    threshold itself decides where both sketches, and so their union, are whole sets."""
    both = F.array_union(a, b)
    union = F.slice(F.sort_array(both), 1, size)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    whole = (F.size(a) == n) & (F.size(b) == m) & (F.size(both) <= size)
    return F.when(whole, 100 * shared >= percent * F.size(both)).otherwise(shared >= _least_shared(F.size(union), percent))


def _candidates(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the union-sketch estimate."""
    one = sketched.select(F.col("sig").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("ak"))
    two = sketched.select(F.col("sig").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bk"))
    passed = estimated(F.col("ak"), F.col("bk"), F.col("an"), F.col("bn"), percent)
    return pairs.join(one, "a").join(two, "b").where(passed).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("sig").alias("a"), F.col("members").alias("am"))
    two = sets.select(F.col("sig").alias("b"), F.col("members").alias("bm"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("am", "bm"))
    return both.where(100 * common >= percent * (F.size("am") + F.size("bm") - common)).select("a", "b")


def _sets_of(documents: DataFrame, classes: DataFrame, kept: DataFrame) -> DataFrame:
    """(sig, members) of the classes kept(sig). One text of each gives its full set; a class of null ids only finds
    it among the texts without id."""
    chosen = materialise(classes.select("sig", "doc_id").join(kept.select("sig"), "sig", "left_semi"), "chosen")
    by_id = chosen.where("doc_id is not null").select("doc_id").distinct()
    if chosen.count() <= BROADCAST_IDS:
        by_id = F.broadcast(by_id)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(by_id, "doc_id", "left_semi").select("text")
    if not chosen.where("doc_id is null").isEmpty():
        found = found.unionByName(texts.where("doc_id is null").select("text"))
    # The text of a repeated id can differ: only digests that were asked for stay, each once.
    sets = found.mapInArrow(_set_rows, "sig binary, members array<long>")
    return materialise(sets.join(chosen.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "sets")


def links(documents: DataFrame, table: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Classes (sig, n, doc_id: the smallest), and labels (node, label) of classes linked with others."""
    classes = table.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    retained = classes.select("sig", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    shared = retained.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    kept = retained.join(shared, "v").groupBy("sig", "s").agg(F.count("*").alias("k"))
    kept = kept.where(F.col("k") >= _least_shared(F.col("s"), percent))
    sets = _sets_of(documents, classes, kept)

    tokens = sets.select("sig", F.explode("members").alias("v"))
    shared = tokens.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v")
    counted = tokens.join(shared, "v").groupBy("sig").agg(F.count("*").alias("k"))
    # own: values nobody else has.
    sized = classes.join(counted, "sig").withColumn("own", F.col("n") - F.col("k")).where(F.col("k") >= _needed("n", percent))
    wide = F.slice("members", 1, WIDE)
    sketched = materialise(sized.select("sig", "n", "own").join(sets, "sig").select("sig", "n", "own", wide.alias("sketch")), "sketched")

    values = sketched.select("sig", "n", "own", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    rarity = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = values.join(rarity, "v").groupBy("sig", "n", "own", "s").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("tv"))
    # Unshared values come first in the order; what is left of the prefix holds shared ones.
    ranked = ranked.withColumn("bare", F.col("s") - F.size("tv"))
    prefix = ranked.withColumn("tv", F.slice("tv", F.lit(1), F.greatest(F.lit(0), F.col("s") - _least_of("n", "s", percent) + 1 - F.col("bare"))))
    prefix = materialise(prefix.select("sig", "n", "own", "s", "bare", F.transform("tv", lambda x: x["v"]).alias("head")), "prefix")
    entries = prefix.select("sig", "n", "own", "s", "bare", F.posexplode("head").alias("p", "v"))

    # Tables that are joined with long lists are written first: a join of plain shuffles can be split by Spark where
    # one value has many members, a join on top of an aggregation can't.
    pivots = entries.groupBy("v").agg(F.min(F.struct("own", "sig", "n")).alias("pivot"), F.count("*").alias("m")).where("m > 1")
    pivots = materialise(pivots, "pivots")
    star = (
        entries.join(pivots, "v")
        .where((F.col("sig") != F.col("pivot.sig")) & _may_match("n", "pivot.n", "own", "pivot.own", percent))
        .select(F.least("sig", "pivot.sig").alias("a"), F.greatest("sig", "pivot.sig").alias("b"))
        .distinct()
    )
    near = materialise(_verified(_candidates(materialise(star, "pairs"), sketched, percent), sets, percent), "links")
    labels = connected(near)

    # What is left: lists whose members are in different components.
    named = prefix.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    # Each entry now carries the values of its prefix that stand before it.
    placed = named.select("sig", "n", "own", "s", "bare", "label", "head", F.posexplode("head").alias("p", "v")).withColumn("head", F.slice("head", F.lit(1), F.col("p")))
    mixed = placed.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v")
    mixed = materialise(mixed, "mixed")
    placed = materialise(placed.join(mixed, "v", "left_semi"), "placed")
    # Members of a list's largest component need no pairs among themselves: one side is everyone else.
    sizes = placed.groupBy("v", "label").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("v").agg(F.max(F.struct("m", "label")).alias("top")).select("v", F.col("top.label").alias("top"))
    few = placed.join(materialise(largest, "largest"), "v").where(F.col("label") != F.col("top")).drop("top")
    few = materialise(few, "few")
    other = placed.select("v", *[F.col(c).alias("o_" + c) for c in ("sig", "n", "own", "s", "bare", "p", "head", "label")])
    # A pair is made where it meets first, so what both retain is at most what follows from there.
    first = ~F.arrays_overlap("head", "o_head")
    most = F.least(F.col("s") - F.col("bare") - F.col("p"), F.col("o_s") - F.col("o_bare") - F.col("o_p"))
    whole = (F.col("s") == F.col("n")) & (F.col("o_s") == F.col("o_n"))
    enough = F.greatest(_least_of("n", "s", percent), _least_of("o_n", "o_s", percent))
    rest = (
        few.join(other, "v")
        .where(F.col("label") != F.col("o_label"))
        .where(_may_match("n", "o_n", "own", "o_own", percent))
        .where((most >= enough) & (~whole | (100 * most >= percent * (F.col("n") + F.col("o_n") - most))))
        .where(first)
        .select(F.least("sig", "o_sig").alias("a"), F.greatest("sig", "o_sig").alias("b"))
        .distinct()
    )
    more = materialise(_verified(_candidates(materialise(rest, "pairs"), sketched, percent), sets, percent), "links")
    if not more.isEmpty():
        labels = connected(near.unionByName(more))
    return classes, labels


def _may_match(n: str, m: str, own: str, other: str, percent: int) -> Column:
    """Bounds that need no look at the sets: unshared values are in the union and not in the intersection."""
    n, m, own, other = F.col(n), F.col(m), F.col(own), F.col(other)
    return 100 * F.least(n - own, m - other) >= percent * F.greatest(n + other, m + own)


def _labelled(documents: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The table of sketches, and (sig, doc_id, label) of its classes."""
    table = materialise(sketches(documents), "sketches")
    classes, labels = links(documents, table, percent)
    named = classes.select("sig", "doc_id").join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    return table, named.select("sig", "doc_id", F.coalesce("label", "sig").alias("label"))


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    table, named = _labelled(documents, percent)
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(smallest, "label").select("sig", "component_id")
    # Rows with an empty set have no class; they skip the join, where they would meet in one task.
    rows = table.where("sig is not null").select("doc_id", "n", "sig").join(of_class, "sig", "left")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rows = rows.unionByName(table.where("sig is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


@F.pandas_udf(T.BinaryType())
def set_digest(texts: pd.Series) -> pd.Series:
    """The digest of a text's set; null for a text without words."""
    shingle = Shingler()
    return pd.Series([_digest(shingle(t)) for t in texts], dtype=object)


def keep_one(documents: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """One row of each component, with its own columns; rows without words all stay.

    The row kept is one with the component's smallest id, or one without id where no member has any; of several such
    rows, that with the smallest hash of all columns. Most rows are picked by their id alone. Only those whose id is
    null or repeated are told apart by the digest of their own set.
    """
    table, named = _labelled(documents, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("first")
    keepers = materialise(named.groupBy("label").agg(first).select("first.doc_id", "first.sig"), "keepers")
    ids = table.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("sig").isNull()).alias("blank"))
    repeated = materialise(ids.where("n > 1").select(F.col("doc_id").alias("__id")), "repeated")
    wanted = keepers.where("doc_id is not null").select("doc_id").unionByName(ids.where("n = 1 and blank").select("doc_id")).select(F.col("doc_id").alias("__id"))
    own = documents["doc_id"].cast("long")
    plain = documents.join(wanted.join(repeated, "__id", "left_anti").distinct(), own == F.col("__id"), "left_semi")
    if repeated.isEmpty() and table.where("doc_id is null").isEmpty():
        return plain
    odd = documents.where(own.isNull()).unionByName(documents.join(repeated, own == F.col("__id"), "left_semi"))
    odd = odd.select(F.struct(*[F.col(f"`{c}`") for c in odd.columns]).alias("row"), F.col("doc_id").cast("long").alias("__id"), set_digest(F.col("text").cast("string")).alias("__sig"))
    met = odd.join(keepers, (odd["__sig"] == keepers["sig"]) & odd["__id"].eqNullSafe(keepers["doc_id"]))
    one = met.groupBy("__sig", "__id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return plain.unionByName(odd.where("__sig is null").select("row.*")).unionByName(one.select("row.*"))
