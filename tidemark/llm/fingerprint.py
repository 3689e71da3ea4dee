"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A fingerprint is the K smallest distinct 64-bit hashes of a text's five-word shingles (one shingle for fewer
words). Sketches of parts merge into the sketch of the whole, and two sketches estimate resemblance,
containment and the number of distinct shingles; they are exact while sets have at most K members.

Defined results: a null text counts as empty, and an empty or blank text has the one empty shingle; white space
around a text doesn't count; very long texts are read whole; equal texts have equal fingerprints. Ties: rows that
repeat an id are ordered by their text's hash. A row without an id is outside the order of documents and is its own
next one; an empty table gives no rows; columns beside doc_id and text are not looked at.

Cost: ids are put in groups of 2^GROUP_BITS neighbouring numbers. Where ids are so sparse that a group holds one row,
texts move twice instead of once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

K, WORDS = 64, 5
#: Ids are put in order in groups of 2^GROUP_BITS neighbouring ids, then groups of groups, and so on.
GROUP_BITS = 6


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles of the text, not yet distinct."""
    # The words are bound to a variable, so that they are split once; single items are taken in constant time.
    parts = F.split(F.trim(F.lower(text), F.lit(" \t\n\x0b\f\r")), r"\s+")
    places = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
    run = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(words)])
    return F.transform(F.array(parts), lambda w: F.transform(places(w), lambda i: run(w, i)))[0]


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.coalesce(text, F.lit(""))))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Of the k smallest values of the union, the share that both sketches retain."""
    union = merge(a, b, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.greatest(F.size(union), F.lit(1))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The size of a short sketch; for a full one, (k - 1) over the share of the hash range it spans."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(span, F.lit(1e-18)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has, from resemblance and the distinct counts."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.least(F.lit(1.0), r * (na + nb) / (1 + r) / na)


def encode(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), ".")


def decode(fingerprint: Column) -> Column:
    """Sketch of an encoded fingerprint."""
    signed = lambda h: F.conv(h, 16, -10).cast("long")
    return F.transform(F.split(fingerprint, r"\."), signed)


def _lower_neighbours(keys: DataFrame, low: int, high: int) -> DataFrame:
    """(key, lower): for every distinct key the next smaller one; the largest for the smallest.

    Windows never hold more than 2^GROUP_BITS keys; only the smallest of a group is handed to the level above.
    """
    keys = keys.select("key").distinct()
    last = high - low <= 1 << GROUP_BITS
    group = F.lit(0).cast("long") if last else F.shiftright("key", GROUP_BITS)
    inner = keys.withColumn("g", group).withColumn("lower", F.lead("key").over(Window.partitionBy("g").orderBy(F.desc("key"))))
    # Written, as every level refers to the one below it several times.
    inner = materialise(inner, "groups")
    if last:
        return inner.select("key", F.coalesce("lower", F.lit(high)).alias("lower"))
    tops = inner.groupBy("g").agg(F.max("key").alias("top"))
    above = _lower_neighbours(tops.select(F.col("g").alias("key")), low >> GROUP_BITS, high >> GROUP_BITS)
    across = above.join(tops.select(F.col("g").alias("lower"), "top"), "lower").select(F.col("key").alias("g"), "top")
    return (
        inner.where("lower is not null")
        .select("key", "lower")
        .unionByName(inner.where("lower is null").join(across, "g").select("key", F.col("top").alias("lower")))
    )


def _with_next(base: DataFrame) -> DataFrame:
    """base (doc_id, text) with its sketch, next_text and next_sketch: those of the next document in descending
    doc_id (ties: by text hash).

    Texts move once, to groups of neighbouring ids. The first row of every group goes to the group above as
    well, where it stands last: it is the next document of that group's last row.
    """
    ordered = base.where("doc_id is not null").withColumn("g", F.shiftright("doc_id", GROUP_BITS))
    span = ordered.agg(F.min("g"), F.max("g")).first()
    alone = base.where("doc_id is null").withColumn("sketch", sketch(F.col("text")))
    alone = alone.select("doc_id", "text", "sketch", F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"))
    if span[0] is None:
        return alone
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("doc_id"), F.xxhash64("text")))
    heads = ordered.withColumn("rn", rank).where("rn = 1").select(F.col("g").alias("lower"), "doc_id", "text")
    groups = _lower_neighbours(ordered.select(F.col("g").alias("key")), span[0], span[1])
    guests = heads.join(groups, "lower").select("doc_id", "text", F.col("key").alias("g"), F.lit(True).alias("guest"))
    # Sketches are made after the move, so that they needn't move.
    dealt = ordered.withColumn("guest", F.lit(False)).unionByName(guests).repartition("g").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("g").orderBy("guest", F.desc("doc_id"), F.xxhash64("text"))
    placed = dealt.withColumn("nx", F.lead(F.struct("text", "sketch")).over(order)).where(~F.col("guest"))
    return placed.select("doc_id", "text", "sketch", F.col("nx.text").alias("next_text"), F.col("nx.sketch").alias("next_sketch")).unionByName(alone)


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, distinct_estimate) of every row."""
    found = documents.select("doc_id", sketch(F.col("text")).alias("s"))
    return found.select("doc_id", encode(F.col("s")).alias("fingerprint"), distinct_shingles(F.col("s")).alias("distinct_estimate"))


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose second half the next document's beginning replaces."""
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = _with_next(base).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_containment"),
        distinct_shingles(F.col("sketch")).alias("distinct_estimate"),
    )
