"""Caption search: literal predicates, trigram acceleration, packet runs, duplicates and reuse attachment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels
from .graph import _settle

#: Vectors of one block of `within` and `alike`, and the blocks of a table that has fewer than so many blocks of that size.
BLOCK_ROWS, BLOCKS = 1 << 17, 4
#: Halves are rounded by 2^-11 of a unit vector's length at most, so no product of two is off by this much.
HALVES_OFF = 0.0015


def predicates(df: DataFrame, text: str | None = None, label: str | None = None, speaker: str | None = None, status: str | None = None, least: dict[str, float] | None = None, text_col: str = "search_text") -> DataFrame:
    """Rows that meet all of the given predicates; texts are literal, so % and _ mean themselves."""
    if text:
        df = df.where(F.contains(F.col(text_col), F.lit(text)))
    if label:
        df = df.where(F.contains(F.lower("label"), F.lit(label.lower())) | (F.col("hash") == label))
    if speaker:
        df = df.where(F.col("speaker") == speaker)
    if status:
        df = df.where(F.col("status") == status)
    for column, value in (least or {}).items():
        df = df.where(F.col(column) >= value)
    return df


def top(df: DataFrame, order: list, limit: int) -> DataFrame:
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie in 1..1000")
    return df.orderBy(*order).limit(limit)


def wanted_trigrams(query: str) -> list[str]:
    return sorted({query[i : i + 3] for i in range(len(query) - 2)})


def trigrams(df: DataFrame, ident: str, text: str, only: list[str] | None = None) -> DataFrame:
    """(id, tri): the distinct trigrams of each text, one row each; an index table to write and bucket by tri.

    `only` keeps the trigrams of one query, which are found without spelling the text out.
    """
    if only is not None:
        found = F.filter(F.array(*[F.lit(g) for g in only]), lambda g: F.contains(F.col(text), g))
        return df.select(ident, F.explode(found).alias("tri"))
    # Characters are bound to a variable, so that the text is cut once and each is then taken in constant time.
    chars = F.array(F.split(F.col(text), ""))
    places = lambda c: F.sequence(F.lit(0), F.size(c) - 3)
    grams = F.transform(chars, lambda c: F.array_distinct(F.transform(places(c), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))))[0]
    return df.where(F.char_length(text) >= 3).select(ident, F.explode(grams).alias("tri"))


def trigram_search(df: DataFrame, index: DataFrame, ident: str, text: str, query: str) -> DataFrame:
    """Rows whose text contains the query: candidates hold all its trigrams, `contains` verifies them."""
    wanted = wanted_trigrams(query)
    if not wanted:
        return df.where(F.contains(F.col(text), F.lit(query)))
    hits = index.where(F.col("tri").isin(wanted)).groupBy(ident).agg(F.count("*").alias("_n")).where(F.col("_n") == len(wanted))
    return df.join(hits.select(ident), ident, "left_semi").where(F.contains(F.col(text), F.lit(query)))


def subsequence(parent: DataFrame, child: DataFrame, keys: list[str], pos: str, mark: str) -> DataFrame:
    """All offsets at which the child's marks occur in a row in the parent (keys, offset)."""
    size = child.agg(F.count("*").alias("_size"))
    meet = parent.select(*keys, F.col(pos).alias("_p"), mark).join(child.select(F.col(pos).alias("_c"), mark), mark)
    runs = meet.groupBy(*keys, (F.col("_p") - F.col("_c")).alias("offset")).agg(F.count("*").alias("_n"))
    return runs.join(F.broadcast(size), F.col("_n") == F.col("_size")).select(*keys, "offset")


def positional_compare(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], mark: str, t: str) -> DataFrame:
    """Rows of both sides by position, with what differs: mark, time distance, or a missing partner."""
    w = Window.partitionBy(*keys).orderBy(*order)
    number = lambda df, s: df.select(*keys, F.row_number().over(w).alias("n"), F.col(mark).alias(mark + s), F.col(t).alias(t + s))
    both = number(a, "_a").join(number(b, "_b"), [*keys, "n"], "full")
    return both.withColumns({"same_mark": F.col(mark + "_a").eqNullSafe(F.col(mark + "_b")), "distance": F.abs(F.col(t + "_a") - F.col(t + "_b"))})


def duplicate_groups(df: DataFrame, key: str, ident: str) -> DataFrame:
    """Keys that occur more than once, with their size and first id."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(ident).alias("first_id")).where("n > 1")


def nearest(vectors: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, block_bytes: int = 16 << 20) -> DataFrame:
    """(a, b, rank, cosine): the k vectors nearest to each query by cosine, itself left out; ties by smaller id.

    Queries, a stated set, are taken in groups of at most block_bytes, each broadcast; a task multiplies a group with its
    own rows and keeps k for each query, so k rows a query and task are shuffled, never a pair for every two vectors.
    Vectors of another length than the query's, nulls and zero vectors have no cosine and don't take part.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.select(F.col(ident).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x))")
    rows, asked = usable(vectors), usable(queries)
    held = asked.agg(F.sum(8 * F.greatest(F.size("v"), F.lit(8)))).first()[0] or 0
    groups = -(-held // block_bytes)
    found = None
    for g in range(groups):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).collect()  # bounded by block_bytes
        by_size: dict[int, list] = {}
        for r in part:
            by_size.setdefault(len(r["v"]), []).append(r)
        told = spark.sparkContext.broadcast({n: (np.array([r["id"] for r in rs]), np.array([r["v"] for r in rs], dtype=float).reshape(len(rs), n)) for n, rs in by_size.items() if n})
        best = rows.mapInPandas(_nearest(told, k), "a long, b long, cosine double")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, cosine double")
    order = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "b")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "b", "rank", "cosine")


def _nearest(told, k: int):
    def run(frames):
        kept: dict[tuple[int, int], list[tuple[float, int, float]]] = {}
        for frame in frames:
            sizes = frame["v"].map(len).to_numpy()
            for n, (ids, q) in told.value.items():
                fit = frame[sizes == n]
                for at in range(0, len(fit), 4096):
                    own = fit["id"].to_numpy()[at : at + 4096]
                    x = np.stack(fit["v"].to_numpy()[at : at + 4096])
                    # Not all of a group's queries at once: the table of cosines has a million cells at most.
                    for first in range(0, len(ids), 256):
                        asked, own_q = ids[first : first + 256], q[first : first + 256]
                        norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(own_q, axis=1)[None, :]
                        c = np.divide(x @ own_q.T, norms, out=np.full(norms.shape, -np.inf), where=norms > 0)
                        c[own[:, None] == asked[None, :]] = -np.inf
                        # Of equal cosines, to nine digits, the smaller id comes first.
                        order = np.lexsort((np.broadcast_to(own[:, None], c.shape), -np.round(c, 9)), axis=0)[:k]
                        for j in range(len(asked)):
                            best = kept.get((n, first + j), []) + [(-round(float(c[i, j]), 9), int(own[i]), float(c[i, j])) for i in order[:, j] if c[i, j] > -np.inf]
                            kept[n, first + j] = sorted(best)[:k]
        out = [(int(told.value[n][0][j]), b, c) for (n, j), best in kept.items() for _, b, c in best]
        yield pd.DataFrame(out, columns=["a", "b", "cosine"])

    return run


def within(queries: DataFrame, vectors: DataFrame, ident: str, vector: str, least: float) -> DataFrame:
    """(a, b, cosine): every query and every vector, itself included, at a cosine of at least `least`; none is missed.

    Both tables are cut into blocks by id, and each block of one meets each of the other in a task of its own, as a matrix
    product of unit vectors in half precision. What may reach `least` by that precision gets its cosine from the whole
    vectors. A task holds two blocks, and a vector is dealt as often as the other table has blocks. Nulls, zero vectors
    and ones with a component that is null or not finite have no cosine.
    """
    left, right = _halves(queries, ident, vector), _halves(vectors, ident, vector)
    m, n = _blocks(queries), _blocks(vectors)
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    dealt = left.select("id", "half", F.lit(0).alias("side"), block(m).alias("i"), every(n).alias("j"))
    dealt = dealt.unionByName(right.select("id", "half", F.lit(1).alias("side"), every(m).alias("i"), block(n).alias("j")))
    return _confirmed(_met(dealt, left.schema["id"].dataType.simpleString(), least), queries, vectors, ident, vector, least)


def alike(vectors: DataFrame, ident: str, vector: str, least: float) -> DataFrame:
    """(a, b, cosine), a < b: every two vectors at a cosine of at least `least`, in blocks as `within`."""
    held, n = _halves(vectors, ident, vector), _blocks(vectors)
    own, other = F.pmod(F.xxhash64("id"), F.lit(n)).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("other")
    dealt = held.select("id", "half", own, other)
    # A block meets itself with its rows on both sides.
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("id", "half", side.alias("side"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = _met(dealt, held.schema["id"].dataType.simpleString(), least).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return _confirmed(met, vectors, vectors, ident, vector, least)


def _blocks(df: DataFrame) -> int:
    n = df.count()
    return max(-(-n // BLOCK_ROWS), min(BLOCKS, -(-n // 1024)), 1)


def _halves(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, half): unit vectors as bytes of half precision."""

    def run(frames):
        for frame in frames:
            ids, halves = [], []
            for i, v in zip(frame["id"], frame["v"], strict=True):
                x = np.asarray(v, dtype=float)
                x = x / top if (top := np.abs(x).max(initial=0)) > 0 and np.isfinite(top) else x
                if (norm := np.linalg.norm(x)) > 0 and np.isfinite(norm):
                    ids.append(i)
                    halves.append((x / norm).astype("<f2").tobytes())
            yield pd.DataFrame({"id": pd.Series(ids, dtype=frame["id"].dtype), "half": pd.Series(halves, dtype=object)})

    rows = df.select(F.col(ident).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, half binary")


def _met(dealt: DataFrame, kind: str, least: float) -> DataFrame:
    """(a, b) of the sides of each (i, j) that may have that cosine."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True)
        for _, fit in frame.groupby(frame["half"].map(len)):
            side, ids = fit["side"].to_numpy(), fit["id"].to_numpy()
            x = np.frombuffer(b"".join(fit["half"]), dtype="<f2").reshape(len(fit), -1).astype(np.float32)
            a, b = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
            left, right = x[a], x[b].T
            step = max(1, (1 << 22) // max(1, len(b)))  # 16 MB of products at a time
            for at in range(0, len(a), step):
                i, j = np.nonzero(left[at : at + step] @ right >= least - HALVES_OFF)
                if len(i):
                    yield pd.DataFrame({"a": ids[a[at + i]], "b": ids[b[j]]})

    return dealt.groupBy("i", "j").applyInPandas(run, f"a {kind}, b {kind}")


def _confirmed(met: DataFrame, left: DataFrame, right: DataFrame, ident: str, vector: str, least: float) -> DataFrame:
    met = _settle(met.distinct())
    own = met.join(left.select(F.col(ident).alias("a"), F.col(vector).alias("va")), "a")
    other = met.join(right.select(F.col(ident).alias("b"), F.col(vector).alias("vb")), "b")
    return own.join(other, ["a", "b"]).select("a", "b", kernels.cosine("va", "vb").alias("cosine")).where(F.col("cosine") >= least)


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """current without the rows whose key comes anew, and the new rows; running it again changes nothing."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def dangling(refs: DataFrame, targets: DataFrame, ref: str, ident: str) -> DataFrame:
    """References that resolve to nothing."""
    return refs.join(targets.select(F.col(ident).alias(ref)).distinct(), ref, "left_anti")


def canonical(df: DataFrame, keys: list[str], rank: str, length: str, order: str, ident: str) -> DataFrame:
    """The member of each group with the best rank, then the longest, then the first seen."""
    best = F.min(F.struct(F.col(rank).alias("r"), (-F.col(length)).alias("l"), F.col(order).alias("o"), F.col(ident).alias("id")))
    return df.groupBy(*keys).agg(best.alias("_b"), F.count("*").alias("n_members")).select(*keys, F.col("_b.id").alias(ident), "n_members")


def families(candidates: DataFrame, works: DataFrame) -> DataFrame:
    """Candidates(candidate, recording, title, provider) grouped by the works(recording, work) that a catalogue
    relates to their recording, one row for each work; else by a normalised title; else alone.

    Only a shared work is proposed as a composition, and not where a recording has several; a title alone is weak.
    """
    title = F.trim(F.regexp_replace(F.lower("title"), r"\W+", " "))
    several = works.groupBy("recording").agg((F.count_distinct("work") > 1).alias("several"))
    keyed = candidates.join(works.distinct(), "recording", "left").join(several, "recording", "left")
    alone = F.concat(F.lit("alone:"), F.col("candidate").cast("string"))
    keyed = keyed.withColumn("family", F.coalesce(F.concat(F.lit("work:"), "work"), F.concat(F.lit("title:"), title), alone))
    titles = F.collect_set("title")
    g = keyed.groupBy("family").agg(
        F.count_distinct("candidate").alias("n_members"),
        F.count_distinct("provider").alias("n_providers"),
        F.when(F.size(titles) == 1, F.min("title")).alias("title"),
        F.min("work").alias("_work"),
        F.coalesce(F.bool_or("several"), F.lit(False)).alias("partial"),
    )
    basis = F.when(F.col("_work").isNotNull(), "SHARED_WORK").when(F.col("family").startswith("title:") & (F.col("n_members") > 1), "WEAK_TITLE").otherwise("UNLINKED")
    status = F.when(F.col("_work").isNotNull() & ~F.col("partial"), "SUPPORTED_REQUIRES_ADJUDICATION").otherwise("CANDIDATE")
    return g.select("family", "n_members", "n_providers", "title", basis.alias("basis"), "partial", status.alias("status"))


def pseudonyms(df: DataFrame, name: str, prefix: str = "Person") -> DataFrame:
    """(name, pseudonym) of distinct names, numbered in name order.

    Names are dealt in ranges and numbered within each; only the ranges' sizes meet in one place.
    """
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    ranged = _settle(names.repartitionByRange(name).sortWithinPartitions(name).select(name, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.col("_id") - F.col("_first") + 1 + F.col("_before")
    placed = ranged.join(F.broadcast(sizes.select("_part", "_first", before.alias("_before"))), "_part")
    return placed.select(name, F.format_string(prefix + "-%02d", number).alias("pseudonym"))


def mask(df: DataFrame, text: str, names: list[tuple[str, str]]) -> DataFrame:
    """Replace names by their pseudonyms, the longest first so that no name is cut by a shorter one."""
    out = F.col(text)
    for name, alias in sorted(names, key=lambda x: (-len(x[0]), x[0])):
        out = F.replace(out, F.lit(name), F.lit(alias))
    return df.withColumn(text, out)
