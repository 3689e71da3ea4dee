"""Hard-negative mining: exact integer inner products of anchor blocks and candidate blocks as dense matrix products.

Anchors are a stated share of the rows. They are taken in groups of at most GROUP_BYTES; each group is broadcast, and every
task multiplies it, SUB_BLOCK anchors at a time, with its own candidates, CHUNK rows at a time, in float64: products of
whole numbers are exact below 2^53, and where a block's bound allows more they are taken in 64-bit integers.

1. Positives: the best rows of the anchor's own label. A task keeps so many for each anchor; such lists merge by taking
   the best of their union, so a window over them is the whole answer.
2. Negatives: each positive gives a window of scores; a second pass keeps the best rows of other labels inside it.

Nothing of the candidates is broadcast or collected; of a group, the anchors and their positives are, which GROUP_BYTES
bounds. No pair is a row: only kept ones leave a task.

Defined results: rows without id, label or vector, or with a component that is null or not finite, take no part; vectors
of another length than the anchor's aren't compared with it, and an empty vector's products are 0; equal scores go by
smaller id; rows that repeat an id are rows of their own as candidates, never of an anchor with their id, and the anchor of an id that
repeats is its row with the smallest label and vector; an empty table gives no rows; columns beside the
three named ones are not looked at. A product that may pass 2^63 is an error, as no long holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Bytes of the float64 components of a group of anchors, anchors multiplied at once, candidates multiplied at once.
GROUP_BYTES, SUB_BLOCK, CHUNK = 16 << 20, 256, 4096

POSITIVE = "anchor_id long, positive_id long, positive_score long"
NEGATIVE = "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def usable(embeddings: DataFrame, label="label") -> DataFrame:
    """(vec_id, label, x) of the rows that take part; x holds floor(256 * component)."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("double"))
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(~odd, x).alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
    )


class _Best:
    """The best k of (key, score, id) rows for each key: higher scores first, then smaller ids."""

    def __init__(self, k: int, keys: int, floor: np.ndarray | None = None):
        self.k = k
        self.at, self.score, self.id = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64))
        self.least = np.full(keys, np.iinfo(np.int64).min) if floor is None else floor.copy()

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        at, score, ids = (np.concatenate(x) for x in ((self.at, at), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, at)
        rank = np.arange(len(at)) - first
        keep = rank < self.k
        self.at, self.score, self.id = at[keep], score[keep], ids[keep]
        full = rank[keep] == self.k - 1
        self.least[self.at[full]] = self.score[full]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows, as float64 where that is exact and int64 elsewhere."""
    most = (np.abs(a).max() if a.size else 0.0) * (np.abs(b).max() if b.size else 0.0) * a.shape[1]
    if most < 2.0**53:
        return a @ b.T
    if most >= 2.0**63:
        raise OverflowError("an inner product may pass 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _chunks(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of candidates of one length, CHUNK rows at most."""
    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        x = batch.column(2)
        sizes = np.diff(x.offsets.to_numpy())
        flat, starts = x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        for size in np.unique(sizes):
            rows = np.nonzero(sizes == size)[0]
            for k in range(0, len(rows), CHUNK):
                part = rows[k : k + CHUNK]
                yield ids[part], labels[part], flat[starts[part][:, None] + np.arange(size)]


class _Group:
    """Anchors of a group by the length of their vectors: place, id, label and matrix, ordered by label."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: (len(r["x"]), r["label"], r["vec_id"]))
        self.ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        self.labels = np.array([r["label"] for r in rows], dtype=np.int64)
        sizes = np.array([len(r["x"]) for r in rows])
        self.parts = {int(s): np.array([r["x"] for r in rows if len(r["x"]) == s], dtype=np.float64).reshape(int((sizes == s).sum()), s) for s in np.unique(sizes)}
        self.first = {int(s): int(np.searchsorted(sizes, s)) for s in np.unique(sizes)}

    def blocks(self, size: int):
        x = self.parts.get(size)
        for k in range(0, 0 if x is None else len(x), SUB_BLOCK):
            part = x[k : k + SUB_BLOCK]
            at = self.first[size] + k
            yield at, self.ids[at : at + len(part)], self.labels[at : at + len(part)], part


def _positives(group, k: int):
    def run(batches):
        g = group.value
        best = _Best(k, len(g.ids))
        for ids, labels, x in _chunks(batches):
            for at, own, own_labels, a in g.blocks(x.shape[1]):
                for label in np.unique(own_labels):
                    r, c = np.nonzero(own_labels == label)[0], np.nonzero(labels == label)[0]
                    if len(c):
                        s = products(a[r], x[c])
                        i, j = np.nonzero((s >= best.least[at + r][:, None]) & (own[r][:, None] != ids[c][None, :]))
                        best.add(at + r[i], s[i, j].astype(np.int64), ids[c[j]])
        yield pa.RecordBatch.from_arrays([pa.array(g.ids[best.at]), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "positive_id", "positive_score"])
        release()

    return run


def _negatives(group, told, k: int, low: int, high: int):
    """told: for each place of an anchor (positive ids, scores), best first."""

    def run(batches):
        g, ps = group.value, told.value
        width = max((len(p) for p, _ in ps), default=0)
        scores = np.zeros((len(ps), max(1, width)), dtype=np.int64)
        held = np.zeros(scores.shape, dtype=bool)
        for i, (p, s) in enumerate(ps):
            scores[i, : len(p)], held[i, : len(p)] = s, True
        least, most = -(-low * scores // 100), high * scores // 100
        held &= least <= most
        big = np.iinfo(np.int64).max // 4
        least, most = np.where(held, least, big), np.where(held, most, -big)
        width = scores.shape[1]
        best = _Best(k, scores.size, least.ravel())
        for ids, labels, x in _chunks(batches):
            for at, _, own_labels, a in g.blocks(x.shape[1]):
                rows = slice(at, at + len(a))
                s = products(a, x)
                floor = best.least.reshape(-1, width)[rows]
                near = (s >= floor.min(axis=1)[:, None]) & (s <= most[rows].max(axis=1)[:, None]) & (own_labels[:, None] != labels[None, :])
                i, j = np.nonzero(near)
                v = s[i, j].astype(np.int64)
                for p in range(width):
                    met = (v >= floor[i, p]) & (v <= most[at + i, p])
                    best.add((at + i[met]) * width + p, v[met], ids[j[met]])
        i, p = best.at // width, best.at % width
        out = [g.ids[i], p.astype(np.int32), np.array([ps[a][0][b] for a, b in zip(i, p, strict=True)], dtype=np.int64), scores[i, p], best.id, best.score]
        names = ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=names)
        release()

    return run


def best_positives(partial: DataFrame, k: int) -> DataFrame:
    """The best k of the union of the tasks' lists."""
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return partial.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """For each anchor and each of its best positives, the best negatives of the positive's window.

    Both tables come from `usable`; anchors are rows of the first. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    anchors = materialise(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", "v.x"), "anchors")
    held = anchors.agg(F.sum(8 * F.greatest(F.size("x"), F.lit(8)))).first()[0] or 0
    groups = -(-held // group_bytes)
    found = []
    for g in range(groups):
        part = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).collect()  # bounded by group_bytes
        if not part:
            continue
        group = sc.broadcast(_Group(part))
        best = best_positives(rows.mapInArrow(_positives(group, positives), POSITIVE), positives).collect()
        by_anchor = {i: [] for i in group.value.ids.tolist()}
        for r in sorted(best, key=lambda r: (r["anchor_id"], r["place"])):
            by_anchor[r["anchor_id"]].append((r["positive_id"], r["positive_score"]))
        told = sc.broadcast([([p for p, _ in ps], [s for _, s in ps]) for ps in by_anchor.values()])
        found.append(materialise(rows.mapInArrow(_negatives(group, told, negatives, low, high), NEGATIVE), "negatives"))
        group.unpersist()
        told.unpersist()
    partial = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], NEGATIVE)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
