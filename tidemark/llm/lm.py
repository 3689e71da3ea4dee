"""LM scoring with an n-gram trie of Elias-Fano levels, built in shards by Spark tasks and memory-mapped by the scoring ones.

Level 1 has the words of the training documents by 63-bit hash and their exact counts; a node of level k is a run of k words.
Children of a node stand together, in the order of their last word; monotone pointers tell where they start. From level 3
on a child's last word is not written as a word but as its place among the children of the node's own last words (the run
without its first word), which are few; so levels are small, and a look-up is a successor search within that range.

Probabilities are those of absolute discounting, interpolated down to level 1, which is (c + 1) / (N + V + 1):
p(w | run) = max(n - D, 0) / n(run) + rest(run) * p(w | run without its first word). Runs that occur once have no node;
what they'd hold is part of the rest. Both numbers of a node are quantised to 8 bits on a logarithmic scale of their shard.

1. A counting pass for each level: a task looks the runs of its chunk up in the levels that stand, sums equal ones, and sends
   each shard what is its own, sorted and packed in one binary row. Nothing is sampled and no count is left out.
2. A task merges a shard, writes its level file in the shared folder and reports a line about it. Shards of level 1 are ranges of
   hashes, later ones ranges of (parent, child) with about equally many training tokens: a frequent word's children lie in several.
3. Scoring tasks map the files and look up each chunk's distinct runs, level by level, whole arrays at once.

Broadcast are a few numbers for each shard. Files are found through the shared folder only: on a mounted one they are mapped,
from any other store a shard is read when needed and at most HELD of them are held.

Defined results: a null or empty text is the end token alone; a null id is no training row (its remainder isn't known) and
not held out; repeated rows are learned from and scored each; very long texts are whole; ties don't arise; an empty table
gives no rows, and without training rows every probability is 1 (N = V = 0); columns beside doc_id and text are not looked at.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import succinct
from .common import held_out, release, scratch_path
from .succinct import EliasFano
from .tokens import Words, chunks, distinct, gathered

BUCKETS, HELD_BUCKET = 7, 2
ORDER, DISCOUNT, LEAST = 3, 0.75, 2
#: Bytes of text that a task looks at together, marks a shard reports, shards held of a store that can't be mapped.
CHUNK, MARKS, HELD = 4 << 20, 64, 4
#: The hash of the end token, which also is the word before the first.
END = 1

DEALT = "shard int, data binary"
BUILT = "shard int, name string, n long, total long, widest long, first_p long, first_kept double, last_p long, last_kept double, last_start long, marks binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def encode(p: np.ndarray, r: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted (p, r) with counts in a few bytes each: differences of p, r, n by byte planes, compressed."""
    planes = [x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (np.diff(p, prepend=0), r, n)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(3, 8, -1)
    p, r, n = (np.ascontiguousarray(x.T).view(np.uint64).ravel().astype(np.int64) for x in planes)
    return np.cumsum(p), r, n


def merge(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of equal (p, r)."""
    p, r, n = (np.concatenate(x) for x in zip(*map(decode, parts), strict=True))
    low = int(p.min())
    width = int(r.max()).bit_length()
    if (int(p.max()) - low).bit_length() + width <= 63:
        key = (p - low) << width | r
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort((r, p))
    p, r, n = p[order], r[order], n[order]
    first = np.nonzero(np.concatenate([[True], (np.diff(p) != 0) | (np.diff(r) != 0)]))[0]
    return p[first], r[first], np.add.reduceat(n, first)


def quantise(x: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook): x, in (0, 1], on a logarithmic scale."""
    logs = np.log10(np.maximum(x, 1e-18))
    low, high = (float(logs.min()), float(logs.max())) if len(x) else (0.0, 0.0)
    step = (high - low) / (codes - 1) or 1.0
    return np.rint((logs - low) / step).astype(np.uint8), 10.0 ** (low + step * np.arange(codes))


class Model:
    """What reaches the tasks of the levels that stand: for each shard its file, first key, first node; and the few parents
    whose children lie in more than one shard."""

    def __init__(self, folder: str):
        self.folder, self.levels, self.tokens, self.words = folder, [], 0, 0

    def add(self, built, bounds) -> None:
        rows = sorted(built, key=lambda r: r["shard"])
        n = np.array([r["n"] for r in rows], dtype=np.int64)
        total = np.array([r["total"] for r in rows], dtype=np.int64)
        offset = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64)
        kept: dict[int, float] = {}
        start: dict[int, int] = {}
        met: dict[int, int] = {}
        for r, at in zip(rows, offset.tolist(), strict=True):
            for p, x in {r["first_p"]: r["first_kept"], r["last_p"]: r["last_kept"]}.items():
                kept[p] = kept.get(p, 0.0) + x
                met[p] = met.get(p, 0) + 1
                start.setdefault(p, at if p == r["first_p"] else at + r["last_start"])
        cut = sorted(p for p in kept if met[p] > 1)
        # A bound inside a parent's children stays one only if the parent has children on both sides.
        found = [bounds[r["shard"]] for r in rows]
        for i, (p, _) in enumerate(found if self.levels else []):
            before, later = i and rows[i - 1]["last_p"] == p, rows[i]["first_p"] == p
            found[i] = found[i] if before and later else (p + 1, -1) if before else (p, -1)
        level = {"names": [r["name"] for r in rows], "bounds": found, "shards": [r["shard"] for r in rows], "n": n, "offset": offset, "total": total}
        level |= {"widest": max([r["widest"] for r in rows], default=0), "marks": [np.frombuffer(r["marks"], dtype=np.float64).reshape(-1, 2) for r in rows]}
        level |= {"cut": np.array(cut, dtype=np.int64), "cut_kept": np.array([kept[p] for p in cut]), "cut_start": np.array([start[p] for p in cut], dtype=np.int64)}
        self.levels.append(level)
        if len(self.levels) == 1:
            self.tokens, self.words = int(total.sum()), int(n.sum())

    def next_bounds(self, shards: int) -> list[tuple[int, int]]:
        """First (parent, child) of each shard of the next level, so that about equally many tokens follow each bound."""
        level = self.levels[-1]
        before = np.concatenate([[0], np.cumsum(level["total"])])
        width = self.words if len(self.levels) == 1 else level["widest"]
        out = [(0, 0)]
        for k in range(1, shards):
            goal = before[-1] * k / shards
            i = min(int(np.searchsorted(before, goal, side="right")) - 1, len(level["n"]) - 1)
            if i >= 0 and level["total"][i]:
                marks = level["marks"][i]
                at, part = marks[min(len(marks) - 1, int((goal - before[i]) / level["total"][i] * len(marks)))]
                bound = (int(level["offset"][i] + at), int(part * width))
                if bound > out[-1]:
                    out.append(bound)
        return out


def cuts(p: np.ndarray, r: np.ndarray, bounds: list[tuple[int, int]]) -> list[int]:
    """Where in sorted (p, r) each bound's part starts, and the end."""
    out = []
    for x, y in bounds:
        low, high = np.searchsorted(p, x, side="left"), np.searchsorted(p, x, side="right")
        out.append(int(low + np.searchsorted(r[low:high], y, side="left")))
    return [*out, len(p)]


class Reader:
    """The level files, mapped."""

    def __init__(self, model: Model):
        self.model, self.open = model, OrderedDict()
        self.store, self.path = fs.FileSystem.from_uri(model.folder)

    def shard(self, level: int, i: int) -> dict:
        key = (level, i)
        if key in self.open:
            self.open.move_to_end(key)
            return self.open[key]
        name = f"{self.path}/{self.model.levels[level - 1]['names'][i]}"
        if isinstance(self.store, fs.LocalFileSystem):
            arrays = succinct.load(np.memmap(name, dtype=np.uint8, mode="r").view(np.ndarray))
        else:
            with self.store.open_input_file(name) as f:
                arrays = succinct.load(np.frombuffer(f.read(), dtype=np.uint8))
            if len(self.open) >= HELD:
                self.open.popitem(last=False)
        found = {"plain": arrays} | {x: succinct.part(arrays, x) for x in ("keys", "start", "sums") if f"{x}.head" in arrays}
        self.open[key] = found
        return found

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, count) of sorted hashes: -1 and 0 for those that aren't in the training documents."""
        level = self.model.levels[0]
        node, count = np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        firsts = np.array([b[0] for b in level["bounds"]], dtype=np.int64)
        at = [*np.searchsorted(h, firsts, side="left").tolist(), len(h)]
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if b > a:
                s = self.shard(1, i)
                found = s["keys"].find(h[a:b] - firsts[i])
                hit = np.nonzero(found >= 0)[0]
                node[a + hit] = found[hit] + level["offset"][i]
                low, high = s["sums"].pairs(found[hit])
                count[a + hit] = high - low
        return node, count

    def counts(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """How often sorted nodes occur."""
        told = self.model.levels[level - 1]
        out = np.zeros(len(nodes), dtype=np.int64)
        at = [*np.searchsorted(nodes, told["offset"], side="left").tolist(), len(nodes)]
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if b > a:
                low, high = self.shard(level, i)["sums"].pairs(nodes[a:b] - told["offset"][i])
                out[a:b] = high - low
        return out

    def children(self, level: int, p: np.ndarray, r: np.ndarray, scores: bool = True):
        """Of sorted (parent, child), a child of -1 being none: node or -1, place among the parent's children, the child's
        share, the parent's rest."""
        told = self.model.levels[level - 1]
        node, place = np.full(len(p), -1, dtype=np.int64), np.zeros(len(p), dtype=np.int64)
        share, rest = np.zeros(len(p)), np.ones(len(p))
        at = cuts(p, r, told["bounds"])
        at[0] = 0
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if b <= a:
                continue
            s = self.shard(level, i)
            plain = s["plain"]
            local = p[a:b] - int(plain["first"][0])
            inside = np.nonzero((local >= 0) & (local < len(plain["rest"])))[0]
            local = local[inside]
            if scores:
                rest[a + inside] = plain["rests"][plain["rest"][local]]
            # Those without a last word have been answered; pointers are read for the others only.
            inside = inside[r[a + inside] >= 0]
            start, end = s["start"].pairs(p[a + inside] - int(plain["first"][0]))
            want = r[a + inside]
            some = np.nonzero(end > start)[0]
            start, end = start[some], end[some]
            base = np.zeros(len(some), dtype=np.int64)
            later = start > 0
            base[later] = s["keys"][start[later] - 1] + 1
            found = s["keys"].find(base + want[some])
            hit = (found >= start) & (found < end)
            where = a + inside[some[hit]]
            node[where] = found[hit] + told["offset"][i]
            place[where] = found[hit] - start[hit]
            if scores:
                share[where] = plain["shares"][plain["share"][found[hit]]]
        # Parents whose children lie in several shards.
        if len(told["cut"]):
            k = np.minimum(np.searchsorted(told["cut"], p), len(told["cut"]) - 1)
            mine = np.nonzero(told["cut"][k] == p)[0]
            if len(mine):
                total = self.counts(level - 1, p[mine])
                rest[mine] = 1.0 - told["cut_kept"][k[mine]] / np.maximum(total, 1)
                place[mine] = node[mine] - told["cut_start"][k[mine]]
        return node, place, share, rest


class Stream:
    """The tokens of a chunk: of each text an end token that is context only, the words, and an end token."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        sizes = np.bincount(words.row, minlength=words.rows)
        total = len(words.row) + 2 * words.rows
        self.h = np.full(total, END, dtype=np.int64)
        self.h[np.arange(len(words.row)) + 2 * words.row + 1] = (words.hashes() >> np.uint64(1)).astype(np.int64)
        self.row = np.repeat(np.arange(words.rows), sizes + 2)
        self.first = np.zeros(total, dtype=bool)
        self.first[np.concatenate([[0], np.cumsum(sizes + 2)])[:-1]] = True
        self.rows = words.rows


def _runs(nodes: np.ndarray, first: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, last) of the places that have a context: nodes has the local number of each place's run of one
    word less, -1 for none. Returns places, context, last, inverse, times; with `whole` those without last, too."""
    context = np.concatenate([[-1], nodes[:-1]])
    at = np.nonzero((context >= 0) & ~first & (whole | (nodes >= 0)))[0]
    width = int(nodes.max(initial=-1)) + 2
    key, inverse = distinct(context[at] * width + nodes[at] + 1)
    return at, key // width, key % width - 1, inverse, np.bincount(inverse, minlength=len(key))


def _descend(reader: Reader, s: Stream, top: int, score: bool):
    """Look the runs of 1 to `top` words up. Returns each place's local number at level `top`, (node, place) by local
    number, counts of words by place and, with `score`, each place's probability."""
    model = reader.model
    h, inverse = distinct(s.h)
    node, count = reader.words(h)
    counts = count[inverse]
    p = (counts + 1) / (model.tokens + model.words + 1) if score else None
    node = np.where(count >= LEAST, node, -1)
    local, place = np.where(node[inverse] >= 0, inverse, -1), node
    base = p
    for level in range(2, top + 1):
        at, context, last, inverse, _ = _runs(local, s.first, score)
        found, where, share, rest = reader.children(level, node[context], np.where(last >= 0, place[last], -1), score)
        if score:
            p = p.copy() if p is base else p
            p[at] = p[at] * rest[inverse] + share[inverse]
        local = np.full(len(s.h), -1, dtype=np.int64)
        local[at] = np.where(found[inverse] >= 0, inverse, -1)
        node, place = found, where
    return local, node, place, counts, base, p


def _texts(batches, column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in gathered(batches, column, CHUNK):
        for first, part in chunks(batch.column(column), CHUNK):
            yield batch.slice(first, len(part)), part


def _counting(told, level: int, bounds: list[tuple[int, int]]):
    """What each chunk has of the runs of `level` words, dealt to the shards."""

    def run(batches):
        reader = Reader(told.value) if level > 1 else None
        for _, part in _texts(batches, 0):
            s = Stream(part)
            if level == 1:
                p, inverse = distinct(s.h[~s.first])
                n = np.bincount(inverse, minlength=len(p))
                r = np.zeros(len(p), dtype=np.int64)
            else:
                local, node, place, *_ = _descend(reader, s, level - 1, False)
                _, context, last, _, n = _runs(local, s.first, False)
                p, r = node[context], place[last]
            at = cuts(p, r, bounds)
            dealt = [(k, encode(p[a:b], r[a:b], n[a:b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int32()), pa.array([d for _, d in dealt], pa.binary())], names=["shard", "data"])
        release()

    return run


def _marks(n: np.ndarray) -> bytes:
    """(entry, share of it that lies before) at equal steps of the sum of n."""
    ends = np.cumsum(n)
    goal = ends[-1] * np.arange(MARKS) / MARKS
    at = np.minimum(np.searchsorted(ends, goal, side="right"), len(n) - 1)
    return np.stack([at, (goal - (ends[at] - n[at])) / n[at]], axis=1).astype(np.float64).tobytes()


def _sums(n: np.ndarray) -> dict[str, np.ndarray]:
    return EliasFano.build(np.concatenate([[0], np.cumsum(n)]), find=False)


def _built(told, level: int, order: int, bounds: list[tuple[int, int]]):
    """A level file of each shard, and a line about it."""

    def words(k, p, r, n):
        arrays = {"keys": EliasFano.build(p - bounds[k][0]), "sums": _sums(n)}
        return arrays, {"n": len(p), "total": int(n.sum()), "widest": 0, "first_p": -1 - 2 * k, "first_kept": 0.0, "last_p": -2 - 2 * k, "last_kept": 0.0, "last_start": 0, "marks": _marks(n)}

    def runs(k, p, r, n, reader):
        kept = n >= LEAST
        p, r, n = p[kept], r[kept], n[kept]
        if not len(p):
            return None, None
        parents, start = np.unique(p, return_index=True)
        sizes = np.diff(np.append(start, len(p)))
        total = reader.counts(level - 1, parents)
        held = np.add.reduceat(n - DISCOUNT, start)
        first, span = int(parents[0]), int(parents[-1] - parents[0]) + 1
        # Children's keys go on from one parent to the next.
        base = np.concatenate([[0], np.cumsum(r[start + sizes - 1] + 1)])[:-1]
        starts = np.zeros(span + 1, dtype=np.int64)
        starts[parents - first + 1] = sizes
        share, shares = quantise((n - DISCOUNT) / np.repeat(total, sizes), 256)
        some, rests = quantise(np.maximum(1.0 - held / total, 1e-6), 255)
        rest = np.full(span, 255, dtype=np.uint8)
        rest[parents - first] = some
        arrays = {"first": np.array([first]), "start": EliasFano.build(np.cumsum(starts), find=False), "keys": EliasFano.build(r + np.repeat(base, sizes)), "share": share, "shares": shares, "rest": rest, "rests": np.append(rests, 1.0)}
        if level < order:
            arrays["sums"] = _sums(n)
        return arrays, {
            "n": len(p), "total": int(n.sum()), "widest": int(sizes.max()), "first_p": first, "first_kept": float(held[0]), "last_p": int(parents[-1]), "last_kept": float(held[-1]), "last_start": int(start[-1]), "marks": _marks(n)
        }

    def run(batches):
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(k, []).append(data)
        model = told.value
        reader = Reader(model) if level > 1 else None
        store, path = fs.FileSystem.from_uri(model.folder)
        store.create_dir(path, recursive=True)
        lines = []
        for k in sorted(parts):
            p, r, n = merge(parts.pop(k))
            arrays, line = words(k, p, r, n) if level == 1 else runs(k, p, r, n, reader)
            if arrays:
                name = f"level{level}-{k}-{uuid.uuid4().hex}"
                with store.open_output_stream(f"{path}/{name}") as f:
                    f.write(succinct.dump(succinct.nested(arrays)))
                lines.append({"shard": k, "name": name} | line)
        names = [x.split()[0] for x in BUILT.split(", ")]
        kinds = {"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
        schema = pa.schema([(x, kinds[k]) for x, k in (y.split() for y in BUILT.split(", "))])
        yield pa.RecordBatch.from_pydict({x: [line[x] for line in lines] for x in names}, schema)
        release()

    return run


def train(texts: DataFrame, order: int = ORDER, shards: int | None = None) -> Model:
    """The model of the whole column `text`; a level has `shards` files, as many as Spark has shuffle partitions if not given."""
    spark = texts.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(scratch_path(spark, "lm"))
    bounds = [(-(-(k << 63) // shards), 0) for k in range(shards)]
    for level in range(1, order + 1):
        told = spark.sparkContext.broadcast(model)
        dealt = texts.select("text").mapInArrow(_counting(told, level, bounds), DEALT)
        built = dealt.repartition(shards, "shard").mapInArrow(_built(told, level, order, bounds), BUILT).collect()  # a line for each shard
        told.unpersist()
        model.add(built, bounds)
        if not built:
            break
        bounds = model.next_bounds(shards)
    return model


def _scoring(told):
    def run(batches):
        model = told.value
        reader = Reader(model) if model.levels and len(model.levels[0]["n"]) else None
        top = sum(1 for level in model.levels if len(level["n"]))
        for batch, part in _texts(batches, 2):
            s = Stream(part)
            if reader:
                *_, counts, base, p = _descend(reader, s, top, True)
            else:
                counts, base = np.zeros(len(s.h), dtype=np.int64), np.ones(len(s.h))
                p = base
            live = ~s.first

            def total(x, live=live, s=s):
                return np.bincount(s.row[live], weights=x[live], minlength=s.rows)

            n = np.bincount(s.row[live], minlength=s.rows)
            known = np.bincount(s.row[live & (counts > 0)], minlength=s.rows)
            base, score = total(np.log10(base)), total(np.log10(np.minimum(p, 1.0)))
            columns = [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(s.rows, model.tokens, dtype=np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        release()

    return run


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Scores of (doc_id, held_out, text)."""
    told = rows.sparkSession.sparkContext.broadcast(model)
    return rows.select("doc_id", "held_out", "text").mapInArrow(_scoring(told), SCORES)


def score_documents(documents: DataFrame, order: int = ORDER, shards: int | None = None) -> DataFrame:
    """Every document's scores under the model of those outside the held-out bucket."""
    doc = F.col("doc_id").cast("long")
    out = held_out(doc, BUCKETS, HELD_BUCKET)
    rows = documents.select(doc.alias("doc_id"), F.coalesce(out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = train(rows.where(F.col("doc_id").isNotNull() & ~F.col("held_out")), order, shards)
    return score(rows, model)
