"""Benchmark decontamination: prefix-filtered set join of item windows and whole documents.

A window is `window` consecutive words of an item (all of them in a shorter item); its set is its shingles, runs of
SHINGLE words (of all its words, if it has fewer). A document contains a window only if it has all of its shingles.

1. Shingles of items are counted in all documents. A window with a shingle that no document has can't occur.
2. Shingles are ordered by rarity. As all of a window's shingles are needed, its prefix is the rarest one alone.
3. Documents give the places of their prefix shingles, each with the words around it; they are joined with the windows
   on the shingle. Its place in the window bounds where the window starts, the window's length where it ends.
4. What is left is verified word by word, so equal hashes of different shingles don't matter.

Items and windows are tables all the way. What the scans look for reaches them as a bitmap that tasks build in slices, of
at most 16 MB however many items there are; it lets too much through and never too little, and the joins are exact. A
probe only counts where it stands in a run of as many shingles as a window has, six for windows of ten words: while items
have under two million shingles, one word in 64^6 passes by chance, and one in 64 of a map that is half full.

Defined results: a null or empty text has no words and no hits; very long texts are read whole; an item without an id
or words has no windows; ties: equal windows of several items give all of them, and repeated items count once; repeated
rows of documents each get their row, as results belong to a text's digest; an empty table of documents gives no rows,
one of items no hits; columns beside doc_id, item_id and text are not looked at, and come through `keep_clean` unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_WORDS, Bitmap, RunHashes, bitmap, materialise, release

WINDOW, SHINGLE = 10, 5
#: Digests of contaminated texts (about 100 bytes each in the join's table) are broadcast up to this number.
BROADCAST_KEYS = 500_000

WINDOWS = "item string, words array<binary>, shingles array<long>"
FOUND = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.list_(pa.binary()))]))
SCANNED = "doc_id long, digest binary, n_words long, found array<struct<h:long,at:int,before:int,around:array<binary>>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(ASCII_WORDS).split() if text else []


def _window_rows(window: int):
    def run(batches):
        hashes = RunHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                if not size:
                    continue
                width = min(SHINGLE, size)
                h = hashes(words, width).view(np.int64).tolist()
                n = len(words) - size + 1
                for start in range(0, n, 4096):
                    at = range(start, min(n, start + 4096))
                    rows = {"item": [item] * len(at), "words": [words[k : k + size] for k in at], "shingles": [h[k : k + size - width + 1] for k in at]}
                    schema = pa.schema([("item", pa.string()), ("words", pa.list_(pa.binary())), ("shingles", pa.list_(pa.int64()))])
                    yield pa.RecordBatch.from_pydict(rows, schema)

    return run


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words, shingles) of every window of every item."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    return items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(_window_rows(window), WINDOWS)


def _counted(filter_: tuple[int, bytes], widths: list[int]):
    """In how many documents of a partition's pieces each hash of the bitmap is."""

    def run(batches):
        look, hashes = Bitmap(*filter_), RunHashes()
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                for width in widths:
                    h = hashes(words, width)
                    found.append(np.unique(h[look(h)]))
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])
        release()

    return run


def in_runs(there: np.ndarray, least: int) -> np.ndarray:
    """Which places stand in a run of at least so many true ones."""
    edges = np.diff(np.concatenate([[0], there.view(np.int8), [0]]))
    starts, stops = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    long = stops - starts >= least
    marks = np.zeros(len(there) + 1, dtype=np.int32)
    marks[starts[long]] += 1
    marks[stops[long]] -= 1
    return np.cumsum(marks[:-1]) > 0


def _scanned(asked: tuple[int, bytes], filter_: tuple[int, bytes], widths: dict[int, int], window: int):
    """widths: the fewest shingles that a window with shingles of that width has. All of them follow one another in a text
    that holds the window, so a probe that doesn't stand in such a run of shingles of items is passed over."""

    def run(batches):
        every, look, hashes = Bitmap(*asked), Bitmap(*filter_), RunHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                digests, sizes, found = [], [], []
                for text in part.column(1).to_pylist():
                    words, mine = words_of(text), []
                    for width, least in widths.items():
                        h = hashes(words, width)
                        for at in np.nonzero(in_runs(every(h), least) & look(h))[0].tolist():
                            before = min(at, window - 1)
                            mine.append({"h": int(h[at].view(np.int64)), "at": at, "before": before, "around": words[at - before : at + window]})
                    digests.append(hashlib.md5(text.encode("utf-8", "replace")).digest() if text is not None else None)
                    sizes.append(len(words))
                    found.append(mine)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, FOUND)], names=["doc_id", "digest", "n_words", "found"])
        release()

    return run


def _probes(texts: DataFrame, own: DataFrame, filter_: tuple[int, bytes], widths: list[int]) -> DataFrame:
    """(h, place, window, words) of every window that may occur: its rarest shingle and the place of that."""
    counts = texts.mapInArrow(_counted(filter_, widths), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    each = own.select("window", F.size("shingles").alias("size"), F.posexplode("shingles").alias("place", "h"))
    least = F.min(F.struct("n", "h", "place")).alias("rarest")
    chosen = each.join(counts, "h").groupBy("window", "size").agg(least, F.count("*").alias("m")).where("m = size")
    return own.select("window", "words").join(chosen.select("window", "rarest.h", "rarest.place"), "window")


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_words, found) of every row of documents, and (digest, items, spans) of texts with hits."""
    every = materialise(windows(benchmark, window).withColumn("window", F.md5(F.array_join(F.transform("words", F.hex), " ")).cast("binary")), "windows")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = every.groupBy("window").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    # Windows have `window` words or fewer, so there are few widths.
    widths: dict[int, int] = {}
    for n in sorted(r[0] for r in every.select(F.size("words")).distinct().collect()):
        widths.setdefault(min(SHINGLE, n), n - min(SHINGLE, n) + 1)
    shingles = materialise(every.select(F.explode("shingles").alias("h")).distinct(), "shingles")
    asked = bitmap(shingles, shingles.count())
    probes = materialise(_probes(docs.select("text"), own, asked, list(widths)), "probes")
    table = materialise(docs.mapInArrow(_scanned(asked, bitmap(probes.select("h"), probes.count()), widths, window), SCANNED), "scanned")

    places = table.where(F.size("found") > 0).select("digest", F.explode("found").alias("f")).select("digest", "f.*")
    met = places.join(probes, "h").where((F.col("place") <= F.col("before")) & (F.size("around") - F.col("before") + F.col("place") >= F.size("words")))
    met = met.where(F.slice("around", F.col("before") - F.col("place") + 1, F.size("words")) == F.col("words"))
    start = F.col("at") - F.col("place")
    hits = met.select("digest", "window", start.cast("long").alias("start"), (start + F.size("words")).cast("long").alias("stop")).distinct()
    hits = materialise(hits, "hits")
    spans = hits.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    owners = every.select("window", "item").distinct()
    items = hits.select("digest", "window").distinct().join(owners, "window").groupBy("digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return table, materialise(spans.join(items, "digest"), "found")


def _covered(spans: Column) -> Column:
    """Number of words in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["upto"], s["stop"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(acc["upto"], s["start"]))).alias("n"),
    )
    return F.aggregate(F.sort_array(spans), start, step)["n"]


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row; items sorted as strings, spans of occurrences in words."""
    table, found = find(documents, benchmark, window)
    # Rows without any prefix shingle skip the join.
    rows = table.where(F.size("found") > 0).select("doc_id", "digest", "n_words").join(found, "digest", "left")
    none = table.where(F.size("found") == 0).select("doc_id", "n_words", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
    rows = rows.select("doc_id", "n_words", "items", "spans").unionByName(none)
    items, spans = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    return rows.select("doc_id", "n_words", _covered(spans).alias("n_hit"), items.alias("items"), spans.alias("spans"))


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows in which no window of an item occurs, with their own columns only."""
    _, found = find(documents, benchmark, window)
    bad = found.select(F.col("digest").alias("__digest"))
    if bad.count() <= BROADCAST_KEYS:
        bad = F.broadcast(bad)
    own = F.unhex(F.md5(documents["text"].cast("string").cast("binary")))
    return documents.join(bad, own == F.col("__digest"), "left_anti")
