"""Shared helpers: table access, the shared scratch folder, byte-level word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Also turns every ASCII byte that is neither a letter nor a digit into a space, so that split() yields
#: the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text; bytes from 0x80 stay in words.
ASCII_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


# Rolling hash: an odd multiplier and its inverse modulo 2^64; a final mix spreads the low bits.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class RunHashes:
    """64-bit hashes of all runs of so many words, by their first word."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)

    def __call__(self, words: list[bytes], size: int) -> np.ndarray:
        if not size or len(words) < size:
            return np.zeros(0, dtype=np.uint64)
        raw = b" ".join(words) + b" "
        n = len(raw)
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        codes = np.frombuffer(raw, dtype=np.uint8)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        stops = np.nonzero(codes == 32)[0]
        starts = np.concatenate([[0], stops[:-1] + 1])
        first, last = starts[: len(starts) - size + 1], stops[size - 1 :]
        h = (sums[last] - sums[first]) * self.down[first]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        return h


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Unset, a local master gets a temporary folder; a cluster has no safe default, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", made)
    _remove_at_exit(spark, made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the Python driver ends."""
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and the files
    outlive any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a bitmap for each hash in it, the fewest and the most bits it has (16 MB), bytes of a slice.
SPREAD, LEAST_BITS, MOST_BITS, SLICE = 64, 16, 27, 1 << 16


def _sliced(bits: int):
    """The slices of a partition's own bitmap that have a bit."""

    def run(batches):
        marks = np.zeros(1 << bits, dtype=bool) if bits <= 20 else None
        packed = None if bits <= 20 else np.zeros(1 << (bits - 3), dtype=np.uint8)
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & mask)
            if marks is not None:
                marks[at] = True
            else:
                np.bitwise_or.at(packed, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if packed is None:
            packed = np.packbits(marks, bitorder="little")
        yield from _slices((k, packed[k * SLICE : (k + 1) * SLICE]) for k in range(-(-len(packed) // SLICE)))
        release()

    return run


def _slices(pairs):
    for k, data in pairs:
        if data.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["k", "data"])


def _merged(batches):
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(data, dtype=np.uint8)
            found[k] = found[k] | part if k in found else part
    yield from _slices(found.items())


def bitmap(hashes: DataFrame, n: int) -> tuple[int, bytes]:
    """(bits, bytes) with a bit for each of about n hashes, at its lowest bits: what has no bit is not among them.

    Tasks mark their own hashes and send slices, tasks merge slices, and the driver gets at most 2^MOST_BITS bits of
    binary slices, however many hashes there are; past that size the map lets more through, never too little.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (SPREAD * n).bit_length()))
    slices = -(-(1 << (bits - 3)) // SLICE)
    parts = hashes.mapInArrow(_sliced(bits), "k int, data binary").repartition(min(slices, 64), "k").mapInArrow(_merged, "k int, data binary")
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for k, data in parts.collect():
        out[k * SLICE : k * SLICE + len(data)] = np.frombuffer(data, dtype=np.uint8)
    return bits, out.tobytes()


class Bitmap:
    """Which of the hashes may be in a bitmap."""

    def __init__(self, bits: int, data: bytes):
        self.bytes, self.mask = np.frombuffer(data, dtype=np.uint8), np.uint64((1 << bits) - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        place = h & self.mask
        return (self.bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def trim() -> None:
    """Give freed memory back to the system: Arrow's own pool keeps what it frees, as does the C library."""
    import ctypes

    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back:
        back(0)


def release() -> None:
    """Give a finished partition's memory back; Python workers live on and serve other queries."""
    import gc

    gc.collect()
    trim()


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM has gone already; the folder's owner clears it
            pass

    atexit.register(remove)


def held_out(doc_id, buckets: int, bucket: int):
    """True where crc32 of the id's text falls in the held-out bucket."""
    return F.crc32(doc_id.cast("string")) % buckets == bucket


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, buckets: int, bucket: int, most: int, most_bytes: int
) -> DataFrame:
    """(text, y) of at most `most` labelled documents outside the held-out bucket, with at most `most_bytes` of text.

    The sample is the rows with the smallest hashed ids, so it is the same in every run; its ids are the only thing
    broadcast and number `most` at most. An id labelled twice takes label 1 if it has it once; of rows that repeat an
    id the text with the smallest hash counts. Whole texts are taken, in the order of hashed ids, until the next would
    pass the bound; the first is taken in any case.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("_id"), buckets, bucket))
        .groupBy("_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    sample = materialise(met.select(F.xxhash64("_id").alias("place"), "text", "y"), "sample")
    # At most `most` pairs of numbers.
    sizes = sorted((r["place"], r["n"]) for r in sample.select("place", F.octet_length("text").alias("n")).collect())
    total, last = 0, None
    for place, n in sizes:
        total += n
        if total > most_bytes and last is not None:
            sample = sample.where(F.col("place") <= last)
            break
        last = place
    return sample.select("text", "y")
