"""Phrase collocation mining: weighted phrase counts out of core, parts looked up by shuffled requests.

1. Texts are cut into pieces; identical pieces of a language become one row with a multiplicity, so copies of documents,
   repeated lines and boilerplate are counted once, weighted.
2. Phrases of 1, 2, ... words are counted level by level. A task adds up its own phrases first; the sums are dealt by
   hash to buckets, and DuckDB counts a bucket in a file of its own with a bound on memory, so a bucket may be larger
   than memory. Only phrases of `least` occurrences or more are kept: a rarer one is neither a candidate nor a part of
   one. From the second level on a task leaves out phrases of which the first or the last words are too rare, told by a bitmap
   of fixed size that lets too much through and never too little.
3. Each cut of a candidate asks for the counts of its two parts: requests and counts are joined on the part.
4. Candidates inside a longer one that is frequent enough go; the best of each language come out, in two rounds, so no
   language is ranked by one task whole.

Counts are 64-bit and scores are computed in decimals of 38 digits, exact up to 10^14 occurrences of a phrase. In one task's chunk of
CHUNK bytes phrases are told apart by 64-bit hashes, across tasks by their text.

Defined results: a null or empty text has no pieces; a null lang is `und`; very long texts and pieces are read whole;
ties of cuts go to the shortest first part, ties of phrases by count and then bytes; repeated rows count each time; an
empty table gives no rows; columns beside text and lang are not looked at. A bucket's file lies in the executor's own
working space as Spark's spills do, is read by its task alone and goes with it; a lost executor's buckets are counted anew.
"""

from __future__ import annotations

import tempfile
import zlib
from functools import reduce

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, bitmap, materialise, release
from .tokens import Words, chunks, gathered, join, mix

MOST_WORDS, LEAST, TOP = 3, 10, 2000
#: A longer candidate of at least so many hundredths of a candidate's count makes it go.
INSIDE = 50
#: Bytes of pieces that a task looks at together; memory of a bucket's DuckDB.
CHUNK, BUCKET_MEMORY = 4 << 20, "192MB"
#: Parts of a language in the first round of ranking.
PARTS = 64

PIECE_END = r"[.,;:!?\x0A-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = "lang string, phrase string, f long"


def pieces(documents: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces of each language and how often they occur."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    cut = documents.select(lang.alias("lang"), F.explode(F.split(text, PIECE_END)).alias("piece")).withColumn("piece", F.trim("piece"))
    return cut.where(F.col("piece") != "").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _seed(lang: str) -> np.uint64:
    return mix(np.array([zlib.crc32(lang.encode("utf-8", "replace")) + (len(lang) << 32)], dtype=np.uint64))[0]


def _runs(h: np.ndarray, row: np.ndarray, size: int) -> list[np.ndarray]:
    """Hashes of the runs of 1 to `size` words, each by its first word; a run past the end of its row has none."""
    out = [h]
    for k in range(1, size):
        n = max(0, len(h) - k)
        out.append(np.where(row[k:] == row[:n], join(out[-1][:n], h[k:]), np.uint64(0)))
    return out


def _sums(size: int, frequent):
    """Of each chunk: the phrases of `size` words and how often they occur; at one word also the sum, as the phrase null."""

    def run(batches):
        look = Bitmap(*frequent.value) if frequent else None
        for batch in gathered(batches, 1, 2 * CHUNK):
            langs, m = batch.column(0).dictionary_encode(), batch.column(2).to_numpy(zero_copy_only=False)
            codes = langs.indices.to_numpy(zero_copy_only=False)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                rows = np.nonzero(codes == code)[0]
                seed = _seed(lang)
                for first, part in chunks(batch.column(1).take(pa.array(rows)), CHUNK):
                    words = Words(part)
                    if len(words.starts) < size:
                        continue
                    h = words.hashes() ^ seed
                    n = len(h) - size + 1
                    runs = _runs(h, words.row, size)
                    at = np.nonzero(words.row[size - 1 :] == words.row[:n])[0]
                    if look and size > 1:
                        shorter = runs[size - 2]
                        at = at[look(shorter[at])]
                        at = at[look(shorter[at + 1])]
                    weight = m[rows[first + words.row[at]]]
                    codes_, found = pd.factorize(runs[size - 1][at])
                    where = np.empty(len(found), dtype=np.int64)
                    where[codes_[::-1]] = np.arange(len(codes_))[::-1]  # the first of each
                    if weight.sum() < 2**53:  # whole numbers that a double holds
                        f = np.bincount(codes_, weights=weight, minlength=len(found)).astype(np.int64)
                    else:
                        f = np.zeros(len(found), dtype=np.int64)
                        np.add.at(f, codes_, weight)
                    raw, starts, ends = words.raw(), words.starts[at[where]], words.ends[at[where] + size - 1]
                    # Runs whose words stand further apart than one space are written with single ones.
                    gap = np.concatenate([[0], np.cumsum((words.starts[1:] - words.ends[:-1] != 1) | (words.codes[words.ends[:-1]] != 32))])
                    wide = gap[at[where] + size - 1] != gap[at[where]]
                    phrases = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    for i in np.nonzero(wide)[0]:
                        phrases[i] = b" ".join(phrases[i].split())
                    if size == 1:
                        phrases.append(None)
                        f = np.append(f, weight.sum())
                    text = pa.array(phrases, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), text, pa.array(f)], names=["lang", "phrase", "f"])
        release()

    return run


def _bucket(least: int):
    """The sums of a bucket's phrases, counted in a DuckDB file."""

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            con = duckdb.connect(f"{folder}/bucket.db", config={"memory_limit": BUCKET_MEMORY, "temp_directory": f"{folder}/spill", "threads": 1})
            con.execute("CREATE TABLE sums (lang VARCHAR, phrase VARCHAR, f BIGINT)")
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                con.execute("INSERT INTO sums SELECT lang, phrase, f FROM batch")
                con.unregister("batch")
            found = con.sql(f"SELECT lang, phrase, CAST(sum(f) AS BIGINT) AS f FROM sums GROUP BY ALL HAVING sum(f) >= {int(least)} OR phrase IS NULL")
            for batch in found.to_arrow_reader(10_000):
                yield batch.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))
            con.close()
        release()

    return run


def _hashes(batches):
    """The hash of every phrase, as `_sums` has it."""
    for batch in batches:
        seeds = {x: _seed(x) for x in batch.column(0).unique().to_pylist()}
        words = Words(batch.column(1))
        seed = np.array([seeds[x] for x in batch.column(0).to_pylist()], dtype=np.uint64)
        h, size = words.hashes(), np.bincount(words.row, minlength=words.rows)
        h = h ^ seed[words.row]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        total = h[first[size > 0]]
        for k in range(1, int(size.max()) if len(size) else 0):
            longer = size[size > 0] > k
            total[longer] = join(total[longer], h[first[size > 0][longer] + k])
        yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64))], names=["h"])


def counts(documents: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST) -> list[DataFrame]:
    """(lang, phrase, f) of all phrases of 1, 2, ... most_words words with least occurrences or more, a table for each
    length; the first also has each language's number of words, under the phrase null."""
    spark = documents.sparkSession
    distinct = materialise(pieces(documents), "pieces")
    out, frequent = [], None
    for size in range(1, most_words + 1):
        sums = distinct.mapInArrow(_sums(size, frequent), COUNTS)
        out.append(materialise(sums.repartition("lang", "phrase").mapInArrow(_bucket(least), COUNTS), f"phrases{size}"))
        if frequent:
            frequent.unpersist()
        if size < most_words:
            kept = out[-1].where(F.col("phrase").isNotNull()).select("lang", "phrase")
            frequent = spark.sparkContext.broadcast(bitmap(kept.mapInArrow(_hashes, "h long"), kept.count()))
    return out


def _score(a: str, left: str, right: str) -> Column:
    d = "decimal(14,0)"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as {d}) * cast({a} as {d})) div (cast({left} as {d}) * cast({right} as {d}))")


def mine(documents: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    levels = counts(documents, most_words, least)
    totals = levels[0].where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    parts = reduce(DataFrame.unionByName, [x.where(F.col("phrase").isNotNull()) for x in levels[:-1]])
    candidates = reduce(DataFrame.unionByName, levels[1:]).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    def phrase(start, size) -> Column:
        return F.array_join(F.slice("words", start, size), " ")

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("first"), phrase(1, F.col("cut")).alias("part")), F.struct(F.lit(False).alias("first"), phrase(F.col("cut") + 1, F.size("words")).alias("part"))))
    requests = materialise(cuts.select("lang", "phrase", "a", "cut", sides.alias("s")).select("lang", "phrase", "a", "cut", "s.*"), "requests")
    answered = requests.join(parts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    pairs = answered.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    best = pairs.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_score("a", "l", "r").alias("score"), "cut", "l", "r")).alias("s"))

    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1))
    held = (
        candidates.where(F.size("words") > 2)
        .select("lang", "words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
        .select("lang", "words", "a", "size", starts.alias("start"))
        .groupBy("lang", phrase(F.col("start"), F.col("size")).alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    kept = best.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    scored = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
