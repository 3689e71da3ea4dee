"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, fingerprint, licenses, lm, near_dedup, negatives, pieces, quality, sharding, toxicity, warc
from .common import held_out, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and whether decoding gives it back."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), quality.BUCKETS, quality.HELD_BUCKET).alias("held_out"),
        "score",
        (F.col("score") >= quality.KEEP_AT).cast("int").alias("predicted"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call, linked with its answer, validated and serialised."""
    return chat.link(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
calls AS (SELECT conv_id, turn, text FROM m WHERE role = 'user'),
answers AS (SELECT conv_id, turn, min(text) AS text FROM m WHERE role = 'assistant' GROUP BY ALL),
known AS (SELECT DISTINCT conv_id, turn FROM calls)
SELECT c.conv_id, c.turn, 0 AS place, 0 AS level, c.conv_id || ':' || c.turn AS call_id, a.turn AS result_turn, a.turn IS NOT NULL AS linked,
  c.turn < 2 OR k.turn IS NOT NULL AS in_order,
  CASE WHEN length(c.text) < 1 THEN 'prompt: too short' WHEN length(c.text) > 240 THEN 'prompt: too long' ELSE '' END AS errors,
  '{"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '},"id":' || to_json(c.conv_id || ':' || c.turn) || ',"name":"reply","result":'
    || CASE WHEN a.turn IS NULL THEN 'null' ELSE to_json(a.text) END || '}' AS json
FROM calls c LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 LEFT JOIN known k ON k.conv_id = c.conv_id AND k.turn = c.turn - 2"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, and where it goes when one shard leaves."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(sharding.place(docs, "doc_id"), "doc_id", sharding.SHARDS[:-1], slot="slot_without_last", shard="shard_without_last").drop("slot_without_last")


def _op5_sql() -> str:
    def cases(shards):
        return "[" + ", ".join(str(i) for i in sharding.fill(shards)) + "]"

    slot = f"(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS})"
    name = "printf('shard-%02d', {}[slot + 1])"
    return f"""
WITH t AS (SELECT {cases(sharding.SHARDS)} AS a, {cases(sharding.SHARDS[:-1])} AS b), d AS (SELECT doc_id, {slot} AS slot FROM documents)
SELECT doc_id, slot, {name.format("a")} AS shard, {name.format("b")} AS shard_without_last FROM d, t"""


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("identifiers").cast("long").alias("n_identifiers"),
        F.array_join("identifiers", ",").alias("identifiers"),
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), toxicity.BUCKETS, toxicity.HELD_BUCKET).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT_AT).cast("int").alias("predicted"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes, BASE32 AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN g USING (html)"""


def _op10_sql() -> str:
    """Base32 of a SHA-1 in SQL: 32 groups of five bits of its 40 hex digits."""
    digit = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    # Five hex digits are 20 bits, which are four letters.
    letters = " || ".join(
        f"substr({digit}, (((('0x' || substr(sha1(html), {5 * k + 1}, 5))::BIGINT >> {shift}) & 31) + 1)::INTEGER, 1)" for k in range(8) for shift in (15, 10, 5, 0)
    )
    return OP10_SQL.replace("BASE32", letters)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every fiftieth vector among all vectors."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.usable(table(spark, sf_dir, "embeddings"), turned)
    return negatives.mine(rows, rows.where(F.col("vec_id") % 50 == 0))


OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label = own) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p),
d AS (SELECT lang, words, count(*) AS m FROM w GROUP BY ALL),
e AS (SELECT lang, words, m, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, (VALUES (1), (2), (3)) t(k) WHERE len(words) >= k),
g AS (SELECT lang, k, words[i:i + k - 1] AS ws, CAST(sum(m) AS BIGINT) AS f FROM e GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY ALL),
c AS (SELECT lang, k, ws, f AS a FROM g WHERE k > 1 AND f >= 10),
u AS (SELECT lang, k, ws, a, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.k, u.ws, u.a, u.cut, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * u.a * u.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM u JOIN g x ON x.lang = u.lang AND x.ws = u.ws[1:u.cut] JOIN g y ON y.lang = u.lang AND y.ws = u.ws[u.cut + 1:u.k]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) AS place FROM s) WHERE place = 1),
h AS (SELECT lang, ws, max(a) AS longer FROM (SELECT lang, ws[1:2] AS ws, a FROM c WHERE k = 3 UNION ALL SELECT lang, ws[2:3], a FROM c WHERE k = 3) GROUP BY ALL),
f AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN h ON h.lang = b.lang AND h.ws = b.ws WHERE h.longer IS NULL OR 100 * h.longer < 50 * b.a)
SELECT * FROM (SELECT f.lang, row_number() OVER (PARTITION BY f.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM f JOIN n ON n.lang = f.lang) WHERE rank <= 2000"""


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole text under a trie of runs of up to three words."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sentencepiece, op2_quality, op3_fingerprint, op4_chat, op5_sharding,
        op6_licenses, op7_near_dedup, op8_decontaminate, op9_toxicity, op10_warc,
        op11_negatives, op12_collocations, op13_lm_scoring,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op5_sharding": _op5_sql(), "op6_licenses": licenses.oracle(), "op10_warc": _op10_sql(), "op11_negatives": OP11_SQL, "op12_collocations": OP12_SQL}
