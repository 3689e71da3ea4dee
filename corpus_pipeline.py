"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

quality        documents scoring under quality.KEEP_AT go
toxicity       documents scoring toxicity.REJECT_AT or more go
near_dedup     one document of each group of near copies (80 of 100 five-word shingles, over any chain) stays
decontaminate  documents that hold a window of a benchmark item go
sentencepiece  the ids of what is left

All but the last give the rows they keep with their own columns, whatever these are called. Defined results: a null or
empty text is scored as empty, is no copy of anything and holds no window; a null id never makes a row go, and rows that
repeat an id are judged by their own texts; of equal rows one stays; very long texts are read whole; an empty table
stays empty. Labels are looked up by id, so rows without one are not learned from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, near_dedup, pieces, quality, toxicity
from tidemark.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Learned scores, reachability under exact Jaccard and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
