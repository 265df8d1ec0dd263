"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet in the shared folder and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import decontaminate, mixing, near_dedup, quality, token_store
from tessel.llm.common import drop_path, new_path, table
from tessel.llm.queries import MIX_CAP, MIX_SHARE, MIX_WEIGHTS, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the co-trained classifier rejects. Nulls, empty texts and repeated rows are judged like any row."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage like a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come to their target shares."""
    return mixing.apply_mix(docs, MIX_WEIGHTS, MIX_SHARE, MIX_CAP)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids with their index and return a digest of each document read back: doc_id, start, n_tokens, ids_crc32."""
    return token_store.token_digests(docs, tokenizer_path(), end_id=1)


STAGES = [("quality", keep_quality), ("near_dedup", keep_distinct), ("decontaminate", keep_uncontaminated), ("mix", mix), ("token_ids", tokenize)]

#: No stage but the mix's sizes can be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
