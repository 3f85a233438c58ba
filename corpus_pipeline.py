"""The corpus pipeline: quality, line dedup, near-dedup, packing. Each stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import delete, new_path, small_batches, table
from strandlake.llm.linedup import drop_similar_lines
from strandlake.llm.minhash import drop_near_duplicates
from strandlake.llm.packing import pack
from strandlake.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels table, scores at 0.3 or more. As keep_quality.

    Texts are long, and what a stage returns is worked out when it is written, so from here on Arrow batches are small.
    """
    small_batches(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"), cut=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line is equal to or like; what loses its last words goes. As drop_similar_lines."""
    small_batches(spark)
    return drop_similar_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more. As drop_near_duplicates."""
    small_batches(spark)
    return drop_near_duplicates(docs, k=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences of at most 4096 tokens. As pack: repeated rows and null doc_ids are packed each.

    Workers that other stages have used remember less of the vocabulary.
    """
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), most=4096, end=1, places=20)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Tokenizing and clustering have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Null and empty texts pass quality by their score and are packed as one token each; no rows in, none out.

    Each stage's result is a table of its own in the shared folder, which goes once the next one is there.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
