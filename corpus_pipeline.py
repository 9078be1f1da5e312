"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again by the next.

All stages take empty tables, columns that clash with their own names, nulls in any column, and rows that repeat: equal rows fare
alike. Rows without a doc_id stay whole in line and near dedup, since they have no place in the order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rootscope.llm import language_id, line_dedup, near_dedup, packing, secret_scan
from rootscope.llm.common import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others (null or empty text, no letters, ambiguous) go."""
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one but for one edit; a document that keeps no visible line goes."""
    return line_dedup.dedup_lines(docs, min_chars=line_dedup.ALL_LINES)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each component of documents that share 0.8 of their 5-word shingles."""
    return near_dedup.keep_one_of_each(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced: owner-specific ones as <secret>, widely copied ones as <example-secret>; all rows stay, null texts as null."""
    return secret_scan.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document; a null or empty text is one token, its end."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("secret_scan", secrets), ("packing", packed)]

#: Best-fit packing looks for a bin among those opened so far, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
