"""What the operators share: cutting lineage, white space, row keys."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, drop, shared_dir  # noqa: F401  for the operators

#: White space of all contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of input for a bucket.
BUCKET = 256 << 20


def free(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs that nothing refers to any more; Spark removes them when the driver collects garbage (twice: the last job's plan is still held at first)."""
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.3)


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: str | Column) -> Column:
    """128 bits that stand for a text, as two longs: rows that repeat a doc_id are told apart by it."""
    t = whole(text)
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit("salt"), t).alias("b"))


def bucketed(df: DataFrame, col: str, label: str) -> tuple[DataFrame, str]:
    """df as a table of the warehouse, bucketed by col, a file for each bucket: later joins on col move only the other side.

    Buckets hold about BUCKET bytes of the input, as Spark estimates it. Also returns the table's name, to drop it by.
    """
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = size if size < 1 << 60 else 0  # Spark's default where it knows nothing
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    n = min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET)))
    df.repartition(n, col).write.bucketBy(n, col).saveAsTable(name)
    return spark.table(name), name
