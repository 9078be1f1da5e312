"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries (one for each partition, merged in two levels) name digests that may be frequent. An exact
count verifies them; the winners, at most `counters` rows, are broadcast and settle their rows where they are
read. No digest that is left has more than about 1/counters of the rows, so those are shuffled by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, cut, whole

#: Counters of a summary and therefore the most rows that are ever broadcast.
COUNTERS = 1024


def frequent_digests(keyed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` verified winners: digest, keep_id, group_size (exact, over all rows)."""
    sketch = f"approx_top_k_accumulate(item, {counters})"
    parts = keyed.select(F.xxhash64("digest").alias("item"), (F.spark_partition_id() % 64).alias("part")).groupBy("part").agg(F.expr(sketch).alias("sketch"))
    # grouped by a constant: partitions without rows, and empty tables, then give no summary
    one = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {counters})").alias("sketch"))
    named = one.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {counters})")).alias("top")).select(F.col("top.item").alias("item"))
    rows = keyed.withColumn("item", F.xxhash64("digest")).join(F.broadcast(named), "item", "left_semi")
    exact = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # two digests may share an item; so the bound is enforced, and what falls out goes the ordinary way
    return exact.filter("group_size > 1").orderBy(F.desc("group_size"), "digest").limit(counters)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Equal: same text after each run of white space became one blank; null counts as empty, and empty texts are
    one group. The smallest doc_id of a group stays; null ids stay only in a group that has no other. Rows that
    repeat a doc_id and text are one document: each of them has the same verdict and counts in group_size. An
    empty table gives an empty result; other columns are not looked at.
    """
    norm = F.regexp_replace(whole(text_col), WS, " ")
    keyed = cut(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("digest")), "digests")
    winners = cut(frequent_digests(keyed, counters), "winners")
    hot = keyed.join(F.broadcast(winners), "digest").select("doc_id", "keep_id", "group_size", "digest")
    rest = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # groups are summed up where they are read, and only those of several rows come back to their rows
    groups = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    cold = rest.join(groups, "digest", "left").select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return hot.unionByName(cold).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
