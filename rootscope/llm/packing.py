"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Pieces of documents are dealt to shards by a hash of their id, text, place and number among equal ones, so that a
source's, a cluster's or a long document's pieces spread evenly; a shard packs its items, longest first. Its bins are ordered by what is left in them and carry bitmaps of the sources
and duplicate clusters that they hold. The search starts at the first bin that is large enough and goes on to its
successors until one holds neither the item's source nor its cluster; if there is none, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WS, cut, text_key, whole

#: Tokens of a bin; items of a shard, on average.
CAPACITY, SHARD = 2048, 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item, in the order given. None as a source or a cluster conflicts with nothing."""
    bit: dict = {}
    left: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[int] = []  # bin -> bitmap of its sources and clusters
    out = []
    for n, source, cluster in zip(sizes, sources, clusters, strict=True):
        own = 0
        for kind, value in (("s", source), ("c", cluster)):
            if value is not None:
                own |= 1 << bit.setdefault((kind, value), len(bit))
        i = bisect_left(left, (n, -1))
        while i < len(left) and held[left[i][1]] & own:
            i += 1
        if i < len(left):
            residual, b = left.pop(i)
        else:
            residual, b = capacity, len(held)
            held.append(0)
        held[b] |= own
        if residual > n:
            insort(left, (residual - n, b))
        out.append(b)
    return out


def items(docs: DataFrame, capacity: int, id_col: str, text_col: str, source_col: str, cluster: Column | None, tokens: Column | None = None) -> DataFrame:
    """doc_id, key, source, cluster, piece, start, n_tokens, copy: documents longer than a bin are cut into full bins and a rest."""
    text = whole(text_col)
    size = tokens.cast("long") if tokens is not None else (F.regexp_count(text, F.lit(WORD)) + 1).cast("long")
    own = cluster if cluster is not None else F.xxhash64(F.regexp_replace(text, WS, " "))
    t = docs.select(F.col(id_col).alias("doc_id"), text_key(text)["a"].alias("key"), F.col(source_col).cast("string").alias("source"), own.cast("string").alias("cluster"), size.alias("all"))
    # rows that repeat in all of this are counted, then dealt out again by their number
    t = t.groupBy("doc_id", "key", "source", "cluster", "all").agg(F.count("*").alias("times"))
    t = t.filter("all > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    t = t.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / capacity))))
    return t.select("doc_id", "key", "source", "cluster", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("piece") * capacity).alias("n_tokens"), "copy")


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, shard: int = SHARD, tokens: Column | None = None) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, n_tokens, source, bin_id, bin_start.

    tokens: how many tokens a row has (as an encoder counts them; rows of none or null are left out). By default: words
    parted by white space, and one end for each document; so a null or empty text is one token. No bin
    holds more than `capacity` tokens, two pieces of one source, or two of one cluster (by default: the same text but
    for white space). A null source or cluster conflicts with nothing. Order in a shard: longer first, then doc_id
    (null last), text, piece, source, cluster; rows that repeat a document are items of their own.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = cut(items(docs, capacity, id_col, text_col, source_col, cluster, tokens), "items")
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", "piece", "copy"), F.lit(shards)))
    schema = f"doc_id {id_type}, piece long, start long, n_tokens long, source string, bin_id long, bin_start long"
    order = [("n_tokens", "descending"), *((c, "ascending") for c in ("doc_id", "key", "piece", "source", "cluster"))]

    def run(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, sort_keys=order, null_placement="at_end"))
        sizes = np.array(part.column("n_tokens"), np.int64)
        bins = np.array(best_fit(sizes.tolist(), part.column("source").to_pylist(), part.column("cluster").to_pylist(), capacity), np.int64)
        by_bin = np.argsort(bins, kind="stable")
        end, new = np.cumsum(sizes[by_bin]), np.diff(bins[by_bin], prepend=-1) > 0
        start = np.empty(len(bins), np.int64)
        start[by_bin] = end - sizes[by_bin] - (end - sizes[by_bin])[new][np.cumsum(new) - 1]
        out = part.select(["doc_id", "piece", "start", "n_tokens", "source"])
        return out.append_column("bin_id", pa.array(bins + (part.column("shard")[0].as_py() << 32))).append_column("bin_start", pa.array(start))

    return rows.groupBy("shard").applyInArrow(run, schema)
