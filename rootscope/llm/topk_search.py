"""Exact top-k search by inner product in three phases with a uniform threshold.

A vector's components are dealt to PARTS score lists; a score is the sum over the lists.
1. Every shard of rows gathers, for each query, the DEPTH highest entries of each list and scores their rows. Of these the
   k best leave the shard, and one number: the sum of the lists' lowest gathered entries, under which every other row of
   the shard stays. The k-th best over all shards can only be below the true one: a safe cutoff.
2. The cutoff goes back, but only to shards whose number is above it; for the others the query is settled. There the
   entries of at least cutoff / PARTS are collected: a row without one cannot reach the cutoff. For a row with some, they
   and cutoff / PARTS for each list that has none bound its score.
3. Rows whose bound reaches the cutoff are scored exactly, and ranked with those of phase 1.
Queries come in blocks, rows in shards; each pair of block and shard is worked on where both were sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Score lists, rows of a shard, entries of a list that a shard gathers (k + 1 at least), queries of a block, shards that share a copy of a block.
PARTS, SHARD, DEPTH, BLOCK, LANE = 4, 1024, 64, 2048, 4


def _sound(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _shards(rows: DataFrame) -> DataFrame:
    """dim, shard, ids, vecs: runs of at most SHARD rows of a partition, as binary matrices of floor(256 x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0), np.int64)
            lists = batch.column(1)
            at = np.array(lists.offsets, np.int64)
            flat = np.floor(256.0 * np.array(lists.values, np.float64)[at[0] : at[-1]])
            at -= at[0]
            dims = np.diff(at)
            out: list[tuple] = []
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for lo in range(0, len(own), SHARD):
                    part = own[lo : lo + SHARD]
                    vecs = flat[(at[part][:, None] + np.arange(dim)[None]).ravel()]
                    out.append((int(dim), ids[part].tobytes(), vecs.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2))], names=["dim", "ids", "vecs"])

    return rows.select("vec_id", "vec").mapInArrow(run, "dim long, ids binary, vecs binary").withColumn("shard", F.xxhash64("ids"))


def _partial(q: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Partial scores by list, exactly: floats while they hold the integers, else longer ones."""
    dim = q.shape[1]
    cuts = [round(dim * k / PARTS) for k in range(PARTS + 1)]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, dim)
    if most >= 2**53:
        kind = np.int64 if most < 2**62 else object
        q, v = (x.astype(kind) if kind is np.int64 else np.array([[int(y) for y in r] for r in x], object).reshape(x.shape) for x in (q, v))
    return [q[:, a:b] @ v[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)]


def _long(x) -> int:
    return int(min(max(int(x), -(2**63)), 2**63 - 1))


def _unpacked(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, ...]:
    """ids of a shard in order, their partial scores for the asked queries by list, the queries' ids and cutoffs."""
    dim = batch.column("dim")[row].as_py()
    ids = np.frombuffer(batch.column("ids")[row].as_py(), np.int64)
    v = np.frombuffer(batch.column("vecs")[row].as_py(), np.float64).reshape(len(ids), dim)
    order = np.argsort(ids, kind="stable")
    asked = batch.column("asked")[row].as_py()
    q = np.floor(256.0 * np.array([a["vec"] for a in asked], np.float64).reshape(len(asked), dim))
    return ids[order], _partial(q, v[order]), np.array([a["query_id"] for a in asked], np.int64), [a["cutoff"] for a in asked]


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k rows of highest score; rows are in order of id, so ties go to the smaller one."""
    if len(rows) > k and scores.dtype != object:
        rows = rows[scores[rows] >= np.partition(scores[rows], len(rows) - k)[len(rows) - k]]
    return np.array(sorted(rows, key=lambda j: (-scores[j], j))[:k], np.int64)


def _gather(pairs: DataFrame, k: int, depth: int) -> DataFrame:
    """Phase 1: query_id, shard, found (vec_id and score of the k best rows gathered), reach (above all other rows of the shard; null if there are none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lists, q_id, _ = _unpacked(batch, row)
                n = min(max(depth, k + 1), len(ids))  # one more than k, as the query's own row may be among them
                low = [np.partition(x, len(ids) - n, axis=1)[:, len(ids) - n] if x.dtype != object else np.sort(x, axis=1)[:, len(ids) - n] for x in lists]
                seen = np.any([x >= y[:, None] for x, y in zip(lists, low, strict=True)], axis=0)
                found, reach = [], []
                for i, own in enumerate(q_id):
                    rows = np.flatnonzero(seen[i])
                    reach.append(None if len(rows) == len(ids) else _long(sum(y[i] for y in low)))
                    score = sum(x[i] for x in lists)
                    found.append([{"vec_id": int(ids[j]), "score": _long(score[j])} for j in _best(score, rows[ids[rows] != own], k)])
                cols = [pa.array(q_id), pa.array([batch.column("shard")[row].as_py()] * len(q_id), pa.int64()), pa.array(found, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))), pa.array(reach, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["query_id", "shard", "found", "reach"])

    return pairs.select("dim", "shard", "ids", "vecs", "asked").mapInArrow(run, "query_id long, shard long, found array<struct<vec_id:long,score:long>>, reach long")


def _resolve(pairs: DataFrame, k: int) -> DataFrame:
    """Phases 2 and 3 for the queries that are still open in a shard: query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lists, q_id, cutoffs = _unpacked(batch, row)
                found: list[tuple] = []
                for i, (own, cutoff) in enumerate(zip(q_id, cutoffs, strict=True)):
                    share = cutoff / PARTS
                    part = np.stack([x[i] for x in lists])
                    enough = part >= share
                    bound = np.where(enough, part, share).sum(axis=0)
                    rows = np.flatnonzero(enough.any(axis=0) & (bound >= cutoff - 1e-6 * abs(cutoff)) & (ids != own))
                    score = np.empty(len(ids), part.dtype)
                    score[rows] = part[:, rows].sum(axis=0)
                    found += [(int(own), int(ids[j]), _long(score[j])) for j in _best(score, rows[score[rows] >= cutoff], k)]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return pairs.select("dim", "shard", "ids", "vecs", "asked").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", depth: int = DEPTH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k rows of `vectors` of highest inner product.

    Components x count as floor(256 x). Rows that have the query's own id are no candidates; ties go to the smaller
    id. Vectors that are null or hold a null or non-finite component, and null ids, take no part; vectors of another
    length than the query's aren't compared. A query id that repeats is asked once, with its least vector; vectors
    that repeat an id are candidates of their own. Scores beyond a long are cut to its range.
    """
    rows = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("vec_id").isNotNull() & _sound(F.col("vec")))
    shards = cut(_shards(rows(vectors)), "shards")
    asked = cut(rows(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")), "queries")
    n_blocks = max(1, math.ceil(asked.count() / BLOCK))
    lanes = max(1, math.ceil(shards.count() / LANE))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block")
    ask = F.collect_list(F.struct("query_id", "vec", "cutoff")).alias("asked")
    # phase 1: every block meets every shard; Spark takes the copies of the blocks for small and would gather them on the driver, which grows with the square of the rows
    s = shards.withColumn("lane", F.pmod("shard", F.lit(lanes))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    b = asked.select("query_id", "vec", F.lit(None).cast("long").alias("cutoff"), F.size("vec").cast("long").alias("dim"), block).groupBy("dim", "block").agg(ask)
    lists = cut(_gather(s.join(b.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).hint("merge"), ["dim", "block", "lane"]), k, depth), "lists")
    gathered = lists.select("query_id", "shard", F.explode("found").alias("x")).select("query_id", "shard", "x.*")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = cut(gathered.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff")), "cutoffs")
    # phases 2 and 3 for the shards that may hold more; where rows are left, k were gathered, so that there is a cutoff
    still = cut(open_pairs(lists, cutoffs), "open").hint("merge")  # up to all pairs
    again = still.join(asked, "query_id").groupBy("shard", block).agg(ask).join(shards.hint("merge"), "shard")
    # of an open shard all rows of at least the cutoff come back, those that it gathered among them
    both = gathered.join(still, ["query_id", "shard"], "left_anti").select("query_id", "vec_id", "score").unionByName(_resolve(again, k))
    return both.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def open_pairs(lists: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """query_id, shard, cutoff: where a row that wasn't gathered may still reach the cutoff."""
    return lists.join(cutoffs, "query_id").filter(F.col("reach") > F.col("cutoff")).select("query_id", "shard", "cutoff")
