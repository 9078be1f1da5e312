"""Hard negatives by Four-Russians scoring.

Rows are packed once: integer components in two's complement, a byte for each bit-plane and group of eight dimensions. An
anchor has for each group a table of its 256 subset sums, so that a byte's part of a score is one lookup; the planes' sums are
added up with a shift by one from the highest plane, whose weight is negative. That is the whole inner product, exactly.

Anchors come in rounds of a bounded size, which are broadcast; packed rows stay where they are and are read once for each of
a round's two passes. The first finds each anchor's positives among the rows of its own label, the second the negatives within the
positives' bands among the others. A task hands on one short list for each anchor and positive, whatever it has read, so a
label with most of the rows is spread over tasks like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Rows of a packed shard, bytes of an anchor block, anchors of a block and of a table, rows scored at once, blocks of a round.
SHARD, BLOCK_BYTES, BLOCK, TABLE, CHUNK, ROUND = 8192, 4 << 20, 1024, 128, 1024, 16
GROUP = 8
_LEAST, _MOST = -(2**63), 2**63 - 1


def usable(vec: Column) -> Column:
    """A vector that isn't null and whose components, times 256, are all finite numbers."""
    big = lambda x: F.abs(x.cast("double") * 256) == float("inf")
    return F.coalesce(vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | big(x)), F.lit(False))


def _integers(lists: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    """floor(256 x) of some rows of one length; Python's integers where 62 bits don't hold them."""
    at = np.array(lists.offsets, np.int64)
    flat = np.floor(256.0 * np.array(lists.values, np.float64)[(at[rows][:, None] + np.arange(dim)[None]).ravel()])
    if np.abs(flat).max(initial=0) < 2**62:
        return flat.astype(np.int64).reshape(len(rows), dim)
    return np.array([int(x) for x in flat], object).reshape(len(rows), dim)


def planes(v: np.ndarray) -> np.ndarray:
    """[planes, groups, rows] bytes: bit j of byte (k, g) of a row is bit k of its component 8 g + j in two's complement; the last plane is the sign."""
    most = max((max(int(x.max()), -int(x.min()) - 1) for x in (v,) if x.size), default=0)
    wide = np.zeros((len(v), -(-v.shape[1] // GROUP) * GROUP), v.dtype)
    wide[:, : v.shape[1]] = v
    bits = [np.packbits(((wide >> k) & 1).astype(np.uint8), axis=1, bitorder="little").T for k in range(most.bit_length() + 1)]
    return np.ascontiguousarray(np.stack(bits))


def tables(q: np.ndarray, dtype: type) -> np.ndarray:
    """[groups, 256, anchors]: the sums of an anchor's components over the subsets of each group of eight."""
    groups = -(-q.shape[1] // GROUP)
    wide = np.zeros((groups * GROUP, len(q)), dtype)
    wide[: q.shape[1]] = q.T
    t = np.zeros((groups, 1 << GROUP, len(q)), dtype)
    for j in range(GROUP):
        t[:, 1 << j : 2 << j] = t[:, : 1 << j] + wide[j::GROUP][:, None]
    return t


def scores(t: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """[rows, anchors]: inner products, by lookups of the planes' bytes and shifts."""
    n = codes.shape[2]
    total = np.zeros((n, t.shape[2]), t.dtype)
    part = np.empty_like(total)
    for k in reversed(range(len(codes))):
        total <<= 1
        for g in range(len(t)):
            np.take(t[g], codes[k, g], axis=0, out=part, mode="clip")
            total += part
        if k == len(codes) - 1:
            np.negative(total, out=total)
    return total


def kind_of(q: np.ndarray, n_planes: int) -> type:
    """The narrowest integers that hold every sum on the way."""
    most = int(np.abs(q).max(initial=0)) * max(1, q.shape[1]) << n_planes
    return np.int32 if most < 2**31 else np.int64 if most < 2**63 else object


def _long(s: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(x), _LEAST), _MOST) for x in s.ravel()], np.int64).reshape(s.shape) if s.dtype == object else s


def pack(rows: DataFrame) -> DataFrame:
    """dim, planes, ids, labels, codes: runs of up to SHARD rows (vec_id, label, vec) of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (np.array(batch.column(c), np.int64) for c in (0, 1))
            size = np.diff(np.array(batch.column(2).offsets, np.int64))
            out = []
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                for lo in range(0, len(own), SHARD):
                    some = own[lo : lo + SHARD]
                    codes = planes(_integers(batch.column(2), some, int(dim)))
                    out.append((int(dim), len(codes), ids[some].tobytes(), labels[some].tobytes(), codes.tobytes()))
            cols = [pa.array([x[k] for x in out], pa.int64() if k < 2 else pa.binary()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(cols, names=["dim", "planes", "ids", "labels", "codes"])

    return rows.select("vec_id", "label", "vec").mapInArrow(run, "dim long, planes long, ids binary, labels binary, codes binary")


def _blocks(anchors: DataFrame) -> DataFrame:
    """block, anchors: runs of up to BLOCK anchors and about BLOCK_BYTES of components, a row for each."""
    sized = cut(anchors.groupBy(F.col("vec_id").alias("id")).agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec", F.size("x.vec").alias("dim")), "anchors")
    n = sized.agg(F.count("*"), F.max("dim")).first()
    each = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, n[1] or 1))))
    by_id = sized.repartitionByRange(max(1, -(-n[0] // each)), "id").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    deal = by_id.withColumn("run", F.floor(place / each))
    return cut(deal.groupBy("part", "run").agg(F.collect_list(F.struct("id", "label", "vec")).alias("anchors")).withColumn("block", F.expr("uuid()")).select("block", "anchors"), "blocks")


def _tabled(anchors: list[Row]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors as runs of up to TABLE of one length, those of a label side by side: length, places in the list, labels, integers."""
    out = []
    for dim in sorted({len(a["vec"]) for a in anchors}):
        own = sorted((i for i, a in enumerate(anchors) if len(a["vec"]) == dim), key=lambda i: (anchors[i]["label"], i))
        for lo in range(0, len(own), TABLE):
            some = own[lo : lo + TABLE]
            vecs = pa.array([anchors[i]["vec"] for i in some], pa.list_(pa.float64()))
            out.append((dim, np.array(some), np.array([anchors[i]["label"] for i in some], np.int64), _integers(vecs, np.arange(len(some)), dim)))
    return out


class _Lists:
    """The `most` best (score, id) of each key: higher scores first, ties by smaller id."""

    def __init__(self, n: int, most: int):
        self.most, self.least = most, np.full(n, _LEAST, np.int64)
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.most
        full = place == self.most - 1
        self.least[key[full]] = score[full]  # rows below the last of a full list needn't be looked at
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]


def _unpacked(batch: pa.RecordBatch, row: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    dim, n_planes = (batch.column(c)[row].as_py() for c in ("dim", "planes"))
    ids, labels = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in ("ids", "labels"))
    return dim, ids, labels, np.frombuffer(batch.column("codes")[row].as_buffer(), np.uint8).reshape(n_planes, -(-dim // GROUP), len(ids))


def _emitted(lists: list[tuple[np.ndarray, _Lists]], ids: list[int], per: int) -> Iterator[pa.RecordBatch]:
    for places, x in lists:
        anchor = np.array(ids, np.int64)[places[x.key // per]]
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array((x.key % per).astype(np.int32) + 1), pa.array(x.score), pa.array(x.id)], names=["anchor_id", "place", "score", "vec_id"])


def _positives(shards: DataFrame, anchors: list[Row], most: int) -> DataFrame:
    """anchor_id, place (always 1), score, vec_id: of each task, the best other rows of the anchor's label."""
    sent = shards.sparkSession.sparkContext.broadcast(_tabled(anchors))
    names = [a["id"] for a in anchors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [(places, _Lists(len(places), most)) for _, places, *_ in sent.value]
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, labels, codes = _unpacked(batch, row)
                for (a_dim, places, a_labels, q), (_, best) in zip(sent.value, lists, strict=True):
                    for label in np.unique(a_labels) if a_dim == dim else ():
                        mine, rows = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
                        if not len(rows):
                            continue
                        t = tables(q[mine], kind_of(q, len(codes)))
                        own = np.array([names[i] for i in places[mine]], np.int64)
                        for lo in range(0, len(rows), CHUNK):
                            some = rows[lo : lo + CHUNK]
                            s = _long(scores(t, codes[:, :, some]))
                            r, a = np.nonzero((s >= best.least[mine]) & (ids[some][:, None] != own))
                            best.add(mine[a], s[r, a].astype(np.int64), ids[some][r])
        yield from _emitted(lists, names, 1)

    return shards.mapInArrow(run, "anchor_id long, place int, score long, vec_id long")


def _negatives(shards: DataFrame, anchors: list[Row], positives: dict[int, list[int]], per: int, most: int, low: int, high: int) -> DataFrame:
    """anchor_id, place (of the positive), score, vec_id: of each task, the best rows of other labels within the positive's band."""
    sent = shards.sparkSession.sparkContext.broadcast((_tabled(anchors), positives))
    names = [a["id"] for a in anchors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, found = sent.value
        lists = [(places, _Lists(len(places) * per, most)) for _, places, *_ in runs]
        bands = []
        for _, places, *_ in runs:
            band = np.zeros((2, len(places), per), np.int64)
            band[0] = 1  # without a positive: from 1 to 0
            for i, p in enumerate(places):
                for j, s in enumerate(found.get(names[p], ())):
                    band[:, i, j] = max(_LEAST, -(-low * s // 100)), min(_MOST, high * s // 100)
            bands.append(band)
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, labels, codes = _unpacked(batch, row)
                for (a_dim, places, a_labels, q), (_, best), (lo_s, hi_s) in zip(runs, lists, bands, strict=True):
                    if a_dim != dim:
                        continue
                    t = tables(q, kind_of(q, len(codes)))
                    for lo in range(0, len(ids), CHUNK):
                        s = _long(scores(t, codes[:, :, lo : lo + CHUNK]))
                        other = labels[lo : lo + CHUNK][:, None] != a_labels
                        least = np.maximum(best.least.reshape(len(places), per), lo_s)
                        for j in range(per):
                            r, a = np.nonzero((s >= least[:, j]) & (s <= hi_s[:, j]) & other)
                            best.add(a * per + j, s[r, a].astype(np.int64), ids[lo : lo + CHUNK][r])
        yield from _emitted(lists, names, per)

    return shards.mapInArrow(run, "anchor_id long, place int, score long, vec_id long")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, positive_rank.

    vectors and anchors: vec_id, label, vec (others are ignored). An anchor's positives are the `positives` rows of its label of highest
    inner product (components count as floor(256 x)); for each, the first `negatives` rows of other labels whose score is between `low`
    and `high` percent of the positive's. Ties go to the smaller id. Rows with a null id, label or vector, or a null or
    non-finite component, take no part. A row that has the anchor's id is no positive of it; an anchor id that repeats is asked
    once, with its least label and vector; other repeated rows count each for itself. Vectors of another length than the anchor's
    aren't compared. Scores beyond a long are cut to its range. An anchor without positives, and a positive without negatives, has no row.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vec").cast("array<double>")).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    shards = cut(pack(clean(vectors)), "shards")
    blocks = _blocks(clean(anchors))
    names = sorted(r["block"] for r in blocks.select("block").collect())  # one for each BLOCK anchors
    base = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
    if not names:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    for lo in range(0, len(names), ROUND):
        asked = [a for r in blocks.filter(F.col("block").isin(names[lo : lo + ROUND])).collect() for a in r["anchors"]]  # at most ROUND blocks
        p = _positives(shards, asked, positives).withColumn("place", F.row_number().over(best).cast("int")).filter(F.col("place") <= positives)
        p = cut(p.select("anchor_id", F.col("place").alias("positive_rank"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
        found: dict[int, list[int]] = {}
        for r in p.orderBy("anchor_id", "positive_rank").collect():  # `positives` for each anchor of the round
            found.setdefault(r["anchor_id"], []).append(r["positive_score"])
        n = _negatives(shards, asked, found, positives, negatives, low, high).withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= negatives)
        n = n.select("anchor_id", F.col("place").alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        n.join(p, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank").write.mode("append").parquet(base)
    return spark.read.schema(schema).parquet(base)
