"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: shingles are placed by the first on a circle of 2^32, and coordinate k
is the least value that the second gives to the places shifted by k. Bands of coordinates are bucket keys.

Documents with equal shingle sets are one class and are searched once. The hub of a bucket is its member that meets
most others in all its buckets: in a group of copies, the text that they were made from. A class is compared with its
best hub first, then with the hubs of all its buckets that still hold more than one component. At last, in buckets
that still do, all members outside of the bucket's largest component are compared with the members of other
components, block by block. So every pair that shares a bucket and isn't joined is decided on its full shingle sets
and no pair is left out by a cap, while a group of thousands of copies costs about as many comparisons as it has
members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, cut
from .components import components
from .tokens import chunks, mix, words

#: Bands and coordinates in each: a pair at a similarity of 0.8 shares no bucket with a chance of 3 in a million.
BANDS, ROWS = 32, 5
#: Members that one task compares with a document at most, before another task shares the work.
PER_TASK = 256
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(w: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of runs of `size` words; of the whole sequence, if it is shorter; none without words."""
    n = min(size, len(w))
    if not n:
        return np.zeros(0, np.uint64)
    odd = _ODD[:n] if n <= len(_ODD) else mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h += w[k : len(w) - n + 1 + k] * odd[k]
    return np.unique(mix(h))


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """bands x rows coordinates of a non-empty set."""
    place = _mix32((s ^ (s >> np.uint64(32))).astype(np.uint32))
    shifts = np.arange(bands * rows, dtype=np.uint32)
    out = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    step = 1 << 14  # keep what is worked on in the cache
    for lo in range(0, len(place), step):
        part = place[lo : lo + step]
        many = max(1, (1 << 15) // len(part))
        for k in range(0, len(shifts), many):
            least = _mix32(part[None, :] + shifts[k : k + many, None]).min(axis=1)
            np.minimum(out[k : k + many], least, out=out[k : k + many])
    return out.reshape(bands, rows)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    h = mix(np.arange(1, len(sig) + 1, dtype=np.uint64))
    for k in range(sig.shape[1]):
        h = mix(h + sig[:, k].astype(np.uint64) + np.uint64(1))
    return h.astype(np.int64)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each row of docs: doc_id, n (distinct shingles), s1, s2 (128 bits that stand for the set), bands."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = src.select("doc_id").schema.add("n", "long").add("s1", "long").add("s2", "long").add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1)):
                w, first = words(data, at)
                n, s1, s2, keys = [], [], [], []
                for i in range(hi - lo):
                    s = shingles(w[first[i] : first[i + 1]], size)
                    n.append(len(s))
                    s1.append(mix(s).sum(dtype=np.uint64))
                    s2.append(mix(s ^ _ODD[0]).sum(dtype=np.uint64))
                    keys.append(_band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                both = [pa.array(np.array(x, np.uint64).astype(np.int64)) for x in (s1, s2)]
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *both, bands], names=schema.names)

    return src.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """hub, doc, both, linked of the pairs (hub, doc): the size of their intersection, and whether 100 * it >= percent * union.

    A hub's documents are dealt to tasks by PER_TASK.
    """
    many = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("parts"))
    dealt = pairs.join(many, "hub").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    hubs = many.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<long>")).alias("part"))
    need = dealt.select(F.col("doc").alias("need"), "hub", "part", F.lit(1).alias("role")).union(hubs.select("hub", "hub", "part", F.lit(0)))
    rows = texts.join(need.hint("shuffle_hash"), F.col("doc_id") == F.col("need")).select("hub", "part", "role", "doc_id", "text")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            hub, part, role, doc = (batch.column(k).to_pylist() for k in range(4))
            linked: list[tuple] = []
            for lo, hi, data, at in chunks(batch.column(4)):
                w, first = words(data, at)
                for i in range(lo, hi):
                    s = shingles(w[first[i - lo] : first[i - lo + 1]], size)
                    if (hub[i], part[i]) != now:
                        now, sets = (hub[i], part[i]), []
                    if role[i] == 0:
                        sets.append(s)
                        continue
                    for t in sets:
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        linked.append((hub[i], doc[i], both, 100 * both >= percent * (len(s) + len(t) - both) > 0))
            ints = [pa.array([x[k] for x in linked], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*ints, pa.array([x[3] for x in linked], pa.bool_())], names=["hub", "doc", "both", "linked"])

    # more than one row of a pair: versions of a document
    return rows.mapInArrow(run, "hub long, doc long, both long, linked boolean").groupBy("hub", "doc").agg(F.max("both").alias("both"), F.bool_or("linked").alias("linked"))


def confirmed_in_blocks(seen: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Linked pairs (hub, doc) of different components of a bucket, one of them outside of the bucket's largest component.

    seen: bucket, doc, comp. Both sides of a bucket are dealt into blocks of about PER_TASK documents, and each pair of
    blocks is compared where its texts meet: no pair is a row before it is found linked, and none is compared whose
    components have met in the block.
    """
    sized = seen.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    major = sized.groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"))
    parts = lambda n: F.ceil(n / PER_TASK).cast("int")
    major = cut(major.select("bucket", F.col("top.comp").alias("major"), parts(F.col("all") - F.col("top.m")).alias("a_parts"), parts(F.col("all")).alias("m_parts")), "major")
    rows = seen.join(major, "bucket").withColumn("astray", F.col("comp") != F.col("major"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    left = rows.filter("astray").select("bucket", "doc", "comp", "astray", F.lit(0).alias("role"), own("a_parts").alias("a"), spread("m_parts").alias("b"))
    right = rows.select("bucket", "doc", "comp", "astray", F.lit(1).alias("role"), spread("a_parts").alias("a"), own("m_parts").alias("b"))
    need = left.unionByName(right).withColumnRenamed("doc", "need")
    met = texts.join(need.hint("shuffle_hash"), F.col("doc_id") == F.col("need")).select("bucket", "a", "b", "role", "doc_id", "comp", "astray", "text")
    met = met.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "role", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, firsts, up = None, [], {}

        def root(c: int) -> int:
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        for batch in batches:
            bucket, a, b, role, doc, comp, astray = (batch.column(k).to_pylist() for k in range(7))
            linked: list[tuple] = []
            for lo, hi, data, at in chunks(batch.column(7)):
                w, first = words(data, at)
                for i in range(lo, hi):
                    s = shingles(w[first[i - lo] : first[i - lo + 1]], size)
                    if (bucket[i], a[i], b[i]) != now:
                        now, firsts, up = (bucket[i], a[i], b[i]), [], {}
                    if role[i] == 0:
                        firsts.append((doc[i], comp[i], s))
                        continue
                    for other, c, t in firsts:
                        # of two that are both astray, the smaller one is the first
                        if root(c) == root(comp[i]) or astray[i] and other >= doc[i] or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                            continue
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if 100 * both >= percent * (len(s) + len(t) - both) > 0:
                            linked.append((other, doc[i]))
                            up[root(c)] = root(comp[i])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in range(2)], names=["hub", "doc"])

    return met.mapInArrow(run, "hub long, doc long").distinct()


def _with_components(lsh: DataFrame, links: DataFrame) -> DataFrame:
    """bucket, doc, hub, comp of the buckets that hold more than one component."""
    comp = components(links.select(F.col("hub").alias("a"), F.col("doc").alias("b")))
    seen = lsh.join(comp, F.col("doc") == F.col("node"), "left").select("bucket", "doc", "hub", F.coalesce("comp", "doc").alias("comp"))
    mixed = seen.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("bucket")
    return cut(seen.join(mixed, "bucket", "left_semi"), "open")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    A set: distinct runs of `size` words (A-Z lower-cased; white space parts words); the whole sequence where there
    are fewer words. Texts that are null or without words have an empty set and are linked with nothing. Linked:
    100 * intersection >= percent * union. component_id: the smallest doc_id reachable over links. Rows that repeat
    a doc_id are versions of one document and therefore in one component. A null doc_id takes no part: it has no
    component and is kept. Ids are longs.
    """
    sk = cut(sketches(docs, size, id_col, text_col), "sketches")
    texts, texts_name = bucketed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL"), "doc_id", "near_dedup")
    real = sk.filter("n > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    members = cut(real.select("doc_id", "s1", "s2").join(classes, ["s1", "s2"]).select("doc_id", "rep").distinct(), "members")
    reps = real.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    lsh = reps.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("bucket")).distinct()
    full = lsh.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    lsh = cut(lsh.join(full, "bucket"), "buckets")
    met = lsh.groupBy("doc").agg(F.sum("m").alias("met"))
    hubs = lsh.join(met, "doc").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("doc")).alias("less"))).alias("top")).select("bucket", (-F.col("top.less")).alias("hub"), F.col("top.met").alias("met"))
    lsh = cut(lsh.select("bucket", "doc").join(hubs, "bucket"), "hubs")
    check = lambda pairs: cut(confirmed(pairs, texts, size, percent), "links")
    # first: each document and the hub of most of its buckets
    best = lsh.filter("doc <> hub").groupBy("doc", "hub").agg(F.count("*").alias("m"), F.max("met").alias("met"))
    best = cut(best.groupBy("doc").agg(F.max(F.struct("m", "met", "hub")).alias("top")).select("doc", "top.hub"), "pairs")
    tested = check(best)
    of = lambda t: t.filter("linked").select("hub", "doc")
    # then: all hubs of buckets that hold several components
    seen = _with_components(lsh, of(tested))
    of_hub = seen.filter("doc = hub").select("bucket", F.col("comp").alias("h_comp"))
    pairs = seen.join(of_hub, "bucket").filter("comp <> h_comp").select("doc", "hub").distinct().join(best, ["doc", "hub"], "left_anti")
    links = cut(of(tested).union(of(check(pairs))), "links")
    # at last: who is outside of a bucket's largest component, and the members of others
    seen = _with_components(lsh, links)
    same = members.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    more = confirmed_in_blocks(seen.select("bucket", "doc", "comp"), texts, size, percent)
    edges = links.union(more).select(F.col("hub").alias("a"), F.col("doc").alias("b")).union(same)
    final = components(edges).select(F.col("node").alias("c_id"), "comp")  # written, so that the texts aren't needed any more
    docs.sparkSession.sql(f"DROP TABLE {texts_name}")
    out = sk.join(final, F.col("doc_id") == F.col("c_id"), "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept; columns stay as they are.

    A row goes if its component has a smaller doc_id, so rows that repeat the kept doc_id all stay, as do rows without a
    doc_id and texts that are null or without words.
    """
    gone = near_duplicates(docs, id_col, text_col, size, percent).filter("NOT kept").select(F.col("doc_id").alias("__n_id"))
    return docs.join(gone, docs[id_col] == gone["__n_id"], "left_anti")
