"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over K bytes sets triggers: of the hashes in each string of LENGTH bytes, the least one (the leftmost of
equal ones). The strings with one trigger are consecutive starts; together they make a phrase, which reaches over
into the next one, as in prefix-free parsing. Since triggers depend on the LENGTH bytes alone, equal strings have
equal triggers at equal distances, so they are met by grouping phrases by trigger, and only there.

Parse: the occurrences of phrases whose trigger repeats. Dictionary: the distinct phrases, each with its earliest
occurrence. Every later occurrence of a phrase repeats whole. Of the dictionary's phrases with a common trigger, the
suffixes are ordered by prefix doubling (suffix arrays, as far as LENGTH bytes, which is all that matters here);
equal ones, combined with the places of the earliest occurrences from the parse, give the earliest in corpus order.
A trigger with very many different phrases is resolved by grouping hashes of the suffixes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, cut, whole
from .tokens import chunks, mix

#: Bytes under a trigger's hash; starts worked on at once; phrases of a trigger that one task sorts; bytes sorted at once.
K, SEGMENT, HOT, SORT = 24, 1 << 19, 4096, 1 << 21
_R = np.uint64(0x9E3779B97F4A7C15 | 1)


def rolling(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, put together from runs of half the length."""
    have, power, out, done = (b.astype(np.uint64) + np.uint64(1)), _R, None, 0
    size = 1
    while True:
        if k & size:
            if out is None:
                out, done = have, size
            else:
                n = min(len(out), len(have) - done)
                out = out[:n] * power + have[done : done + n]
                done += size
        size *= 2
        if size > k:
            return mix(out[: max(0, len(b) - k + 1)])
        have = have[: len(have) - size // 2] * power + have[size // 2 :] if len(have) > size // 2 else have[:0]
        power = np.uint64(int(power) ** 2 % 2**64)


def phrases(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, first start in it, number of starts, trigger's hash and the phrase's hash, for all phrases of the texts."""
    found: list[tuple[np.ndarray, ...]] = []
    width = length - K + 1
    total = len(data)
    for seg in range(0, max(0, total - length + 1), SEGMENT):
        n = min(SEGMENT, total - length + 1 - seg)
        part = data[seg : seg + n + length - 1]
        h = rolling(part, K)
        low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        spot = (low[:n] & np.uint64((1 << 20) - 1)).astype(np.int64)
        text = np.searchsorted(at, np.arange(seg, seg + n), "right") - 1
        ok = np.arange(seg, seg + n) + length <= at[text + 1]
        s = np.flatnonzero(ok)
        if not len(s):
            continue
        first = np.ones(len(s), bool)
        first[1:] = (spot[s[1:]] != spot[s[:-1]]) | (s[1:] != s[:-1] + 1)
        lo = np.flatnonzero(first)
        count = np.diff(np.append(lo, len(s)))
        start = s[lo]
        # the phrase's hash: a difference of prefix sums, brought to a common weight
        sums, inverse = _prefix_sums(part)
        phrase = mix((sums[start + count + length - 1] - sums[start]) * inverse[start])
        found.append((text[start], start + seg - at[text[start]], count, h[spot[start]], phrase))
    if not found:
        return tuple(np.zeros(0, np.uint64 if k > 2 else np.int64) for k in range(5))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(5))


def _prefix_sums(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(part) + 1
    power = np.full(n, _R, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(n, np.uint64(pow(int(_R), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.zeros(n, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return sums, inverse


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Order numbers of the suffixes of data, by their first `length` bytes; equal ones have equal numbers. Suffixes that are shorter have none (-1)."""
    n = len(data) - length + 1
    rank, size = data.astype(np.int64), 1
    while size * 2 <= length:
        both = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        rank = np.unique(both, return_inverse=True)[1]
        size *= 2
    if size < length:
        more = length - size
        both = rank[: len(rank) - more] * (int(rank.max()) + 1) + rank[more:]
        rank = np.unique(both, return_inverse=True)[1]
    out = np.full(len(data), -1)
    out[:n] = rank[:n]
    return out


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """trigger, phrase (hashes), doc_id, tag, start, n: all phrases of docs (doc_id, tag, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(2)):
                text, start, n, trigger, phrase = phrases(data, at, length)
                of = pa.array(text + lo)
                longs = [pa.array(x.view(np.int64)) for x in (trigger, phrase)]
                yield pa.RecordBatch.from_arrays([*longs, batch.column(0).take(of), batch.column(1).take(of), pa.array(start, pa.int64()), pa.array(n.astype(np.int32), pa.int32())], names=["trigger", "phrase", "doc_id", "tag", "start", "n"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, f"trigger long, phrase long, doc_id {id_type}, tag long, start long, n int")


def _same(a: Column, b: Column) -> Column:
    """a = b, but no join key: documents are bucketed by doc_id alone."""
    return a.bitwiseXOR(b) == 0


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """trigger, doc_id, tag, start, content of the wanted phrases (trigger, doc_id, tag, start, n), read from their documents."""
    per = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("tag").alias("w_tag")).agg(F.collect_list(F.struct("trigger", "start", "n")).alias("want"))
    raw = F.col("text").cast("binary")
    rows = docs.join(per, (docs.doc_id == per.w_id) & _same(docs.tag, per.w_tag)).select("doc_id", "tag", raw.alias("raw"), F.explode("want").alias("w"))
    return rows.select("w.trigger", "doc_id", "tag", "w.start", F.expr(f"substring(raw, int(w.start + 1), w.n + {length - 1})").alias("content")).distinct()


def _sorted_repeats(contents: DataFrame, length: int) -> DataFrame:
    """doc_id, tag, lo, hi: bytes of the dictionary's phrases that repeat earlier ones. Rows of a trigger meet in one task, at most HOT of them."""
    id_type = contents.schema["doc_id"].dataType.simpleString()
    rows = contents.repartition("trigger").sortWithinPartitions("trigger", "doc_id", "tag", "start")
    schema = f"doc_id {id_type}, tag long, lo long, hi long"

    def solve(held: pa.Table) -> pa.RecordBatch:
        content = held.column("content").combine_chunks().cast(pa.large_binary())
        _, offsets, data = content.buffers()
        at = np.frombuffer(offsets, np.int64)[content.offset : content.offset + len(content) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        start, trigger = np.array(held.column("start"), np.int64), np.array(held.column("trigger"), np.int64)
        rank = suffix_ranks(raw, length)
        n = np.diff(at) - length + 1
        row = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        group = np.unique(trigger[row], return_inverse=True)[1] * (int(rank.max()) + 1) + rank[at[row] + off]
        # the rows come in corpus order: of equal suffixes of a trigger the first one stays
        first = np.unique(group, return_index=True)[1]
        gone = np.ones(len(row), bool)
        gone[first] = False
        g = np.flatnonzero(gone)
        lo = start[row[g]] + off[g]
        new = np.ones(len(g), bool)
        new[1:] = (row[g[1:]] != row[g[:-1]]) | (lo[1:] != lo[:-1] + 1)
        i = np.flatnonzero(new)
        end = np.append(i[1:], len(g)) - 1
        of = pa.array(row[g[i]])
        ids = [held.column(c).combine_chunks().take(of) for c in ("doc_id", "tag")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(lo[i]), pa.array(lo[end] + length)], names=["doc_id", "tag", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.nbytes > SORT and held.num_rows > 1:
                t = np.array(held.column("trigger"), np.int64)
                end = int(np.flatnonzero(t != t[-1])[-1]) + 1 if t[0] != t[-1] else 0
                if end:
                    yield solve(held.slice(0, end))
                    held = held.slice(end)
        if held is not None and held.num_rows:
            yield solve(held)

    return rows.mapInArrow(run, schema)


def _hashed_repeats(contents: DataFrame, length: int) -> DataFrame:
    """As _sorted_repeats, for triggers with any number of phrases: hashes of the suffixes, earliest by partial minima."""
    b = contents.select("trigger", "doc_id", "tag", "start", "content", F.explode(F.sequence(F.lit(0), F.octet_length("content") - length)).alias("off"))
    suffix = F.expr(f"substring(content, off + 1, {length})")
    b = b.select("trigger", F.xxhash64(suffix).alias("a"), F.xxhash64(F.lit("salt"), suffix).alias("b"), F.struct("doc_id", "tag", (F.col("start") + F.col("off")).alias("lo")).alias("me"))
    first = b.groupBy("trigger", "a", "b").agg(F.min("me").alias("first"))
    gone = b.join(first, ["trigger", "a", "b"]).filter(F.col("me") != F.col("first"))
    return gone.select("me.doc_id", "me.tag", "me.lo", (F.col("me.lo") + length).alias("hi"))


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, tag, lo, hi: byte ranges of docs (doc_id, tag, text) that are to go; they may overlap."""
    occ = _occurrences(docs, length)
    # written before they are joined: both sides are then plain exchanges, of which Spark splits a hot trigger's partition
    again = cut(occ.groupBy("trigger").agg(F.count("*").alias("c")).filter("c > 1").select("trigger"), "triggers")
    parse = cut(occ.join(again, "trigger", "left_semi"), "parse")
    me = F.struct("doc_id", "tag", "start")
    entries = cut(parse.groupBy("trigger", "phrase").agg(F.min(me).alias("first"), F.max("n").alias("n")), "dictionary")
    later = parse.join(entries.select("trigger", "phrase", "first"), ["trigger", "phrase"]).filter(me != F.col("first"))
    later = later.select("doc_id", "tag", F.col("start").alias("lo"), (F.col("start") + F.col("n") + length - 1).alias("hi"))
    many = cut(entries.groupBy("trigger").agg(F.count("*").alias("m")).filter("m > 1"), "many")
    wanted = entries.join(many, "trigger").select("trigger", "first.doc_id", "first.tag", "first.start", "n", "m")
    contents = cut(_contents(docs, wanted.select("trigger", "doc_id", "tag", "start", "n"), length), "contents")
    hot = cut(many.filter(F.col("m") > HOT).select("trigger"), "hot")
    out = later.union(_sorted_repeats(contents.join(hot, "trigger", "left_anti"), length))
    return out.union(_hashed_repeats(contents.join(hot, "trigger", "left_semi"), length)) if hot.head(1) else out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Each byte of a text (UTF-8; null is empty) that lies in a string of `length` bytes which also starts earlier goes:
    in a document of a smaller doc_id, or earlier in the same one. Strings are judged on the input and don't cross
    documents. Rows that repeat a doc_id with another text are ordered by the text's hash; rows that are equal in both
    are one document, and none of them is earlier. Rows without a doc_id take no part and stay whole.
    """
    if length < K + 8:
        raise ValueError(f"length is {K + 8} at least")
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(text_col)).alias("tag"), whole(text_col).alias("text"))
    # bucketed by doc_id: the two joins with documents below then move no text
    src, _ = bucketed(src, "doc_id", "suffix_dedup")
    ranges = repeats(src.filter("doc_id IS NOT NULL"), length).groupBy(F.col("doc_id").alias("r_id"), F.col("tag").alias("r_tag")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    both = src.join(ranges, (src.doc_id == ranges.r_id) & _same(src.tag, ranges.r_tag), "left").select("doc_id", "text", F.col("ranges.lo").alias("lo"), F.col("ranges.hi").alias("hi"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = batch.column(2), batch.column(3)
            for lo, hi, data, at in chunks(batch.column(1)):
                n, spans, kept = [], [], []
                for i in range(lo, hi):
                    b = data[at[i - lo] : at[i - lo + 1]]
                    if not lows[i].is_valid:
                        n.append(0), spans.append(0), kept.append(b.tobytes())
                        continue
                    depth = np.zeros(len(b) + 1, np.int64)
                    np.add.at(depth, np.array(lows[i].values, np.int64), 1)
                    np.add.at(depth, np.array(highs[i].values, np.int64), -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    n.append(int(gone.sum()))
                    spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                    kept.append(b[~gone].tobytes())
                ints = [pa.array(x, pa.int64()) for x in (np.diff(at), n, spans)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *ints, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, schema)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
