"""A hierarchical Pitman-Yor language model over words, and perplexity scores.

Restaurants: one for each word that stands before another one (END stands before the first), whose dishes are the words
that follow it. They share one parent over all words, whose base is uniform over the words and one unknown word. No word
is merged with another, and every pair (context, word) keeps its own tables.

Seating is sampled by blocked Gibbs steps. A restaurant of T tables gets an auxiliary Gamma(theta / d + T) variable z; given all z and
the parent's probabilities p of words, drawn as well, the numbers of tables of its dishes are independent, each in proportion to
S(c, t) (d z p) ** t, where c are the dish's customers and S are generalised Stirling numbers. So a hot context is parted over tasks like any
other pairs. The parent gets a customer for each table. It is a process of independent masses of words, normalised: given its own auxiliary
variable z0, its tables are drawn in the same way, and then a word's mass is Gamma(c - d0 t) for what its tables hold, and a tilted stable variable
of exponent z0 b for the rest, b the base's probability. Up to ROW customers tables are drawn from their distribution itself; beyond, by
Metropolis steps, whose proposals are exact draws of a Pitman-Yor process of the matching strength. Scores don't use the drawn masses,
but the predictive probabilities of the seatings, averaged over the sweeps after the first ones.

Where things are: texts become chunks (a dictionary of word hashes, tokens by their place in it). Words are parted by
hash; a part numbers its words by frequency, and number and part make a word's id. Pairs are parted into blocks by the
hash of both ids. In each sweep blocks tell parts the tables of their words, and parts answer with what they sum up to.
Rows that travel hold packed arrays, a row for each sender and receiver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, cut, drop, free, shared_dir
from .tokens import _R, END, chunks, mix, words

#: Tokens of a chunk, unless one text has more; words of a part and tokens of a block, on average (they set how many there are).
CHUNK, PART, BLOCK = 1 << 20, 1 << 17, 3 << 19
#: Customers of a dish up to which tables are drawn from the whole distribution; Metropolis steps of larger ones in a sweep; sweeps in all and dropped ones.
ROW, STEPS, SWEEPS, BURN_IN = 256, 3, 4, 2
THETA = 1.0
#: Rows between chunks, parts and blocks: kind, receiver, sender, arrays.
PACKED = "kind string, at long, sender long, a binary, b binary, c binary, d binary, n1 double, n2 double"
_NAMES = ["kind", "at", "sender", "a", "b", "c", "d", "n1", "n2"]


def training(id_col: str = "doc_id") -> Column:
    """Rows that the model learns from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 1, F.lit(True))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, each text closed by END, and where each text starts."""
    w, first = words(data, at)
    n = len(first) - 1
    out = np.full(len(w) + n, END, np.uint64)
    out[np.arange(len(w)) + np.repeat(np.arange(n), np.diff(first))] = w
    return out, first + np.arange(n + 1)


# Arrays in rows


def pack(x: np.ndarray) -> bytes:
    """An array as bytes: integers in the shortest type that holds them, compressed."""
    if x.dtype.kind in "iu" and len(x) and x.dtype != np.uint64:
        x = x.astype(np.result_type(np.min_scalar_type(x.min()), np.min_scalar_type(x.max())))
    head = f"{x.dtype.str}:{x.nbytes}:".encode()
    return head + (pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if x.nbytes else b"")


def unpack(raw: bytes | None) -> np.ndarray:
    if raw is None:
        return np.zeros(0, np.int64)
    kind, size, data = raw.split(b":", 2)
    x = np.frombuffer(pa.decompress(data, decompressed_size=int(size), codec="zstd", asbytes=True) if int(size) else b"", np.dtype(kind.decode()))
    return x.astype(np.int64) if x.dtype.kind in "iu" and x.dtype != np.uint64 else x


def row(kind: str, at: int, sender: int = 0, a=None, b=None, c=None, d=None, n1: float = 0.0, n2: float = 0.0) -> tuple:
    return (kind, int(at), int(sender), *(None if x is None else pack(x) for x in (a, b, c, d)), float(n1), float(n2))


def batch_of(rows: list[tuple]) -> pa.Table:
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.float64(), pa.float64()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_NAMES)


class Group:
    """The rows that one receiver got."""

    def __init__(self, table: pa.Table):
        self.rows = table.select(_NAMES).to_pylist()
        self.at = self.rows[0]["at"]

    def of(self, kind: str) -> list[dict]:
        return sorted((r for r in self.rows if r["kind"] == kind), key=lambda r: r["sender"])

    def one(self, kind: str) -> dict | None:
        return next((r for r in self.rows if r["kind"] == kind), None)


def met(rows: DataFrame, f: Callable[[Group], list[tuple]], receivers: int) -> DataFrame:
    """What f makes of the rows of each receiver."""
    def run(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what the group before needed
        return batch_of(f(Group(table)))

    return rows.repartition(receivers, "at").groupBy("at").applyInArrow(run, PACKED)


class Kept:
    """Rows written to the shared folder, in a folder for each kind; drop() frees them once they aren't needed."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
        df.write.partitionBy("kind").parquet(self.path)
        names = [n.strip().split(" ") for n in PACKED.split(",")]
        self.schema = ", ".join(" ".join(n) for n in [*names[1:], names[0]])

    def of(self, *kinds: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("kind").isin(*kinds)).select(*_NAMES)

    def drop(self, *kinds: str) -> None:
        """Without kinds, all of them."""
        for path in [f"{self.path}/kind={k}" for k in kinds] or [self.path]:
            drop(self.spark, path)


# Sampling


def stirling(d: float, most: int) -> np.ndarray:
    """log of the generalised Stirling numbers: row c, column t - 1, for up to `most` customers at t tables of a dish."""
    out = np.full((most + 1, most), -np.inf)
    out[1, 0] = 0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        out[c + 1, :c] = out[c, :c] + np.log(c - t * d)
        out[c + 1, 1 : c + 1] = np.logaddexp(out[c + 1, 1 : c + 1], out[c, :c])
    return out


def _pick(logw: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column for each row, in proportion to exp(logw)."""
    w = np.exp(logw - logw.max(axis=1, keepdims=True)).cumsum(axis=1)
    return np.minimum((w < (rng.random(len(w)) * w[:, -1])[:, None]).sum(axis=1), w.shape[1] - 1)


def process_tables(c: np.ndarray, strength: np.ndarray, d: float, logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of c customers in a Pitman-Yor process, drawn exactly: ROW customers are seated, a Beta variable tells how many
    of the others sit elsewhere, and those make a process of their own whose strength grew by d for each table."""
    c, strength, t = c.copy(), strength.astype(np.float64).copy(), np.zeros(len(c), np.int64)
    while (act := np.flatnonzero(c > 0)).size:
        m = np.minimum(c[act], ROW)
        k = np.zeros(len(act), np.int64)
        for size in np.unique(m):
            at = np.flatnonzero(m == size)
            grow = np.log(strength[act[at]][:, None] + d * np.arange(1, size)).cumsum(axis=1)
            k[at] = 1 + _pick(logs[size, :size] + np.concatenate([np.zeros((len(at), 1)), grow], axis=1), rng)
        t[act] += k
        strength[act] += d * k
        away = rng.beta(np.maximum(strength[act], 1e-12), m - d * k)
        c[act] = rng.binomial(c[act] - m, away)
    return t


def matching_strength(c: int, a: float, d: float) -> float:
    """The strength whose process of c customers has strength + d * (expected tables) = a."""
    lo, hi = -d * (1 - 1e-9), max(a, 1.0)
    for _ in range(50):
        x = (lo + hi) / 2
        f = lgamma(x + 1) + lgamma(x + d + c) - lgamma(x + d) - lgamma(x + c)
        lo, hi = (x, hi) if f < log(a) else (lo, x)
    return (lo + hi) / 2


def draw(c: np.ndarray, a: np.ndarray, d: float, logs: np.ndarray, rng: np.random.Generator, before: np.ndarray | None = None) -> np.ndarray:
    """Tables of dishes with c customers, in proportion to S(c, t) a ** t; before: what they were, the state of the Metropolis steps."""
    t = np.minimum(c, 1)
    order = np.argsort(c, kind="stable")
    sizes, first = np.unique(c[order], return_index=True)
    for k, lo, hi in zip(sizes, first, np.append(first, len(c))[1:], strict=True):
        if 1 < k <= ROW:
            for at in np.array_split(order[lo:hi], max(1, (hi - lo) * int(k) >> 19)):
                t[at] = 1 + _pick(logs[k, :k] + np.log(a[at])[:, None] * np.arange(1, k + 1), rng)
    big = np.flatnonzero(c > ROW)
    if len(big):
        s = np.array([matching_strength(int(n), float(x), d) for n, x in zip(c[big], a[big], strict=True)])
        # a proposal is taken or not by how its weight compares with that of the state; without a state, the first one is it
        weight = lambda t: t * np.log(a[big]) - (t - 1) * log(d) - np.array([lgamma(x / d + n) - lgamma(x / d + 1) for x, n in zip(s, t, strict=True)])
        now = process_tables(c[big], s, d, logs, rng) if before is None else before[big]
        w_now = weight(now)
        for _ in range(STEPS):
            new = process_tables(c[big], s, d, logs, rng)
            w_new = weight(new)
            yes = np.log(rng.random(len(big))) < w_new - w_now
            now, w_now = np.where(yes, new, now), np.where(yes, w_new, w_now)
        t[big] = now
    return t


def keys_of(ids: np.ndarray, seed: int) -> np.ndarray:
    """What the variables of ids are drawn from: whoever draws for an id, a part or a block, draws the same."""
    return mix(mix(ids.astype(np.uint64)) + np.uint64(seed))


def uniform(keys: np.ndarray, k: int) -> np.ndarray:
    """The k-th uniform variable of each key."""
    return ((mix(keys + np.uint64(k * int(_R) & (1 << 64) - 1)) >> np.uint64(11)) + 0.5) / 2.0**53


def gamma(shape: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Gamma variables of the keys, by rejection from the cube of a normal one; shapes below 1 from those above."""
    shape = shape.astype(np.float64)
    low = shape < 1
    top = shape + low - 1 / 3
    out, left, k = np.zeros(len(shape)), np.arange(len(shape)), 1
    while len(left):
        x = np.sqrt(-2 * np.log(uniform(keys[left], k))) * np.cos(2 * np.pi * uniform(keys[left], k + 1))
        m = top[left]
        v = np.maximum(1 + x / np.sqrt(9 * m), 1e-300) ** 3
        with np.errstate(divide="ignore"):
            yes = (v > 0) & (np.log(uniform(keys[left], k + 2)) < x * x / 2 + m * (1 - v + np.log(v)))
        out[left[yes]] = (m * v)[yes]
        left, k = left[~yes], k + 3
    out[low] *= uniform(keys[low], 0) ** (1 / shape[low])
    return out


def tilted_stable(a: np.ndarray, d: float, keys: np.ndarray) -> np.ndarray:
    """Variables with E exp(-x s) = exp(-a ((1 + x) ** d - 1)): sums of stable variables of exponents up to 1, each kept with the chance exp(-s)."""
    pieces = np.maximum(1, np.ceil(a)).astype(np.int64)
    place = np.repeat(np.arange(len(a)), pieces)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    keys = mix(keys[place] + mix(nth.astype(np.uint64) + np.uint64(1)))
    scale, out, k = (a / pieces) ** (1 / d), np.zeros(len(a)), 0
    while len(place):
        u, e = np.pi * uniform(keys, k), -np.log(uniform(keys, k + 1))
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            s = scale[place] * np.sin(d * u) / np.sin(u) ** (1 / d) * (np.sin((1 - d) * u) / e) ** ((1 - d) / d)
        yes = uniform(keys, k + 2) < np.exp(-np.nan_to_num(s, nan=np.inf))
        out += np.bincount(place[yes], weights=s[yes], minlength=len(a))
        place, keys, k = place[~yes], keys[~yes], k + 3
    return out


def masses(cw: np.ndarray, tw: np.ndarray, a: np.ndarray, d0: float, keys: np.ndarray) -> np.ndarray:
    """The parent's masses of words with cw customers at tw tables; a: z0 b."""
    return gamma(cw - d0 * tw, keys) + tilted_stable(a, d0, keys)


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(1.0, ones + 2 * twos), 0.1, 0.95))


# Chunks, parts and blocks


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts: chunk, ids, held, lens (tokens of each text), dictionary (sorted hashes), own (how often training has each), spot (place by frequency), toks."""
    src = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), (~training(id_col)).alias("held"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        toks: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        held: list[np.ndarray] = []
        ids: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            nonlocal made
            t, n, h = np.concatenate(toks), np.concatenate(lens), np.concatenate(held)
            keys, place, count = np.unique(t, return_inverse=True, return_counts=True)
            spot = np.empty(len(keys), np.int64)
            spot[np.argsort(-count, kind="stable")] = np.arange(len(keys))
            own = np.bincount(place[np.repeat(~h, n)], minlength=len(keys))
            of = pa.concat_arrays(ids)
            cols = [pa.array([(part << 32) + made], pa.int64()), pa.ListArray.from_arrays([0, len(of)], of), *(pa.array([pack(x)], pa.binary()) for x in (h.astype(np.int64), n, keys, own, spot, spot[place])), pa.array([len(t)], pa.int64()), pa.array([len(keys)], pa.int64())]
            made += 1
            for x in (toks, lens, held, ids):
                x.clear()
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "held", "lens", "dictionary", "own", "spot", "toks", "n", "v"])

        for batch in batches:
            flags = np.array(batch.column(2), bool)
            for lo, hi, data, at in chunks(batch.column(0)):
                t, starts = tokens(data, at)
                toks.append(t), lens.append(np.diff(starts)), held.append(flags[lo:hi]), ids.append(batch.column(1).slice(lo, hi - lo))
                if sum(map(len, toks)) >= CHUNK:
                    yield out()
        if toks:
            yield out()

    return src.mapInArrow(run, f"chunk long, ids array<{id_type}>, held binary, lens binary, dictionary binary, own binary, spot binary, toks binary, n long, v long")


def part_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Parts are ranges of hashes, so that a sorted dictionary is cut into runs."""
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _asking(table: DataFrame, bits: int) -> DataFrame:
    """ask rows: a part's run of each chunk's dictionary, and how often training has each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, own = unpack(keys), unpack(own)
                edges = np.searchsorted(part_of(keys, bits), np.arange((1 << bits) + 1))
                rows = [row("ask", j, chunk, keys[lo:hi], own[lo:hi]) for j, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]
                yield from batch_of(rows).to_batches()

    return table.select("chunk", "dictionary", "own").mapInArrow(run, PACKED)


def _number(bits: int) -> Callable[[Group], list[tuple]]:
    """ask rows of a part -> part: its words of training (sorted hashes) with their ranks by frequency and counts by rank; id: the ids of each ask's words, -1 if unknown."""
    step = 1 << bits

    def f(g: Group) -> list[tuple]:
        asks = [(r["sender"], unpack(r["a"]).astype(np.uint64), unpack(r["b"])) for r in g.of("ask")]
        keys, place = np.unique(np.concatenate([k for _, k, _ in asks]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([n for *_, n in asks]), minlength=len(keys)).astype(np.int64)
        keys, count = keys[count > 0], count[count > 0]
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        out = [row("part", g.at, 0, keys, rank, count[order], n1=count.sum(), n2=len(keys))]
        return out + [row("id", chunk, g.at, np.where((i := find(keys, k)) >= 0, rank[i] * step + g.at, -1) if len(keys) else np.full(len(k), -1)) for chunk, k, _ in asks]

    return f


def find(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x among sorted_keys, -1 if it isn't there."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == x, i, -1)


def _chunk_pairs(ids: np.ndarray, toks: np.ndarray, end: int, n_blocks: int) -> tuple[np.ndarray, ...]:
    """Of a chunk's neighbouring tokens: the pair of each token, u and w of each pair of known words, its block, and the pairs in order of blocks."""
    order = np.argsort(ids, kind="stable")
    place_of = np.empty(len(ids), np.int64)
    place_of[order] = np.arange(len(ids))
    ids, toks = ids[order], place_of[toks]  # so that pairs come in order of u, then w
    context = np.empty_like(toks)
    context[:1], context[1:] = place_of[end], toks[:-1]
    pairs, place = np.unique(context * len(ids) + toks, return_inverse=True)
    u, w = ids[pairs // max(1, len(ids))], ids[pairs % max(1, len(ids))]
    block = (mix(u.astype(np.uint64) * _R + w.astype(np.uint64)) % np.uint64(n_blocks)).astype(np.int64)
    block[(u < 0) | (w < 0)] = n_blocks  # nobody has seen them
    return place, u, w, block, np.argsort(block, kind="stable")


def _opened(chunk: dict, replies: list[dict]) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids by place, tokens and the place of END, whose hash is the least."""
    spot = unpack(chunk["spot"])
    ids = np.empty(len(spot), np.int64)
    ids[spot] = np.concatenate([unpack(r["a"]) for r in replies])
    return ids, unpack(chunk["toks"]), int(spot[0])


def _with_replies(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Each chunk and what was answered to it, in one row."""
    per = rows.groupBy(F.col("at").alias("chunk")).agg(F.collect_list(F.struct("kind", "sender", "a", "b", "c", "d")).alias("got"))
    return table.join(per, "chunk")


def _pairs(table: DataFrame, ids: DataFrame, n_blocks: int) -> DataFrame:
    """pair rows: u, w and c (times in training, maybe 0) of each pair that a chunk has, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                own, toks, end = _opened(x, sorted(x["got"], key=lambda r: r["sender"]))
                place, u, w, block, order = _chunk_pairs(own, toks, end, n_blocks)
                count = np.bincount(place[np.repeat(unpack(x["held"]) == 0, unpack(x["lens"]))], minlength=len(u))
                edges = np.searchsorted(block[order], np.arange(n_blocks + 1))
                for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    if hi > lo:
                        at = order[lo:hi]
                        yield from batch_of([row("pair", b, x["chunk"], np.diff(u[at], prepend=0), w[at], count[at])]).to_batches()

    return _with_replies(table.select("chunk", "held", "lens", "spot", "toks"), ids).mapInArrow(run, PACKED)


def _runs(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and where it stands, in order."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    for j, lo, hi in zip(parts, first, np.append(first, len(part))[1:], strict=True):
        yield int(j), order[lo:hi]


def _block(n_parts: int) -> Callable[[Group], list[tuple]]:
    """pair rows of a block -> block: u (differences), w, c; solo and cell: u and w of its pairs seen once, or more often; base and
    link: of each part and role (sender: 2 * block + role; 0 context, 1 dish), words with their tables of pairs seen once, and words of cells
    with their numbers of cells and tables to start with, drawn from Pitman-Yor processes without strength by the block's own discount."""

    def f(g: Group) -> list[tuple]:
        got = [[np.cumsum(unpack(r["a"])), unpack(r["b"]), unpack(r["c"])] for r in g.of("pair")]
        u, w, c = (np.concatenate([x[k] for x in got]) for k in range(3))
        u, w, c = u[c > 0], w[c > 0], c[c > 0]
        us, iu = np.unique(u, return_inverse=True)
        ws, iw = np.unique(w, return_inverse=True)
        key, place = np.unique(iu * max(1, len(ws)) + iw, return_inverse=True)
        c = np.bincount(place, weights=c, minlength=len(key)).astype(np.int64)
        u, w = us[key // max(1, len(ws))], ws[key % max(1, len(ws))]
        out = [row("block", g.at, 0, np.diff(u, prepend=0), w, c, n1=(c == 1).sum(), n2=(c == 2).sum())]
        cells, d = c > 1, discount((c == 1).sum(), (c == 2).sum())
        t = process_tables(c[cells], np.full(cells.sum(), 1e-9), d, stirling(d, ROW), np.random.default_rng([ROW, g.at]))
        for kind, at in (("base", ~cells), ("link", cells)):
            for role, x in ((0, u[at]), (1, w[at])):
                own, place, n = np.unique(x, return_inverse=True, return_counts=True)
                first = np.bincount(place, weights=t, minlength=len(own)).astype(np.int64) if kind == "link" else n
                for j, to in _runs(own % n_parts):
                    out.append(row(kind, j, 2 * g.at + role, np.diff(own[to] // n_parts, prepend=0), n[to], first[to] if kind == "link" else None))
        return [*out, row("cell", g.at, 0, np.diff(u[cells], prepend=0), w[cells], c[cells])]

    return f


def _summed(d0: float, a0: float, d: float, seed: int) -> Callable[[Group], list[tuple]]:
    """A part's turn. base: tables of pairs seen once, summed up in start after the first turn; link: the words that each block asks for; sum: their tables now.

    state: tables tu of each word as a context and cw as a dish (the parent's customers), its tables tw in the parent. a0: d0 z0 b.
    value: for each link, z of a context, or cw and tw of a dish.
    """
    logs = stirling(d0, ROW)

    def f(g: Group) -> list[tuple]:
        out, start = [], g.one("start")
        if start is None:
            size = int(g.one("part")["n2"])
            tables = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
            for r in g.of("base"):
                tables[r["sender"] % 2][np.cumsum(unpack(r["a"]))] += unpack(r["b"])
            out.append(row("start", g.at, 0, *tables))
        else:
            tables = [unpack(start["a"]), unpack(start["b"])]
            size = len(tables[0])
        links = {r["sender"]: (np.cumsum(unpack(r["a"])), unpack(r["c"])) for r in g.of("link")}
        now = {r["sender"]: unpack(r["a"]) for r in g.of("sum")}
        for k, (at, first) in links.items():
            tables[k % 2][at] += now.get(k, first)
        tu, cw = tables
        rng = np.random.default_rng([seed, g.at])
        last = g.one("state")
        tw = draw(cw, np.full(size, a0), d0, logs, rng, last and np.minimum(unpack(last["c"]), cw))
        z = rng.gamma(THETA / d + tu).astype(np.float32)
        out.append(row("state", g.at, 0, tu, cw, tw, n1=cw.sum(), n2=tw.sum()))
        return out + [row("value", k // 2, 2 * g.at + k % 2, *((z[at],) if k % 2 == 0 else (cw[at], tw[at]))) for k, (at, _) in links.items()]

    return f


def _massed(n_parts: int, d0: float, a: float, seed: int) -> Callable[[Group], list[tuple]]:
    """state rows -> mass: the sum of the parent's masses of a part's words, which blocks draw alike."""

    def f(g: Group) -> list[tuple]:
        cw, tw = (unpack(g.one("state")[k]) for k in "bc")
        m = masses(cw, tw, np.full(len(cw), a), d0, keys_of(np.arange(len(cw)) * n_parts + g.at, seed))
        return [row("mass", g.at, n1=m.sum())]

    return f


def parent(cw: np.ndarray, tw: np.ndarray, d0: float, b: float, customers: float, tables: float) -> np.ndarray:
    """The parent's probability of words with cw customers at tw tables."""
    return (cw - d0 * tw + (THETA + d0 * tables) * b) / (THETA + customers)


def _seated(n_parts: int, d: float, d0: float, a: float, mass: float, seeds: tuple[int, int]) -> Callable[[Group], list[tuple]]:
    """A block's turn: cell and value rows -> seat: the tables of each cell; sum: those of each word that it asks for."""
    logs = stirling(d, ROW)

    def f(g: Group) -> list[tuple]:
        cell = g.one("cell")
        u, w, c = np.cumsum(unpack(cell["a"])), unpack(cell["b"]), unpack(cell["c"])
        values = {r["sender"]: r for r in g.of("value")}
        per = []
        for role, x in ((0, u), (1, w)):
            own, place = np.unique(x, return_inverse=True)
            parts, got = list(_runs(own % n_parts)), np.zeros((2, len(own)))
            for j, to in parts:
                for k, key in enumerate("ab"[: role + 1]):
                    got[k, to] = unpack(values[2 * j + role][key])
            value = d * got[0] if role == 0 else masses(*got, np.full(len(own), a), d0, keys_of(own, seeds[0])) / mass
            per.append((place, parts, value))
        last = g.one("seat")
        t = draw(c, per[0][2][per[0][0]] * per[1][2][per[1][0]], d, logs, np.random.default_rng([seeds[1], g.at]), last and unpack(last["a"]))
        out = [row("seat", g.at, 0, t, n1=t.sum())]
        for role, (place, parts, value) in enumerate(per):
            sums = np.bincount(place, weights=t, minlength=len(value)).astype(np.int64)
            out += [row("sum", j, 2 * g.at + role, sums[to]) for j, to in parts]
        return out

    return f


def _lookup(d: float, turns: int) -> Callable[[Group], list[tuple]]:
    """block, seat and pair rows -> weight: c - d * (mean of its tables) of each pair asked for, 0 if it was never seen."""

    def f(g: Group) -> list[tuple]:
        block = g.one("block")
        u, w, c = np.cumsum(unpack(block["a"])), unpack(block["b"]), unpack(block["c"])
        t = np.ones(len(c))
        t[c > 1] = sum(unpack(r["a"]) for r in g.of("seat")) / turns
        weight = np.append(c - d * t, 0.0)
        us, ws = np.unique(u), np.unique(w)
        keys = find(us, u) * max(1, len(ws)) + find(ws, w)
        out = []
        for r in g.of("pair"):
            iu, iw = find(us, np.cumsum(unpack(r["a"]))), find(ws, unpack(r["b"]))
            out.append(row("weight", r["sender"], g.at, weight[np.where((iu < 0) | (iw < 0), -1, find(keys, iu * max(1, len(ws)) + iw))]))
        return out

    return f


def _told(n_parts: int) -> Callable[[Group], list[tuple]]:
    """part, state and id rows -> word: count, and for each kept turn tu, cw and tw of each id of a chunk (0 for unknown words)."""

    def f(g: Group) -> list[tuple]:
        n, states = unpack(g.one("part")["c"]), [[unpack(r[k]) for k in "abc"] for r in g.of("state")]
        out = []
        for r in g.of("id"):
            ids = unpack(r["a"])
            at = np.where(ids < 0, -1, ids // n_parts)
            tell = lambda x: np.append(x, 0)[at]  # noqa: B023, E731
            out.append(row("word", r["sender"], g.at, tell(n), *(np.concatenate([tell(s[k]) for s in states]) for k in range(3))))
        return out

    return f


class Model:
    """What training leaves: tables in the shared folder and a few totals."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        path = f"{shared_dir(self.spark)}/chunks-{uuid.uuid4().hex}"
        whole = chunked(docs, id_col, text_col)
        whole.write.parquet(path)
        whole = self.spark.read.schema(whole.schema).parquet(path)
        n, v = whole.agg(F.sum("n"), F.sum("v")).first()
        # bucketed by chunk: what is answered to chunks comes to them, and they stay where they are
        self.table, self.name = bucketed(whole.drop("dictionary", "own", "n", "v"), "chunk", "pitman_yor")
        bits = max(0, int(np.ceil(np.log2(max(1, (v or 0) / PART)))))
        self.n_parts, self.n_blocks = 1 << bits, max(1, -(-(n or 0) // BLOCK))
        free(self.spark)
        self.parts = Kept(met(_asking(whole, bits), _number(bits), self.n_parts), "parts")
        drop(self.spark, path)
        own, v = self.parts.of("part").agg(F.sum("n1"), F.sum("n2")).first()
        self.n_train, self.v = int(own or 0), int(v or 0)
        self.b = 1 / (self.v + 1)
        self.pairs = Kept(_pairs(self.table, self.parts.of("id"), self.n_blocks), "pairs")
        free(self.spark)
        self.blocks = Kept(met(self.pairs.of("pair"), _block(self.n_parts), self.n_blocks), "blocks")
        free(self.spark)
        once, twice = (x or 0.0 for x in self.blocks.of("block").agg(F.sum("n1"), F.sum("n2")).first())
        self.d = discount(once, twice)
        self.d0 = discount(*(x or 0.0 for x in self.singles()))
        self.seats: list[Kept] = []
        self.states: list[tuple[Kept, tuple[float, float]]] = []
        rng = np.random.default_rng(11)
        z0 = float(rng.gamma(THETA / self.d0 + self.v))
        fixed, state, start, seats, tilt = self.parts.of("part").unionByName(self.blocks.of("base", "link")), None, None, None, None
        links = self.blocks.of("link").withColumns({k: F.lit(None).cast("binary") for k in "bc"})
        for turn in range(SWEEPS + 1):
            rows = fixed if seats is None else start.of("start").unionByName(links).unionByName(seats.of("sum")).unionByName(state.of("state"))
            last, state = state, Kept(met(rows, _summed(self.d0, self.d0 * z0 * self.b, self.d, 3 * turn), self.n_parts), "state")
            start = start or state
            totals = tuple(x or 0.0 for x in state.of("state").agg(F.sum("n1"), F.sum("n2")).first())
            customers, tables = totals
            if last and turn - 1 <= BURN_IN:
                last.drop(*(["state"] if last is start else []))
            if turn > BURN_IN:
                self.states.append((state, totals))
            if turn < SWEEPS:
                tilt = 1 + rng.gamma(customers) / rng.gamma(THETA) if tilt is None else tilt
                z0 = float(rng.gamma(THETA / self.d0 + tables))
                zeta = z0 / tilt**self.d0
                a, seed = z0 * self.b, 3 * turn + 1
                summed = met(state.of("state"), _massed(self.n_parts, self.d0, a, seed), self.n_parts).agg(F.sum(F.col("n1").cast("decimal(30,6)"))).first()[0]
                # a sum of decimals is the same in any order; the unknown word's mass goes with it
                mass = float(summed or 0) + float(tilted_stable(np.array([a]), self.d0, keys_of(np.array([-1]), seed))[0])
                rows = self.blocks.of("cell").unionByName(state.of("value"))
                rows = rows if seats is None else rows.unionByName(seats.of("seat"))
                last, seats = seats, Kept(met(rows, _seated(self.n_parts, self.d, self.d0, a, mass, (seed, 3 * turn + 2)), self.n_blocks), "seats")
                if last and turn - 1 < BURN_IN:
                    last.drop()
                if turn >= BURN_IN:
                    self.seats.append(seats)
                state.drop("value")
                # masses are those of tilt 1 over the tilt; its new value, given them and the new tables
                tilt = 1 + rng.gamma(once + float(seats.of("seat").agg(F.sum("n1")).first()[0] or 0)) * tilt / mass
                z0 = zeta * tilt**self.d0
            free(self.spark)
        self.blocks.drop("base", "link", "cell")
        start.drop("start")

    def singles(self) -> tuple[float, float]:
        """Words that follow one word only, and two."""

        def f(g: Group) -> list[tuple]:
            cw = np.zeros(int(g.one("part")["n2"]), np.int64)
            for r in g.of("base") + g.of("link"):
                if r["sender"] % 2:
                    cw[np.cumsum(unpack(r["a"]))] += unpack(r["b"])
            return [row("n", g.at, n1=(cw == 1).sum(), n2=(cw == 2).sum())]

        return met(self.parts.of("part").unionByName(self.blocks.of("base", "link")), f, self.n_parts).agg(F.sum("n1"), F.sum("n2")).first()

    def score(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each text, as a written table. The model's own tables go."""
        turns, d, d0, b, n_blocks, n_train, v = len(self.states), self.d, self.d0, self.b, self.n_blocks, self.n_train, self.v
        states, seats = self.states[0][0].of("state"), self.seats[0].of("seat")
        states, seats = states.withColumn("sender", F.lit(0).cast("long")), seats.withColumn("sender", F.lit(0).cast("long"))
        for k in range(1, turns):
            states = states.unionByName(self.states[k][0].of("state").withColumn("sender", F.lit(k).cast("long")))
            seats = seats.unionByName(self.seats[k].of("seat").withColumn("sender", F.lit(k).cast("long")))
        totals = [t for _, t in self.states]
        weight = Kept(met(self.blocks.of("block").unionByName(seats).unionByName(self.pairs.of("pair")), _lookup(d, turns), n_blocks), "weights")
        for kept in (self.pairs, self.blocks, *self.seats):
            kept.drop()
        free(self.spark)
        asked = self.parts.of("id").withColumns({"at": F.col("sender"), "sender": F.col("at")})
        word = Kept(met(self.parts.of("part").unionByName(states).unionByName(asked), _told(self.n_parts), self.n_parts), "words")
        free(self.spark)
        rows = _with_replies(self.table.select("chunk", "ids", "held", "lens", "spot", "toks"), self.parts.of("id").unionByName(word.of("word")).unionByName(weight.of("weight")))
        id_type = self.table.schema["ids"].dataType.elementType.simpleString()
        spread = n_train + 0.5 * (v + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x = batch.slice(i, 1).drop_columns(["ids"]).to_pylist()[0]
                    got = {k: sorted((r for r in x["got"] if r["kind"] == k), key=lambda r: r["sender"]) for k in ("id", "word", "weight")}
                    ids, toks, end = _opened(x, got["id"])
                    place, u, w, block, order = _chunk_pairs(ids, toks, end, n_blocks)
                    extra = np.zeros(len(u))
                    seen = order[: int((block < n_blocks).sum())]
                    if len(seen):
                        extra[seen] = np.concatenate([unpack(r["a"]) for r in got["weight"]])
                    spot = unpack(x["spot"])
                    told = np.zeros((1 + 3 * turns, len(spot)))
                    told[0, spot] = np.concatenate([unpack(r["a"]) for r in got["word"]])
                    for k, key in enumerate("bcd"):
                        both = [unpack(r[key]).reshape(turns, -1) for r in got["word"]]
                        told[1 + k * turns : 1 + (k + 1) * turns, spot] = np.concatenate(both, axis=1)
                    n, tu, cw, tw = told[0], *(told[1 + k * turns : 1 + (k + 1) * turns] for k in range(3))
                    p = np.stack([parent(cw[k], tw[k], d0, b, *totals[k]) for k in range(turns)])
                    s = THETA + d * tu
                    context = np.empty_like(toks)
                    context[:1], context[1:] = end, toks[:-1]
                    back = sum(s[k][context] * p[k][toks] for k in range(turns)) / turns
                    gain = np.log10((extra[place] + back) / (THETA + n[context]))
                    base = np.log10((n + 0.5) / spread)[toks]
                    lens, held = unpack(x["lens"]), unpack(x["held"])
                    at = np.cumsum(lens) - lens
                    sums = lambda y: pa.array(np.add.reduceat(y, at))  # noqa: B023, E731
                    cols = [batch.column("ids").slice(i, 1).flatten(), pa.array(held == 1), pa.array(lens), sums((n[toks] > 0).astype(np.int64)), pa.array(np.full(len(at), n_train)), sums(base), sums(gain)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        out = cut(rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
        for kept in (self.parts, *(s for s, _ in self.states), word, weight):
            kept.drop()
        self.spark.sql(f"DROP TABLE {self.name}")
        return out


def perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Learned from the rows whose crc32(doc_id as text) mod 5 isn't 1. Tokens: words parted by white space, A-Z
    lower-cased, and one end for each text; so a null or empty text is one token. Repeated rows count each time.
    Without rows to learn from, all words are unknown and the base is uniform. A text's perplexity is
    10 ** (-score / n_tokens).
    """
    return Model(docs, id_col, text_col).score()
