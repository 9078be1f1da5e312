"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: a seed for each small bucket of keys
sends its keys to free slots; buckets of one key name their slot) resolves a pre-token that is a token itself.
Tier two: other pre-tokens are merged by a heap of pair ranks over linked bytes. Either result is kept in a bounded
memo, since pre-tokens repeat.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of either generation of the memo, with what an entry costs besides; characters of the longest pre-token that it keeps.
MEMO, ENTRY, LONGEST = 64 << 20, 200, 64
AFTER, BEFORE = list(range(1, 257)), list(range(-1, 255))


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file (a fixed vocabulary of bounded size), read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash: every key has a slot of its own among as many slots as keys."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        self.seeds, self.keys = [0] * self.buckets, [b""] * n
        taken, by_bucket = bytearray(n), defaultdict(list)
        for key in keys:
            by_bucket[xxhash.xxh3_64_intdigest(key) % self.buckets].append(key)
        for bucket, own in sorted(by_bucket.items(), key=lambda x: (-len(x[1]), x[0])):
            seed = 1
            while len(own) > 1:
                slots = [xxhash.xxh3_64_intdigest(k, seed) % n for k in own]
                if len(set(slots)) == len(own) and not any(taken[s] for s in slots):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for k, s in zip(own, slots if len(own) > 1 else [], strict=False):
                taken[s], self.keys[s] = 1, k
        free = iter([i for i in range(n) if not taken[i]])
        for bucket, own in by_bucket.items():
            if len(own) == 1:
                slot = next(free)
                self.seeds[bucket], self.keys[slot] = -slot - 1, own[0]

    def slot(self, key: bytes) -> int:
        """The key's slot, -1 if it isn't a key: the slot's own key is compared."""
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        s = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return s if self.keys[s] == key else -1


class Coder:
    """Ranks, their perfect hash and the pairs of tokens that merge into a token. Made once; restore() takes its plain parts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.hash = PerfectHash(list(ranks))
        self.rank_of_slot = [ranks.get(k, 0) for k in self.hash.keys]
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.token = {r: t for t, r in ranks.items()}
        self.pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = r

    def parts(self) -> tuple[dict, dict]:
        return vars(self) | {"hash": None}, vars(self.hash)

    @classmethod
    def restore(cls, own: dict, of_hash: dict) -> Coder:
        coder, coder_hash = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        vars(coder_hash).update(of_hash)
        vars(coder).update(own | {"hash": coder_hash})
        return coder

    def merge(self, piece: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost among equals; a byte's node stays linked to its neighbours."""
        n, rank, pop, push = len(piece), self.pairs.get, heapq.heappop, heapq.heappush
        ids = [self.byte_id[b] for b in piece]
        after, before = (AFTER[:n], BEFORE[:n]) if n <= len(AFTER) else (list(range(1, n + 1)), list(range(-1, n - 1)))
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if j >= n or (a := ids[i]) < 0 or rank(a << 32 | ids[j]) != r:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j], after[i] = r, -1, (k := after[j])
            if k < n:
                before[k] = i
                if (x := rank(r << 32 | ids[k])) is not None:
                    push(heap, x << 32 | i)
            if (h := before[i]) >= 0 and (x := rank(ids[h] << 32 | r)) is not None:
                push(heap, x << 32 | h)
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        s = self.hash.slot(raw)
        return [self.rank_of_slot[s]] if s >= 0 else self.merge(raw)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


class Memo(dict):
    """pre-token -> ids as little-endian 32-bit integers. Past MEMO bytes it turns: entries not used until the next turn go. Long pre-tokens aren't kept."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder, self.old, self.size = coder, {}, 0

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            ids = self.coder.encode_piece(piece)
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) > LONGEST:
                return out
        self[piece] = out
        self.size += ENTRY + 4 * len(piece) + len(out)
        if self.size > MEMO:
            self.old, self.size = dict(self), 0
            self.clear()
        return out


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, ids (binary: little-endian unsigned 32-bit) and, if asked, decoded (binary).

    Null and empty texts have no ids. Special tokens' strings are ordinary text. Rows are independent: repeated
    rows, ties and other columns need no rule.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Coder(read_ranks(spark, path), pattern).parts())  # a vocabulary of fixed size
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("ids", "binary").add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.restore(*shared.value)
        split, memo = regex.compile(coder.pattern).findall, Memo(coder)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [b"".join(map(memo.__getitem__, split(text or ""))) for text in part.column(1).to_pylist()]
                back = [coder.decode(x) for x in ids] if decoded else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out if decoded else out.drop("decoded")


def digest(encoded: DataFrame) -> DataFrame:
    n = (F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
