import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rootscope.llm import packing as P

SCHEMA = "doc_id long, text string, source string, key string, piece string, shard string"


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[k]["left"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        out.append(k)
    return out


def test_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(0, 80)
        args = [rng.randrange(1, 30) for _ in range(n)], [rng.choice([None, *"abcd"]) for _ in range(n)], [rng.choice([None, 1, 2, 3]) for _ in range(n)]
        assert P.best_fit(*args, 30) == plain_best_fit(*args, 30)


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice([None, "hot", "hot", "b", "c"])) for i in range(300)] + [(1000, None, "a"), (1001, "", None), (1002, "x " * 5000, "a"), (1002, "x " * 5000, "a"), (None, "one two", "b")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)
    got = P.pack(df, capacity=64, shard=100).collect()
    need = Counter()
    for d, t, _ in rows:
        need[d] += len((t or "").split()) + 1
    have, bins = Counter(), defaultdict(list)
    for r in got:
        have[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
    assert have == need
    for part in bins.values():
        spots = sorted((r.bin_start, r.bin_start + r.n_tokens) for r in part)
        assert spots[0][0] == 0 and spots[-1][1] <= 64 and all(a[1] == b[0] for a, b in zip(spots, spots[1:], strict=False))
        named = [r.source for r in part if r.source is not None]
        assert len(named) == len(set(named))
    assert P.pack(df.limit(0)).count() == 0


def test_ids_stay_whole(spark):
    """Ids beyond 2^53, with a null id beside them."""
    ids = [2**53 + 1, 2**53, 2**63 - 1, None, 5]
    df = spark.createDataFrame([(i, "a b", "s", "", "", "") for i in ids], SCHEMA)
    assert sorted((r.doc_id for r in P.pack(df).collect()), key=str) == sorted(ids, key=str)


def test_given_counts_and_repeats(spark):
    """Counts of an encoder decide; a row that repeats very often and a very long one spread over shards."""
    rows = [(1, "same", "a", 3)] * 500 + [(2, "long", "b", 64 * 400), (3, "none", "c", 0), (4, "null", "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    got = P.pack(df, capacity=64, shard=100, tokens=F.col("n")).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == {(1, 3): 500, (2, 64): 400}
    shards = Counter((r.doc_id, r.bin_id >> 32) for r in got)
    assert len(shards) == 18 and max(shards.values()) < 150
