import math
import random

from pyspark.sql import functions as F

from rootscope.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def test_against_all_scores(spark, monkeypatch):
    rng = random.Random(5)
    vecs = [(i, [rng.uniform(-1, 1) for _ in range(9)]) for i in range(230)]
    vecs += [(300 + i, [0.5] * 9) for i in range(40)] + [(400, None), (450, [None] * 9), (500, [float("nan")] * 9), (550, [float("inf")] * 9), (600, [0.25] * 3), (601, [0.5] * 3), (None, [0.1] * 9), (50, vecs[50][1]), (1000, [3e9] * 9)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in vecs], SCHEMA).repartition(5)
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    f = {}
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        mine = min(v for i, v in rows if i == q)
        best = sorted(((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in rows if i != q and len(v) == len(mine)))[:5]
        f[q] = [(i, min(-s, 2**63 - 1)) for s, i in best]
    # everything gathered, little gathered (most shards stay open), shards of a few rows
    for shard, depth in ((1024, 64), (1024, 1), (16, 8)):
        monkeypatch.setattr(T, "SHARD", shard)
        got = {}
        for r in sorted(T.top_k(df, df.filter("vec_id % 50 = 0"), depth=depth).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == {q: x for q, x in f.items() if x}


def clustered(spark):
    """Shards of 64 rows whose vectors point one way, and a query for each of the ways."""
    rng = random.Random(6)
    centre = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    vecs = [(c * 64 + i, [x + rng.gauss(0, 0.1) for x in centre[c]]) for c in range(20) for i in range(64)]
    return spark.createDataFrame(vecs, "vec_id long, embedding array<float>").coalesce(1)


def test_the_cutoff_settles_shards(spark, monkeypatch):
    """Only shards whose other rows may reach the cutoff are sent again; without the cutoff's test all would be."""
    sent = []
    real, resolve = T.open_pairs, T._resolve
    monkeypatch.setattr(T, "SHARD", 64)
    monkeypatch.setattr(T, "open_pairs", lambda lists, cutoffs: sent.append((real(lists, cutoffs).count(), lists.count())) or real(lists, cutoffs))
    df = clustered(spark)
    want = [tuple(r) for r in T.top_k(df, df.filter("vec_id % 64 = 0"), depth=8).orderBy("query_id", "rank").collect()]
    assert sent[0][1] == 400 and 0 < sent[0][0] < 100
    # a cutoff that lets nothing through loses rows, so phases 2 and 3 hang on it
    monkeypatch.setattr(T, "open_pairs", lambda lists, cutoffs: real(lists, cutoffs.withColumn("cutoff", F.lit(2**62))))
    lost = [tuple(r) for r in T.top_k(df, df.filter("vec_id % 64 = 0"), depth=1).orderBy("query_id", "rank").collect()]
    assert lost != want
    monkeypatch.setattr(T, "_resolve", lambda pairs, k: resolve(pairs.select("dim", "shard", "ids", "vecs", F.transform("asked", lambda a: a.withField("cutoff", a["cutoff"] + 10**6)).alias("asked")), k))
    monkeypatch.setattr(T, "open_pairs", real)
    assert [tuple(r) for r in T.top_k(df, df.filter("vec_id % 64 = 0"), depth=8).orderBy("query_id", "rank").collect()] != want


def test_empty(spark):
    df = spark.createDataFrame([(0, [1.0], "", "")], SCHEMA)
    assert T.top_k(df, df).count() == 0 and T.top_k(df.limit(0), df.limit(0)).count() == 0


def test_no_pairs_go_through_the_driver(spark, monkeypatch):
    """Copies of query blocks and open pairs grow with the square of the rows, so that no join may broadcast them, however small Spark takes them to be."""
    plans, gather, resolve = [], T._gather, T._resolve
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(T, "SHARD", 64)
    monkeypatch.setattr(T, "_gather", lambda pairs, k, depth: seen(pairs) or gather(pairs, k, depth))
    monkeypatch.setattr(T, "_resolve", lambda pairs, k: seen(pairs) or resolve(pairs, k))
    df = clustered(spark)
    seen(T.top_k(df, df.filter("vec_id % 64 = 0"), depth=8))
    assert len(plans) == 3 and all("Join" in p and "Broadcast" not in p for p in plans)
