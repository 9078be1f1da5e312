import math
import random

import numpy as np
from pyspark.sql import functions as F

from rootscope.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, vec array<double>, score string, rank string, place string"


def brute(rows, anchors, positives=5, negatives=10):
    ok = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    out = []
    for a in sorted({i for i, *_ in ok if i in anchors}):
        y, q = min((r[1], r[2]) for r in ok if r[0] == a)
        rest = [(-cut(sum(x * z for x, z in zip(q, v, strict=True))), i, lab) for i, lab, v in ok if len(v) == len(q)]
        for k, (s, p, _) in enumerate(sorted(r for r in rest if r[2] == y and r[1] != a)[:positives]):
            inside = sorted((t, n) for t, n, lab in rest if lab != y and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(a, p, j + 1, n, -s, -t, k + 1) for j, (t, n) in enumerate(inside)]
    return sorted(out)


def got(spark, rows, anchors):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in H.hard_negatives(df, df.filter(F.col("vec_id").isin(list(anchors)))).collect())


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for most in (1, 300, 2**40, 2**61):
        for dim in (1, 8, 13):
            q, v = rng.integers(-most, most, (5, dim)), rng.integers(-most, most, (40, dim))
            codes = H.planes(v)
            want = q.astype(object) @ v.astype(object).T
            assert (H.scores(H.tables(q, H.kind_of(q, len(codes))), codes).T == want).all()
    assert H.planes(np.array([[-1, 0]])).shape == (1, 1, 1)  # the sign alone


def test_against_all_scores(spark, monkeypatch):
    rng = random.Random(3)
    # label 1 holds most rows; ties, repeats, odd rows, other lengths, one very large vector
    rows = [(i, rng.choice([0, 1, 1, 1, 2]), [rng.uniform(-0.2, 1) for _ in range(11)]) for i in range(260)]
    rows += [(300 + i, i % 3, [0.5] * 11) for i in range(60)] + [(7, 1, rows[7][2]), (40, 0, [0.1] * 11), (None, 1, [0.5] * 11), (500, None, [0.5] * 11), (501, 1, None), (502, 1, [None] * 11), (503, 1, [float("nan")] * 11), (504, 1, [float("inf")] * 11)]
    rows += [(600 + i, i % 2, [0.3, 0.2, 0.1]) for i in range(9)] + [(700, 0, [1e30] * 11), (701, 0, [-3.0] * 11), (702, 5, [1.0] * 11), (703, 1, []), (704, 1, [])]
    anchors = {i for i in range(0, 400, 20)} | {320, 501, 503, 600, 700, 701, 702, 703}
    want = brute(rows, anchors)
    assert len(want) > 500
    for block, table, chunk, rounds, shard in ((1024, 128, 1024, 16, 8192), (4, 2, 16, 2, 40)):
        for k, v in (("BLOCK", block), ("TABLE", table), ("CHUNK", chunk), ("ROUND", rounds), ("SHARD", shard)):
            monkeypatch.setattr(H, k, v)
        assert got(spark, rows, anchors) == want


def test_empty(spark):
    assert got(spark, [], {0}) == [] and got(spark, [(0, 1, [1.0])], {0}) == [] and got(spark, [(1, 1, [1.0])], {0}) == []
