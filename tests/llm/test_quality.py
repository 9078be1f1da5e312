import random

import numpy as np
from pyspark.sql import functions as F

from rootscope.llm import quality as Q

DOC = "doc_id long, text string, lang string, stats string, score string"
LABEL = "doc_id long, quality int, toxic int"


def texts(n, seed=1):
    """Prose, and the same words in capitals, with symbols, as tables or repeated."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = ["".join(rng.choice("abcdeéinorst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(5, 200))]
        bad = rng.randrange(4) if rng.random() < 0.3 else None
        prose = " ".join(w).capitalize() + "."
        out.append((i, prose if bad is None else [prose.upper(), " | ".join(w), "%$# ".join(w), " ".join(x for x in w for _ in range(9))][bad], int(bad is None)))
    return out


def scored(spark, docs, labels):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], DOC).repartition(6)
    return Q.score_quality(df, spark.createDataFrame(labels, LABEL))


def test_kernel_is_gaussian():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.5, (40, Q.WIDTH))
    z = Q.Kernel(np.zeros(Q.WIDTH), np.ones(Q.WIDTH))(x)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-far / (2 * Q.SPREAD**2 * Q.WIDTH))).mean() < 0.06


def test_normal_equations_are_the_sums_of_all_rows(spark):
    rng = np.random.default_rng(4)
    x, y, f = rng.normal(size=(300, Q.WIDTH)).astype(np.float32), rng.integers(0, 2, 300), rng.integers(0, Q.FOLDS, 300)
    kernel = Q.Kernel(np.zeros(Q.WIDTH), np.ones(Q.WIDTH))
    df = spark.createDataFrame([(int(a), 2.0, float(b), c.tolist()) for a, b, c in zip(f, y, x, strict=True)], "fold int, weight double, label double, stats array<float>").repartition(7)
    got = Q.normal_equations(df, kernel)
    z = kernel(x.astype(float))
    for k in range(Q.FOLDS):
        size, gram, moment = got[k]
        assert size == 2 * (f == k).sum() and np.allclose(gram, 2 * z[f == k].T @ z[f == k]) and np.allclose(moment, 2 * z[f == k].T @ y[f == k])
    w = Q.solve(list(got.values()))
    penalty = np.diag([Q.RIDGE * 600] * Q.FEATURES + [1e-9 * 600])
    assert np.allclose((2 * z.T @ z + penalty) @ w, 2 * z.T @ y, atol=1e-6)


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 30):
        s, w, y = np.sort(rng.normal(size=n)), rng.integers(1, 9, n).astype(float), rng.random(n)
        at, share = Q.isotonic(s, w, y)
        assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all()
        mean = lambda a, b: (w[a : b + 1] @ y[a : b + 1]) / w[a : b + 1].sum()  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(sorted(set(np.round(want, 9))), np.round(share, 9))


def test_held_out_accuracy(spark):
    made = texts(900)
    rng = random.Random(6)
    labels = [(i, q, 0) for i, _, q in made if rng.random() < 0.6]
    r = scored(spark, [(i, t) for i, t, _ in made], labels).toPandas().set_index("doc_id")
    assert len(r) == 900 and r.score.between(0, 1).all() and ((r.score >= 0.3) == (r.predicted == 1)).all()
    unseen = r[r.held_out].join(__import__("pandas").DataFrame([(i, q) for i, _, q in made], columns=["doc_id", "q"]).set_index("doc_id"))
    assert len(unseen) > 100 and (unseen.predicted == unseen.q).mean() > 0.95
    # labels of held-out documents change nothing, nor do other columns
    held = set(unseen.index)
    again = scored(spark, [(i, t) for i, t, _ in made], [(i, 1 - q if i in held else q, 1) for i, q, _ in labels]).toPandas().set_index("doc_id")
    assert np.allclose(again.score.sort_index(), r.score.sort_index(), atol=1e-9)


def test_odd_rows(spark):
    made = texts(300, 2)
    docs = [(i, t) for i, t, _ in made] + [(1000, None), (1001, ""), (1002, "word " * 200_000), (None, "A text."), (None, None), (1, made[1][1]), (1003, "!?"), (1004, "\x00\x7f")]
    labels = [(i, q, 0) for i, _, q in made] + [(5, None, 0), (None, 1, 1), (1, made[1][2], 0), (1, made[1][2], 0), (1000, 0, 0)]
    r = scored(spark, docs, labels)
    assert r.columns == ["doc_id", "held_out", "score", "predicted"] and r.count() == len(docs)
    p = r.toPandas()
    assert p.score.between(0, 1).all() and p[p.doc_id == 1].score.nunique() == 1
    assert p[p.doc_id == 1000].score.iloc[0] == p[p.doc_id == 1001].score.iloc[0]
    assert not p[p.doc_id.isna()].held_out.any()


def test_empty(spark):
    assert scored(spark, [], [(1, 1, 0)]).count() == 0
    got = scored(spark, [(1, "A text."), (2, None)], []).collect()
    assert [r.score for r in got] == [0.5, 0.5] and [r.predicted for r in got] == [1, 1]
    one = scored(spark, [(i, "A text.") for i in range(9)], [(i, 1, 0) for i in range(9)])
    assert one.filter(F.col("predicted") == 1).count() == 9
