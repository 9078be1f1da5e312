import random

import pytest

from rootscope.llm import language_id as L

WORDS = {"en": "the of and that house with this from water".split(), "de": "der und nicht über schön haus wasser straße zeit".split(), "fr": "les été dans une être maison avec eau français".split(), "es": "los año niño casa agua también según más con".split()}


def rows():
    rng = random.Random(3)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(5, 60))), lang, "x", "y") for i in range(400) for lang in [rng.choice(sorted(WORDS))]]


SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


def test_held_out(spark):
    r = rows()
    more = [(1000, None, "en", "", ""), (1001, "", "de", "", ""), (1002, "123 !?", None, "", ""), (None, "der und nicht", "de", "", ""), (1003, "der und nicht über " * 9000, None, "", "")]
    df = spark.createDataFrame(r + more, SCHEMA).repartition(4)
    out = L.identify(df, L.train(df.filter(~L.held_out())), keep=[L.held_out().alias("held_out")]).collect()
    truth = {x[0]: x[2] for x in r}
    held = [x for x in out if x.held_out and x.doc_id in truth]
    assert len(held) > 50 and sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.98 * len(held)
    by = {x.doc_id: x for x in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "de" == by[None].lang_pred
    assert all(0 <= x.score <= 1 for x in out) and len(out) == len(r) + len(more)
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and not {1000, 1001, 1002} & {x.doc_id for x in kept.collect()} and kept.count() >= len(r)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "word", None, "", "")], SCHEMA)
    assert [r.lang_pred for r in L.identify(df, L.train(df)).collect()] == ["und"]
    assert L.identify(df.limit(0), L.train(df.limit(0))).count() == 0


def test_decoding_takes_the_nearest_codeword():
    """Each text and language one by one: log-odds of its n-grams for each bit, logistic loss against the codeword, weighted."""
    import math
    from collections import Counter

    import numpy as np
    import pandas as pd

    texts = [(t, lang) for _, t, lang, *_ in rows()[:200]]
    raw = lambda t: np.frombuffer(t.encode(), np.uint8)
    counts = Counter((lang, int(g)) for t, lang in texts[:120] for g in L.grams(raw(t)))
    model = L.Model(pd.DataFrame([(lang, g, n) for (lang, g), n in counts.items()], columns=["lang", "bucket", "n"]))
    asked = [t for t, _ in texts[120:]] + ["", "zzz", "der und the of"]
    best, score = model.predict([raw(t) for t in asked])
    for t, b, s in zip(asked, best, score, strict=True):
        g = L.grams(raw(t))
        loss = []
        for code in model.code:
            margins = [sum(model.odds[x, bit] for x in g) / max(1, len(g)) for bit in range(len(code))]
            loss.append(sum(w * math.log1p(math.exp(-4 * m * c)) for m, c, w in zip(margins, code, model.weight, strict=True)))
        near = [math.exp(-math.sqrt(max(1, len(g))) * (x - min(loss))) for x in loss]
        assert loss[b] <= min(loss) + 1e-12 and abs(s - near[b] / sum(near)) < 1e-9


def test_codewords():
    for n in (2, 3, 4, 9, 20):
        code = L.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n


def test_more_labels_than_a_model_holds(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 3)
    df = spark.createDataFrame([(f"text {k}", f"l{k % n}", n) for n in (3, 4) for k in range(12)], "text string, lang string, n int")
    assert len(L.train(df.filter("n = 3")).langs) == 3
    with pytest.raises(ValueError, match="lang has over 3 values"):
        L.train(df.filter("n = 4"))
