import random
import re

from rootscope.llm import near_dedup as N
from rootscope.llm.components import components

SCHEMA = "doc_id long, text string, component_id string, kept string, hub string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, k):
    w = re.findall(r"[^ \t-\r]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    s = [(d, sets(t, k)) for d, t in rows if d is not None]
    up = {d: d for d, _ in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: root(d) for d in up}


def rows():
    rng = random.Random(11)
    word = lambda: "w%d" % rng.randrange(5000)
    out, n = [], 0
    for _ in range(12):
        seed = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 14)):
            t = list(seed)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                t[rng.randrange(len(t))] = word()
            out.append((n, " ".join(t).replace("w1", "W1") if rng.random() < 0.3 else "\n".join(t)))
            n += 1
    rng.shuffle(out)
    return out + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "two words"), (n + 4, "TWO  words"), (n + 5, "one"), (n + 6, "long " * 30_000), (n + 7, "long " * 20_000), (None, "two words"), (n + 5, "one")]


def test_against_all_pairs(spark):
    r = rows()
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in r], SCHEMA).repartition(4)
    got = N.near_duplicates(df, size=4, percent=80).collect()
    want = brute(r, 4, 80)
    assert len(got) == len(r)
    texts = {d: t for d, t in r if d is not None}
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.component_id, x.kept, x.n_shingles) == (want[x.doc_id], want[x.doc_id] == x.doc_id, len(sets(texts[x.doc_id], 4)))
    assert len(set(want.values())) < len(want) - 20


def test_empty_and_stage(spark):
    df = spark.createDataFrame([(2, "a b c d e f", "", "", ""), (1, "a b c  d e f", "", "", ""), (3, None, "", "", "")], SCHEMA)
    out = N.keep_one_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}
