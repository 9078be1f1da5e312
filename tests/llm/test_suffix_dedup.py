import random

import numpy as np

from rootscope.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, kept string, tag string, lo string"


def brute(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def rows(rng):
    word = lambda: rng.choice(["é日", "abc", "th", "q", "  ", "\n"]) + str(rng.randrange(500))
    shared = [" ".join(word() for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    out = []
    for d in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            s = rng.choice(shared)
            parts.append(rng.choice([s, s[rng.randrange(len(s)) :], " ".join(word() for _ in range(30)), "z" * rng.randrange(0, 400)]))
        out.append((d, "".join(parts)))
    rng.shuffle(out)
    return out


def check(spark, length=100):
    r = rows(random.Random(8)) + [(500, ""), (501, "short"), (502, "ab" * 40_000)]
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in r], SCHEMA).repartition(4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in S.remove_repeats(df, length=length).collect()}
    assert got == brute(r, length)


def test_against_all_strings(spark):
    check(spark)


def test_hashed_path(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    monkeypatch.setattr(S, "SEGMENT", 1000)
    check(spark)


def test_odd_rows(spark):
    t = "".join(random.Random(6).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(1, t, "", "", ""), (1, t, "", "", ""), (2, None, "", "", ""), (None, t, "", "", ""), (3, "x" + t, "", "", "")], SCHEMA)
    got = sorted(((x.doc_id, x.n_removed, len(x.kept)) for x in S.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, 0, 300), (1, 0, 300), (2, 0, 0), (None, 0, 300), (3, 300, 1)], key=str)
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_suffix_ranks():
    b = np.frombuffer(b"abracadabra" * 3, np.uint8)
    r = S.suffix_ranks(b, 7)
    keys = [bytes(b[i : i + 7]) for i in range(len(b) - 6)]
    assert all((keys[i] < keys[j]) == (r[i] < r[j]) and (keys[i] == keys[j]) == (r[i] == r[j]) for i in range(len(keys)) for j in range(len(keys)))
