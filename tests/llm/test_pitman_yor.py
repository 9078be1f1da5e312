import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rootscope.llm import pitman_yor as M
from rootscope.llm.tokens import END

SCHEMA = "doc_id long, text string, h string, n string, score string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(t):
    return [*re.findall(r"[^ \t-\r]+", (t or "").translate(LOW)), None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def rows():
    rng = random.Random(1)
    nxt = {w: [rng.randrange(60) for _ in range(4)] for w in range(60)}
    out = []
    for d in range(250):
        w, t = rng.randrange(60), []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(nxt[w])
            t.append(f"Word{w}" if rng.random() < 0.97 else f"rare{rng.randrange(10**6)}")
        out.append((d, " ".join(t)))
    return out + [(300, None), (301, ""), (302, "word1 " * 20_000), (303, "never seen words"), (303, "never seen words"), (None, "word2")]


@pytest.fixture
def many_parts(monkeypatch):
    """Every text in small chunks, and words and pairs over many parts and blocks."""
    monkeypatch.setattr(M, "CHUNK", 500)
    monkeypatch.setattr(M, "PART", 40)
    monkeypatch.setattr(M, "BLOCK", 4000)
    monkeypatch.setattr(M, "ROW", 20)


def test_base_and_perplexity(spark, many_parts):
    r = rows()
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in r], SCHEMA).repartition(4)
    out = M.perplexity(df).collect()
    got = sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in out), key=str)
    c = Counter(w for d, t in r if not held(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = [(d, held(d), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t)), 6)) for d, t in r]
    assert got == sorted(want, key=str)
    h = [x for x in out if x.held_out and x.n_tokens > 5 and x.doc_id < 300]
    assert len(h) > 20 and sum(x.score for x in h) > 0.8 * sum(x.base_score for x in h)  # context helps


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(None, None, "", "", "")], SCHEMA)
    assert M.perplexity(df.limit(0)).count() == 0
    only_held = spark.createDataFrame([(d, "a b", "", "", "") for d in range(40) if held(d)], SCHEMA)
    assert all(x.base_score == 0 and math.isfinite(x.score) for x in M.perplexity(only_held).collect())


def seats_of(model):
    """For each kept sweep: tables of each pair, then of words as contexts and dishes, then in the parent; all by word hash."""
    names = {}
    for r in model.parts.of("part").collect():
        keys, rank = M.unpack(r.a).astype(np.uint64), M.unpack(r.b)
        names |= {int(k) * model.n_parts + r["at"]: int(h) for h, k in zip(keys, rank, strict=True)}
    blocks = {r["at"]: [np.cumsum(M.unpack(r.a)), M.unpack(r.b), M.unpack(r.c)] for r in model.blocks.of("block").collect()}
    out = []
    for (state, totals), seats in zip(model.states, model.seats, strict=True):
        t = {r["at"]: M.unpack(r.a) for r in seats.of("seat").collect()}
        pairs = {}
        for b, (u, w, c) in blocks.items():
            n = np.ones(len(c), np.int64)
            n[c > 1] = t[b]
            pairs |= {(names[i], names[j]): (int(x), int(y)) for i, j, x, y in zip(u, w, c, n, strict=True)}
        words = {}
        for r in state.of("state").collect():
            for k, x in enumerate(zip(M.unpack(r.a), M.unpack(r.b), M.unpack(r.c), strict=True)):
                words[names[k * model.n_parts + r["at"]]] = tuple(map(int, x))
        out.append((pairs, words, totals))
    return out


def test_score_is_the_predictive_probability_of_the_seatings(spark, many_parts):
    """Every text scored word by word from the seatings that the sweeps left, on one machine."""
    r = rows()
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in r], SCHEMA).repartition(3)
    model = M.Model(df, "doc_id", "text")
    kept = seats_of(model)
    assert model.n_blocks > 3 and model.n_parts > 3 and len(kept) == M.SWEEPS - M.BURN_IN
    code = {None: int(END)}
    for _, t in r:
        for w in toks(t)[:-1]:
            if w not in code:
                code[w] = int(M.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])
    seen = Counter(p for d, t in r if not held(d) for p in zip([code[w] for w in [None, *toks(t)[:-1]]], [code[w] for w in toks(t)], strict=True))
    n = Counter()
    for (u, _), c in seen.items():
        n[u] += c
    for pairs, words, (customers, tables) in kept:
        assert {p: c for p, (c, _) in pairs.items()} == dict(seen)
        assert all(1 <= t <= c for c, t in pairs.values())
        tu, cw = Counter(), Counter()
        for (u, w), (_, t) in pairs.items():
            tu[u] += t
            cw[w] += t
        assert all(words[w][:2] == (tu[w], cw[w]) and 1 <= words[w][2] <= cw[w] for w in words)
        assert customers == sum(cw.values()) and tables == sum(x[2] for x in words.values())

    def p(u, w):
        out = 0.0
        for pairs, words, (customers, tables) in kept:
            _, cw, tw = words.get(w, (0, 0, 0))
            base = (cw - model.d0 * tw + (M.THETA + model.d0 * tables) * model.b) / (M.THETA + customers)
            c, t = pairs.get((u, w), (0, 0))
            out += (c - model.d * t + (M.THETA + model.d * words.get(u, (0, 0, 0))[0]) * base) / (M.THETA + n[u])
        return out / len(kept)

    want = [(d, round(sum(math.log10(p(code[u], code[w])) for u, w in zip([None, *toks(t)[:-1]], toks(t), strict=True)), 6)) for d, t in r]
    assert sorted(((x.doc_id, round(x.score, 6)) for x in model.score().collect()), key=str) == sorted(want, key=str)
    every = list(kept[0][1])
    for u in [*every[:20], -1]:  # a distribution over all words and the unknown one, after known and unknown contexts
        assert abs(sum(p(u, w) for w in every) + p(u, -2) - 1) < 1e-9


def test_rare_pairs_keep_their_identity(spark):
    own, other = [d for d in range(400) if not held(d)][:200], [d for d in range(400) if held(d)][:2]
    # rare words of equal counts: left{k} is always followed by right{k}
    texts = [(d, f"the of and left{d % 40} right{d % 40} the of and") for d in own]
    texts += [(other[0], "left7 right7"), (other[1], "left7 right8")]
    by = {x.doc_id: x.score for x in M.perplexity(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert by[other[0]] > by[other[1]] + 1


def exact(c, a, d):
    """Weights of t tables of c customers: all seatings, customer by customer, a for a table and size - d for a seat."""
    weight = Counter({(1,): a})
    for _ in range(c - 1):
        nxt = Counter()
        for sizes, w in weight.items():
            nxt[tuple(sorted((*sizes, 1)))] += w * a
            for i, n in enumerate(sizes):
                nxt[tuple(sorted((*sizes[:i], n + 1, *sizes[i + 1 :])))] += w * (n - d)
        weight = nxt
    out = np.zeros(c + 1)
    for sizes, w in weight.items():
        out[len(sizes)] += w
    return out / out.sum()


@pytest.mark.parametrize("row", [12, 4])
def test_drawn_tables_follow_their_distribution(monkeypatch, row):
    """Up to ROW customers from the whole distribution, beyond by Metropolis steps."""
    monkeypatch.setattr(M, "ROW", row)
    d, rng = 0.6, np.random.default_rng(1)
    logs = M.stirling(d, row)
    for c, a in ((2, 0.8), (7, 0.8), (9, 3.0), (9, 0.05)):
        n = 20_000
        t = None
        for _ in range(6 if c > row else 1):
            t = M.draw(np.full(n, c), np.full(n, a), d, logs, rng, t)
        assert np.abs(np.bincount(t, minlength=c + 1) / n - exact(c, a, d)).max() < 0.02


def test_process_tables_follow_the_process():
    d, rng, n, c = 0.7, np.random.default_rng(2), 20_000, 30
    got = M.process_tables(np.full(n, c), np.full(n, 2.0), d, M.stirling(d, M.ROW), rng).mean()
    t = np.ones(n)
    for i in range(1, c):
        t += rng.random(n) < (2.0 + d * t) / (2.0 + i)
    assert abs(got - t.mean()) < 0.1


def test_tilted_stable_has_its_transform():
    keys = M.keys_of(np.arange(100_000), 4)
    for d, a in ((0.5, 0.3), (0.8, 2.5), (0.2, 1.0), (0.95, 7.0)):
        s = M.tilted_stable(np.full(100_000, a), d, keys)
        for x in (0.2, 1.0, 5.0):
            assert abs(np.exp(-x * s).mean() - math.exp(-a * ((1 + x) ** d - 1))) < 0.006


def test_gamma_has_its_moments():
    keys = M.keys_of(np.arange(200_000), 9)
    for shape in (0.05, 0.6, 1.0, 3.5, 4000.0):
        x = M.gamma(np.full(len(keys), shape), keys)
        assert abs(x.mean() / shape - 1) < 0.03 and abs(x.var() / shape - 1) < 0.06
        assert (M.gamma(np.full(5, shape), keys[7:12]) == x[7:12]).all()  # an id's variable, whoever draws it


def rising(theta, d, n):
    return math.prod(theta + d * i for i in range(n))


@pytest.mark.parametrize("d, d0", [(0.5, 0.5), (0.7, 0.3), (0.3, 0.8)])
def test_sweeps_draw_from_the_posterior(d, d0):
    """Two contexts that share dishes: tables settle at what all seatings of both levels, weighed one by one, give."""
    cells = [(0, 0, 3), (0, 1, 1), (1, 0, 2), (1, 1, 2)]  # context, dish, customers
    b, dishes = 1 / 3, 2
    logs, logs0 = M.stirling(d, 8), M.stirling(d0, 16)
    want, total = np.zeros(len(cells) + dishes), 0.0
    for t in itertools.product(*(range(1, c + 1) for *_, c in cells)):
        weight = math.prod(math.exp(logs[c, x - 1]) for (*_, c), x in zip(cells, t, strict=True))
        for u in (0, 1):
            weight *= rising(M.THETA, d, sum(x for (v, *_), x in zip(cells, t, strict=True) if v == u))
        cw = [sum(x for (_, w, _), x in zip(cells, t, strict=True) if w == k) for k in range(dishes)]
        for tw in itertools.product(*(range(1, c + 1) for c in cw)):
            full = weight * rising(M.THETA, d0, sum(tw)) / rising(M.THETA, 1, sum(cw)) * math.prod(math.exp(logs0[c, x - 1]) * b**x for c, x in zip(cw, tw, strict=True))
            want += full * np.array([*t, *tw])
            total += full
    want /= total

    # many copies of the case at once, each with its own parent: what the parts and blocks of a sweep do
    n, rng = 20_000, np.random.default_rng(5)
    u, w, c = (np.array(x) for x in zip(*cells, strict=True))
    t, got, kept = np.ones((n, len(cells)), np.int64), np.zeros(len(want)), 0
    z0, tilt = rng.gamma(M.THETA / d0 + 2, size=n), None
    by = lambda x, of, k: np.stack([x[:, of == i].sum(axis=1) for i in range(k)], axis=1)
    for turn in range(60):
        cw, tu = by(t, w, dishes), by(t, u, 2)
        tw = M.draw(cw.ravel(), np.repeat(d0 * z0 * b, dishes), d0, logs0, rng).reshape(n, dishes)
        if turn >= 15:
            got, kept = got + np.concatenate([t, tw], axis=1).mean(axis=0), kept + 1
        tilt = 1 + rng.gamma(cw.sum(axis=1)) / rng.gamma(M.THETA, size=n) if tilt is None else tilt
        z0 = rng.gamma(M.THETA / d0 + tw.sum(axis=1))
        zeta = z0 / tilt**d0
        m = M.masses(cw.ravel(), tw.ravel(), np.repeat(z0 * b, dishes), d0, M.keys_of(np.arange(n * dishes), 2 * turn)).reshape(n, dishes)
        mass = m.sum(axis=1) + M.tilted_stable(z0 * b, d0, M.keys_of(np.arange(n), 2 * turn + 1))
        z = rng.gamma(M.THETA / d + tu)
        t = M.draw(np.tile(c, n), (d * z[:, u] * m[:, w] / mass[:, None]).ravel(), d, logs, rng).reshape(n, -1)
        tilt = 1 + rng.gamma(t.sum(axis=1)) * tilt / mass
        z0 = zeta * tilt**d0
    assert np.abs(got / kept / want - 1).max() < 0.005


def test_arrays_travel_whole():
    for x in (np.array([], np.int64), np.array([-1, 300]), np.array([0, 2**40]), np.array([0.5, 1e-300]), np.array([2**64 - 1, 0], np.uint64)):
        assert (M.unpack(M.pack(x)) == x).all()
