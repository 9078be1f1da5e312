import hashlib
import itertools
import random
import re
import zlib

from rootscope.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, key string, seg string, copies string"
WS = " \t\n\x0b\x0c\r"


def code(role, fault):
    return (role[:1] if role[:1] in ("s", "u", "a") and role else "x") + fault


def every_edit(codes):
    """The least (cost, audit) over all edits with up to two rows put in at each place."""
    best = None
    ops = [[("D", 4, "")] if f in "bd" else [("D", 4, ""), *([("K", 3 * (f == "t"), r)]), *[("R", 3 + 3 * (f == "t"), x) for x in "ua"]] for r, f in codes]
    gap = [("", 0, "")] + [("I" * n, 3 * n, "".join(x)) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    for chosen in itertools.product(*ops):
        for put in itertools.product(gap, repeat=len(codes) + 1):
            seq = [put[0], *itertools.chain.from_iterable(zip(chosen, put[1:], strict=True))]
            if re.fullmatch("(s?(ua)+)?", "".join(x[2] for x in seq)):
                one = (sum(x[1] for x in seq), "".join(x[0] for x in seq))
                best = one if best is None or one < best else best
    return best


def forward(codes):
    """The same for long conversations: the least (cost, audit) for each state, row by row."""
    state = {0: (0, "")}

    def closed(state):
        for _ in range(3):
            for q, (c, a) in list(state.items()):
                to = 3 if q == 2 else 2
                if to not in state or (c + 3, a + "I") < state[to]:
                    state[to] = (c + 3, a + "I")
        return state

    for r, f in codes:
        new = {}
        for q, (c, a) in closed(state).items():
            due = 3 if q == 2 else 2
            more = [(q, c + 4, a + "D")]
            if f not in "bd":
                t = 3 * (f == "t")
                more.append((due, c + 3 + t, a + "R"))
                if r == "s" and q == 0:
                    more.append((1, c + t, a + "K"))
                if r == {2: "u", 3: "a"}[due]:
                    more.append((due, c + t, a + "K"))
            for to, cost, audit in more:
                if to not in new or (cost, audit) < new[to]:
                    new[to] = (cost, audit)
        state = new
    return min(v for q, v in closed(state).items() if q in (0, 3))


def test_search_against_every_edit():
    rng = random.Random(1)
    for n in (0, 1, 2, 2, 2, 3, 3):
        for _ in range(4):
            codes = [rng.choice("suax") + rng.choice("nnnntbd") for _ in range(n)]
            want = every_edit(codes)
            assert C.search(C.items(codes, [1] * n)) == want == forward(codes), codes


def test_search_against_forward_pass():
    rng = random.Random(2)
    for n in (5, 9, 30, 400):
        for _ in range(30 if n < 400 else 3):
            codes = [rng.choice("suuuaaax") + rng.choice("nnnnntbd") for _ in range(n)]
            best = C.search(C.items(codes, [1] * n))
            assert best == forward(codes)
            bound = C.bounds(C.items(codes, [1] * n), C.ENDS)
            assert bound[0] <= best[0]


def test_dominance_prunes(monkeypatch):
    """The search looks at far fewer nodes than there are edits."""
    codes = (["un", "an"] * 30)[:-1]
    rows = C.items(codes, [1] * len(codes))
    assert C.search(rows)[0] == 3
    looked = []
    monkeypatch.setattr(C, "_due", lambda s, real=C._due: looked.append(s) or real(s))
    C.search(rows)
    assert len(looked) < 40 * len(codes)


def brute(rows):
    """conv_id -> the contract's columns, from the given rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, t, role, text in [r for r in rows if r[0] == conv]:
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = role if role is not None else " ", text if text is not None else " "
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            after += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes = set(), []
        for _, role, text in after:
            s = text.strip(WS)
            codes.append(code(role, "b" if not s else "d" if (role, text) in seen else "n" if s[-1] in ".!?" else "t"))
            seen.add((role, text))
        cost, audit = forward(codes)
        turns = [t for t, *_ in after if t is not None]
        kept, at, state = [], 0, "a"
        for edit in audit:
            row = after[at] if edit != "I" else None
            at += edit != "I"
            if edit == "D":
                continue
            due = "u" if state != "u" else "a"
            state = row[1][0] if edit == "K" else due
            name = {"u": "user", "a": "assistant"}[due]
            kept.append((row[1] if edit == "K" else name) + ":" + (row[2] if row else ""))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
        count = lambda f: sum(c[1] == f for c in codes)  # noqa: E731, B023
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    made = C.digest(C.repair(C.damaged(df)), df)
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r)[1:] for r in made.collect()}


def table():
    rng = random.Random(4)
    say = lambda: rng.choice(["Yes.", "No!", "So", "Well. ", "", " \n", "What?\n", "Été.", "Done", "a.b", "x\ty."]) if rng.random() < 0.5 else f"Text {rng.random()}."
    rows = [(c, t, ("system" if t == 0 and c % 3 == 0 else "user" if t % 2 == (c % 3 == 0) else "assistant"), say()) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, t, rng.choice(["user", "assistant", "system", "tool", "USER", ""]), say()) for t in range(75)]
    rows += [(101, 3, None, None), (101, None, "user", "Hi."), (101, 9, "user", "Hi."), (None, 1, "user", "Hi."), (None, 2, "assistant", "x" * 50_000 + "."), (102, None, None, None), (103, 5, "user", "Same."), (103, 5, "user", "Same."), (103, 5, "user", "Same."), (103, 7, "assistant", " ")]
    rows += [(104, 1, "user", "Same."), (104, 1, "user", "Same."), (104, 2, "assistant", "Same."), (104, 2, "assistant", "Same."), (104, 2, "assistant", "Same.")]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Hi.")]


def test_against_plain_search(spark, monkeypatch):
    rows = table()
    want = brute(rows)
    assert any(w[6] == "" and w[7] == hashlib.sha256(b"").hexdigest() for w in want.values())
    assert got(spark, rows) == want
    monkeypatch.setattr(C, "SEGMENT", 4)  # most conversations are cut
    assert got(spark, rows) == want


def test_messages(spark):
    rows = [(1, 0, "user", "Hi."), (1, 2, "user", "Again."), (1, 3, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    made = C.repair(df)
    assert [tuple(r)[4:] for r in made.messages.orderBy("seg", "place", "sub").collect()] == [("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "Again."), ("K", "assistant", "Yes.")]
    one = made.summary.first()
    assert (one["audit"], one["cost"], one["gaps"]) == ("KIKK", 3, 1)


def test_empty(spark):
    assert got(spark, []) == {}
