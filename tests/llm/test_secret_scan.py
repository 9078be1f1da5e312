import hashlib
import re

from rootscope.llm import secret_scan as S

SCHEMA = "doc_id long, text string, source string, key string, base string, s string"
FIND = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KEY, HEX = "AKIA" + "Q1W2E3R4T5Y6U7I8", "0123456789abcdef01234567"
TEXTS = [
    (1, f"é日 token = \"{HEX}\" and {KEY}", "a"), (2, "token:token:abcdefgh PASSWORD='x' passwd=short api_key: abcdef", "a"), (3, None, "b"), (4, "", "c"), (5, f"password={'z9' * 5}", "a"), (6, f"x password={'z9' * 5} y", "b"), (7, f"password={'z9' * 5}", "c"),
    (8, "A" * 50_000 + " secret:hunter22", "a"), (9, "lonely Ab3dEf6hIj9kLm2nOp5qRs8t here", "d"), (10, "shared Zb3dEf6hIj9kLm2nOp5qRs8t", "d"), (11, "shared Zb3dEf6hIj9kLm2nOp5qRs8t", "e"), (12, "token=abcdef1", None), (12, "other token=abcdef1", "q"), (12, "other token=abcdef1", "q"), (None, "secret = qwertyuiop", "r"), (13, "no secrets", "a"),
]


def base(text):
    out = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(FIND) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return sorted(out)


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def test_contract(spark):
    got = S.digest(S.scan_secrets(frame(spark))).collect()
    assert len(got) == len(TEXTS)
    want = []
    for d, t, _ in TEXTS:
        b = base(t)
        want.append((d, *(sum(x[3] == k for x in b) for k, *_ in FIND), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in b).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r for r in got}
    # the loose kind counts while its value is live, as base kinds are
    assert by[9].spans == by[10].spans == by[11].spans == "mixed:7:31" and by[10].n_live == 1
    # three owners of a value: an example; one: live
    assert by[5].n_example == 1 and by[5].n_live == 0 and by[8].n_live == 1
    assert S.digest(S.scan_secrets(frame(spark).limit(0))).count() == 0


def test_masks(spark):
    df = frame(spark)
    out = S.mask_secrets(df)
    assert out.columns == df.columns and out.count() == len(TEXTS)
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[1] == "é日 <secret> and <secret>".replace("<secret> and", '<secret>" and')
    assert by[6] == "x <example-secret> y" and by[13] == "no secrets" and by[3] is None and by[9] == "lonely <secret> here"


def test_owners_and_repositories_decide(spark):
    """Two owners: live in few repositories, an example in very many; one owner: live in any number; three: an example."""
    loose = "Qb3dEf6hIj9kLm2nOp5qRs8t"
    rows = [(k, f"{k} token=twoowners1 {loose}", "ab"[k % 2]) for k in range(S.EXAMPLE_REPOS)]
    rows += [(100 + k, f"{k} token=twoowners2", "ab"[k % 2]) for k in range(S.EXAMPLE_REPOS - 1)]
    rows += [(200 + k, f"{k} token=oneowner1", "a") for k in range(3 * S.EXAMPLE_REPOS)] + [(300 + k, f"{k} token=threeowners", "abc"[k]) for k in range(3)]
    got = {r.doc_id: (r.n_live, r.n_example) for r in S.digest(S.scan_secrets(frame(spark, rows))).collect()}
    assert got[0] == (0, 1) and got[100] == (1, 0) and got[200] == (1, 0) and got[300] == (0, 1)  # and the loose one of doc 0 isn't added


def test_very_many_hits(spark):
    """Places in a text of more hits than one run sums up."""
    text = "é" + "".join(f"token=abcdef{k} \n" for k in range(3 * S.RUN + 1))
    got = S.digest(S.scan_secrets(frame(spark, [(1, text, "a")]))).collect()[0]
    masked = S.mask_secrets(frame(spark, [(1, text, "a")])).first().text
    assert masked == "é" + "<secret> \n" * (3 * S.RUN + 1)
    assert got.n_assign == 3 * S.RUN + 1 and got.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base(text)).encode()).hexdigest()
