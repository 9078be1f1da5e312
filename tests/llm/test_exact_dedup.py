import hashlib
import re

from rootscope.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, digest string, keep_id string, kept string, item int"


def test_groups(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (4, " "), (7, "c"), (7, "c"), (None, "c"), (None, "only"), (8, "x" * 200_000)]
    rows += [(100 + i, "hot text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame([(d, t, "x", "y", "z", 1) for d, t in rows], SCHEMA).repartition(5)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_dedup(df, counters=16).collect()), key=str)
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    want = []
    for d, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((d, keep, len(g), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert E.exact_dedup(df.limit(0)).count() == 0
