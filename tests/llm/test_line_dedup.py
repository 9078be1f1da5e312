import hashlib
import random

from rootscope.llm import line_dedup as L

SCHEMA = "doc_id long, text string, key string, me string, lk string"
BLANKS = " \t\n\x0b\x0c\r"


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, edits=1):
    lines = sorted((d, p, x.strip(BLANKS)) for d, t in rows if d is not None for p, x in enumerate((t or "").split("\n")) if len(x.strip(BLANKS)) >= L.MIN_CHARS)
    gone = {}
    for k, (d, p, x) in enumerate(lines):
        if any(x == y or edits and within_one(x, y) for _, _, y in lines[:k]):
            gone.setdefault(d, []).append(p)
    return gone


def got(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)
    return {r.doc_id: [int(p) for p in r.removed.split(",") if p] for r in L.digest(df, **more).collect() if r.removed}, df


def mutated(rng, line):
    i, kind = rng.randrange(len(line)), rng.randrange(4)
    c = rng.choice("abcdé日")
    return [line[:i] + c + line[i + 1 :], line[:i] + line[i + 1 :], line[:i] + c + line[i:], line[: i // 2] + "x" + line[i // 2 : i] + line[i + 1 :]][kind]


def test_against_all_pairs(spark):
    rng = random.Random(7)
    pool = ["".join(rng.choice("ab é日") for _ in range(rng.randrange(14, 60))) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randrange(4))]
        rows.append((d, "\n".join(mutated(rng, mutated(rng, x)) if rng.random() < 0.3 else mutated(rng, x) if rng.random() < 0.6 else " " + x + "\t" for x in lines)))
    found, _ = got(spark, rows)
    assert found == brute(rows) and len(found) > 10
    plain, _ = got(spark, rows, max_edits=0)
    assert plain == brute(rows, 0)


def test_templates_share_halves(spark):
    rows = [(d, f"the same long beginning of a line {d:03d} and its same long end") for d in range(120)]
    assert got(spark, rows)[0] == brute(rows)


def test_odd_rows(spark):
    same = "a line that is long enough"
    rows = [(None, same), (1, None), (2, ""), (3, "\n\n"), (4, same), (4, same), (5, same), (6, "short\nshort"), (7, "b" * 100_000), (8, "b" * 99_999 + "c")]
    found, df = got(spark, rows)
    assert found == {5: [0], 8: [0]}
    kept = L.dedup_lines(df).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2, 3, 4, 4, 6, 7] and df.columns == L.dedup_lines(df).columns
    assert L.digest(df.limit(0)).count() == 0


def test_text_that_stays(spark):
    rows = [(1, "first line of some length\nshort\n  first line of some length "), (2, "x\nfirst line of sme length")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.dedup_lines(df).collect()} == {1: "first line of some length\nshort", 2: "x"}
    sha = {r.doc_id: r.kept_sha256 for r in L.digest(df).collect()}
    assert sha[2] == hashlib.sha256(b"x").hexdigest()


def test_query_and_stage_compare_short_lines(spark, tmp_path):
    import corpus_pipeline
    from rootscope.llm import queries

    rng = random.Random(11)
    rows = [(d, "\n".join("".join(rng.choice("ab{é日") for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 12, 15, 17)))) + " " * rng.randrange(2) for _ in range(3))) for d in range(60)]
    lines = sorted((d, p, x.strip(BLANKS)) for d, t in rows for p, x in enumerate(t.split("\n")) if x.strip(BLANKS))
    want = {}
    for k, (d, p, x) in enumerate(lines):
        if any(x == y or min(len(x), len(y)) > 1 and within_one(x, y) for _, _, y in lines[:k]):
            want.setdefault(d, []).append(p)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: [int(p) for p in r.removed.split(",")] for r in queries.op1_line_dedup(spark, str(tmp_path)).collect() if r.removed}
    assert found == want and len(want) > 20
    staged = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()}
    left = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want.get(d, [])) for d, t in rows}
    assert staged == {d: t for d, t in left.items() if d not in want or t.strip(BLANKS)}
