import re

import corpus_pipeline as C
from rootscope.llm import language_id, line_dedup, near_dedup, packing, secret_scan


def test_stages(spark, tmp_path):
    en = "the house of the water and that with this from the other side of it all"
    texts = [(1, f"{en} one\n{en} in other words said again"), (2, f"{en} one\nsomething of its own and that is the end of the matter here"), (3, None), (4, "12345"), (5, "password=hunter2x5 and that is the word of the house with the water"), (6, f"{en} one\n{en} in other words said again")]
    more = [(100 + i, " ".join(f"{w}{i}" for w in en.split()) + " the of and", ) for i in range(30)]
    rows = [(d, t, "en" if t else None, f"s{d % 3}", len(t or "")) for d, t in texts + more]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} >= {1, 2, 5} and not {3, 4, 6} & {r.doc_id for r in got}
    # the same by the operators themselves, on tables made by hand between them
    docs = df
    for (name, stage), step in zip(C.STAGES[:-1], (language_id.keep_identified, line_dedup.dedup_lines, near_dedup.keep_one_of_each, secret_scan.mask_secrets), strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns, name
        assert sorted(map(str, out.collect())) == sorted(map(str, step(docs).collect()))
        docs = spark.createDataFrame(out.collect(), df.schema)
    by = {r.doc_id: r.text for r in docs.collect()}
    assert by[2] == "something of its own and that is the end of the matter here" and by[5].startswith("<secret> and")
    want = {(r.doc_id, r.piece, r.n_tokens) for r in packing.pack(docs).collect()}
    assert {(r.doc_id, r.piece, r.n_tokens) for r in got} == want
    assert all(r.n_tokens == len(re.findall(r"[^ \t-\r]+", by[r.doc_id])) + 1 for r in got)


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, gone string, hub string, piece string"


def test_stages_on_odd_rows(spark, tmp_path):
    """Each stage on an empty table, and on nulls, repeated rows, a very long text and columns that clash with its own."""
    en = "the house of the water and that with this from the other side of it all"
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (None, en, "en", "a", 5), (3, en, None, "b", 5), (3, en, None, "b", 5), (4, f"{en} {en} token=abcdef{1}", "en", "a", 5), (5, f"{en}\n" * 3000, "en", "c", 5)]
    df = spark.createDataFrame([(*r, "k", "g", "h", "p") for r in rows], ODD)
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, df.limit(0), "").count() == 0
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        kept = out.collect()
        assert {(r.key, r.gone, r.hub, r.piece) for r in kept} <= {("k", "g", "h", "p")}
        if name != "language_id":  # equal rows fare alike; the rows without an id stay
            assert sum(r.doc_id == 3 for r in kept) in (0, 2) and sum(r.doc_id is None for r in kept) == 2
        if name == "secret_scan":
            assert len(kept) == len(rows) and {r.doc_id: r.text for r in kept}[4].endswith("<secret>")
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in kept if r.doc_id == 3} == {3: en}
    assert C.packed(spark, df.limit(0), "").count() == 0 and {r.doc_id for r in C.packed(spark, df, "").collect()} == {None, 1, 2, 3, 4, 5}
    df.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
