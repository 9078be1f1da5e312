import base64

import numpy as np
import public_tokenizers as P
import tiktoken

from rootscope.llm import bpe

TEXTS = [None, "", " ", "don't we'LL 12 ١٢", "aaaaaaa" * 3000, "é" * 300, "<|endoftext|>", "日本語テキスト 😀😀 x", "a\x1c \x1d\x85\x0b\x0c b", "  a  b\n\n c\t", "x" * 40 + "Zq" * 99, "threwh thndones of arethth"]


def test_against_tiktoken(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*TEXTS, *TEXTS])], "doc_id long, text string, ids string, decoded string")
    got = {r.doc_id: r for r in bpe.encode(df, path, P.PATTERN, decoded=True).collect()}
    for i, t in enumerate([*TEXTS, *TEXTS]):
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == enc.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()
    empty = bpe.encode(df.limit(0), path, P.PATTERN)
    assert empty.columns == ["doc_id", "ids"] and empty.count() == 0


def test_perfect_hash():
    keys = [str(i).encode() for i in range(2000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(2000))
    assert all(h.slot(str(i).encode()) == -1 for i in range(2000, 3000))


def test_memo_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 2 * bpe.ENTRY + 60)

    class One:
        calls = 0

        def encode_piece(self, piece):
            self.calls += 1
            return [len(piece)] * len(piece)

    coder = One()
    memo = bpe.Memo(coder)
    want = lambda p: len(p).to_bytes(4, "little") * len(p)
    for piece in ["a", "bb", "ccc", "a", "bb"]:  # the third one turns the memo, within one text as well
        assert memo[piece] == want(piece)
    assert coder.calls == 3
    for k in range(1000):
        assert memo[f"{k:05d}"] == want("00000") and memo.size <= bpe.MEMO and len(memo) + len(memo.old) <= 6
    before = len(memo)
    assert memo["x" * 100_000] == want("x" * 100_000) and len(memo) == before
