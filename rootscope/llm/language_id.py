"""Language ID by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams tells the languages whose
bit is 1 from the others (log-odds of their n-gram shares, summed from the counts of all labelled rows). A text's
margins are compared with each codeword by a logistic loss, bits weighted by how far apart their two sides are;
the codeword of least loss wins, and a text whose two best codewords are close is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import chunks

#: Hash buckets of the n-grams; a model has languages x BUCKETS counts.
BUCKETS = 1 << 13
#: Languages that a model may have: what the driver and each task hold. ISO 639-1 names 184.
LANGUAGES = 256
#: Of a text whose best codeword's share of the score is less, the language is open.
AMBIGUOUS = 0.6
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[x for x in range(128) if not chr(x).isalpha()]] = 32


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of a text's byte 2- and 3-grams; ASCII letters are folded to small ones, other ASCII to blanks."""
    b = _FOLD[data]
    b = np.concatenate([[np.uint32(32)], b, [np.uint32(32)]]).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    two, three = two[two != 0x2020], three[(three & 0xFFFF) != 0x2020]
    code = np.concatenate([two * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F), three * np.uint32(0x9E3779B1)])
    return (code >> np.uint32(32 - 13)).astype(np.int64)


def language_counts(labelled: DataFrame, text_col: str, lang_col: str) -> pd.DataFrame:
    """lang, bucket, n over every labelled row: at most LANGUAGES x BUCKETS rows, the only thing that the driver sees. More labels are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, data, at in chunks(batch.column(0)):
                for i in range(hi - lo):
                    one = total.setdefault(langs[lo + i], np.zeros(BUCKETS, np.int64))
                    one += np.bincount(grams(data[at[i] : at[i + 1]]), minlength=BUCKETS)
        for lang, n in total.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(b), pa.array(n[b])], names=["lang", "bucket", "n"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    if (found := rows.select("lang").distinct().limit(LANGUAGES + 1).count()) > LANGUAGES:
        raise ValueError(f"{lang_col} has over {found - 1} values; a model holds {LANGUAGES} languages")
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. All ways to part the languages in two while they are few; else seeded random columns, one-against-rest first."""
    if n <= 6:
        cols = [[1 if m >> i & 1 else -1 for i in range(n)] for m in range(1, 1 << max(0, n - 1))]
        return np.array(cols, np.float64).T if cols else np.ones((n, 1))
    rng = np.random.default_rng(n)
    return np.concatenate([2 * np.eye(n) - 1, rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))], axis=1)


class Model:
    """Languages, their codewords, and for each bit the n-grams' log-odds and its weight."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique()) if len(counts) else []
        share = np.zeros((len(self.langs), BUCKETS))
        for i, lang in enumerate(self.langs):
            own = counts[counts["lang"] == lang]
            share[i, own["bucket"].to_numpy(np.int64)] = own["n"].to_numpy(np.float64)
        share = (share + 0.5) / (share + 0.5).sum(axis=1, keepdims=True) if len(self.langs) else share
        self.code = codewords(len(self.langs))
        if len(self.langs) < 2:
            self.odds, self.weight = np.zeros((BUCKETS, 1)), np.ones(1)
            return
        one = np.stack([share[c > 0].mean(axis=0) if (c > 0).any() else share.mean(axis=0) for c in self.code.T])
        rest = np.stack([share[c < 0].mean(axis=0) if (c < 0).any() else share.mean(axis=0) for c in self.code.T])
        self.odds = np.log(one / rest).T
        apart = ((one - rest) * np.log(one / rest)).sum(axis=1)  # mean margin of the one side less that of the other
        self.weight = apart / max(apart.sum(), 1e-12)

    def predict(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the language's number and its score: the share of exp(-loss), spread by the length of the text."""
        n = np.stack([np.bincount(grams(t), minlength=BUCKETS) for t in texts]).astype(np.float64)
        total = np.maximum(1, n.sum(axis=1, keepdims=True))
        margin = (n @ self.odds) / total
        loss = np.log1p(np.exp(-np.clip(4 * margin[:, None, :] * self.code[None], -50, 50))) @ self.weight
        near = np.exp(-np.sqrt(total) * (loss - loss.min(axis=1, keepdims=True)))
        best = loss.argmin(axis=1)
        return best, near[np.arange(len(best)), best] / near.sum(axis=1)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    return Model(language_counts(labelled, text_col, lang_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, the columns of keep, lang_pred, score (0 to 1), ambiguous.

    A text that is null or has no letter is `und` with score 0, and so is every text if no language was learned.
    The model has BUCKETS x bits numbers, of at most LANGUAGES languages, and is sent to the tasks. Only the text decides; rows are
    independent of each other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kept = [F.col(id_col).alias("doc_id"), *(keep or [])]
    head = docs.select(*kept).schema
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        vars(m).update(shared.value)
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi, data, at in chunks(batch.column(batch.num_columns - 2), 1 << 21):
                for a in range(lo, hi, 256):
                    z = min(hi, a + 256)
                    langs, scores = [None] * (z - a), [0.0] * (z - a)
                    if m.langs:
                        best, score = m.predict([data[at[i - lo] : at[i - lo + 1]] for i in range(a, z)])
                        langs, scores = [m.langs[b] for b in best], score.tolist()
                    for i in range(z - a):
                        if not letters[a + i] or langs[i] is None:
                            langs[i], scores[i] = "und", 0.0
                    part = [batch.column(c).slice(a, z - a) for c in range(len(head))]
                    more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([s < AMBIGUOUS for s in scores], pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*part, *more], names=schema.names)

    text = F.col(text_col)
    return docs.select(*kept, text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letter")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is known: `und` and ambiguous ones go. Columns stay as they are."""
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    named = [F.col(f"`{c}`") for c in docs.columns]
    inner = docs.select(*(c.alias(f"__c{k}") for k, c in enumerate(named)))
    k_id, k_text = docs.columns.index(id_col), docs.columns.index(text_col)
    told = identify(inner, model, f"__c{k_id}", f"__c{k_text}", keep=[F.col(f"__c{k}") for k in range(len(named))])
    return told.filter("lang_pred <> 'und' AND NOT ambiguous").select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)))
