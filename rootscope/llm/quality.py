"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text becomes WIDTH numbers: its length, shares of kinds of bytes, words that repeat, lengths of words, lines and sentences. Seeded
random cosines of the standardised numbers approximate a Gaussian kernel. Every partition of the labelled rows sums its part of
the normal equations, those sums are summed in two levels, and the driver solves a system whose size is fixed. Equations
are kept apart by fold, so that each labelled row also has a score of a model that hasn't seen it; isotonic regression of
the labels on those scores, counted in steps, turns scores into shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut
from .tokens import chunks, words

#: Cosines, ridge penalty (of the mean squared error), kernel width (times the root of the number of statistics), folds, steps of a score, seed.
FEATURES, RIDGE, SPREAD, FOLDS, STEPS, SEED = 256, 1e-4, 1.0, 4, 1000, 12
#: Scores below this are predicted as low quality.
THRESHOLD = 0.3

_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".", ",", "!?", ";:'\"()-", "|", "#$%&*@^~+=<>[]{}\\/_`"]
_KIND = np.full(256, len(_KINDS), np.uint8)  # what isn't listed: control characters
_KIND[128:] = len(_KINDS) + 1
for _k, _chars in enumerate(_KINDS):
    _KIND[[ord(c) for c in _chars]] = _k
_N_KINDS = len(_KINDS) + 2
WIDTH = _N_KINDS + 11


def _statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[texts, WIDTH] of the texts of a chunk."""
    n = len(at) - 1
    hashes, first = words(data, at)
    kinds = _KIND[data]
    out = np.zeros((n, WIDTH))
    for i in range(n):
        h, b = hashes[first[i] : first[i + 1]], kinds[at[i] : at[i + 1]]
        count = np.bincount(b, minlength=_N_KINDS)
        size, n_words, lines, ends = max(1, len(b)), max(1, len(h)), count[4] + 1, count[5] + count[7]
        letters = count[0] + count[1] + count[-1]
        out[i, :_N_KINDS] = count / size
        uses = np.unique(h, return_counts=True)[1] if len(h) else np.ones(1)
        pairs = h[1:] * np.uint64(31) + h[:-1]
        change = np.flatnonzero(b[1:] != b[:-1]) if len(b) > 1 else b
        out[i, _N_KINDS:] = (
            math.log1p(len(b)), math.log1p(len(h)), letters / n_words, len(uses) / n_words, uses.max() / n_words,
            np.mean(h[1:] == h[:-1]) if len(h) > 1 else 0.0, len(np.unique(pairs)) / max(1, len(pairs)), math.log1p(n_words / lines),
            math.log1p(n_words / (ends + 1)), count[1] / max(1, letters), len(change) / size,
        )
    return out


def statistics(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns of keep, and stats: WIDTH numbers of each row's whole text (null: empty)."""
    schema, n_kept = docs.select(*keep).schema, len(keep)
    schema = schema.add("stats", ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(batch.num_columns - 1)):
                flat = pa.array(_statistics(data, at).astype(np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * WIDTH), flat)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(n_kept)), lists], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), WIDTH)


class Kernel:
    """Standardisation and the seeded cosines."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = rng.normal(0, 1 / (SPREAD * math.sqrt(WIDTH)), (WIDTH, FEATURES))
        self.shift = rng.uniform(0, 2 * math.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.turn + self.shift) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))], axis=1)


def _summed(rows: DataFrame) -> DataFrame:
    """fold, size, gram, moment: the sums of such rows; a task holds one sum for each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                one = [batch.column(c)[i].as_py() for c in range(4)]
                new = [one[1], np.frombuffer(one[2]), np.frombuffer(one[3])]
                old = total.get(one[0])
                total[one[0]] = new if old is None else [a + b for a, b in zip(old, new, strict=True)]
        yield from _equations(total)

    return rows.mapInArrow(run, _EQUATIONS)


_EQUATIONS = "fold int, size double, gram binary, moment binary"


def _equations(total: dict[int, list]) -> Iterator[pa.RecordBatch]:
    for fold, (size, gram, moment) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([float(size)]), pa.array([gram.tobytes()]), pa.array([moment.tobytes()])], names=["fold", "size", "gram", "moment"])


def normal_equations(labelled: DataFrame, kernel: Kernel) -> dict[int, list]:
    """size, gram matrix and moments of each fold, from labelled rows (fold, weight, label, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            fold, weight, label = (np.array(batch.column(c), np.float64) for c in range(3))
            z = kernel(_matrix(batch.column(3)))
            for k in np.unique(fold):
                own = fold == k
                zw = z[own] * weight[own][:, None]
                new = [weight[own].sum(), (zw.T @ z[own]).ravel(), zw.T @ label[own]]
                total[int(k)] = [a + b for a, b in zip(total[int(k)], new, strict=True)] if int(k) in total else new
        yield from _equations(total)

    parts = cut(labelled.select("fold", "weight", "label", "stats").mapInArrow(run, _EQUATIONS), "equations")
    middle = _summed(parts.repartition(max(1, math.isqrt(parts.count()))))
    return {r["fold"]: [r["size"], np.frombuffer(r["gram"]).reshape(FEATURES + 1, -1), np.frombuffer(r["moment"])] for r in _summed(middle.repartition(FOLDS, "fold")).collect()}


def solve(parts: list[list]) -> np.ndarray:
    """Ridge weights from summed equations; the constant isn't penalised."""
    size, gram, moment = (sum(x) for x in zip(*parts, strict=True))
    penalty = np.full(FEATURES + 1, RIDGE * size)
    penalty[-1] = 1e-9 * size
    return np.linalg.solve(gram + np.diag(penalty), moment)


def isotonic(score: np.ndarray, weight: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and shares of the blocks that pooling of adjacent violators leaves, from mean labels in order of score."""
    blocks: list[list[float]] = []
    for s, w, y in zip(score, weight, label, strict=True):
        blocks.append([s, w, y])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, (a[2] * a[1] + b[2] * b[1]) / w])
    return np.array([b[0] for b in blocks]), np.clip([b[2] for b in blocks], 0, 1)


class Model:
    """A kernel, ridge weights and the calibration; without labelled rows every score is 0.5."""

    def __init__(self, kernel: Kernel, weights: np.ndarray | None, steps: tuple[np.ndarray, np.ndarray] | None):
        self.kernel, self.weights, self.steps = kernel, weights, steps

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.steps is None:
            return np.full(len(x), 0.5)
        return np.interp(self.kernel(x) @ self.weights, *self.steps)


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """A model of all rows of stats (doc_id, stats) that labels (doc_id, quality) marks.

    Each label row counts once for each row of its document; null ids and null labels don't count. Labels are taken as numbers from 0 to 1.
    """
    x = [F.col("stats")[i].cast("double") for i in range(WIDTH)]
    moments = stats.agg(*(F.avg(c) for c in x), *(F.stddev_pop(c) for c in x)).first()
    moments = np.array([v or 0.0 for v in moments])
    kernel = Kernel(moments[:WIDTH], moments[WIDTH:])
    y = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("quality").cast("double")))
    marks = labels.select("doc_id", y.alias("y")).dropna().groupBy("doc_id").agg(F.count("*").cast("double").alias("weight"), F.avg("y").alias("label"))
    fold = F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string")) / 5), F.lit(FOLDS)).cast("int")
    labelled = cut(stats.join(marks, "doc_id").select(fold.alias("fold"), "weight", "label", "stats"), "labelled")
    sums = normal_equations(labelled, kernel)
    if not sums:
        return Model(kernel, None, None)
    unseen = {k: solve([v for j, v in sums.items() if j != k] or [sums[k]]) for k in sums}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, folds = kernel(_matrix(batch.column(3))), np.array(batch.column(0), np.int64)
            score = np.array([z[i] @ unseen[k] for i, k in enumerate(folds.tolist())], np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(score), batch.column(1), batch.column(2)], names=["score", "weight", "label"])

    told = labelled.mapInArrow(run, "score double, weight double, label double")
    step = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("score"))) * STEPS)
    w = F.col("weight")
    counted = told.groupBy(step.alias("step")).agg(F.sum(w).alias("n"), (F.sum(w * F.col("score")) / F.sum(w)).alias("at"), (F.sum(w * F.col("label")) / F.sum(w)).alias("share"))
    c = counted.orderBy("step").toPandas()  # at most 3 * STEPS + 1 rows
    return Model(kernel, solve(list(sums.values())), isotonic(c["at"].to_numpy(), c["n"].to_numpy(), c["share"].to_numpy()))


def classify(stats: DataFrame, model: Model) -> DataFrame:
    """The columns of stats but the last, score (0 to 1) and predicted (1 from THRESHOLD on). The model has a fixed size."""
    kept = stats.columns[:-1]
    schema = stats.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(len(kept))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(kept))), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=schema.names)

    return stats.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, learned from the labels of documents that aren't held out.

    Only the whole text decides a score; null texts count as empty, and rows that repeat fare alike. Rows with a null id are
    scored too and never learned from. The statistics of each text are made once and written; labels meet those.
    """
    stats = cut(statistics(docs, [F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out")], text_col), "stats")
    model = train(stats.filter("NOT held_out").select("doc_id", "stats"), labels.select(F.col("doc_id"), F.col("quality")))
    return classify(stats, model)
