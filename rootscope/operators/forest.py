"""Isolation-forest alerts: trees are grown in tasks on seeded samples, then sent to where the rows are scored.

Samples and splits are drawn from md5 of the seed, the tree and the service or node, so a forest is the same on any
cluster, and SQL can grow it too.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detect import _alerts, detect_anomalies, ewma_baseline
from .incidents import by_incident

FEATURES = ("latency_ratio", "error_rate", "span_share", "tail_ratio", "unknown_share")
SAMPLE = 256


def _path_norm(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _uniform(*key: object) -> float:
    """A number in [0, 1) from the first 32 bits of the md5 of the key's parts, joined by colons."""
    return int(hashlib.md5(":".join(map(str, key)).encode(), usedforsecurity=False).hexdigest()[:8], 16) / 2.0**32


def _grow(x: np.ndarray, depth: int, seed: int, tree: int, node: int = 1) -> list:
    """A tree as nested lists: [size] for a leaf, [feature, cut, left, right] else. The children of a node are 2 * node and 2 * node + 1."""
    wide = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 and depth > 0 else []
    if not len(wide):
        return [len(x)]
    f = int(wide[int(_uniform(seed, tree, node, "feature") * len(wide))])
    lo, hi = float(x[:, f].min()), float(x[:, f].max())
    cut = lo + _uniform(seed, tree, node, "cut") * (hi - lo)
    low = x[:, f] < cut
    return [f, cut, _grow(x[low], depth - 1, seed, tree, 2 * node), _grow(x[~low], depth - 1, seed, tree, 2 * node + 1)]


def _flat(trees: list[list]) -> tuple[np.ndarray, ...]:
    """Nodes of all trees as arrays (feature, -1 for a leaf; cut; left and right child; what a leaf adds to the depth), and the roots."""
    rows: list[list] = []

    def put(node: list) -> int:
        at = len(rows)
        rows.append([-1, 0.0, at, at, 0.0] if len(node) > 1 else [-1, 0.0, at, at, _path_norm(node[0])])
        if len(node) > 1:
            rows[at] = [node[0], node[1], put(node[2]), put(node[3]), 0.0]
        return at

    roots = np.array([put(t) for t in trees], np.int64)
    f, c, left, right, more = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0),) * 5
    return f.astype(np.int64), c.astype(np.float64), left.astype(np.int64), right.astype(np.int64), more.astype(np.float64), roots


def _mean_depth(flat: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Mean depth of each row over the trees: all rows go down all trees level by level."""
    feature, cut, left, right, more, roots = flat
    at = np.broadcast_to(roots, (len(x), len(roots))).copy()
    depth = np.zeros(at.shape)
    while (inner := feature[at] >= 0).any():
        row, tree = np.nonzero(inner)
        node = at[row, tree]
        at[row, tree] = np.where(x[row, feature[node]] < cut[node], left[node], right[node])
        depth[row, tree] += 1
    return (depth + more[at]).mean(axis=1)


def forest_alerts(features: DataFrame, stats: DataFrame, baselines: DataFrame, trees: int = 100, contamination: float = 0.1, err: float = 0.05, seed: int = 42, raw_scores: bool = False) -> DataFrame:
    """Alerts of the services that a forest isolates first.

    The score is the isolation measure scaled to [0, 1] over the services. raw_scores: (-raw - min raw) / range as some
    tools print it, where raw is the decision value; that isn't bound to [0, 1]. Skipped: scores under 0.3 with an
    error rate under err.
    """
    spark = features.sparkSession
    cols = list(FEATURES)
    # each tree takes the SAMPLE rows whose hash with the tree's number is least: seeded, whatever the partitions are
    ids = spark.range(trees).withColumnRenamed("id", "tree")
    picks = features.select("service", *cols).crossJoin(F.broadcast(ids)).withColumn("o", F.md5(F.concat_ws(":", F.lit(seed), "tree", "service")))  # `trees` numbers
    picks = picks.withColumn("n", F.row_number().over(Window.partitionBy("tree").orderBy("o", "service"))).filter(F.col("n") <= SAMPLE)

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        x = part[cols].to_numpy(np.float64)
        tree = _grow(x, int(np.ceil(np.log2(max(2, len(x))))), seed, int(key[0]))
        return pd.DataFrame({"tree": [key[0]], "size": [len(x)], "body": [json.dumps(tree)]})

    grown = picks.groupBy("tree").applyInPandas(grow, "tree long, size long, body string").toPandas()  # `trees` rows, each of at most 2 * SAMPLE nodes
    flat, size = _flat([json.loads(b) for b in grown["body"]]), float(grown["size"].max()) if len(grown) else 1.0

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part[cols].to_numpy(np.float64)
            mean = np.concatenate([_mean_depth(flat, x[lo : lo + 4096]) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
            yield pd.DataFrame({"service": part["service"], "iso": np.power(2.0, -mean / max(_path_norm(size), 1e-9))})

    # twelve digits, so that the bar doesn't hang on the order of sums
    iso = features.select("service", *cols).mapInPandas(score, "service string, iso double").withColumn("iso", F.round("iso", 12))
    ends = iso.agg(F.min("iso").alias("lo"), F.max("iso").alias("hi"), F.expr(f"percentile(iso, {1 - contamination})").alias("bar"))
    s = iso.crossJoin(F.broadcast(ends)).withColumn("out", (F.col("iso") >= F.col("bar")) & (F.col("hi") > F.col("lo")))  # one row
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    # the decision value is bar - iso: its least is bar - hi
    value = (F.col("iso") - F.col("bar") - (F.col("bar") - F.col("hi"))) / span if raw_scores else (F.col("iso") - F.col("lo")) / span
    s = s.withColumn("score", F.round(value, 3))
    s = s.join(features.select("service", "latency_ratio", "error_rate"), "service").join(baselines.select("service", F.col("ewma_mean").alias("baseline_mean"), F.col("ewma_std").alias("baseline_std")), "service").join(stats.select("service", F.col("duration_mean_ms").alias("current_value"), "unknown_response_pct"), "service")
    z = F.coalesce(F.round(F.try_divide(F.col("current_value") - F.col("baseline_mean"), F.when(F.col("baseline_std") > 0.001, F.col("baseline_std"))), 3), F.lit(0.0))
    s = s.withColumn("z_score", z)
    kinds = F.concat_ws("+", F.when(F.abs("z_score") >= 3, F.lit("latency_spike")), F.when(F.col("error_rate") >= err, F.lit("error_rate_high")), F.when(F.col("unknown_response_pct") > 80, F.lit("unknown_response_gap")))
    s = s.withColumn("anomaly_type", F.when(kinds == "", F.lit("if_multivariate")).otherwise(kinds))
    return _alerts(s.filter(F.col("out") & ((F.col("score") >= 0.3) | (F.col("error_rate") >= err))), ())


@by_incident
def detector_choice(spans: DataFrame, mode: str = "auto", forest_from: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """span_count, detector (of each incident): the one that mode names; auto is the forest from `forest_from` spans on, else ewma."""
    if mode not in ("ewma", "forest", "auto"):
        raise ValueError(f"no detector is named {mode}")
    n = spans.groupBy(*by).agg(F.count("*").alias("span_count"))
    return n.withColumn("detector", F.when(F.col("span_count") >= forest_from, F.lit("forest")).otherwise(F.lit("ewma")) if mode == "auto" else F.lit(mode))


def detect(spans: DataFrame, stats: DataFrame, features: DataFrame, mode: str = "ewma", forest_from: int = 30, **more) -> DataFrame:
    """Alerts of the detector that mode names: ewma, forest, or auto (the forest from `forest_from` spans on)."""
    if mode not in ("ewma", "forest", "auto"):
        raise ValueError(f"no detector is named {mode}")
    baselines = ewma_baseline(spans)
    if mode == "auto":
        mode = detector_choice(spans.limit(forest_from), mode, forest_from).first()["detector"]
    return forest_alerts(features, stats, baselines, **more) if mode == "forest" else detect_anomalies(spans, stats, baselines, **more)
