"""Time order and lagged correlation of services, and the fused rank; with `by`, within each incident."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import rounded
from ..sources.shared import cut
from .incidents import beside, keys, packed, unpacked
from .order import numbered


def temporal_order(spans: DataFrame, alerts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """service, first_seen, idx: alerted services by their earliest span, idx from 0; ties by name."""
    k = keys(by)
    alerted = packed(alerts, by).select(*k, "service").distinct()
    s = packed(spans.select(*by, F.col("service_name").alias("service"), "start_time"), by).join(alerted, [*k, "service"], "left_semi")
    first = s.groupBy(*k, "service").agg(F.min("start_time").alias("first_seen"))
    return unpacked(first.withColumn("idx", F.row_number().over(Window.partitionBy(*k).orderBy("first_seen", "service")) - 1), by)


#: Places of the series that are set side by side at a time.
BLOCK = 4096
#: Services of a part, about: a task sets two parts side by side at most.
PART = 128


def _block_moments(lag: int, size: int, k: Sequence[str], schema):
    """Of one block of places and two parts of services (columns block, low, high, part, service, d, pos, n): for each pair (a at a place, b `lag` later) the number of places, means and sums of centred squares and products.

    Where the parts differ, only pairs across them.
    """

    def moments(rows: pa.Table) -> pa.Table:
        start = rows.column("block")[0].as_py() * size  # places before the block
        names = rows.column("service").combine_chunks().dictionary_encode()
        code, names = names.indices.to_numpy(), np.array(names.dictionary.to_pylist(), dtype=object)
        at = np.zeros((len(names), size + lag))
        at[code, rows.column("pos").to_numpy() - 1 - start] = rows.column("d").to_numpy()
        n = np.zeros(len(names), dtype=np.int64)
        n[code] = rows.column("n").to_numpy()
        part = np.zeros(len(names), dtype=np.int64)
        part[code] = rows.column("part").to_numpy()
        across = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
        long = np.clip(n - lag - start, 0, size)  # places of the block at which a service may lead or follow
        out = []
        for m in np.unique(long[long > 0]):
            own, over = np.flatnonzero(long == m), np.flatnonzero(long > m)
            for xs, ys in ((own, own), *([(own, over), (over, own)] if len(over) else [])):
                x, y = at[xs, :m], at[ys, lag : lag + m]
                mx, my = x.mean(1), y.mean(1)
                x, y = x - mx[:, None], y - my[:, None]
                i, j = (g.ravel() for g in np.meshgrid(np.arange(len(xs)), np.arange(len(ys)), indexing="ij"))
                xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x @ y.T).ravel()
                keep = part[xs[i]] != part[ys[j]] if across else xs[i] != ys[j]
                cols = names[xs[i]], names[ys[j]], np.minimum(n[xs[i]], n[ys[j]]), np.full(len(i), float(m)), mx[i], my[j], xx[i], yy[j], xy
                out.append([c[keep] for c in cols])
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 9
        same = [pa.chunked_array([pa.array([rows.column(c)[0].as_py()] * len(cols[0]), rows.column(c).type)]) for c in k]
        return pa.table([*same, *(pa.array(c, t) for c, t in zip(cols, [pa.string()] * 2 + [pa.int64()] + [pa.float64()] * 6, strict=True))], names=schema.names)

    return moments


def _correlations(s: DataFrame, lag: int, k: Sequence[str]) -> DataFrame:
    """a, b, c, n: the correlation of a's values with those of b `lag` places later, as far as both lie in the first n, the lesser length. s: service, part of parts, d, pos, n.

    A block of places goes to one task with the `lag` places after it, once for each two parts of the services; moments of blocks are put together around the means of the whole.
    """
    size = max(BLOCK, lag)
    block = F.floor((F.col("pos") - 1) / size)
    too = F.when((block > 0) & (F.pmod(F.col("pos") - 1, F.lit(size)) < lag), F.array(block, block - 1)).otherwise(F.array(block))
    schema = T.StructType([s.schema[c] for c in k] + [T.StructField(c, T.StringType()) for c in "ab"] + [T.StructField("n", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("m", "mx", "my", "xx", "yy", "xy")])
    m = s.withColumn("block", F.explode(too)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    m = m.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other", "parts")
    m = m.groupBy(*k, "block", "low", "high").applyInArrow(_block_moments(lag, size, k, schema), schema)
    m, pair = cut(m, "moments"), [*k, "a", "b"]
    mean = lambda c: (F.sum(F.col("m") * F.col(c)) / F.sum("m")).alias(f"{c}_all")
    m = m.join(m.groupBy(*pair).agg(mean("mx"), mean("my")), pair).select(*pair, "n", "m", "xx", "yy", "xy", (F.col("mx") - F.col("mx_all")).alias("dx"), (F.col("my") - F.col("my_all")).alias("dy"))
    whole = lambda own, p, q: F.sum(F.col(own) + F.col("m") * F.col(p) * F.col(q)) / F.sum("m")
    g = m.groupBy(*pair).agg(F.max("n").alias("n"), whole("xy", "dx", "dy").alias("cov"), F.sqrt(whole("xx", "dx", "dx")).alias("sx"), F.sqrt(whole("yy", "dy", "dy")).alias("sy"))
    c = F.try_divide("cov", F.when((F.col("sx") > 1e-9) & (F.col("sy") > 1e-9), F.col("sx") * F.col("sy")))
    return g.select(*pair, F.coalesce(c, F.lit(0.0)).alias("c"), "n")


def lagged_strength(spans: DataFrame, services: DataFrame, lag: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """a, b, strength for ordered pairs of the services: how much more a's durations lead b's than the reverse, 0 to 1.

    Series are in order of arrival (ingest_seq). Of two, the first n = least length count; under max(lag + 2, 5) or
    for constant series the strength is 0. Places are given by ranges, so that no task sorts a service; pairs meet in blocks of
    places and parts of services, so that no task holds all pairs of a long list.
    """
    k = keys(by)
    names = cut(packed(services, by).select(*k, "service").distinct(), "services")
    parts = names.groupBy(*k).agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = beside(names, parts, by).withColumn("part", F.pmod(F.xxhash64("service"), F.col("parts")))
    s = packed(spans.select(*by, F.col("service_name").alias("service"), F.coalesce("duration_ms", F.lit(0.0)).alias("d"), "ingest_seq"), by).join(dealt, [*k, "service"])
    c = cut(_correlations(numbered(s, [*k, "service"], ["ingest_seq"]).drop("ingest_seq"), lag, k), "correlations")
    r = c.select(*k, F.col("a").alias("b"), F.col("b").alias("a"), F.col("c").alias("r"))
    left, right = names.select(*k, F.col("service").alias("a")), names.select(*k, F.col("service").alias("b"))
    pairs = (left.join(right, k) if by else left.crossJoin(right)).filter("a <> b")  # they are the result's rows
    p = pairs.join(c, [*k, "a", "b"], "left").join(r, [*k, "a", "b"], "left")
    lead = (F.col("c") - F.col("r")) / F.greatest(F.abs("c") + F.abs("r"), F.lit(1e-9))
    ok = (F.col("n") >= max(lag + 2, 5)) & (F.col("c") > F.col("r")) & (F.col("c") > 0)
    return unpacked(p.select(*k, "a", "b", rounded(F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), lead))).otherwise(F.lit(0.0)), 4).alias("strength")), by)


def causal_totals(strengths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """service, score: strengths summed over the others, over the greatest sum."""
    k = keys(by)
    s = packed(strengths, by).groupBy(*k, F.col("a").alias("service")).agg(F.sum("strength").alias("sum"))
    top = s.groupBy(*k).agg(F.max("sum").alias("top"))
    return unpacked(beside(s, top, by).select(*k, "service", F.when(F.col("top") > 0, rounded(F.try_divide("sum", "top"), 4)).otherwise(F.lit(0.0)).alias("score")), by)


def fuse_rank(cands: DataFrame, order: DataFrame, causal: DataFrame, w_conf: float = 0.5, w_time: float = 0.25, w_cause: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """Ranked candidates with `combined` of confidence, time order and causal score; ranked anew, ties by the old rank."""
    k = keys(by)
    cands, order, causal = (packed(x, by) for x in (cands, order, causal))
    n = order.groupBy(*k).agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    c = cands.join(order.select(*k, "service", "idx"), [*k, "service"], "left").join(causal.select(*k, "service", F.col("score").alias("cause")), [*k, "service"], "left")
    early = F.when(F.col("idx").isNotNull(), 1 - F.col("idx") / F.col("n")).otherwise(F.lit(0.0))
    c = beside(c, n, by).withColumn("combined", rounded(w_conf * F.col("confidence") + w_time * early + w_cause * F.coalesce("cause", F.lit(0.0)), 6))
    return unpacked(c.withColumn("rank", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("combined"), "rank"))).drop("idx", "cause", "n"), by)
