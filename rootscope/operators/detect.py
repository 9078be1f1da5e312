"""Baselines, scores and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import filled, is_request, rounded
from ..sources.shared import cut
from .incidents import beside, by_incident

#: An hour in microseconds; the hour of spans without a start, before all others.
HOUR, BEFORE_ALL = 3_600_000_000, -(2**62)
ALERT = ("service", "severity", "anomaly_type", "score", "z_score", "current_value", "baseline_mean", "baseline_std", "details")


@by_incident
def latency_series(spans: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """service, d (ms), back (1 is the newest): a service's request spans if there are two at least, else all; the newest `most`.

    Ordered by (start_time, ingest_seq). Spans are counted by hour first, so that only those of the hours that hold the newest `most` of
    a service are sorted; the cut comes before anything is gathered, so that a service that owns most spans costs `most` rows.
    """
    s = spans.select(*by, F.coalesce(filled(F.col("service_name")), F.lit("unknown")).alias("service"), F.coalesce("duration_ms", F.lit(0.0)).alias("d"), F.coalesce(is_request(F.col("operation_name")), F.lit(False)).alias("req"), "start_time", "ingest_seq")
    keys = [*by, "service"]
    hour = F.coalesce(F.floor(F.col("start_time") / HOUR), F.lit(BEFORE_ALL))
    all_of, up_to = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, 0)
    n = s.groupBy(*keys, hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if("req").alias("n_req"))
    n = n.withColumn("use_req", F.sum("n_req").over(all_of) >= 2).withColumn("n", F.when(F.col("use_req"), F.col("n_req")).otherwise(F.col("n")))
    n = n.withColumn("newer", F.sum("n").over(up_to) - F.col("n")).filter(F.col("newer") < most)
    # one row for each service, written so that its size is known before it meets the spans
    since = cut(n.groupBy(*keys).agg(F.first("use_req").alias("use_req"), F.min("hour").alias("since")), "since")
    s = s.join(since, keys).filter((F.col("req") | ~F.col("use_req")) & (hour >= F.col("since")))
    newest = [F.desc("start_time"), F.desc("ingest_seq")]
    return s.withColumn("back", F.row_number().over(all_of.orderBy(*newest))).filter(F.col("back") <= most).select(*keys, "d", "back")


@by_incident
def ewma_baseline(spans: DataFrame, alpha: float = 0.3, window: int = 100, by: Sequence[str] = (), series: DataFrame | None = None) -> DataFrame:
    """service, metric, ewma_mean, ewma_std, sample_count, alpha. The variance takes the mean that the value itself has moved.

    series: latency_series of the spans, of `window` values or more, where it is at hand.
    """
    keys = [*by, "service"]
    newest = latency_series(spans, window, by=by) if series is None else series.filter(F.col("back") <= window)
    v = newest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), "d"))).alias("x"))
    v = v.withColumn("x", F.transform("x", lambda e: e["d"]))

    def step(acc: Column, d: Column) -> Column:
        m = alpha * d + (1 - alpha) * acc["m"]
        return F.struct(m.alias("m"), (alpha * (d - m) * (d - m) + (1 - alpha) * acc["v"]).alias("v"))

    fold = F.aggregate(F.slice("x", 2, window), F.struct(F.get("x", F.lit(0)).alias("m"), F.lit(0.0).alias("v")), step)
    v = v.withColumn("f", fold)
    return v.select(*keys, F.lit("duration_ms").alias("metric"), rounded(F.col("f.m"), 3).alias("ewma_mean"), rounded(F.sqrt("f.v"), 3).alias("ewma_std"), F.size("x").cast("long").alias("sample_count"), F.lit(alpha).alias("alpha"))


@by_incident
def current_latency(spans: DataFrame, n: int = 10, by: Sequence[str] = (), series: DataFrame | None = None) -> DataFrame:
    """service, current_value: mean of the newest n values of the same series."""
    newest = latency_series(spans, n, by=by) if series is None else series.filter(F.col("back") <= n)
    return newest.groupBy(*by, "service").agg(F.avg("d").alias("current_value"))


def z_score(value: Column, mean: Column, std: Column) -> Column:
    flat = F.coalesce(std, F.lit(0.0)) < 0.001
    return F.when(flat, F.when(F.abs(value - mean) > 0.001, F.lit(10.0)).otherwise(F.lit(0.0))).otherwise(rounded(F.try_divide(value - mean, std), 3))


def anomaly_score(z: Column, error_rate: Column, unknown_pct: Column) -> Column:
    zc = F.when(F.abs(z) > 2, F.least(F.lit(1.0), F.abs(z) / 10)).otherwise(F.lit(0.0))
    unk = F.when(unknown_pct > 80, F.lit(0.2)).otherwise(F.lit(0.0))
    return rounded(F.least(F.lit(1.0), 0.40 * zc + 0.45 * F.least(F.lit(1.0), error_rate * 2) + 0.15 * unk), 3)


def severity(score: Column) -> Column:
    return F.when(score >= 0.8, F.lit("CRITICAL")).when(score >= 0.6, F.lit("HIGH")).when(score >= 0.4, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def _alerts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    details = F.format_string("%s: %s detected. Current=%.1fms, Baseline=%.1fms ± %.1fms, Z-score=%.2f, Score=%.3f", "service", "anomaly_type", "current_value", "baseline_mean", "baseline_std", "z_score", "score")
    return df.withColumn("severity", severity(F.col("score"))).withColumn("details", details).select(*by, *ALERT)


@by_incident
def detect_anomalies(spans: DataFrame, stats: DataFrame, baselines: DataFrame, z: float = 3.0, err: float = 0.05, n: int = 10, by: Sequence[str] = (), series: DataFrame | None = None) -> DataFrame:
    """Alerts of services whose latency or error rate is out of bounds or whose score is over 0.3. Unknown responses alone never alert."""
    keys = [*by, "service"]
    s = stats.select(*keys, "error_rate", "unknown_response_pct", "duration_mean_ms").join(baselines.select(*keys, F.col("ewma_mean").alias("baseline_mean"), F.col("ewma_std").alias("baseline_std")), keys).join(current_latency(spans, n, by=by, series=series), keys, "left")
    s = s.withColumn("current_value", F.coalesce("current_value", "duration_mean_ms"))
    s = s.withColumn("z_score", z_score(F.col("current_value"), F.col("baseline_mean"), F.col("baseline_std")))
    s = s.withColumn("score", anomaly_score(F.col("z_score"), F.col("error_rate"), F.col("unknown_response_pct")))
    slow, bad = F.abs("z_score") >= z, F.col("error_rate") >= err
    kinds = F.concat_ws("+", F.when(slow, F.lit("latency_spike")), F.when(bad, F.lit("error_rate_high")), F.when(F.col("unknown_response_pct") > 80, F.lit("unknown_response_gap")))
    s = s.withColumn("anomaly_type", F.when(kinds == "", F.lit("multi_signal")).otherwise(kinds))
    return _alerts(s.filter(slow | bad | (F.col("score") > 0.3)), by)


@by_incident
def forest_features(stats: DataFrame, baselines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """service and five features: mean over baseline, error rate, share of spans, p95 over p50, share of unknown responses."""
    keys = [*by, "service"]
    s = beside(stats, stats.groupBy(*by).agg(F.sum("span_count").alias("total")), by)
    s = s.join(baselines.select(*keys, "ewma_mean", "ewma_std"), keys, "left")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.when(b > 0, b)), F.lit(1.0))
    return s.select(*keys, ratio(F.col("duration_mean_ms"), F.col("ewma_mean")).alias("latency_ratio"), "error_rate", (F.col("span_count") / F.col("total")).alias("span_share"), ratio(F.col("duration_p95_ms"), F.col("duration_p50_ms")).alias("tail_ratio"), (F.col("unknown_response_pct") / 100).alias("unknown_share"))


@by_incident
def primary_service(alerts: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """service: of the highest alert; without alerts the one of highest error rate; else unknown. Ties by name. With by, a row for each incident of stats."""
    first = lambda c: F.min_by("service", F.struct((-F.col(c)).alias("s"), "service"))
    top = alerts.groupBy(*by).agg(first("score").alias("a"))
    err = stats.groupBy(*by).agg(F.min_by(F.when(F.col("error_rate") > 0, F.col("service")), F.struct((-F.col("error_rate")).alias("s"), "service")).alias("b"))
    return beside(err, top, by).select(*by, F.coalesce("a", "b", F.lit("unknown")).alias("service"))


@by_incident
def confirm_anomaly(alerts: DataFrame, floor: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """confirmed, service, top: whether the highest score is over the floor, whose it is, and the first five."""
    top = alerts.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "service"))).filter("__n <= 5")
    best = F.max("score") > floor
    return top.groupBy(*by).agg(F.coalesce(best, F.lit(False)).alias("confirmed"), F.when(best, F.min_by("service", F.struct((-F.col("score")).alias("s"), "service"))).alias("service"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "service"))), lambda x: x["service"]).alias("top"))


@by_incident
def apply_labels(alerts: DataFrame, labels: DataFrame, top: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Scores of the `top` highest alerts times 1.2, 0.8 or 0.3 by label (missing: ROOT_CAUSE), within 0.01 and 1; these come first. labels: service, label."""
    ranked = alerts.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "service")))
    ranked = ranked.join(labels, [*by, "service"], "left").withColumn("label", F.when(F.col("pos") <= top, F.coalesce("label", F.lit("ROOT_CAUSE"))))
    factor = F.when(F.col("label") == "ROOT_CAUSE", 1.2).when(F.col("label") == "SYMPTOM", 0.8).when(F.col("label") == "FALSE_POSITIVE", 0.3).otherwise(F.lit(1.0))
    new = F.when(F.col("pos") <= top, rounded(F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("score") * factor)), 3)).otherwise(F.col("score"))
    out = ranked.withColumn("score", new)
    order = Window.partitionBy(*by).orderBy((F.col("pos") > top).cast("int"), F.when(F.col("pos") <= top, -F.col("score")), "pos")
    return out.withColumn("rank", F.row_number().over(order)).drop("pos")


def column_means_over(df: DataFrame, threshold: float = 0.01, pattern: str | None = None) -> DataFrame:
    """column, mean of the numeric columns (of those that match the pattern) whose mean is over the threshold; one pass."""
    import re

    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "short", "byte", "float", "double", "decimal") and (pattern is None or re.search(pattern, f.name.lower()))]
    if not numeric:
        return df.sparkSession.createDataFrame([], "column string, mean double")
    means = df.agg(*(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if pattern else F.col(c).cast("double")).alias(c) for c in numeric))
    return means.unpivot([], numeric, "column", "mean").filter(F.col("mean") > threshold)


def alert_context(edges: DataFrame, alerts: DataFrame, most: int = 30) -> DataFrame:
    """src, dst, call_count, error_rate: call edges that touch an alerted service, the busiest first."""
    names = alerts.select("service").distinct()
    a = edges.join(names, edges.src == names.service, "left_semi")
    b = edges.join(names, edges.dst == names.service, "left_semi")
    return a.union(b).select("src", "dst", "call_count", "error_rate").distinct().orderBy(F.desc("call_count"), "src", "dst").limit(most)


def alert_ranks(alerts: DataFrame, ranks: DataFrame) -> DataFrame:
    """Alerts with the PageRank of their service."""
    return alerts.join(ranks.select(F.col("id").alias("service"), F.col("score").alias("pagerank")), "service", "left")


def kernel_signals(metrics: DataFrame, suspects: DataFrame | None = None, latency_ms: float = 50.0, errors: int = 10) -> DataFrame:
    """service, type, severity, evidence of kernel metrics (service, socket_latency_ms struct, syscall_errors map, tcp_retransmits, fd_exhaustion, open_file_descriptors)."""
    m = metrics.join(suspects.select("service").distinct(), "service", "left_semi") if suspects is not None else metrics
    p99, total, again = F.coalesce(F.col("socket_latency_ms.p99").cast("double"), F.lit(0.0)), F.coalesce(F.element_at("syscall_errors", "total"), F.lit(0)), F.coalesce("tcp_retransmits", F.lit(0))
    kinds = F.map_entries(F.map_filter("syscall_errors", lambda k, v: k != "total"))
    worst = F.array_max(F.transform(kinds, lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))
    sig = lambda kind, level, text: F.struct(F.lit(kind).alias("type"), level.alias("severity"), text.alias("evidence"))
    found = F.array_compact(F.array(
        F.when(p99 >= latency_ms, sig("kernel_socket_latency", F.when(p99 > 200, F.lit("HIGH")).otherwise(F.lit("MEDIUM")), F.format_string(f"Socket p99 latency=%.1fms (threshold={latency_ms}ms)", p99))),
        F.when(total >= errors, sig("syscall_error_spike", F.when(total > 100, F.lit("CRITICAL")).otherwise(F.lit("HIGH")), F.concat(F.lit("Syscall errors="), total.cast("string"), F.lit(" (dominant="), F.coalesce(worst["k"], F.lit("unknown")), F.lit(":"), F.coalesce(worst["n"], F.lit(0)).cast("string"), F.lit(")")))),
        F.when(again > 50, sig("tcp_retransmission_spike", F.lit("MEDIUM"), F.concat(F.lit("TCP retransmits="), again.cast("string"), F.lit(" (possible network congestion)")))),
        F.when(F.coalesce("fd_exhaustion", F.lit(False)), sig("fd_exhaustion", F.lit("CRITICAL"), F.concat(F.lit("File descriptor exhaustion detected ("), F.coalesce(F.col("open_file_descriptors").cast("string"), F.lit("0")), F.lit(" open FDs)")))),
    ))
    return m.select("service", F.explode(found).alias("s")).select("service", "s.*")
