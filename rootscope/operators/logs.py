"""Log lines: patterns, fault types, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normalize_log

# Fault types by the first pattern that matches, in this order; words of cluster names.
FAULTS = (
    (r"containerport|targetport|port.*mismatch|connection refused.*port", "Misconfiguration", "Application"),
    (r"imagepullbackoff|errimagepull|no such image|image.*not found", "ImagePullFailure", "Infrastructure"),
    (r"oomkilled|out of memory|memory limit", "ResourceExhaustion", "Application"),
    (r"crashloopbackoff|exit code [1-9]", "CrashLoopFailure", "Application"),
    (r"connection refused|connection timed out|dial tcp.*refused", "NetworkFailure", "Network"),
    (r"certificate.*expired|x509|tls.*error", "CertificateFailure", "Security"),
    (r"database.*connection|sql.*error|pg.*error|mongo.*error", "DatabaseFailure", "DataLayer"),
    (r"timeout|deadline exceeded|context deadline", "TimeoutFailure", "Application"),
)
CLUSTER_WORDS = (("network|connection", "Network"), ("auth|permission", "Auth Issue"), ("config", "Misconfiguration"))


def error_lines(spans: DataFrame, suspects: DataFrame, most: int = 60) -> DataFrame:
    """service, line: error spans of the suspects as log lines, the first ones to come."""
    s = spans.filter("has_error").join(suspects.select(F.col("service").alias("service_name")).distinct(), "service_name", "left_semi").orderBy("ingest_seq").limit(most)
    text = F.format_string("[%s] op=%s response=%s duration=%.0fms trace=%s", "service_name", F.coalesce("operation_name", F.lit("")), F.coalesce("response", F.lit("")), F.coalesce("duration_ms", F.lit(0.0)), F.substring("trace_id", 1, 8))
    return s.select(F.col("service_name").alias("service"), text.alias("line"))


def top_patterns(lines: DataFrame, n: int = 5) -> DataFrame:
    """service, pattern, count, share, rank: the n most frequent normalised lines of each service; ties by text."""
    p = lines.filter(F.trim("line") != "").groupBy("service", normalize_log(F.col("line")).alias("pattern")).agg(F.count("*").alias("count"))
    total = p.groupBy("service").agg(F.sum("count").alias("total"))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("count"), "pattern"))).filter(F.col("rank") <= n)
    return p.join(total, "service").select("service", "pattern", "count", F.round(F.col("count") / F.col("total"), 4).alias("share"), "rank")


def fault_type(lines: DataFrame) -> DataFrame:
    """service, fault_type, fault_layer: the first pattern of the list that any line of the service matches."""
    low = F.lower("line")
    no: Column = F.lit(None).cast("int")
    for k, (pattern, _, _) in reversed(list(enumerate(FAULTS))):
        no = F.when(low.rlike(pattern), F.lit(k)).otherwise(no)
    first = lines.groupBy("service").agg(F.min(no).alias("k")).filter("k IS NOT NULL")
    pick = lambda j: F.element_at(F.array(*(F.lit(f[j]) for f in FAULTS)), F.col("k") + 1)
    return first.select("service", pick(1).alias("fault_type"), pick(2).alias("fault_layer"))


def clusters(lines: DataFrame, signals: DataFrame | None = None, most: int = 5) -> DataFrame:
    """pattern, count, severity, services, summary: the most frequent patterns; without lines the kernel signals.

    Severity by the share of all lines: half CRITICAL, a quarter HIGH, a tenth MEDIUM, else LOW.
    """
    p = lines.filter(F.trim("line") != "").groupBy(normalize_log(F.col("line")).alias("pattern"), "service").agg(F.count("*").alias("n"))
    total = p.agg(F.sum("n").alias("total"))
    p = p.groupBy("pattern").agg(F.sum("n").alias("count"), F.array_sort(F.collect_set("service")).alias("services")).orderBy(F.desc("count"), "pattern").limit(most).crossJoin(F.broadcast(total))  # one row
    share = F.col("count") / F.col("total")
    level = F.when(share >= 0.5, F.lit("CRITICAL")).when(share >= 0.25, F.lit("HIGH")).when(share >= 0.1, F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    out = p.select("pattern", "count", level.alias("severity"), "services", F.format_string("%d of %d lines in %d services", "count", "total", F.size("services")).alias("summary"))
    if signals is None:
        return out
    empty = total.filter("total IS NULL").select(F.lit(True).alias("e"))
    s = signals.select(F.col("type").alias("pattern"), F.lit(1).cast("long").alias("count"), "severity", F.array("service").alias("services"), F.col("evidence").alias("summary"))
    return out.union(s.crossJoin(F.broadcast(empty)).drop("e"))  # no row or one


def cluster_fault_type(found: DataFrame, default: str = "Misconfiguration") -> DataFrame:
    """fault_type: by words of the cluster names; of several clusters that say something the last one (by count) counts."""
    low = F.lower("pattern")
    kind: Column = F.lit(None).cast("string")
    for pattern, name in reversed(CLUSTER_WORDS):
        kind = F.when(low.rlike(pattern), F.lit(name)).otherwise(kind)
    return found.withColumn("kind", kind).filter("kind IS NOT NULL").agg(F.coalesce(F.max_by("kind", F.struct((-F.col("count")).alias("c"), "pattern")), F.lit(default)).alias("fault_type"))
