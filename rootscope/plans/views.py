"""Telemetry views over the driver tables: spans of lineitem, pods of supplier, metrics of events, log lines of documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spans import ARRIVAL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(x: Column) -> Column:
    """A double to the nearest whole number, halves away from zero; F.round takes each value through its decimal digits."""
    up = lambda v: F.floor(v) + (v - F.floor(v) >= 0.5).cast("long")
    return F.when(x < 0, -up(-x)).otherwise(up(x))


def raw_spans(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """SPAN: a trace for each order, a span for each line, whose parent is the line before; duplicates as they are.

    ingest_seq is made of the columns, so that it is the same whatever the partitions are. placed: with the file and the row of each line, which settle equal ones.
    """
    place = [F.col("_metadata.file_path").alias(ARRIVAL[0]), F.col("_metadata.row_index").alias(ARRIVAL[1])] if placed else []
    c = F.col
    seq = (c("l_orderkey") * 8 + c("l_linenumber")) * 1_000_000 + F.pmod(c("l_partkey") * 7919 + c("l_suppkey") * 104729 + _whole(c("l_extendedprice") * 100) + _whole(c("l_quantity")) * 31, F.lit(1_000_000))
    err = (c("l_returnflag") == "R") & ((c("l_linenumber") == 5) | (c("l_tax") >= 0.08))
    dur = _whole(c("l_extendedprice"))
    resp = F.when(err, "500").when(c("l_linestatus") == "F", "200").otherwise(F.lit("Unknown"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("t"), c("l_orderkey").cast("string")).alias("trace_id"),
        F.concat(F.lit("s"), c("l_orderkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string")).alias("span_id"),
        F.when(c("l_linenumber") > 1, F.concat(F.lit("s"), c("l_orderkey").cast("string"), F.lit("-"), (c("l_linenumber") - 1).cast("string"))).otherwise(F.lit("ROOT")).alias("parent_span"),
        F.concat(F.lit("svc-"), c("l_linenumber").cast("string"), F.lit("-"), (c("l_suppkey") % 2).cast("string")).alias("service_name"),
        F.when(c("l_linenumber") % 2 == 1, "/api/op").otherwise(F.lit("db_query")).alias("operation_name"),
        (F.unix_micros(c("l_shipdate").cast("timestamp")) + 1000 * c("l_linenumber")).alias("start_time"),
        dur.alias("duration"), (dur / 1000.0).alias("duration_ms"), err.alias("has_error"), resp.alias("response"),
        F.when(err, "ERROR").when(resp == "Unknown", "UNKNOWN").otherwise(resp).alias("status"),
        F.lit("").alias("end_time"), F.create_map().cast("map<string,string>").alias("tags"), seq.cast("long").alias("ingest_seq"), *place,
    )


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pod for each supplier, on a machine for each nation."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("pod-"), k.cast("string")).alias("name"), F.lit("prod").alias("namespace"), F.concat(F.lit("node-"), F.col("s_nationkey").cast("string")).alias("node_name"),
        F.concat(F.lit("svc-"), (k % 7 + 1).cast("string"), F.lit("-"), (k % 2).cast("string")).alias("service_name"),
        F.when(k % 11 == 0, "0/1").otherwise(F.lit("1/1")).alias("ready"), F.when(k % 13 == 0, "CrashLoopBackOff").otherwise(F.lit("Running")).alias("status"), (k % 10).cast("string").alias("restarts"),
    )


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("node-"), F.col("n_nationkey").cast("string")).alias("name"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """METRIC: cpu_ and mem_ series by event type and a hundredth of the users."""
    kind = F.when(F.col("event_id") % 2 == 0, "cpu_").otherwise(F.lit("mem_"))
    return table(spark, sf_dir, "events").select(F.concat(kind, "event_type").alias("metric"), F.concat(F.lit("user"), (F.col("user_id") % 100).cast("string"), F.lit("svc")).alias("service"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("value").cast("double").alias("value"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG_LINE: the lines of documents by source."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("service"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    return d.select("service", F.col("line_no").cast("long").alias("line_no"), "line")


#: What the first event numbers of each 40 write to the log; the others are fine.
FAULT_LINES = (
    "ERROR error connecting to svc-3-0: connection refused", "request timed out: context deadline exceeded", "Exception in handler: sql syntax error", "connect() refused Host: svc-2-1 Port 5432",
    "container OOMKilled: memory limit reached", "x509: certificate has expired", "Back-off pulling image: ImagePullBackOff", "targetPort 9999 mismatch",
)


def fault_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG_LINE: a line for each event, a fifth of them faults."""
    k = F.col("event_id") % 40
    line: Column = F.concat(F.lit("ok "), F.col("event_type"))
    for i, text in enumerate(FAULT_LINES):
        line = F.when(k == i, F.lit(text)).otherwise(line)
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 7 + 1).cast("string"), F.lit("-"), (F.col("event_id") % 2).cast("string"))
    return table(spark, sf_dir, "events").select(service.alias("service"), F.col("event_id").alias("line_no"), line.alias("line"))


def flawed_spans(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Raw spans, some without a span id, a service or a trace."""
    s, n = raw_spans(spark, sf_dir, placed), F.col("ingest_seq")
    return s.withColumns({"span_id": F.when(n % 50 == 0, "").otherwise(F.col("span_id")), "service_name": F.when(n % 70 == 1, " ").otherwise(F.col("service_name")), "trace_id": F.when(n % 90 != 2, F.col("trace_id"))})


def ring(spans: DataFrame) -> DataFrame:
    """Spans whose traces close: the first line was called by the seventh."""
    return spans.withColumn("parent_span", F.when(F.col("parent_span") == "ROOT", F.concat(F.lit("s"), F.substring("trace_id", 2, 20), F.lit("-7"))).otherwise(F.col("parent_span")))


def pod_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pod listing in JSON for each pod: its service stands under one of several labels; every fifth has no requests."""
    k = F.col("s_suppkey")
    svc = F.concat(F.lit("svc-"), (k % 7 + 1).cast("string"))
    labels = F.when(k % 3 == 0, F.create_map(F.lit("app"), svc)).when(k % 3 == 1, F.create_map(F.lit("app"), F.lit(""), F.lit("service"), svc)).otherwise(F.create_map(F.lit("component"), svc, F.lit("tier"), F.lit("back")))
    requests = F.when(k % 5 != 0, F.create_map(F.lit("cpu"), F.concat((k % 9).cast("string"), F.lit("m")), F.lit("memory"), F.lit("64Mi")))
    meta = F.struct(F.concat(F.lit("pod-"), k.cast("string")).alias("name"), F.lit("prod").alias("namespace"), labels.alias("labels"))
    spec = F.struct(F.concat(F.lit("node-"), F.col("s_nationkey").cast("string")).alias("nodeName"), F.array(F.struct(F.struct(requests.alias("requests")).alias("resources"))).alias("containers"))
    return table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.array(F.struct(meta.alias("metadata"), spec.alias("spec"))).alias("items"))).alias("json"))


def node_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine in JSON for each nation."""
    k = F.col("n_nationkey")
    conditions = F.array(F.struct(F.lit("Ready").alias("type"), F.when(k % 4 == 0, "Unknown").otherwise(F.lit("True")).alias("status"), F.lit("r").alias("reason")), F.struct(F.lit("DiskPressure").alias("type"), F.lit("False").alias("status"), F.lit("s").alias("reason")))
    status = F.struct(F.create_map(F.lit("cpu"), (k + 2).cast("string"), F.lit("memory"), F.lit("8Gi")).alias("capacity"), conditions.alias("conditions"))
    return table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("node-"), k.cast("string")).alias("name")).alias("metadata"), status.alias("status"))).alias("items"))).alias("json"))


def service_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service of two ports in JSON for each supplier; some ports lead to 9999."""
    k = F.col("s_suppkey")
    port = lambda n, bad: F.struct(F.lit(n).alias("port"), F.when(bad, "9999").otherwise(F.lit("8080")).alias("targetPort"))
    return table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("app-"), k.cast("string")).alias("name")).alias("metadata"), F.struct(F.array(port(80, k % 17 == 0), port(443, k % 19 == 0)).alias("ports")).alias("spec"))).alias("items"))).alias("json"))


def kernel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel metrics of a service for each event."""
    k = F.col("event_id")
    errors = F.create_map(F.lit("total"), (k % 120).cast("int"), F.lit("EPIPE"), (k % 50).cast("int"), F.lit("EIO"), (k % 70).cast("int"))
    latency = F.struct(F.lit(1.0).alias("p50"), F.lit(2.0).alias("p95"), (k % 260).cast("double").alias("p99"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("svc-"), (F.col("user_id") % 100).cast("string")).alias("service"), latency.alias("socket_latency_ms"), errors.alias("syscall_errors"), (k % 60).cast("int").alias("tcp_retransmits"), (k % 33 == 0).alias("fd_exhaustion"), (k % 1000).cast("int").alias("open_file_descriptors"))


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each order: those that can be undone, some that cannot, some that are forbidden."""
    k = F.col("o_orderkey")
    s = F.concat(F.lit("svc-"), (k % 7).cast("string"))
    put = lambda a, b="": F.concat(F.lit(a), s, F.lit(b))
    commands = [
        F.concat(put("kubectl scale deployment/", " --replicas="), (k % 9).cast("string")), put("kubectl rollout restart deployment/"), put("kubectl patch configmap ", " -p x"), put("kubectl set env deployment/", " FOO=1 BAZ=2"), put("helm upgrade ", " chart"), put("kubectl delete pods -l app="),
        put("kubectl apply -f ", ".yaml"), put("kubectl get pods -l app="), put("kubectl delete namespace "), put("rm -rf /var/"), put("kubectl logs -f "), F.lit(""),
    ]
    cmd = F.get(F.array(*commands), (k % len(commands)).cast("int"))
    kinds = F.array(*map(F.lit, ("rollout_restart", "rollback", "scale", "patch_port", "set_image", "wait_ready", "other")))
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"), cmd.alias("command"), s.alias("service"), s.alias("target"), F.concat(F.lit("step "), k.cast("string")).alias("title"), F.get(kinds, (k % 7).cast("int")).alias("action"),
        F.when(k % 2 == 0, "remediation").otherwise(F.lit("diagnostic")).alias("category"), F.col("o_totalprice").alias("priority"), k.cast("int").alias("sequence"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all roles, one for each customer."""
    words = F.array(*map(F.lit, ("jaeger", "load-generator", "Kafka", "user-db", "redis", "frontend-proxy", "nginx", "email", "checkout", "", "mongodb-rate", "fraud-detection", "wrk2-job", "istio-ingress", "geo")))
    k = F.col("c_custkey")
    word = F.get(words, (k % 15).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.when(word == "", word).otherwise(F.concat(word, F.lit("-"), k.cast("string"))).alias("name"))
