"""Reports, answers and the analytics of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What each kind of task must resolve; metric and time field by kind.
REQUIRED = (
    ("detection", ("ANOMALY_CONFIRMED",)),
    ("localization", ("ANOMALY_CONFIRMED", "ROOT_CAUSE_SERVICE")),
    ("analysis", ("ANOMALY_CONFIRMED", "ROOT_CAUSE_SERVICE", "FAULT_TYPE", "FAULT_LAYER")),
    ("mitigation", ("ANOMALY_CONFIRMED", "ROOT_CAUSE_SERVICE", "FAULT_TYPE", "FAULT_LAYER", "MITIGATION_ACTION", "MITIGATION_EXECUTED", "TNR_VERIFIED")),
)
METRICS = (("detection", "Detection Accuracy", "TTD"), ("localization", "Localization Accuracy", "TTL"), ("analysis", "system_level_correct", "TTA"), ("mitigation", "Mitigation Success", "TTM"))
KINDS = ("detection", "mitigation", "localization", "analysis")


def incident_report(incident_id: str, alerts: DataFrame, cands: DataFrame, clusters: DataFrame, actions: DataFrame, graph: DataFrame, cases: DataFrame, primary: DataFrame) -> DataFrame:
    """One nested row of everything that was found; every part is a short ranked table."""
    a = alerts.agg(F.count("*").alias("alert_count"))
    top = F.transform(F.array_sort(F.collect_list(F.struct("rank", "service", "confidence"))), lambda x: F.struct(x["service"].alias("service"), F.bround(x["confidence"], 3).alias("confidence")))
    c = cands.filter("rank <= 3").agg(top.alias("top_3_causes"))
    k = clusters.agg(F.collect_list(F.struct("pattern", "count", "severity", "services", "summary")).alias("clusters"))
    m = actions.agg(F.count("*").alias("action_count"), F.array_sort(F.collect_list(F.struct("sequence", "action", "service", "command", "category"))).alias("actions"))
    s = cases.agg(F.count("*").alias("similar_cases"))
    one = a.crossJoin(c).crossJoin(k).crossJoin(m).crossJoin(s).crossJoin(graph).crossJoin(primary.withColumnRenamed("service", "primary_error_service"))  # one row each
    root = F.try_element_at("top_3_causes", F.lit(1))
    summary = F.struct("primary_error_service", F.coalesce(root["service"], F.lit("unknown")).alias("root_cause_service"), F.coalesce(root["confidence"], F.lit(0.0)).alias("root_cause_confidence"), F.col("alert_count").alias("alerts_detected"))
    return one.select(F.lit(incident_id).alias("incident_id"), summary.alias("summary"), F.struct(*graph.columns).alias("graph"), F.struct("top_3_causes").alias("rca"), F.struct("clusters").alias("log_analysis"), F.struct("action_count", "actions").alias("mitigation"), F.struct("similar_cases").alias("memory"))


def answers(found: DataFrame, most: int = 1) -> DataFrame:
    """answer (JSON) of each row of found (task_type, alert_count, services array, fault_layer, fault_type).

    detection: Yes or No; localization: the first `most` services; analysis: layer and type; mitigation: null.
    """
    kind = F.col("task_type")
    services = F.when(F.size(F.coalesce("services", F.array().cast("array<string>"))) > 0, F.slice("services", 1, most)).otherwise(F.array(F.lit("unknown")))
    fault = F.struct(F.coalesce("fault_layer", F.lit("Application")).alias("system_level"), F.coalesce("fault_type", F.lit("Misconfiguration")).alias("fault_type"))
    yes = F.when(F.coalesce("alert_count", F.lit(0)) > 0, F.lit('"Yes"')).otherwise(F.lit('"No"'))
    return found.withColumn("answer", F.when(kind == "detection", yes).when(kind == "localization", F.to_json(services)).when(kind == "analysis", F.to_json(fault)))


def open_fields(tasks: DataFrame, resolved: DataFrame) -> DataFrame:
    """incident_id, field: what a task (incident_id, task_type) requires and resolved (incident_id, field) lacks."""
    req = tasks.sparkSession.createDataFrame([(k, f) for k, fields in REQUIRED for f in fields], "task_type string, field string")
    return tasks.join(F.broadcast(req), "task_type").select("incident_id", "field").join(resolved, ["incident_id", "field"], "left_anti")


def diagnosis_json(cands: DataFrame, actions: DataFrame) -> DataFrame:
    """diagnosis, remediation: JSON of the causes (the first one is the root) and of the actions."""
    faults = F.transform(F.array_sort(F.collect_list(F.struct("rank", "service"))), lambda x: F.struct(x["service"].alias("entity_name"), F.lit("service").alias("entity_type"), (x["rank"] == 1).alias("root_cause")))
    plan = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "action"))), lambda x: F.struct(x["action"].alias("action")))
    return cands.agg(F.to_json(F.struct(faults.alias("faults"))).alias("diagnosis")).crossJoin(actions.agg(F.to_json(F.struct(F.array(plan).alias("mitigation"))).alias("remediation")))


def token_usage(calls: DataFrame) -> DataFrame:
    """caller, model, calls, in_tokens, out_tokens, seconds of a log of model calls."""
    return calls.groupBy("caller", "model").agg(F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.round(F.sum("elapsed"), 3).alias("seconds"))


def run_rollup(runs: DataFrame) -> DataFrame:
    """task_type (null: all), passed, failed, skipped, seconds of runs (task_type, status, seconds)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return runs.rollup("task_type").agg(n("passed"), n("failed"), n("skipped"), F.round(F.sum("seconds"), 3).alias("seconds"))


def task_type(task_id):
    """The kind that the id of a task names."""
    out = F.lit("unknown")
    for k in reversed(KINDS):
        out = F.when(task_id.contains(k), F.lit(k)).otherwise(out)
    return out


def accuracy(results: DataFrame) -> DataFrame:
    """task_type, metric, time_field, accuracy, n of results (task_id, correct)."""
    m = results.sparkSession.createDataFrame(list(METRICS), "task_type string, metric string, time_field string")
    r = results.withColumn("task_type", task_type(F.col("task_id"))).groupBy("task_type").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return r.join(F.broadcast(m), "task_type", "left").select("task_type", F.coalesce("metric", F.lit("Accuracy")).alias("metric"), F.coalesce("time_field", F.lit("Time")).alias("time_field"), F.round("accuracy", 4).alias("accuracy"), "n")


def worker_counts(results: DataFrame) -> DataFrame:
    ok = F.coalesce("success", F.lit(False))
    return results.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
