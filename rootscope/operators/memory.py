"""Incident history: signatures, storage, lookup, learning. Tables are append-only; the latest row of an id holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def signature(service: Column, anomaly: Column, root_cause: Column | None = None) -> Column:
    """md5 over the parts that there are. Lookups know no root cause; so incidents keep both forms."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:"), c))
    parts = [part("service", service), part("anomaly", anomaly)] + ([part("root_cause", root_cause)] if root_cause is not None else [])
    text = F.concat_ws("|", *parts)
    return F.md5(F.when(text == "", F.lit("unknown")).otherwise(text).cast("binary"))


def anomaly_type(alerts: DataFrame, top: int = 3) -> DataFrame:
    """anomaly_type: the distinct kinds of the highest alerts, in order, joined by +."""
    t = alerts.orderBy(F.desc("score"), "service").limit(top)
    return t.agg(F.array_join(F.array_sort(F.collect_set("anomaly_type")), "+").alias("anomaly_type"))


def incident_rows(found: DataFrame) -> DataFrame:
    """Incident rows of (id, ts, service, anomaly_type, root_cause, affected_services, resolution, confidence, outcome, metadata)."""
    sig = signature(F.col("service"), F.col("anomaly_type"))
    full = signature(F.col("service"), F.col("anomaly_type"), F.col("root_cause"))
    return found.select(F.coalesce("id", F.concat(F.lit("INC-"), F.substring(full, 1, 8))).alias("id"), "ts", F.coalesce("root_cause", "service").alias("root_cause"), F.coalesce("affected_services", F.array("service")).alias("affected_services"), sig.alias("signature"), full.alias("signature_full"), "resolution", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("outcome", F.lit("pending")).alias("outcome"), "metadata")


def store_incidents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of the rows of an id the latest; of equal times the new one."""
    w = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("__new"))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__new")


def latest(incidents: DataFrame) -> DataFrame:
    """Of the rows of an id the one of the latest time, of equal times the greatest by its other values; by partial aggregation."""
    rest = [F.col(c) for c, kind in incidents.dtypes if "map<" not in kind and c not in ("id", "ts")]
    return incidents.groupBy("id").agg(F.max_by(F.struct(*incidents.columns), F.struct("ts", *rest)).alias("i")).select("i.*")


def find_similar(incidents: DataFrame, asked: DataFrame, limit: int = 5) -> DataFrame:
    """For each row of asked (case_id, signature, root_cause) the incidents of that signature or root cause, the newest first.

    The latest row of an id holds: one whose root cause has changed since is found by the new one only. Each key's incidents are cut to the
    newest `limit` before they are joined: a case's best ones are among the best of each of its keys.
    """
    now = cut(latest(incidents), "incidents")

    def newest(col: str) -> DataFrame:
        w = Window.partitionBy("__key").orderBy(F.desc("ts"), "id")
        rows = now.withColumn("__key", F.col(col)).filter(F.col("__key").isNotNull())
        return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit).drop("__n")

    by_sig = asked.select("case_id", F.col("signature").alias("__key")).join(newest("signature"), "__key")
    by_full = asked.select("case_id", F.col("signature").alias("__key")).join(newest("signature_full"), "__key")
    by_root = asked.filter("root_cause IS NOT NULL AND root_cause <> ''").select("case_id", F.col("root_cause").alias("__key")).join(newest("root_cause"), "__key")
    cols = ["case_id", *incidents.columns]
    both = by_sig.select(cols).union(by_full.select(cols)).union(by_root.select(cols)).dropDuplicates(["case_id", "id"])
    w = Window.partitionBy("case_id").orderBy(F.desc("ts"), "id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def update_outcome(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Incidents with the last outcome and the sum of deltas of changes (id, seq, outcome, delta)."""
    c = changes.groupBy("id").agg(F.max_by("outcome", "seq").alias("new"), F.sum("delta").alias("delta"))
    i = incidents.join(c, "id", "left")
    return i.withColumn("outcome", F.coalesce("new", "outcome")).withColumn("confidence", F.col("confidence") + F.coalesce("delta", F.lit(0.0))).drop("new", "delta")


def outcome_changes(results: DataFrame) -> DataFrame:
    """Changes of (id, seq, success): resolved with +0.1, failed with -0.1."""
    return results.select("id", "seq", F.when(F.col("success"), F.lit("resolved")).otherwise(F.lit("failed")).alias("outcome"), F.when(F.col("success"), F.lit(0.1)).otherwise(F.lit(-0.1)).alias("delta"))


def false_positives(incidents: DataFrame, limit: int = 10) -> DataFrame:
    """signature, root_cause, count of incidents found to be none, the most frequent first."""
    return incidents.filter("outcome = 'false_positive'").groupBy("signature", "root_cause").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "signature", "root_cause").limit(limit)


def incident_count(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count("*").alias("count"))


def similar_links(found: DataFrame) -> DataFrame:
    """src, dst, edge_type: incident -> past case, of find_similar's rows."""
    return found.filter("case_id <> id").select(F.col("case_id").alias("src"), F.col("id").alias("dst"), F.lit("SIMILAR_TO").alias("edge_type")).distinct()
