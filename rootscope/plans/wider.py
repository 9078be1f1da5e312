"""More registered queries: readers and sinks over files that are written from the driver tables, then the operators of plans and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pod_of, service_role
from ..operators import detect, facts, forest, infra, logs, memory, mitigate, rca, report
from ..operators.order import numbered
from ..sources import history, readers, tables
from ..sources.shared import shared_dir
from . import views
from .registry import Run, _all_facts, _incidents, _ranks, _suspects, query

SPAN_COLUMNS = ("trace_id", "span_id", "parent_span", "service_name", "operation_name", "start_time", "duration_ms", "has_error", "response")


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# I: readers


def _standard(spark, sf, folder: str, keep: Column) -> str:
    s = _in_order(views.raw_spans(spark, sf).filter(keep))
    s.select("trace_id", "span_id", "parent_span", "service_name", "operation_name", "start_time", "duration", "has_error", "response").write.option("header", True).csv(folder)
    return folder


#: Spans of a file at most, about: files grow in number with the table, so that no task's sort grows with it.
FILE_ROWS = 250_000


def _in_order(s: DataFrame) -> DataFrame:
    """Spans as files whose names are in the order of ids; of spans with an id those that are equal in all else may change places."""
    order = ("trace_id", "span_id", "start_time", "duration", "service_name", "has_error", "response")
    return s.repartitionByRange(max(4, -(-s.count() // FILE_ROWS)), *order).sortWithinPartitions(*order)


def _arrived(s: DataFrame) -> DataFrame:
    """Spans with their place in order of arrival."""
    return numbered(s.withColumn("all", F.lit(0)), ["all"], ["ingest_seq"], "arrival", "n").select(*SPAN_COLUMNS, "arrival")


def _mixed(spark, sf, folder: str, keep: Column) -> str:
    """trace, "span parent service", "operation start", duration, error, response: header and values are blank-separated in two fields."""
    s = _in_order(views.raw_spans(spark, sf).filter(keep))
    s.select("trace_id", F.concat_ws(" ", "span_id", "parent_span", "service_name").alias("span_id parent_span service_name"), F.concat_ws(" ", "operation_name", F.col("start_time").cast("string")).alias("operation_name start_time"), "duration", "has_error", "response").write.option("header", True).csv(folder)
    return folder


@query
def i1_read_csv(spark, sf):
    return _arrived(readers.read_spans(spark, _standard(spark, sf, _folder(spark, "csv"), F.lit(True)), "standard"))


@query
def i2_read_mixed(spark, sf):
    return _arrived(readers.read_spans(spark, _mixed(spark, sf, _folder(spark, "mixed"), F.lit(True)), "mixed"))


@query
def i3_read_auto(spark, sf):
    """Files of both formats in one folder; which one each has shows from its first lines."""
    base, odd = _folder(spark, "auto"), F.col("start_time") % 2 == 1
    _standard(spark, sf, f"{base}/a", ~odd)
    _mixed(spark, sf, f"{base}/b", odd)
    return _arrived(readers.read_spans(spark, f"{base}/*"))


@query
def i4_read_json(spark, sf):
    """Lines of JSON objects whose `data` holds the spans of a trace."""
    s = views.raw_spans(spark, sf).groupBy("trace_id").agg(F.collect_list(F.struct("trace_id", "span_id", "parent_span", "service_name", "operation_name", "start_time", "duration", "has_error", "response")).alias("data"))
    folder = _folder(spark, "json")
    s.select(F.to_json(F.struct("data")).alias("value")).write.text(folder)
    return readers.read_spans(spark, folder, "jsonl").select(*SPAN_COLUMNS)


@query
def i5_normalize_spans(spark, sf):
    """Columns under other names, numbers and truths as text, blanks and words for nothing."""
    k = F.col("l_linenumber")
    raw = views.table(spark, sf, "lineitem").select(
        F.concat(F.lit(" t"), F.col("l_orderkey").cast("string"), F.lit(" ")).alias("traceId"), F.col("l_partkey").cast("string").alias("SpanId"), F.when(k % 3 == 0, "").otherwise(k.cast("string")).alias("parentId"), F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit("svc-"), k.cast("string"))).alias("Service"),
        F.lit("op").alias("operation"), F.when(k == 5, "12.5").otherwise(F.col("l_suppkey").cast("string")).alias("startTime"), F.when(k % 2 == 0, "1.5").alias("duration_ms"), (k * 1000).cast("string").alias("duration"),
        F.get(F.array(*map(F.lit, ("true", "1", "Yes", "y", "no", "0", ""))), k - 1).alias("hasError"), F.get(F.array(*map(F.lit, ("200", "None", "nan", "", "503", "Unknown", "ok"))), k - 1).alias("response_class"), F.when(k == 7, '{"a":"1"}').otherwise(F.lit("no json")).alias("tags"),
    )
    n = readers.normalize_spans(raw)
    return n.select(*SPAN_COLUMNS, "duration", "status", F.size("tags").alias("n_tags"))


@query
def i14_read_metrics(spark, sf):
    """Instance and pod in one column; every tenth value is no number."""
    k = F.col("event_id")
    m = views.table(spark, sf, "events").select(F.concat(F.lit("CPU_"), "event_type").alias("metric"), F.concat(F.lit("inst-1.pod-"), (F.col("user_id") % 50).cast("string")).alias("cmdb_id"), F.lit("kpi").alias("kpi_name"), F.when(k % 10 == 0, "nan").otherwise(F.col("value").cast("string")).alias("value"), (k * 2).cast("string").alias("timestamp"))
    folder = _folder(spark, "metrics") + "/summary.csv"
    m.write.option("header", True).csv(folder)
    return readers.read_metrics(spark, folder)


@query
def i15_read_metric_files(spark, sf):
    """A folder for each kind of event with a file kpi_<kind>.csv without header."""
    e = views.table(spark, sf, "events").select(F.concat(F.lit("x.pod"), (F.col("user_id") % 50).cast("string")).alias("c1"), F.col("event_id").alias("c0"), F.lit("n").alias("c2"), F.col("value").alias("c3"), "event_type")
    base = _folder(spark, "kpis")
    e.select("c0", "c1", "c2", "c3", "event_type").repartition("event_type").write.partitionBy("event_type").csv(base)
    # the writer names its files itself: they are renamed to what they hold
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for d in fs.listStatus(hadoop.Path(base)):  # a folder for each kind of event
        name = d.getPath().getName()
        if "=" in name:
            for f in fs.listStatus(d.getPath()):
                if f.getPath().getName().endswith(".csv"):
                    fs.rename(f.getPath(), hadoop.Path(d.getPath(), f"kpi_{name.split('=')[1]}.csv"))
    return readers.read_metrics(spark, base).withColumn("metric", F.regexp_replace("metric", "^.*=", ""))


@query
def i16_read_logs(spark, sf):
    """A file of lines under `=== service ===` headers for each source, each document's text below its header."""
    d = views.table(spark, sf, "documents").select(F.concat(F.lit("=== "), F.coalesce("source", F.lit("none")), F.lit(" ===\nfirst line\n"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.lit("\n")).alias("value"))
    folder = _folder(spark, "logs")
    d.write.text(folder)
    return readers.read_logs(spark, folder).select("service", "line")


@query
def i17_read_pods(spark, sf):
    p = views.pods(spark, sf).select(F.concat_ws("   ", "name", "ready", "status", "restarts", F.lit("3d")).alias("value"))
    folder = _folder(spark, "pods")
    p.unionByName(spark.createDataFrame([("NAME  READY  STATUS  RESTARTS  AGE",)], "value string")).write.text(folder)
    return readers.read_pods(spark, folder)


@query
def i18_unwrap_text(spark, sf):
    t = views.table(spark, sf, "orders").select(F.concat(F.lit("b'order "), F.col("o_orderkey").cast("string"), F.lit("\\nstatus\\t"), F.col("o_orderstatus"), F.lit("\\r\\nroot@host:~# tail'")).alias("text"))
    return readers.unwrap_text(t, "text", "root@host")


# G, R, M, T: sinks


@query
def g11_graph_sink(spark, sf):
    """The graph stored twice, the second time with a node and an edge changed."""
    *_, edges, nodes = Run(spark, sf).small()
    path = _folder(spark, "graph-sink")
    tables.upsert_graph(nodes, edges, path)
    n, e = tables.upsert_graph(nodes.filter("id LIKE '%-1'").withColumn("span_count", F.lit(0).cast("long")), edges.filter("src LIKE 'svc-1-%'").withColumn("call_count", -F.col("call_count")), path)
    return n.select(F.col("id").alias("a"), F.lit("").alias("b"), F.col("node_type").alias("kind"), F.col("span_count").alias("n")).union(e.select("src", "dst", "edge_type", "call_count"))


@query
def g12_trace_sink(spark, sf):
    s = Run(spark, sf).written()
    path = _folder(spark, "trace-sink")
    tables.write_trace_graph(s, path)
    return tables.write_trace_graph(s.filter("has_error"), path).select("src", "dst", "edge_type")


@query
def r12_rca_sink(spark, sf):
    ranked = Run(spark, sf).ranked()[0].select("service", "confidence", "rank")
    path = _folder(spark, "rca-sink")
    tables.append_rca(ranked, "inc-1", path)
    tables.append_rca(ranked, "inc-2", path, 3)
    return tables.append_rca(ranked.withColumn("confidence", F.lit(0.0)), "inc-1", path, 2).select("incident_id", "rank", "service", "confidence")


@query
def m2_store_incidents(spark, sf):
    """All incidents pending, then the resolved ones stored again a day later."""
    rows = memory.incident_rows(_incidents(spark, sf)).drop("metadata")
    path = _folder(spark, "incident-sink")
    tables.store_incidents(rows.withColumn("outcome", F.lit("pending")), path)
    out = tables.store_incidents(rows.filter("outcome = 'resolved'").withColumn("ts", F.col("ts") + F.expr("interval 1 day")), path)
    return out.select("id", "root_cause", "outcome", "signature")


@query
def m3_similar_from_lists(spark, sf):
    """All incidents put into a history; then every fifth order's is found to have another root cause, a day later."""
    o = _incidents(spark, sf).withColumn("anomaly_type", F.lit(""))
    path = _folder(spark, "history")
    history.add(memory.incident_rows(o).drop("metadata"), path)
    moved = o.filter(F.substring("id", 2, 20).cast("long") % 5 == 0).withColumn("root_cause", F.concat(F.lit("svc-"), (F.substring("service", 5, 9).cast("int") % 3).cast("string"))).withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
    history.add(memory.incident_rows(moved).drop("metadata"), path)
    asked = o.filter("asked").select(F.col("id").alias("case_id"), memory.signature(F.col("service"), F.lit("")).alias("signature"), "root_cause")
    return history.find_similar(spark, path, asked).select("case_id", "id", "rank")


@query
def t19_store_facts(spark, sf):
    """Facts of two sessions stored, one of them twice."""
    f = _all_facts(spark, sf)
    path = _folder(spark, "fact-sink")
    tables.store_facts(facts.fact_rows(f, "s1"), path)
    tables.store_facts(facts.fact_rows(f.filter("relationship = 'calls'"), "s2"), path)
    out = tables.store_facts(facts.fact_rows(f.withColumn("relevance", F.lit(0.5)), "s1"), path)
    return out.groupBy("session_id", "relationship", "relevance").agg(F.count("*").alias("n"))


@query
def t20_active_facts(spark, sf):
    f = _all_facts(spark, sf)
    both = facts.fact_rows(f, "s1").unionByName(facts.fact_rows(f, "s2").withColumn("is_active", F.col("relationship") == "calls"))
    return facts.active_facts(both, "s2").select("edge_id", "source", "relationship", "target")


@query
def t21_store_sessions(spark, sf):
    """A session for each customer; those of orders that are done are stored again."""
    c = views.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("session_id"), F.lit("q").alias("user_query"), F.lit("p").alias("master_plan"), F.lit("open").alias("global_status"), F.lit(1).alias("updated_at"))
    done = views.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("session_id")).distinct()
    path = _folder(spark, "session-sink")
    tables.store_sessions(c, path)
    return tables.store_sessions(c.join(done, "session_id", "left_semi").withColumns({"global_status": F.lit("done"), "updated_at": F.lit(2)}), path).select("session_id", "global_status")


# N, D: infrastructure and detection


@query
def n1_flatten_pods(spark, sf):
    return infra.flatten_pods(views.pod_json(spark, sf)).withColumn("labels", F.size("labels"))


@query
def n2_flatten_nodes(spark, sf):
    return infra.flatten_nodes(views.node_json(spark, sf)).withColumn("conditions", F.array_join(F.transform("conditions", lambda c: c["type"]), ","))


@query
def n4_index_maps(spark, sf):
    m = infra.index_maps(infra.flatten_pods(views.pod_json(spark, sf)))
    out = m["pod_node"].select(F.lit("pod_node").alias("kind"), F.col("name").alias("key"), F.col("node_name").alias("value"))
    for k in ("node_pods", "service_pods"):
        out = out.union(m[k].select(F.lit(k), "key", F.array_join("pods", ",")))
    return out


@query
def n9_infra_counts(spark, sf):
    _, _, alerts, _, nodes = Run(spark, sf).small()
    p, m = views.pods(spark, sf), views.machines(spark, sf)
    return infra.infra_counts(p, m, infra.infra_edges(nodes, p, m, alerts))


@query
def n10_port_drift(spark, sf):
    return infra.port_drift(views.service_json(spark, sf), preferred=["app-17"])


def _pod_lines(spark, sf) -> DataFrame:
    return views.pods(spark, sf).select(F.concat_ws(" ", "name", "ready", "status", "restarts").alias("line"))


@query
def n11_unhealthy_pods(spark, sf):
    return infra.unhealthy_pods(_pod_lines(spark, sf))


@query
def d10_detector_choice(spark, sf):
    r = Run(spark, sf)
    stats, base, *_ = r.small()
    return forest.detect(r.spans, stats, detect.forest_features(stats, base), "ewma").select("service", "score", "z_score")


@query
def d10_choice_by_day(spark, sf):
    """Each day of spans is an incident: those of 30 spans and more go to the forest."""
    s = Run(spark, sf).spans.withColumn("day", F.date_format(F.timestamp_micros("start_time"), "yyyy-MM-dd"))
    return forest.detector_choice(s, "auto", by=["day"])


@query
def d14_kernel_signals(spark, sf):
    return detect.kernel_signals(views.kernel_metrics(spark, sf))


@query
def d15_suspect_signals(spark, sf):
    m = views.kernel_metrics(spark, sf)
    return detect.kernel_signals(m, m.filter("service LIKE 'svc-1%'"))


@query
def d17_alert_ranks(spark, sf):
    _, _, alerts, edges, _ = Run(spark, sf).small()
    return detect.alert_ranks(alerts, _ranks(edges)).select("service", "score", F.round("pagerank", 6).alias("pagerank"))


# R: root cause


@query
def r5_infra_term(spark, sf):
    """Candidates of which some share a machine with an alerted service."""
    r = Run(spark, sf)
    _, base, alerts, edges, nodes = r.small()
    near = infra.service_colocated(infra.infra_edges(nodes, views.pods(spark, sf), views.machines(spark, sf), alerts))
    cands = rca.candidates(rca.upstream_paths(edges, "svc-5-1"), "svc-5-1")
    return rca.score_candidates(cands, nodes, base, alerts, colocated=near).select("service", "confidence")


@query
def r6_span_fallbacks(spark, sf):
    """Nodes of which half lost their error rate and mean: both come from the spans."""
    r = Run(spark, sf)
    _, base, alerts, edges, nodes = r.small()
    lost = nodes.withColumns({c: F.when(F.col("id").endswith("-0"), 0.0).otherwise(F.col(c)) for c in ("error_rate", "duration_mean_ms")})
    cands = rca.candidates(rca.upstream_paths(edges, "svc-5-1"), "svc-5-1")
    return rca.score_candidates(cands, lost, base, alerts, r.spans).select("service", "confidence", "error_rate", "latency_z_score")


@query
def r13_reorder(spark, sf):
    ranked, stats, *_ = Run(spark, sf).ranked()
    order = stats.filter("service LIKE '%-0'").select("service", F.col("span_count").alias("pos"))
    return rca.reorder(ranked, order).select("service", "rank")


@query
def r14_apply_deltas(spark, sf):
    ranked = Run(spark, sf).ranked()[0]
    deltas = ranked.select("service", (F.col("rank") * 0.05 - 0.2).alias("delta"), (F.col("rank") == 3).alias("first"))
    return rca.apply_deltas(ranked, deltas).select("service", "confidence", "rank")


# T, S, L: facts, suspects, logs


@query
def t2_service_role(spark, sf):
    return views.names(spark, sf).select("id", service_role(F.col("name")).alias("role"))


@query
def t8_pod_of(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", pod_of(F.concat(F.lit("inst."), "o_orderstatus", F.lit(".pod-"), F.col("o_custkey").cast("string"))).alias("pod"))


@query
def t23_fact_lines(spark, sf):
    return facts.fact_lines(facts.fact_rows(_all_facts(spark, sf), "s1"))


@query
def s8_relabel_suspects(spark, sf):
    s = _suspects(spark, sf)
    labels = s.filter("rank > 1").select("service", F.when(F.col("rank") % 3 == 0, "ROOT_CAUSE").when(F.col("rank") % 3 == 1, "NORMAL").otherwise(F.lit("odd")).alias("label"))
    return facts.relabel_suspects(s, labels).select("service", "label", F.round("adjusted", 6).alias("adjusted"), "rank")


@query
def l6_cluster_fault_type(spark, sf):
    return logs.cluster_fault_type(logs.clusters(views.fault_lines(spark, sf), most=12))


@query
def l7_redact_map(spark, sf):
    from ..functions.columns import redact_map

    m = F.create_map(F.lit("Password "), F.lit("x"), F.lit("note"), F.concat(F.lit("api_key=abc"), F.col("o_orderkey").cast("string"), F.lit(" ok")), F.lit("status"), F.col("o_orderstatus"))
    r = redact_map(m)
    return views.table(spark, sf, "orders").select("o_orderkey", F.element_at(r, "Password ").alias("password"), F.element_at(r, "note").alias("note"), F.element_at(r, "status").alias("status"))


# M, A, E: memory, mitigation, reports


@query
def m4_update_outcome(spark, sf):
    rows = memory.incident_rows(_incidents(spark, sf))
    k = F.col("o_orderkey")
    tries = views.table(spark, sf, "orders").filter(k % 4 != 0).select(F.concat(F.lit("o"), k.cast("string")).alias("id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq"), k).withColumn("success", (k + F.col("seq")) % 3 == 0).drop("o_orderkey")
    return memory.update_outcome(rows, memory.outcome_changes(tries)).select("id", "outcome", F.round("confidence", 4).alias("confidence"))


@query
def m7_anomaly_type(spark, sf):
    return memory.anomaly_type(Run(spark, sf).small()[2])


@query
def m8_similar_links(spark, sf):
    o = _incidents(spark, sf).withColumn("anomaly_type", F.lit(""))
    asked = o.filter("asked").select(F.col("id").alias("case_id"), memory.signature(F.col("service"), F.lit("")).alias("signature"), "root_cause")
    return memory.similar_links(memory.find_similar(memory.incident_rows(o), asked))


@query
def a5_regressed(spark, sf):
    """Health of each group of customers over even orders, then over odd ones."""
    o, k = views.table(spark, sf, "orders"), F.col("o_orderkey")
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    per = lambda part: mitigate.health(o.filter(k % 2 == part).groupBy((F.col("o_custkey") % 100).alias("service")).agg(n("F").alias("alerts"), n("O").alias("violations"), n("P").alias("unhealthy")))
    return mitigate.regressed(per(0), per(1).withColumn("cycle", F.col("service") % 5), "service")


@query
def a7_undo_order(spark, sf):
    undo = mitigate.revert_commands(views.action_log(spark, sf)).withColumn("reverted", F.col("seq") % 5 == 0)
    return mitigate.undo_order(undo).select("step", "seq", "revert_cmd")


@query
def a8_screen_commands(spark, sf):
    return mitigate.screen_commands(views.action_log(spark, sf)).select("seq", "blocked")


@query
def a9_render_actions(spark, sf):
    return mitigate.render_actions(views.action_log(spark, sf), "prod")


@query
def a10_error_columns(spark, sf):
    wide = views.table(spark, sf, "lineitem").select(F.col("l_tax").alias("error_rate"), (F.col("l_discount") / 100).alias("http_5xx"), F.col("l_quantity").alias("load"), F.col("l_discount").alias("Errors"))
    return detect.column_means_over(wide, pattern="error|5xx").withColumn("mean", F.round("mean", 6))


@query
def a11_cross_check(spark, sf):
    return mitigate.cross_check(Run(spark, sf).small()[2], _pod_lines(spark, sf))


def _kind(k: Column) -> Column:
    return F.get(F.array(*map(F.lit, ("detection", "localization", "analysis", "mitigation"))), (k % 4).cast("int"))


@query
def e2_answers(spark, sf):
    k = F.col("o_orderkey")
    found = views.table(spark, sf, "orders").select(k.alias("id"), _kind(k).alias("task_type"), (F.col("o_custkey") % 3).alias("alert_count"), F.when(F.col("o_custkey") % 2 == 0, F.array(F.concat(F.lit("svc-"), (k % 7).cast("string")), F.lit("other"))).alias("services"), F.when(F.col("o_custkey") % 5 != 0, F.lit("Network")).alias("fault_layer"), F.when(F.col("o_custkey") % 7 != 0, F.lit("NetworkFailure")).alias("fault_type"))
    return report.answers(found).select("id", "answer")


@query
def e3_open_fields(spark, sf):
    k = F.col("o_orderkey")
    o = views.table(spark, sf, "orders").select(F.concat(F.lit("o"), k.cast("string")).alias("incident_id"), _kind(k).alias("task_type"), k)
    done = F.array_compact(F.array(F.when(k % 2 == 0, "ANOMALY_CONFIRMED"), F.when(k % 3 == 0, "ROOT_CAUSE_SERVICE"), F.when(k % 5 == 0, "FAULT_TYPE")))
    return report.open_fields(o.drop("o_orderkey"), o.select("incident_id", F.explode(done).alias("field")))


@query
def e4_diagnosis(spark, sf):
    cands = Run(spark, sf).ranked()[0]
    return report.diagnosis_json(cands, mitigate.mitigation_plan(cands))


@query
def e7_accuracy(spark, sf):
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("detection", "localization", "analysis", "mitigation", "other")))
    runs = views.table(spark, sf, "orders").select(F.concat(F.lit("app-"), F.get(names, (k % 5).cast("int")), F.lit("-"), k.cast("string")).alias("task_id"), (F.col("o_custkey") % 3 != 0).alias("correct"))
    return report.accuracy(runs)


@query
def e8_worker_counts(spark, sf):
    return report.worker_counts(views.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus") == "F").alias("success")))
