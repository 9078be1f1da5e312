"""Registered queries over the driver tables.

Each reads its tables whole. START is the service from which the upstream search of the examples begins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clip_middle, is_request, redact, strip_ansi
from ..operators import causal, detect, facts, forest, graph, infra, logs, memory, mitigate, rca, report, spans
from . import views

START = "svc-5-1"
FLAGSHIP = "d7_detect_anomalies"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


class Run:
    """The tables that most queries build on, each made on demand; all lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.raw = views.raw_spans(spark, sf_dir, placed=True)
        self.spans, self.is_written = spans.dedup_spans(self.raw), False

    def written(self, **more: Column) -> DataFrame:
        """The spans, deduplicated and written once, with `more` columns."""
        if not self.is_written:
            keep = ("trace_id", "span_id", "parent_span", "service_name", "operation_name", "start_time", "duration", "duration_ms", "has_error", "response", "status", "ingest_seq")
            raw = self.raw.select(*keep, *spans.ARRIVAL)  # what is not kept isn't shuffled
            once = spans.dedup_spans(raw, spans.is_crowded(raw))
            self.spans, self.is_written = graph.cut(once.select(*keep, *(c.alias(n) for n, c in more.items())), "spans"), True
        return self.spans

    @property
    def stats(self) -> DataFrame:
        return spans.service_stats(self.spans)

    @functools.cached_property
    def series(self) -> DataFrame:
        """The newest 100 values of each service, written once: of them come baselines and current values."""
        return graph.cut(detect.latency_series(self.written(), 100), "series")

    @property
    def base(self) -> DataFrame:
        return detect.ewma_baseline(self.spans, series=self.series)

    @property
    def alerts(self) -> DataFrame:
        return detect.detect_anomalies(self.spans, self.stats, self.base, series=self.series)

    @property
    def edges(self) -> DataFrame:
        return graph.call_edges(self.spans)

    @property
    def nodes(self) -> DataFrame:
        return graph.service_nodes(self.edges, self.stats)

    def small(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """stats, baselines, alerts, edges and nodes, written once: one row for each service or pair of services. The spans that they read are written first."""
        self.written()
        stats, base, edges = graph.cut(self.stats, "stats"), graph.cut(self.base, "base"), graph.cut(self.edges, "edges")
        alerts = graph.cut(detect.detect_anomalies(self.spans, stats, base, series=self.series), "alerts")
        return stats, base, alerts, edges, graph.cut(graph.service_nodes(edges, stats), "nodes")

    def ranked(self) -> tuple[DataFrame, ...]:
        """Ranked candidates, then what small() gives."""
        parts = stats, base, alerts, edges, nodes = self.small()
        cands = rca.candidates(rca.upstream_paths(edges, START), START)
        return graph.cut(rca.rank(rca.score_candidates(cands, nodes, base, alerts)), "ranked"), *parts


# I: spans


@query
def i6_dedup_spans(spark, sf):
    return Run(spark, sf).spans.select("trace_id", "span_id", "service_name", "start_time", "duration", "has_error", "response", "ingest_seq")


@query
def i7_dedup_stats(spark, sf):
    return spans.dedup_stats(Run(spark, sf).raw)


@query
def i8_validate_spans(spark, sf):
    return spans.validate_spans(views.flawed_spans(spark, sf)).select("is_valid", "valid_count", "total_count", "validation_rate", F.array_join("errors", "; ").alias("errors"))


@query
def i9_orphan_spans(spark, sf):
    return spans.orphan_spans(Run(spark, sf).spans).select("trace_id", "span_id", "parent_span")


@query
def i10_service_stats(spark, sf):
    return spans.service_stats(Run(spark, sf).written())


@query
def i10_service_stats_by_month(spark, sf):
    s = Run(spark, sf).written().withColumn("month", F.date_format(F.timestamp_micros("start_time"), "yyyy-MM"))
    return spans.service_stats(s, by=["month"]).select("month", "service", "span_count", "error_count", "duration_p95_ms")


@query
def i12_overall_stats(spark, sf):
    return spans.overall_stats(Run(spark, sf).spans)


@query
def i13_ingest_summary(spark, sf):
    return spans.ingest_summary(views.flawed_spans(spark, sf, placed=True))


@query
def i19_discover_services(spark, sf):
    return spans.discover_services(views.pods(spark, sf), Run(spark, sf).spans)


# G: graph


@query
def g1_call_edges(spark, sf):
    return Run(spark, sf).edges


@query
def g2_service_nodes(spark, sf):
    return Run(spark, sf).small()[4]


#: Rounds of the PageRank queries: as many in their SQL.
ROUNDS = 40


def _ring(r: Run) -> DataFrame:
    """Edges of the closed traces; spans are read twice, so that they are written first."""
    return graph.call_edges(views.ring(r.written()))


def _ranks(edges: DataFrame, **more) -> DataFrame:
    return graph.pagerank(edges, tol=0.0, max_iter=ROUNDS, **more)


@query
def g3_cycles(spark, sf):
    return graph.cycles(graph.cut(_ring(Run(spark, sf)))).select(F.array_join("cycle", ">").alias("cycle"))


@query
def g3_strong_components(spark, sf):
    return graph.strong_components(graph.cut(_ring(Run(spark, sf))))


@query
def g4_pagerank(spark, sf):
    return _ranks(graph.cut(Run(spark, sf).edges)).select("id", F.round("score", 6).alias("score"))


@query
def g5_personal_pagerank(spark, sf):
    _, _, alerts, edges, _ = Run(spark, sf).small()
    return _ranks(edges, restart=alerts.select(F.col("service").alias("id"))).select("id", F.round("score", 6).alias("score"))


@query
def g6_fact_pagerank(spark, sf):
    f = facts.trace_facts(Run(spark, sf).written()).withColumn("seq", F.concat_ws("|", "source", "relationship", "target"))
    return _ranks(graph.cut(graph.fact_edges(f, facts.emit_weight(F.col("target")))), weight="w").select("id", F.round("score", 6).alias("score"))


@query
def g7_error_services(spark, sf):
    return graph.error_services(Run(spark, sf).spans)


@query
def g8_column_call_graph(spark, sf):
    return graph.column_call_graph(Run(spark, sf).spans)


@query
def g9_graph_json(spark, sf):
    *_, edges, nodes = Run(spark, sf).small()
    return graph.graph_json(nodes, edges)


@query
def g10_graph_summary(spark, sf):
    r = Run(spark, sf)
    *_, nodes = r.small()
    edges = graph.cut(_ring(r))
    ranks = _ranks(edges).withColumn("score", F.round("score", 9))
    return graph.graph_summary(nodes, edges, ranks).withColumn("top", F.array_join("top", ","))


# D: detection


@query
def d1_request_spans(spark, sf):
    return Run(spark, sf).spans.groupBy(F.col("service_name").alias("service")).agg(F.count_if(is_request(F.col("operation_name"))).alias("requests"), F.count("*").alias("spans"))


@query
def d2_ewma_baseline(spark, sf):
    return Run(spark, sf).base


@query
def d3_current_latency(spark, sf):
    return detect.current_latency(Run(spark, sf).written()).select("service", F.round("current_value", 4).alias("current_value"))


@query
def d7_detect_anomalies(spark, sf):
    r = Run(spark, sf)
    r.written()
    return r.alerts.withColumn("current_value", F.round("current_value", 4))


@query
def d8_forest_features(spark, sf):
    stats, base, *_ = Run(spark, sf).small()
    return detect.forest_features(stats, base)


@query
def d9_forest_alerts(spark, sf):
    stats, base, *_ = Run(spark, sf).small()
    return forest.forest_alerts(graph.cut(detect.forest_features(stats, base)), stats, base).withColumn("current_value", F.round("current_value", 4))


@query
def d11_primary_service(spark, sf):
    stats, _, alerts, *_ = Run(spark, sf).small()
    return detect.primary_service(alerts, stats)


@query
def d12_apply_labels(spark, sf):
    a = Run(spark, sf).small()[2]
    labels = a.select("service", F.when(F.col("service").endswith("-1"), "SYMPTOM").otherwise("ROOT_CAUSE").alias("label"))
    return detect.apply_labels(a, labels).select("service", "label", "score")


@query
def d13_column_means(spark, sf):
    return detect.column_means_over(views.table(spark, sf, "lineitem")).withColumn("mean", F.round("mean", 4))


@query
def d16_confirm_anomaly(spark, sf):
    return detect.confirm_anomaly(Run(spark, sf).small()[2])


@query
def d17_alert_context(spark, sf):
    _, _, alerts, edges, _ = Run(spark, sf).small()
    return detect.alert_context(edges, alerts)


# R, C: root cause


@query
def r1_upstream_paths(spark, sf):
    return rca.upstream_paths(Run(spark, sf).edges, START).select("path_no", F.array_join("path", ">").alias("path"))


@query
def r2_candidates(spark, sf):
    return rca.candidates(rca.upstream_paths(Run(spark, sf).edges, START), START)


@query
def r3_adaptive_weights(spark, sf):
    return rca.adaptive_weights(Run(spark, sf).small()[2])


@query
def r4_score_candidates(spark, sf):
    return Run(spark, sf).ranked()[0].select("service", "confidence", "error_rate", "latency_z_score", "traversal_depth")


@query
def r7_silent_bottlenecks(spark, sf):
    *_, edges, nodes = Run(spark, sf).small()
    return rca.silent_bottlenecks(edges, nodes)


@query
def r8_boost_silent(spark, sf):
    cands, _, _, _, edges, nodes = Run(spark, sf).ranked()
    return rca.boost_silent(cands, rca.silent_bottlenecks(edges, nodes)).select("service", "confidence")


@query
def r9_rank(spark, sf):
    return Run(spark, sf).ranked()[0].select("service", "confidence", "rank")


@query
def r10_shortest_path(spark, sf):
    cands, _, _, _, edges, _ = Run(spark, sf).ranked()
    pairs = cands.filter("rank = 1").select(F.col("service").alias("a"), F.lit(START).alias("b"))
    return rca.shortest_paths(edges, pairs).select(F.array_join("path", ">").alias("path"))


@query
def r11_fault_tree(spark, sf):
    cands, _, _, _, edges, _ = Run(spark, sf).ranked()
    nodes, links = rca.fault_tree(cands, edges, START)
    return links.union(nodes.select("service", F.lit("")))


@query
def r15_pick_start(spark, sf):
    r = Run(spark, sf)
    errors = graph.cut(graph.error_services(r.written()))
    ranks = _ranks(graph.cut(r.edges), restart=errors.select(F.col("service").alias("id")))
    return rca.pick_start(ranks.withColumn("score", F.round("score", 9)), errors)


@query
def c1_temporal_order(spark, sf):
    r = Run(spark, sf)
    alerts = r.small()[2]
    return causal.temporal_order(r.spans, alerts)


def _strength(spark, sf, more=False):
    r = Run(spark, sf)
    ranked = r.ranked()
    s = graph.cut(causal.lagged_strength(r.spans, ranked[0].filter("rank <= 8").select("service")))
    return (r, ranked, s) if more else s


@query
def c2_lagged_strength(spark, sf):
    return _strength(spark, sf)


@query
def c3_causal_totals(spark, sf):
    return causal.causal_totals(_strength(spark, sf))


@query
def c4_fuse_rank(spark, sf):
    r, ranked, s = _strength(spark, sf, True)
    return causal.fuse_rank(ranked[0], causal.temporal_order(r.spans, ranked[3]), causal.causal_totals(s)).select("service", "combined", "rank")


# N: infrastructure


@query
def n5_infra_edges(spark, sf):
    _, _, alerts, _, nodes = Run(spark, sf).small()
    return infra.infra_edges(nodes, views.pods(spark, sf), views.machines(spark, sf), alerts)


@query
def n8_noisy_neighbors(spark, sf):
    return infra.noisy_neighbors(views.pods(spark, sf), Run(spark, sf).small()[2]).select("pod_a", "pod_b", "shared_node", "alerted_service")


# T, S: facts and suspects


@query
def t3_trace_facts(spark, sf):
    return facts.trace_facts(Run(spark, sf).written())


@query
def t6_pod_facts(spark, sf):
    return facts.pod_facts(views.pods(spark, sf))


@query
def t9_peer_outliers(spark, sf):
    return facts.peer_outliers(views.metrics(spark, sf))


@query
def t10_own_outliers(spark, sf):
    return facts.own_outliers(views.metrics(spark, sf))


@query
def t11_metric_facts(spark, sf):
    return facts.metric_facts(views.metrics(spark, sf))


@query
def t12_log_facts(spark, sf):
    return facts.log_facts(views.fault_lines(spark, sf))


@query
def t18_decide_incident(spark, sf):
    f = facts.trace_facts(Run(spark, sf).written()).unionByName(facts.metric_facts(views.metrics(spark, sf)))
    return facts.decide_incident(f)


@query
def t18_decide_with_logs(spark, sf):
    """One row for the shape of spans and metrics beside logs and pods: each source of lines is an incident of its own, by the kind of fact."""
    f = facts.trace_facts(Run(spark, sf).written()).withColumn("kind", F.lit("spans")).unionByName(facts.log_facts(views.fault_lines(spark, sf)).withColumn("kind", F.lit("logs"))).unionByName(facts.pod_facts(views.pods(spark, sf)).withColumn("kind", F.lit("pods")))
    return facts.decide_incident(f, by=["kind"])


def _all_facts(spark, sf):
    f = facts.trace_facts(Run(spark, sf).written()).unionByName(facts.pod_facts(views.pods(spark, sf))).unionByName(facts.log_facts(views.fault_lines(spark, sf)))
    f = f.unionByName(facts.metric_facts(views.metrics(spark, sf)))
    return graph.cut(facts.merge_facts(f, "analysis").withColumn("seq", F.concat_ws("|", "source", "relationship", "target")))


@query
def t17_merge_facts(spark, sf):
    return _all_facts(spark, sf).drop("seq")


@query
def t19_fact_rows(spark, sf):
    return facts.fact_rows(_all_facts(spark, sf), "s1").drop("extracted_at")


@query
def t22_neighbourhood(spark, sf):
    rows = graph.cut(facts.fact_rows(_all_facts(spark, sf), "s1"))
    return facts.fact_lines(facts.neighbourhood(rows, "svc-5", 1))


@query
def t22_many_seeds(spark, sf):
    """Every source of a fact as a seed, none of whose facts is left out."""
    rows = graph.cut(facts.fact_rows(_all_facts(spark, sf), "s1"))
    seeds = rows.filter("source NOT LIKE 'user%'").select("session_id", F.col("source").alias("seed")).distinct()
    return facts.neighbourhoods(rows, seeds, 1).select("seed", "place", "edge_id")


def _suspects(spark, sf):
    return graph.cut(facts.rank_suspects(_all_facts(spark, sf), tol=0.0, max_iter=ROUNDS))


@query
def s1_rank_suspects(spark, sf):
    return _suspects(spark, sf).withColumns({"score": F.round("score", 6), "pagerank": F.round("pagerank", 6)})


@query
def s7_rank_facts(spark, sf):
    return facts.rank_facts(_suspects(spark, sf))


# L: logs


@query
def l1_error_lines(spark, sf):
    r = Run(spark, sf)
    return logs.error_lines(r.spans, r.ranked()[0].filter("rank <= 5"))


@query
def l3_top_patterns(spark, sf):
    return logs.top_patterns(views.log_lines(spark, sf))


@query
def l4_fault_type(spark, sf):
    return logs.fault_type(views.fault_lines(spark, sf))


@query
def l5_clusters(spark, sf):
    return logs.clusters(views.fault_lines(spark, sf)).withColumn("services", F.array_join("services", ","))


@query
def l8_redact(spark, sf):
    text = redact(strip_ansi(F.coalesce("text", F.lit(""))))
    return views.table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("sha"))


@query
def l9_clip_middle(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", clip_middle(F.coalesce("text", F.lit("")), 200).alias("clipped"))


# M, A, E: memory, mitigation, reports


@query
def m1_signature(spark, sf):
    s, a = F.col("service"), F.col("anomaly_type")
    return Run(spark, sf).small()[2].select("service", memory.signature(s, a).alias("signature"), memory.signature(s, a, s).alias("signature_full"))


def _incidents(spark, sf):
    """An incident for each order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = views.table(spark, sf, "orders").select(
        F.concat(F.lit("o"), k.cast("string")).alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat(F.lit("svc-"), (c % 50).cast("string")).alias("service"), F.col("o_orderpriority").alias("anomaly_type"),
        F.concat(F.lit("svc-"), (c % 7).cast("string")).alias("root_cause"), F.lit(None).cast("array<string>").alias("affected_services"), F.when(k % 3 == 0, "kubectl rollout restart").alias("resolution"), F.lit(0.5).alias("confidence"),
        F.when(F.col("o_orderstatus") == "P", "false_positive").when(k % 3 == 0, "resolved").alias("outcome"), F.create_map().cast("map<string,string>").alias("metadata"), (k % 50 == 0).alias("asked"),
    )
    return o


@query
def m3_find_similar(spark, sf):
    o = _incidents(spark, sf).withColumn("anomaly_type", F.lit(""))
    rows = memory.incident_rows(o)
    asked = o.filter("asked").select(F.col("id").alias("case_id"), memory.signature(F.col("service"), F.lit("")).alias("signature"), "root_cause")
    return memory.find_similar(rows, asked).select("case_id", "id", "rank")


@query
def m5_false_positives(spark, sf):
    return memory.false_positives(memory.incident_rows(_incidents(spark, sf)))


@query
def m6_incident_count(spark, sf):
    return memory.incident_count(memory.incident_rows(_incidents(spark, sf)))


@query
def a1_mitigation_plan(spark, sf):
    ranked = Run(spark, sf).ranked()[0]
    cases = memory.incident_rows(_incidents(spark, sf)).withColumn("root_cause", F.concat("root_cause", F.lit("-1")))
    plan = mitigate.approve(mitigate.mitigation_plan(ranked, cases))
    return mitigate.screen_commands(plan)


@query
def a4_health(spark, sf):
    stats, _, alerts, *_ = Run(spark, sf).small()
    a = alerts.groupBy("service").agg(F.count("*").alias("alerts"))
    p = views.pods(spark, sf).filter("status <> 'Running'").groupBy(F.col("service_name").alias("service")).agg(F.count("*").alias("unhealthy"))
    counts = stats.select("service", F.col("error_count").alias("violations")).join(a, "service", "left").join(p, "service", "left").fillna(0)
    return mitigate.health(counts).select("service", "alerts", "violations", "unhealthy", "score")


@query
def a6_revert_commands(spark, sf):
    return mitigate.revert_commands(views.action_log(spark, sf))


@query
def e1_incident_report(spark, sf):
    r = Run(spark, sf)
    cands, stats, _, alerts, edges, nodes = r.ranked()
    summary = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each
    found = logs.clusters(logs.error_lines(r.spans, cands.filter("rank <= 5")))
    cases = memory.incident_rows(_incidents(spark, sf)).withColumn("root_cause", F.concat("root_cause", F.lit("-1"))).join(cands.filter("rank = 1").select(F.col("service").alias("root_cause")), "root_cause", "left_semi")
    one = report.incident_report("INC-1", alerts, cands, found, mitigate.mitigation_plan(cands), summary, cases, detect.primary_service(alerts, stats))
    line = lambda col, f: F.array_join(F.transform(col, f), ",")
    causes = line("rca.top_3_causes", lambda x: F.concat(x["service"], F.lit("="), x["confidence"].cast("string")))
    actions = line("mitigation.actions", lambda x: F.concat_ws(":", x["sequence"].cast("string"), x["action"], x["service"]))
    return one.select("incident_id", "summary.*", "graph.*", causes.alias("causes"), line("log_analysis.clusters", lambda x: x["pattern"]).alias("patterns"), "mitigation.action_count", actions.alias("actions"), "memory.similar_cases")


@query
def e5_token_usage(spark, sf):
    c = views.table(spark, sf, "conversations").select(F.col("role").alias("caller"), F.lit("conversation").alias("model"), F.length("text").cast("long").alias("in_tokens"), F.col("turn").alias("out_tokens"), (F.col("turn") / 10.0).alias("elapsed"))
    return report.token_usage(c)


@query
def e6_run_rollup(spark, sf):
    k = F.col("event_id") % 3
    runs = views.table(spark, sf, "events").select(F.col("event_type").alias("task_type"), F.when(k == 0, "passed").when(k == 1, "failed").otherwise("skipped").alias("status"), F.col("value").alias("seconds"))
    return report.run_rollup(runs)


