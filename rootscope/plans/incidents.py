"""Registered queries over many incidents at once: each month of the spans is one, and all go through the same jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import causal, detect, facts, graph, rca, spans
from .registry import START, Run, _ranks, query

BY = ["month"]


class Months:
    """What Run.small() makes, by month; written once."""

    def __init__(self, spark, sf: str):
        self.spans = Run(spark, sf).written(month=F.date_format(F.timestamp_micros("start_time"), "yyyy-MM"))
        series = graph.cut(detect.latency_series(self.spans, 100, by=BY), "series")
        self.stats, self.base = graph.cut(spans.service_stats(self.spans, by=BY), "stats"), graph.cut(detect.ewma_baseline(self.spans, by=BY, series=series), "base")
        self.edges = graph.cut(graph.call_edges(self.spans, by=BY), "edges")
        self.alerts = graph.cut(detect.detect_anomalies(self.spans, self.stats, self.base, by=BY, series=series), "alerts")

    def ranked(self) -> DataFrame:
        nodes = graph.service_nodes(self.edges, self.stats, by=BY)
        cands = rca.candidates(rca.upstream_paths(self.edges, START, by=BY), START, by=BY, incidents=self.edges)
        return graph.cut(rca.rank(rca.score_candidates(cands, nodes, self.base, self.alerts, by=BY), by=BY), "ranked")


@query
def g5_pagerank_by_month(spark, sf):
    m = Months(spark, sf)
    return _ranks(m.edges, restart=m.alerts.select("month", F.col("service").alias("id")), by=BY).select("month", "id", F.round("score", 6).alias("score"))


@query
def d11_primary_by_month(spark, sf):
    m = Months(spark, sf)
    return detect.primary_service(m.alerts, m.stats, by=BY)


@query
def r4_scores_by_month(spark, sf):
    return Months(spark, sf).ranked().select("month", "service", "confidence", "error_rate", "latency_z_score", "traversal_depth", "rank")


@query
def r10_paths_by_month(spark, sf):
    m = Months(spark, sf)
    pairs = m.ranked().filter("rank = 1").select("month", F.col("service").alias("a"), F.lit(START).alias("b"))
    return rca.shortest_paths(m.edges, pairs, by=BY).select("month", F.array_join("path", ">").alias("path"))


@query
def r11_fault_tree_by_month(spark, sf):
    m = Months(spark, sf)
    nodes, links = rca.fault_tree(m.ranked(), m.edges, START, by=BY)
    return links.union(nodes.select("month", "service", F.lit("")))


@query
def c4_fuse_rank_by_month(spark, sf):
    m = Months(spark, sf)
    ranked = m.ranked()
    s = graph.cut(causal.lagged_strength(m.spans, ranked.select("month", "service"), by=BY), "strength")
    order = causal.temporal_order(m.spans, m.alerts, by=BY)
    return causal.fuse_rank(ranked, order, causal.causal_totals(s, by=BY), by=BY).select("month", "service", "combined", "rank")


@query
def s1_suspects_by_month(spark, sf):
    s = Run(spark, sf).written().withColumn("month", F.date_format(F.timestamp_micros("start_time"), "yyyy-MM"))
    f = facts.merge_facts(facts.trace_facts(s, by=BY), "analysis", by=BY).withColumn("seq", F.concat_ws("|", "source", "relationship", "target"))
    out = facts.rank_suspects(graph.cut(f, "facts"), tol=0.0, max_iter=40, by=BY)
    return out.withColumns({"score": F.round("score", 6), "pagerank": F.round("pagerank", 6)})
