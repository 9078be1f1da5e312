import pytest
from pyspark.sql import functions as F

from rootscope.operators import causal, graph as G, infra, rca
from rootscope.sources import tables

from .test_spans import frame

EDGES = "src string, dst string"


def test_call_edges_last_parent_wins(spark):
    df = frame(spark, [{"span_id": "p", "service_name": "old"}, {"trace_id": "t2", "span_id": "p", "service_name": "new"}, {"span_id": "c", "service_name": "db", "parent_span": "p", "duration_ms": 4.0, "has_error": True}, {"span_id": "d", "service_name": "db", "parent_span": "p", "duration_ms": 1.0, "response": "500"}, {"span_id": "e", "service_name": "new", "parent_span": "p"}])
    r = G.call_edges(df).collect()
    assert [(x.src, x.dst, x.call_count, x.avg_duration_ms, x.error_count) for x in r] == [("new", "db", 2, 2.5, 1)]
    assert {x.id for x in G.service_nodes(G.call_edges(df), __import__("rootscope.operators.spans", fromlist=["x"]).service_stats(df)).collect()} == {"old", "new", "db"}


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "d"), ("c", "x")], EDGES)
    assert sorted(r.cycle for r in G.cycles(e).collect()) == [["a", "b", "c"], ["b", "c"], ["d"]]
    assert sorted(r.cycle for r in G.cycles(e, 2).collect()) == [["b", "c"], ["d"]]
    assert rca.upstream_paths(e, "b").count() > 0


def plain_rank(edges, ids, alpha=0.85, restart=None):
    jump = {i: 1 / len(restart) if i in restart else 0.0 for i in ids} if restart else {i: 1 / len(ids) for i in ids}
    out = {i: sum(w for a, _, w in edges if a == i) for i in ids}
    r = {i: 1 / len(ids) for i in ids}
    for _ in range(300):
        lost = sum(r[i] for i in ids if not out[i])
        r = {i: alpha * (sum(r[a] * w / out[a] for a, b, w in edges if b == i) + lost * jump[i]) + (1 - alpha) * jump[i] for i in ids}
    return r


def test_pagerank(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("a", "d", 3.0), ("e", "d", 1.0)]
    e = spark.createDataFrame(edges, "src string, dst string, w double")
    for restart in (None, {"b", "e"}):
        got = {r.id: r.score for r in G.pagerank(e, weight="w", tol=1e-9, restart=spark.createDataFrame([(x,) for x in restart], "id string") if restart else None).collect()}
        assert got == pytest.approx(plain_rank(edges, "abcde", restart=restart), abs=1e-6) and sum(got.values()) == pytest.approx(1)
    assert G.pagerank(e.limit(0)).count() == 0


def test_depth_is_that_of_the_first_path(spark):
    # the path through c ends first in order although x is nearer on another one
    e = spark.createDataFrame([("x", "s"), ("a", "s"), ("x", "a"), ("r", "x")], EDGES)
    paths = [(r.path_no, r.path) for r in rca.upstream_paths(e, "s").orderBy("path_no").collect()]
    assert paths == [(1, ["s", "x", "r"]), (2, ["s", "a", "x", "r"])]
    assert {r.service: r.depth for r in rca.candidates(rca.upstream_paths(e, "s"), "s").collect()} == {"s": 0, "x": 1, "r": 2, "a": 1}
    assert rca.upstream_paths(e, "nowhere").count() == 0


def test_paths_keep_their_bounds(spark):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(9)]
    e = spark.createDataFrame([(*x, "CALLS") for x in chain] + [("p", "n0", "COLOCATED"), ("q", "p", "RUNS_ON"), ("z", "q", "RUNS_ON")], EDGES + ", edge_type string")
    got = {len(r.path) for r in rca.upstream_paths(e, "n0", 5, 2).collect() if r.path[1].startswith("n")}
    assert got == {6}
    infra_only = [r.path for r in rca.upstream_paths(e, "n0", types=["COLOCATED", "RUNS_ON"]).collect()]
    assert infra_only == [["n0", "p", "q"]]
    wide = spark.createDataFrame([(f"a{i:03d}", "s") for i in range(30)], EDGES)
    with pytest.warns(UserWarning):
        assert rca.upstream_paths(wide, "s", max_paths=10).count() == 10


def test_scores_and_tree(spark):
    nodes = spark.createDataFrame([("a", 0.5, 100.0, 10), ("b", 0.0, 10.0, 20)], "id string, error_rate double, duration_mean_ms double, span_count long")
    base = spark.createDataFrame([("a", 50.0, 10.0), ("b", 10.0, 1.0)], "service string, ewma_mean double, ewma_std double")
    alerts = spark.createDataFrame([("a", "error_rate_high", 0.6)], "service string, anomaly_type string, score double")
    c = spark.createDataFrame([("a", 1), ("b", 0)], "service string, depth int")
    got = {r.service: r for r in rca.rank(rca.score_candidates(c, nodes, base, alerts)).collect()}
    # error-only weights .50 .15 .20 .10: .5*1 + .15*.5 + .2*.6 + .1*.5 + .03
    assert got["a"].confidence == pytest.approx(0.775) and got["a"].rank == 1 and got["a"].latency_z_score == 5.0
    assert got["b"].confidence == pytest.approx(0.1) and got["a"].evidence[0] == "Error rate=50.0%"
    near = spark.createDataFrame([("b", "a")], EDGES)
    withinfra = {r.service: r.confidence for r in rca.score_candidates(c, nodes, base, alerts, colocated=near).collect()}
    assert withinfra["b"] == pytest.approx(0.1 * 0.9 + 0.03)
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], EDGES)
    assert rca.shortest_path(e, "a", "d").first().path == ["a", "c", "d"] and rca.shortest_path(e, "d", "a").count() == 0
    ranked = rca.rank(rca.score_candidates(c, nodes, base, alerts))
    n, links = rca.fault_tree(ranked, e, "d")
    assert {r.service for r in n.collect()} == {"a", "b", "c", "d"} and {(r.src, r.dst) for r in links.collect()} == {("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")}
    order = spark.createDataFrame([("b", 0)], "service string, pos int")
    assert {r.service: r["rank"] for r in rca.reorder(ranked, order).collect()} == {"b": 1, "a": 2}
    deltas = spark.createDataFrame([("b", 0.5, True)], "service string, delta double, first boolean")
    assert {r.service: (r["rank"], r.confidence) for r in rca.apply_deltas(ranked, deltas).collect()} == {"b": (1, 0.6), "a": (2, 0.775)}
    assert {r.service: r["rank"] for r in rca.apply_deltas(ranked, deltas, parity=True).collect()} == {"a": 1, "b": 2}


def test_silent_bottlenecks(spark):
    nodes = spark.createDataFrame([("p", 100.0, 0.0), ("c", 5.0, 0.01), ("x", 5.0, 0.5)], "id string, duration_mean_ms double, error_rate double")
    e = spark.createDataFrame([("p", "c", 80.0), ("p", "x", 80.0), ("c", "x", 1.0)], "src string, dst string, avg_duration_ms double")
    assert {(r.child, r.verdict) for r in rca.silent_bottlenecks(e, nodes).collect()} == {("c", "SILENT_BOTTLENECK"), ("x", "POSSIBLE_BOTTLENECK")}


def test_causality(spark):
    alerts = spark.createDataFrame([("svc-a",), ("svc-b",), ("svc-c",)], "service string")
    df = frame(spark, [{"span_id": f"{s}{i}", "service_name": s, "start_time": t + i} for s, t in (("svc-a", 200), ("svc-b", 300), ("svc-c", 100), ("other", 1)) for i in range(3)])
    assert [r.service for r in causal.temporal_order(df, alerts).orderBy("idx").collect()] == ["svc-c", "svc-a", "svc-b"]
    x = [((i * 7919) % 97) / 10 for i in range(60)]
    series = [{"span_id": f"a{i}", "service_name": "a", "duration_ms": x[i]} for i in range(50)] + [{"span_id": f"b{i}", "service_name": "b", "duration_ms": x[i - 5] if i >= 5 else 0.0} for i in range(50)] + [{"span_id": f"k{i}", "service_name": "k", "duration_ms": 3.0} for i in range(50)] + [{"span_id": "z", "service_name": "z"}]
    names = spark.createDataFrame([(s,) for s in "abkz"], "service string")
    got = {(r.a, r.b): r.strength for r in causal.lagged_strength(frame(spark, series), names).collect()}
    assert got[("a", "b")] > 0.5 and got[("b", "a")] == 0 and all(v == 0 for k, v in got.items() if "k" in k or "z" in k) and len(got) == 12
    totals = {r.service: r.score for r in causal.causal_totals(causal.lagged_strength(frame(spark, series), names)).collect()}
    assert totals["a"] == 1.0 and min(totals.values()) == 0.0
    cands = spark.createDataFrame([("a", 0.2, 2), ("b", 0.3, 1)], "service string, confidence double, rank int")
    order = spark.createDataFrame([("a", 0)], "service string, idx int")
    fused = causal.fuse_rank(cands, order, spark.createDataFrame([("a", 1.0)], "service string, score double")).orderBy("rank").collect()
    assert [(r.service, round(r.combined, 4)) for r in fused] == [("a", 0.6), ("b", 0.15)]


POD = "name string, service_name string, node_name string"


def test_infrastructure(spark):
    nodes = spark.createDataFrame([("svc-a", "service"), ("svc-b", "service")], "id string, node_type string")
    pods = spark.createDataFrame([("pod-a", "svc-a", "node-1"), ("pod-b", "svc-b", "node-1"), ("pod-c", "svc-c", "node-9")], POD)
    k8s = spark.createDataFrame([("node-1",)], "name string")
    alerts = spark.createDataFrame([("svc-a", 0.9), ("svc-b", 0.5)], "service string, score double")
    e = infra.infra_edges(nodes, pods, k8s, alerts)
    assert {r.edge_type: r["count"] for r in e.groupBy("edge_type").count().collect()} == {"DEPLOYED_AS": 2, "RUNS_ON": 2, "COLOCATED": 2}
    assert infra.infra_edges(nodes, pods, k8s, alerts.limit(0)).filter("edge_type = 'COLOCATED'").count() == 0
    pair = infra.noisy_neighbors(pods, alerts).collect()
    assert [(r.pod_a, r.pod_b, r.alerted_service) for r in pair] == [("pod-a", "pod-b", "svc-a")]
    assert {(r.src, r.dst) for r in infra.service_colocated(e).collect()} == {("svc-a", "svc-b"), ("svc-b", "svc-a")}
    assert tuple(infra.infra_counts(pods, k8s, e).first()) == (3, 1, 6)
    assert {r.key: r.pods for r in infra.index_maps(pods)["node_pods"].collect()} == {"node-1": ["pod-a", "pod-b"], "node-9": ["pod-c"]}


def test_json_listings(spark):
    pod = '{"items": [{"metadata": {"name": "p", "namespace": "n", "labels": {"app": "", "service": "my-svc"}}, "spec": {"nodeName": "node-1", "containers": [{"resources": {"requests": {"cpu": "100m"}}}]}}]}'
    node = '{"items": [{"metadata": {"name": "node-1"}, "status": {"capacity": {"cpu": "4"}, "conditions": [{"type": "Ready", "status": "True"}, {"type": "X", "status": "Unknown"}]}}]}'
    svc = '{"items": [{"metadata": {"name": "u"}, "spec": {"ports": [{"port": 80, "targetPort": 8080}, {"port": 9090, "targetPort": 9999}]}}]}'
    j = lambda s: spark.createDataFrame([(s,)], "json string")
    r = infra.flatten_pods(j(pod)).first()
    assert (r.name, r.service_name, r.node_name, r.cpu_request) == ("p", "my-svc", "node-1", "100m")
    n = infra.flatten_nodes(j(node)).first()
    assert n.capacity_cpu == "4" and [c.type for c in n.conditions] == ["Ready"]
    assert [(x.service, x.port_index, x.port) for x in infra.port_drift(j(svc)).collect()] == [("u", 1, 9090)]
    lines = spark.createDataFrame([("a 0/1 CrashLoopBackOff",), ("b 1/1 Running",)], "line string")
    assert infra.unhealthy_pods(lines).count() == 1


def test_sinks_write_once(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "service", 1)], "id string, node_type string, n int")
    e = spark.createDataFrame([("a", "b")], EDGES)
    for k in (1, 2):
        n, links = tables.upsert_graph(nodes.selectExpr("id", "node_type", f"n + {k} AS n"), e, str(tmp_path / "g"))
    assert n.count() == 1 and n.first().n == 3 and links.count() == 1
    df = frame(spark, [{"span_id": "1"}, {"span_id": "2", "parent_span": "1"}])
    for _ in range(2):
        t = tables.write_trace_graph(df, str(tmp_path / "t"))
    assert {r.edge_type: r["count"] for r in t.groupBy("edge_type").count().collect()} == {"CONTAINS": 2, "EXECUTED_BY": 2, "CHILD_OF": 1}
    c = spark.createDataFrame([("a", 1), ("b", 20)], "service string, rank int")
    assert tables.append_rca(c, "i", str(tmp_path / "r")).count() == 1 and tables.append_rca(c, "i", str(tmp_path / "r")).count() == 1


def test_causal_pairs_of_the_first_eight(spark, monkeypatch):
    from rootscope.plans import registry

    cands = spark.createDataFrame([(f"s{i}", i) for i in range(1, 10)], "service string, rank int")
    spans = spark.createDataFrame([(f"s{i}", float((i * k) % 7), 100 * i + k) for i in range(1, 10) for k in range(20)], "service_name string, duration_ms double, ingest_seq long")
    monkeypatch.setattr(registry, "Run", lambda spark, sf: type("R", (), {"spans": spans, "ranked": lambda self: (cands,)})())
    pairs = registry.c2_lagged_strength(spark, "").collect()
    assert len(pairs) == 56 and {p.a for p in pairs} == {f"s{i}" for i in range(1, 9)}
    assert registry.c3_causal_totals(spark, "").count() == 8


def test_small_graphs_take_few_jobs(spark):
    import random

    rng = random.Random(4)
    rows = sorted({(rng.choice("abcdefghijklmn"), rng.choice("abcdefghijklmn")) for _ in range(30)})
    e = G.cut(spark.createDataFrame(rows, "src string, dst string"))

    def jobs(group, f):
        spark.sparkContext.setJobGroup(group, "")
        out = f()
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, n

    pairs = lambda few: {(r.node, r.component) for r in G.strong_components(e, few).collect()}
    few, n_few = jobs("few", lambda: pairs(G.FEW))
    many, n_many = jobs("many", lambda: pairs(0))
    assert few == many and len(few) > 3
    assert n_few * 2 < n_many
    ring = [(chr(97 + i), chr(97 + (i + 1) % 12)) for i in range(12)]
    found, n = jobs("ring", lambda: {tuple(r.cycle) for r in G.cycles(G.cut(spark.createDataFrame(ring, "src string, dst string"))).collect()})
    assert found == {tuple("abcdefghijkl")}
    assert n < 60


def test_lagged_strength_in_blocks_is_that_of_all_places(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(5)
    long = {"a": 61, "b": 61, "c": 40, "d": 9, "e": 6, "flat": 50}
    values = {s: [1e6 if s == "flat" else rng.random() * 9 for _ in range(n)] for s, n in long.items()}
    values["b"][5:] = values["a"][:-5]
    rows = [(s, v, 1000 * i + j) for j, (s, x) in enumerate(values.items()) for i, v in enumerate(x)]
    spans = spark.createDataFrame(rows, "service_name string, duration_ms double, ingest_seq long").repartition(5)

    def corr(a, b):
        n = min(long[a], long[b])
        x, y = np.array(values[a][: n - 5]), np.array(values[b][5:n])
        return np.mean((x - x.mean()) * (y - y.mean())) / (x.std() * y.std()) if x.std() > 1e-9 and y.std() > 1e-9 else 0.0

    want = {(a, b): round(max(0.0, min(1.0, (corr(a, b) - corr(b, a)) / max(abs(corr(a, b)) + abs(corr(b, a)), 1e-9))), 4) if min(long[a], long[b]) >= 7 and corr(a, b) > max(corr(b, a), 0) else 0.0 for a in long for b in long if a != b}
    assert want["a", "b"] > 0.5
    monkeypatch.setattr("rootscope.operators.causal.BLOCK", 8)
    for plain in (1_000_000, 0):
        monkeypatch.setattr("rootscope.operators.order.PLAIN", plain)
        got = {(r.a, r.b): r.strength for r in causal.lagged_strength(spans, spans.select("service_name").toDF("service")).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-4 for k, v in want.items())


def test_lagged_strength_takes_any_number_of_services(spark, monkeypatch):
    import random

    rng = random.Random(8)
    rows = [(f"s{i:04}", rng.random(), 2000 * k + i) for i in range(1010) for k in range(8)]
    many = spark.createDataFrame(rows, "service_name string, duration_ms double, ingest_seq long")
    assert causal.lagged_strength(many, many.select("service_name").toDF("service")).count() == 1010 * 1009
    # parts of services give what one part gives
    few = many.filter("service_name < 's0030'")
    strengths = lambda: sorted(tuple(r) for r in causal.lagged_strength(few, few.select("service_name").toDF("service")).collect())
    whole = strengths()
    monkeypatch.setattr(causal, "PART", 7)
    assert strengths() == whole and len(whole) == 30 * 29 and len({x for *_, x in whole}) > 100


def test_fusion_by_month_takes_all_candidates(spark, monkeypatch):
    import random

    from rootscope.plans import incidents

    rng = random.Random(9)
    x = {i: [rng.random() for _ in range(40)] for i in range(1, 11)}
    x[10][5:] = x[9][:-5]  # the ninth leads the tenth
    spans = spark.createDataFrame([("m", f"s{i}", v, 100 * k + i, k) for i, y in x.items() for k, v in enumerate(y)], "month string, service_name string, duration_ms double, ingest_seq long, start_time long")
    cands = spark.createDataFrame([("m", f"s{i}", 0.1, i) for i in x], "month string, service string, confidence double, rank int")
    alerts = cands.select("month", "service").limit(0)
    monkeypatch.setattr(incidents, "Months", lambda spark, sf: type("M", (), {"spans": spans, "alerts": alerts, "ranked": lambda self: cands})())
    got = {r.service: r.combined for r in incidents.c4_fuse_rank_by_month(spark, "").collect()}
    assert len(got) == 10 and got["s9"] > 0.1


def test_scores_round_their_product_as_the_sql_does(spark):
    """0.60635 * 10,000 lies below 6,063.5: SQL's round gives 0.6063, the printed digits 0.6064."""
    totals = causal.causal_totals(spark.createDataFrame([("a", 1.2127), ("b", 2.0)], "a string, strength double"))
    assert {r.service: r.score for r in totals.collect()} == {"a": 0.6063, "b": 1.0}
    cands = spark.createDataFrame([("a", 0.60635, 1)], "service string, confidence double, rank int")
    assert rca.apply_deltas(cands, cands.select("service", F.lit(0.0).alias("delta"), F.lit(False).alias("first"))).first().confidence == 0.6063
