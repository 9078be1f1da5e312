import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rootscope.operators import detect, forest, graph, memory, order, rca, spans
from rootscope.sources import history, tables
from tests.test_spans import frame

EDGE = "src string, dst string, call_count long, error_rate double"


def test_percentiles_and_places_against_sorting(spark):
    """A hot key, ties and nulls over several ranges."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), float(rng.randrange(40)) if rng.random() < 0.95 else None, k) for k in range(1500)]
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(5)
    by = defaultdict(list)
    for k, v, _ in rows:
        if v is not None:
            by[k].append(v)
    got = {r.k: r for r in order.percentiles(df, ["k"], "v", {"lo": 0.0, "half": 0.5, "p95": 0.95, "all": 1.0}).collect()}
    mid = {r.k: r.m for r in order.percentiles(df, ["k"], "v", {"m": 0.5}, between=True).collect()}
    assert set(got) == set(by) == set(mid)
    for k, v in by.items():
        v.sort()
        at = lambda p: v[max(1, math.ceil(p * len(v))) - 1]  # noqa: B023, E731
        assert (got[k].lo, got[k].half, got[k].p95, got[k]["all"]) == (v[0], at(0.5), at(0.95), v[-1]) and mid[k] == pytest.approx(np.median(v))
    places = defaultdict(list)
    for r in order.numbered(df, ["k"], ["i"]).collect():
        places[r.k].append((r.i, r.pos, r.n))
    want = Counter(k for k, *_ in rows)
    assert all([p for _, p, _ in sorted(x)] == list(range(1, want[k] + 1)) and {n for *_, n in x} == {want[k]} for k, x in places.items())
    assert order.percentiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0 == order.numbered(df.limit(0), ["k"], ["i"]).count()


def test_pagerank_is_the_same_in_one_row_and_in_rounds(spark):
    rng = random.Random(2)
    e = spark.createDataFrame([(f"n{rng.randrange(12)}", f"n{rng.randrange(15)}", rng.random() + 0.1) for _ in range(40)], "src string, dst string, w double").dropDuplicates(["src", "dst"])
    restart = spark.createDataFrame([("n3",), ("n14",)], "id string")
    for more in ({"weight": "w"}, {"restart": restart}):
        one = {r.id: r.score for r in graph.pagerank(e, tol=0.0, max_iter=12, **more).collect()}
        many = {r.id: r.score for r in graph.pagerank(e, tol=0.0, max_iter=12, small=0, **more).collect()}
        assert one.keys() == many.keys() and sum(one.values()) == pytest.approx(1) and all(one[k] == pytest.approx(many[k], abs=1e-12) for k in one)


def test_tables_are_kept_by_a_log(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, at int, kind string")
    monkeypatch.setattr(tables, "MERGE", 3)
    put = lambda df: {(r.k, r.v) for r in tables.upsert(df, path, ["k"], "at", "kind").collect()}
    assert put(rows(("a", 1, 1, "x"), ("b", 1, 1, "y"))) == {("a", 1), ("b", 1)}
    assert put(rows(("a", 2, 2, "x"))) == {("a", 2), ("b", 1)} == put(rows(("a", 2, 2, "x")))
    assert put(rows(("b", 0, 0, "y"), ("c", 3, 1, "x"))) == {("a", 2), ("b", 1), ("c", 3)}  # an older row, and parts are merged
    assert len(tables._entry(spark, path)[1]) == 1
    # a write that never came to its entry leaves the table as it was, and of two writers of one number one fails
    rows(("z", 9, 9, "x")).write.partitionBy("kind").parquet(f"{path}/part-lost")
    assert {r.k for r in tables.read_table(spark, path, ["k"], "at").collect()} == {"a", "b", "c"}
    with pytest.raises(RuntimeError):
        tables._commit(spark, path, 4, [])
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "none"), ["k"], "at")


def test_sessions_and_facts_are_stored_once(spark, tmp_path):
    s = spark.createDataFrame([("s1", "q", "p", "open", 1)], "session_id string, user_query string, master_plan string, global_status string, updated_at int")
    tables.store_sessions(s, str(tmp_path / "s"))
    assert tables.store_sessions(s, str(tmp_path / "s")).count() == 1
    f = spark.createDataFrame([("e1", "s1", 1), ("e2", "s2", 1)], "edge_id string, session_id string, extracted_at int")
    tables.store_facts(f, str(tmp_path / "f"))
    assert tables.store_facts(f, str(tmp_path / "f")).count() == 2


def test_similar_cases_of_a_hot_root_cause(spark):
    """Each key's list is short, repeated ids count once, and the best ones are those of all incidents."""
    rng = random.Random(3)
    rows = [(f"i{rng.randrange(150)}", rng.randrange(60), f"s{rng.randrange(6)}", "full", "hot" if rng.random() < 0.7 else "cold") for _ in range(400)]
    latest = {}  # the row of an id that holds
    for r in rows:
        latest[r[0]] = max(latest.get(r[0], (-1,)), r[1:])
    i = spark.createDataFrame(rows, "id string, ts int, signature string, signature_full string, root_cause string")
    asked = spark.createDataFrame([("c1", "s1", "hot"), ("c2", "s2", None), ("c3", "none", "cold")], "case_id string, signature string, root_cause string")
    got = defaultdict(list)
    for r in memory.find_similar(i, asked).orderBy("case_id", "rank").collect():
        got[r.case_id].append(r.ts)
    for case, keys in (("c1", [("sig", "s1"), ("root", "hot")]), ("c2", [("sig", "s2")]), ("c3", [("root", "cold")])):
        best = [ts for ts, sig, _, root in latest.values() if ("sig", sig) in keys or ("root", root) in keys]
        assert sorted(got[case], reverse=True) == sorted(best, reverse=True)[:5]


@pytest.mark.parametrize("merge", [16, 4])
def test_similar_cases_from_lists(spark, tmp_path, monkeypatch, merge):
    """After any writes the lists give what a search of all incidents gives: ids that move, leave a full list, come late or come twice."""
    monkeypatch.setattr(history, "MERGE", merge)
    rng, path, schema = random.Random(merge), str(tmp_path / "h"), "id string, ts int, signature string, signature_full string, root_cause string, note string"
    made = []
    asked = spark.createDataFrame([("c1", "s1", "hot"), ("c2", "s2", None), ("c3", "none", "cold"), ("c4", "f3", ""), ("c5", None, "rare")], "case_id string, signature string, root_cause string")
    with pytest.raises(ValueError):
        history.find_similar(spark, path, asked)
    for turn in range(4):
        at = rng.sample(range(30), 30)
        rows = [(f"i{rng.randrange(40)}", 4 * (300 * rng.randrange(turn + 2) + t) + turn, rng.choice(["s1", "s2", "s3", None]), f"f{rng.randrange(4)}", rng.choice(["hot", "hot", "cold", "rare"]), f"{turn}-{t}") for t in at]
        if turn == 2:  # the newest of a full list all move away
            top = sorted(history.incidents(spark, path).filter("root_cause = 'hot'").collect(), key=lambda r: -r.ts)[:4]
            rows = [(r.id, 5000 + k, "s9", "f9", "moved", "m") for k, r in enumerate(top)]
        made += rows
        history.add(spark.createDataFrame(rows, schema), path)
        every = spark.createDataFrame(made, schema)
        key = lambda df: sorted((r.case_id, r["rank"], r.id, r.ts, r.note) for r in df.collect())
        assert key(history.find_similar(spark, path, asked)) == key(memory.find_similar(every, asked))
        assert sorted(map(str, history.incidents(spark, path).collect())) == sorted(map(str, memory.latest(every).collect()))
    history.add(spark.createDataFrame([], schema), path)
    assert key(history.find_similar(spark, path, asked)) == key(memory.find_similar(every, asked))
    assert len(history._parts(spark, path)[1]) < merge
    with pytest.raises(ValueError):
        history.find_similar(spark, path, asked, limit=6)


def test_trees_as_arrays():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    trees = [forest._grow(x[rng.choice(200, 64)], 6, 42, k) for k in range(5)]

    def depth(tree, row):
        d = 0
        while len(tree) > 1:
            tree, d = tree[2] if row[tree[0]] < tree[1] else tree[3], d + 1
        return d + forest._path_norm(tree[0])

    assert np.allclose(forest._mean_depth(forest._flat(trees), x), [np.mean([depth(t, r) for t in trees]) for r in x])


def graph_of(spark):
    return spark.createDataFrame([("a", "b", 5, 0.5), ("b", "c", 9, 0.0), ("c", "a", 1, 0.0), ("x", "y", 2, 0.0)], EDGE)


def test_context_and_ranks_of_alerts(spark):
    alerts = spark.createDataFrame([("b", 0.9), ("q", 0.1)], "service string, score double")
    assert [(r.src, r.dst) for r in detect.alert_context(graph_of(spark), alerts).collect()] == [("b", "c"), ("a", "b")]
    ranks = spark.createDataFrame([("b", 0.3)], "id string, score double")
    assert {r.service: r.pagerank for r in detect.alert_ranks(alerts, ranks).collect()} == {"b": 0.3, "q": None}


def test_graph_as_json_and_summary(spark):
    nodes = spark.createDataFrame([(n, "service") for n in "abcxy"], "id string, node_type string")
    text = graph.graph_json(nodes, graph_of(spark)).first().json
    assert text.startswith('{"directed":true,"nodes":[{"id":"a","node_type":"service"}') and '{"source":"x","target":"y","call_count":2,"error_rate":0.0}' in text
    s = graph.graph_summary(nodes, graph_of(spark), nodes.selectExpr("id", "double(ascii(id)) AS score")).first()
    assert (s.node_count, s.edge_count, s.cycle_count, s.top) == (5, 4, 1, ["y", "x", "c", "b", "a"])
    calls = spark.createDataFrame([("p", "s"), ("p", "s"), ("s", "s"), (None, "s")], "caller string, service string")
    assert [tuple(r) for r in graph.column_call_graph(calls).collect()] == [("p", "s")]
    with pytest.raises(ValueError):
        graph.column_call_graph(nodes)


def test_boost_and_start(spark):
    cands = spark.createDataFrame([("a", 0.9, []), ("b", 0.5, ["x"])], "service string, confidence double, evidence array<string>")
    found = spark.createDataFrame([("a", "SILENT_BOTTLENECK", 0.8), ("b", "POSSIBLE_BOTTLENECK", 0.7)], "child string, verdict string, absorption double")
    got = {r.service: (r.confidence, len(r.evidence)) for r in rca.boost_silent(cands, found).collect()}
    assert got == {"a": (1.0, 1), "b": (0.5, 1)}
    ranks = spark.createDataFrame([("a", 0.1), ("b", 0.4), ("c", 0.4), ("d", 0.9)], "id string, score double")
    assert rca.pick_start(ranks, spark.createDataFrame([("c",), ("b",), ("a",)], "service string")).first().service == "b"


def test_overall_figures_and_services(spark):
    rows = [{"span_id": "1"}, {"span_id": "1"}, {"span_id": "2", "service_name": "jaeger-0", "parent_span": "gone", "has_error": True}, {"span_id": "3", "service_name": "pay-1", "response": "Unknown"}]
    df = frame(spark, rows)
    s = spans.ingest_summary(df).first()
    assert (s.original_count, s.unique_count, s.duplicates_removed, s.orphan_count, s.error_spans, s.unique_services) == (4, 3, 1, 1, 1, 3)
    o = spans.overall_stats(df).first()
    assert (o.total_spans, o.unique_spans, o.error_spans) == (4, 3, 1)
    pods = spark.createDataFrame([("cart-7",), ("kube",)], "name string")
    assert {r.service for r in spans.discover_services(pods, df).collect()} >= {"cart", "pay"} and "jaeger" not in {r.service for r in spans.discover_services(pods, df).collect()}
