"""Operators over many incidents at once, against a run for each; searches in graphs against plain ones."""

import itertools
import random
import warnings

import pytest
from pyspark.sql import functions as F

from rootscope.operators import causal, detect, facts as T, graph as G, memory, rca, spans as S
from rootscope.operators.order import numbered, percentiles

EDGE = "inc string, src string, dst string"
INCIDENTS = ["a", None]


def span_rows(spark, seed=1):
    """Spans of three incidents, one without a key, each with its own services, faults and repeats of ids between incidents."""
    rng = random.Random(seed)
    rows = []
    for inc in INCIDENTS:
        for i in range(120):
            svc, up = rng.randrange(6), f"s{rng.randrange(i)}" if i and rng.random() < 0.8 else "ROOT"
            d = rng.choice([5, 6, 7, 80 if svc == 2 else 8])
            rows.append((inc, "t", f"s{i}", up, f"svc{svc}-app-{rng.randrange(2)}", rng.choice(["/x", "db"]), 1000 * i, d * 1000, float(d), rng.random() < 0.1 * svc, "500" if rng.random() < 0.1 else "200", i))
    return spark.createDataFrame(rows, "inc string, trace_id string, span_id string, parent_span string, service_name string, operation_name string, start_time long, duration long, duration_ms double, has_error boolean, response string, ingest_seq long").withColumn("status", F.lit("")).cache()


def chain(s, by):
    """Every operator from spans to ranks; a dict of rows."""
    stats, base, edges = S.service_stats(s, by=by), detect.ewma_baseline(s, by=by), G.cut(G.call_edges(s, by=by))
    alerts = G.cut(detect.detect_anomalies(s, stats, base, by=by))
    nodes = G.service_nodes(edges, stats, by=by)
    start = "svc2-app-0"
    paths = rca.upstream_paths(edges, start, 3, by=by)
    ranked = G.cut(rca.rank(rca.score_candidates(rca.candidates(paths, start, by=by, incidents=edges), nodes, base, alerts, by=by), by=by))
    silent = rca.boost_silent(ranked, rca.silent_bottlenecks(edges, nodes, by=by), by=by)
    strength = G.cut(causal.lagged_strength(s, ranked.filter("rank <= 4").select(*by, "service"), by=by))
    fused = causal.fuse_rank(ranked, causal.temporal_order(s, alerts, by=by), causal.causal_totals(strength, by=by), by=by)
    tree_nodes, tree_links = rca.fault_tree(ranked, edges, start, by=by)
    f = G.cut(T.merge_facts(T.trace_facts(s, by=by), "x", by=by).withColumn("seq", F.concat_ws("|", "source", "relationship", "target")))
    suspects = T.rank_suspects(f, by=by)
    out = {
        "stats": stats.drop("operations"), "base": base, "edges": edges.drop("operations"), "alerts": alerts, "paths": paths, "ranked": ranked.drop("evidence", "components"), "silent": silent.select(*by, "service", "confidence"), "strength": strength, "fused": fused.select(*by, "service", "combined", "rank"),
        "tree": tree_links.union(tree_nodes.select(*by, "service", F.lit(""))), "facts": f, "suspects": suspects, "rank_facts": T.rank_facts(suspects, by=by), "decided": T.decide_incident(f, by=by), "primary": detect.primary_service(alerts, stats, by=by), "confirmed": detect.confirm_anomaly(alerts, by=by),
        "start": rca.pick_start(G.pagerank(edges, by=by), G.error_services(s, by=by), by=by), "labels": detect.apply_labels(alerts, alerts.select(*by, "service", F.lit("SYMPTOM").alias("label")).limit(2), by=by).select(*by, "score") if not by else None,
    }
    return {k: [tuple(r) for r in v.collect()] for k, v in out.items() if v is not None}


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=str)


def test_many_incidents_are_single_runs(spark):
    s = span_rows(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        both = chain(s, ["inc"])
        for inc in INCIDENTS:
            one = chain(s.filter(F.col("inc").eqNullSafe(F.lit(inc))), [])
            for name, rows in one.items():
                if name in both:
                    assert rounded(r[1:] for r in both[name] if r[0] == inc) == rounded(rows), (inc, name)


def test_null_keys_stay(spark):
    s = span_rows(spark)
    stats = S.service_stats(s, by=["inc"])
    assert stats.filter("inc IS NULL").count() == s.filter("inc IS NULL").select("service_name").distinct().count()


def all_paths(edges, start, depth):
    """Maximal acyclic paths against the calls, of at most `depth` edges."""
    into = {}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
    out, todo = [], [(start,)]
    while todo:
        p = todo.pop()
        more = [x for x in into.get(p[-1], ()) if x not in p] if len(p) <= depth else []
        todo += [(*p, x) for x in more]
        if not more and len(p) > 1:
            out.append(p)
    return sorted(out, key=lambda p: (len(p), "\x01".join(p)))


def test_paths_are_cut_exactly(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for inc in range(12):
        names = [f"n{i:02d}" for i in range(rng.randint(3, 8))]
        edges = {(a, b) for a in names for b in names if rng.random() < (0.9 if inc % 2 else 0.5)}
        rows += [(str(inc), a, b) for a, b in edges]
        want[str(inc)] = all_paths([e for e in edges if e[0] != e[1]], "n00", 4)[:7]
    df = spark.createDataFrame(rows, EDGE)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = {}
        for r in rca.upstream_paths(df, "n00", 4, max_paths=7, by=["inc"]).orderBy("inc", "path_no").collect():
            got.setdefault(r.inc, []).append(tuple(r.path))
    assert got == {k: v for k, v in want.items() if v}


def test_paths_of_a_dense_graph(spark):
    """60 services with 40 callers each have about 40^5 paths; 201 are looked for."""
    names = [f"n{i:02d}" for i in range(60)]
    rows = [(names[(i + k) % 60], names[i]) for i in range(60) for k in range(1, 41)]
    with pytest.warns(UserWarning, match="more than 200"):
        got = [tuple(r.path) for r in rca.upstream_paths(spark.createDataFrame(rows, "src string, dst string"), "n00").orderBy("path_no").collect()]
    into = {n: sorted(a for a, b in rows if b == n) for n in names}

    def first(path):
        if len(path) == 6:
            yield path
            return
        for x in into[path[-1]]:
            if x not in path:
                yield from first((*path, x))

    assert got == list(itertools.islice(first(("n00",)), 200))


def strong(edges):
    reach = {a: {a} for e in edges for a in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = {x for x, r in reach.items() if a in r and b not in r}
            for x in new:
                reach[x].add(b)
                changed = True
    loops = {a for a, b in edges if a == b}
    out = {}
    for x in reach:
        own = {y for y in reach[x] if x in reach[y]}
        if len(own) > 1 or x in loops:
            out[x] = min(own)
    return out


def simple_cycles(edges):
    out, todo = set(), [(a, b) for a, b in edges if a < b]
    out |= {(a,) for a, b in edges if a == b}
    while todo:
        p = todo.pop()
        for a, b in edges:
            if a == p[-1] and b == p[0]:
                out.add(p)
            elif a == p[-1] and b > p[0] and b not in p:
                todo.append((*p, b))
    return out


def test_components_and_cycles(spark):
    rng = random.Random(5)
    edges, offset = set(), 0
    for size, density in ((1, 1), (5, 0.3), (6, 0.3), (7, 0.25), (9, 0.15), (5, 0.6)):  # many graphs side by side
        names = [f"x{offset + i:03d}" for i in range(size)]
        edges |= {(a, b) for a in names for b in names if rng.random() < density}
        offset += size
    edges |= {("x000", "x003"), ("x007", "x013")}
    ring = [f"r{(i * 37) % 60:02d}" for i in range(60)]  # passed over node by node
    edges |= set(zip(ring, [*ring[1:], ring[0]], strict=True)) | {(f"t{i:03d}", f"t{i + 1:03d}") for i in range(200)} | {("t100", "r05")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    assert {r.node: r.component for r in G.strong_components(df).collect()} == strong(edges)
    few = {(a, b) for a, b in edges if a[0] == "x"}
    assert {tuple(r.cycle) for r in G.cycles(spark.createDataFrame(sorted(few), "src string, dst string")).collect()} == simple_cycles(few)


def test_shortest_paths(spark):
    rng = random.Random(6)
    rows, want, pairs = [], {}, []
    for inc in INCIDENTS:
        names = [f"n{i}" for i in range(9)]
        edges = {(x, y) for x in names for y in names if x != y and rng.random() < 0.18}
        rows += [(inc, *e) for e in edges]
        for a, b in itertools.product(names, names):
            level, best = {a: (a,)}, None
            seen = {a}
            while level and best is None:
                best = level.get(b)
                new = {}
                for (x, p), (s, d) in itertools.product(level.items(), edges):
                    if s == x and d not in seen and ((*p, d) < new.get(d, ("~",))):
                        new[d] = (*p, d)
                seen |= set(new)
                level = new
            pairs.append((inc, a, b))
            if best:
                want[inc, a, b] = best
    got = rca.shortest_paths(spark.createDataFrame(rows, EDGE), spark.createDataFrame(pairs, "inc string, a string, b string"), by=["inc"])
    assert {(r.inc, r.a, r.b): tuple(r.path) for r in got.collect()} == want


def test_shortest_path_of_a_long_chain(spark):
    names = [f"n{i:02d}" for i in range(14)]
    df = spark.createDataFrame(list(itertools.pairwise(names)), "src string, dst string")
    assert rca.shortest_path(df, "n00", "n13").first().path == names
    assert rca.shortest_path(df, "n13", "n00").count() == 0 and rca.shortest_path(df, "n03", "n03").first().path == ["n03"]


def test_pagerank_of_many_graphs(spark):
    rng = random.Random(7)
    rows = [(inc, f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for inc in INCIDENTS for _ in range(20 if inc else 4)]
    df = spark.createDataFrame(rows, EDGE)
    restart = spark.createDataFrame([("a", "n1"), (None, "n2")], "inc string, id string")
    tol = 1e-2
    for small in (20_000, 0):
        got = {(r.inc, r.id): r.score for r in G.pagerank(df, restart=restart, by=["inc"], small=small, tol=tol).collect()}
        for inc in INCIDENTS:
            own = F.col("inc").eqNullSafe(F.lit(inc))
            one = G.pagerank(df.filter(own).drop("inc"), restart=restart.filter(own).drop("inc"), small=small, tol=tol)
            assert {k[1]: round(v, 9) for k, v in got.items() if k[0] == inc} == {r.id: round(r.score, 9) for r in one.collect()}


def test_similar_cases_of_rows_that_hold(spark):
    cols = "id string, ts timestamp, root_cause string, signature string, signature_full string, resolution string, metadata map<string,string>"
    rows = spark.sql("SELECT * FROM VALUES ('A', timestamp'2024-01-01', 'x', 's', 'f', 'r1', map('k', 'v')), ('A', timestamp'2024-01-02', 'y', 's', 'f', 'r2', map('k', 'w')), ('B', timestamp'2024-01-01', 'x', 't', 'g', 'r3', map()) AS t(id, ts, root_cause, signature, signature_full, resolution, metadata)").select(*[c.split()[0] for c in cols.split(", ")])
    ask = spark.createDataFrame([("by x", None, "x"), ("by y", None, "y"), ("by s", "s", None)], "case_id string, signature string, root_cause string")
    got = {(r.case_id, r.id, r.resolution) for r in memory.find_similar(rows, ask).collect()}
    assert got == {("by x", "B", "r3"), ("by y", "A", "r2"), ("by s", "A", "r2")}


def test_places_by_window_and_by_ranges(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice("aab"), rng.randrange(50)) for _ in range(400)], "k string, v long")
    plain = sorted(tuple(r) for r in numbered(df, ["k"], ["v"]).collect())
    wanted = {"p50": 0.5, "p95": 0.95}
    shares = [sorted(tuple(r) for r in percentiles(df, ["k"], "v", wanted, between=b).collect()) for b in (False, True)]
    monkeypatch.setattr("rootscope.operators.order.PLAIN", 0)
    assert sorted(tuple(r) for r in numbered(df, ["k"], ["v"]).collect()) == plain
    assert [sorted(tuple(r) for r in percentiles(df, ["k"], "v", wanted, between=b).collect()) for b in (False, True)] == shares


def test_dedup_moves_repeated_spans_only(spark):
    s = span_rows(spark).filter("inc = 'a'").drop("inc")
    twice = s.unionByName(s.filter("ingest_seq % 10 = 0").withColumn("ingest_seq", F.col("ingest_seq") + 1000)).unionByName(s.filter("ingest_seq = 3"))
    got = S.dedup_spans(twice)
    assert got.count() == s.count() and got.filter("ingest_seq >= 1000").count() == 0
    blank = s.withColumn("span_id", F.lit(" "))
    assert S.dedup_spans(blank.unionByName(blank)).count() == blank.dropDuplicates(["parent_span", "service_name", "operation_name", "start_time", "duration_ms"]).count()
