import pytest
from pyspark.sql import functions as F

from rootscope.functions import columns as C
from rootscope.operators import facts as T, logs as L
from rootscope.sources import readers

from .test_spans import frame

FACT = "source string, relationship string, target string, citation_quote string, relevance double, source_type string, seq long"


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    names = ["search-7b5c6d-x9k2m", "geo-c47ff745-snvqz", "mongo-0", "user", ' "quoted" ', "", None, "post-storage-service", "a-12345-6789"]
    assert col(spark, names, C.canonical_service) == ["search", "geo", "mongo", "user", "quoted", "", "", "post", "a"]
    assert col(spark, ["post-storage-service", "geo-c47ff745-snvqz"], lambda c: C.canonical_service(c, True)) == ["post-storage-service", "geo"]
    assert col(spark, ["jaeger-x", "wrk2-job", "user-db", "nginx-web", "email", "cart", None], C.service_role) == ["OBSERVABILITY", "LOADGEN", "DATASTORE", "GATEWAY", "ASYNC_CONSUMER", "APP", "UNKNOWN"]
    assert col(spark, ["container_cpu_usage", "container_spec_cpu_period", "cpu_cfs_periods_total", "Mem_x", "io"], C.usage_kind) == ["cpu", None, None, "mem", None]
    assert col(spark, ["node.pod-1", "pod-2"], C.pod_of) == ["pod-1", "pod-2"]


def test_text(spark):
    assert col(spark, ["2024-01-02T03:04:05.6Z ERROR id deadbeef01 at 10.0.0.1:80 "], C.normalize_log) == ["ERROR id <id> at <ip>"]
    assert col(spark, ["\x1b[31mred\x1b[0m"], C.strip_ansi) == ["red"]
    assert col(spark, ["API_KEY=abc, password: x1 sk-0123456789abcdef"], C.redact) == ["API_KEY=[REDACTED], password: [REDACTED] sk-[REDACTED]"]
    assert col(spark, ["abcdefghij", "abcd", None], lambda c: C.clip_middle(c, 4)) == ["ab\n...[TRUNCATED 6 chars]...\nij", "abcd", None]
    m = spark.createDataFrame([({"Token": "t", "note": "password=1"},)], "m map<string,string>")
    assert m.select(C.redact_map(F.col("m")).alias("m")).first().m == {"Token": "[REDACTED]", "note": "password=[REDACTED]"}


def triples(df):
    return {(r.source, r.relationship, r.target): r.relevance for r in df.collect()}


def test_trace_facts(spark):
    rows = [{"span_id": "p", "service_name": "a", "duration": 100}] + [{"span_id": f"c{i}", "parent_span": "p", "service_name": "b", "duration": 100, "has_error": i < 2} for i in range(4)] + [{"span_id": "s", "service_name": "slow", "duration": 100_000}]
    got = triples(T.trace_facts(frame(spark, rows)))
    assert set(got) == {("a", "calls", "b"), ("b", "emits", "HTTP_ERROR"), ("slow", "blocks", "HIGH_LATENCY")}
    assert got[("a", "calls", "b")] == 0.4 and got[("slow", "blocks", "HIGH_LATENCY")] == 1.0


def test_pods(spark, tmp_path):
    p = tmp_path / "pods.txt"
    p.write_text("NAME READY STATUS RESTARTS AGE\nok-abcde1-xyz12 1/1 Running 4 2d\nloop-abcde1-xyz12 1/1 Running 8 2d\ndown-abcde1-xyz12 0/1 Pending 3 1h\njaeger-abcde1-xyz12 0/1 Error 0 1h\n")
    got = {r.source: r for r in T.pod_facts(readers.read_pods(spark, str(p))).collect()}
    assert set(got) == {"loop", "down"} and got["down"].citation_quote == "kubectl pods ready=0/1, restarts=3, status=Pending"


def test_metrics(spark, tmp_path):
    flat = [("container_cpu_usage", s, float(i), v) for s, v in (("big", 9.0), ("x", 1.0), ("y", 1.0), ("z", 1.0)) for i in range(10)]
    step = [("container_mem", s, float(i), 1.0 + i % 2 * 0.01 + (3 if s == "jump" and i >= 7 else 0)) for s in ("jump", "calm") for i in range(10)]
    m = spark.createDataFrame(flat + step + [("container_spec_cpu_x", "big", 0.0, 99.0)], "metric string, service string, ts double, value double")
    assert set(triples(T.peer_outliers(m))) == {("big", "emits", "HIGH_CPU"), ("jump", "emits", "HIGH_MEM")}
    assert set(triples(T.own_outliers(m))) == {("jump", "emits", "HIGH_MEM")}
    own, peer, both = triples(T.own_outliers(m)), triples(T.peer_outliers(m)), triples(T.metric_facts(m))
    assert both[("jump", "emits", "HIGH_MEM")] == max(own[("jump", "emits", "HIGH_MEM")], peer[("jump", "emits", "HIGH_MEM")])
    d = tmp_path / "m" / "deep"
    d.mkdir(parents=True)
    (d / "kpi_container_CPU.csv").write_text("1.5,node.pod-a,k,2\n,node.pod-a,k,3\n1,node.pod-b,k,NaN\n")
    assert sorted((r.metric, r.service, r.ts, r.value) for r in readers.read_metrics(spark, str(tmp_path / "m")).collect()) == [("container_cpu", "pod-a", 1.0, 3.0), ("container_cpu", "pod-a", 1.5, 2.0)]
    (tmp_path / "s.csv").write_text("metric,cmdb_id,kpi_name,value\nmem,n.p,k,1\nmem,n.p,k,x\nmem,n.p,k,2\n")
    assert [(r.service, r.value) for r in readers.read_metrics(spark, str(tmp_path / "s.csv")).orderBy("ts").collect()] == [("p", 1.0), ("p", 2.0)]


def test_logs(spark, tmp_path):
    (tmp_path / "l.txt").write_text("before\n=== compose-post ===\nERROR connect() <Host: user-service Port: 9090>: Connection refused\nfailed to connect media-service-client.\n=== nginx ===\nERROR x\n=== geo-abcde1-xyz12 ===\nrequest timed out\nfine\n")
    lines = readers.read_logs(spark, str(tmp_path / "l.txt"))
    assert lines.count() == 5
    got = triples(T.log_facts(lines))
    assert set(got) == {("compose-post", "emits", "LOG_ERROR"), ("geo", "blocks", "TIMEOUT"), ("user-service", "emits", "CONNECTION_REFUSED"), ("media-service", "emits", "CONNECTION_REFUSED")}
    wrapped = spark.createDataFrame([("b'one\\ntwo\\n'",)], "t string")
    assert [r.line for r in readers.unwrap_text(wrapped, "t").collect()] == ["one", "two"]


def test_incident_decision(spark):
    f = lambda *rows: spark.createDataFrame([(*r, None) for r in rows], "source string, relationship string, target string, relevance double, source_type string")
    say = lambda *rows: T.decide_incident(f(*rows)).first().anomaly
    assert say(("a", "emits", "LOG_ERROR", 0.01)) and not say(("a", "calls", "b", 1.0))
    many = [(s, "emits", "HIGH_CPU", 0.9) for s in "abcd"]
    assert not say(*many) and say(("a", "emits", "HIGH_CPU", 0.9), *[(s, "emits", "HIGH_CPU", 0.1) for s in "bcde"])


def facts(spark):
    rows = [("caller", "calls", "user-service", 1.0), ("user-service", "emits", "CONNECTION_REFUSED", 0.3), ("caller", "emits", "HTTP_ERROR", 1.0), ("mongodb", "emits", "HIGH_MEM", 1.0), ("far", "calls", "near", 1.0), ("near", "calls", "caller", 1.0)]
    return spark.createDataFrame([(s, r, t, "q", w, None, i) for i, (s, r, t, w) in enumerate(rows)], FACT)


def test_suspects(spark):
    got = {r.service: r for r in T.rank_suspects(facts(spark)).collect()}
    assert set(got) == {"user-service", "caller", "mongodb", "near"} and got["user-service"]["rank"] == 1
    assert got["caller"].score == pytest.approx(1.0) and got["mongodb"].score == pytest.approx(1.2) and got["user-service"].score == pytest.approx(2.4)
    assert "CONNECTION_REFUSED" in {r.service for r in T.rank_suspects(facts(spark), parity=True).collect()}
    ranks = T.rank_facts(T.rank_suspects(facts(spark))).collect()
    assert {r.target for r in ranks} == {f"SUSPECT_RANK_{i}" for i in range(1, 5)} and max(r.relevance for r in ranks) == 1.0
    labels = spark.createDataFrame([("caller", "ROOT_CAUSE"), ("user-service", "NORMAL")], "service string, label string")
    assert [r.service for r in T.relabel_suspects(T.rank_suspects(facts(spark)), labels).orderBy("rank").collect()][0] == "caller"


def test_fact_store(spark):
    rows = T.fact_rows(T.merge_facts(facts(spark).drop("seq"), "analysis"), "s")
    assert rows.count() == 7 and rows.filter("source = 'SYSTEM'").first().target == "analysis"
    again = T.upsert_facts(rows, rows)
    assert again.count() == 7 and T.active_facts(again, "s").count() == 7 and T.active_facts(again, "other").count() == 0
    # both ends of every fact that holds the name are seeds, so that what the other end touches is there too
    chain = spark.createDataFrame([(f"e{i}", "s", a, b, 1.0, "calls") for i, (a, b) in enumerate(zip("abcd", "bcde", strict=True), 1)] + [("e9", "t", "a", "z", 1.0, "calls")], "edge_id string, session_id string, source string, target string, relevance double, relationship string")
    s = chain.filter("session_id = 's'")
    assert [r.edge_id for r in T.neighbourhood(s, "a", 0).collect()] == ["e1", "e2"]
    assert [r.edge_id for r in T.neighbourhood(s, " A ", 1).collect()] == ["e1", "e2", "e3"]
    assert [r.edge_id for r in T.neighbourhood(s, "e4", 0).collect()] == ["e3", "e4"] and T.neighbourhood(s, "zzz").count() == 0
    many = T.neighbourhoods(chain, spark.createDataFrame([("s", "a"), ("s", "e4"), ("t", "a"), ("t", ""), ("u", "a"), (None, "a")], "session_id string, seed string"), 1, most=3)
    assert sorted((r.session_id, r.seed, r.place, r.edge_id) for r in many.collect()) == [("s", "a", 1, "e1"), ("s", "a", 2, "e2"), ("s", "a", 3, "e3"), ("s", "e4", 1, "e2"), ("s", "e4", 2, "e3"), ("s", "e4", 3, "e4"), ("t", "a", 1, "e9")]
    assert {r.source for r in T.neighbourhood(rows, "near").collect()} == {"far", "near", "caller", "user-service"}
    assert T.neighbourhood(rows, rows.filter("source = 'far'").first().edge_id, 0).count() == 2
    assert T.fact_lines(rows).filter("text LIKE '[DATASTORE] mongodb -emits-> HIGH_MEM%'").count() == 1


def test_patterns(spark):
    lines = spark.createDataFrame([("a", i, x) for i, x in enumerate(["GET 10.0.0.1", "GET 10.0.0.2", "dial tcp 1.2.3.4: connect refused", "", "Timeout"])] + [("b", 0, "nothing")], "service string, line_no long, line string")
    top = {(r.service, r.pattern): (r["count"], r.share, r["rank"]) for r in L.top_patterns(lines, 2).collect()}
    assert top[("a", "GET <ip>")] == (2, 0.5, 1) and len(top) == 3
    assert [(r.service, r.fault_type, r.fault_layer) for r in L.fault_type(lines).collect()] == [("a", "NetworkFailure", "Network")]
    c = L.clusters(lines).collect()
    assert c[0].pattern == "GET <ip>" and c[0].severity == "HIGH" and c[0].services == ["a"]
    signals = spark.createDataFrame([("a", "fd_exhaustion", "CRITICAL", "e")], "service string, type string, severity string, evidence string")
    assert [r.pattern for r in L.clusters(lines.limit(0), signals).collect()] == ["fd_exhaustion"] and L.clusters(lines, signals).count() == 4
    named = spark.createDataFrame([("auth denied", 5), ("connection reset", 2), ("other", 9)], "pattern string, count long")
    assert L.cluster_fault_type(named).first().fault_type == "Network" and L.cluster_fault_type(named.limit(0)).first().fault_type == "Misconfiguration"
    df = frame(spark, [{"span_id": "1", "has_error": True, "trace_id": "0123456789", "duration_ms": 12.4}, {"span_id": "2"}])
    assert [r.line for r in L.error_lines(df, spark.createDataFrame([("a",)], "service string")).collect()] == ["[a] op=/x response=200 duration=12ms trace=01234567"]
