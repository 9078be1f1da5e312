import json
import math

import pytest
from pyspark.sql import functions as F

from rootscope.operators import detect, graph, spans as S
from rootscope.schemas import SPAN
from rootscope.sources import readers

BASE = {"trace_id": "t1", "span_id": "", "parent_span": "ROOT", "service_name": "a", "operation_name": "/x", "start_time": 0, "duration": 1000, "duration_ms": 1.0, "has_error": False, "response": "200", "status": "200", "end_time": "", "tags": {}}


def frame(spark, rows):
    full = [BASE | r | {"ingest_seq": r.get("ingest_seq", i)} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in spark.createDataFrame([], SPAN).schema) for r in full], SPAN)


STANDARD = """trace_id,span_id,parent_span,service_name,operation_name,start_time,duration,has_error,response
t1,s1,ROOT,frontend,HTTP GET /,1000,50000,false,200
t1,s2,s1,api-gateway,/route,1100,40000,true,500
t1,s3,s2,postgres,SELECT,1200,30000,FALSE,
"""
MIXED = """trace_id,span_id parent_span service_name,operation_name start_time,duration,has_error,response
t9,"a1 ROOT nginx-web-server","/wrk2-api/post 5000",700,true,500
t9,"a2 a1 compose-post-service","compose post server 5100",650,false,200
"""


def test_read_standard_mixed_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text(STANDARD)
    (tmp_path / "b.csv").write_text("traceId,spanId,parentId,service,operation,startTime,duration_ms,hasError\nt2,x1,,redis,get,7,1.5,Y\n")
    (tmp_path / "c.csv").write_text(MIXED)
    got = {r.span_id: r for r in readers.read_spans(spark, str(tmp_path)).collect()}
    assert set(got) == {"s1", "s2", "s3", "x1", "a1", "a2"}
    assert got["s2"].has_error and got["s2"].duration_ms == 40.0 and got["s3"].response == "Unknown" and got["s3"].status == "UNKNOWN"
    assert got["x1"].parent_span == "ROOT" and got["x1"].has_error and got["x1"].duration == 1500 and got["x1"].status == "ERROR"
    assert got["a2"].service_name == "compose-post-service" and got["a2"].operation_name == "compose post server" and got["a2"].start_time == 5100
    assert got["s1"].ingest_seq < got["s2"].ingest_seq < got["s3"].ingest_seq
    j = tmp_path / "j"
    j.mkdir()
    (j / "t.json").write_text(json.dumps({"data": [{"traceId": "q", "spanId": "1", "serviceName": "z", "duration": "123.0", "tags": '{"k": "v"}'}, {"traceId": "q", "spanId": "2", "serviceName": "z", "duration": 2000}]}))
    got = {r.span_id: r for r in readers.read_spans(spark, str(j), "json").collect()}
    assert got["1"].duration_ms == 0.0 and got["1"].tags == {"k": "v"} and got["2"].duration_ms == 2.0


def test_dedup_and_validation(spark):
    rows = [{"span_id": "1"}, {"span_id": "1", "service_name": "late"}, {"trace_id": "t2", "span_id": "1"}, {"trace_id": "", "span_id": "1"}, {"trace_id": "", "span_id": "1"}, {"start_time": 5}, {"start_time": 5}, {"start_time": 6}]
    df = frame(spark, rows)
    once = S.dedup_spans(df)
    assert sorted(r.ingest_seq for r in once.collect()) == [0, 2, 3, 5, 7]
    assert sorted(r.ingest_seq for r in S.dedup_spans(once.repartition(3)).collect()) == [0, 2, 3, 5, 7]
    assert tuple(S.dedup_stats(df).first()) == (8, 5, 3)
    v = S.validate_spans(df).first()
    assert not v.is_valid and v.valid_count == 3 and v.errors[0] == "span 3: missing trace_id" and len(v.errors) == 5
    none = S.validate_spans(df.limit(0)).first()
    assert none.is_valid and none.validation_rate == 100.0


def test_dedup_of_equal_places_and_in_one_shuffle(spark):
    rows = [{"span_id": "1", "ingest_seq": 7, "service_name": n} for n in ("b", "a", "c")]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        assert [r.service_name for r in S.dedup_spans(frame(spark, order).coalesce(1)).collect()] == ["a"]
    plan = S.dedup_spans(frame(spark, rows))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan  # a task drops its own repeats before the shuffle


def test_orphans_look_at_all_traces(spark):
    df = frame(spark, [{"span_id": "1"}, {"trace_id": "t2", "span_id": "2", "parent_span": "1"}, {"span_id": "3", "parent_span": "gone"}, {"span_id": "4", "parent_span": ""}])
    assert [r.span_id for r in S.orphan_spans(df).collect()] == ["3"]


def test_service_stats(spark):
    rows = [{"span_id": str(i), "duration_ms": float(i + 1), "has_error": i == 0, "response": "503" if i == 1 else "Unknown" if i < 4 else "200", "operation_name": "op%d" % (i % 2)} for i in range(10)]
    r = S.service_stats(frame(spark, rows)).first()
    assert (r.span_count, r.error_count, r.error_rate, r.unknown_response_count, r.unknown_response_pct) == (10, 2, 0.2, 3, 30.0)
    assert (r.duration_p50_ms, r.duration_p95_ms, r.duration_mean_ms) == (5.0, 10.0, 5.5) and r.duration_std_ms == round(math.sqrt(8.25), 2) and r.operations == ["op0", "op1"]
    assert S.service_stats(frame(spark, rows), by=["trace_id"]).count() == 1
    none = S.service_stats(frame(spark, [{"operation_name": " "}, {"operation_name": None, "service_name": "b"}])).collect()
    assert sorted((r.service, r.operations) for r in none) == [("a", []), ("b", [])]


def test_figures_of_spans_use_generated_code(spark):
    """A set among a group's figures takes the generated code from all of them: sets come from few rows instead."""
    df = frame(spark, [{"span_id": "1"}, {"span_id": "2", "parent_span": "1", "service_name": "b"}])
    for out, figure in ((S.service_stats(df), "stddev_pop"), (graph.call_edges(df), "decimal(20,3)")):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert not [x for x in plan.splitlines() if "ObjectHashAggregate" in x and figure in x]
        assert [x for x in plan.splitlines() if "HashAggregate" in x and figure in x]


def ewma(values, a=0.3):
    m, v = values[0], 0.0
    for x in values[1:]:
        m = a * x + (1 - a) * m
        v = a * (x - m) ** 2 + (1 - a) * v
    return round(m, 3), round(math.sqrt(v), 3)


def test_ewma_takes_the_last_window_of_request_spans(spark):
    d = [(i * 37) % 101 / 7 for i in range(150)]
    rows = [{"span_id": str(i), "start_time": i // 2, "duration_ms": x} for i, x in enumerate(d)] + [{"span_id": f"q{i}", "operation_name": "db", "duration_ms": 999.0, "start_time": 10_000} for i in range(5)] + [{"span_id": "l", "service_name": "lone", "duration_ms": 4.0}]
    got = {r.service: r for r in detect.ewma_baseline(frame(spark, rows).repartition(5)).collect()}
    assert (got["a"].ewma_mean, got["a"].ewma_std) == pytest.approx(ewma(d[-100:]), abs=1e-3) and got["a"].sample_count == 100
    assert (got["lone"].ewma_mean, got["lone"].ewma_std, got["lone"].sample_count) == (4.0, 0.0, 1)
    cur = {r.service: r.current_value for r in detect.current_latency(frame(spark, rows)).collect()}
    assert cur["a"] == pytest.approx(sum(d[-10:]) / 10)


def run_detection(spark, rows):
    df = frame(spark, rows)
    return detect.detect_anomalies(df, S.service_stats(df), detect.ewma_baseline(df)).collect()


def test_unknown_responses_alone_never_alert(spark):
    rows = [{"span_id": str(i), "service_name": "ab"[i % 2], "response": "Unknown", "start_time": i} for i in range(4)]
    assert run_detection(spark, rows) == []
    bad = run_detection(spark, [r | {"has_error": r["service_name"] == "a"} for r in rows])
    assert [(r.service, r.anomaly_type) for r in bad] == [("a", "error_rate_high+unknown_response_gap")] and bad[0].severity == "MEDIUM"


def test_labels_and_context(spark):
    alerts = spark.createDataFrame([(s, "LOW", "x", sc, 0.0, 0.0, 0.0, 0.0, "") for s, sc in [("a", 0.5), ("b", 0.4), ("c", 0.3)]], "service string, severity string, anomaly_type string, score double, z_score double, current_value double, baseline_mean double, baseline_std double, details string")
    labels = spark.createDataFrame([("a", "ROOT_CAUSE"), ("b", "FALSE_POSITIVE")], "service string, label string")
    got = {r.service: (r.score, r.rank) for r in detect.apply_labels(alerts, labels).collect()}
    assert got == {"a": (0.6, 1), "b": (0.12, 3), "c": (0.36, 2)}
    c = detect.confirm_anomaly(alerts).first()
    assert not c.confirmed and c.service is None and c.top == ["a", "b", "c"]
    assert not detect.confirm_anomaly(alerts.limit(0)).first().confirmed
    none = S.service_stats(frame(spark, [{"span_id": "1"}]))
    assert detect.primary_service(alerts.limit(0), none).first().service == "unknown"


def test_kernel_signals(spark):
    m = spark.createDataFrame([("a", (1.0, 2.0, 250.0), {"total": 120, "EPIPE": 100, "EIO": 20}, 60, True, 9), ("b", (1.0, 2.0, 3.0), {"total": 1}, 0, False, 1)], "service string, socket_latency_ms struct<p50:double,p95:double,p99:double>, syscall_errors map<string,int>, tcp_retransmits int, fd_exhaustion boolean, open_file_descriptors int")
    got = {(r.type, r.severity) for r in detect.kernel_signals(m).collect()}
    assert got == {("kernel_socket_latency", "HIGH"), ("syscall_error_spike", "CRITICAL"), ("tcp_retransmission_spike", "MEDIUM"), ("fd_exhaustion", "CRITICAL")}
    assert detect.kernel_signals(m, m.filter("service = 'b'")).count() == 0
    assert any("dominant=EPIPE:100" in r.evidence for r in detect.kernel_signals(m).collect())


def test_column_means(spark):
    df = spark.createDataFrame([(1, 0.0, "x", 5), (2, 0.01, "y", 5)], "k int, error_rate double, s string, b5xx int")
    assert {r.column for r in detect.column_means_over(df).collect()} == {"k", "b5xx"}
    assert {r.column for r in detect.column_means_over(df, pattern="error|5xx").collect()} == {"b5xx"}
    assert detect.column_means_over(df.select("s")).count() == 0


def test_forest(spark):
    from rootscope.operators import forest

    rows = [{"span_id": f"{s}-{i}", "service_name": f"s{s}", "start_time": i, "duration_ms": 10.0 + i % 5 + (400 if s == 0 and i > 20 else 0), "has_error": s == 0 and i > 20} for s in range(12) for i in range(30)]
    df = frame(spark, rows)
    stats, base = S.service_stats(df), detect.ewma_baseline(df)
    f = detect.forest_features(stats, base)
    a = forest.forest_alerts(f, stats, base, trees=40)
    got = a.collect()
    assert got and got[0].service == "s0" and all(0 <= r.score <= 1 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, forest.forest_alerts(f.repartition(7), stats, base, trees=40).collect()))
    assert forest.detect(df, stats, f, "auto", trees=10).filter("service = 's0'").count() == 1
    with pytest.raises(ValueError):
        forest.detect(df, stats, f, "magic")


def test_order_of_files(spark, tmp_path):
    """Spans come by path, then line, so that of equal ids the first path's stays."""
    head = "trace_id,span_id,parent_span,service_name,operation_name,start_time,duration,has_error,response"
    for name in "hgfedcba":
        (tmp_path / f"{name}.csv").write_text(head + "\n" + "".join(f"t,same{k},ROOT,svc-{name},op,{k},5,false,200\n" for k in range(3)))
    got = readers.read_spans(spark, str(tmp_path)).orderBy("ingest_seq").collect()
    assert [(r.service_name, r.span_id) for r in got] == [(f"svc-{n}", f"same{k}") for n in "abcdefgh" for k in range(3)]
    assert {r.service_name for r in S.dedup_spans(readers.read_spans(spark, str(tmp_path))).collect()} == {"svc-a"}
    j = tmp_path / "j"
    j.mkdir()
    for name in "ba":
        (j / f"{name}.json").write_text("".join(f'{{"data":[{{"trace_id":"t","span_id":"{k}","service":"svc-{name}"}},{{"trace_id":"t","span_id":"{k}x","service":"svc-{name}"}}]}}\n' for k in range(2)))
    got = readers.read_spans(spark, str(j), "jsonl").orderBy("ingest_seq").collect()
    assert [(r.service_name, r.span_id) for r in got] == [(f"svc-{n}", k) for n in "ab" for k in ("0", "0x", "1", "1x")]


def test_lines_over_blocks(spark, tmp_path):
    """A file that many tasks read: places and section headers carry over the borders of its blocks."""
    lines, want, now = [], [], None
    for i in range(900):
        if i in (100, 350, 351, 800):
            now = f"svc{i}"
            lines.append(f"=== {now} ===")
        else:
            lines.append(f"line {i}")
            want += [(now, i + 1, f"line {i}")] if now else []
    (tmp_path / "log.txt").write_text("\n".join(lines))
    (tmp_path / "other.txt").write_text("no header\n=== b ===\nlast")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = sorted(tuple(r) for r in readers.read_logs(spark, str(tmp_path)).collect())
        assert got == sorted([*want, ("b", 3, "last")])
        csv = tmp_path / "m"
        csv.mkdir()
        (csv / "summary.csv").write_text("metric,cmdb_id,kpi_name,value\n" + "".join(f"cpu,a.pod,k,{'nan' if i % 7 == 0 else i}\n" for i in range(400)))
        got = readers.read_metrics(spark, str(csv / "summary.csv")).orderBy("value").collect()
        assert [r.ts for r in got] == list(range(len(got))) and len(got) == sum(i % 7 > 0 for i in range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_format_by_first_decisive_row(spark, tmp_path):
    head = "trace_id,span_id,parent_span,service_name,operation_name,start_time,duration,has_error,response"
    (tmp_path / "late.csv").write_text(head + "\nbroken,row\n\ntrace_id again\nt1,s1 p1 svc,op 5,7,false,200\n")
    (tmp_path / "std.csv").write_text(head + "\nbroken,row\nt2,s2,p2,svc,op,5,7,false,200\nt1,s1 p1 svc,op 5,7,false,200\n")
    got = {r.path.rsplit("/", 1)[1]: r.fmt for r in readers.file_formats(spark, str(tmp_path)).collect()}
    assert got == {"late.csv": "mixed", "std.csv": "standard"}


def test_files_grow_in_number_with_the_table(spark, monkeypatch):
    from rootscope.plans import wider

    monkeypatch.setattr(wider, "FILE_ROWS", 10)
    rows = [{"trace_id": f"t{i % 50:03}", "span_id": str(i)} for i in range(100)]
    s = wider._in_order(frame(spark, rows))
    assert s.rdd.getNumPartitions() == 10
    parts = [[r.trace_id for r in p] for p in s.rdd.glom().collect()]
    assert max(map(len, parts)) <= 30 and sum(parts, []) == sorted(r["trace_id"] for r in rows)


def test_only_the_newest_hours_are_sorted(spark, monkeypatch):
    import random

    rng, hour = random.Random(5), 3_600_000_000
    rows = [("a" if i % 3 else "b", "/x" if i % 5 else "q", rng.choice([None, *range(0, 40 * hour, hour // 3)]), float(i), i) for i in range(600)] + [("c", "q", None, 1.0, 700), ("c", "/x", 5, 2.0, 701), (None, "/x", hour, 3.0, 702)]
    df = spark.createDataFrame(rows, "service_name string, operation_name string, start_time long, duration_ms double, ingest_seq long")
    want = set()
    for s in ("a", "b", "c", None):
        own = [r for r in rows if r[0] == s]
        own = [r for r in own if r[1] == "/x"] if sum(r[1] == "/x" for r in own) >= 2 else own
        own.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[4]), reverse=True)
        want |= {(s or "unknown", r[3], i + 1) for i, r in enumerate(own[:7])}
    since, cut = [], detect.cut
    monkeypatch.setattr(detect, "cut", lambda t, label: since.append(cut(t, label)) or since[-1])
    assert {tuple(r) for r in detect.latency_series(df, 7).collect()} == want
    hours = {r.service: r.since for r in since[0].collect()}
    assert hours["a"] > 30 and hours["b"] > 25  # all earlier hours stay unsorted
    assert {tuple(r) for r in detect.latency_series(df, 10_000).filter("back <= 7").collect()} == want


def test_dedup_without_a_crowded_key_sorts_after_the_shuffle_only(spark, monkeypatch):
    rows = [{"trace_id": f"t{i % 7}", "span_id": ["", " s1 ", "s1", f"x{i % 5}"][i % 4], "start_time": i % 3, "ingest_seq": 40 - i // 2, "duration": i} for i in range(80)]
    df = frame(spark, rows).repartition(6)
    once = S.dedup_spans(df, crowded=False)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and "__hash" in plan
    kept = lambda d: sorted((r.trace_id, r.span_id, r.ingest_seq, r.duration) for r in d.collect())
    assert kept(once) == kept(S.dedup_spans(df)) and 0 < once.count() < 80
    assert not S.is_crowded(df) and not S.is_crowded(df.limit(0))
    monkeypatch.setattr(S, "PLAIN", 15)
    assert S.is_crowded(df.withColumn("span_id", F.lit("s")).withColumn("trace_id", F.lit("t")))


def test_whole_numbers_are_those_of_round(spark):
    from rootscope.plans.views import _whole

    df = spark.createDataFrame([(x,) for x in (0.0, 0.49999999999999994, 0.5, 1.5, 2.5, -0.5, -2.5, -2.4, 8419704.000000001, 901.5, 104949.49999999999, None)], "x double")
    assert all(r.a == r.b for r in df.select(_whole(F.col("x")).alias("a"), F.round("x").cast("long").alias("b")).collect())


def test_statistics_round_as_their_sql(spark):
    import duckdb

    # 0.145, 0.285 and 1.005 lie below the half as doubles, 0.125 on it; 1e307 has no product, NaN and infinity are as they come
    ms = [0.145, 0.285, 1.005, 0.125, 8.345, 69.005, 2.0, -0.125, 0.0, 1e307]
    got = {r.service: r for r in S.service_stats(frame(spark, [{"service_name": f"s{i}", "span_id": f"x{i}", "duration_ms": d} for i, d in enumerate([*ms, math.inf, math.nan])])).collect()}
    for i, d in enumerate(ms):
        want = duckdb.sql(f"SELECT round({d!r}::DOUBLE, 2)").fetchall()[0][0]
        r = got[f"s{i}"]
        assert {r.duration_min_ms, r.duration_max_ms, r.duration_mean_ms, r.duration_p50_ms, r.duration_p99_ms} == {want}, d
    assert got["s10"].duration_max_ms == math.inf and math.isnan(got["s11"].duration_max_ms)


def test_equal_places_go_by_the_file(spark, tmp_path):
    """Of lines with one key and one ingest_seq the first in the files stays, as in the SQL read by one thread, whatever else they hold."""
    import duckdb

    from rootscope.plans import catalog

    # 100 more of quantity weigh 31.00 of price in ingest_seq
    line = lambda k, more: (k, 1, 1, 1, 1.0 + 100 * more, 2031.0 - 31 * more, 0.0, 0.0, "N", "F", f"1995-01-{10 + more:02}")
    files = [[line(1, 0), line(2, 1), line(1, 1), line(3, 1)], [line(2, 0), line(3, 0), line(4, 0)]]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    (folder := tmp_path / "lineitem.parquet").mkdir()
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, names).withColumn("l_shipdate", F.to_timestamp("l_shipdate")).toPandas().to_parquet(folder / f"part-{i}.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute("SET threads=1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    got = {q: sorted(map(tuple, catalog.QUERIES[q](spark, str(tmp_path)).collect())) for q in ("i6_dedup_spans", "d10_choice_by_day")}
    assert got == {q: sorted(con.execute(catalog.ORACLE_SQL[q]).fetchall()) for q in got}
    assert [r[4] for r in got["i6_dedup_spans"]] == [2031, 2000, 2000, 2031]
