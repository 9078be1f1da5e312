import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from rootscope.operators import memory as M, mitigate as A, report as E

FOUND = "id string, ts timestamp, service string, anomaly_type string, root_cause string, affected_services array<string>, resolution string, confidence double, outcome string, metadata map<string,string>"
CANDS = "service string, rank int, confidence double, error_rate double"


def day(n):
    return dt.datetime(2024, 1, n)


def incidents(spark):
    rows = [("i1", day(1), "a", "x", "db", None, "fix db", 0.5, "resolved", None), ("i2", day(2), "a", "x", "web", None, None, None, "false_positive", None), ("i3", day(3), "q", "", None, ["q", "r"], None, 0.2, None, None), ("i4", day(4), "z", "y", "db", None, "newer fix", 0.1, "resolved", None)]
    return M.incident_rows(spark.createDataFrame(rows, FOUND))


def test_signatures(spark):
    r = {x.id: x for x in incidents(spark).collect()}
    assert r["i1"].signature == hashlib.md5(b"service:a|anomaly:x").hexdigest() and r["i1"].signature_full == hashlib.md5(b"service:a|anomaly:x|root_cause:db").hexdigest()
    assert r["i3"].root_cause == "q" and r["i3"].outcome == "pending" and r["i3"].affected_services == ["q", "r"]


def test_similar_and_learning(spark):
    i = incidents(spark)
    sig = hashlib.md5(b"service:a|anomaly:x").hexdigest()
    asked = spark.createDataFrame([("c1", sig, "db"), ("c2", sig, None)], "case_id string, signature string, root_cause string")
    got = {(r.case_id, r["rank"]): r.id for r in M.find_similar(i, asked).collect()}
    assert got == {("c1", 1): "i4", ("c1", 2): "i2", ("c1", 3): "i1", ("c2", 1): "i2", ("c2", 2): "i1"}
    assert M.find_similar(i, asked, 1).count() == 2 and M.similar_links(M.find_similar(i, asked)).count() == 5
    done = M.outcome_changes(spark.createDataFrame([("i3", 1, False), ("i3", 2, True)], "id string, seq int, success boolean"))
    r = {x.id: x for x in M.update_outcome(i, done).collect()}
    assert r["i3"].outcome == "resolved" and abs(r["i3"].confidence - 0.2) < 1e-9 and r["i1"].confidence == 0.5
    assert [(x.root_cause, x["count"]) for x in M.false_positives(i).collect()] == [("web", 1)]
    assert M.incident_count(M.store_incidents(i, i)).first()[0] == 4


def cands(spark):
    return spark.createDataFrame([("web", 1, 0.9, 0.6), ("db", 2, 0.5, 0.2), ("cache", 3, 0.4, 0.0), ("far", 4, 0.1, 0.9)], CANDS)


def test_plan(spark):
    plan = A.mitigation_plan(cands(spark)).orderBy("sequence").collect()
    assert [(r.service, r.action, r.priority) for r in plan] == [("web", "restart", 1.0), ("web", "check_pods", 1.3), ("web", "check_logs", 1.5), ("db", "check_resources", 2.0), ("db", "check_pods", 2.3), ("db", "scale_up", 2.5), ("cache", "check_dependencies", 3.0), ("cache", "check_pods", 3.3)]
    assert plan[0].description == "Restart web due to high error rate (60.0%)" and plan[5].command == "kubectl scale deployment/db --replicas=3"
    known = {r.service: r for r in A.mitigation_plan(cands(spark), incidents(spark)).filter("service = 'db'").collect()}
    assert known["db"].action == "apply_known_fix" and known["db"].command == "newer fix" and known["db"].confidence == 0.9
    assert [r.action for r in A.mitigation_plan(cands(spark).limit(0)).collect()] == ["investigate"]
    notes = {r.category: (r.approved, r.approval_note) for r in A.approve(A.mitigation_plan(cands(spark)), auto_remediation=False).collect()}
    assert notes == {"diagnostic": (True, "Auto-approved (diagnostic)"), "remediation": (False, "Pending approval")}
    assert A.render_actions(A.mitigation_plan(cands(spark)), "ns").first().command == "kubectl rollout restart deployment/web -n ns"


def test_health(spark):
    h = A.health(spark.createDataFrame([("x", 2, 1, 3)], "k string, alerts int, violations int, unhealthy int"))
    assert h.first().score == 1.9
    b = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "k string, score double")
    a = spark.createDataFrame([("x", 1.2, 1), ("y", 1.04, 1)], "k string, score double, cycle int")
    assert {r.k: (r.regressed, r.retry) for r in A.regressed(b, a, "k").collect()} == {"x": (True, True), "y": (False, False)}
    alerts, pods = spark.createDataFrame([("a",)], "service string"), spark.createDataFrame([("p 1/1 Running",)], "line string")
    assert not A.cross_check(alerts, pods).first().agrees


def test_reverts_and_policy(spark):
    want = {
        "kubectl scale deployment/w --replicas=5": "kubectl scale deployment/w --replicas=3", "kubectl scale deployment/w --replicas=1": "kubectl scale deployment/w --replicas=1", "kubectl rollout restart deployment/w": "kubectl rollout undo deployment/w", "kubectl set env deployment/w FOO=1 BAZ=2": "kubectl set env deployment/w FOO- BAZ-",
        "helm upgrade rel chart": "helm rollback rel", "kubectl apply -f x.yaml": "kubectl delete -f x.yaml",
    }
    log = spark.createDataFrame([(i, c, "w", "t") for i, c in enumerate([*want, "echo"])], "seq int, command string, service string, title string")
    got = {r.action_cmd: r.revert_cmd for r in A.revert_commands(log).collect()}
    assert got.pop("echo").startswith("#") and got == want
    assert [r.seq for r in A.undo_order(A.revert_commands(log)).collect()] == [6, 5, 4, 3, 2, 1, 0]
    cmds = spark.createDataFrame([("kubectl edit x",), ("rm  -RF /",), ("kubectl get pods",), (None,)], "command string")
    assert [r.blocked for r in A.screen_commands(cmds).collect()] == ["interactive — not permitted", r"forbidden pattern rm\s+-rf", None, "no action specified"]
    policy = spark.createDataFrame([(2, "get", False, "late"), (1, "^kubectl", True, "first")], "no int, pattern string, regex boolean, reason string")
    assert {r.command: r.blocked for r in A.screen_commands(cmds, policy).collect()}["kubectl get pods"] == "first"


def test_reports(spark):
    plan = A.mitigation_plan(cands(spark))
    clusters = spark.createDataFrame([("p", 1, "LOW", ["a"], "s")], "pattern string, count long, severity string, services array<string>, summary string")
    one = spark.createDataFrame([(3, 2)], "node_count int, edge_count int")
    r = E.incident_report("I", plan, cands(spark), clusters, plan, one, incidents(spark), spark.createDataFrame([("web",)], "service string")).first()
    assert r.summary.root_cause_service == "web" and r.rca.top_3_causes[1].service == "db" and r.mitigation.action_count == 8 and r.memory.similar_cases == 4 and r.graph.node_count == 3
    d = E.diagnosis_json(cands(spark), plan).first()
    assert json.loads(d.diagnosis)["faults"][0] == {"entity_name": "web", "entity_type": "service", "root_cause": True} and len(json.loads(d.remediation)["mitigation"][0]) == 8
    tasks = spark.createDataFrame([("detection", 1, None, None, None), ("detection", 0, None, None, None), ("localization", 1, ["a", "b"], None, None), ("localization", 1, [], None, None), ("analysis", 1, None, None, "Network"), ("mitigation", 1, None, None, None)], "task_type string, alert_count int, services array<string>, fault_layer string, fault_type string")
    assert [x.answer for x in E.answers(tasks).collect()] == ['"Yes"', '"No"', '["a"]', '["unknown"]', '{"system_level":"Application","fault_type":"Network"}', None]


def test_run_analytics(spark):
    t = spark.createDataFrame([("i", "localization")], "incident_id string, task_type string")
    assert [r.field for r in E.open_fields(t, spark.createDataFrame([("i", "ANOMALY_CONFIRMED")], "incident_id string, field string")).collect()] == ["ROOT_CAUSE_SERVICE"]
    calls = spark.createDataFrame([("a", "m", 3, 1, 0.5), ("a", "m", 4, 1, 0.25)], "caller string, model string, in_tokens long, out_tokens long, elapsed double")
    assert tuple(E.token_usage(calls).first()) == ("a", "m", 2, 7, 2, 0.75)
    runs = spark.createDataFrame([("detection", "passed", 1.0), ("detection", "failed", 2.0), ("analysis", "skipped", 0.5)], "task_type string, status string, seconds double")
    assert {r.task_type: (r.passed, r.failed, r.skipped, r.seconds) for r in E.run_rollup(runs).collect()} == {None: (1, 1, 1, 3.5), "detection": (1, 1, 0, 3.0), "analysis": (0, 0, 1, 0.5)}
    res = spark.createDataFrame([("noop_detection_1", True), ("x-detection-2", False), ("odd", True)], "task_id string, correct boolean")
    assert {r.task_type: (r.metric, r.time_field, r.accuracy) for r in E.accuracy(res).collect()} == {"detection": ("Detection Accuracy", "TTD", 0.5), "unknown": ("Accuracy", "Time", 1.0)}
    assert tuple(E.worker_counts(spark.createDataFrame([(True,), (None,)], "success boolean")).first()) == (1, 1)
    alerts = spark.createDataFrame([("a", "x+y", 0.9), ("b", "x", 0.8)], "service string, anomaly_type string, score double")
    assert M.anomaly_type(alerts).first().anomaly_type == "x+x+y"
    assert spark.range(1).select(E.task_type(F.lit("k8s-mitigation-2")).alias("t")).first().t == "mitigation"
