"""Action plans, approval, health, reverts, command policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered

# The rules of a plan (lowest and highest error rate, step, action, command, title, description, category), block list, commands that can be undone, templates.
RULES = (
    (0.5, None, 0.0, "restart", "kubectl rollout restart deployment/{s}", "Restart {s}", "Restart {s} due to high error rate ({e})", "remediation"),
    (0.5, None, 0.5, "check_logs", "kubectl logs -l app={s} --tail=100", "Check logs for {s}", "Check logs for {s}", "diagnostic"),
    (0.1, 0.5, 0.0, "check_resources", "kubectl top pods -l app={s}", "Check resources for {s}", "Check resource usage for {s}", "diagnostic"),
    (0.1, 0.5, 0.5, "scale_up", "kubectl scale deployment/{s} --replicas=3", "Scale up {s}", "Scale up {s} if resource constrained", "remediation"),
    (None, 0.1, 0.0, "check_dependencies", "kubectl describe deployment/{s}", "Check deployment for {s}", "Check dependencies and config for {s}", "diagnostic"),
    (None, None, 0.3, "check_pods", "kubectl get pods -l app={s} -o wide", "Check pods for {s}", "Check pod status for {s}", "diagnostic"),
)
BLOCKED = (
    ("kubectl edit", "interactive — not permitted"),
    ("port-forward", "interactive — not permitted"),
    ("logs -f", "follow mode — not permitted"),
    ("docker logs -f", "follow mode — not permitted"),
    ("delete namespace", "destructive — not permitted"),
    ("delete statefulset", "destructive — not permitted"),
    ("delete pvc", "destructive — not permitted"),
    ("&&", "compound shell operator — not permitted"),
    ("||", "compound shell operator — not permitted"),
    ("; rm", "destructive compound — not permitted"),
)
REVERTS = {
    "scale": r"^kubectl scale deployment/(\S+) --replicas=(\d+)",
    "restart": r"^kubectl rollout restart deployment/(\S+)",
    "configmap": r"^kubectl patch configmap (\S+)",
    "env": r"^kubectl set env deployment/(\S+) (.+)",
    "helm": r"^helm upgrade (\S+) (\S+)",
    "apply": r"^kubectl apply -f (.+)",
}
FORBIDDEN = (r"rm\s+-rf", r"drop\s+database", r"delete\s+ns", r"delete\s+namespace", r"sudo\s+rm")
TEMPLATES = (
    ("rollout_restart", "kubectl rollout restart deployment/{deployment} -n {namespace}"),
    ("rollback", "kubectl rollout undo deployment/{deployment} -n {namespace}"),
    ("scale", "kubectl scale deployment/{deployment} -n {namespace} --replicas={n}"),
    ("patch_port", 'kubectl patch deployment/{deployment} -n {namespace} --type=\'json\' -p=\'[{"op":"replace","path":"/spec/template/spec/containers/0/ports/0/containerPort","value":{port}}]\''),
    ("set_image", "kubectl set image deployment/{deployment} {container}={image} -n {namespace}"),
    ("wait_ready", "kubectl wait --for=condition=ready pod --all -n {namespace} --timeout={timeout}"),
)
ACTION_COLUMNS = ("action", "target", "service", "command", "priority", "title", "description", "category", "confidence", "sequence")


def mitigation_plan(cands: DataFrame, cases: DataFrame | None = None, stats: DataFrame | None = None, top: int = 3) -> DataFrame:
    """Action rows for the first candidates: a resolution proven in a past case (root_cause, resolution, outcome, ts), else the rules of the error-rate band. Without candidates one row that asks for a look."""
    spark = cands.sparkSession
    c = cands.filter(F.col("rank") <= top).select("service", "rank", "error_rate")
    if stats is not None:
        c = c.join(stats.select("service", F.col("error_rate").alias("s_err")), "service", "left").withColumn("error_rate", F.coalesce("error_rate", "s_err")).drop("s_err")
    c = c.withColumn("error_rate", F.coalesce("error_rate", F.lit(0.0)))
    rules = spark.createDataFrame([(lo, hi, float(step), a, cmd, t, d, cat, k) for k, (lo, hi, step, a, cmd, t, d, cat) in enumerate(RULES)], "lo double, hi double, step double, action string, cmd string, t string, d string, category string, no int")
    fill = lambda col: F.replace(F.replace(F.col(col), F.lit("{s}"), F.col("service")), F.lit("{e}"), F.format_string("%.1f%%", F.col("error_rate") * 100))
    known = None
    if cases is not None:
        fixes = cases.filter("outcome = 'resolved' AND resolution IS NOT NULL AND resolution <> ''").groupBy(F.col("root_cause").alias("service")).agg(F.max_by("resolution", "ts").alias("fix"))
        k = c.join(fixes, "service")
        title = F.concat(F.lit("Apply known fix for "), "service")
        known = k.select(F.lit("apply_known_fix").alias("action"), F.col("service").alias("target"), "service", F.col("fix").alias("command"), F.col("rank").cast("double").alias("priority"), title.alias("title"), F.lit("Apply proven resolution from similar past incident").alias("description"), F.lit("remediation").alias("category"), F.lit(0.9).alias("confidence"), F.lit(0).alias("no"))
        c = c.join(fixes, "service", "left_anti")
    r = c.crossJoin(F.broadcast(rules)).filter("(lo IS NULL OR error_rate > lo) AND (hi IS NULL OR error_rate <= hi)")  # six rules
    plan = r.select("action", F.col("service").alias("target"), "service", fill("cmd").alias("command"), (F.col("rank") + F.col("step")).alias("priority"), fill("t").alias("title"), fill("d").alias("description"), "category", F.lit(None).cast("double").alias("confidence"), "no")
    plan = plan.union(known) if known is not None else plan
    none = spark.createDataFrame([("investigate", "unknown", "unknown", "kubectl get pods -A | grep -v Running", 1.0, "Manual investigation required", "Manual investigation required - no clear root cause identified", "diagnostic", None, 0)], plan.schema)
    plan = plan.union(none.join(cands.filter(F.col("rank") <= top).agg(F.count("*").alias("n")), F.col("n") == 0, "left_semi"))
    return plan.withColumn("sequence", F.row_number().over(Window.orderBy("priority", "service", "no"))).select(*ACTION_COLUMNS)


def approve(actions: DataFrame, auto_diagnostic: bool = True, auto_remediation: bool = True) -> DataFrame:
    """approved, approval_note by category."""
    kind = F.col("category")
    diagnostic, remediation = (kind == "diagnostic") & F.lit(auto_diagnostic), kind == "remediation"
    note = F.when(diagnostic, F.lit("Auto-approved (diagnostic)")).when(remediation & F.lit(auto_remediation), F.lit("Auto-approved (benchmark mode)")).when(remediation, F.lit("Pending approval")).otherwise(F.lit("Auto-approved (default)"))
    return actions.withColumn("approved", F.lit(True) if auto_remediation else ~remediation).withColumn("approval_note", note)


def health(counts: DataFrame, w_alerts: float = 0.40, w_violations: float = 0.35, w_unhealthy: float = 0.25) -> DataFrame:
    """score of each row of counts (keys, alerts, violations, unhealthy): lower is better."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return counts.withColumn("score", F.round(w_alerts * n("alerts") + w_violations * n("violations") + w_unhealthy * n("unhealthy"), 4))


def regressed(before: DataFrame, after: DataFrame, key: str, tolerance: float = 0.05, most_cycles: int = 3) -> DataFrame:
    """key, before, after, regressed, retry: whether the score rose by more than the tolerance, and a further cycle is allowed (after.cycle)."""
    j = before.select(key, F.col("score").alias("before")).join(after.select(key, F.col("score").alias("after"), "cycle"), key)
    worse = F.col("after") > F.col("before") + tolerance
    return j.select(key, "before", "after", worse.alias("regressed"), (worse & (F.col("cycle") < most_cycles)).alias("retry"))


def cross_check(alerts: DataFrame, pod_lines: DataFrame) -> DataFrame:
    """alerts, unhealthy, agrees: whether alerts and unhealthy pods tell the same."""
    from .infra import unhealthy_pods

    a = alerts.agg(F.count("*").alias("alerts")).crossJoin(unhealthy_pods(pod_lines).agg(F.count("*").alias("unhealthy")))
    return a.withColumn("agrees", (F.col("alerts") > 0) == (F.col("unhealthy") > 0))


def revert_command(cmd: Column) -> Column:
    """The command that undoes cmd; a comment where there is none."""
    c = F.trim(cmd)
    get = lambda p, k=1: F.regexp_extract(c, p, k)
    scale, restart, cm, env, helm, apply_f = REVERTS.values()
    fewer = F.greatest(F.lit(1), get(scale, 2).try_cast("int") - 2)
    keys = F.array_join(F.transform(F.regexp_extract_all(get(env, 2), F.lit(r"(\w+)=\S+"), F.lit(1)), lambda k: F.concat(k, F.lit("-"))), " ")
    return (
        F.when(c.rlike(scale), F.concat(F.lit("kubectl scale deployment/"), get(scale), F.lit(" --replicas="), fewer.cast("string")))
        .when(c.rlike(restart), F.concat(F.lit("kubectl rollout undo deployment/"), get(restart)))
        .when(c.rlike(cm), F.concat(F.lit("# Manual revert required for configmap "), get(cm), F.lit(" — restore from backup")))
        .when(c.rlike(env), F.concat(F.lit("kubectl set env deployment/"), get(env), F.lit(" "), keys))
        .when(c.rlike(helm), F.concat(F.lit("helm rollback "), get(helm)))
        .when(c.rlike("^kubectl delete pods"), F.lit("# Pod deletion is self-healing; verify with: kubectl get pods -w"))
        .when(c.rlike(apply_f), F.concat(F.lit("kubectl delete -f "), get(apply_f)))
        .otherwise(F.concat(F.lit("# No automatic revert for: "), F.substring(c, 1, 80)))
    )


def revert_commands(actions: DataFrame) -> DataFrame:
    """Undo rows of an action log (seq, command, service, title)."""
    return actions.select("seq", F.col("command").alias("action_cmd"), revert_command(F.col("command")).alias("revert_cmd"), "service", F.col("title").alias("description"), F.lit(True).alias("executed"), F.lit(False).alias("reverted"))


def undo_order(undo: DataFrame) -> DataFrame:
    """What is left to revert, the newest first (a plan; nothing is executed)."""
    left = undo.filter("NOT reverted").withColumns({"__log": F.lit(0), "__back": -F.col("seq")})
    return numbered(left, ["__log"], ["__back"], "step", "__rows").drop("__log", "__back", "__rows").orderBy("step")


def screen(cmd: Column) -> Column:
    """The first reason that forbids a command, null if none does."""
    out: Column = F.lit(None).cast("string")
    for pattern in reversed(FORBIDDEN):
        out = F.when(F.lower(cmd).rlike(pattern), F.lit(f"forbidden pattern {pattern}")).otherwise(out)
    for text, reason in reversed(BLOCKED):
        out = F.when(cmd.contains(text), F.lit(reason)).otherwise(out)
    return F.when(cmd.isNull() | (cmd == ""), F.lit("no action specified")).otherwise(out)


def screen_commands(actions: DataFrame, policy: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    """Actions with `blocked`: the reason of the built-in lists, or of a policy table (no, pattern, regex, reason) of at most `most` rules, the lowest no first."""
    if policy is None:
        return actions.withColumn("blocked", screen(F.col("command")))
    p = policy.select("no", "pattern", "regex", "reason")
    if p.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rules: they are sent to every task")
    hit = F.when(F.col("regex"), F.rlike("__cmd", "pattern")).otherwise(F.contains("__cmd", "pattern"))
    found = actions.select(F.col("command").alias("__cmd")).distinct().join(F.broadcast(p), hit).groupBy("__cmd").agg(F.min_by("reason", "no").alias("blocked"))  # a short list of rules
    return actions.join(found, F.col("command") == F.col("__cmd"), "left").drop("__cmd")


def render_actions(actions: DataFrame, namespace: str, root: str = "unknown") -> DataFrame:
    """action, target, command: the first remediation by priority (else the first action), rendered by its template; blocked or unknown ones become a restart."""
    pick = actions.agg(F.min_by(F.struct("action", "target"), F.struct((F.col("category") != "remediation").alias("later"), "priority", "sequence")).alias("p"))
    p = pick.select(F.coalesce("p.action", F.lit("rollout_restart")).alias("action"), F.coalesce("p.target", F.lit(root)).alias("target"))
    t = F.create_map(*(F.lit(x) for pair in TEMPLATES for x in pair))
    d = F.replace(F.col("target"), F.lit("/"), F.lit("-"))
    text = F.try_element_at(t, F.col("action"))
    for name, value in {"deployment": d, "namespace": F.lit(namespace), "n": F.lit("1"), "port": F.lit("8080"), "container": d, "image": F.concat(d, F.lit(":latest")), "timeout": F.lit("180s")}.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    safe = F.concat(F.lit("kubectl rollout restart deployment/"), d, F.lit(f" -n {namespace}"))
    return p.select("action", "target", F.when(text.isNull() | screen(text).isNotNull(), safe).otherwise(text).alias("command"))
