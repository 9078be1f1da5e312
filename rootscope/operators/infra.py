"""Pods, machines and the edges between them and services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels that name a pod's service, in order; words of unhealthy pods.
SERVICE_LABELS = ("app", "app.kubernetes.io/name", "io.kompose.service", "service", "component")
UNHEALTHY = r"CrashLoopBackOff|Error|OOMKilled|Pending|ImagePullBackOff"

_POD = "struct<items:array<struct<metadata:struct<name:string,namespace:string,labels:map<string,string>>,spec:struct<nodeName:string,containers:array<struct<resources:struct<requests:map<string,string>>>>>>>>"
_NODE = "struct<items:array<struct<metadata:struct<name:string>,status:struct<capacity:map<string,string>,conditions:array<struct<type:string,status:string,reason:string>>>>>>"
_SERVICES = "struct<items:array<struct<metadata:struct<name:string>,spec:struct<ports:array<struct<port:int,targetPort:string>>>>>>"


def service_of(labels: Column) -> Column:
    """The first label of SERVICE_LABELS that isn't empty."""
    return F.coalesce(*(F.trim(F.nullif(F.element_at(labels, k), F.lit(""))) for k in SERVICE_LABELS))


def flatten_pods(json: DataFrame, col: str = "json") -> DataFrame:
    """name, namespace, node_name, labels, cpu_request, memory_request (of the first container), service_name."""
    p = json.select(F.explode(F.from_json(col, _POD)["items"]).alias("p")).select("p.metadata.*", F.col("p.spec.nodeName").alias("node_name"), F.get("p.spec.containers", F.lit(0))["resources"]["requests"].alias("r"))
    return p.select("name", "namespace", "node_name", "labels", F.element_at("r", "cpu").alias("cpu_request"), F.element_at("r", "memory").alias("memory_request"), service_of(F.col("labels")).alias("service_name"))


def flatten_nodes(json: DataFrame, col: str = "json") -> DataFrame:
    """name, capacity_cpu, capacity_memory, conditions (unknown ones aside)."""
    n = json.select(F.explode(F.from_json(col, _NODE)["items"]).alias("n"))
    cap = lambda k: F.element_at("n.status.capacity", k)
    return n.select("n.metadata.name", cap("cpu").alias("capacity_cpu"), cap("memory").alias("capacity_memory"), F.filter("n.status.conditions", lambda c: c["status"] != "Unknown").alias("conditions"))


def index_maps(pods: DataFrame) -> dict[str, DataFrame]:
    """pod_node (name, node_name), node_pods and service_pods (key, pods in order of name)."""
    some = pods.filter("name IS NOT NULL")
    group = lambda c: some.filter(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(F.col(c).alias("key")).agg(F.array_sort(F.collect_list("name")).alias("pods"))
    return {"pod_node": some.select("name", "node_name"), "node_pods": group("node_name"), "service_pods": group("service_name")}


def _alerted_pods(pods: DataFrame, alerts: DataFrame) -> DataFrame:
    top = alerts.groupBy(F.col("service").alias("service_name")).agg(F.max("score").alias("score"))
    return pods.filter("node_name IS NOT NULL AND node_name <> ''").join(top, "service_name").select("name", "service_name", "node_name", "score")


def infra_edges(nodes: DataFrame, pods: DataFrame, k8s_nodes: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """src, dst, edge_type, shared_node: DEPLOYED_AS (known service -> pod), RUNS_ON (pod -> known machine), COLOCATED (pods of alerted services on one machine, both ways)."""
    none = F.lit(None).cast("string").alias("shared_node")
    deployed = pods.join(nodes.filter("node_type <> 'pod'").select(F.col("id").alias("service_name")), "service_name", "left_semi").select(F.col("service_name").alias("src"), F.col("name").alias("dst"), F.lit("DEPLOYED_AS").alias("edge_type"), none)
    runs = pods.join(k8s_nodes.select(F.col("name").alias("node_name")).filter("node_name <> ''"), "node_name", "left_semi").select("name", "node_name", F.lit("RUNS_ON"), none)
    out = deployed.union(runs)
    if alerts is not None:
        a = _alerted_pods(pods, alerts).select("name", "node_name")
        b = a.select(F.col("name").alias("other"), "node_name")
        out = out.union(a.join(b, "node_name").filter("name <> other").select("name", "other", F.lit("COLOCATED"), "node_name"))
    return out


def service_colocated(edges: DataFrame) -> DataFrame:
    """src, dst: services that share a machine, by DEPLOYED_AS and COLOCATED edges."""
    d = edges.filter("edge_type = 'DEPLOYED_AS'").select(F.col("src").alias("service"), F.col("dst").alias("pod"))
    c = edges.filter("edge_type = 'COLOCATED'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    left = c.join(d.select(F.col("pod").alias("a"), F.col("service").alias("src")), "a")
    return left.join(d.select(F.col("pod").alias("b"), F.col("service").alias("dst")), "b").filter("src <> dst").select("src", "dst").distinct()


def noisy_neighbors(pods: DataFrame, alerts: DataFrame) -> DataFrame:
    """pod_a, pod_b, service_a, service_b, shared_node, alerted_service, evidence: pairs of alerted pods on one machine; the one of higher score is named."""
    a = _alerted_pods(pods, alerts)
    x = a.select("node_name", F.col("name").alias("pod_a"), F.col("service_name").alias("service_a"), F.col("score").alias("s_a"))
    y = a.select("node_name", F.col("name").alias("pod_b"), F.col("service_name").alias("service_b"), F.col("score").alias("s_b"))
    p = x.join(y, "node_name").filter("pod_a < pod_b")
    text = F.format_string("Pods '%s' (svc=%s, score=%.3f) and '%s' (svc=%s, score=%.3f) share node '%s'", "pod_a", "service_a", "s_a", "pod_b", "service_b", "s_b", "node_name")
    return p.select("pod_a", "pod_b", "service_a", "service_b", F.col("node_name").alias("shared_node"), F.when(F.col("s_a") >= F.col("s_b"), F.col("service_a")).otherwise(F.col("service_b")).alias("alerted_service"), text.alias("evidence"))


def infra_counts(pods: DataFrame, k8s_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.agg(F.count_if(F.col("edge_type").isin("DEPLOYED_AS", "RUNS_ON", "COLOCATED")).alias("infra_edges"))
    return pods.agg(F.count_distinct("name").alias("pods")).crossJoin(k8s_nodes.agg(F.count_distinct("name").alias("machines"))).crossJoin(e)


def port_drift(services_json: DataFrame, bad_port: int = 9999, preferred: list[str] | None = None, col: str = "json") -> DataFrame:
    """service, port_index, port: ports that send to bad_port; preferred services first."""
    s = services_json.select(F.explode(F.from_json(col, _SERVICES)["items"]).alias("s")).select(F.col("s.metadata.name").alias("service"), F.posexplode("s.spec.ports").alias("port_index", "p"))
    s = s.filter(F.col("p.targetPort") == str(bad_port)).select("service", "port_index", F.col("p.port").alias("port")).distinct()
    return s.orderBy((~F.col("service").isin(preferred or [])).cast("int"), "service", "port_index")


def unhealthy_pods(lines: DataFrame, col: str = "line") -> DataFrame:
    return lines.filter(F.col(col).rlike(UNHEALTHY))
