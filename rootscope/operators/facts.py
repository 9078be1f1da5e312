"""Telemetry to facts (source, relationship, target, citation_quote, relevance, source_type), and suspects from facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import INFRA_SERVICES, ROLE_PRIORS, canonical_service, is_token, linear_relevance, log_relevance, ratio_relevance, rounded, service_role, usage_kind
from .graph import cut, fact_edges, pagerank
from .incidents import beside, by_incident
from .order import numbered, percentiles

# Signals that decide at any count; words of failed connections; healthy pod states.
DECISIVE = ("CONNECTION_REFUSED", "LOG_ERROR", "TIMEOUT", "POD_UNHEALTHY")
KNOWN_TARGETS = (*DECISIVE, "HTTP_ERROR", "HIGH_LATENCY", "HIGH_CPU", "HIGH_MEM")
ERROR_WORDS = r"(?i)ERROR|FATAL|EXCEPTION|PANIC|TRACEBACK"
TIMEOUT_WORDS = r"(?i)TIMEOUT|TIMED OUT|DEADLINE"
REFUSED_WORDS = r"(?i)REFUSED|CONNECT\(\)|FAILED TO CONNECT|COULD NOT CONNECT|CANNOT CONNECT|NO ROUTE TO HOST|CONNECT: CONNECTION"
CALLEE_HOST = r"(?i)Host:\s*([A-Za-z0-9_.-]+?)\s+Port"
CALLEE_NAME = r"(?i)(?:failed to connect|could not connect|cannot connect to|connect to|connecting to)\s+([A-Za-z][\w.-]*?)(?:-client)?(?:[\s.:]|$)"
HEALTHY = ("Running", "Completed", "Succeeded")


def _fact(rel: str, target: str | Column, quote: Column, relevance: Column, source: str = "service", by: Sequence[str] = ()) -> list[Column]:
    t = F.lit(target) if isinstance(target, str) else target
    return [*(F.col(b) for b in by), F.col(source).alias("source"), F.lit(rel).alias("relationship"), t.alias("target"), quote.alias("citation_quote"), relevance.alias("relevance")]


@by_incident
def trace_facts(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """calls, emits HTTP_ERROR and blocks HIGH_LATENCY of spans. Durations are compared as they come, in microseconds, with the median of the incident."""
    svc = canonical_service(F.col("service_name"))
    s = spans.select(*by, F.trim("span_id").alias("span_id"), F.trim("parent_span").alias("parent"), svc.alias("service"), F.coalesce("has_error", F.lit(False)).alias("bad"), F.col("duration").cast("double").alias("d"), "ingest_seq").filter("service <> ''")
    parents = s.filter("span_id <> ''").groupBy(*by, F.col("span_id").alias("parent")).agg(F.max_by("service", "ingest_seq").alias("caller"))
    calls = s.filter("parent <> ''").join(parents, [*by, "parent"]).filter("caller <> service").groupBy(*by, "caller", "service").agg(F.count("*").alias("vol"), F.count_if("bad").alias("err"))
    quote = F.concat(F.lit("trace call volume="), F.col("vol").cast("string"), F.lit(" errors="), F.col("err").cast("string"))
    out = calls.select(*_fact("calls", F.col("service"), quote, linear_relevance(F.col("vol")), "caller", by))
    errs = s.filter("bad").groupBy(*by, "service").agg(F.count("*").alias("n"))
    out = out.union(errs.select(*_fact("emits", "HTTP_ERROR", F.concat(F.lit("trace error_spans="), F.col("n").cast("string")), log_relevance(F.col("n"), 100.0), by=by)))
    med = percentiles(s.withColumn("all", F.lit(0)), [*by, "all"], "d", {"med": 0.5}, between=True).select(*by, "med")
    avg = beside(s.groupBy(*by, "service").agg(F.avg("d").alias("avg")), med, by)
    slow = avg.filter(F.col("avg") >= F.greatest(F.lit(100.0), 2 * F.col("med"))).withColumn("ratio", F.col("avg") / F.greatest("med", F.lit(1.0)))
    return out.union(slow.select(*_fact("blocks", "HIGH_LATENCY", F.format_string("trace avg_duration=%.0f median=%.0f (%.1fx)", "avg", "med", "ratio"), ratio_relevance(F.col("ratio")), by=by)))


def pod_facts(pods: DataFrame, restart_floor: int = 8) -> DataFrame:
    """emits POD_UNHEALTHY: a bad status, no container ready, or very many restarts; 3 restarts count beside another sign only. pods: name, ready, status, restarts."""
    up, total = F.split("ready", "/")[0].try_cast("int"), F.try_element_at(F.split("ready", "/"), F.lit(2)).try_cast("int")
    n = F.col("restarts").try_cast("int")
    bad_status, not_ready = (F.col("status") != "") & ~F.col("status").isin(*HEALTHY), (up == 0) & (total > 0)
    ill = F.coalesce(bad_status, F.lit(False)) | F.coalesce(not_ready, F.lit(False))
    many = F.coalesce(n >= restart_floor, F.lit(False))
    why = F.array_compact(F.array(F.when(bad_status, F.concat(F.lit("status="), "status")), F.when(not_ready, F.concat(F.lit("ready="), "ready")), F.when(many | (ill & F.coalesce(n >= 3, F.lit(False))), F.concat(F.lit("restarts="), F.col("restarts").cast("string")))))
    p = drop_infra(pods.withColumn("service", canonical_service(F.col("name")))).filter("service <> ''")
    p = p.select("service", why.alias("why"), (ill | many).alias("bad")).filter("bad").select("service", F.explode("why").alias("w"), F.lit(1).alias("one"))
    n_pods = drop_infra(pods.withColumn("service", canonical_service(F.col("name")))).filter(ill | many).groupBy("service").agg(F.count("*").alias("n"))
    reasons = p.groupBy("service").agg(F.array_sort(F.collect_set("w")).alias("w")).join(n_pods, "service")
    return reasons.select(*_fact("emits", "POD_UNHEALTHY", F.concat(F.lit("kubectl pods "), F.array_join("w", ", ")), log_relevance(F.col("n"), 10.0)))


def _usage(metrics: DataFrame) -> DataFrame:
    m = metrics.withColumn("kind", usage_kind(F.col("metric")))
    return m.filter("kind IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND service <> ''")


def _target() -> Column:
    return F.when(F.col("kind") == "cpu", F.lit("HIGH_CPU")).otherwise(F.lit("HIGH_MEM"))


def peer_outliers(metrics: DataFrame) -> DataFrame:
    """Services at twice the mean of a metric or more; of cpu and of mem the strongest metric each. Quotes print means of nine digits, so that they don't hang on the order of sums."""
    m = _usage(metrics)
    mean = m.groupBy("metric").agg(F.avg("value").alias("mean")).filter("mean > 0")
    top = m.groupBy("metric", "kind", "service").agg(F.max("value").alias("mx")).join(mean, "metric").filter("mx >= 2 * mean").withColumn("ratio", F.col("mx") / F.col("mean"))
    best = top.groupBy("service", "kind").agg(F.max(F.struct("ratio", "metric", "mx", "mean")).alias("b")).select("service", "kind", "b.*")
    return best.select(*_fact("emits", _target(), F.format_string("metric %s max=%.3f mean=%.3f (%.1fx, cross-sectional)", "metric", "mx", F.round("mean", 9), "ratio"), ratio_relevance(F.col("ratio"))))


def own_outliers(metrics: DataFrame, z_min: float = 3.0, saturate: float = 15.0) -> DataFrame:
    """Series whose last 30 % (3 points at least, 6 in all) left the rest by z_min deviations; a floor of 5 % of the mean holds for the deviation."""
    m = _usage(metrics)
    keys = ["metric", "kind", "service"]
    m = numbered(m.select(*keys, "ts", "value"), keys, ["ts", "value"], "i", "n").filter("n >= 6")
    m = m.withColumn("cur", F.least(F.greatest(F.lit(3), F.floor(F.col("n") * 0.3)), F.col("n") - 3)).filter("cur >= 3")
    now = F.col("i") > F.col("n") - F.col("cur")
    s = m.groupBy(*keys).agg(F.avg(F.when(now, F.col("value"))).alias("c"), F.avg(F.when(~now, F.col("value"))).alias("b"), F.stddev_pop(F.when(~now, F.col("value"))).alias("sd")).filter("NOT (b = 0 AND sd = 0)")
    s = s.withColumn("z", (F.col("c") - F.col("b")) / F.greatest("sd", F.abs("b") * 0.05, F.lit(1e-6))).filter(F.abs("z") >= z_min)
    best = s.groupBy("service", "kind").agg(F.max(F.struct(F.abs("z").alias("az"), "metric", "z", "c", "b")).alias("x")).select("service", "kind", "x.*")
    return best.select(*_fact("emits", _target(), F.format_string("metric %s current=%.3f baseline=%.3f (z=%.1f, own-history)", "metric", F.round("c", 9), F.round("b", 9), "z"), log_relevance(F.abs("z"), saturate)))


@by_incident
def best_facts(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of the facts of a (source, relationship, target) the one of highest relevance."""
    w = Window.partitionBy(*by, "source", "relationship", "target").orderBy(F.desc_nulls_last("relevance"), "citation_quote")
    return facts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def metric_facts(metrics: DataFrame) -> DataFrame:
    """Outliers among peers and against a series' own history, the stronger one of each service and kind."""
    return best_facts(peer_outliers(metrics).unionByName(own_outliers(metrics)))


def drop_infra(df: DataFrame, col: str = "service") -> DataFrame:
    return df.filter(~F.coalesce(F.lower(col).isin(*INFRA_SERVICES), F.lit(False)))


def log_facts(lines: DataFrame) -> DataFrame:
    """emits LOG_ERROR, blocks TIMEOUT by service; emits CONNECTION_REFUSED by the callee that the line names. lines: service, line."""
    s = drop_infra(lines.withColumn("service", canonical_service(F.col("service")))).filter("service <> ''")
    host, name = F.regexp_extract("line", CALLEE_HOST, 1), F.regexp_replace(F.regexp_extract("line", CALLEE_NAME, 1), r"(?i)-client$", "")
    callee = F.when(F.col("line").rlike(CALLEE_HOST), canonical_service(host)).otherwise(canonical_service(name))
    n = s.groupBy("service").agg(F.count_if(F.col("line").rlike(ERROR_WORDS)).alias("e"), F.count_if(F.col("line").rlike(TIMEOUT_WORDS)).alias("t"))
    quote = lambda what, c: F.concat(F.lit(f"logs {what}="), F.col(c).cast("string"))
    out = n.filter("e > 0").select(*_fact("emits", "LOG_ERROR", quote("error_lines", "e"), log_relevance(F.col("e"), 100.0)))
    out = out.union(n.filter("t > 0").select(*_fact("blocks", "TIMEOUT", quote("timeout_lines", "t"), log_relevance(F.col("t"), 50.0))))
    refused = drop_infra(s.filter(F.col("line").rlike(REFUSED_WORDS)).select(callee.alias("service"))).filter(~is_token(F.col("service"))).groupBy("service").agg(F.count("*").alias("c"))
    return out.union(refused.select(*_fact("emits", "CONNECTION_REFUSED", quote("connection_refused_lines", "c"), log_relevance(F.col("c"), 50.0))))


@by_incident
def merge_facts(facts: DataFrame, task_type: str = "unknown", by: Sequence[str] = ()) -> DataFrame:
    """The best fact of each triple, stamped with its source's role, and one that marks the task (of each incident that has facts)."""
    names = ("source", "relationship", "target", "citation_quote", "relevance")
    mark = [F.lit(v).alias(c) for c, v in zip(names, ("SYSTEM", "has_task", task_type, "task started", 0.0), strict=True)]
    incidents = facts.select(*by).distinct() if by else facts.sparkSession.range(1)
    f = best_facts(facts.select(*by, *names).union(incidents.select(*by, *mark)), by=by)
    return f.withColumn("source_type", F.when(is_token(F.col("source")), F.lit("UNKNOWN")).otherwise(service_role(F.col("source"))))


@by_incident
def decide_incident(facts: DataFrame, floor: float = 0.3, ceiling: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """One row (of each incident that has signals): anomaly, concentration. A decisive signal, or strong ones on few enough of the flagged services."""
    shaped = facts.filter(F.col("relationship").isin("emits", "blocks")).filter(~is_token(F.col("source")))
    decisive = F.col("target").isin(*DECISIVE)
    strong = ~decisive & (F.coalesce("relevance", F.lit(0.0)) >= floor)
    a = shaped.groupBy(*by).agg(F.coalesce(F.bool_or(decisive), F.lit(False)).alias("d"), F.coalesce(F.bool_or(strong), F.lit(False)).alias("s"), F.count_distinct("source").alias("all"), F.count_distinct(F.when(strong, F.col("source"))).alias("few"))
    share = F.coalesce(F.try_divide("few", "all"), F.lit(0.0))
    return a.select(*by, (F.col("d") | (F.col("s") & (share <= ceiling))).alias("anomaly"), rounded(share, 4).alias("concentration"))


def fact_rows(facts: DataFrame, session_id: str, agent_id: str = "observer") -> DataFrame:
    """Facts as stored: with edge_id (a hash of session and triple), trimmed, relationship in small letters, quote of 240 characters."""
    s, r, t = F.trim("source"), F.lower(F.trim("relationship")), F.trim("target")
    edge = F.substring(F.sha1(F.concat_ws("|", F.lit(session_id), s, r, t).cast("binary")), 1, 16)
    level = F.lit(1)
    return facts.select(edge.alias("edge_id"), F.lit(session_id).alias("session_id"), F.lit(agent_id).alias("agent_id"), s.alias("source"), r.alias("relationship"), t.alias("target"), F.substring("citation_quote", 1, 240).alias("citation_quote"), level.alias("hierarchy_level"), F.coalesce("relevance", F.lit(1.0)).alias("relevance"), F.lit(True).alias("is_active"), F.current_timestamp().alias("extracted_at"), F.coalesce("source_type", F.lit("UNKNOWN")).alias("source_type")).filter("source <> '' AND relationship <> '' AND target <> ''")


def upsert_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of the rows of an edge_id the latest."""
    w = Window.partitionBy("edge_id").orderBy(F.desc("extracted_at"), F.desc("__new"))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__new")


def active_facts(facts: DataFrame, session_id: str) -> DataFrame:
    return facts.filter((F.col("session_id") == session_id) & F.col("is_active"))


def neighbourhoods(facts: DataFrame, seeds: DataFrame, k: int = 1, most: int = 40) -> DataFrame:
    """session_id, seed and, for each, the facts of its session that touch a name within k undirected steps, the most relevant first (place from 1).

    seeds: session_id, seed. A seed is an edge_id of the session, else a part of a name, in whatever case; the search begins at both ends of every fact that it hits.
    Names that a seed has reached are rows (session_id, seed, name), so that each step is one join for all seeds.
    """
    s = seeds.select("session_id", F.trim("seed").alias("seed")).dropna().filter("seed <> ''").distinct()
    f = facts.select("session_id", "edge_id", "source", "target")
    by_id = f.join(s.withColumn("edge_id", F.col("seed")), ["session_id", "edge_id"])
    parts = s.join(by_id.select("session_id", "seed").distinct(), ["session_id", "seed"], "left_anti")
    part = F.lower("seed")
    by_name = f.join(parts, "session_id").filter(F.lower("source").contains(part) | F.lower("target").contains(part))
    both = by_id.select("session_id", "seed", "source", "target").union(by_name.select("session_id", "seed", "source", "target"))
    seen = cut(both.select("session_id", "seed", F.explode(F.array("source", "target")).alias("name")).distinct(), "seen")
    links = f.select("session_id", F.col("source").alias("name"), F.col("target").alias("next"))
    links = cut(links.union(links.select("session_id", "next", "name")).distinct(), "links")
    front = seen
    for _ in range(k):
        step = front.join(links, ["session_id", "name"]).select("session_id", "seed", F.col("next").alias("name")).distinct()
        front = cut(step.join(seen, ["session_id", "seed", "name"], "left_anti"), "front")
        seen = seen.union(front)
    ends = f.select("session_id", "edge_id", F.explode(F.array("source", "target")).alias("name"))
    touched = ends.join(seen, ["session_id", "name"]).select("session_id", "seed", "edge_id").distinct()
    out = touched.join(facts.dropDuplicates(["session_id", "edge_id"]), ["session_id", "edge_id"])
    place = F.row_number().over(Window.partitionBy("session_id", "seed").orderBy(F.desc("relevance"), "edge_id"))
    return out.withColumn("place", place).filter(F.col("place") <= most)


def neighbourhood(facts: DataFrame, seed: str, k: int = 1, most: int = 40) -> DataFrame:
    """The facts of one session that touch a name within k undirected steps of the seed, the most relevant first; see neighbourhoods."""
    one = facts.withColumn("session_id", F.lit(""))
    seeds = facts.sparkSession.createDataFrame([("", seed)], "session_id string, seed string")
    found = neighbourhoods(one, seeds, k, most).select("edge_id", "place")  # blanks around the seed don't count
    return facts.dropDuplicates(["edge_id"]).join(found, "edge_id").orderBy("place").select(facts.columns)


def fact_lines(facts: DataFrame) -> DataFrame:
    return facts.select(F.format_string("[%s] %s -%s-> %s (%.2f): %s", F.coalesce("source_type", F.lit("UNKNOWN")), "source", "relationship", "target", "relevance", F.coalesce("citation_quote", F.lit(""))).alias("text"))


def emit_weight(target: Column) -> Column:
    t = F.upper(F.coalesce(target, F.lit("")))
    refused = t.startswith("CONNECTION") | t.contains("REFUSED") | t.startswith("CONN_")
    return F.when(t == "POD_UNHEALTHY", 5.0).when(refused, 8.0).when(t == "LOG_ERROR", 4.5).when(t.isin("HIGH_CPU", "HIGH_MEM"), 3.0).otherwise(F.lit(2.0))


def _not_service(c: Column, parity: bool) -> Column:
    return is_token(c) if parity else is_token(c) | c.isin(*KNOWN_TARGETS)


@by_incident
def anomaly_scores(facts: DataFrame, suppression: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """source, role, score: weights of its signals by relevance and role; halved for callers of an anomalous service."""
    rel = F.col("relationship")
    f = facts.filter(rel.isin("emits", "blocks"))
    stamped = F.upper(F.coalesce("source_type", F.lit("UNKNOWN")))
    roles = facts.groupBy(*by, "source").agg(F.max(F.when(~stamped.isin("UNKNOWN", "SERVICE"), stamped)).alias("role")).withColumn("role", F.coalesce("role", service_role(F.col("source"))))
    prior = F.create_map(*(x for k, v in ROLE_PRIORS.items() for x in (F.lit(k), F.lit(v))))
    strength = F.greatest(F.coalesce(F.nullif("relevance", F.lit(0.0)), F.lit(1.0)), F.lit(0.1))
    w = F.when(rel == "emits", emit_weight(F.col("target"))).otherwise(F.lit(4.0)) * strength * F.coalesce(F.element_at(prior, F.col("role")), F.lit(1.0))
    s = f.join(roles, [*by, "source"]).groupBy(*by, "source", "role").agg(F.sum(w).alias("score"))
    names = s.select(*by, F.col("source").alias("target"))
    callers = facts.filter("relationship = 'calls'").join(names, [*by, "target"], "left_semi").select(*by, "source").distinct().withColumn("calls_bad", F.lit(True))
    return s.join(callers, [*by, "source"], "left").select(*by, "source", "role", (F.col("score") * F.when(F.col("calls_bad"), suppression).otherwise(F.lit(1.0))).alias("score"))


@by_incident
def rank_suspects(facts: DataFrame, k: int = 8, alpha: float = 0.85, parity: bool = False, tol: float = 1e-6, max_iter: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """service, score, pagerank, role, rank: of each incident the first k anomalous services and their neighbours, by (score, PageRank of the reversed graph).

    facts need `seq`, the order in which they came. Names of signals are never suspects; parity: but CONNECTION_REFUSED,
    which some tools let through. Scores count to nine digits, so that the order doesn't hang on the order of sums.
    """
    scores = cut(anomaly_scores(facts, by=by))
    bad = facts.filter(F.col("relationship").isin("emits", "blocks")).filter(~is_token(F.col("source"))).select(*by, F.col("source").alias("name")).distinct()
    e = cut(fact_edges(facts, emit_weight(F.col("target")), by=by))
    end = lambda c: bad.select(*by, F.col("name").alias(c))
    near = e.join(end("src"), [*by, "src"], "left_semi").select(*by, "dst").union(e.join(end("dst"), [*by, "dst"], "left_semi").select(*by, "src"))
    cands = bad.union(near).distinct().filter(~_not_service(F.col("name"), parity))
    ranks = pagerank(e, alpha, "w", tol=tol, max_iter=max_iter, by=by).select(*by, F.col("id").alias("name"), F.col("score").alias("pagerank"))
    out = cands.join(scores.withColumnRenamed("source", "name"), [*by, "name"], "left").join(ranks, [*by, "name"], "left")
    out = out.select(*by, F.col("name").alias("service"), F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"), F.round(F.coalesce("pagerank", F.lit(0.0)), 9).alias("pagerank"), F.coalesce("role", F.lit("UNKNOWN")).alias("role"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("pagerank"), "service")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@by_incident
def rank_facts(suspects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ranks as facts: relationship ranked, target SUSPECT_RANK_i, relevance falling by place."""
    s = beside(suspects, suspects.groupBy(*by).agg(F.count("*").alias("n")), by)
    quote = F.format_string("topological diagnoser rank %d/%d, anomaly_score=%.2f, role=%s", "rank", "n", "score", "role")
    rel = F.bround(F.greatest(F.lit(0.1), 1 - (F.col("rank") - 1) / F.col("n") * 0.9), 3)
    return s.select(*by, F.col("service").alias("source"), F.lit("ranked").alias("relationship"), F.concat(F.lit("SUSPECT_RANK_"), F.col("rank").cast("string")).alias("target"), quote.alias("citation_quote"), rel.alias("relevance"), F.col("role").alias("source_type"))


@by_incident
def relabel_suspects(suspects: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Suspects in order of score times 2, 0.6 or 0.25 by label (missing: SYMPTOM, 1 if unknown); ties as they were. labels: service, label."""
    factor = F.when(F.col("label") == "ROOT_CAUSE", 2.0).when(F.col("label") == "SYMPTOM", 0.6).when(F.col("label") == "NORMAL", 0.25).otherwise(F.lit(1.0))
    s = suspects.join(labels, [*by, "service"], "left").withColumn("label", F.coalesce("label", F.lit("SYMPTOM")))
    s = s.withColumn("adjusted", F.col("score") * factor)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("adjusted"), "rank")))
