"""DuckDB SQL of the wider queries: CTEs and statements that oracles.py takes in."""

from __future__ import annotations


def canon(x: str) -> str:
    """The name of a service without a pod's hashes or ordinal."""
    return rf"regexp_replace({x}, '^(?:(.+)-[a-z0-9]{{5,}}-[a-z0-9]{{4,}}|(.+)-\d+)$', '\1\2')"


def role(x: str) -> str:
    n = f"lower(coalesce({x}, ''))"
    return f"""CASE WHEN {n} = '' THEN 'UNKNOWN'
    WHEN regexp_matches({n}, 'jaeger|prometheus|grafana|otel|opentelemetry|opensearch|opamp|telemetry|loki|chaos|metrics-server|mcp|chatbot') THEN 'OBSERVABILITY'
    WHEN regexp_matches({n}, 'load-generator|loadgenerator|wrk|wrk2-job|locust') THEN 'LOADGEN' WHEN regexp_matches({n}, 'kafka|rabbitmq|nats|zookeeper') THEN 'BROKER'
    WHEN regexp_matches({n}, 'mongodb|mysql|postgres|redis|valkey|memcached|-db|tidb|etcd|consul') THEN 'DATASTORE' WHEN regexp_matches({n}, 'frontend-proxy|frontend-web|nginx|istio|envoy|ingress|loadbalancer') THEN 'GATEWAY'
    WHEN regexp_matches({n}, 'fraud-detection|accounting|email') THEN 'ASYNC_CONSUMER' ELSE 'APP' END"""


def ranks(name: str, edges: str, restart: str | None = None) -> dict[str, str]:
    """CTEs of 40 rounds of PageRank over `edges` (src, dst, w): `name`, with the columns id and s. restart: a query of ids."""
    jump = f"CASE WHEN id IN ({restart}) THEN 1.0::DOUBLE / (SELECT count(*) FROM {name}_id WHERE id IN ({restart})) ELSE 0.0::DOUBLE END" if restart else f"1.0::DOUBLE / (SELECT count(*) FROM {name}_id)"
    return {
        f"{name}_sh": f"SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM {edges}",
        f"{name}_id": f"SELECT src AS id FROM {name}_sh UNION SELECT dst FROM {name}_sh",
        f"{name}_m": f"""SELECT i.id AS a, k.id AS b, 0.85 * (coalesce(share, 0) + CASE WHEN i.id IN (SELECT src FROM {name}_sh) THEN 0 ELSE k.j END) + 0.15 * k.j AS p
  FROM {name}_id i CROSS JOIN (SELECT id, {jump} AS j FROM {name}_id) k LEFT JOIN {name}_sh ON src = i.id AND dst = k.id""",
        f"{name}_r": f"SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM {name}_id) AS s, 0 AS k FROM {name}_id UNION ALL SELECT b, sum(s * p), k + 1 FROM {name}_r JOIN {name}_m ON id = a WHERE k < 40 GROUP BY b, k",
        name: f"SELECT id, s FROM {name}_r WHERE k = 40",
    }


_LINE = " ".join(
    f"WHEN {k} THEN '{t}'"
    for k, t in enumerate((
        "ERROR error connecting to svc-3-0: connection refused", "request timed out: context deadline exceeded", "Exception in handler: sql syntax error", "connect() refused Host: svc-2-1 Port 5432",
        "container OOMKilled: memory limit reached", "x509: certificate has expired", "Back-off pulling image: ImagePullBackOff", "targetPort 9999 mismatch",
    ))
)
_REFUSED = r"(?i)REFUSED|CONNECT\(\)|FAILED TO CONNECT|COULD NOT CONNECT|CANNOT CONNECT|NO ROUTE TO HOST|CONNECT: CONNECTION"
_HOST, _NAME = r"(?i)Host:\s*([A-Za-z0-9_.-]+?)\s+Port", r"(?i)(?:failed to connect|could not connect|cannot connect to|connect to|connecting to)\s+([A-Za-z][\w.-]*?)(?:-client)?(?:[\s.:]|$)"
_log = lambda n, cap: f"round_even(least(1.0, ln(1 + {n}) / ln({cap + 1})), 3)::DOUBLE"
_TOKEN = "(x IS NULL OR x = '' OR x IN ('SYSTEM', 'INCIDENT') OR regexp_matches(x, '^(HTTP_|LOG_|ERROR|TIMEOUT|HIGH_|POD_|STATUS_)'))"
_token = lambda x: _TOKEN.replace("x IS", f"{x} IS").replace("OR x =", f"OR {x} =").replace("OR x IN", f"OR {x} IN").replace("matches(x", f"matches({x}")
_KNOWN = "('CONNECTION_REFUSED', 'LOG_ERROR', 'TIMEOUT', 'POD_UNHEALTHY', 'HTTP_ERROR', 'HIGH_LATENCY', 'HIGH_CPU', 'HIGH_MEM')"
_EMIT = "CASE WHEN target = 'POD_UNHEALTHY' THEN 5.0 WHEN target LIKE 'CONNECTION%' OR target LIKE '%REFUSED%' THEN 8.0 WHEN target = 'LOG_ERROR' THEN 4.5 WHEN target IN ('HIGH_CPU', 'HIGH_MEM') THEN 3.0 ELSE 2.0 END"
_fact_edges = lambda facts: f"""SELECT src, dst, arg_max(w, seq)::DOUBLE AS w FROM (SELECT CASE WHEN relationship IN ('calls', 'emits', 'blocks') THEN target ELSE source END AS src, CASE WHEN relationship IN ('calls', 'emits', 'blocks') THEN source ELSE target END AS dst,
  CASE WHEN relationship = 'emits' THEN {_EMIT} WHEN relationship = 'blocks' THEN 1.5 ELSE 1.0 END AS w, concat_ws('|', source, relationship, target) AS seq FROM {facts}) GROUP BY 1, 2"""  # noqa: E731

CTE = {
    "flawed": "SELECT CASE WHEN ingest_seq % 90 <> 2 THEN trace_id END AS trace_id, CASE WHEN ingest_seq % 50 = 0 THEN '' ELSE span_id END AS span_id, CASE WHEN ingest_seq % 70 = 1 THEN ' ' ELSE service_name END AS service_name, ingest_seq FROM raw",
    "redges": "SELECT DISTINCT p.src, s.service_name AS dst FROM (SELECT *, CASE WHEN parent_span = 'ROOT' THEN 's' || substr(trace_id, 2) || '-7' ELSE parent_span END AS up FROM spans) s JOIN parents p ON s.up = p.p_id WHERE p.src <> s.service_name",
    "rwalk": "SELECT [src, dst] AS path, dst AS last FROM redges WHERE src < dst UNION ALL SELECT list_append(path, dst), dst FROM rwalk JOIN redges ON src = last WHERE dst > path[1] AND NOT list_contains(path, dst)",
    "loops": "SELECT array_to_string(path, '>') AS cycle FROM rwalk JOIN redges ON src = last AND dst = path[1]",
    "wedges": "SELECT src, dst, 1.0::DOUBLE AS w FROM edges",
    "rwedges": "SELECT src, dst, 1.0::DOUBLE AS w FROM redges",
    **ranks("prank", "wedges"),
    **ranks("arank", "wedges", "SELECT service FROM alerts"),
    **ranks("erank", "wedges", "SELECT DISTINCT service_name FROM spans WHERE has_error"),
    **ranks("crank", "rwedges"),
    "tfedges": _fact_edges("tfacts"),
    **ranks("trank", "tfedges"),
    "flines": f"SELECT 'svc-' || (user_id % 7 + 1) || '-' || (event_id % 2) AS service, CASE event_id % 40 {_LINE} ELSE 'ok ' || event_type END AS line FROM events",
    "lfacts": f"""SELECT svc AS source, 'emits' AS relationship, 'LOG_ERROR' AS target, 'logs error_lines=' || count(*) AS citation_quote, {_log('count(*)', 100)} AS relevance FROM (SELECT {canon('service')} AS svc, line FROM flines) WHERE regexp_matches(line, '(?i)ERROR|FATAL|EXCEPTION|PANIC|TRACEBACK') GROUP BY 1
  UNION ALL SELECT svc, 'blocks', 'TIMEOUT', 'logs timeout_lines=' || count(*), {_log('count(*)', 50)} FROM (SELECT {canon('service')} AS svc, line FROM flines) WHERE regexp_matches(line, '(?i)TIMEOUT|TIMED OUT|DEADLINE') GROUP BY 1
  UNION ALL SELECT callee, 'emits', 'CONNECTION_REFUSED', 'logs connection_refused_lines=' || count(*), {_log('count(*)', 50)} FROM (SELECT CASE WHEN regexp_matches(line, '{_HOST}') THEN {canon(f"regexp_extract(line, '{_HOST}', 1)")} ELSE {canon(f"regexp_extract(line, '{_NAME}', 1)")} END AS callee FROM flines WHERE regexp_matches(line, '{_REFUSED}')) WHERE NOT {_token('callee')} GROUP BY 1""",
    "pfacts": """SELECT 'pod' AS source, 'emits' AS relationship, 'POD_UNHEALTHY' AS target, 'kubectl pods ' || (SELECT string_agg(w, ', ' ORDER BY w) FROM (SELECT DISTINCT w FROM (SELECT 'status=' || status AS w FROM pod WHERE status <> 'Running' UNION ALL SELECT 'ready=' || ready FROM pod WHERE ready = '0/1' UNION ALL SELECT 'restarts=' || restarts FROM pod WHERE restarts >= 8 OR (restarts >= 3 AND (status <> 'Running' OR ready = '0/1'))))) AS citation_quote,
  round_even(least(1.0, ln(1 + count(*)) / ln(11)), 3)::DOUBLE AS relevance FROM pod WHERE status <> 'Running' OR ready = '0/1' OR restarts >= 8 HAVING count(*) > 0""",
    "nofacts": f"SELECT *, CASE WHEN {_token('source')} THEN 'UNKNOWN' ELSE {role('source')} END AS source_type FROM (SELECT * FROM tfacts UNION ALL SELECT * FROM pfacts UNION ALL SELECT * FROM lfacts UNION ALL SELECT 'SYSTEM', 'has_task', 'analysis', 'task started', 0.0)",
    "afacts": f"SELECT source, relationship, target, max(relevance) AS relevance, CASE WHEN {_token('source')} THEN 'UNKNOWN' ELSE {role('source')} END AS source_type FROM (SELECT source, relationship, target, relevance FROM nofacts UNION ALL SELECT * FROM peer UNION ALL SELECT * FROM own) GROUP BY 1, 2, 3",
    "ascores": f"""SELECT source, role, sum(w) * CASE WHEN source IN (SELECT source FROM afacts WHERE relationship = 'calls' AND target IN (SELECT source FROM afacts WHERE relationship IN ('emits', 'blocks'))) THEN 0.5 ELSE 1.0 END AS score
  FROM (SELECT f.source, f.source_type AS role, CASE WHEN relationship = 'emits' THEN {_EMIT} ELSE 4.0 END * greatest(coalesce(nullif(relevance, 0), 1.0), 0.1) * CASE f.source_type WHEN 'GATEWAY' THEN 0.5 WHEN 'DATASTORE' THEN 0.4 WHEN 'BROKER' THEN 0.3 WHEN 'ASYNC_CONSUMER' THEN 0.25 WHEN 'OBSERVABILITY' THEN 0.1 WHEN 'LOADGEN' THEN 0.1 ELSE 1.0 END AS w
    FROM afacts f WHERE relationship IN ('emits', 'blocks')) GROUP BY 1, 2""",
    "afedges": _fact_edges("afacts"),
    **ranks("frank", "afedges"),
    "bad": f"SELECT DISTINCT source AS name FROM afacts WHERE relationship IN ('emits', 'blocks') AND NOT {_token('source')}",
    "suspects": f"""SELECT *, row_number() OVER (ORDER BY score DESC, pagerank DESC, service)::INT AS rank FROM (SELECT name AS service, round(coalesce(score, 0), 9) AS score, round(coalesce(s, 0), 9) AS pagerank, coalesce(role, 'UNKNOWN') AS role
  FROM (SELECT name FROM bad UNION SELECT dst FROM afedges WHERE src IN (SELECT name FROM bad) UNION SELECT src FROM afedges WHERE dst IN (SELECT name FROM bad)) LEFT JOIN ascores ON source = name LEFT JOIN frank ON id = name WHERE NOT {_token('name')} AND name NOT IN {_KNOWN} ORDER BY score DESC, pagerank DESC, service LIMIT 8)""",
    "peerq": """SELECT service AS source, 'emits' AS relationship, CASE WHEN kind = 'cpu' THEN 'HIGH_CPU' ELSE 'HIGH_MEM' END AS target, printf('metric %s max=%.3f mean=%.3f (%.1fx, cross-sectional)', metric, mx, round(round(mean, 9)::DECIMAL(30, 12), 3)::DOUBLE, ratio) AS citation_quote, round_even(least(1.0, log10(greatest(ratio, 1.0001)) / 3), 3)::DOUBLE AS relevance
  FROM (SELECT m.service, m.kind, m.metric, max(value) AS mx, any_value(mean) AS mean, max(value) / any_value(mean) AS ratio FROM metric m JOIN (SELECT metric, avg(value) AS mean FROM metric GROUP BY 1 HAVING avg(value) > 0) USING (metric) GROUP BY 1, 2, 3 HAVING max(value) >= 2 * any_value(mean)) QUALIFY row_number() OVER (PARTITION BY service, kind ORDER BY ratio DESC, metric DESC) = 1""",
    "ownq": """SELECT service AS source, 'emits' AS relationship, CASE WHEN kind = 'cpu' THEN 'HIGH_CPU' ELSE 'HIGH_MEM' END AS target, printf('metric %s current=%.3f baseline=%.3f (z=%.1f, own-history)', metric, round(round(c, 9)::DECIMAL(30, 12), 3)::DOUBLE, round(round(b, 9)::DECIMAL(30, 12), 3)::DOUBLE, z) AS citation_quote, round_even(least(1.0, ln(1 + abs(z)) / ln(16)), 3)::DOUBLE AS relevance
  FROM (SELECT *, (c - b) / greatest(sd, abs(b) * 0.05, 1e-6) AS z FROM (SELECT service, kind, metric, avg(value) FILTER (i > n - cur) AS c, avg(value) FILTER (i <= n - cur) AS b, stddev_pop(value) FILTER (i <= n - cur) AS sd FROM (SELECT *, least(greatest(3, floor(n * 0.3)), n - 3) AS cur FROM hist WHERE n >= 6) GROUP BY 1, 2, 3))
  WHERE NOT (b = 0 AND sd = 0) AND abs(z) >= 3 QUALIFY row_number() OVER (PARTITION BY service, kind ORDER BY abs(z) DESC, metric DESC) = 1""",
    "quoted": f"""SELECT source, relationship, target, citation_quote, relevance, CASE WHEN {_token('source')} THEN 'UNKNOWN' ELSE {role('source')} END AS source_type FROM (SELECT source, relationship, target, citation_quote, relevance FROM nofacts UNION ALL SELECT * FROM peerq UNION ALL SELECT * FROM ownq)
  QUALIFY row_number() OVER (PARTITION BY source, relationship, target ORDER BY relevance DESC NULLS LAST, citation_quote) = 1""",
    "rows1": "SELECT substr(sha1(concat_ws('|', 's1', source, relationship, target)), 1, 16) AS edge_id, source, relationship, target, citation_quote, relevance, source_type FROM quoted",
    "near0": "SELECT source AS name FROM rows1 WHERE contains(lower(source), 'svc-5') OR contains(lower(target), 'svc-5') UNION SELECT target FROM rows1 WHERE contains(lower(source), 'svc-5') OR contains(lower(target), 'svc-5')",
    "near1": "SELECT name FROM near0 UNION SELECT target FROM rows1 WHERE source IN (SELECT name FROM near0) UNION SELECT source FROM rows1 WHERE target IN (SELECT name FROM near0)",
    "pats": r"""SELECT service, trim(regexp_replace(regexp_replace(regexp_replace(line, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[\d.:Z+-]*', '', 'g'), '(?i)\b[0-9a-f]{8,}\b', '<id>', 'g'), '\b\d+\.\d+\.\d+\.\d+(:\d+)?\b', '<ip>', 'g')) AS pattern FROM flines""",
    "tops": "SELECT pattern, count(*) AS count, array_to_string(list_sort(list(DISTINCT service)), ',') AS services, count(DISTINCT service) AS n, count(*) / (SELECT count(*) FROM pats) AS share FROM pats GROUP BY 1",
    "rules": """SELECT * FROM (VALUES (0.5, NULL, 0.0, 'restart', 'kubectl rollout restart deployment/{s}', 'Restart {s}', 'Restart {s} due to high error rate ({e})', 'remediation', 0), (0.5, NULL, 0.5, 'check_logs', 'kubectl logs -l app={s} --tail=100', 'Check logs for {s}', 'Check logs for {s}', 'diagnostic', 1),
  (0.1, 0.5, 0.0, 'check_resources', 'kubectl top pods -l app={s}', 'Check resources for {s}', 'Check resource usage for {s}', 'diagnostic', 2), (0.1, 0.5, 0.5, 'scale_up', 'kubectl scale deployment/{s} --replicas=3', 'Scale up {s}', 'Scale up {s} if resource constrained', 'remediation', 3),
  (NULL, 0.1, 0.0, 'check_dependencies', 'kubectl describe deployment/{s}', 'Check deployment for {s}', 'Check dependencies and config for {s}', 'diagnostic', 4), (NULL, NULL, 0.3, 'check_pods', 'kubectl get pods -l app={s} -o wide', 'Check pods for {s}', 'Check pod status for {s}', 'diagnostic', 5)) t(lo, hi, step, action, cmd, title, descr, category, no)""",
    "ruled": "SELECT action, r.service, rank, replace(cmd, '{s}', r.service) AS command, (rank + step)::DOUBLE AS priority, replace(title, '{s}', r.service) AS title, replace(replace(descr, '{s}', r.service), '{e}', printf('%.1f%%', error_rate * 100)) AS description, category, NULL::DOUBLE AS confidence, no FROM ranked r JOIN rules ON (lo IS NULL OR error_rate > lo) AND (hi IS NULL OR error_rate <= hi) WHERE rank <= 3",
    "fixes": "SELECT 'svc-' || (o_custkey % 7) || '-1' AS service, 'kubectl rollout restart' AS fix FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'P' GROUP BY 1",
    "plan": """SELECT action, service AS target, service, command, priority, title, description, category, confidence, row_number() OVER (ORDER BY priority, service, no)::INT AS sequence FROM (SELECT * FROM ruled WHERE service NOT IN (SELECT service FROM fixes)
  UNION ALL SELECT 'apply_known_fix', service, rank, fix, rank::DOUBLE, 'Apply known fix for ' || service, 'Apply proven resolution from similar past incident', 'remediation', 0.9, 0 FROM ranked JOIN fixes USING (service) WHERE rank <= 3)""",
    "rplan": "SELECT action, service, command, category, row_number() OVER (ORDER BY priority, service, no)::INT AS sequence FROM ruled",
    "acts": """SELECT o_orderkey AS seq, 'svc-' || (o_orderkey % 7) AS service, o_totalprice AS priority, (['rollout_restart', 'rollback', 'scale', 'patch_port', 'set_image', 'wait_ready', 'other'])[o_orderkey % 7 + 1] AS action, CASE WHEN o_orderkey % 2 = 0 THEN 'remediation' ELSE 'diagnostic' END AS category,
  'step ' || o_orderkey AS title, CASE o_orderkey % 12 WHEN 0 THEN 'kubectl scale deployment/svc-' || (o_orderkey % 7) || ' --replicas=' || (o_orderkey % 9) WHEN 1 THEN 'kubectl rollout restart deployment/svc-' || (o_orderkey % 7) WHEN 2 THEN 'kubectl patch configmap svc-' || (o_orderkey % 7) || ' -p x' WHEN 3 THEN 'kubectl set env deployment/svc-' || (o_orderkey % 7) || ' FOO=1 BAZ=2' WHEN 4 THEN 'helm upgrade svc-' || (o_orderkey % 7) || ' chart'
    WHEN 5 THEN 'kubectl delete pods -l app=svc-' || (o_orderkey % 7) WHEN 6 THEN 'kubectl apply -f svc-' || (o_orderkey % 7) || '.yaml' WHEN 7 THEN 'kubectl get pods -l app=svc-' || (o_orderkey % 7) WHEN 8 THEN 'kubectl delete namespace svc-' || (o_orderkey % 7) WHEN 9 THEN 'rm -rf /var/svc-' || (o_orderkey % 7) WHEN 10 THEN 'kubectl logs -f svc-' || (o_orderkey % 7) ELSE '' END AS command FROM orders""",
    "undos": """SELECT *, CASE seq % 12 WHEN 0 THEN 'kubectl scale deployment/' || service || ' --replicas=' || greatest(1, seq % 9 - 2) WHEN 1 THEN 'kubectl rollout undo deployment/' || service WHEN 2 THEN '# Manual revert required for configmap ' || service || ' — restore from backup' WHEN 3 THEN 'kubectl set env deployment/' || service || ' FOO- BAZ-' WHEN 4 THEN 'helm rollback ' || service
    WHEN 5 THEN '# Pod deletion is self-healing; verify with: kubectl get pods -w' WHEN 6 THEN 'kubectl delete -f ' || service || '.yaml' ELSE '# No automatic revert for: ' || command END AS revert_cmd FROM acts""",
    "kern": "SELECT 'svc-' || (user_id % 100) AS service, event_id AS k FROM events",
    "signals": """SELECT service, 'kernel_socket_latency' AS type, CASE WHEN k % 260 > 200 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, printf('Socket p99 latency=%.1fms (threshold=50.0ms)', (k % 260)::DOUBLE) AS evidence FROM kern WHERE k % 260 >= 50
  UNION ALL SELECT service, 'syscall_error_spike', CASE WHEN k % 120 > 100 THEN 'CRITICAL' ELSE 'HIGH' END, 'Syscall errors=' || (k % 120) || ' (dominant=' || CASE WHEN k % 50 >= k % 70 THEN 'EPIPE:' || (k % 50) ELSE 'EIO:' || (k % 70) END || ')' FROM kern WHERE k % 120 >= 10
  UNION ALL SELECT service, 'tcp_retransmission_spike', 'MEDIUM', 'TCP retransmits=' || (k % 60) || ' (possible network congestion)' FROM kern WHERE k % 60 > 50
  UNION ALL SELECT service, 'fd_exhaustion', 'CRITICAL', 'File descriptor exhaustion detected (' || (k % 1000) || ' open FDs)' FROM kern WHERE k % 33 = 0""",
    "near": "SELECT DISTINCT a.service_name AS service FROM alerted a JOIN alerted b ON a.node_name = b.node_name AND a.name <> b.name AND a.service_name <> b.service_name",
    "lostp": """SELECT c.service, depth, coalesce(a.score, 0) AS al, coalesce(n.span_count, 0) / (SELECT max(span_count) FROM nodes) AS vol, ewma_mean, ewma_std, CASE WHEN c.service LIKE '%-0' THEN s_err ELSE error_rate END AS er, CASE WHEN c.service LIKE '%-0' THEN s_mean ELSE duration_mean_ms END AS mean
  FROM cands c LEFT JOIN nodes n ON n.id = c.service LEFT JOIN (SELECT service_name AS service, round(count(*) FILTER (has_error) / count(*), 4) AS s_err, round(avg(duration_ms), 3) AS s_mean FROM spans GROUP BY 1) s ON s.service = c.service LEFT JOIN baselines b ON b.service = c.service LEFT JOIN (SELECT service, max(score) AS score FROM alerts GROUP BY 1) a ON a.service = c.service""",
    "lost": "SELECT *, (CASE WHEN ewma_std <= 0.001 THEN (CASE WHEN abs(mean - ewma_mean) > 0.001 THEN 10.0 ELSE 0.0 END) ELSE round((mean - ewma_mean) / ewma_std, 3) END)::DOUBLE AS z FROM lostp",
    "stdspans": "SELECT trace_id, span_id, parent_span, service_name, operation_name, start_time, duration / 1000.0::DOUBLE AS duration_ms, has_error, response FROM resp",
    "words": "SELECT c_custkey AS id, (['jaeger', 'load-generator', 'Kafka', 'user-db', 'redis', 'frontend-proxy', 'nginx', 'email', 'checkout', '', 'mongodb-rate', 'fraud-detection', 'wrk2-job', 'istio-ingress', 'geo'])[c_custkey % 15 + 1] AS word FROM customer",
}

_RED = "least(1.0, we * least(1.0, er * 3) + wl * (CASE WHEN abs(z) > 2 THEN least(1.0, abs(z) / 10) ELSE 0 END) + wa * al + 0.10 * vol + least(0.15, depth * 0.03))"
_TPL = "CASE action WHEN 'rollout_restart' THEN 'kubectl rollout restart deployment/' || t || ' -n prod' WHEN 'rollback' THEN 'kubectl rollout undo deployment/' || t || ' -n prod' WHEN 'scale' THEN 'kubectl scale deployment/' || t || ' -n prod --replicas=1' WHEN 'patch_port' THEN 'kubectl patch deployment/' || t || ' -n prod --type=''json'' -p=''[{\"op\":\"replace\",\"path\":\"/spec/template/spec/containers/0/ports/0/containerPort\",\"value\":8080}]''' WHEN 'set_image' THEN 'kubectl set image deployment/' || t || ' ' || t || '=' || t || ':latest -n prod' WHEN 'wait_ready' THEN 'kubectl wait --for=condition=ready pod --all -n prod --timeout=180s' ELSE 'kubectl rollout restart deployment/' || t || ' -n prod' END"
_FMT = "printf('[%s] %s -%s-> %s (%s): %s', source_type, source, relationship, target, printf('%.2f', round(relevance::DECIMAL(8, 3), 2)::DOUBLE), citation_quote) AS text"
STATEMENTS = {
    "i1_read_csv": "SELECT *, row_number() OVER (ORDER BY trace_id, span_id, start_time, duration_ms, service_name, has_error, response) AS arrival FROM stdspans",
    "i2_read_mixed": "SELECT *, row_number() OVER (ORDER BY trace_id, span_id, start_time, duration_ms, service_name, has_error, response) AS arrival FROM stdspans",
    "i3_read_auto": "SELECT *, row_number() OVER (ORDER BY start_time % 2, trace_id, span_id, start_time, duration_ms, service_name, has_error, response) AS arrival FROM stdspans",
    "i4_read_json": "SELECT * FROM stdspans",
    "i5_normalize_spans": """SELECT 't' || l_orderkey AS trace_id, l_partkey::VARCHAR AS span_id, CASE WHEN k % 3 = 0 THEN 'ROOT' ELSE k::VARCHAR END AS parent_span, CASE WHEN k % 4 = 0 THEN 'unknown' ELSE 'svc-' || k END AS service_name, 'op' AS operation_name, CASE WHEN k = 5 THEN 0 ELSE l_suppkey END AS start_time,
  CASE WHEN k % 2 = 0 THEN 1.5 ELSE k END::DOUBLE AS duration_ms, CASE WHEN k % 2 = 0 THEN 1500 ELSE k * 1000 END::BIGINT AS duration, k <= 4 AS has_error, CASE WHEN k IN (2, 3, 4, 6) THEN 'Unknown' ELSE (['200', '', '', '', '503', '', 'ok'])[k] END AS response,
  CASE WHEN k <= 4 THEN 'ERROR' WHEN k = 6 THEN 'UNKNOWN' ELSE (['200', '', '', '', '503', '', 'ok'])[k] END AS status, CASE WHEN k = 7 THEN 1 ELSE 0 END AS n_tags FROM (SELECT *, l_linenumber::BIGINT AS k FROM lineitem)""",
    "i14_read_metrics": "SELECT 'cpu_' || event_type AS metric, 'pod-' || (user_id % 50) AS service, (event_id * 2)::DOUBLE AS ts, value FROM events WHERE event_id % 10 <> 0",
    "i15_read_metric_files": "SELECT lower(event_type) AS metric, 'pod' || (user_id % 50) AS service, event_id::DOUBLE AS ts, value FROM events",
    "i16_read_logs": "SELECT coalesce(source, 'none') AS service, unnest(['first line', 'doc ' || doc_id, '']) AS line FROM documents",
    "i17_read_pods": "SELECT name, ready, status, restarts::VARCHAR AS restarts FROM pod",
    "i18_unwrap_text": "SELECT unnest(['order ' || o_orderkey, 'status' || chr(9) || o_orderstatus]) AS line FROM orders",
    "i8_validate_spans": """, flaws AS (SELECT ingest_seq, array_to_string(list_filter(['' || CASE WHEN coalesce(trim(trace_id), '') = '' THEN 'trace_id' END, CASE WHEN trim(span_id) = '' THEN 'span_id' END, CASE WHEN trim(service_name) = '' THEN 'service_name' END], lambda x: x IS NOT NULL), ', ') AS missing FROM flawed)
SELECT count(*) FILTER (missing = '') = count(*) AS is_valid, count(*) FILTER (missing = '') AS valid_count, count(*) AS total_count, count(*) FILTER (missing = '') / count(*) * 100 AS validation_rate, (SELECT string_agg('span ' || ingest_seq || ': missing ' || missing, '; ' ORDER BY ingest_seq) FROM (SELECT * FROM flaws WHERE missing <> '' ORDER BY ingest_seq LIMIT 10)) AS errors FROM flaws""",
    "g3_cycles": "SELECT cycle FROM loops",
    "g4_pagerank": "SELECT id, round(s, 6) AS score FROM prank",
    "g5_personal_pagerank": "SELECT id, round(s, 6) AS score FROM arank",
    "g6_fact_pagerank": "SELECT id, round(s, 6) AS score FROM trank",
    "g9_graph_json": """SELECT '{"directed":true,"nodes":[' || (SELECT string_agg('{"id":"' || id || '","node_type":"service"}', ',' ORDER BY id) FROM nodes) || '],"links":[' || (SELECT string_agg('{"source":"' || src || '","target":"' || dst || '","call_count":' || call_count || ',"error_rate":' || error_rate || '}', ',' ORDER BY src, dst) FROM edges) || ']}' AS json""",
    "g3_strong_components": """, reach AS (SELECT src AS a, dst AS b FROM redges UNION SELECT a, dst FROM reach JOIN redges ON b = src)
SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1""",
    "g10_graph_summary": "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM redges) AS edge_count, (SELECT count(*) FROM loops) AS cycle_count, (SELECT string_agg(id, ',' ORDER BY s DESC, id) FROM (SELECT id, round(s, 9) AS s FROM crank ORDER BY 2 DESC, id LIMIT 5)) AS top",
    "g11_graph_sink": "SELECT id AS a, '' AS b, 'service' AS kind, CASE WHEN id LIKE '%-1' THEN 0 ELSE span_count END AS n FROM nodes UNION ALL SELECT src, dst, 'CALLS', CASE WHEN src LIKE 'svc-1-%' THEN -call_count ELSE call_count END FROM edges",
    "g12_trace_sink": "SELECT trace_id AS src, span_id AS dst, 'CONTAINS' AS edge_type FROM spans UNION ALL SELECT span_id, service_name, 'EXECUTED_BY' FROM spans UNION ALL SELECT span_id, parent_span, 'CHILD_OF' FROM spans WHERE parent_span <> 'ROOT'",
    "r12_rca_sink": "SELECT 'inc-1' AS incident_id, rank, service, CASE WHEN rank <= 2 THEN 0 ELSE confidence END::DOUBLE AS confidence FROM ranked WHERE rank <= 10 UNION ALL SELECT 'inc-2', rank, service, confidence FROM ranked WHERE rank <= 3",
    "m2_store_incidents": "SELECT 'o' || o_orderkey AS id, 'svc-' || (o_custkey % 7) AS root_cause, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 3 = 0 THEN 'resolved' ELSE 'pending' END AS outcome, md5('service:svc-' || (o_custkey % 50) || '|anomaly:' || o_orderpriority) AS signature FROM orders",
    "t19_store_facts": "SELECT 's1' AS session_id, relationship, 0.5::DOUBLE AS relevance, count(*) AS n FROM afacts GROUP BY 2 UNION ALL SELECT 's2', relationship, relevance, count(*) FROM afacts WHERE relationship = 'calls' GROUP BY 2, 3",
    "t20_active_facts": "SELECT substr(sha1(concat_ws('|', 's2', source, relationship, target)), 1, 16) AS edge_id, source, relationship, target FROM afacts WHERE relationship = 'calls'",
    "t21_store_sessions": "SELECT 'c' || c_custkey AS session_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'done' ELSE 'open' END AS global_status FROM customer",
    "n1_flatten_pods": "SELECT 'pod-' || s_suppkey AS name, 'prod' AS namespace, 'node-' || s_nationkey AS node_name, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS labels, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 9) || 'm' END AS cpu_request, CASE WHEN s_suppkey % 5 <> 0 THEN '64Mi' END AS memory_request, 'svc-' || (s_suppkey % 7 + 1) AS service_name FROM supplier",
    "n2_flatten_nodes": "SELECT 'node-' || n_nationkey AS name, (n_nationkey + 2)::VARCHAR AS capacity_cpu, '8Gi' AS capacity_memory, CASE WHEN n_nationkey % 4 = 0 THEN 'DiskPressure' ELSE 'Ready,DiskPressure' END AS conditions FROM nation",
    "n4_index_maps": "SELECT 'pod_node' AS kind, 'pod-' || s_suppkey AS key, 'node-' || s_nationkey AS value FROM supplier UNION ALL SELECT 'node_pods', 'node-' || s_nationkey, string_agg('pod-' || s_suppkey, ',' ORDER BY 'pod-' || s_suppkey) FROM supplier GROUP BY 2 UNION ALL SELECT 'service_pods', 'svc-' || (s_suppkey % 7 + 1), string_agg('pod-' || s_suppkey, ',' ORDER BY 'pod-' || s_suppkey) FROM supplier GROUP BY 2",
    "n9_infra_counts": "SELECT (SELECT count(*) FROM pod) AS pods, (SELECT count(*) FROM nation) AS machines, (SELECT count(*) FROM pod WHERE service_name IN (SELECT id FROM nodes)) + (SELECT count(*) FROM pod) + (SELECT count(*) FROM alerted a JOIN alerted b ON a.node_name = b.node_name AND a.name <> b.name) AS infra_edges",
    "n10_port_drift": "SELECT 'app-' || s_suppkey AS service, 0 AS port_index, 80 AS port FROM supplier WHERE s_suppkey % 17 = 0 UNION ALL SELECT 'app-' || s_suppkey, 1, 443 FROM supplier WHERE s_suppkey % 19 = 0",
    "n11_unhealthy_pods": "SELECT name || ' ' || ready || ' ' || status || ' ' || restarts AS line FROM pod WHERE status = 'CrashLoopBackOff'",
    "d10_detector_choice": "SELECT service, score, z_score FROM alerts",
    "d14_kernel_signals": "SELECT * FROM signals",
    "d15_suspect_signals": "SELECT * FROM signals WHERE service LIKE 'svc-1%'",
    "d17_alert_ranks": "SELECT service, score, round(s, 6) AS pagerank FROM alerts LEFT JOIN prank ON id = service",
    "r5_infra_term": """SELECT service, round(greatest(0, least(1.0, CASE WHEN service IN (SELECT service FROM near) THEN m * 0.9 + deep + 0.1 * 0.3 ELSE m + deep END)), 4)::DOUBLE AS confidence FROM (SELECT service, deep, we * err + wl * (CASE WHEN abs(z) > 2 THEN least(1.0, abs(z) / 10) ELSE 0 END) + wa * al + 0.10 * vol AS m FROM parts CROSS JOIN weights)""",
    "r6_span_fallbacks": f"SELECT service, round(greatest(0, {_RED}), 4)::DOUBLE AS confidence, round(er, 4) AS error_rate, z AS latency_z_score FROM lost CROSS JOIN weights",
    "r11_fault_tree": """, fw AS (SELECT [(SELECT service FROM ranked WHERE rank = 1)] AS path, (SELECT service FROM ranked WHERE rank = 1) AS last UNION ALL SELECT list_append(path, edges.dst), edges.dst FROM fw JOIN edges ON edges.src = last WHERE NOT list_contains(path, edges.dst) AND last <> 'svc-5-1' AND len(path) <= 7),
chain AS (SELECT path FROM fw WHERE last = 'svc-5-1' ORDER BY len(path), path LIMIT 1), tree AS (SELECT service FROM ranked WHERE rank <= 5 UNION SELECT 'svc-5-1' UNION SELECT unnest(path) FROM chain)
SELECT src, dst FROM edges WHERE src IN (SELECT service FROM tree) AND dst IN (SELECT service FROM tree) UNION SELECT path[i], path[i + 1] FROM (SELECT path, unnest(range(1, len(path))) AS i FROM chain) UNION ALL SELECT service, '' FROM tree""",
    "r13_reorder": "SELECT service, row_number() OVER (ORDER BY pos NULLS LAST, rank)::INT AS rank FROM (SELECT r.service, rank, CASE WHEN r.service LIKE '%-0' THEN span_count END AS pos FROM ranked r LEFT JOIN stats s ON s.service = r.service)",
    "r14_apply_deltas": "SELECT service, confidence, row_number() OVER (ORDER BY CASE WHEN old = 3 THEN 0 ELSE 1 END, confidence DESC, service)::INT AS rank FROM (SELECT service, rank AS old, round(greatest(0, least(1.0, confidence + (rank * 0.05::DOUBLE - 0.2::DOUBLE))), 4)::DOUBLE AS confidence FROM ranked)",
    "r15_pick_start": "SELECT id AS service FROM erank WHERE id IN (SELECT DISTINCT service_name FROM spans WHERE has_error) ORDER BY round(s, 9) DESC, id LIMIT 1",
    "t2_service_role": f"SELECT id, {role('CASE WHEN word = chr(0) THEN word ELSE word END').replace('CASE WHEN word = chr(0) THEN word ELSE word END', 'name')} AS role FROM (SELECT id, CASE WHEN word = '' THEN '' ELSE word || '-' || id END AS name FROM words)",
    "t8_pod_of": "SELECT o_orderkey, 'pod-' || o_custkey AS pod FROM orders",
    "t12_log_facts": "SELECT * FROM lfacts",
    "t17_merge_facts": "SELECT * FROM quoted",
    "t19_fact_rows": "SELECT substr(sha1(concat_ws('|', 's1', source, relationship, target)), 1, 16) AS edge_id, 's1' AS session_id, 'observer' AS agent_id, source, relationship, target, citation_quote, 1 AS hierarchy_level, relevance, true AS is_active, source_type FROM quoted",
    "t22_neighbourhood": f"SELECT {_FMT} FROM (SELECT * FROM rows1 WHERE source IN (SELECT name FROM near1) OR target IN (SELECT name FROM near1) ORDER BY relevance DESC, edge_id LIMIT 40)",
    "t22_many_seeds": """, sd AS (SELECT DISTINCT source AS seed FROM rows1 WHERE source NOT LIKE 'user%'), hit AS (SELECT seed, source, target FROM sd JOIN rows1 ON contains(lower(source), lower(seed)) OR contains(lower(target), lower(seed))),
  n0 AS (SELECT seed, source AS name FROM hit UNION SELECT seed, target FROM hit), n1 AS (SELECT * FROM n0 UNION SELECT seed, target FROM n0 JOIN rows1 ON source = name UNION SELECT seed, source FROM n0 JOIN rows1 ON target = name),
  touch AS (SELECT DISTINCT seed, edge_id, relevance FROM n1 JOIN rows1 ON source = name OR target = name)
SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY relevance DESC, edge_id)::INT AS place, edge_id FROM touch QUALIFY place <= 40""",
    "t18_decide_with_logs": f"""SELECT kind, count(*) FILTER (d) > 0 OR (count(*) FILTER (NOT d AND relevance >= 0.3) > 0 AND count(DISTINCT source) FILTER (NOT d AND relevance >= 0.3) / count(DISTINCT source) <= 0.3) AS anomaly, round(count(DISTINCT source) FILTER (NOT d AND relevance >= 0.3) / count(DISTINCT source), 4) AS concentration
FROM (SELECT *, target IN ('CONNECTION_REFUSED', 'LOG_ERROR', 'TIMEOUT', 'POD_UNHEALTHY') AS d FROM (SELECT 'spans' AS kind, source, relationship, target, relevance FROM tfacts UNION ALL SELECT 'logs', source, relationship, target, relevance FROM lfacts UNION ALL SELECT 'pods', source, relationship, target, relevance FROM pfacts) WHERE relationship IN ('emits', 'blocks') AND NOT {_token('source')}) GROUP BY 1""",
    "d10_choice_by_day": "SELECT strftime(make_timestamp(start_time), '%Y-%m-%d') AS day, count(*) AS span_count, CASE WHEN count(*) >= 30 THEN 'forest' ELSE 'ewma' END AS detector FROM spans GROUP BY 1",
    "t23_fact_lines": f"SELECT {_FMT} FROM rows1",
    "s1_rank_suspects": "SELECT service, round(score, 6) AS score, round(pagerank, 6) AS pagerank, role, rank FROM suspects",
    "s7_rank_facts": "SELECT service AS source, 'ranked' AS relationship, 'SUSPECT_RANK_' || rank AS target, printf('topological diagnoser rank %d/%d, anomaly_score=%.2f, role=%s', rank, (SELECT count(*) FROM suspects), score, role) AS citation_quote, round_even(greatest(0.1, 1 - (rank - 1) / (SELECT count(*) FROM suspects) * 0.9), 3)::DOUBLE AS relevance, role AS source_type FROM suspects",
    "s8_relabel_suspects": "SELECT service, label, round(adjusted, 6) AS adjusted, row_number() OVER (ORDER BY adjusted DESC, rank)::INT AS rank FROM (SELECT *, score * CASE label WHEN 'ROOT_CAUSE' THEN 2.0 WHEN 'SYMPTOM' THEN 0.6 WHEN 'NORMAL' THEN 0.25 ELSE 1.0 END::DOUBLE AS adjusted FROM (SELECT service, score, rank, CASE WHEN rank = 1 THEN 'SYMPTOM' WHEN rank % 3 = 0 THEN 'ROOT_CAUSE' WHEN rank % 3 = 1 THEN 'NORMAL' ELSE 'odd' END AS label FROM suspects))",
    "l5_clusters": "SELECT pattern, count, CASE WHEN share >= 0.5 THEN 'CRITICAL' WHEN share >= 0.25 THEN 'HIGH' WHEN share >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, services, printf('%d of %d lines in %d services', count, (SELECT count(*) FROM pats), n) AS summary FROM tops ORDER BY count DESC, pattern LIMIT 5",
    "l6_cluster_fault_type": "SELECT coalesce((SELECT CASE WHEN regexp_matches(lower(pattern), 'network|connection') THEN 'Network' WHEN regexp_matches(lower(pattern), 'auth|permission') THEN 'Auth Issue' ELSE 'Misconfiguration' END FROM (SELECT * FROM tops ORDER BY count DESC, pattern LIMIT 12) WHERE regexp_matches(lower(pattern), 'network|connection|auth|permission|config') ORDER BY count, pattern DESC LIMIT 1), 'Misconfiguration') AS fault_type",
    "l7_redact_map": "SELECT o_orderkey, '[REDACTED]' AS password, 'api_key=[REDACTED] ok' AS note, o_orderstatus AS status FROM orders",
    "m4_update_outcome": """SELECT 'o' || k AS id, CASE WHEN k % 4 = 0 THEN coalesce(CASE WHEN st = 'P' THEN 'false_positive' WHEN k % 3 = 0 THEN 'resolved' END, 'pending') WHEN (k + 3) % 3 = 0 THEN 'resolved' ELSE 'failed' END AS outcome, round(0.5 + CASE WHEN k % 4 = 0 THEN 0 ELSE -0.1 END, 4)::DOUBLE AS confidence FROM (SELECT o_orderkey AS k, o_orderstatus AS st FROM orders)""",
    "m7_anomaly_type": "SELECT array_to_string(list_sort(list(DISTINCT anomaly_type)), '+') AS anomaly_type FROM (SELECT * FROM alerts ORDER BY score DESC, service LIMIT 3)",
    "m3_similar_from_lists": """, inc AS (SELECT 'o' || o_orderkey AS id, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5 = 0)::INT AS ts, 'svc-' || (o_custkey % 50) AS service, 'svc-' || (CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 50 % 3 ELSE o_custkey % 7 END) AS root_cause FROM orders),
asked AS (SELECT 'o' || o_orderkey AS case_id, 'svc-' || (o_custkey % 50) AS service, 'svc-' || (o_custkey % 7) AS root_cause FROM orders WHERE o_orderkey % 50 = 0)
SELECT case_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, id)::INT AS rank FROM (SELECT DISTINCT case_id, inc.id, inc.ts FROM asked JOIN inc ON inc.service = asked.service OR inc.root_cause = asked.root_cause)) WHERE rank <= 5""",
    "m8_similar_links": """, inc AS (SELECT 'o' || o_orderkey AS id, o_orderdate AS ts, 'svc-' || (o_custkey % 50) AS service, 'svc-' || (o_custkey % 7) AS root_cause, o_orderkey AS k FROM orders), asked AS (SELECT id AS case_id, service, root_cause FROM inc WHERE k % 50 = 0)
SELECT case_id AS src, id AS dst, 'SIMILAR_TO' AS edge_type FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, id) AS rank FROM (SELECT DISTINCT case_id, inc.id, inc.ts FROM asked JOIN inc ON inc.service = asked.service OR inc.root_cause = asked.root_cause)) WHERE rank <= 5 AND case_id <> id""",
    "a1_mitigation_plan": "SELECT *, true AS approved, CASE WHEN category = 'diagnostic' THEN 'Auto-approved (diagnostic)' ELSE 'Auto-approved (benchmark mode)' END AS approval_note, NULL::VARCHAR AS blocked FROM plan",
    "a5_regressed": """, h AS (SELECT o_orderkey % 2 AS part, o_custkey % 100 AS service, round(0.40 * count(*) FILTER (o_orderstatus = 'F') + 0.35 * count(*) FILTER (o_orderstatus = 'O') + 0.25 * count(*) FILTER (o_orderstatus = 'P'), 4)::DOUBLE AS score FROM orders GROUP BY 1, 2)
SELECT a.service, b.score AS before, a.score AS after, a.score > b.score + 0.05 AS regressed, a.score > b.score + 0.05 AND a.service % 5 < 3 AS retry FROM h a JOIN h b ON a.service = b.service AND a.part = 1 AND b.part = 0""",
    "a6_revert_commands": "SELECT seq, command AS action_cmd, revert_cmd, service, title AS description, true AS executed, false AS reverted FROM undos",
    "a7_undo_order": "SELECT row_number() OVER (ORDER BY seq DESC) AS step, seq, revert_cmd FROM undos WHERE seq % 5 <> 0",
    "a8_screen_commands": r"SELECT seq, CASE seq % 12 WHEN 8 THEN 'destructive — not permitted' WHEN 9 THEN 'forbidden pattern rm\s+-rf' WHEN 10 THEN 'follow mode — not permitted' WHEN 11 THEN 'no action specified' END AS blocked FROM acts",
    "a9_render_actions": f"SELECT action, t AS target, {_TPL} AS command FROM (SELECT action, service AS t FROM acts ORDER BY category <> 'remediation', priority, seq LIMIT 1)",
    "a10_error_columns": "SELECT \"column\", mean FROM (SELECT unnest(['error_rate', 'http_5xx', 'Errors']) AS column, unnest([round(avg(l_tax), 6), round(avg(l_discount / 100), 6), round(avg(l_discount), 6)]) AS mean, unnest([avg(l_tax), avg(l_discount / 100), avg(l_discount)]) AS m FROM lineitem) WHERE m > 0.01",
    "a11_cross_check": "SELECT (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM pod WHERE status = 'CrashLoopBackOff') AS unhealthy, ((SELECT count(*) FROM alerts) > 0) = ((SELECT count(*) FROM pod WHERE status = 'CrashLoopBackOff') > 0) AS agrees",
    "e1_incident_report": """, lg AS (SELECT service_name AS service, printf('[%s] op=%s response=%s duration=%.0fms trace=%s', service_name, operation_name, response, duration_ms, left(trace_id, 8)) AS line FROM (SELECT * FROM spans WHERE has_error AND service_name IN (SELECT service FROM ranked WHERE rank <= 5) ORDER BY ingest_seq LIMIT 60)),
pt AS (SELECT trim(regexp_replace(line, '(?i)\\b[0-9a-f]{8,}\\b', '<id>', 'g')) AS pattern FROM lg)
SELECT 'INC-1' AS incident_id, (SELECT service FROM primary_s) AS primary_error_service, (SELECT service FROM ranked WHERE rank = 1) AS root_cause_service, (SELECT round_even(confidence, 3) FROM ranked WHERE rank = 1)::DOUBLE AS root_cause_confidence, (SELECT count(*) FROM alerts) AS alerts_detected, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count,
  (SELECT string_agg(service || '=' || round_even(confidence, 3)::DOUBLE, ',' ORDER BY rank) FROM ranked WHERE rank <= 3) AS causes, (SELECT string_agg(pattern, ',' ORDER BY n DESC, pattern) FROM (SELECT pattern, count(*) AS n FROM pt GROUP BY 1 ORDER BY n DESC, pattern LIMIT 5)) AS patterns,
  (SELECT count(*) FROM rplan) AS action_count, (SELECT string_agg(sequence || ':' || action || ':' || service, ',' ORDER BY sequence) FROM rplan) AS actions, (SELECT count(*) FROM orders WHERE 'svc-' || (o_custkey % 7) || '-1' IN (SELECT service FROM ranked WHERE rank = 1)) AS similar_cases""".replace("\\\\", "\\"),
    "e2_answers": """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 3 > 0 THEN '"Yes"' ELSE '"No"' END WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN '["svc-' || (o_orderkey % 7) || '"]' ELSE '["unknown"]' END
  WHEN 2 THEN '{"system_level":"' || CASE WHEN o_custkey % 5 <> 0 THEN 'Network' ELSE 'Application' END || '","fault_type":"' || CASE WHEN o_custkey % 7 <> 0 THEN 'NetworkFailure' ELSE 'Misconfiguration' END || '"}' END AS answer FROM orders""",
    "e3_open_fields": """SELECT incident_id, field FROM (SELECT 'o' || o_orderkey AS incident_id, o_orderkey AS k, unnest((['ANOMALY_CONFIRMED', 'ROOT_CAUSE_SERVICE', 'FAULT_TYPE', 'FAULT_LAYER', 'MITIGATION_ACTION', 'MITIGATION_EXECUTED', 'TNR_VERIFIED'])[1:([1, 2, 4, 7])[o_orderkey % 4 + 1]]) AS field FROM orders)
WHERE NOT (field = 'ANOMALY_CONFIRMED' AND k % 2 = 0) AND NOT (field = 'ROOT_CAUSE_SERVICE' AND k % 3 = 0) AND NOT (field = 'FAULT_TYPE' AND k % 5 = 0)""",
    "e4_diagnosis": """SELECT '{"faults":[' || (SELECT string_agg('{"entity_name":"' || service || '","entity_type":"service","root_cause":' || (rank = 1) || '}', ',' ORDER BY rank) FROM ranked) || ']}' AS diagnosis, '{"mitigation":[[' || (SELECT string_agg('{"action":"' || action || '"}', ',' ORDER BY sequence) FROM rplan) || ']]}' AS remediation""",
    "e7_accuracy": """SELECT kind AS task_type, CASE kind WHEN 'detection' THEN 'Detection Accuracy' WHEN 'localization' THEN 'Localization Accuracy' WHEN 'analysis' THEN 'system_level_correct' WHEN 'mitigation' THEN 'Mitigation Success' ELSE 'Accuracy' END AS metric, CASE kind WHEN 'detection' THEN 'TTD' WHEN 'localization' THEN 'TTL' WHEN 'analysis' THEN 'TTA' WHEN 'mitigation' THEN 'TTM' ELSE 'Time' END AS time_field, round(avg((o_custkey % 3 <> 0)::INT), 4) AS accuracy, count(*) AS n
FROM (SELECT *, (['detection', 'localization', 'analysis', 'mitigation', 'unknown'])[o_orderkey % 5 + 1] AS kind FROM orders) GROUP BY 1""",
    "e8_worker_counts": "SELECT count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderkey % 7 = 0 OR o_orderstatus <> 'F') AS failed FROM orders",
}
