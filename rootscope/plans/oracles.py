"""DuckDB SQL for the registered queries: a set of shared CTEs and one statement for each query."""

from __future__ import annotations

import re

from . import oracles_incidents, oracles_wider

CTE = {
    "raw": """SELECT 't' || l_orderkey AS trace_id, 's' || l_orderkey || '-' || l_linenumber AS span_id,
  CASE WHEN l_linenumber > 1 THEN 's' || l_orderkey || '-' || (l_linenumber - 1) ELSE 'ROOT' END AS parent_span,
  'svc-' || l_linenumber || '-' || (l_suppkey % 2) AS service_name, CASE WHEN l_linenumber % 2 = 1 THEN '/api/op' ELSE 'db_query' END AS operation_name,
  epoch_us(l_shipdate) + 1000 * l_linenumber AS start_time, round(l_extendedprice)::BIGINT AS duration, round(l_extendedprice)::BIGINT / 1000.0::DOUBLE AS duration_ms,
  l_returnflag = 'R' AND (l_linenumber = 5 OR l_tax >= 0.08) AS has_error, l_linestatus,
  (l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 7919 + l_suppkey * 104729 + round(l_extendedprice * 100)::BIGINT + round(l_quantity)::BIGINT * 31) % 1000000 AS ingest_seq FROM lineitem""",
    "resp": "SELECT *, CASE WHEN has_error THEN '500' WHEN l_linestatus = 'F' THEN '200' ELSE 'Unknown' END AS response FROM raw",
    "spans": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY ingest_seq) AS rn FROM resp) WHERE rn = 1",
    "stats": """SELECT service_name AS service, count(*) AS span_count, count(*) FILTER (has_error OR response = '500') AS error_count, count(*) FILTER (response = 'Unknown') AS unknown_response_count,
  round(min(duration_ms), 2) AS duration_min_ms, round(max(duration_ms), 2) AS duration_max_ms, round(avg(duration_ms), 2) AS duration_mean_ms, round(stddev_pop(duration_ms), 2) AS duration_std_ms,
  round(quantile_disc(duration_ms, 0.5), 2) AS duration_p50_ms, round(quantile_disc(duration_ms, 0.95), 2) AS duration_p95_ms, round(quantile_disc(duration_ms, 0.99), 2) AS duration_p99_ms,
  list_sort(list(DISTINCT operation_name)) AS operations, round(count(*) FILTER (has_error OR response = '500') / count(*), 4) AS error_rate, round(count(*) FILTER (response = 'Unknown') / count(*) * 100, 1) AS unknown_response_pct
  FROM spans GROUP BY 1""",
    "series": """SELECT service, d, back FROM (SELECT service_name AS service, duration_ms AS d, row_number() OVER (PARTITION BY service_name ORDER BY start_time DESC, ingest_seq DESC) AS back
  FROM (SELECT *, count(*) FILTER (operation_name LIKE '/%') OVER (PARTITION BY service_name) AS n_req FROM spans) WHERE n_req < 2 OR operation_name LIKE '/%')""",
    "base": """SELECT service, list_reduce(list_transform(x, lambda d: {'m': d, 'v': 0.0::DOUBLE}), lambda a, b: {'m': 0.3 * b.m + 0.7 * a.m, 'v': 0.3 * (b.m - (0.3 * b.m + 0.7 * a.m)) * (b.m - (0.3 * b.m + 0.7 * a.m)) + 0.7 * a.v}) AS f, len(x) AS n
  FROM (SELECT service, list(d ORDER BY back DESC) AS x FROM series WHERE back <= 100 GROUP BY 1)""",
    "baselines": "SELECT service, 'duration_ms' AS metric, round(f.m, 3) AS ewma_mean, round(sqrt(f.v), 3) AS ewma_std, n::BIGINT AS sample_count, 0.3::DOUBLE AS alpha FROM base",
    "current_lat": "SELECT service, avg(d) AS current_value FROM series WHERE back <= 10 GROUP BY 1",
    "scored": """SELECT *, round(least(1.0, 0.40 * (CASE WHEN abs(z) > 2 THEN least(1.0, abs(z) / 10) ELSE 0 END) + 0.45 * least(1.0, error_rate * 2) + 0.15 * (CASE WHEN unknown_response_pct > 80 THEN 0.2 ELSE 0 END)), 3)::DOUBLE AS score
  FROM (SELECT s.service, error_rate, unknown_response_pct, ewma_mean AS bm, ewma_std AS bs, coalesce(current_value, duration_mean_ms) AS cv,
    (CASE WHEN ewma_std < 0.001 THEN (CASE WHEN abs(coalesce(current_value, duration_mean_ms) - ewma_mean) > 0.001 THEN 10.0 ELSE 0.0 END) ELSE round((coalesce(current_value, duration_mean_ms) - ewma_mean) / ewma_std, 3) END)::DOUBLE AS z
    FROM stats s JOIN baselines USING (service) LEFT JOIN current_lat USING (service))""",
    "alerts": """SELECT service, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  coalesce(nullif(concat_ws('+', CASE WHEN abs(z) >= 3 THEN 'latency_spike' END, CASE WHEN error_rate >= 0.05 THEN 'error_rate_high' END, CASE WHEN unknown_response_pct > 80 THEN 'unknown_response_gap' END), ''), 'multi_signal') AS anomaly_type,
  score, z AS z_score, cv AS current_value, bm AS baseline_mean, bs AS baseline_std FROM scored WHERE abs(z) >= 3 OR error_rate >= 0.05 OR score > 0.3""",
    "parents": "SELECT span_id AS p_id, max_by(service_name, ingest_seq) AS src FROM spans GROUP BY 1",
    "edges": """SELECT src, service_name AS dst, count(*) AS call_count, round(sum(duration_ms::DECIMAL(20,3))::DOUBLE / count(*), 2) AS avg_duration_ms, round(sum(duration_ms::DECIMAL(20,3)), 2)::DOUBLE AS total_duration_ms,
  count(*) FILTER (has_error) AS error_count, round(count(*) FILTER (has_error) / count(*), 4) AS error_rate, list_sort(list(DISTINCT operation_name)) AS operations
  FROM spans JOIN parents ON parent_span = p_id WHERE src <> service_name GROUP BY 1, 2""",
    "nodes": "SELECT service AS id, * EXCLUDE service FROM stats",
    "primary_s": "SELECT coalesce((SELECT service FROM alerts ORDER BY score DESC, service LIMIT 1), (SELECT service FROM stats WHERE error_rate > 0 ORDER BY error_rate DESC, service LIMIT 1), 'unknown') AS service",
    "walk": """SELECT ['svc-5-1'] AS path, 'svc-5-1' AS last UNION ALL SELECT list_append(path, src), src FROM walk JOIN edges ON edges.dst = last WHERE NOT list_contains(path, src) AND len(path) <= 5""",
    "ended": "SELECT path FROM walk w WHERE len(path) > 1 AND (len(path) = 6 OR NOT EXISTS (SELECT 1 FROM edges WHERE dst = w.last AND NOT list_contains(w.path, src)))",
    "paths": "SELECT row_number() OVER (ORDER BY len(path), array_to_string(path, chr(1))) AS path_no, path FROM ended QUALIFY path_no <= 200",
    "cands": "SELECT service, min(depth) AS depth FROM (SELECT service, min_by(depth, path_no) AS depth FROM (SELECT path_no, unnest(path) AS service, generate_subscripts(path, 1) - 1 AS depth FROM paths) GROUP BY 1 UNION ALL SELECT 'svc-5-1', 0) GROUP BY 1",
    "kinds": "SELECT coalesce(bool_or(contains(lower(anomaly_type), 'error')), false) AS e, coalesce(bool_or(contains(lower(anomaly_type), 'latency')), false) AS l FROM alerts",
    "weights": "SELECT CASE WHEN e AND NOT l THEN 0.50 WHEN l AND NOT e THEN 0.15 ELSE 0.35 END::DOUBLE AS we, CASE WHEN e AND NOT l THEN 0.15 WHEN l AND NOT e THEN 0.50 ELSE 0.35 END::DOUBLE AS wl, CASE WHEN e <> l THEN 0.20 ELSE 0.15 END::DOUBLE AS wa FROM kinds",
    "parts": """SELECT c.service, depth, coalesce(n.error_rate, 0) AS er, coalesce(a.score, 0) AS al, least(1.0, coalesce(n.error_rate, 0) * 3)::DOUBLE AS err, coalesce(n.span_count, 0) / (SELECT max(span_count) FROM nodes) AS vol, least(0.15, depth * 0.03)::DOUBLE AS deep,
  (CASE WHEN coalesce(ewma_std, 0) <= 0.001 THEN (CASE WHEN abs(coalesce(duration_mean_ms, 0) - coalesce(ewma_mean, duration_mean_ms, 0)) > 0.001 THEN 10.0 ELSE 0.0 END) ELSE round((duration_mean_ms - ewma_mean) / ewma_std, 3) END)::DOUBLE AS z
  FROM cands c LEFT JOIN nodes n ON n.id = c.service LEFT JOIN baselines b ON b.service = c.service LEFT JOIN (SELECT service, max(score) AS score FROM alerts GROUP BY 1) a ON a.service = c.service""",
    "scores": """SELECT service, round(greatest(0, least(1.0, we * err + wl * (CASE WHEN abs(z) > 2 THEN least(1.0, abs(z) / 10) ELSE 0 END) + wa * al + 0.10 * vol + deep)), 4)::DOUBLE AS confidence, round(er, 4) AS error_rate, z AS latency_z_score, depth::INT AS traversal_depth FROM parts CROSS JOIN weights""",
    "ranked": "SELECT *, row_number() OVER (ORDER BY confidence DESC, service)::INT AS rank FROM scores",
    "bottle": """SELECT src AS parent, dst AS child, round(a, 3)::DOUBLE AS absorption, round(err, 4)::DOUBLE AS child_error_rate, CASE WHEN a >= 0.75 AND err < 0.05 THEN 'SILENT_BOTTLENECK' WHEN a >= 0.6 THEN 'POSSIBLE_BOTTLENECK' END AS verdict
  FROM (SELECT src, dst, least(1.5, avg_duration_ms / p.duration_mean_ms) AS a, c.error_rate AS err FROM edges JOIN nodes p ON p.id = src JOIN nodes c ON c.id = dst WHERE p.duration_mean_ms > 0 AND avg_duration_ms > 0) WHERE a >= 0.6""",
    "torder": "SELECT service_name AS service, min(start_time) AS first_seen, (row_number() OVER (ORDER BY min(start_time), service_name) - 1)::INT AS idx FROM spans WHERE service_name IN (SELECT service FROM alerts) GROUP BY 1",
    "pos": "SELECT service_name AS service, duration_ms AS d, row_number() OVER (PARTITION BY service_name ORDER BY ingest_seq) AS pos, count(*) OVER (PARTITION BY service_name) AS n FROM spans WHERE service_name IN (SELECT service FROM ranked WHERE rank <= 8)",
    "corrs": "SELECT a.service AS a, b.service AS b, coalesce(covar_pop(a.d, b.d) / nullif(stddev_pop(a.d) * stddev_pop(b.d), 0), 0) AS c, max(least(a.n, b.n)) AS n FROM pos a JOIN pos b ON b.pos = a.pos + 5 AND a.service <> b.service WHERE b.pos <= least(a.n, b.n) GROUP BY 1, 2",
    "lead": "SELECT x.a, x.b, round(CASE WHEN x.n >= 7 AND x.c > y.c AND x.c > 0 THEN greatest(0, least(1, (x.c - y.c) / greatest(abs(x.c) + abs(y.c), 1e-9))) ELSE 0 END, 4)::DOUBLE AS strength FROM corrs x JOIN corrs y ON y.a = x.b AND y.b = x.a",
    "totals": "SELECT a AS service, CASE WHEN max(sum(strength)) OVER () > 0 THEN round(sum(strength) / max(sum(strength)) OVER (), 4) ELSE 0 END::DOUBLE AS score FROM lead GROUP BY 1",
    "pod": """SELECT 'pod-' || s_suppkey AS name, 'node-' || s_nationkey AS node_name, 'svc-' || (s_suppkey % 7 + 1) || '-' || (s_suppkey % 2) AS service_name, CASE WHEN s_suppkey % 11 = 0 THEN '0/1' ELSE '1/1' END AS ready,
  CASE WHEN s_suppkey % 13 = 0 THEN 'CrashLoopBackOff' ELSE 'Running' END AS status, s_suppkey % 10 AS restarts FROM supplier""",
    "alerted": "SELECT name, service_name, node_name, score FROM pod JOIN alerts ON service = service_name",
    "metric": "SELECT CASE WHEN event_id % 2 = 0 THEN 'cpu_' ELSE 'mem_' END || event_type AS metric, CASE WHEN event_id % 2 = 0 THEN 'cpu' ELSE 'mem' END AS kind, 'user' || (user_id % 100) || 'svc' AS service, epoch_us(ts)::DOUBLE AS ts, value::DOUBLE AS value FROM events",
    "peer": """SELECT service AS source, 'emits' AS relationship, CASE WHEN kind = 'cpu' THEN 'HIGH_CPU' ELSE 'HIGH_MEM' END AS target, round_even(least(1.0, log10(greatest(max(ratio), 1.0001)) / 3), 3)::DOUBLE AS relevance
  FROM (SELECT m.service, m.kind, m.metric, max(value) / any_value(mean) AS ratio FROM metric m JOIN (SELECT metric, avg(value) AS mean FROM metric GROUP BY 1 HAVING avg(value) > 0) USING (metric) GROUP BY 1, 2, 3 HAVING max(value) >= 2 * any_value(mean)) GROUP BY service, kind""",
    "hist": """SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY metric, service ORDER BY ts, value) AS i FROM metric WINDOW w AS (PARTITION BY metric, service)""",
    "own": """SELECT service AS source, 'emits' AS relationship, CASE WHEN kind = 'cpu' THEN 'HIGH_CPU' ELSE 'HIGH_MEM' END AS target, round_even(least(1.0, ln(1 + max(az)) / ln(16)), 3)::DOUBLE AS relevance
  FROM (SELECT service, kind, metric, abs((avg(value) FILTER (i > n - cur) - avg(value) FILTER (i <= n - cur)) / greatest(stddev_pop(value) FILTER (i <= n - cur), abs(avg(value) FILTER (i <= n - cur)) * 0.05, 1e-6)) AS az, avg(value) FILTER (i <= n - cur) AS b, stddev_pop(value) FILTER (i <= n - cur) AS sd
    FROM (SELECT *, least(greatest(3, floor(n * 0.3)), n - 3) AS cur FROM hist WHERE n >= 6) GROUP BY 1, 2, 3) WHERE NOT (b = 0 AND sd = 0) AND az >= 3 GROUP BY service, kind""",
    "lines": "SELECT source AS service, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents",
    "norm": r"SELECT service, trim(regexp_replace(regexp_replace(regexp_replace(line, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[\d.:Z+-]*', '', 'g'), '(?i)\b[0-9a-f]{8,}\b', '<id>', 'g'), '\b\d+\.\d+\.\d+\.\d+(:\d+)?\b', '<ip>', 'g')) AS pattern FROM lines WHERE trim(line) <> ''",
    "tmed": "SELECT quantile_cont(duration::DOUBLE, 0.5) AS med FROM spans",
    "tfacts": """SELECT src AS source, 'calls' AS relationship, dst AS target, 'trace call volume=' || call_count || ' errors=' || error_count AS citation_quote, round_even(least(1.0, call_count / 10), 3)::DOUBLE AS relevance FROM edges2
  UNION ALL SELECT svc, 'emits', 'HTTP_ERROR', 'trace error_spans=' || count(*), round_even(least(1.0, ln(1 + count(*)) / ln(101)), 3)::DOUBLE FROM (SELECT regexp_replace(service_name, '-\\d+$', '') AS svc, * FROM spans) WHERE has_error GROUP BY 1
  UNION ALL SELECT svc, 'blocks', 'HIGH_LATENCY', printf('trace avg_duration=%.0f median=%.0f (%.1fx)', a, med, a / greatest(med, 1)), round_even(least(1.0, log10(greatest(a / greatest(med, 1), 1.0001)) / 3), 3)::DOUBLE FROM (SELECT regexp_replace(service_name, '-\\d+$', '') AS svc, avg(duration) AS a FROM spans GROUP BY 1) CROSS JOIN tmed WHERE a >= greatest(100, 2 * med)""".replace("\\\\", "\\"),
    "edges2": r"""SELECT p.svc AS src, s.svc AS dst, count(*) AS call_count, count(*) FILTER (has_error) AS error_count FROM (SELECT regexp_replace(service_name, '-\d+$', '') AS svc, * FROM spans) s
  JOIN (SELECT span_id AS p_id, max_by(regexp_replace(service_name, '-\d+$', ''), ingest_seq) AS svc FROM spans GROUP BY 1) p ON parent_span = p_id WHERE p.svc <> s.svc GROUP BY 1, 2""",
}

CTE |= oracles_wider.CTE
CTE |= oracles_incidents.CTE


def _reads(text: str) -> set[str]:
    return set(re.findall(r"\b[a-z_0-9]+\b", text)) & CTE.keys()


def sql(statement: str) -> str:
    """The statement with the CTEs that it needs, directly or through others, each after those that it reads."""
    order: list[str] = []

    def take(name: str, above: tuple[str, ...] = ()) -> None:
        for other in sorted(_reads(CTE[name]) - {name}):
            if other not in above and other not in order:
                take(other, (*above, name))
        if name not in order:
            order.append(name)

    for name in sorted(_reads(statement)):
        take(name)
    if not order and not statement.startswith(", "):
        return statement
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + statement


_STATS = "span_count, error_count, error_rate, unknown_response_pct, duration_mean_ms, duration_p50_ms, duration_p95_ms, duration_p99_ms, duration_std_ms, duration_min_ms, duration_max_ms, operations"
STATEMENTS = {
    "i6_dedup_spans": "SELECT trace_id, span_id, service_name, start_time, duration, has_error, response, ingest_seq FROM spans",
    "i7_dedup_stats": "SELECT (SELECT count(*) FROM resp) AS original_count, (SELECT count(*) FROM spans) AS unique_count, (SELECT count(*) FROM resp) - (SELECT count(*) FROM spans) AS duplicates_removed",
    "i9_orphan_spans": "SELECT trace_id, span_id, parent_span FROM spans WHERE parent_span <> 'ROOT' AND parent_span NOT IN (SELECT span_id FROM spans)",
    "i10_service_stats": "SELECT * FROM stats",
    "i10_service_stats_by_month": """SELECT strftime(make_timestamp(start_time), '%Y-%m') AS month, service_name AS service, count(*) AS span_count, count(*) FILTER (has_error OR response = '500') AS error_count, round(quantile_disc(duration_ms, 0.95), 2) AS duration_p95_ms FROM spans GROUP BY 1, 2""",
    "i12_overall_stats": "SELECT count(*) AS total_spans, count(DISTINCT span_id) AS unique_spans, count(DISTINCT service_name) AS unique_services, count(DISTINCT trace_id) AS unique_traces, count(*) FILTER (has_error OR response = '500') AS error_spans, count(*) FILTER (response = 'Unknown') / count(*) * 100 AS unknown_response_pct, list_sort(list(DISTINCT service_name)) AS services FROM spans",
    "i13_ingest_summary": """, odd AS (SELECT CASE WHEN ingest_seq % 90 <> 2 THEN trace_id END AS trace_id, CASE WHEN ingest_seq % 50 = 0 THEN '' ELSE span_id END AS span_id, CASE WHEN ingest_seq % 70 = 1 THEN '' ELSE service_name END AS service_name,
  parent_span, operation_name, CASE WHEN has_error THEN 'ERROR' WHEN response = 'Unknown' THEN 'UNKNOWN' ELSE response END AS status, start_time, duration_ms, has_error, response, ingest_seq FROM resp),
once AS (SELECT * FROM odd QUALIFY row_number() OVER (PARTITION BY coalesce(trace_id, ''), span_id, CASE WHEN span_id = '' THEN (parent_span, service_name, operation_name, status, start_time, duration_ms) END ORDER BY ingest_seq) = 1)
SELECT (SELECT count(*) FROM odd) AS original_count, count(*) AS unique_count, (SELECT count(*) FROM odd) - count(*) AS duplicates_removed, count(*) FILTER (trace_id IS NOT NULL AND span_id <> '' AND service_name <> '') = count(*) AS is_valid,
  count(*) FILTER (trace_id IS NOT NULL AND span_id <> '' AND service_name <> '') / count(*) * 100 AS validation_rate, count(*) FILTER (parent_span <> 'ROOT' AND parent_span NOT IN (SELECT span_id FROM once WHERE span_id <> '')) AS orphan_count,
  count(DISTINCT nullif(service_name, '')) AS unique_services, count(DISTINCT trace_id) AS unique_traces, count(*) FILTER (has_error OR response = '500') AS error_spans, count(*) FILTER (response = 'Unknown') / count(*) * 100 AS unknown_response_pct FROM once""",
    "i19_discover_services": r"SELECT DISTINCT service FROM (SELECT regexp_replace(service_name, '-\d+$', '') AS service FROM spans UNION ALL SELECT regexp_replace(name, '-\d+$', '') FROM pod)",
    "g1_call_edges": "SELECT * FROM edges",
    "g2_service_nodes": f"SELECT id, {_STATS}, 'service' AS node_type FROM nodes",
    "g7_error_services": "SELECT DISTINCT service_name AS service FROM spans WHERE has_error",
    "g8_column_call_graph": "SELECT DISTINCT parent_span AS src, service_name AS dst FROM spans WHERE parent_span <> service_name",
    "d1_request_spans": "SELECT service_name AS service, count(*) FILTER (operation_name LIKE '/%') AS requests, count(*) AS spans FROM spans GROUP BY 1",
    "d2_ewma_baseline": "SELECT * FROM baselines",
    "d3_current_latency": "SELECT service, round(current_value, 4) AS current_value FROM current_lat",
    "d7_detect_anomalies": "SELECT service, severity, anomaly_type, score, z_score, round(current_value, 4) AS current_value, baseline_mean, baseline_std, printf('%s: %s detected. Current=%.1fms, Baseline=%.1fms ± %.1fms, Z-score=%.2f, Score=%.3f', service, anomaly_type, current_value, baseline_mean, baseline_std, z_score, score) AS details FROM alerts",
    "d8_forest_features": """SELECT s.service, CASE WHEN ewma_mean > 0 THEN duration_mean_ms / ewma_mean ELSE 1 END AS latency_ratio, error_rate, span_count / (SELECT sum(span_count) FROM stats) AS span_share, CASE WHEN duration_p50_ms > 0 THEN duration_p95_ms / duration_p50_ms ELSE 1 END AS tail_ratio, unknown_response_pct / 100 AS unknown_share FROM stats s LEFT JOIN baselines USING (service)""",
    "d9_forest_alerts": """, features AS (SELECT s.service, [CASE WHEN ewma_mean > 0 THEN duration_mean_ms / ewma_mean ELSE 1 END, error_rate, span_count / (SELECT sum(span_count) FROM stats), CASE WHEN duration_p50_ms > 0 THEN duration_p95_ms / duration_p50_ms ELSE 1 END, unknown_response_pct / 100]::DOUBLE[] AS x FROM stats s LEFT JOIN baselines USING (service)),
dealt AS (SELECT tree, service, x, row_number() OVER (PARTITION BY tree ORDER BY md5(concat('42:', tree, ':', service)), service) <= 256 AS own FROM features, range(100) t(tree)),
size AS (SELECT least(256, count(*)) AS n FROM features),
grown AS (SELECT tree, 1::BIGINT AS node, 0 AS depth, service, x, own, false AS leaf, 0::BIGINT AS left_here FROM dealt UNION ALL
  SELECT tree, CASE WHEN stop THEN node WHEN x[f] < lo[f] + cut * (hi[f] - lo[f]) THEN 2 * node ELSE 2 * node + 1 END, CASE WHEN stop THEN depth ELSE depth + 1 END, service, x, own, stop, n
  FROM (SELECT *, wide[1 + floor(pick * len(wide))::INT] AS f, n <= 1 OR depth >= ceil(log2((SELECT greatest(2, n) FROM size))) OR len(wide) = 0 AS stop
    FROM (SELECT *, list_filter([1, 2, 3, 4, 5], lambda i: hi[i] > lo[i]) AS wide, ('0x' || left(md5(concat('42:', tree, ':', node, ':feature')), 8))::BIGINT / 4294967296.0::DOUBLE AS pick, ('0x' || left(md5(concat('42:', tree, ':', node, ':cut')), 8))::BIGINT / 4294967296.0::DOUBLE AS cut
      FROM (SELECT *, count(*) FILTER (own) OVER w AS n, [min(x[1]) FILTER (own) OVER w, min(x[2]) FILTER (own) OVER w, min(x[3]) FILTER (own) OVER w, min(x[4]) FILTER (own) OVER w, min(x[5]) FILTER (own) OVER w] AS lo,
        [max(x[1]) FILTER (own) OVER w, max(x[2]) FILTER (own) OVER w, max(x[3]) FILTER (own) OVER w, max(x[4]) FILTER (own) OVER w, max(x[5]) FILTER (own) OVER w] AS hi FROM grown WHERE NOT leaf WINDOW w AS (PARTITION BY tree, node))))),
depths AS (SELECT n, CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 * (ln(n - 1) + 0.5772156649) - 2 * (n - 1) / n END::DOUBLE AS more FROM range(257) t(n)),
iso AS (SELECT service, round(pow(2.0, -avg(depth + more) / greatest((SELECT more FROM depths JOIN size USING (n)), 1e-9)), 12) AS iso FROM grown JOIN depths ON left_here = n WHERE leaf GROUP BY 1),
ends AS (SELECT min(iso) AS lo, max(iso) AS hi, quantile_cont(iso, 0.9) AS bar FROM iso),
found AS (SELECT service, round((iso - lo) / greatest(hi - lo, 1e-9), 3)::DOUBLE AS score, error_rate, unknown_response_pct, duration_mean_ms AS cv, ewma_mean AS bm, ewma_std AS bs, coalesce(CASE WHEN ewma_std > 0.001 THEN round((duration_mean_ms - ewma_mean) / ewma_std, 3) END, 0)::DOUBLE AS z
  FROM iso CROSS JOIN ends JOIN stats USING (service) JOIN baselines USING (service) WHERE iso >= bar AND hi > lo),
told AS (SELECT *, coalesce(nullif(concat_ws('+', CASE WHEN abs(z) >= 3 THEN 'latency_spike' END, CASE WHEN error_rate >= 0.05 THEN 'error_rate_high' END, CASE WHEN unknown_response_pct > 80 THEN 'unknown_response_gap' END), ''), 'if_multivariate') AS kind FROM found WHERE score >= 0.3 OR error_rate >= 0.05)
SELECT service, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, kind AS anomaly_type, score, z AS z_score, round(cv, 4) AS current_value, bm AS baseline_mean, bs AS baseline_std,
  printf('%s: %s detected. Current=%.1fms, Baseline=%.1fms ± %.1fms, Z-score=%.2f, Score=%.3f', service, kind, cv, bm, bs, z, score) AS details FROM told""",
    "d11_primary_service": "SELECT * FROM primary_s",
    "d12_apply_labels": """SELECT service, label, CASE WHEN pos <= 8 THEN round(greatest(0.01, least(1.0, score * (CASE label WHEN 'ROOT_CAUSE' THEN 1.2 WHEN 'SYMPTOM' THEN 0.8 WHEN 'FALSE_POSITIVE' THEN 0.3 ELSE 1.0 END))), 3)::DOUBLE ELSE score END AS score
  FROM (SELECT service, score, row_number() OVER (ORDER BY score DESC, service) AS pos, CASE WHEN row_number() OVER (ORDER BY score DESC, service) <= 8 THEN (CASE WHEN service LIKE '%-1' THEN 'SYMPTOM' ELSE 'ROOT_CAUSE' END) END AS label FROM alerts)""",
    "d13_column_means": """SELECT * FROM (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS column, round(unnest([avg(l_orderkey), avg(l_partkey), avg(l_suppkey), avg(l_linenumber), avg(l_quantity), avg(l_extendedprice), avg(l_discount), avg(l_tax)]), 4) AS mean FROM lineitem) WHERE mean > 0.01""",
    "d16_confirm_anomaly": "SELECT coalesce(max(score) > 0.5, false) AS confirmed, CASE WHEN max(score) > 0.5 THEN min_by(service, (-score, service)) END AS service, list(service ORDER BY score DESC, service) AS top FROM (SELECT * FROM alerts ORDER BY score DESC, service LIMIT 5)",
    "d17_alert_context": "SELECT src, dst, call_count, error_rate FROM edges WHERE src IN (SELECT service FROM alerts) OR dst IN (SELECT service FROM alerts) ORDER BY call_count DESC, src, dst LIMIT 30",
    "r1_upstream_paths": "SELECT path_no::INT AS path_no, array_to_string(path, '>') AS path FROM paths",
    "r2_candidates": "SELECT service, depth::INT AS depth FROM cands",
    "r3_adaptive_weights": "SELECT we AS w_error, wl AS w_latency, wa AS w_alerts, 0.10::DOUBLE AS w_volume FROM weights",
    "r4_score_candidates": "SELECT * FROM scores",
    "r7_silent_bottlenecks": "SELECT * FROM bottle",
    "r8_boost_silent": "SELECT service, CASE WHEN service IN (SELECT child FROM bottle WHERE verdict = 'SILENT_BOTTLENECK') THEN round(least(1.0, confidence * 1.15), 4)::DOUBLE ELSE confidence END AS confidence FROM scores",
    "r9_rank": "SELECT service, confidence, rank FROM ranked",
    "r10_shortest_path": """, fw AS (SELECT [(SELECT service FROM ranked WHERE rank = 1)] AS path, (SELECT service FROM ranked WHERE rank = 1) AS last UNION ALL SELECT list_append(path, edges.dst), edges.dst FROM fw JOIN edges ON edges.src = last WHERE NOT list_contains(path, edges.dst) AND last <> 'svc-5-1' AND len(path) <= 7)
SELECT array_to_string(path, '>') AS path FROM fw WHERE last = 'svc-5-1' ORDER BY len(path), path LIMIT 1""",
    "c1_temporal_order": "SELECT * FROM torder",
    "c2_lagged_strength": "SELECT * FROM lead",
    "c3_causal_totals": "SELECT * FROM totals",
    "c4_fuse_rank": """SELECT service, combined, row_number() OVER (ORDER BY combined DESC, rank)::INT AS rank FROM (SELECT r.service, rank, round(0.5 * confidence + 0.25 * (CASE WHEN idx IS NOT NULL THEN 1 - idx / (SELECT greatest(count(*), 1) FROM torder) ELSE 0 END) + 0.25 * coalesce(t.score, 0), 6)::DOUBLE AS combined FROM ranked r LEFT JOIN torder USING (service) LEFT JOIN totals t USING (service))""",
    "n5_infra_edges": """SELECT service_name AS src, name AS dst, 'DEPLOYED_AS' AS edge_type, NULL::VARCHAR AS shared_node FROM pod WHERE service_name IN (SELECT id FROM nodes) UNION ALL SELECT name, node_name, 'RUNS_ON', NULL FROM pod WHERE node_name IN (SELECT 'node-' || n_nationkey FROM nation)
  UNION ALL SELECT a.name, b.name, 'COLOCATED', a.node_name FROM alerted a JOIN alerted b ON a.node_name = b.node_name AND a.name <> b.name""",
    "n8_noisy_neighbors": "SELECT a.name AS pod_a, b.name AS pod_b, a.node_name AS shared_node, CASE WHEN a.score >= b.score THEN a.service_name ELSE b.service_name END AS alerted_service FROM alerted a JOIN alerted b ON a.node_name = b.node_name AND a.name < b.name",
    "t3_trace_facts": "SELECT * FROM tfacts",
    "t6_pod_facts": """SELECT 'pod' AS source, 'emits' AS relationship, 'POD_UNHEALTHY' AS target, 'kubectl pods ' || (SELECT string_agg(w, ', ' ORDER BY w) FROM (SELECT DISTINCT w FROM (SELECT 'status=' || status AS w FROM pod WHERE status <> 'Running' UNION ALL SELECT 'ready=' || ready FROM pod WHERE ready = '0/1' UNION ALL SELECT 'restarts=' || restarts FROM pod WHERE restarts >= 8 OR (restarts >= 3 AND (status <> 'Running' OR ready = '0/1'))))) AS citation_quote,
  round_even(least(1.0, ln(1 + count(*)) / ln(11)), 3)::DOUBLE AS relevance FROM pod WHERE status <> 'Running' OR ready = '0/1' OR restarts >= 8 HAVING count(*) > 0""",
    "t9_peer_outliers": "SELECT * FROM peerq",
    "t10_own_outliers": "SELECT * FROM ownq",
    "t11_metric_facts": "SELECT * FROM (SELECT * FROM peerq UNION ALL SELECT * FROM ownq) QUALIFY row_number() OVER (PARTITION BY source, relationship, target ORDER BY relevance DESC, citation_quote) = 1",
    "t18_decide_incident": """, shaped AS (SELECT source, target, relevance FROM tfacts WHERE relationship <> 'calls' UNION ALL SELECT source, target, relevance FROM (SELECT source, target, max(relevance) AS relevance FROM (SELECT * FROM peer UNION ALL SELECT * FROM own) GROUP BY 1, 2))
SELECT count(*) FILTER (relevance >= 0.3) > 0 AND count(DISTINCT source) FILTER (relevance >= 0.3) / greatest(count(DISTINCT source), 1) <= 0.3 AS anomaly, round(count(DISTINCT source) FILTER (relevance >= 0.3) / greatest(count(DISTINCT source), 1), 4) AS concentration FROM shaped""",
    "l1_error_lines": "SELECT service_name AS service, printf('[%s] op=%s response=%s duration=%.0fms trace=%s', service_name, operation_name, response, duration_ms, left(trace_id, 8)) AS line FROM (SELECT * FROM spans WHERE has_error AND service_name IN (SELECT service FROM ranked WHERE rank <= 5) ORDER BY ingest_seq LIMIT 60)",
    "l3_top_patterns": """SELECT service, pattern, count, round(count / total, 4) AS share, rank FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY count DESC, pattern)::INT AS rank, sum(count) OVER (PARTITION BY service) AS total FROM (SELECT service, pattern, count(*) AS count FROM norm GROUP BY 1, 2)) WHERE rank <= 5""",
    "l4_fault_type": """SELECT service, (['Misconfiguration', 'ImagePullFailure', 'ResourceExhaustion', 'CrashLoopFailure', 'NetworkFailure', 'CertificateFailure', 'DatabaseFailure', 'TimeoutFailure'])[min(k)] AS fault_type, (['Application', 'Infrastructure', 'Application', 'Application', 'Network', 'Security', 'DataLayer', 'Application'])[min(k)] AS fault_layer FROM (
  SELECT service, CASE WHEN regexp_matches(l, 'containerport|targetport|port.*mismatch|connection refused.*port') THEN 1 WHEN regexp_matches(l, 'imagepullbackoff|errimagepull|no such image|image.*not found') THEN 2 WHEN regexp_matches(l, 'oomkilled|out of memory|memory limit') THEN 3 WHEN regexp_matches(l, 'crashloopbackoff|exit code [1-9]') THEN 4
    WHEN regexp_matches(l, 'connection refused|connection timed out|dial tcp.*refused') THEN 5 WHEN regexp_matches(l, 'certificate.*expired|x509|tls.*error') THEN 6 WHEN regexp_matches(l, 'database.*connection|sql.*error|pg.*error|mongo.*error') THEN 7 WHEN regexp_matches(l, 'timeout|deadline exceeded|context deadline') THEN 8 END AS k FROM (SELECT service, lower(line) AS l FROM flines)) WHERE k IS NOT NULL GROUP BY 1""",
    "l8_redact": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'sk-[A-Za-z0-9]{16,}', 'sk-[REDACTED]', 'g'), '(?i)(api[_-]?key\s*[:=]\s*)([^\s,''\x22]+)', '\1[REDACTED]', 'g'), '(?i)(password\s*[:=]\s*)([^\s,''\x22]+)', '\1[REDACTED]', 'g')) AS sha FROM documents",
    "l9_clip_middle": "SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE left(t, 100) || chr(10) || '...[TRUNCATED ' || (length(t) - 200) || ' chars]...' || chr(10) || right(t, 100) END AS clipped FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "m1_signature": "SELECT service, md5('service:' || service || '|anomaly:' || anomaly_type) AS signature, md5('service:' || service || '|anomaly:' || anomaly_type || '|root_cause:' || service) AS signature_full FROM alerts",
    "m3_find_similar": """, inc AS (SELECT 'o' || o_orderkey AS id, o_orderdate AS ts, 'svc-' || (o_custkey % 50) AS service, 'svc-' || (o_custkey % 7) AS root_cause, o_orderkey AS k FROM orders), asked AS (SELECT id AS case_id, service, root_cause FROM inc WHERE k % 50 = 0)
SELECT case_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, id)::INT AS rank FROM (SELECT DISTINCT case_id, inc.id, inc.ts FROM asked JOIN inc ON inc.service = asked.service OR inc.root_cause = asked.root_cause)) WHERE rank <= 5""",
    "m5_false_positives": """SELECT md5('service:svc-' || (o_custkey % 50) || '|anomaly:' || o_orderpriority) AS signature, 'svc-' || (o_custkey % 7) AS root_cause, count(*) AS count FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2 ORDER BY count DESC, signature, root_cause LIMIT 10""",
    "m6_incident_count": "SELECT count(*) AS count FROM orders",
    "a4_health": """SELECT service, alerts, violations, unhealthy, round(0.40 * alerts + 0.35 * violations + 0.25 * unhealthy, 4)::DOUBLE AS score FROM (SELECT s.service, (SELECT count(*) FROM alerts a WHERE a.service = s.service) AS alerts, error_count AS violations, (SELECT count(*) FROM pod WHERE service_name = s.service AND status <> 'Running') AS unhealthy FROM stats s)""",
    "e6_run_rollup": """SELECT event_type AS task_type, count(*) FILTER (event_id % 3 = 0) AS passed, count(*) FILTER (event_id % 3 = 1) AS failed, count(*) FILTER (event_id % 3 = 2) AS skipped, round(sum(value), 3)::DOUBLE AS seconds FROM events GROUP BY ROLLUP (event_type)""",
    "e5_token_usage": "SELECT role AS caller, 'conversation' AS model, count(*) AS calls, sum(length(text))::BIGINT AS in_tokens, sum(turn)::BIGINT AS out_tokens, round(sum(turn) / 10.0, 3)::DOUBLE AS seconds FROM conversations GROUP BY 1",
}
STATEMENTS |= oracles_wider.STATEMENTS
STATEMENTS |= oracles_incidents.STATEMENTS


def build() -> dict[str, str]:
    # a statement that opens with a comma goes on with CTEs of its own
    return {name: sql(s).replace("\n, ", ",\n", 1).replace("WITH RECURSIVE ,", "WITH RECURSIVE", 1) for name, s in STATEMENTS.items()}
