"""DuckDB SQL of the queries by month: CTEs and statements that oracles.py takes in."""

from __future__ import annotations

from .oracles_wider import _EMIT, _KNOWN, _token, role


def ranks_by(name: str, edges: str, restart: str | None = None) -> dict[str, str]:
    """CTEs of 40 rounds of PageRank over the edges (month, src, dst, w) of each month: `name`, with month, id and s. restart: a query of (month, id); a month without any jumps everywhere."""
    marked = f"(SELECT DISTINCT i.month, i.id FROM {name}_id i JOIN ({restart}) r ON r.month = i.month AND r.id = i.id)" if restart else f"(SELECT month, id FROM {name}_id)"
    return {
        f"{name}_sh": f"SELECT month, src, dst, w / sum(w) OVER (PARTITION BY month, src) AS share FROM {edges}",
        f"{name}_id": f"SELECT month, src AS id FROM {name}_sh UNION SELECT month, dst FROM {name}_sh",
        f"{name}_j": f"""SELECT i.month, i.id, CASE WHEN m.n IS NULL THEN 1.0::DOUBLE / c.n WHEN r.id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / m.n END AS j, 1.0::DOUBLE / c.n AS s
  FROM {name}_id i JOIN (SELECT month, count(*) AS n FROM {name}_id GROUP BY 1) c ON c.month = i.month LEFT JOIN (SELECT month, count(*) AS n FROM {marked} GROUP BY 1) m ON m.month = i.month LEFT JOIN {marked} r ON r.month = i.month AND r.id = i.id""",
        f"{name}_m": f"""SELECT i.month, i.id AS a, k.id AS b, 0.85 * (coalesce(x.share, 0) + CASE WHEN o.src IS NOT NULL THEN 0 ELSE k.j END) + 0.15 * k.j AS p
  FROM {name}_id i JOIN {name}_j k ON k.month = i.month LEFT JOIN {name}_sh x ON x.month = i.month AND x.src = i.id AND x.dst = k.id LEFT JOIN (SELECT DISTINCT month, src FROM {name}_sh) o ON o.month = i.month AND o.src = i.id""",
        f"{name}_r": f"SELECT month, id, s, 0 AS k FROM {name}_j UNION ALL SELECT m.month, m.b, sum(r.s * m.p), r.k + 1 FROM {name}_r r JOIN {name}_m m ON m.month = r.month AND r.id = m.a WHERE r.k < 40 GROUP BY m.month, m.b, r.k",
        name: f"SELECT month, id, s FROM {name}_r WHERE k = 40",
    }


CTE = {
    "mspans": "SELECT *, strftime(make_timestamp(start_time), '%Y-%m') AS month, regexp_replace(service_name, '-\\d+$', '') AS svc FROM spans",
    "mstats": """SELECT month, service_name AS service, count(*) AS span_count, round(avg(duration_ms), 2) AS mean, round(count(*) FILTER (has_error OR response = '500') / count(*), 4) AS error_rate,
  round(count(*) FILTER (response = 'Unknown') / count(*) * 100, 1) AS unknown_response_pct FROM mspans GROUP BY 1, 2""",
    "mseries": """SELECT month, service_name AS service, duration_ms AS d, row_number() OVER (PARTITION BY month, service_name ORDER BY start_time DESC, ingest_seq DESC) AS back
  FROM (SELECT *, count(*) FILTER (operation_name LIKE '/%') OVER (PARTITION BY month, service_name) AS n_req FROM mspans) WHERE n_req < 2 OR operation_name LIKE '/%'""",
    "mfold": """SELECT month, service, list_reduce(list_transform(x, lambda d: {'m': d, 'v': 0.0::DOUBLE}), lambda a, b: {'m': 0.3 * b.m + 0.7 * a.m, 'v': 0.3 * (b.m - (0.3 * b.m + 0.7 * a.m)) * (b.m - (0.3 * b.m + 0.7 * a.m)) + 0.7 * a.v}) AS f
  FROM (SELECT month, service, list(d ORDER BY back DESC) AS x FROM mseries WHERE back <= 100 GROUP BY 1, 2)""",
    "mbase": "SELECT month, service, round(f.m, 3) AS bm, round(sqrt(f.v), 3) AS bs FROM mfold",
    "mnow": "SELECT month, service, avg(d) AS cv FROM mseries WHERE back <= 10 GROUP BY 1, 2",
    "mscored": """SELECT *, round(least(1.0, 0.40 * (CASE WHEN abs(z) > 2 THEN least(1.0, abs(z) / 10) ELSE 0 END) + 0.45 * least(1.0, error_rate * 2) + 0.15 * (CASE WHEN unknown_response_pct > 80 THEN 0.2 ELSE 0 END)), 3)::DOUBLE AS score
  FROM (SELECT s.month, s.service, error_rate, unknown_response_pct, (CASE WHEN bs < 0.001 THEN (CASE WHEN abs(coalesce(cv, mean) - bm) > 0.001 THEN 10.0 ELSE 0.0 END) ELSE round((coalesce(cv, mean) - bm) / bs, 3) END)::DOUBLE AS z
    FROM mstats s JOIN mbase b ON b.month = s.month AND b.service = s.service LEFT JOIN mnow c ON c.month = s.month AND c.service = s.service)""",
    "malerts": "SELECT month, service, score, abs(z) >= 3 AS slow, error_rate >= 0.05 AS bad FROM mscored WHERE abs(z) >= 3 OR error_rate >= 0.05 OR score > 0.3",
    "medges": """SELECT c.month, p.src, c.service_name AS dst, count(*) AS call_count FROM mspans c JOIN (SELECT month, span_id AS p_id, max_by(service_name, ingest_seq) AS src FROM mspans GROUP BY 1, 2) p
  ON p.month = c.month AND c.parent_span = p.p_id WHERE p.src <> c.service_name GROUP BY 1, 2, 3""",
    "mwalk": """SELECT DISTINCT month, ['svc-5-1'] AS path, 'svc-5-1' AS last FROM medges WHERE 'svc-5-1' IN (src, dst)
  UNION ALL SELECT w.month, list_append(path, src), src FROM mwalk w JOIN medges e ON e.month = w.month AND e.dst = w.last WHERE NOT list_contains(path, src) AND len(path) <= 5""",
    "mended": "SELECT month, path FROM mwalk w WHERE len(path) > 1 AND (len(path) = 6 OR NOT EXISTS (SELECT 1 FROM medges e WHERE e.month = w.month AND e.dst = w.last AND NOT list_contains(w.path, e.src)))",
    "mpaths": "SELECT month, row_number() OVER (PARTITION BY month ORDER BY len(path), array_to_string(path, chr(1))) AS path_no, path FROM mended QUALIFY path_no <= 200",
    "mcands": """SELECT month, service, min(depth) AS depth FROM (SELECT month, service, min_by(depth, path_no) AS depth FROM (SELECT month, path_no, unnest(path) AS service, generate_subscripts(path, 1) - 1 AS depth FROM mpaths) GROUP BY 1, 2
  UNION ALL SELECT DISTINCT month, 'svc-5-1', 0 FROM medges) GROUP BY 1, 2""",
    "mweights": """SELECT m.month, CASE WHEN e AND NOT l THEN 0.50 WHEN l AND NOT e THEN 0.15 ELSE 0.35 END::DOUBLE AS we, CASE WHEN e AND NOT l THEN 0.15 WHEN l AND NOT e THEN 0.50 ELSE 0.35 END::DOUBLE AS wl, CASE WHEN e <> l THEN 0.20 ELSE 0.15 END::DOUBLE AS wa
  FROM (SELECT s.month, coalesce(bool_or(bad), false) AS e, coalesce(bool_or(slow), false) AS l FROM (SELECT DISTINCT month FROM mstats) s LEFT JOIN malerts a ON a.month = s.month GROUP BY 1) m""",
    "mparts": """SELECT c.month, c.service, depth, coalesce(n.error_rate, 0) AS er, coalesce(a.score, 0) AS al, least(1.0, coalesce(n.error_rate, 0) * 3)::DOUBLE AS err, coalesce(n.span_count, 0) / t.top AS vol, least(0.15, depth * 0.03)::DOUBLE AS deep,
  (CASE WHEN coalesce(bs, 0) <= 0.001 THEN (CASE WHEN abs(coalesce(mean, 0) - coalesce(bm, mean, 0)) > 0.001 THEN 10.0 ELSE 0.0 END) ELSE round((mean - bm) / bs, 3) END)::DOUBLE AS z
  FROM mcands c JOIN (SELECT month, max(span_count) AS top FROM mstats GROUP BY 1) t ON t.month = c.month LEFT JOIN mstats n ON n.month = c.month AND n.service = c.service LEFT JOIN mbase b ON b.month = c.month AND b.service = c.service LEFT JOIN malerts a ON a.month = c.month AND a.service = c.service""",
    "mscores": """SELECT p.month, service, round(greatest(0, least(1.0, we * err + wl * (CASE WHEN abs(z) > 2 THEN least(1.0, abs(z) / 10) ELSE 0 END) + wa * al + 0.10 * vol + deep)), 4)::DOUBLE AS confidence, round(er, 4) AS error_rate, z AS latency_z_score, depth::INT AS traversal_depth FROM mparts p JOIN mweights w ON w.month = p.month""",
    "mranked": "SELECT *, row_number() OVER (PARTITION BY month ORDER BY confidence DESC, service)::INT AS rank FROM mscores",
    "mways": """SELECT month, [service] AS path, service AS last FROM mranked WHERE rank = 1 UNION ALL SELECT w.month, list_append(path, e.dst), e.dst FROM mways w JOIN medges e ON e.month = w.month AND e.src = w.last WHERE NOT list_contains(path, e.dst) AND last <> 'svc-5-1' AND len(path) <= 7""",
    "mchain": "SELECT month, path FROM mways WHERE last = 'svc-5-1' QUALIFY row_number() OVER (PARTITION BY month ORDER BY len(path), path) = 1",
    "mtree": "SELECT month, service FROM mranked WHERE rank <= 5 UNION SELECT month, 'svc-5-1' FROM mranked UNION SELECT month, unnest(path) FROM mchain",
    "mtorder": "SELECT s.month, service_name AS service, row_number() OVER (PARTITION BY s.month ORDER BY min(start_time), service_name) - 1 AS idx FROM mspans s JOIN malerts a ON a.month = s.month AND a.service = s.service_name GROUP BY 1, 2",
    "mpos": """SELECT s.month, service_name AS service, duration_ms AS d, row_number() OVER w AS pos, count(*) OVER (PARTITION BY s.month, service_name) AS n FROM mspans s JOIN mranked r ON r.month = s.month AND r.service = s.service_name
  WINDOW w AS (PARTITION BY s.month, service_name ORDER BY ingest_seq)""",
    "mcorrs": """SELECT a.month, a.service AS a, b.service AS b, coalesce(covar_pop(a.d, b.d) / nullif(stddev_pop(a.d) * stddev_pop(b.d), 0), 0) AS c, max(least(a.n, b.n)) AS n FROM mpos a JOIN mpos b ON b.month = a.month AND b.pos = a.pos + 5 AND a.service <> b.service
  WHERE b.pos <= least(a.n, b.n) GROUP BY 1, 2, 3""",
    "mlead": """SELECT x.month, x.a, x.b, round(CASE WHEN x.n >= 7 AND x.c > y.c AND x.c > 0 THEN greatest(0, least(1, (x.c - y.c) / greatest(abs(x.c) + abs(y.c), 1e-9))) ELSE 0 END, 4)::DOUBLE AS strength FROM mcorrs x JOIN mcorrs y ON y.month = x.month AND y.a = x.b AND y.b = x.a""",
    "mtotals": "SELECT month, a AS service, CASE WHEN max(sum(strength)) OVER (PARTITION BY month) > 0 THEN round(sum(strength) / max(sum(strength)) OVER (PARTITION BY month), 4) ELSE 0 END::DOUBLE AS score FROM mlead GROUP BY 1, 2",
    "mwedges": "SELECT month, src, dst, 1.0::DOUBLE AS w FROM medges",
    **ranks_by("mrank", "mwedges", "SELECT month, service AS id FROM malerts"),
    "mcalls": """SELECT s.month, p.svc AS src, s.svc AS dst, count(*) AS n FROM mspans s JOIN (SELECT month, span_id AS p_id, max_by(svc, ingest_seq) AS svc FROM mspans GROUP BY 1, 2) p ON p.month = s.month AND s.parent_span = p.p_id WHERE p.svc <> s.svc GROUP BY 1, 2, 3""",
    "mraw": """SELECT month, src AS source, 'calls' AS relationship, dst AS target, round_even(least(1.0, n / 10), 3)::DOUBLE AS relevance FROM mcalls
  UNION ALL SELECT month, svc, 'emits', 'HTTP_ERROR', round_even(least(1.0, ln(1 + count(*)) / ln(101)), 3)::DOUBLE FROM mspans WHERE has_error GROUP BY 1, 2
  UNION ALL SELECT a.month, svc, 'blocks', 'HIGH_LATENCY', round_even(least(1.0, log10(greatest(a / greatest(med, 1), 1.0001)) / 3), 3)::DOUBLE FROM (SELECT month, svc, avg(duration) AS a FROM mspans GROUP BY 1, 2) a JOIN (SELECT month, quantile_cont(duration::DOUBLE, 0.5) AS med FROM mspans GROUP BY 1) m ON m.month = a.month WHERE a >= greatest(100, 2 * med)""",
    "mfacts": f"SELECT *, CASE WHEN {_token('source')} THEN 'UNKNOWN' ELSE {role('source')} END AS source_type FROM (SELECT * FROM mraw UNION ALL SELECT DISTINCT month, 'SYSTEM', 'has_task', 'analysis', 0.0 FROM mraw)",
    "mfedges": f"""SELECT month, src, dst, arg_max(w, seq)::DOUBLE AS w FROM (SELECT month, CASE WHEN relationship IN ('calls', 'emits', 'blocks') THEN target ELSE source END AS src, CASE WHEN relationship IN ('calls', 'emits', 'blocks') THEN source ELSE target END AS dst,
  CASE WHEN relationship = 'emits' THEN {_EMIT} WHEN relationship = 'blocks' THEN 1.5 ELSE 1.0 END AS w, concat_ws('|', source, relationship, target) AS seq FROM mfacts) GROUP BY 1, 2, 3""",
    **ranks_by("mfrank", "mfedges"),
    "mbad": f"SELECT DISTINCT month, source AS name FROM mfacts WHERE relationship IN ('emits', 'blocks') AND NOT {_token('source')}",
    "mhalf": "SELECT DISTINCT f.month, f.source FROM mfacts f JOIN (SELECT DISTINCT month, source FROM mfacts WHERE relationship IN ('emits', 'blocks')) b ON b.month = f.month AND b.source = f.target WHERE f.relationship = 'calls'",
    "mheat": f"""SELECT f.month, f.source, source_type AS role, sum((CASE WHEN relationship = 'emits' THEN {_EMIT} ELSE 4.0 END) * greatest(CASE WHEN relevance = 0 THEN 1.0 ELSE relevance END, 0.1)
    * CASE source_type WHEN 'GATEWAY' THEN 0.5 WHEN 'DATASTORE' THEN 0.4 WHEN 'BROKER' THEN 0.3 WHEN 'ASYNC_CONSUMER' THEN 0.25 WHEN 'OBSERVABILITY' THEN 0.1 WHEN 'LOADGEN' THEN 0.1 ELSE 1.0 END) * CASE WHEN any_value(h.source) IS NULL THEN 1.0 ELSE 0.5 END AS score
  FROM mfacts f LEFT JOIN mhalf h ON h.month = f.month AND h.source = f.source WHERE relationship IN ('emits', 'blocks') GROUP BY 1, 2, 3""",
    "mnear": "SELECT month, name FROM mbad UNION SELECT e.month, dst FROM mfedges e JOIN mbad b ON b.month = e.month AND b.name = src UNION SELECT e.month, src FROM mfedges e JOIN mbad b ON b.month = e.month AND b.name = dst",
    "msuspects": f"""SELECT n.month, name AS service, round(coalesce(score, 0), 9) AS score, round(coalesce(s, 0), 9) AS pagerank, coalesce(role, 'UNKNOWN') AS role FROM mnear n LEFT JOIN mheat h ON h.month = n.month AND h.source = n.name LEFT JOIN mfrank r ON r.month = n.month AND r.id = n.name
  WHERE NOT {_token('name')} AND name NOT IN {_KNOWN}""",
}

STATEMENTS = {
    "g5_pagerank_by_month": "SELECT month, id, round(s, 6) AS score FROM mrank",
    "d11_primary_by_month": """SELECT s.month, coalesce(min_by(a.service, (-a.score, a.service)), min_by(s.service, (-s.error_rate, s.service)) FILTER (s.error_rate > 0), 'unknown') AS service FROM mstats s LEFT JOIN malerts a ON a.month = s.month GROUP BY 1""",
    "r4_scores_by_month": "SELECT * FROM mranked",
    "r10_paths_by_month": "SELECT month, array_to_string(path, '>') AS path FROM mchain",
    "r11_fault_tree_by_month": """SELECT DISTINCT e.month, src, dst FROM medges e JOIN mtree a ON a.month = e.month AND a.service = e.src JOIN mtree b ON b.month = e.month AND b.service = e.dst
UNION SELECT month, path[i], path[i + 1] FROM (SELECT month, path, unnest(range(1, len(path))) AS i FROM mchain) UNION ALL SELECT month, service, '' FROM mtree""",
    "c4_fuse_rank_by_month": """SELECT month, service, combined, row_number() OVER (PARTITION BY month ORDER BY combined DESC, rank)::INT AS rank FROM (SELECT r.month, r.service, rank, round(0.5 * confidence + 0.25 * (CASE WHEN idx IS NOT NULL THEN 1 - idx / o.n ELSE 0 END) + 0.25 * coalesce(t.score, 0), 6)::DOUBLE AS combined
  FROM mranked r LEFT JOIN mtorder i ON i.month = r.month AND i.service = r.service LEFT JOIN (SELECT month, count(*) AS n FROM mtorder GROUP BY 1) o ON o.month = r.month LEFT JOIN mtotals t ON t.month = r.month AND t.service = r.service)""",
    "s1_suspects_by_month": "SELECT month, service, round(score, 6) AS score, round(pagerank, 6) AS pagerank, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, pagerank DESC, service)::INT AS rank FROM msuspects) WHERE rank <= 8",
}
