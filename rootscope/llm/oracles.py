"""DuckDB SQL for the queries that SQL can express."""

_OP1 = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (
  SELECT doc_id, i - 1 AS place, trim(p[i], E' \t\n\x0b\x0c\r') AS line
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
long AS (SELECT *, length(line) AS n FROM lines WHERE length(line) >= 1),
firsts AS (SELECT line, n, min((doc_id, place)) AS first FROM long GROUP BY line, n),
-- within one edit: what the two lines share at their start and at their end leaves at most one character of either
near AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b ON a.first < b.first AND b.n BETWEEN a.n - 1 AND a.n + 1 AND a.n >= 2 AND b.n >= 2
    AND (left(a.line, least(a.n, b.n) // 2) = left(b.line, least(a.n, b.n) // 2)
      OR right(a.line, least(a.n, b.n) - least(a.n, b.n) // 2) = right(b.line, least(a.n, b.n) - least(a.n, b.n) // 2))
  WHERE list_bool_or(list_transform(range(0, greatest(a.n, b.n)), lambda i:
    left(a.line, i) = left(b.line, i) AND substr(a.line, i + 1 + (a.n >= b.n)::int) = substr(b.line, i + 1 + (b.n >= a.n)::int)))),
gone AS (
  SELECT DISTINCT l.doc_id, l.place FROM long l JOIN firsts f USING (line) LEFT JOIN near USING (line)
  WHERE near.line IS NOT NULL OR (l.doc_id, l.place) <> f.first),
per AS (SELECT doc_id, list(place ORDER BY place) AS g FROM gone GROUP BY doc_id)
SELECT parts.doc_id, len(p)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
  coalesce(array_to_string(g, ','), '') AS removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda i: NOT list_contains(coalesce(g, []), i - 1)), lambda i: p[i]), chr(10)), '')) AS kept_sha256
FROM parts LEFT JOIN per ON parts.doc_id = per.doc_id
"""

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

_OP2 = rf"""
WITH kinds AS (SELECT * FROM (VALUES
  ('assign', 0, 6, '{_ASSIGN}'), ('access', 1, 20, 'AKIA[A-Z0-9]+'), ('hex', 2, 24, '[0-9a-f]+'), ('mixed', 3, 24, '[A-Za-z0-9+/_-]+')) t(kind, no, least, pattern)),
docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
hits AS (
  SELECT doc_id, owner, 'assign' AS kind, 0 AS no, 6 AS least, regexp_extract_all(text, '{_ASSIGN}', 0) AS h, regexp_extract_all(text, '{_ASSIGN}', 2) AS v, string_split_regex(text, '{_ASSIGN}') AS g FROM docs
  UNION ALL SELECT doc_id, owner, 'access', 1, 20, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) AS h, h, string_split_regex(text, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT doc_id, owner, 'hex', 2, 24, regexp_extract_all(text, '[0-9a-f]+', 0) AS h, h, string_split_regex(text, '[0-9a-f]+') FROM docs
  UNION ALL SELECT doc_id, owner, 'mixed', 3, 24, regexp_extract_all(text, '[A-Za-z0-9+/_-]+', 0) AS h, h, string_split_regex(text, '[A-Za-z0-9+/_-]+') FROM docs),
each AS (SELECT doc_id, owner, kind, no, least, unnest(h) AS h, unnest(v) AS v, unnest(g[1:len(h)]) AS g, generate_subscripts(h, 1) AS i FROM hits WHERE len(h) > 0),
placed AS (
  SELECT doc_id, owner, kind, no, least, v,
    (sum(length(g) + length(h)) OVER w - length(h))::BIGINT AS s, (sum(length(g) + length(h)) OVER w)::BIGINT AS e
  FROM each WINDOW w AS (PARTITION BY doc_id, no ORDER BY i)),
good AS (SELECT * FROM placed WHERE length(v) >= least),
spans AS (
  SELECT * FROM good WHERE no < 3
  UNION ALL SELECT * FROM good m WHERE no = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM good b WHERE b.no < 3 AND b.doc_id = m.doc_id AND b.s < m.e AND m.s < b.e)),
owners AS (SELECT v, count(DISTINCT owner) = 1 OR (count(DISTINCT owner) < 3 AND count(DISTINCT doc_id) < 16) AS live FROM spans GROUP BY v),
judged AS (SELECT spans.*, live FROM spans JOIN owners USING (v) WHERE no < 3 OR live),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM judged GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM docs LEFT JOIN per USING (doc_id)
"""

_OP3 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g USING (norm)
"""

_VECTORS = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_INNER = "list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT"

_OP8 = f"""
WITH v AS ({_VECTORS}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, {_INNER} AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

_OP13 = f"""
WITH v AS (SELECT vec_id, q, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y FROM ({_VECTORS}) WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.y = b.y AS same, {_INNER} AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INT AS positive_rank FROM s WHERE same AND anchor_id <> vec_id QUALIFY positive_rank <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

# the cyclic redundancy check of ASCII text, byte by byte and bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""
_SOLID, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*$"

# states of a repair: 0 nothing kept, 1 after system, 2 after user, 3 after assistant; the least (cost, audit) that leads to each, row by row
_OP11 = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT conv_id, turn, role, text, ({_CRC}) % 20 AS h FROM raw),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM dam),
rows AS (SELECT conv_id, turn, role, text, i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
  CASE WHEN NOT regexp_matches(text, '{_SOLID}') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '{_ENDED}') THEN 't' ELSE 'n' END AS f FROM num),
-- what the edits of one row (any roles put in before it, then the row's own) do to each state
due AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) t(q, d)),
put AS (SELECT q AS p, q, '' AS ins, 0 AS cost FROM due UNION ALL SELECT q, d, 'I', 3 FROM due UNION ALL SELECT a.q, b.d, 'II', 6 FROM due a JOIN due b ON b.q = a.d UNION ALL SELECT a.q, c.d, 'III', 9 FROM due a JOIN due b ON b.q = a.d JOIN due c ON c.q = b.d),
own AS (SELECT r.conv_id, r.i, x.p, x.q, x.cost + 4 AS cost, x.ins || 'D' AS op FROM rows r CROSS JOIN put x
  UNION ALL SELECT r.conv_id, r.i, x.p, d.d, x.cost + 3 + 3 * (f = 't')::INT, x.ins || 'R' FROM rows r CROSS JOIN put x JOIN due d ON d.q = x.q WHERE f IN ('t', 'n')
  UNION ALL SELECT r.conv_id, r.i, x.p, CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, x.cost + 3 * (f = 't')::INT, x.ins || 'K' FROM rows r CROSS JOIN put x
    WHERE f IN ('t', 'n') AND ((c = 's' AND x.q = 0) OR (c = 'u' AND x.q <> 2) OR (c = 'a' AND x.q = 2))),
best AS (SELECT conv_id, i, p, q, min((cost, op)) AS m FROM own GROUP BY ALL),
go AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit FROM rows WHERE i = 1
  UNION ALL
  SELECT conv_id, i, q, cost, audit FROM (
    SELECT g.conv_id, b.i, b.q, g.cost + b.m[1] AS cost, g.audit || b.m[2] AS audit, row_number() OVER (PARTITION BY g.conv_id, b.q ORDER BY g.cost + b.m[1], g.audit || b.m[2]) AS n
    FROM go g JOIN best b ON b.conv_id IS NOT DISTINCT FROM g.conv_id AND b.i = g.i + 1 AND b.p = g.q) WHERE n = 1),
fin AS (SELECT g.conv_id, min((g.cost + x.cost, g.audit || x.ins)) AS m FROM go g JOIN (SELECT conv_id, max(i) AS n FROM rows GROUP BY 1) l ON l.conv_id IS NOT DISTINCT FROM g.conv_id AND l.n = g.i JOIN put x ON x.p = g.q AND x.q IN (0, 3) GROUP BY 1),
-- the audit again as rows: kept and new messages in order
ops AS (SELECT conv_id, j, substr(m[2], j, 1) AS op, length(regexp_replace(left(m[2], j), 'I', '', 'g')) AS i, length(regexp_replace(left(m[2], j), 'D', '', 'g')) AS e FROM (SELECT conv_id, m, unnest(range(1, length(m[2]) + 1)) AS j FROM fin)),
said AS (SELECT o.conv_id, o.j, o.e, o.op, r.role, coalesce(r.text, '') AS text, first_value(CASE WHEN o.op = 'K' AND r.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id ORDER BY o.j) AS sys
  FROM ops o LEFT JOIN rows r ON o.op <> 'I' AND r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.i = o.i WHERE o.op <> 'D'),
msgs AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (e - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS t FROM said GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(f.m[1], 0)::BIGINT AS cost, coalesce(f.m[2], '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN msgs m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES = {"op1_line_dedup": _OP1, "op2_secret_scans": _OP2, "op3_exact_dedup": _OP3, "op8_topk_search": _OP8, "op11_conversation_repair": _OP11, "op13_hard_negatives": _OP13}
