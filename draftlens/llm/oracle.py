"""SQL of op11 to op13."""

from __future__ import annotations


def _add(state: str, cost: str, letter: str) -> str:
    """A state (nine digits of cost, then the audit; null if it can't be reached) after an edit."""
    return f"lpad(CAST(CAST({state}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || '{letter}'"


def _least(*options: str) -> str:
    return f"least({', '.join(options)})"


_D = [_add(f"s{q}", "2", "D") for q in range(4)]
_K = [_add(f"s{q}", "extra", "K") for q in range(4)]
_R = [_add(f"s{q}", "1 + extra", "R") for q in range(4)]
_FREE = "CASE WHEN NOT forced THEN {0} END"
_KEPT = "CASE WHEN NOT forced AND initial = '{0}' THEN {1} END"
_TO_USER = _least(_D[2], _FREE.format(_least(_R[0], _R[1], _R[3])), _KEPT.format("u", _least(_K[0], _K[1], _K[3])))
_TO_ASSISTANT = _least(_D[3], _FREE.format(_R[2]), _KEPT.format("a", _K[2]))


def _insert(state: str) -> str:
    return _add(state, "5", "I")


OP11 = rf"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(CAST(role AS VARCHAR), ' ') AS role, coalesce(CAST(text AS VARCHAR), ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
sums AS (
  SELECT name, xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: list_reduce(
             list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END))) % 20 AS hit
  FROM (SELECT DISTINCT name FROM said)),
hurt AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, hit
  FROM said JOIN sums USING (name) WHERE hit <> 0),
twice AS (SELECT conv_id, turn, role, text FROM hurt UNION ALL SELECT conv_id, turn, role, text FROM hurt WHERE hit = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, role[1:1] AS initial FROM twice),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id),
walk(conv_id, k, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), '000000005I', '000000010II' FROM marked
  UNION ALL
  SELECT conv_id, k, n0, n1, {_least("m2", _insert("m3"))}, {_least("m3", _insert("m2"))}
  FROM (
    SELECT *, {_least("n2", _insert("n0"), _insert("n1"), _insert("n3"))} AS m2, {_least("n3", _insert("n2"))} AS m3
    FROM (
      SELECT conv_id, k, {_D[0]} AS n0, {_least(_D[1], _KEPT.format("s", _K[0]))} AS n1, {_TO_USER} AS n2, {_TO_ASSISTANT} AS n3
      FROM (
        SELECT w.*  EXCLUDE (k), m.k, m.initial, m.fault IN ('blank', 'duplicate') AS forced, CASE WHEN m.fault = 'truncated' THEN 5 ELSE 0 END AS extra
        FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k + 1)))),
best AS (
  SELECT w.conv_id, CAST(least(s0, s3)[1:9] AS BIGINT) AS cost, least(s0, s3)[10:] AS audit
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k = c.n),
edits AS (SELECT conv_id, audit, generate_subscripts(string_split(audit, ''), 1) AS p FROM best WHERE audit <> ''),
numbered AS (
  SELECT conv_id, p, audit[p] AS edit, length(replace(audit[1:p], 'I', '')) AS k, length(replace(audit[1:p], 'D', '')) AS o,
         length(replace(audit, 'D', '')) % 2 AS odd
  FROM edits WHERE audit[p] <> 'D'),
turns AS (
  SELECT n.conv_id, n.p, CASE WHEN n.edit = 'K' THEN m.role WHEN (n.o + n.odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
         || CASE WHEN n.edit = 'I' THEN '' ELSE m.text END AS line
  FROM numbered n LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM n.conv_id AND m.k = n.k AND n.edit <> 'I'),
repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS text FROM turns GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _op12(k: int = 8, rounds: int = 10) -> str:
    def assigned(i: int) -> str:
        gap = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"a{i} AS MATERIALIZED (SELECT row, vec_id, v.v, c.j, CAST({gap} AS BIGINT) AS d FROM kept v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, j) = 1)"

    def moved(i: int) -> str:
        return f"""m{i} AS (
  SELECT j, list(x ORDER BY pos) AS v FROM (
    SELECT j, pos, CAST((s - (s % n + n) % n) // n AS BIGINT) AS x
    FROM (SELECT j, pos, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i - 1}) GROUP BY j, pos)) GROUP BY j),
c{i} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{i - 1} c LEFT JOIN m{i} m USING (j))"""

    steps = [assigned(0)]
    for i in range(1, rounds + 1):
        steps += [moved(i), assigned(i)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v
  FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
{", ".join(steps)}
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j
"""


OP12 = _op12()

OP13 = r"""
WITH RECURSIVE dw AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT row, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT row, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM dw WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT row, count(*) AS n FROM sh GROUP BY row),
both_ AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.row <> b.row GROUP BY a.row, b.row),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(row, to_) AS (SELECT row, row FROM dw UNION SELECT r.row, l.b FROM reach r JOIN link l ON l.a = r.to_),
comp AS (SELECT r.row, min(d.doc_id) AS component_id FROM reach r JOIN dw d ON d.row = r.to_ GROUP BY r.row)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM dw JOIN comp USING (row) LEFT JOIN n USING (row)
"""
