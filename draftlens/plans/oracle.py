"""The same results in plain SQL, for another engine to check against."""

from __future__ import annotations

from draftlens import vocab

_LOG = "log AS (SELECT CAST(user_id % 5 + 1 AS INTEGER) AS project, user_id AS author, ts, event_id AS tie, event_type AS label FROM events)"
_REV = "rev AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS revision_index, coalesce(text, '') AS text FROM conversations)"
_ORDER = "PARTITION BY project ORDER BY ts, tie"
_MIN = "(epoch_us({b}) - epoch_us({a})) / 60000000.0"
_GAPS = f"g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY project, author ORDER BY ts, tie)) AS us FROM log), gaps AS (SELECT *, us / 60000000.0 AS gap FROM g WHERE us IS NOT NULL)"
_VOCAB = "voc AS (SELECT * FROM (VALUES ('view', 0), ('click', 1), ('signup', 2), ('purchase', 3), ('error', 4)) v(label, pos))"
_BIN = "CASE " + " ".join(f"WHEN gap < {float(e)} THEN {k}" for k, e in enumerate(vocab.GAP_BINS)) + f" ELSE {len(vocab.GAP_BINS)} END"
_HIST = f"b AS (SELECT CAST({_BIN} AS INTEGER) AS bin, count(*) AS n FROM gaps GROUP BY 1), h AS (SELECT CAST(r.range AS INTEGER) AS bin, coalesce(b.n, 0) AS n FROM range({len(vocab.GAP_BINS) + 1}) r LEFT JOIN b ON b.bin = r.range)"
_NEXT = f"nx AS (SELECT *, lead(label) OVER ({_ORDER}) AS nxt, row_number() OVER ({_ORDER}) - 1 AS p, count(*) OVER (PARTITION BY project) // 3 AS t FROM log)"


def _transitions(where: str = "", keys: str = "") -> str:
    k = keys + ", " if keys else ""
    return f"""WITH {_LOG}, {_NEXT}, pairs AS (SELECT {k}label AS cur, nxt, count(*) AS n FROM nx WHERE nxt IS NOT NULL AND nxt <> label {where} GROUP BY ALL)
SELECT {k}cur, nxt, n, round(n / sum(n) OVER (PARTITION BY {k}cur), 6) AS prob FROM pairs"""



def _in_lines(pattern: str) -> str:
    """A leakage pattern for a literal, with ^ and $ at lines."""
    return pattern.replace("(?i)", "(?im)").replace("'", "''")


_PIECES = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"


def _change(before: str, after: str) -> str:
    """The change between two columns, told as in operators/clipboard.py."""
    a, b = (f"regexp_extract_all({x}, '{_PIECES}')" for x in (before, after))
    fewer = f"least(len({a}), len({b}))"

    def differ(x: str, y: str) -> str:
        return f"list_min(list_filter(range(0, {fewer} + 1), lambda i: i = {fewer} OR ({x})[i + 1] <> ({y})[i + 1]))"

    start = differ(a, b)
    end = f"least({differ(f'list_reverse({a})', f'list_reverse({b})')}, {fewer} - {start})"
    gone, new = (f"array_to_string(({x})[{start} + 1 : len({x}) - {end}], '')" for x in (a, b))
    at = _place_after(f"array_to_string(({a})[1 : {start}], '')")
    return f"CASE WHEN {before} = {after} THEN 'All lines are the same' WHEN {gone} = '' THEN {at} || ' ' || {new} || '--added' WHEN {new} = '' THEN {at} || ' ' || {gone} || '--deleted' ELSE {at} || ' ' || {gone} || '->' || {new} END"


def _place_after(before: str) -> str:
    return f"'(' || (length({before}) - length(replace({before}, chr(10), ''))) || ',' || length(string_split({before}, chr(10))[-1]) || ')'"


_STREAM = f"""many AS (SELECT max(conv_id) + 1 AS c, max(turn) + 1 AS t FROM conversations),
own AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
stream AS (
  SELECT project, ts, tie, own.text, CASE label WHEN 'click' THEN 'copy' WHEN 'signup' THEN 'paste' WHEN 'purchase' THEN 'undo' WHEN 'error' THEN 'undo' ELSE 'type' END AS kind,
         coalesce(nxt.text, '') AS new_text, CASE WHEN label = 'click' THEN coalesce(regexp_extract_all(own.text, '{_PIECES}')[-1], '') END AS selection
  FROM log CROSS JOIN many JOIN own ON own.conv_id = tie % c AND own.turn = (tie // c) % t LEFT JOIN own nxt ON nxt.conv_id = own.conv_id AND nxt.turn = own.turn + 1),
st1 AS (
  SELECT *, last_value(selection IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clipboard,
         sum(CASE kind WHEN 'type' THEN 1 WHEN 'paste' THEN 1 WHEN 'undo' THEN -1 ELSE 0 END) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
  FROM stream),
st2 AS (
  SELECT *, least(0, min(s) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS low, coalesce(least(0, min(s) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS was
  FROM st1),
st3 AS (
  SELECT *, s - low AS height, CASE kind WHEN 'type' THEN new_text WHEN 'paste' THEN text || coalesce(clipboard, '') END AS after_ FROM st2),
st4 AS (
  SELECT *, last_value(CASE WHEN kind IN ('type', 'paste') THEN tie END IGNORE NULLS) OVER (
           PARTITION BY project, CASE WHEN kind = 'undo' THEN height + 1 ELSE height END ORDER BY ts, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pushed
  FROM st3),
st5 AS (SELECT *, CASE WHEN kind = 'undo' AND s >= was THEN pushed END AS undone FROM st4),
st6 AS (
  SELECT a.*, CASE a.kind WHEN 'undo' THEN coalesce(b.after_, '') ELSE a.text END AS was_text, CASE a.kind WHEN 'undo' THEN coalesce(b.text, '') WHEN 'copy' THEN '' ELSE a.after_ END AS is_text
  FROM st5 a LEFT JOIN st5 b ON b.tie = a.undone)"""


def _runs(label: str = "label", where: str = "") -> str:
    return f"""f AS (SELECT project, ts, tie, {label} AS label FROM log {where}),
f1 AS (SELECT *, row_number() OVER ({_ORDER}) - 1 AS place, lag(label) OVER ({_ORDER}) AS b FROM f),
f2 AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> label THEN 1 ELSE 0 END) OVER ({_ORDER}) - 1 AS run FROM f1),
runs AS (SELECT project, CAST(run AS BIGINT) AS run, min(label) AS label, CAST(min(place) AS INTEGER) AS "first", CAST(max(place) AS INTEGER) AS "last", count(*) AS length FROM f2 GROUP BY project, run)"""


_WIN = f"""w0 AS (SELECT project, label, row_number() OVER ({_ORDER}) - 1 AS p, count(*) OVER (PARTITION BY project) AS n FROM log),
win AS (SELECT project, label, CAST(p // CAST(ceil(n / 10.0) AS BIGINT) AS INTEGER) AS win, count(*) AS n FROM w0 GROUP BY ALL)"""


def _phase(k: int) -> str:
    return f"SELECT * FROM ph WHERE p >= (n * {k - 1}) // 3 AND p < (n * {k}) // 3"


_PH = f"ph AS (SELECT *, row_number() OVER ({_ORDER}) - 1 AS p, count(*) OVER (PARTITION BY project) AS n FROM log)"


def _sessions(label_breaks: bool = False, where: str = "") -> str:
    label = f"WHEN label <> lag(label) OVER ({_ORDER}) THEN 'label'" if label_breaks else ""
    return f"""s0 AS (SELECT *, row_number() OVER ({_ORDER}) - 1 AS place,
  CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER ({_ORDER})) > 600000000 THEN 'gap' {label} END AS cause FROM log {where}),
s1 AS (SELECT *, sum(CASE WHEN cause IS NOT NULL THEN 1 ELSE 0 END) OVER ({_ORDER}) AS session FROM s0),
s2 AS (SELECT project, CAST(session AS BIGINT) AS session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, list(label ORDER BY place) AS labels, max(cause) AS opened FROM s1 GROUP BY project, session),
ses AS (SELECT *, lead(opened) OVER (PARTITION BY project ORDER BY session) AS closed, {_MIN.format(a="start_ts", b="end_ts")} AS minutes FROM s2)"""


def _strict(least: float) -> str:
    return f"st AS (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY session) - 1 AS INTEGER) AS idx FROM ses WHERE closed IS NOT NULL AND minutes > {least})"


_W = r"list_filter(regexp_split_to_array({t}, '[\s\x0B\x1c-\x1f\x85\xA0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: x <> '')"


def _words(t: str) -> str:
    return _W.format(t=t)


def _jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({_words(f'lower({a})')})", f"list_distinct({_words(f'lower({b})')})"
    i = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 1.0 ELSE {i} * 1.0 / (len({x}) + len({y}) - {i}) END"


_DOCW = "PARTITION BY doc_id ORDER BY revision_index"
_EDIT = f"""k0 AS (SELECT doc_id, revision_index, regexp_extract_all(lower(substr(text, 1, 200)), '[a-z0-9_]+') AS t FROM rev),
k1 AS (SELECT *, lag(t) OVER ({_DOCW}) AS b FROM k0),
k2 AS (SELECT *, CASE WHEN b IS NULL OR b = t THEN 0 ELSE (
   len(list_filter(list_distinct(t), lambda x: NOT list_contains(b, x))) + len(list_filter(list_distinct(b), lambda x: NOT list_contains(t, x)))) * 1.0 / greatest(len(t), len(b), 1) END AS ratio FROM k1),
ed AS (SELECT doc_id, revision_index, CAST(CASE WHEN ratio >= 0.2 THEN 2 WHEN ratio > 0 THEN 1 ELSE 0 END AS INTEGER) AS edit FROM k2),
ec AS (SELECT *, max(edit) OVER ({_DOCW} ROWS UNBOUNDED PRECEDING) AS state FROM ed)"""
_STATE = "list_extract(['cold', 'warm', 'assimilated'], state + 1)"

_SPANS = """sp0 AS (
  SELECT doc_id, revision_index, text, 'inj_' || doc_id AS injection_id, CASE WHEN revision_index % 4 = 3 THEN 'anomaly.truncation' ELSE 'injection.topical' END AS label,
         CAST(floor(length(text) / 4.0) AS INTEGER) AS s, CAST(floor(length(text) / 2.0) AS INTEGER) AS e FROM rev
  UNION ALL
  SELECT doc_id, revision_index, text, 'two_' || doc_id, 'injection.naive', CAST(floor(length(text) / 3.0) AS INTEGER),
         CAST(floor(length(text) * 3 / 4.0) + CASE WHEN revision_index = 2 THEN 5000 ELSE 0 END AS INTEGER) FROM rev WHERE revision_index % 2 = 0),
sp AS (SELECT *, starts_with(label, 'injection.') AS inj, CASE WHEN starts_with(label, 'injection.') THEN split_part(label, '.', 2) END AS level,
  CASE WHEN starts_with(label, 'injection.') THEN list_extract(['cold', 'warm', 'assimilated'], CAST((doc_id + revision_index) % 3 AS INTEGER) + 1) END AS state,
  list_extract(['none', 'low', 'medium', 'high'], CAST(doc_id % 4 AS INTEGER) + 1) AS flag FROM sp0)"""


def _broken(kind: str, rows: str, *rules: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, revision_index, injection_id, '{kind}' AS error_type, {m} AS message FROM {rows} WHERE {c}" for c, m in rules)


def _iou(keys: str) -> str:
    k = keys + ", " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""WITH {_REV}, {_SPANS},
pt AS (SELECT {k}s AS x, CASE WHEN injection_id LIKE 'inj%' THEN 1 ELSE 0 END AS dp, CASE WHEN injection_id LIKE 'two%' THEN 1 ELSE 0 END AS dt FROM sp WHERE e > s
       UNION ALL SELECT {k}e, CASE WHEN injection_id LIKE 'inj%' THEN -1 ELSE 0 END, CASE WHEN injection_id LIKE 'two%' THEN -1 ELSE 0 END FROM sp WHERE e > s),
ag AS (SELECT {k}x, sum(dp) AS dp, sum(dt) AS dt FROM pt GROUP BY {k}x),
sg AS (SELECT {k}sum(dp) OVER w > 0 AS p, sum(dt) OVER w > 0 AS t, lead(x) OVER ({part} ORDER BY x) - x AS len FROM ag WINDOW w AS ({part} ORDER BY x ROWS UNBOUNDED PRECEDING)),
su AS (SELECT {k}CAST(coalesce(sum(CASE WHEN p AND t THEN len END), 0) AS BIGINT) AS inter, CAST(coalesce(sum(CASE WHEN p OR t THEN len END), 0) AS BIGINT) AS "union" FROM sg {group})
SELECT {k}inter, "union", round(coalesce(inter * 1.0 / nullif("union", 0), 1), 6) AS iou FROM su"""


_PAIRS = "pairs AS (SELECT l.doc_id, quality, toxic, n_chars, source, lang FROM labels l JOIN documents d USING (doc_id))"
_CONF = 'cm AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS p, count(*) AS n FROM pairs GROUP BY ALL)'
_PERCLASS = """lb AS (SELECT t AS label FROM cm UNION SELECT p FROM cm),
pc AS (SELECT label, CAST(coalesce((SELECT sum(n) FROM cm WHERE t = label), 0) AS BIGINT) AS support, coalesce((SELECT sum(n) FROM cm WHERE p = label), 0) AS claimed,
       coalesce((SELECT sum(n) FROM cm WHERE t = label AND p = label), 0) AS hit FROM lb)"""
_MARKERS = "|".join(vocab.DISCOURSE_MARKERS)


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _pii() -> str:
    parts = []
    for r, p in {**vocab.PII_STRICT, **vocab.PII_HEURISTIC}.items():
        p = p.replace("'", "''")
        # this engine's word boundaries know ASCII only: in names, other letters are shown to it as an underscore
        shown = "coalesce(text, '')" if r in vocab.PII_STRICT else r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g')"
        found = f"regexp_extract_all({shown}, '{p}')"
        if r in vocab.PII_HEURISTIC:
            skip = " AND ".join(f"NOT starts_with(m, '{w}')" for w in vocab.PII_NOT_NAMES)
            found = f"list_filter({found}, lambda m: {skip})"
        parts.append(f"SELECT doc_id, '{r}' AS rule_id, '{'high' if r in vocab.PII_STRICT else 'medium'}' AS severity, len({found}) AS n FROM documents")
    return "pii AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0)"


_OPENING = "|".join(vocab.LEAKAGE_OPENINGS).replace("'", "''")
_STRIPPED = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
_LEAKS = (
    rf"(regexp_matches({_STRIPPED}, '^(?:{_OPENING})', 'i')"
    + rf" OR (contains({_STRIPPED}, '[') AND contains({_STRIPPED}, ']') AND ("
    + " OR ".join(f"contains(upper({_STRIPPED}), '{w}')" for w in vocab.LEAKAGE_BRACKET_WORDS)
    + ")) OR "
    + " OR ".join(f"contains(lower({_STRIPPED}), '{w.lower()}')" for w in vocab.LEAKAGE_ECHOES)
    + f""" OR (starts_with({_STRIPPED}, '"') AND ends_with({_STRIPPED}, '"') AND length({_STRIPPED}) - length(replace({_STRIPPED}, '"', '')) = 2))"""
)
_PATTERNS = " + ".join("CAST(regexp_matches(text, '" + p.replace("(?i)", "(?im)").replace("'", "''") + "') AS INTEGER)" for p in vocab.LEAKAGE_PATTERNS)
_TEMPLATE = "(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{t.lower()}')" for t in vocab.NAIVE_TEMPLATES) + ")"

_TRACE = """tr AS (SELECT *, CAST(doc_id % 9 + 1 AS INTEGER) AS size FROM sp),
ev AS (SELECT doc_id, revision_index, injection_id, label, state, flag, size, i,
         (i * 3 + doc_id) % 4 = 0 AS bad, (i + doc_id) % 3 = 0 AS fixed, CAST(1.0 - i * 0.01 + CASE WHEN doc_id % 5 = 0 THEN i * 0.02 ELSE 0 END AS DOUBLE) AS glucose,
         ((i * i + doc_id) % 7) / 2.0 AS cx
       FROM (SELECT *, unnest(generate_series(1, size)) AS i FROM tr)),
ev1 AS (SELECT *, min(CASE WHEN fixed THEN i END) OVER (PARTITION BY doc_id, revision_index, injection_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_fix,
         lead(cx) OVER (PARTITION BY doc_id, revision_index, injection_id ORDER BY i) AS cx1,
         lead(glucose) OVER (PARTITION BY doc_id, revision_index, injection_id ORDER BY i) AS gl1 FROM ev),
sg0 AS (SELECT doc_id, revision_index, injection_id, any_value(size) AS size, any_value(label) AS label, any_value(state) AS state, any_value(flag) AS flag, bool_or(bad) AS any_bad, min(glucose) AS least,
         coalesce(avg(CASE WHEN bad AND next_fix IS NOT NULL THEN next_fix - i + 1 END), 0) AS loc, bool_or(gl1 > glucose + 0.0001) AS rises,
         coalesce(covar_samp(CASE WHEN bad THEN 1.0 ELSE 0 END, cx1) FILTER (cx1 IS NOT NULL) / nullif(stddev_samp(CASE WHEN bad THEN 1.0 ELSE 0 END) FILTER (cx1 IS NOT NULL) * stddev_samp(cx1) FILTER (cx1 IS NOT NULL), 0), 0) AS r,
         coalesce(covar_samp(CASE WHEN bad AND fixed THEN 1.0 ELSE 0 END, cx1) FILTER (cx1 IS NOT NULL) / nullif(stddev_samp(CASE WHEN bad AND fixed THEN 1.0 ELSE 0 END) FILTER (cx1 IS NOT NULL) * stddev_samp(cx1) FILTER (cx1 IS NOT NULL), 0), 0) AS rr
       FROM ev1 GROUP BY doc_id, revision_index, injection_id),
sg AS (SELECT *, CASE WHEN size > 5 AND any_bad THEN r ELSE 0 END AS cr FROM sg0),
sig AS (SELECT *, round(loc, 2) AS locality, round(cr, 3) + CAST(0 AS DOUBLE) AS coupling, loc BETWEEN 1.0 AND 3.5 AND abs(cr) > 0.5 AS plausible FROM sg)"""

SQL: dict[str, str] = {
    "label_counts": f"WITH {_LOG} SELECT label, count(*) AS n FROM log GROUP BY label",
    "label_counts_by_project": f"WITH {_LOG} SELECT project, label, count(*) AS n FROM log GROUP BY ALL",
    "label_counts_dense": f"WITH {_LOG}, voc AS (SELECT * FROM (VALUES ('view', 0), ('click', 1), ('signup', 2), ('purchase', 3), ('error', 4), ('refund', 5)) v(label, pos)), c AS (SELECT label, count(*) AS n FROM log GROUP BY label) SELECT label, pos, n FROM voc LEFT JOIN c USING (label)",
    "label_log_freq": f"WITH {_LOG}, c AS (SELECT label, count(*) AS n FROM log GROUP BY label) SELECT label, n, round(ln(n), 6) AS log_n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM c",
    "label_shares_by_project": f"WITH {_LOG}, c AS (SELECT project, label, count(*) AS n FROM log GROUP BY ALL) SELECT project, label, n, round(ln(n), 6) AS log_n, round(100.0 * n / sum(n) OVER (PARTITION BY project), 6) AS pct FROM c",
    "daily_activity_dense": "WITH b AS (SELECT CAST(range AS DATE) AS bucket FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)), c AS (SELECT CAST(ts AS DATE) AS bucket, count(*) AS n FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)",
    "weekly_activity": "WITH b AS (SELECT CAST(range AS DATE) AS bucket FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 7 DAY)), c AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS bucket, count(*) AS n FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)",
    "monthly_activity": "WITH b AS (SELECT CAST(range AS DATE) AS bucket FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2025-01-01', INTERVAL 1 MONTH)), c AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS bucket, count(*) AS n FROM events WHERE ts >= '2024-01-01' AND ts < '2025-01-01' GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)",
    "daily_activity_by_project": f"WITH {_LOG} SELECT CAST(ts AS DATE) AS bucket, coalesce(CAST(project AS VARCHAR), 'null') AS key, count(*) AS n FROM log WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY ALL",
    "daily_activity_closed": f"WITH {_LOG} SELECT CAST(ts AS DATE) AS bucket, coalesce(label, 'null') AS key, count(*) AS n FROM log WHERE ts >= '2024-01-01' AND ts <= '2024-01-15' GROUP BY ALL",
    "top_users_breakdown": f"WITH {_LOG}, c AS (SELECT author, count(*) AS total FROM log GROUP BY author ORDER BY total DESC, author LIMIT 5) SELECT author, project, count(*) AS n, any_value(total) AS total FROM log JOIN c USING (author) GROUP BY author, project",
    "top_projects_breakdown": f"WITH {_LOG}, c AS (SELECT project, count(*) AS total FROM log GROUP BY project ORDER BY total DESC, project LIMIT 3) SELECT project, author, count(*) AS n, any_value(total) AS total FROM log JOIN c USING (project) GROUP BY project, author",
    "breakdown_entries": f"WITH {_LOG}, c AS (SELECT project, coalesce(label, 'null') AS key, count(*) AS n FROM log GROUP BY ALL) SELECT project, key, n, CAST(sum(n) OVER (PARTITION BY project) AS BIGINT) AS total FROM c",
    "activity_rollup": f"WITH {_LOG} SELECT project, label, count(*) AS n, CAST(grouping(project) * 2 + grouping(label) AS INTEGER) AS level FROM log GROUP BY ROLLUP (project, label)",
    "stacked_series": "SELECT CAST(ts AS DATE) AS bucket, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS {x}" for x in ("view", "click", "signup", "purchase", "error")) + " FROM events GROUP BY 1",
    "first_last_edit": f"WITH {_LOG} SELECT project, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(label, (ts, tie)) AS last_label FROM log GROUP BY project",
    "replay_page": f"WITH {_LOG}, x AS (SELECT project, CAST(row_number() OVER ({_ORDER}) - 1 AS INTEGER) AS place, tie, label FROM log) SELECT * FROM x WHERE place >= 200 AND place < 400",
    "distinct_authors": f"WITH {_LOG} SELECT project, count(DISTINCT author) AS authors, count(DISTINCT label) AS coverage FROM log GROUP BY project",
    "gap_stats": f"WITH {_LOG}, {_GAPS} SELECT count(*) AS n, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap, round(avg(gap), 6) AS mean_gap, round(median(gap), 6) AS median_gap, round(stddev_pop(gap), 6) AS std_gap FROM gaps",
    "gap_histogram": f"WITH {_LOG}, {_GAPS}, {_HIST} SELECT bin, n FROM h",
    "gap_drop_pct": f"WITH {_LOG}, {_GAPS}, {_HIST}, x AS (SELECT bin, n, lead(n) OVER (ORDER BY bin) AS nx FROM h) SELECT bin, n, round(100.0 * (1 - nx * 1.0 / n), 6) AS drop_pct FROM x WHERE nx IS NOT NULL AND n > 0",
    "transitions": _transitions(),
    "transitions_early": _transitions("AND p < t"),
    "transitions_late": _transitions("AND p >= 2 * t"),
    "transitions_by_project": _transitions(keys="project"),
    "transition_matrix": "WITH m AS (" + _transitions() + ") SELECT cur, " + ", ".join(f"coalesce(max(prob) FILTER (nxt = '{x}'), 0.0) AS {x}" for x in ("view", "click", "signup", "purchase", "error")) + " FROM m GROUP BY cur",
    "top_next_label": f"WITH m AS ({_transitions()}), {_VOCAB}, r AS (SELECT m.*, row_number() OVER (PARTITION BY cur ORDER BY n DESC, pos) AS k FROM m JOIN voc ON voc.label = m.nxt) SELECT cur, nxt, n, prob FROM r WHERE k = 1",
    "label_runs": f"WITH {_LOG}, {_runs()} SELECT * FROM runs",
    "flow_links": f"WITH {_LOG}, {_runs(where=chr(87) + 'HERE label <> ' + chr(39) + 'error' + chr(39))}, x AS (SELECT label AS source, lead(label) OVER (PARTITION BY project ORDER BY run) AS target FROM runs) SELECT source, target, count(*) AS n FROM x WHERE target IS NOT NULL AND source <> 'signup' AND target <> 'signup' GROUP BY ALL",
    "run_composition": f"WITH {_LOG}, {_runs('CASE WHEN label = ' + chr(39) + 'view' + chr(39) + ' THEN ' + chr(39) + 'labelled' + chr(39) + ' ELSE ' + chr(39) + 'unlabelled' + chr(39) + ' END')} SELECT project, run, label, length, round(100.0 * length / sum(length) OVER (PARTITION BY project), 6) AS pct FROM runs",
    "windowed_label_dist": f"WITH {_LOG}, {_WIN} SELECT * FROM win",
    "label_uniform_w1": f"WITH {_LOG}, {_WIN}, k AS (SELECT project, max(win) + 1 AS k FROM win GROUP BY project), g AS (SELECT p.project, p.label, k.k, w.range AS win FROM (SELECT DISTINCT project, label FROM win) p JOIN k USING (project) JOIN range(10) w ON w.range < k.k), x AS (SELECT g.*, coalesce(win.n, 0) * 1.0 / sum(coalesce(win.n, 0)) OVER (PARTITION BY g.project, g.label) AS p FROM g LEFT JOIN win ON win.project = g.project AND win.label = g.label AND win.win = g.win) SELECT project, label, round(avg(abs(p - 1.0 / k)), 6) AS w1 FROM x GROUP BY project, label",
    "label_temporal_mean": f"WITH {_LOG}, {_WIN}, x AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY project, label) AS p, n * 1.0 / max(n) OVER (PARTITION BY project, label) AS rel FROM win) SELECT project, label, round(sum(p * (win + 0.5) / 10), 6) AS mean_time, round(avg(rel), 6) AS mean_rel FROM x GROUP BY ALL",
    "phase_shares": f"WITH {_LOG}, {_PH} " + " UNION ALL ".join(f"SELECT project, label, count(*) AS n, {k} AS phase FROM ({_phase(k)}) GROUP BY project, label" for k in (1, 2, 3)),
    "sessions_gap": f"WITH {_LOG}, {_sessions()} SELECT project, session, start_ts, end_ts, n, round(minutes, 4) AS minutes FROM ses",
    "sessions_strict": f"WITH {_LOG}, {_sessions()}, {_strict(1.0)} SELECT project, session, idx AS \"index\", n, array_to_string(CASE WHEN session = 0 THEN labels ELSE labels[2:] END, ',') AS labels, round(minutes, 6) AS minutes FROM st",
    "intention_sessions": f"WITH {_LOG}, {_sessions(True, 'WHERE project <> 3')}, {_strict(0.01)} SELECT project, session, idx AS \"index\", labels[1] AS label, n, round(minutes, 6) AS minutes FROM st",
    "session_duration_stats": f"WITH {_LOG}, {_sessions()} SELECT project, count(*) AS n, round(avg(minutes), 6) AS mean_minutes, round(coalesce(var_samp(minutes), 0), 6) AS var_minutes, round(coalesce(stddev_samp(minutes), 0), 6) AS sd_minutes, round(median(minutes), 6) AS median_minutes, round(min(minutes), 6) AS min_minutes, round(max(minutes), 6) AS max_minutes FROM ses GROUP BY project",
    "session_duration_classes": f"WITH {_LOG}, {_sessions()} SELECT project, CASE WHEN minutes = 0 THEN 'zero' WHEN minutes < 1 THEN 'under_1' WHEN minutes < 5 THEN 'under_5' ELSE 'longer' END AS duration_class, count(*) AS n FROM ses GROUP BY ALL",
    "session_starts": f"WITH {_LOG}, {_sessions()} SELECT project, session, round(coalesce(sum(minutes) OVER (PARTITION BY project ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS begins FROM ses",
    "time_per_label": f"WITH {_LOG}, x AS (SELECT *, (epoch_us(lead(ts) OVER ({_ORDER})) - epoch_us(ts)) / 60000000.0 AS m FROM log), y AS (SELECT project, label, round(sum(CASE WHEN m <= 5 THEN m ELSE 0 END), 6) AS minutes, count(*) AS n FROM x GROUP BY ALL) SELECT *, round(100.0 * minutes / nullif(sum(minutes) OVER (PARTITION BY project), 0), 6) AS pct FROM y",
    "time_per_label_early_late": f"WITH {_LOG}, {_PH} " + " UNION ALL ".join(f"SELECT label, round(sum(CASE WHEN m <= 5 THEN m ELSE 0 END), 6) AS minutes, count(*) AS n, {k} AS phase FROM (SELECT label, (epoch_us(lead(ts) OVER ({_ORDER})) - epoch_us(ts)) / 60000000.0 AS m FROM ({_phase(k)})) GROUP BY label" for k in (1, 3)),
    "duration_vs_labels_ols": f"WITH {_LOG}, {_sessions()}, x AS (SELECT project, minutes, len(list_distinct(labels)) * 1.0 AS kinds FROM ses) SELECT project, count(*) AS n, round(CASE WHEN max(kinds) > min(kinds) THEN regr_slope(minutes, kinds) END, 6) AS slope, round(CASE WHEN max(kinds) > min(kinds) THEN regr_intercept(minutes, kinds) END, 6) AS intercept, round(CASE WHEN max(kinds) > min(kinds) THEN regr_r2(minutes, kinds) END, 6) AS r2 FROM x GROUP BY project",
    "window_sessions": f"WITH {_LOG}, {_sessions()} SELECT project, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_s, n FROM ses",
    "sliding_counts": "WITH x AS (SELECT CAST(ts AS DATE) AS d FROM events), y AS (SELECT d AS s FROM x UNION ALL SELECT d - 1 FROM x) SELECT strftime(s, '%Y-%m-%d') AS start_s, count(*) AS n FROM y GROUP BY 1",
    "word_delta_by_conv": f"WITH {_REV}, x AS (SELECT doc_id, revision_index, len({_words('text')}) AS n FROM rev), y AS (SELECT doc_id, n - lag(n) OVER ({_DOCW}) AS d FROM x) SELECT doc_id, CAST(coalesce(sum(CASE WHEN d > 0 THEN d END), 0) AS BIGINT) AS added, CAST(coalesce(sum(CASE WHEN d < 0 THEN -d END), 0) AS BIGINT) AS deleted FROM y GROUP BY doc_id",
    "revision_deltas": f"WITH {_REV}, x AS (SELECT doc_id, revision_index, CAST(len({_words('text')}) AS INTEGER) AS n_words FROM rev) SELECT *, n_words - lag(n_words) OVER ({_DOCW}) AS delta FROM x",
    "revision_anomalies": f"WITH {_REV}, x AS (SELECT *, lag(revision_index) OVER ({_DOCW}) AS bi, lag(text) OVER ({_DOCW}) AS bt FROM rev) SELECT doc_id, revision_index, CASE WHEN bi IS NULL THEN NULL WHEN revision_index <> bi + 1 THEN 'anomaly.missing_revision' WHEN bt <> '' AND text <> '' AND length(text) < length(bt) * 0.4 THEN 'anomaly.truncation' WHEN bt <> '' AND text <> '' AND {_jaccard('bt', 'text')} < 0.3 THEN 'anomaly.large_diff' END AS anomaly FROM x",
    "word_jaccard_consecutive": f"WITH {_REV}, x AS (SELECT *, lag(text) OVER ({_DOCW}) AS bt FROM rev) SELECT doc_id, revision_index, round({_jaccard('bt', 'text')}, 6) AS jaccard FROM x WHERE bt IS NOT NULL",
    "edit_classes": f"WITH {_REV}, {_EDIT} SELECT * FROM ec",
    "trajectory_states": f"WITH {_REV}, {_EDIT}, x AS (SELECT doc_id, max(state) AS state FROM ec GROUP BY doc_id) SELECT doc_id, {_STATE} AS state, list_extract(['none', 'low', 'medium'], state + 1) AS flag FROM x",
    "trajectory_history": f"WITH {_REV}, {_EDIT}, x AS (SELECT *, coalesce(lag(state) OVER ({_DOCW}), -1) AS b FROM ec) SELECT doc_id, revision_index, {_STATE} AS state FROM x WHERE state > b",
    "carry_forward_asof": f"WITH {_REV}, v AS (SELECT doc_id, revision_index AS born, md5(text) AS value FROM (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS revision_index, coalesce(text, '') AS text FROM conversations WHERE role = 'user')) SELECT rev.doc_id, rev.revision_index, v.value FROM rev ASOF LEFT JOIN v ON rev.doc_id = v.doc_id AND rev.revision_index >= v.born",
    "active_spans": f"WITH {_REV}, b AS (SELECT doc_id, revision_index AS born, length(text) AS size FROM (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS revision_index, coalesce(text, '') AS text FROM conversations WHERE role = 'user')) SELECT rev.doc_id, rev.revision_index, count(*) AS n_active, CAST(sum(size) AS BIGINT) AS chars FROM rev JOIN b ON rev.doc_id = b.doc_id AND born <= revision_index GROUP BY ALL",
    "doc_ids": "SELECT doc_id, 'doc_' || substr(sha256('seed:project:' || doc_id), 1, 16) AS hashed_id, 'rev_' || substr(sha256(source || ':' || doc_id), 1, 16) AS rev_id, CAST(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS UBIGINT) AS BIGINT) AS c1, CAST(0 AS BIGINT) AS bucket FROM documents",
    "provenance_hash": r"WITH x AS (SELECT doc_id, regexp_replace(replace(replace(nfc_normalize(coalesce(text, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents) SELECT doc_id, substr(sha256(regexp_replace(t, '^\s+|\s+$', '', 'g')), 1, 32) AS provenance FROM x",
    "discourse_density": rf"SELECT doc_id, CAST({_count('lower(coalesce(text, ' + chr(39) * 2 + '))', chr(92) + 'b(' + _MARKERS + ')' + chr(92) + 'b')} AS INTEGER) AS n_markers, CAST(len({_words('coalesce(text, ' + chr(39) * 2 + ')')}) AS INTEGER) AS n_words FROM documents",
    "syntactic_demand": rf"SELECT doc_id, round(CASE WHEN coalesce(text, '') = '' THEN 1.0 ELSE least(10.0, len({_words('text')}) / 10.0 + 1.2 * {_count('lower(text)', chr(92) + 'b(' + '|'.join(vocab.DEMAND_MARKERS) + ')' + chr(92) + 'b')}) END, 6) AS demand FROM documents",
    "pii_counts_by_rule": f"WITH {_pii()} SELECT rule_id, severity, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs FROM pii GROUP BY ALL",
    "pii_docs": f"WITH {_pii()} SELECT doc_id, CAST(sum(CASE WHEN severity = 'high' THEN n ELSE 0 END) AS BIGINT) AS n_high, CAST(sum(n) AS BIGINT) AS n FROM pii GROUP BY doc_id",
    "leakage_flags": f"SELECT doc_id, {_LEAKS} AS leaks, {_PATTERNS} AS n_patterns, {_TEMPLATE} AS template FROM documents",
    "template_hits": r"WITH t AS (SELECT item_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body FROM benchmark) SELECT DISTINCT doc_id, item_id FROM documents JOIN t ON body <> '' AND contains(lower(text), body)",
    "parsed_labels": "WITH v AS (SELECT unnest(["
    + ", ".join(f"'{x}'" for x in vocab.WRITING_INTENTIONS)
    + "]) AS label, unnest(range(15)) AS k), x AS (SELECT CASE WHEN event_id % 16 = 15 THEN 'Invalid' ELSE (SELECT label FROM v WHERE k = event_id % 16) END AS label FROM events) SELECT label, count(*) AS n FROM x GROUP BY label",
    "iso_timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0, 3) AS delta_s FROM events",
    "classification_report": f"WITH {_PAIRS}, {_CONF}, {_PERCLASS} SELECT label, support, round(coalesce(hit / nullif(claimed, 0), 0), 4) AS \"precision\", round(coalesce(hit / nullif(support, 0), 0), 4) AS recall, round(coalesce(2 * hit / nullif(claimed + support, 0), 0), 4) AS f1 FROM pc",
    "classification_summary": f"WITH {_PAIRS}, {_CONF}, {_PERCLASS}, a AS (SELECT round(sum(CASE WHEN t = p THEN n ELSE 0 END) / sum(n), 4) AS v FROM cm) SELECT 'accuracy' AS metric, v AS value FROM a UNION ALL SELECT 'micro_f1', v FROM a UNION ALL SELECT 'macro_f1', round(avg(coalesce(2 * hit / nullif(claimed + support, 0), 0)), 4) FROM pc",
    "confusion_matrix": f"WITH {_PAIRS}, {_CONF}, l AS (SELECT DISTINCT t AS label FROM cm) SELECT a.label AS \"true\", b.label AS pred, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN cm ON cm.t = a.label AND cm.p = b.label",
    "binary_f1": f"WITH {_PAIRS}, x AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 1500) AS tp, count(*) FILTER (quality <> 1 AND n_chars > 1500) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1500) AS fn FROM pairs GROUP BY lang) SELECT *, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM x",
    "auc_length_quality": f"WITH {_PAIRS}, r AS (SELECT lang, quality = 1 AS y, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS k FROM pairs), s AS (SELECT lang, sum(CASE WHEN y THEN k ELSE 0 END) AS r, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM r GROUP BY lang) SELECT lang, round(coalesce((r - p * (p + 1) / 2.0) / nullif(p * q, 0), 0), 6) AS auc FROM s",
    "kappa": f"WITH {_PAIRS}, a AS (SELECT quality AS k, count(*) * 1.0 / (SELECT count(*) FROM pairs) AS x FROM pairs GROUP BY 1), b AS (SELECT toxic AS k, count(*) * 1.0 / (SELECT count(*) FROM pairs) AS y FROM pairs GROUP BY 1), e AS (SELECT sum(x * y) AS pe FROM a JOIN b USING (k)), o AS (SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END) AS p0 FROM pairs) SELECT round(p0, 6) AS p0, round(pe, 6) AS pe, round(CASE WHEN pe >= 1 THEN 0 ELSE (p0 - pe) / (1 - pe) END, 6) AS kappa FROM o, e",
    "class_weights": f"WITH {_LOG}, voc AS (SELECT unnest(['view', 'click', 'signup', 'purchase', 'error', 'refund']) AS label), c AS (SELECT voc.label, count(log.label) + 1 AS c FROM voc LEFT JOIN log USING (label) GROUP BY voc.label), w AS (SELECT label, sum(c) OVER () / (count(*) OVER () * c) AS w FROM c) SELECT label, round(w / sum(w) OVER (), 6) AS weight FROM w",
    "harm_rates": f"WITH {_REV}, {_SPANS}, per AS (SELECT doc_id, revision_index, bool_or(inj) AS has, arg_min(label, s) FILTER (NOT inj) AS anomaly, any_value(contains(lower(text), 'the')) AS hit FROM sp GROUP BY ALL), h AS (SELECT *, CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0 END AS hit FROM sp WHERE inj) SELECT 'fpr_' || replace(anomaly, '.', '_') AS metric, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS value FROM per WHERE anomaly IS NOT NULL AND NOT has GROUP BY 1 UNION ALL SELECT 'sensitivity_level_' || level, round(avg(hit), 6) FROM h GROUP BY 1 UNION ALL SELECT 'sensitivity_state_' || state, round(avg(hit), 6) FROM h GROUP BY 1",
    "harm_by_source": f"WITH {_PAIRS} SELECT source, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0 END) FILTER (toxic = 1), 6) AS sensitivity, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0 END) FILTER (toxic = 0), 6) AS fpr, count(*) AS n FROM pairs GROUP BY source",
    "coupling_evaluation": "WITH x AS (SELECT quality = 1 AS t, toxic = 1 AS p FROM labels), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) AS n_keys FROM x) SELECT tp, fp, fn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, n_keys FROM c",
    "gold_sample": "SELECT doc_id, source FROM documents ORDER BY sha256('17:' || doc_id) LIMIT 50",
    "stratified_rotation": "SELECT list_extract(['naive', 'topical', 'contextual'], CAST(doc_id % 3 AS INTEGER) + 1) AS level, list_extract(['cold', 'warm', 'assimilated'], CAST((doc_id // 3) % 3 AS INTEGER) + 1) AS state, count(*) AS n FROM documents GROUP BY ALL",
    "weighted_choice": "WITH x AS (SELECT CAST('0x' || substr(sha256('11:' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM documents) SELECT CASE WHEN u < 0.35 THEN 'naive' WHEN u < 0.75 THEN 'topical' ELSE 'contextual' END AS choice, count(*) AS n FROM x GROUP BY 1",
    "diverse_selection": "WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT doc_id, source, n_chars FROM r WHERE k <= 2 ORDER BY k, n_chars DESC, doc_id LIMIT 60",
    "fallback_ranking": "WITH p AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 1 LIMIT 1) SELECT d.doc_id AS key, d.source AS vendor, d.n_chars AS score FROM documents d, p WHERE d.doc_id <> p.doc_id ORDER BY d.source <> p.source, abs(d.n_chars - p.n_chars), d.doc_id LIMIT 20",
    "split_disjointness": "SELECT 'test' AS a, 'train' AS b, count(*) AS n_shared FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'test', 'val', count(*) FROM documents WHERE doc_id % 15 = 0 UNION ALL SELECT 'train', 'val', count(*) FROM documents WHERE doc_id % 6 = 0",
    "annotator_agreement": "SELECT doc_id, quality AS \"first\", toxic AS second FROM labels",
    "span_iou_by_conv": _iou("doc_id"),
    "span_iou_pooled": _iou(""),
    "span_overlaps": f"WITH {_REV}, {_SPANS}, x AS (SELECT *, lead(injection_id) OVER w AS next_id, lead(s) OVER w AS ns FROM sp WINDOW w AS (PARTITION BY doc_id, revision_index ORDER BY s, e, injection_id)) SELECT doc_id, revision_index, injection_id, next_id FROM x WHERE ns < e",
    "span_boundary_errors": f"WITH {_REV}, {_SPANS}, x AS (SELECT *, doc_id % 5 - 1 AS a, revision_index % 3 AS b FROM sp) "
    + _broken("boundary", "x", ("s < 0", "'start ' || s || ' is negative'"), ("e > length(text)", "'end ' || e || ' exceeds text length ' || length(text)"), ("s > e", "'start lies after end'"), ("a < 0", "'start sentence ' || a || ' is negative'"), ("a > b", "'start sentence lies after end sentence'")),
    "span_content_errors": rf"WITH {_REV}, {_SPANS}, x AS (SELECT *, CASE WHEN s >= length(text) THEN 'start exceeds text length' WHEN e > length(text) THEN 'end exceeds text length' WHEN s < 0 THEN 'start is negative' WHEN s > e THEN 'start lies after end' WHEN regexp_replace(substr(text, s + 1, e - s), '^\s+|\s+$', '', 'g') = '' THEN 'content is empty or blank' END AS message FROM sp WHERE inj) SELECT doc_id, revision_index, injection_id, 'span_content' AS error_type, message FROM x WHERE message IS NOT NULL",
    "span_constraints": f"WITH {_REV}, {_SPANS}, x AS (SELECT doc_id, revision_index, injection_id, inj, state, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE coalesce(level, CASE WHEN doc_id % 5 = 0 THEN 'naive' END) END AS level FROM sp) " + _broken("constraint", "x", ("inj AND NOT (level IS NOT NULL AND state IS NOT NULL)", "'injection label requires level and state'"), ("NOT inj AND (level IS NOT NULL OR state IS NOT NULL)", "'anomaly label forbids level and state'")),
    "flag_consistency": f"WITH {_REV}, {_SPANS} " + _broken("ambiguity", "sp", ("state = 'warm' AND flag = 'none'", "'warm requires at least low'"), ("state = 'assimilated' AND flag IN ('none', 'low')", "'assimilated requires at least medium'")),
    "metadata_errors": f"WITH {_REV}, {_SPANS} " + _broken("consistency", "sp", ("inj AND doc_id % 2 <> 0", "'missing provenance_hash'"), ("inj AND doc_id % 3 = 0", "'missing prompt_hash'")),
    "boundary_erosion": f"WITH {_REV}, {_SPANS} SELECT a.doc_id, a.injection_id, a.revision_index, round(least(1.0, avg((abs(b.s - a.s) + abs(b.e - a.e)) * 1.0 / greatest(a.e - a.s, 1))), 6) AS erosion, count(*) AS n_later FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND a.injection_id = b.injection_id AND b.revision_index > a.revision_index GROUP BY ALL",
    "state_monotonicity": f"WITH {_REV}, {_SPANS}, x AS (SELECT *, list_position(['cold', 'warm', 'assimilated'], state) AS r FROM sp WHERE inj), y AS (SELECT *, lag(r) OVER w AS b, lag(state) OVER w AS bs FROM x WINDOW w AS (PARTITION BY doc_id, injection_id ORDER BY revision_index)) SELECT doc_id, revision_index, injection_id, 'trajectory_monotonicity' AS error_type, bs || ' -> ' || state AS message FROM y WHERE b > r",
    "earned_labels": f"WITH {_REV}, {_SPANS}, {_TRACE}, x AS (SELECT *, CASE WHEN size > 6 THEN rr ELSE 0 END AS q FROM sg0 WHERE state IN ('warm', 'assimilated')) "
    + _broken("earned_label", "x", ("state = 'warm' AND size < 3", "'warm requires 3 events'"), ("state = 'warm' AND abs(q) < 0.3 AND size > 6", "'warm requires coupling 0.3'"), ("state = 'assimilated' AND flag = 'none'", "'assimilated cannot have flag none'"), ("state = 'assimilated' AND size < 5", "'assimilated requires 5 events'"), ("state = 'assimilated' AND abs(q) < 0.55", "'assimilated requires coupling 0.55'"), ("state = 'assimilated' AND rises", "'glucose increased'")),
    "earned_flags": f"WITH {_REV}, {_SPANS}, {_TRACE}, er AS (SELECT a.doc_id, a.injection_id, a.revision_index, round(least(1.0, avg((abs(b.s - a.s) + abs(b.e - a.e)) * 1.0 / greatest(a.e - a.s, 1))), 6) AS erosion FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND a.injection_id = b.injection_id AND b.revision_index > a.revision_index GROUP BY ALL), x AS (SELECT sig.*, erosion, abs(coupling) AS q FROM sig LEFT JOIN er USING (doc_id, injection_id, revision_index) WHERE starts_with(label, 'injection.')) "
    + _broken("earned_ambiguity", "x", ("flag = 'none' AND state <> 'cold'", "'none requires cold'"), ("flag = 'low' AND state <> 'warm'", "'low requires warm'"), ("flag = 'low' AND size < 3", "'low requires 3 events'"), ("flag IN ('medium', 'high') AND state <> 'assimilated'", "flag || ' requires assimilated'"), ("flag = 'medium' AND q < 0.3", "'medium requires coupling 0.3'"), ("flag = 'high' AND q < 0.5", "'high requires coupling 0.5'"), ("flag = 'medium' AND erosion < 0.1", "'medium requires erosion 0.1'"), ("flag = 'high' AND erosion < 0.25", "'high requires erosion 0.25'")),
    "span_leakage": rf"WITH {_REV}, {_SPANS}, x AS (SELECT *, 'Here is it. ' || text || ' as an AI ' AS body FROM sp WHERE inj) SELECT doc_id, revision_index, injection_id, 'prompt_leakage' AS error_type, '(?i)\bas an ai\b' AS message FROM x WHERE regexp_matches(body, '(?im)\bas an ai\b') UNION ALL SELECT doc_id, revision_index, injection_id, 'prompt_leakage', '(?i)^here is\b' FROM x WHERE regexp_matches(body, '(?im)^here is\b')",
    "text_insertion": """WITH """ + _REV + """, x AS (SELECT doc_id, revision_index, text, length(text) AS n, length(text) // 2 AS p1, length(text) // 3 AS p2, length(text) // 4 AS p3 FROM rev),
a AS (SELECT *, text[1:p1] || ' FIRST ' || text[p1 + 1:] AS t1, least(p2 + 7, n + 7) AS q2 FROM x),
b AS (SELECT *, t1[1:q2] || ' SECOND é ' || t1[q2 + 1:] AS t2, p3 + 17 AS q3 FROM a),
c AS (SELECT *, t2[1:q3] || ' THIRD ' || t2[q3 + 1:] AS t3 FROM b)
SELECT doc_id, revision_index, md5(t3) AS text_md5, 'i1' AS injection_id, CAST(p1 AS INTEGER) AS "start", CAST(p1 + 7 AS INTEGER) AS "end" FROM c
UNION ALL SELECT doc_id, revision_index, md5(t3), 'i2', CAST(q2 AS INTEGER), CAST(q2 + 10 AS INTEGER) FROM c
UNION ALL SELECT doc_id, revision_index, md5(t3), 'i3', CAST(q3 AS INTEGER), CAST(q3 + 7 AS INTEGER) FROM c""",
    "causal_signatures": f"WITH {_REV}, {_SPANS}, {_TRACE} SELECT doc_id, revision_index, injection_id, locality, coupling, plausible FROM sig",
    "signature_anomalies": f"WITH {_REV}, {_SPANS}, {_TRACE}, x AS (SELECT *, CASE WHEN locality > 4.5 THEN 'anomaly.process_violation' WHEN abs(coupling) < 0.2 THEN 'anomaly.no_resource_coupling' END AS a FROM sig WHERE starts_with(label, 'injection.')) SELECT doc_id, revision_index, 'anom_' || substr(injection_id, 1, 8) AS injection_id, a AS label, 'high' AS flag FROM x WHERE a IS NOT NULL",
    "signature_states": f"WITH {_REV}, {_SPANS}, {_TRACE}, x AS (SELECT doc_id, revision_index, injection_id, CASE WHEN plausible AND abs(coupling) > 0.7 THEN 'assimilated' WHEN abs(coupling) >= 0.4 AND locality <= 4.5 THEN 'warm' ELSE 'cold' END AS state FROM sig) SELECT *, CASE state WHEN 'assimilated' THEN 'high' WHEN 'warm' THEN 'medium' ELSE 'none' END AS flag FROM x",
    "trace_summary": f"WITH {_REV}, {_SPANS}, {_TRACE} SELECT doc_id, revision_index, count(*) AS n, round(min(least), 6) AS least_glucose, round(coalesce(avg(CASE WHEN locality > 0 THEN locality END), 0), 6) AS mean_locality, round(avg(CASE WHEN plausible THEN 1.0 ELSE 0 END), 6) AS plausible_share FROM sig GROUP BY ALL",
    "cosine_consecutive": "WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, label, round(list_cosine_similarity(b, e), 5) AS cosine FROM x WHERE b IS NOT NULL",
    "cosine_by_label": "WITH u AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS k FROM embeddings), m AS (SELECT label, k, avg(x) AS m FROM u GROUP BY ALL), c AS (SELECT label, list(m ORDER BY k) AS c FROM m GROUP BY label) SELECT label, round(avg(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c)), 5) AS mean_cosine, count(*) AS n FROM embeddings JOIN c USING (label) GROUP BY label",
    "revenue_topk": "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20",
    "priority_pivot": "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
}

_TIMED = f"""tm AS (SELECT project AS doc_id, row_number() OVER ({_ORDER}) - 1 AS k, epoch_us(ts) AS us, length(coalesce(props, '') || ' ' || repeat('x', CAST(floor(value) AS BIGINT))) AS size FROM log JOIN (SELECT event_id AS tie, props, value FROM events) USING (tie)),
st AS (SELECT doc_id, k, (us - lag(us) OVER w) / 1000.0 AS ms, size - lag(size) OVER w AS delta, (us - min(us) OVER (PARTITION BY doc_id)) // 60000000 AS minute FROM tm WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
sp AS (SELECT * FROM st WHERE ms > 0),
mr AS (SELECT doc_id, minute, CAST(sum(delta) AS BIGINT) AS chars FROM sp WHERE delta > 0 GROUP BY ALL),
rr AS (SELECT *, chars * 1.0 / first_value(chars) OVER (PARTITION BY doc_id ORDER BY minute) AS relative FROM mr)"""
SQL["merged_runs"] = f"WITH {_LOG}, m0 AS (SELECT *, lag(label) OVER ({_ORDER}) AS b FROM log), m1 AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> label THEN 1 ELSE 0 END) OVER ({_ORDER}) - 1 AS run FROM m0) SELECT project, CAST(run AS BIGINT) AS run, min(label) AS label, arg_max(tie, (ts, tie)) AS tie FROM m1 GROUP BY project, run"
SQL["prompt_rows"] = f"WITH {_LOG} SELECT tie, md5('<INPUT><BT>' || label || '</BT> <PWA>' || coalesce(lag(label) OVER ({_ORDER}), 'none') || '</PWA> </INPUT>') AS prompt FROM log"
SQL["calibration_report"] = f"WITH {_LOG}, {_TIMED} SELECT count(*) AS n, round(avg(ms), 3) AS mean_ms, round(median(ms), 3) AS median_ms, round(coalesce(stddev_samp(ms), 0), 3) AS sd_ms, round(avg(CASE WHEN delta <> 0 THEN abs(delta) END), 6) AS mean_delta FROM sp"
SQL["calibration_fit"] = f"WITH {_LOG}, {_TIMED}, f AS (SELECT count(*) AS n, max(minute) > min(minute) AS v, regr_slope(ln(relative), minute) AS b, regr_r2(ln(relative), minute) AS r FROM rr WHERE relative BETWEEN 0.1 AND 2.0) SELECT n, round(CASE WHEN n >= 5 AND v AND b < 0 THEN greatest(0.99, least(0.9999, exp(b / 50))) ELSE 0.9992 END, 6) AS rate, round(CASE WHEN n >= 5 AND v THEN greatest(0, coalesce(r, 0)) ELSE 0 END, 6) AS r2 FROM f"
SQL["calibration_divisor"] = f"WITH {_LOG}, {_TIMED}, x AS (SELECT *, lag(chars) OVER w AS b, sum(chars) OVER (w ROWS UNBOUNDED PRECEDING) AS c, count(*) OVER (PARTITION BY doc_id) AS k FROM mr WINDOW w AS (PARTITION BY doc_id ORDER BY minute)) SELECT doc_id, coalesce(median(CASE WHEN k >= 10 AND (chars - b) * 1.0 / b < -0.05 THEN c / 0.5 END), 12000.0) AS divisor FROM x GROUP BY doc_id"
SQL["process_classes"] = """WITH x AS (SELECT doc_id, doc_id * 7 % 100 / 100.0 AS g, doc_id * 13 % 100 / 100.0 AS f, doc_id * 37 % 100 / 100.0 AS s, doc_id % 90 AS m, doc_id % 3 + 1 AS w FROM documents), y AS (SELECT *, (g + (1 - f)) / 2 AS c FROM x)
SELECT doc_id, CASE WHEN c > 0.75 THEN 'low' WHEN c > 0.5 THEN 'moderate' WHEN c > 0.25 THEN 'high' ELSE 'severe' END AS load,
  CASE WHEN m * 7 < 200 THEN 'low' WHEN m * 7 < 350 THEN 'moderate' WHEN m * 7 < 500 THEN 'high' ELSE 'very high' END AS latency, CASE WHEN m / 20.0 > 3 THEN 'high' WHEN m / 20.0 > 2 THEN 'moderate' ELSE 'low' END AS burst,
  CASE WHEN g > 0.7 THEN 'full' WHEN g > 0.5 THEN 'moderate' WHEN g > 0.3 THEN 'shallow' ELSE 'minimal' END AS ceiling,
  CASE WHEN m <= 25 THEN 'low' WHEN m <= 50 THEN CASE WHEN w = 1 THEN 'low' ELSE 'medium' END WHEN m <= 75 THEN CASE WHEN w = 1 THEN 'medium' ELSE 'high' END ELSE 'high' END AS severity,
  round(least(1.0, 0.5 + g * 0.4 + w * 0.05), 3) AS temperature, CAST(least(4096, floor(1536 + s * 1536) + w * 256) AS INTEGER) AS max_tokens,
  round(least(1.0, greatest(0.3, g * 1.3) * CASE WHEN m / 10.0 > 5 THEN 0.7 ELSE 1 END), 3) AS syntactic FROM y"""
SQL["reply_quality"] = f"WITH x AS (SELECT CASE WHEN coalesce(text, '') = '' THEN 'empty_response' WHEN length(text) < 200 THEN 'too_short_chars' WHEN len({_words('text')}) < 30 THEN 'too_short_words' WHEN contains(lower(text), 'password') THEN 'suspicious_phrase:password' ELSE 'ok' END AS reason FROM documents) SELECT reason, count(*) AS n FROM x GROUP BY reason"
SQL["escaped_texts"] = r"SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>')) AS html, md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\textbackslash{}'), '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'), '{', '\{'), '}', '\}'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), '<', '\textless{}'), '>', '\textgreater{}')) AS tex FROM documents"

_H = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), {k}, 8) AS BIGINT)"
SQL["doc_ids"] = (
    "WITH x AS (SELECT doc_id, source, " + ", ".join(f"{_H.format(k=8 * i + 1)} AS h{i}" for i in range(4)) + " FROM documents) "
    "SELECT doc_id, 'doc_' || substr(sha256('seed:project:' || doc_id), 1, 16) AS hashed_id, 'rev_' || substr(sha256(source || ':' || doc_id), 1, 16) AS rev_id, "
    f"(((h0 % 10000 * {(1 << 32) % 10000} + h1) % 10000 * {(1 << 32) % 10000} + h2) % 10000 * {(1 << 32) % 10000} + h3) % 10000 AS bucket FROM x"
)


_EARNED = SQL["earned_labels"].split("SELECT doc_id, revision_index, injection_id, 'earned_label'", 1)
_FLAGS = SQL["earned_flags"].split("SELECT doc_id, revision_index, injection_id, 'earned_ambiguity'", 1)
_BOUNDS = _broken("boundary", "sp", ("s < 0 OR e > length(text)", "'Offset out of bounds'"))
#: The earned labels of injections alone, under the name that a check of a revision gives them.
_CAUSAL = ("SELECT doc_id, revision_index, injection_id, 'earned_label'" + _EARNED[1]).replace("'earned_label'", "'causal_integrity'").replace(" FROM x WHERE ", " FROM xe WHERE starts_with(label, 'injection.') AND ")
_WITH_CAUSAL = _EARNED[0].replace(", x AS (", ", xe AS (", 1)
_MONOTONE = "m0 AS (SELECT *, list_position(['cold', 'warm', 'assimilated'], state) AS r FROM sp WHERE inj), m1 AS (SELECT *, lag(r) OVER w AS b FROM m0 WINDOW w AS (PARTITION BY doc_id, injection_id ORDER BY revision_index))"
_LEAKED = "SELECT doc_id, revision_index, injection_id, 'prompt_leakage' AS error_type, '' AS message FROM (SELECT *, unnest([" + ", ".join(f"regexp_matches(body, '{_in_lines(p)}')" for p in vocab.LEAKAGE_PATTERNS) + "]) AS hit FROM lk) WHERE hit"
_DAYS = "cal AS (SELECT CAST(range AS DATE) AS bucket FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 {g}))"

SQL |= {
    "revision_checks": f"{_WITH_CAUSAL} {_BOUNDS} UNION ALL {_CAUSAL}",
    "trace_sufficiency": f"WITH {_REV}, {_SPANS}, {_TRACE} " + _broken("trace_sufficiency", "sg0", ("state = 'warm' AND size < 3", "'warm requires 3 events, got ' || size"), ("state = 'assimilated' AND size < 5", "'assimilated requires 5 events, got ' || size")),
    "coupling_support": f"WITH {_REV}, {_SPANS}, {_TRACE} " + _broken("coupling_support", "sig", ("flag = 'high' AND abs(coupling) < 0.5", "'high requires coupling 0.5'"), ("flag = 'medium' AND abs(coupling) < 0.3", "'medium requires coupling 0.3'")),
    "span_iou_every_conv": 'WITH had AS (' + _iou("doc_id") + ') SELECT doc_id, CAST(coalesce(inter, 0) AS BIGINT) AS inter, CAST(coalesce("union", 0) AS BIGINT) AS "union", coalesce(iou, 1) AS iou FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) LEFT JOIN had USING (doc_id)',
    "model_selection": """WITH r AS (SELECT doc_id AS key, source AS vendor, length(source) AS p, n_chars AS score, doc_id % 17 AS cost, doc_id % 17 <= 9 AS fits FROM documents),
v AS (SELECT vendor, row_number() OVER (ORDER BY min(p), vendor) AS v FROM r GROUP BY vendor),
a AS (SELECT r.*, v, row_number() OVER w AS i, sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY vendor ORDER BY score DESC, key ROWS UNBOUNDED PRECEDING) AS a FROM r JOIN v USING (vendor) WINDOW w AS (PARTITION BY vendor ORDER BY score DESC, key)),
b AS (SELECT *, CASE WHEN fits AND a = 1 THEN 1 WHEN fits AND i > 1 AND v <= 6 AND a <= 3 THEN 2 ELSE 3 END AS phase FROM a),
c AS (SELECT *, count(*) FILTER (phase < 3) OVER (PARTITION BY vendor) AS taken, row_number() OVER (PARTITION BY vendor, phase = 3 ORDER BY cost, score DESC, key) AS c FROM b)
SELECT key, vendor, phase FROM c WHERE phase < 3 OR taken + c <= 3 ORDER BY phase, CASE WHEN phase < 3 THEN v END NULLS FIRST, CASE WHEN phase < 3 THEN i END NULLS FIRST, cost, score DESC, key LIMIT 14""",
    "lexical_diversity": "SELECT doc_id, round(len(list_distinct(t)) * 1.0 / nullif(len(t), 0), 4) AS diversity FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS t FROM documents)",
    "composed_hashes": r"SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(replace(replace(nfc_normalize(coalesce(text || ' e' || chr(769) || ' A' || chr(778), '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')), 1, 32) AS hash FROM documents",
    "long_revisions": f"WITH {_REV}, x AS (SELECT doc_id, revision_index, CAST(len({_words('text')}) AS INTEGER) AS n_words FROM rev) SELECT * FROM x WHERE n_words >= 50",
    "labelled_documents": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "document_means": f"WITH {_REV}, p AS (SELECT doc_id, avg(len({_words('text')})) AS w, count(*) AS n FROM rev GROUP BY doc_id) SELECT count(*) AS n_docs, round(avg(w), 6) AS mean_words, round(avg(n), 6) AS mean_revisions FROM p",
    "dashboard_projects": f"WITH {_LOG}, {_DAYS.format(g='DAY')}, k AS (SELECT DISTINCT project FROM log WHERE label <> 'error' AND ts >= '2024-01-01' AND ts < '2024-02-01'), c AS (SELECT project, CAST(date_trunc('day', ts) AS DATE) AS bucket, count(*) AS n FROM log WHERE label <> 'error' GROUP BY ALL) SELECT CAST(project AS VARCHAR) AS key, bucket, coalesce(n, 0) AS n FROM k CROSS JOIN cal LEFT JOIN c USING (project, bucket)",
    "dashboard_authors": f"WITH {_LOG}, {_DAYS.format(g='WEEK')}, k AS (SELECT DISTINCT author FROM log WHERE ts >= '2024-01-01' AND ts < '2024-02-01'), c AS (SELECT author, CAST(date_trunc('week', ts) AS DATE) AS bucket, count(*) AS n FROM log WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY ALL) SELECT CAST(author AS VARCHAR) AS key, bucket, coalesce(n, 0) AS n FROM k CROSS JOIN cal LEFT JOIN c USING (author, bucket)",
    "present_labels": f"WITH {_LOG} SELECT label, count(*) AS n FROM log WHERE tie % 7 <> 0 AND label NOT IN ('view', 'click') GROUP BY label",
    "local_places": f"WITH {_LOG} SELECT project, author, tie, row_number() OVER (PARTITION BY project, author ORDER BY ts, tie) - 1 AS index FROM log",
    "gantt_bars": f"WITH {_LOG}, {_runs()} SELECT r.project, r.run, r.label, a.ts AS start_ts, b.ts AS end_ts, r.length FROM runs r JOIN f1 a ON a.project = r.project AND a.place = r.first JOIN f1 b ON b.project = r.project AND b.place = r.last",
    "validation_report": _WITH_CAUSAL
    + ", "
    + _FLAGS[0].split(_TRACE + ", ", 1)[1]
    + f", {_MONOTONE}, lk AS MATERIALIZED (SELECT doc_id, revision_index, injection_id, substr(text, s + 1, e - s) AS body FROM sp WHERE inj AND s >= 0 AND e <= length(text)), every AS ({_LEAKED} UNION ALL {_BOUNDS} UNION ALL {_CAUSAL} UNION ALL SELECT doc_id, revision_index, injection_id, 'earned_ambiguity'"
    + _FLAGS[1]
    + " UNION ALL SELECT doc_id, revision_index, injection_id, 'trajectory_monotonicity', '' FROM m1 WHERE b > r) SELECT error_type, count(*) AS n FROM every GROUP BY error_type ORDER BY n DESC, error_type LIMIT 20",
}


def _md5_mod(key: str, n: int) -> str:
    h = [f"CAST('0x' || substr(md5({key}), {8 * k + 1}, 8) AS BIGINT)" for k in range(4)]
    s = (1 << 32) % n
    return f"(((({h[0]} % {n} * {s} + {h[1]}) % {n} * {s} + {h[2]}) % {n} * {s}) + {h[3]}) % {n}"


def _pick(key: str, options: tuple[str, ...]) -> str:
    return "list_extract([" + ", ".join(f"'{o}'" for o in options) + f"], CAST({_md5_mod(key, len(options))} AS INTEGER) + 1)"


def _html(t: str, line_end: str) -> str:
    return f"replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '{line_end}')"


def _framed(op: int, t: str) -> str:
    t = _html(t, "&para;<br>")
    t = f"CASE WHEN regexp_full_match({t}, '[\\s\\x0B\\x85\\xA0]+') THEN replace({t}, ' ', '&nbsp;') ELSE {t} END"
    tag, colour = vocab.REPLAY_MARKS.get(op, ("span", ""))
    return f"'<{tag}" + (f' style="background:{colour};"' if colour else "") + f">' || {t} || '</{tag}>'"


#: Lines of documents with the number of their paragraph, 0 for blank ones.
_LINES = r"""ln0 AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
ln1 AS (SELECT doc_id, generate_subscripts(a, 1) AS line, unnest(a) AS t FROM ln0),
ln2 AS (SELECT *, trim(t, ' ') = '' AS blank, regexp_matches(t, '^\s*\\(paragraph|subsection|subsubsection)\{') AS head FROM ln1),
ln3 AS (SELECT *, NOT blank AND (head OR coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line), true)) AS begins FROM ln2),
ln AS (SELECT doc_id, line, CASE WHEN blank THEN 0 ELSE CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS INTEGER) END AS paragraph FROM ln3)"""
_BEFORE = f"lag(text) OVER ({_DOCW})"
_REPAIR_KEY = "concat_ws(':', source, way, printf('%.4f', g), CAST(doc_id AS VARCHAR))"
_CHARS = "list_distinct(string_split({t}, ''))"
_REPORT = """x AS (SELECT quality * 0.9 AS g, toxic * 0.8 AS p, doc_id % 40 * 25 AS place FROM labels),
c AS (SELECT count(*) FILTER (g > 0.6 AND p > 0.6) AS tp, count(*) FILTER (g <= 0.6 AND p > 0.6) AS fp, count(*) FILTER (g > 0.6 AND p <= 0.6) AS fn, count(*) AS n FROM x),
u AS (SELECT count(DISTINCT place) AS m FROM x)"""

SQL |= {
    "replay_frames": f"WITH {_REV} SELECT doc_id, revision_index, md5(" + " || ".join([_framed(op, f"substr(text, {9 * k + 1}, 9)") for k, op in enumerate((1, -1, 2, 3, 4))] + [_framed(0, "substr(text, 55)"), _framed(0, "'  '")]) + ") AS html_md5 FROM rev",
    "rendered_diffs": f"WITH {_REV} SELECT doc_id, revision_index, md5({_html('substr(text, 1, 20)', '<br>')} || '<del>' || {_html('substr(text, 21, 15)', '<br>')} || '</del><ins>' || {_html('substr(text, 36, 15)', '<br>')} || '</ins>' || {_html('substr(text, 51)', '<br>')}) AS html_md5 FROM rev",
    "annotation_cards": f"WITH {_REV}, {_SPANS}, {_TRACE}, c AS (SELECT doc_id, revision_index, injection_id, CAST(count(*) FILTER (bad AND fixed) AS INTEGER) AS repairs, max_by(glucose, i) AS g, CAST(count(*) AS INTEGER) AS n_events FROM ev GROUP BY ALL) "
    'SELECT doc_id, revision_index, injection_id, s AS start, e AS "end", coalesce(state, \'unknown\') AS state, coalesce(level, \'unknown\') AS level, label, repairs, round(g, 3) AS final_glucose, n_events FROM sp JOIN c USING (doc_id, revision_index, injection_id)',
    "project_titles": f"WITH {_LOG}, p AS (SELECT DISTINCT project FROM log) SELECT project, 'Project ' || row_number() OVER (ORDER BY project) AS title FROM p",
    "paragraph_lines": f"WITH {_LINES} SELECT doc_id, CAST(max(line) AS INTEGER) AS n_lines, max(paragraph) AS n_paragraphs FROM ln GROUP BY doc_id",
    "lines_in_paragraphs": f"WITH {_LINES}, rg AS (SELECT doc_id, paragraph, min(line) AS a, max(line) AS b FROM ln WHERE paragraph > 0 GROUP BY ALL), "
    "q AS (SELECT DISTINCT doc_id, CAST(unnest([doc_id % 7 + 1, 9, 100000]) AS INTEGER) AS line FROM documents) "
    "SELECT q.doc_id, q.line, paragraph, CAST(a AS INTEGER) AS first_line, CAST(b AS INTEGER) AS last_line FROM q LEFT JOIN rg ON rg.doc_id = q.doc_id AND q.line BETWEEN a AND b",
    "sentence_counts": r"WITH x AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\s\x0B\x1c-\x1f\x85\xA0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS a FROM documents) "
    r"SELECT doc_id, CAST(len(list_filter(a, lambda t: regexp_replace(t, '\s', '', 'g') <> '')) AS INTEGER) AS n_sentences FROM x",
    "repair_choices": "WITH x AS (SELECT doc_id, source, doc_id * 7 % 100 / 100.0 AS g, list_extract(['lexical_starvation', 'syntactic_collapse', 'cognitive_overflow'], CAST(doc_id % 3 AS INTEGER) + 1) AS way FROM documents) "
    f"SELECT doc_id, CASE way WHEN 'lexical_starvation' THEN (CASE WHEN lower(source) = 'web' THEN {_pick(_REPAIR_KEY, ('site', 'page'))} ELSE {_pick(_REPAIR_KEY, vocab.REPAIRS['lexical_starvation'])} END) || ' ' "
    f"WHEN 'syntactic_collapse' THEN {_pick(_REPAIR_KEY, vocab.REPAIRS['syntactic_collapse'])} ELSE 'it ' END AS repair, CAST(doc_id % 3 + 1 AS INTEGER) AS distance FROM x",
    "state_samples": "WITH x AS (SELECT doc_id, source, doc_id % 50 AS k, doc_id * 7 % 100 / 100.0 AS g, doc_id * 13 % 100 / 100.0 AS f, doc_id % 9 AS demand FROM documents) "
    "SELECT doc_id, CAST(floor(k / 50.0 * 90) AS INTEGER) AS minute, round(f, 3) AS fatigue, round(g, 4) AS glucose, round(least(1.0, g * (1 - f * 0.4)), 3) AS lexical, "
    "round(least(1.0, greatest(0.3, g * 1.3) * CASE WHEN demand > 5 THEN 0.7 ELSE 1.0 END), 3) AS syntactic, round(least(1.0, greatest(0.1, g - f * 0.5)), 3) AS clarity, "
    "sha256(source || ':' || printf('%.6f', g) || ':' || k) AS salt FROM x",
    "placeholder_texts": "SELECT doc_id, " + " || ' ' || ".join(_pick(f"(doc_id || ':{name}')", tuple(f"{word} {k}" for k in range(3))) for name, word in (("intro", "intro"), ("body", "body"), ("conclusion", "end"))) + " AS text FROM documents",
    "session_minutes": "WITH x AS (SELECT doc_id, CAST(floor(doc_id % 50 / 50.0 * 90) AS INTEGER) AS minute FROM documents) SELECT doc_id, minute, round(least((0.10 + minute / 90.0 * 0.70) * (doc_id % 3 + 1), 0.95), 6) AS chance FROM x",
    "hashed_names": "SELECT doc_id, 'author_' || substr(sha256(source), 1, 16) AS author, 'inj_' || substr(sha256(doc_id || ':' || lang || ':' || printf('%.2f', doc_id % 40 / 8.0) || ':' || printf('%.2f', doc_id % 16 / 16.0)), 1, 16) AS causal, substr(sha256(source || ':' || doc_id), 1, 32) AS cache FROM documents",
    "character_overlap": f"WITH {_REV}, x AS (SELECT *, {_BEFORE} AS b FROM rev), y AS (SELECT doc_id, revision_index, list_filter({_CHARS.format(t='b')}, lambda c: c <> '') AS p, list_filter({_CHARS.format(t='text')}, lambda c: c <> '') AS q FROM x WHERE b IS NOT NULL) "
    "SELECT doc_id, revision_index, round(CASE WHEN len(p) + len(q) = 0 THEN 1.0 ELSE len(list_intersect(p, q)) * 1.0 / (len(p) + len(q) - len(list_intersect(p, q))) END, 6) AS jaccard FROM y",
    "insertion_checks": f"WITH {_REV}, {_SPANS}, x AS (SELECT doc_id, revision_index, injection_id, length(text) AS n, s, e, split_part(text, ' ', 1) AS word, substr(text, s + 1, greatest(e - s, 0)) AS body FROM sp) "
    "SELECT doc_id, revision_index, injection_id, 'bounds' AS reason FROM x WHERE s < 0 OR e > n OR s >= e UNION ALL SELECT doc_id, revision_index, injection_id, 'content' FROM x WHERE NOT contains(body, word) "
    "UNION ALL SELECT doc_id, revision_index, injection_id, 'blank' FROM x WHERE regexp_replace(body, '\\s', '', 'g') = ''",
    "label_kinds": f"WITH {_REV}, {_SPANS}, x AS (SELECT label FROM sp UNION ALL SELECT list_extract(['Clarity', 'Idea Generation', 'none'], CAST(event_id % 3 AS INTEGER) + 1) FROM events) "
    "SELECT split_part(label, '.', 1) AS kind, label IN (" + ", ".join(f"'{v}'" for v in vocab.WRITING_INTENTIONS) + ") AS valid, array_to_string(list_transform(string_split(label, ' '), lambda w: w[1]), '.') AS initials, count(*) AS n FROM x GROUP BY ALL",
    "first_arrays": r"SELECT doc_id, md5(regexp_extract('x [' || text || '] y', '\[[\s\S]*\]', 0)) AS array_md5 FROM documents",
    "leakage_pattern_counts": f"WITH {_REV}, x AS (SELECT 'Here is it. ' || text || ' as an AI ' AS t FROM rev), y AS (" + " UNION ALL ".join(f"SELECT '{p.replace(chr(39), chr(39) * 2)}' AS pattern FROM x WHERE regexp_matches(t, '{p.replace('(?i)', '(?im)').replace(chr(39), chr(39) * 2)}')" for p in vocab.LEAKAGE_PATTERNS) + ") SELECT pattern, count(*) AS n FROM y GROUP BY pattern",
    "evaluation_report": f"WITH {_REPORT} SELECT round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, CASE WHEN m = 0 THEN 1.0 ELSE 0.5 END AS span_iou, n FROM c, u",
}
SQL["edit_stream_tokens"] = f"""WITH {_LOG}, {_STREAM}
SELECT project, tie, kind, CAST(height AS BIGINT) AS height, undone,
       md5(CASE WHEN kind = 'copy' THEN {_place_after("text[1 : greatest(instr(text, selection) - 1, 0)]")} || ', ' || selection
                WHEN kind = 'undo' AND undone IS NULL THEN 'All lines are the same' ELSE {_change("was_text", "is_text")} END) AS token_md5
FROM st6"""
_BLANK = r"[\s\x0B\x1c-\x1f\x85\xA0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQL["sentence_offsets"] = rf"""WITH x AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])({_BLANK})([A-Z])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), chr(1)) AS p FROM documents),
y AS (SELECT doc_id, p, list_transform(p, lambda q: length(q)) AS n, unnest(range(0, len(p), 2)) AS i FROM x),
z AS (SELECT doc_id, i, coalesce(list_sum(n[1 : i]), 0) + n[i + 1] - length(regexp_replace(p[i + 1], '^{_BLANK}', '')) AS s, length(regexp_replace(p[i + 1], '^{_BLANK}|{_BLANK}$', '', 'g')) AS size FROM y)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS k, CAST(s AS INTEGER) AS start, CAST(s + size AS INTEGER) AS "end" FROM z WHERE size > 0"""
SQL["span_content_totals"] = rf"""WITH {_REV}, {_SPANS}, f AS (SELECT injection_id, min(substr(text, s + 1, 8)) AS x FROM sp WHERE revision_index = 0 GROUP BY injection_id),
v AS (SELECT s >= length(text) OR e > length(text) OR s < 0 OR s > e OR regexp_replace(substr(text, s + 1, greatest(e - s, 0)), '^\s+|\s+$', '', 'g') = '' OR coalesce(NOT contains(substr(text, s + 1, greatest(e - s, 0)), x), false) AS failed FROM sp LEFT JOIN f USING (injection_id) WHERE inj)
SELECT (SELECT count(DISTINCT doc_id) FROM rev) AS documents_checked, (SELECT count(*) FROM rev) AS revisions_checked, count(*) AS spans_verified, count(*) FILTER (failed) AS spans_failed, round(coalesce(count(*) FILTER (failed) / nullif(count(*), 0), 0), 6) AS failure_rate FROM v"""
_LEAKED = [(p, p.replace("(?i)", "(?im)").replace("'", "''")) for p in vocab.LEAKAGE_PATTERNS]
SQL["leakage_totals"] = f"""WITH {_REV}, {_SPANS}, b AS (SELECT CASE WHEN revision_index % 2 = 0 THEN 'Here is it. ' || text || ' as an AI ' ELSE text END AS body FROM sp WHERE inj)
SELECT 'spans_checked' AS metric, count(*) AS n FROM b UNION ALL SELECT 'spans_with_leakage', count(*) FROM b WHERE {" OR ".join(f"regexp_matches(body, '{m}')" for _, m in _LEAKED)}
UNION ALL SELECT metric, count(*) FROM ({" UNION ALL ".join(f"SELECT 'pattern:{p.replace(chr(39), chr(39) * 2)}' AS metric FROM b WHERE regexp_matches(body, '{m}')" for p, m in _LEAKED)}) GROUP BY metric"""
SQL["spans_with_anomalies"] = f"""WITH {_REV}, {_SPANS}, {_TRACE}, x AS (SELECT doc_id, revision_index, injection_id, CASE WHEN locality > 4.5 THEN 'anomaly.process_violation' WHEN abs(coupling) < 0.2 THEN 'anomaly.no_resource_coupling' END AS a FROM sig)
SELECT doc_id, revision_index, injection_id, label, level, state, flag, s AS start, e AS "end" FROM sp
UNION ALL SELECT doc_id, revision_index, 'anom_' || substr(injection_id, 1, 8), a, NULL, NULL, 'high', s, e FROM sp JOIN x USING (doc_id, revision_index, injection_id) WHERE inj AND a IS NOT NULL"""
SQL["document_trajectory"] = f"""WITH {_REV}, {_SPANS}, {_TRACE},
h AS (SELECT doc_id, revision_index, count(*) AS n, count(*) FILTER (state = 'cold') AS cold, count(*) FILTER (state = 'warm') AS warm, count(*) FILTER (state = 'assimilated') AS assimilated FROM sp GROUP BY ALL),
t AS (SELECT doc_id, revision_index, avg(locality) AS l, avg(coupling) AS c, bool_and(plausible) AS p FROM sig GROUP BY ALL),
g AS (SELECT doc_id, revision_index, min(glucose) FILTER (i = size AND glucose <> 0) AS g, count(*) FILTER (bad AND fixed) AS repairs FROM ev GROUP BY ALL),
k AS (SELECT DISTINCT doc_id, revision_index FROM rev), z AS (SELECT * FROM k LEFT JOIN h USING (doc_id, revision_index) LEFT JOIN t USING (doc_id, revision_index) LEFT JOIN g USING (doc_id, revision_index))
SELECT doc_id, count(*) AS n_revisions, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_spans, CAST(coalesce(sum(cold), 0) AS BIGINT) AS cold, CAST(coalesce(sum(warm), 0) AS BIGINT) AS warm, CAST(coalesce(sum(assimilated), 0) AS BIGINT) AS assimilated,
       CAST(coalesce(sum(repairs), 0) AS BIGINT) AS repairs, round(arg_max(least(1.0, coalesce(g, 1.0)), revision_index), 6) AS final_glucose, round(coalesce(avg(l) FILTER (l <> 0), 0), 6) AS mean_locality,
       round(coalesce(avg(c) FILTER (c <> 0), 0), 6) AS mean_coupling, round(avg(CASE WHEN coalesce(p, true) THEN 1.0 ELSE 0.0 END), 6) AS plausible_share FROM z GROUP BY doc_id"""
_OVERVIEW = """WITH {log}, cal AS (SELECT CAST(range AS DATE) AS bucket FROM range(DATE '{lo}', DATE '{hi}', INTERVAL 1 {g})), w AS (SELECT * FROM log WHERE ts >= '{lo}' AND ts < '{hi}'),
k AS (SELECT DISTINCT project FROM w), c AS (SELECT project, CAST(date_trunc('{g}', ts) AS DATE) AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT CAST(project AS VARCHAR) AS key, bucket, coalesce(n, 0) AS n FROM k CROSS JOIN cal LEFT JOIN c USING (project, bucket)"""
SQL["overview_week"] = _OVERVIEW.format(log=_LOG, lo="2024-01-15", hi="2024-01-22", g="day")
SQL["overview_month"] = _OVERVIEW.format(log=_LOG, lo="2024-01-01", hi="2024-02-01", g="day")
SQL["overview_year"] = _OVERVIEW.format(log=_LOG, lo="2024-01-01", hi="2025-01-01", g="month")
SQL["period_forms"] = """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders),
x AS (SELECT strftime(day, '%Y-W%W') AS form, date_trunc('week', day) AS s, date_trunc('week', day) + INTERVAL 7 DAY AS e, 'day' AS grain FROM o
      UNION ALL SELECT strftime(day, '%Y-%m'), date_trunc('month', day), date_trunc('month', day) + INTERVAL 1 MONTH, 'day' FROM o
      UNION ALL SELECT strftime(day, '%Y-%m-%d'), day, day + INTERVAL 1 YEAR, 'month' FROM o)
SELECT form, CAST(s AS DATE) AS start, CAST(e AS DATE) AS "end", grain, count(*) AS n FROM x GROUP BY ALL"""
SQL["consented_find"] = f"WITH {_LOG} SELECT project, author, ts, tie, label FROM log WHERE label IN ('purchase', 'error') AND author IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ORDER BY ts DESC, tie DESC LIMIT 100 OFFSET 50"
SQL["passage_prompts"] = """WITH x AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, CAST(floor(length(coalesce(text, '')) * 2 / 5.0) AS INTEGER) AS s, CAST(floor(length(coalesce(text, '')) * 3 / 5.0) AS INTEGER) AS e FROM documents),
p AS (SELECT doc_id, 'naive' AS level, 'Write a scholarly paragraph about academic research. Maintain formal register.' AS prompt FROM x
      UNION ALL SELECT doc_id, 'topical', 'Write a scholarly paragraph about ' || source || ' in the field of ' || lang || '. Maintain formal register.' FROM x
      UNION ALL SELECT doc_id, 'contextual', 'In the ' || source || ' section, write content that bridges the following passages:' || chr(10) || chr(10) || 'Preceding: ' || right(substr(t, 1, s), 500) || chr(10) || chr(10)
        || 'Following: ' || substr(t, e + 1, 500) || chr(10) || chr(10) || 'Maintain formal academic register.' FROM x)
SELECT doc_id, level, CAST(length(prompt) AS INTEGER) AS n_chars, substr(sha256(prompt), 1, 16) AS prompt_hash FROM p"""
SQL["sessions_similarity"] = f"""WITH log AS (SELECT CAST(user_id % 5 + 1 AS INTEGER) AS project, ts, event_id AS tie, value FROM events),
p AS (SELECT *, row_number() OVER w AS k, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0 AS gap, coalesce(least(value, lag(value) OVER w) / nullif(greatest(value, lag(value) OVER w), 0), 1) AS likeness FROM log WINDOW w AS ({_ORDER})),
c AS (SELECT *, CASE WHEN k = 1 THEN NULL WHEN gap > 10 THEN 'gap' WHEN likeness < 0.5 THEN 'similarity' END AS cause FROM p),
s AS (SELECT *, count(cause) OVER ({_ORDER}) AS session FROM c)
SELECT a.project, a.session, min(a.ts) AS start_ts, count(*) AS n, (SELECT any_value(cause) FROM s b WHERE b.project = a.project AND b.session = a.session + 1 AND b.cause IS NOT NULL) AS closed_by FROM s a GROUP BY a.project, a.session"""
