"""DuckDB SQL for the operators that SQL can express, written from their
definitions."""

from __future__ import annotations

from . import embedding_dedup, filter_audit, line_runs, mixing, secret_scan

_Q = "'"


def _text(s: str) -> str:
    return _Q + s.replace(_Q, _Q * 2) + _Q


def mixing_sql() -> str:
    """Sources filled in the order of the level that fills them; offers of all
    sources in one order by virtual finish time; one running sum."""
    w1, w2, w3 = mixing.WEIGHTS
    return f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                 CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS mixed FROM documents),
sources AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, {mixing.CAP}.0 * source_size AS cap, CASE (place - 1) % 3 WHEN 0 THEN {w1}.0::DOUBLE WHEN 1 THEN {w2}.0::DOUBLE ELSE {w3}.0::DOUBLE END AS weight FROM sources),
ordered AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS FIRST) AS k FROM weighed),
levels AS (SELECT o.*, (CAST((SELECT sum(source_size) FROM ordered) AS DOUBLE) * {mixing.SHARE}::DOUBLE
                        - coalesce((SELECT sum(CAST(cap AS DOUBLE)) FROM ordered p WHERE p.k < o.k), 0))
                       / (SELECT sum(weight) FROM ordered p WHERE p.k >= o.k) AS level FROM ordered o),
goal AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM levels WHERE level * weight <= cap ORDER BY k LIMIT 1) * weight, CAST(cap AS DOUBLE))) AS target FROM levels),
queued AS (SELECT s.*, g.source_size, g.target, CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY mixed, doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ahead
           FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
offers AS (SELECT doc_id, source, size, mixed, turn, CAST(turn * source_size + ahead AS DOUBLE) / target AS finish FROM queued, range(0, {mixing.CAP}) t(turn) WHERE size > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, turn, mixed, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM offers),
-- in the merged order, everything up to the offer in which the budget ends (itself if half of it fits)
kept AS (SELECT doc_id, source, size, mixed, count(*) AS copies FROM run
         WHERE upto - size / 2.0 <= (SELECT floor(sum(size) * {min(mixing.SHARE, mixing.CAP)}) FROM sized) AND upto - size < (SELECT floor(sum(size) * {min(mixing.SHARE, mixing.CAP)}) FROM sized)
         GROUP BY doc_id, source, size, mixed)
SELECT q.doc_id, q.source, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, CAST(coalesce(k.copies, 0) * q.size AS BIGINT) AS taken, CAST(coalesce(k.copies, 0) AS INTEGER) AS copies
FROM queued q LEFT JOIN kept k ON k.doc_id IS NOT DISTINCT FROM q.doc_id AND k.source IS NOT DISTINCT FROM q.source AND k.size = q.size AND k.mixed = q.mixed"""


def _spans(text: str, pattern: str, measured: str) -> str:
    """List of {s, e, m}: the matches of a pattern with their places, found from
    the texts between them."""
    m, gaps = f"regexp_extract_all({text}, {_text(pattern)})", f"string_split_regex({text}, {_text(pattern)})"
    ends = f"list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(m[1:i], lambda g: length(g))))"
    return f"(SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST(e[i] - length(m[i]) AS BIGINT), 'e': CAST(e[i] AS BIGINT), 'm': m[i]}}), lambda x: {measured}) FROM (SELECT m, {ends} AS e FROM (SELECT {m} AS m, {gaps} AS gaps)))"


def secrets_sql() -> str:
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    group = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    token = "[A-Za-z0-9+/=_-]+"
    window = secret_scan.WINDOW
    allowed = " OR ".join(f"regexp_matches(x.m, {_text(p)})" for p in secret_scan.ALLOW)
    chars = "string_split(x.m, '')"
    entropy = f"list_max(list_transform(range(1, length(x.m) - {window - 2}), lambda i: list_aggregate({chars}[i:i + {window - 1}], 'entropy')))"
    limit = "CASE " + " ".join(f"WHEN regexp_matches(x.m, {_text(tokens)}) THEN {bits}" for _, tokens, bits in secret_scan.CLASSES) + " END"
    share = lambda letters: f"length(regexp_replace(x.m, '[^{letters}]', '', 'g')) * {secret_scan.CASES} >= length(x.m)"
    mixed = f"(regexp_matches(x.m, '[0-9]') OR ({share('a-z')} AND {share('A-Z')}))"
    kinds = [("assign", _spans("t", assign, f"length(regexp_extract(x.m, {_text(group)}, 1)) >= 8")), ("access", _spans("t", "AKIA[A-Z0-9]+", "length(x.m) >= 16")), ("hex", _spans("t", "[0-9a-f]{32,}", "true"))]
    named = lambda k, i: f"list_transform({k}, lambda x: {{'s': x.s, 'k': {i}, 'e': x.e, 'n': '{k}'}})"
    joined = lambda c: f"array_to_string(list_transform({c}, lambda x: x.n || ':' || x.s || ':' || x.e), ',')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, t, {', '.join(f'{sql} AS {k}' for k, sql in kinds)},
            {_spans('t', token, "length(x.m) >= 20 AND regexp_matches(x.m, '[A-Za-z]')")} AS candidates FROM texts),
base AS (SELECT doc_id, assign, access, hex, candidates, list_sort({' || '.join(named(k, i) for i, (k, _) in enumerate(kinds))}) AS base FROM found),
spans AS (SELECT *, list_filter(candidates, lambda x: {mixed} AND NOT ({allowed}) AND len(list_filter(base, lambda b: b.s < x.e AND x.s < b.e)) = 0 AND {entropy} >= {limit}) AS entropy FROM base)
SELECT doc_id, CAST(len(assign) AS BIGINT) AS n_assign, CAST(len(access) AS BIGINT) AS n_access, CAST(len(hex) AS BIGINT) AS n_hex,
  sha256({joined('base')}) AS base_sha256, {joined("list_sort(base || " + named('entropy', 3) + ")")} AS spans FROM spans"""


def embeddings_sql() -> str:
    """All pairs of a label; the least id reachable by a recursive walk."""
    return f"""
WITH RECURSIVE vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vecs
           WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
          WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {embedding_dedup.COSINE}),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.other),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c ON c.vec_id = e.vec_id LEFT JOIN links l ON l.a = e.vec_id"""


def line_runs_sql() -> str:
    """Lines with their keys as text; a key's documents and its largest id by one
    aggregation."""
    n = line_runs
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM texts),
lines AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM parts),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= {n.LEAST_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {n.LEAST_DOCS}),
judged AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.top AS dropped FROM keyed k LEFT JOIN frequent f ON f.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r"""


def filter_audit_sql() -> str:
    """Every document's failures; each order's removal step by the first filter of
    the order that is failed."""
    names = filter_audit.FILTERS
    words = "list_filter(string_split_regex(t.text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    letters = ", ".join(f"('{x}')" for x in names)
    tables = ", ".join(f"letters l{k}" for k in range(len(names)))
    differ = " AND ".join(f"l{a}.f <> l{b}.f" for a in range(len(names)) for b in range(a))
    return f"""
WITH letters(f) AS (VALUES {letters}),
orders AS (SELECT {' || '.join(f'l{k}.f' for k in range(len(names)))} AS filter_order FROM {tables} WHERE {differ}),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
counted AS (SELECT t.doc_id, t.part, t.text, {words} AS words, t.doc_id > f.first AS repeat, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic
            FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN marks m ON m.doc_id = t.doc_id),
failing AS (SELECT part, good, toxic, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
              || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
              || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN repeat THEN 'E' ELSE '' END AS fails FROM counted),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failing GROUP BY part, fails),
steps AS (SELECT filter_order, step, substr(filter_order, CAST(step AS BIGINT), 1) AS f FROM orders, range(1, {len(names) + 1}) s(step)),
removal AS (SELECT c.*, o.filter_order, coalesce(list_min(list_filter(list_transform(string_split(c.fails, ''), lambda x: instr(o.filter_order, x)), lambda i: i > 0 AND c.fails <> '')), {len(names) + 1}) AS gone FROM cells c, orders o),
rows_ AS (SELECT r.part, s.filter_order, s.step, s.f, sum(n) FILTER (WHERE gone > step) AS kept, sum(n) FILTER (WHERE gone = step) AS removed, sum(n) FILTER (WHERE gone < step AND contains(fails, s.f)) AS redundant,
            sum(n) FILTER (WHERE fails = s.f) AS unique_fails, sum(good) FILTER (WHERE gone = step) AS good_lost, sum(toxic) FILTER (WHERE gone = step) AS toxic_lost
          FROM removal r JOIN steps s ON s.filter_order = r.filter_order GROUP BY r.part, s.filter_order, s.step, s.f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM rows_"""
