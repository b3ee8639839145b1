"""Independent SQL (DuckDB dialect) for the registered queries.

The SQL is written from the operator semantics, not generated from the Spark
plans.  Word lists are the fixed values; patterns are written out here, apart
from those of the operators, so that a wrong one does not pass on both sides.  DuckDB lists are 1-based and its lambdas
are ``lambda x: ...``.
"""

from __future__ import annotations

import math

from ..functions import fixed
from ..functions.tokens import english_stop_words

# White space as Python's str.isspace() has it, and word characters, spelled out.
SPACE = r"\x{09}\x{0A}\x{0B}\x{0C}\x{0D}\x{1C}\x{1D}\x{1E}\x{1F}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EMAIL = r"[\pL\pN_.+-]+@[\pL\pN_.-]+\.[\pL\pN_]+"
ENDS = "^[" + SPACE + "]+|[" + SPACE + "]+$"
TAG = "<[^>]+>"
LINK = "http[^" + SPACE + "]+|www[.][^" + SPACE + "]+"
SPACES = "[" + SPACE + "]+"
FOREIGN = r"[^\x{00}-\x{7F}]+"
TOKEN_RE = r"[\pL\pN_][\pL\pN_]+"
RUN_RE = r"[\pL\pN_]+"


def gap_pattern(patterns) -> str:
    """Python patterns in RE2: white space as above, a dot is all but a line feed."""
    return "|".join("(?:" + p.replace(r"\s", "[" + SPACE + "]") + ")" for p in patterns)


def whole_words(words) -> str:
    return r"(?:^|[^\pL\pN_])(?:" + "|".join(words) + r")(?:[^\pL\pN_]|$)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def stop_list() -> str:
    return str_list(english_stop_words())


def terms_sql(text: str) -> str:
    """List of terms (unigrams after stop words, then bigrams) of ``text``."""
    u = f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), {q(TOKEN_RE)}), lambda t: NOT list_contains({stop_list()}, t))"
    return (f"(SELECT u || list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]) "
            f"FROM (SELECT {u} AS u))")


def tfidf_ctes(max_features: int = fixed.MAX_FEATURES, source: str = "documents") -> str:
    """CTEs: docs, corpus (all benchmark texts are parts of document -1), terms, tf, stats, vocab, nn, idf, w, qv, score."""
    return f"""
docs AS (SELECT doc_id, text FROM {source}),
corpus AS (SELECT doc_id, text FROM docs UNION ALL SELECT CAST(-1 AS BIGINT), text FROM benchmark),
terms AS (SELECT doc_id, {terms_sql('text')} AS t FROM corpus),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM terms) GROUP BY doc_id, term),
stats AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term),
vocab AS (SELECT term, cf, df FROM stats ORDER BY cf DESC, term ASC LIMIT {max_features}),
nn AS (SELECT count(*) + 1 AS n FROM docs),
idf AS (SELECT term, cf, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM vocab, nn),
w0 AS (SELECT tf.doc_id, tf.term, (1.0 + ln(tf.tf)) * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY doc_id),
w AS (SELECT w0.doc_id, w0.term, w0.w / nrm.norm AS w FROM w0 JOIN nrm ON w0.doc_id = nrm.doc_id),
qv AS (SELECT term, w AS qw FROM w WHERE doc_id = -1),
score AS (
  SELECT d.doc_id, round(coalesce(s.dot, 0.0), {fixed.SCORE_DECIMALS}) + 0.0 AS score
  FROM docs d LEFT JOIN (SELECT w.doc_id, sum(w.w * qv.qw) AS dot FROM w JOIN qv ON w.term = qv.term GROUP BY w.doc_id) s
  ON d.doc_id = s.doc_id)"""


def with_tfidf(body: str) -> str:
    """Prefix a statement with the TF-IDF CTEs (``body`` may add more CTEs
    by starting with a comma)."""
    return "WITH " + tfidf_ctes() + ("\n" if not body.lstrip().startswith(",") else "") + body


def sql_rank_topk(k: int = 20) -> str:
    return "WITH " + tfidf_ctes() + f"""
SELECT doc_id, score, rank FROM (
  SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM score)
WHERE rank <= {k}"""


# -- scalar text operators ----------------------------------------------------

def s_text(c: str) -> str:
    return f"coalesce({c}, '')"


def s_strip(c: str) -> str:
    return f"regexp_replace({c}, {q(ENDS)}, '', 'g')"


def s_lines(c: str) -> str:
    return f"string_split({s_text(c)}, chr(10))"


def s_email(c: str) -> str:
    return f"regexp_extract({s_text(c)}, {q(EMAIL)}, 0)"


def s_name(c: str) -> str:
    return (f"coalesce(list_filter(list_transform({s_lines(c)}, lambda l: {s_strip('l')}), "
            f"lambda l: l <> '')[1], {q(fixed.UNKNOWN_NAME)})")


def s_any_contains(c: str, kws) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(k)})" for k in kws) + ")"


def s_skills(c: str, kws=fixed.PARSER_SKILLS) -> str:
    items = ", ".join(f"CASE WHEN contains(lower({s_text(c)}), {q(k)}) THEN {q(k.title())} END" for k in kws)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ', ')"


def s_education(c: str) -> str:
    kws = [k.lower() for k in fixed.EDUCATION_KEYWORDS]
    first = f"list_filter({s_lines(c)}, lambda l: {s_any_contains('lower(l)', kws)})[1]"
    return f"coalesce({s_strip(first)}, '')"


def s_tier(c: str, kws=fixed.PARSER_TIER1) -> str:
    return (f"CASE WHEN {s_any_contains(f'lower({s_text(c)})', kws)} THEN {q(fixed.TIER1_LABEL)} "
            f"ELSE {q(fixed.TIER23_LABEL)} END")


def s_gap(c: str, patterns=fixed.PARSER_GAP_PATTERNS) -> str:
    return (f"CASE WHEN regexp_matches(lower({s_text(c)}), {q(gap_pattern(patterns))}) THEN {q(fixed.GAP_YES)} "
            f"ELSE {q(fixed.GAP_NO)} END")


def s_gender(c: str, female=fixed.PARSER_FEMALE_PATTERN, male=fixed.PARSER_MALE_PATTERN) -> str:
    tl = f"lower({s_text(c)})"
    return (f"CASE WHEN regexp_matches({tl}, {q(female)}) THEN {q(fixed.FEMALE)} "
            f"WHEN regexp_matches({tl}, {q(male)}) THEN {q(fixed.MALE)} ELSE {q(fixed.UNSPECIFIED)} END")


def s_gender_words(c: str) -> str:
    return s_gender(c, whole_words(fixed.PREP_FEMALE_WORDS), whole_words(fixed.PREP_MALE_WORDS))


def s_origin(name: str) -> str:
    nl = f"lower({s_text(name)})"
    return (f"CASE WHEN {s_any_contains(nl, fixed.PARSER_SOUTH_ASIAN)} THEN {q(fixed.SOUTH_ASIAN)} "
            f"WHEN {s_any_contains(nl, fixed.PARSER_WESTERN)} THEN {q(fixed.WESTERN)} ELSE {q(fixed.OTHER)} END")


def s_bucket(c: str, n: int) -> str:
    return (f"(CAST('0x' || substr(md5(substr({s_text(c)}, 1, {fixed.ORIGIN_PREFIX_CHARS})), 1, 8) AS BIGINT) % {n})")


def s_origin_text(c: str) -> str:
    tl = f"lower({s_text(c)})"
    buckets = str_list(fixed.ORIGIN_BUCKETS)
    return (f"CASE WHEN {s_any_contains(tl, fixed.PREP_SOUTH_ASIAN)} THEN {q(fixed.SOUTH_ASIAN)} "
            f"WHEN {s_any_contains(tl, fixed.PREP_EAST_ASIAN)} THEN {q(fixed.EAST_ASIAN)} "
            f"WHEN {s_any_contains(tl, fixed.PREP_WESTERN)} THEN {q(fixed.WESTERN)} "
            f"ELSE {buckets}[{s_bucket(c, len(fixed.ORIGIN_BUCKETS))} + 1] END")


def s_clean(c: str) -> str:
    t = s_text(c)
    t = f"regexp_replace({t}, {q(TAG)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(LINK)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(SPACES)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(FOREIGN)}, ' ', 'g')"
    return s_strip(t)


def s_parse_select(text: str = "text") -> str:
    return (f"{s_name(text)} AS Name, {s_email(text)} AS Email, {s_skills(text)} AS Skills, "
            f"{s_education(text)} AS Education, {s_strip(s_text(text))} AS Full_Text, "
            f"{s_gender(text)} AS gender_proxy, {s_tier(text)} AS institution_tier, "
            f"{s_gap(text)} AS career_gap, {s_origin(s_name(text))} AS name_origin_proxy")


# -- vectorizer, ranking, audit -------------------------------------------------

def labeled_cte() -> str:
    return (", lab AS (SELECT doc_id, score, CAST(score >= (SELECT median(score) FROM score) AS INTEGER) AS label "
            "FROM score)")


def transform_ctes(table: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f""",
xterms AS (SELECT {k}, {terms_sql('text')} AS t FROM {table}),
xtf AS (SELECT {k}, term, count(*) AS tf FROM (SELECT {k}, unnest(t) AS term FROM xterms) GROUP BY ALL),
xw0 AS (SELECT {', '.join('xtf.' + c for c in keys)}, xtf.term, (1.0 + ln(xtf.tf)) * idf.idf AS w
        FROM xtf JOIN idf ON xtf.term = idf.term),
xn AS (SELECT {k}, sqrt(sum(w * w)) AS norm FROM xw0 GROUP BY ALL),
xw AS (SELECT xw0.*, xw0.w / xn.norm AS wn FROM xw0 JOIN xn USING ({k}))"""


# Rounds of the fit below; the objective is strictly convex and 300 rounds reach 1e-13 on 1,000 documents.
FIT_ROUNDS = 400


def model_ctes(labels: str = "SELECT doc_id, label FROM lab", C: float = fixed.LOGISTIC_C) -> str:
    """CTEs coef(term, c), free(b), the intercept, and pred(doc_id, score, margin, model_score, recommended):
    the penalized logistic fit by accelerated gradient steps over the non-zero
    weights.  Features are centred (the free intercept absorbs it) and each one
    has its own step, from the row sums of the absolute Gram matrix, which bound
    the curvature.  ``labels``: doc_id and label of the training documents.

    y holds the point at which the gradient is taken, b the iterate; feature 0 is
    the intercept."""
    margins = """SELECT z.d, 1.0 / (1.0 + exp(c.c - z.z)) - n.label AS r
      FROM (SELECT x.d, sum(x.v * f.y) AS z FROM x JOIN fit f ON f.j = x.j GROUP BY x.d) z JOIN train n ON n.d = z.d,
           (SELECT sum(f.y * s.m) AS c FROM fit f JOIN steps s ON s.j = f.j) c"""
    return labeled_cte() + f""",
feats AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY term) AS INTEGER) AS j, term FROM idf),
train AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS d, doc_id, CAST(label AS DOUBLE) AS label FROM ({labels}) WHERE label IS NOT NULL),
total AS MATERIALIZED (SELECT count(*) AS n FROM train),
x AS MATERIALIZED (SELECT n.d, f.j, w.w AS v FROM w JOIN train n ON n.doc_id = w.doc_id JOIN feats f ON f.term = w.term UNION ALL SELECT d, 0, 1.0 FROM train),
means AS MATERIALIZED (SELECT f.j, coalesce(sum(v), 0.0) / (SELECT n FROM total) AS m FROM feats f LEFT JOIN x ON x.j = f.j GROUP BY f.j),
gram AS (SELECT a.j, b.j AS k, sum(a.v * b.v) AS g FROM x a JOIN x b ON a.d = b.d WHERE a.j > 0 AND b.j > 0 GROUP BY a.j, b.j),
bounds AS (SELECT a.j, sum(abs(coalesce(g.g, 0.0) - (SELECT n FROM total) * a.m * b.m)) / 4 + 1.0 / {C} AS h
           FROM means a CROSS JOIN means b LEFT JOIN gram g ON g.j = a.j AND g.k = b.j GROUP BY a.j),
steps AS MATERIALIZED (SELECT b.j, b.h, m.m FROM bounds b JOIN means m ON m.j = b.j UNION ALL SELECT 0, n / 4.0, 0.0 FROM total),
momentum AS MATERIALIZED (SELECT (sqrt(max(h) * {C}) - 1) / (sqrt(max(h) * {C}) + 1) AS q FROM steps WHERE j > 0),
fit AS (SELECT 0 AS k, j, 0.0::DOUBLE AS b, 0.0::DOUBLE AS y FROM steps
  UNION ALL
  SELECT k, j, b, b + q * (b - old) FROM (
    SELECT f.k + 1 AS k, f.j, f.b AS old, f.y - (coalesce(g.g, 0.0) - s.m * t.g + CASE WHEN f.j > 0 THEN f.y / {C} ELSE 0.0 END) / s.h AS b
    FROM fit f JOIN steps s ON s.j = f.j
    LEFT JOIN (SELECT x.j, sum(x.v * r.r) AS g FROM x JOIN ({margins}) r ON r.d = x.d GROUP BY x.j) g ON g.j = f.j,
    (SELECT sum(r) AS g FROM ({margins})) t
    WHERE f.k < {FIT_ROUNDS}) u, momentum),
coef AS MATERIALIZED (SELECT f.term, t.b AS c FROM fit t JOIN feats f ON f.j = t.j WHERE t.k = {FIT_ROUNDS}),
free AS MATERIALIZED (SELECT sum(CASE WHEN t.j = 0 THEN t.b ELSE -t.b * s.m END) AS b FROM fit t JOIN steps s ON s.j = t.j WHERE t.k = {FIT_ROUNDS}),
pred AS MATERIALIZED (SELECT score.doc_id, score.score, m.margin, round(1.0 / (1.0 + exp(-m.margin)), {fixed.SCORE_DECIMALS}) AS model_score, CAST(m.margin > 0 AS INTEGER) AS recommended
         FROM score JOIN (SELECT d.doc_id, (SELECT b FROM free) + coalesce(s.dot, 0.0) AS margin FROM docs d
              LEFT JOIN (SELECT w.doc_id, sum(w.w * coef.c) AS dot FROM w JOIN coef ON coef.term = w.term GROUP BY w.doc_id) s ON s.doc_id = d.doc_id) m ON m.doc_id = score.doc_id)"""


def audit_ctes(attrs: list[str], source: str | None = None, recommended: str | None = None) -> str:
    """``source``: a table that has the attributes as columns (else they are parsed from documents).
    ``recommended``: a table that has doc_id, score and the class audited (else the median label)."""
    exprs = {
        "gender_proxy": s_gender("text"), "institution_tier": s_tier("text"), "career_gap": s_gap("text"),
        "name_origin_proxy": s_origin(s_name("text")),
    }
    sel = ", ".join(f"{exprs[a]} AS {a}" if a in exprs else ("labels.toxic" if a == "toxic" else a) for a in attrs)
    rows = (f"SELECT doc_id, {', '.join(attrs)} FROM {source}" if source else
            f"SELECT documents.doc_id, {sel} FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id")
    unions = " UNION ALL ".join(
        f"SELECT {i} AS attr_pos, {q(a)} AS attr, coalesce(CAST({a} AS VARCHAR), 'None') AS grp, doc_id, s, label "
        f"FROM audited" for i, a in enumerate(attrs))
    head = labeled_cte() if recommended is None else f", audit_lab AS (SELECT doc_id, score, recommended AS label FROM {recommended})"
    lab = "lab" if recommended is None else "audit_lab"
    return head + f""",
attrs AS ({rows}),
audited AS (SELECT a.*, lab.label, CAST(round(lab.score * {10 ** fixed.SCORE_DECIMALS}) AS BIGINT) AS s
         FROM attrs a JOIN {lab} lab ON a.doc_id = lab.doc_id),
long AS ({unions}),
firsts AS (SELECT attr_pos, grp, s AS fs, doc_id AS first_id FROM (
  SELECT *, row_number() OVER (PARTITION BY attr_pos, grp ORDER BY s DESC, doc_id) AS rn FROM long) WHERE rn = 1),
g0 AS (SELECT attr_pos, attr, grp, count(*) AS n, sum(s) AS ssum, sum(label) AS rsum FROM long GROUP BY ALL),
g AS (SELECT g0.attr_pos, attr, g0.grp, n, (2 * ssum + n) // (2 * n) AS mu,
        ((2 * ssum + n) // (2 * n)) / {float(10 ** fixed.SCORE_DECIMALS)} AS mean_score,
        ((2 * {10 ** fixed.REC_RATE_DECIMALS} * rsum + n) // (2 * n)) / {float(10 ** fixed.REC_RATE_DECIMALS)} AS rec_rate,
        fs, first_id
      FROM g0 JOIN firsts ON g0.attr_pos = firsts.attr_pos AND g0.grp = firsts.grp),
rep AS (SELECT attr_pos, attr, count(*) AS n_groups, (max(mu) - min(mu)) / {float(10 ** fixed.SCORE_DECIMALS)} AS disparity,
          first(grp ORDER BY mu DESC, fs DESC, first_id ASC) AS favoured,
          first(grp ORDER BY mu ASC, fs DESC, first_id ASC) AS disadvantaged
        FROM g GROUP BY attr_pos, attr HAVING count(*) >= 2),
report AS (SELECT CAST(row_number() OVER (ORDER BY disparity DESC, attr_pos) AS BIGINT) AS position, attr, n_groups,
             disparity, favoured, disadvantaged FROM rep)"""


def severity_sql(pos: str = "position") -> str:
    s = fixed.SEVERITY
    return f"CASE WHEN {pos} = 1 THEN {q(s[0])} WHEN {pos} = 2 THEN {q(s[1])} ELSE {q(s[2])} END"


# -- attribution ----------------------------------------------------------------------
import re as _re  # noqa: E402

ORDER_DECIMALS = 12


def sql_fill(template: str, **exprs: str) -> str:
    parts, pos = [], 0
    for m in _re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(q(template[pos:m.start()]))
        parts.append(exprs[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(q(template[pos:]))
    return "(" + " || ".join(parts) + ")"


def attribution_ctes(names: str | None = None, coef: str = "SELECT term, qw AS c FROM qv") -> str:
    """``names``: doc_id and name of the documents; ``coef``: term and c of the linear score."""
    year = r"^(19[0-9][0-9]|20[0-9][0-9])$"
    names = names or f"SELECT doc_id, {s_name('text')} AS name FROM documents"
    return f""",
names AS ({names}),
nwords AS (SELECT regexp_extract_all(lower(coalesce(name, '')), {q(TOKEN_RE)}) AS t FROM names),
ntoks AS (SELECT DISTINCT unnest(t) AS token FROM nwords),
name_tokens AS (SELECT token FROM ntoks UNION
                SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS token FROM nwords),
vw AS (SELECT term, unnest(string_split(term, ' ')) AS word FROM idf),
noise AS (SELECT i.term, (regexp_matches(i.term, {q(year)}) OR contains(i.term, '@') OR EXISTS (
            SELECT 1 FROM vw WHERE vw.term = i.term AND (vw.word IN ({', '.join(q(x) for x in fixed.NOISE_WORDS)})
                                                         OR vw.word IN (SELECT token FROM ntoks)))) AS is_noise
          FROM idf i),
nd AS (SELECT count(*) AS n FROM docs),
lin AS ({coef}),
feat AS (SELECT i.term, coalesce(lin.c, 0.0) AS c, coalesce(ms.sw, 0.0) / nd.n AS m, noise.is_noise
         FROM idf i JOIN noise ON noise.term = i.term CROSS JOIN nd
         LEFT JOIN lin ON lin.term = i.term
         LEFT JOIN (SELECT term, sum(w) AS sw FROM w WHERE doc_id <> -1 GROUP BY term) ms ON ms.term = i.term),
vals AS (SELECT d.doc_id, f.term, f.c * (coalesce(w.w, 0.0) - f.m) AS value, f.is_noise
         FROM docs d CROSS JOIN feat f LEFT JOIN w ON w.doc_id = d.doc_id AND w.term = f.term),
nclean AS (SELECT count(*) AS k FROM noise WHERE NOT is_noise),
topc AS (SELECT doc_id, term, value, row_number() OVER (
           PARTITION BY doc_id ORDER BY round(0.0 - abs(value), {ORDER_DECIMALS}), term) AS r
         FROM vals WHERE NOT is_noise OR (SELECT k FROM nclean) = 0),
disp AS (SELECT doc_id, term, value, r, row_number() OVER (PARTITION BY doc_id ORDER BY
           CASE WHEN (SELECT k FROM nclean) = 0 THEN -r ELSE 0 END,
           CASE WHEN value > 0 THEN 1 ELSE 0 END,
           round(CASE WHEN value > 0 THEN -value ELSE value END, {ORDER_DECIMALS}), r) AS pos
         FROM topc WHERE r <= {fixed.TOP_CLEAN_TERMS}),
top6 AS (SELECT doc_id, term, round(value, {fixed.SCORE_DECIMALS}) + 0.0 AS value, row_number() OVER (
           PARTITION BY doc_id ORDER BY round(0.0 - abs(value), {ORDER_DECIMALS}), pos) AS pos FROM disp),
bias AS (SELECT doc_id, term, round(value, 5) + 0.0 AS value, row_number() OVER (
           PARTITION BY doc_id ORDER BY round(0.0 - abs(value), {ORDER_DECIMALS}), term) AS pos
         FROM vals WHERE is_noise AND abs(value) > {fixed.BIAS_MIN_ABS}),
leader AS (SELECT doc_id FROM score ORDER BY score DESC, doc_id LIMIT 1),
lead_vals AS (SELECT term, value AS a FROM vals WHERE doc_id = (SELECT doc_id FROM leader)),
gaps AS (SELECT v.doc_id, v.term, l.a - v.value AS gap FROM vals v JOIN lead_vals l ON l.term = v.term
         WHERE NOT v.is_noise AND l.a - v.value > 0 AND v.doc_id <> (SELECT doc_id FROM leader)),
gtop AS (SELECT doc_id, term, gap, row_number() OVER (
           PARTITION BY doc_id ORDER BY round(0.0 - gap, {ORDER_DECIMALS}), term) AS pos FROM gaps)"""


def contrast_text_sql() -> str:
    f = {i: f"max(CASE WHEN g.pos = {i + 1} THEN g.term END)" for i in range(3)}
    return f""",
gagg AS (SELECT doc_id, count(*) AS ng, {f[0]} AS f0, {f[1]} AS f1, {f[2]} AS f2
         FROM gtop g WHERE pos <= {fixed.CONTRAST_TERMS} GROUP BY doc_id),
best AS (SELECT doc_id, string_agg('**' || term || '**', ', ' ORDER BY pos) AS signals FROM (
           SELECT doc_id, term, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
           FROM top6 WHERE pos <= {fixed.TOP_TABLE_TERMS} AND value > 0) WHERE k <= 3 GROUP BY doc_id)
SELECT n.doc_id, CASE
  WHEN n.doc_id = (SELECT doc_id FROM leader) THEN
    {sql_fill(fixed.CONTRAST_LEADER, name='n.name')} || coalesce(b.signals, {q(fixed.CONTRAST_LEADER_GENERIC)}) || '.'
  WHEN coalesce(g.ng, 0) > 0 THEN
    {sql_fill(fixed.CONTRAST_IMPROVE, name='n.name', f0='g.f0')}
    || CASE WHEN g.ng > 1 THEN {sql_fill(fixed.CONTRAST_FOLLOWED, f1='g.f1')} ELSE '' END
    || CASE WHEN g.ng > 2 THEN {sql_fill(fixed.CONTRAST_AND, f2='g.f2')} ELSE '' END
    || {sql_fill(fixed.CONTRAST_QUESTION, name='n.name', f0='g.f0')}
  ELSE {sql_fill(fixed.CONTRAST_NO_GAP, name='n.name')} END AS contrastive
FROM names n LEFT JOIN gagg g ON g.doc_id = n.doc_id LEFT JOIN best b ON b.doc_id = n.doc_id"""


# -- preparation job -----------------------------------------------------------------------

def s_key(key: str, tag: str | None = None, seed: int = fixed.SEED) -> str:
    parts = [q(str(seed))] + ([q(tag)] if tag else []) + [f"CAST({key} AS VARCHAR)"]
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def raw_cte() -> str:
    return "raw AS (SELECT doc_id AS ID, text AS Resume_str, source AS Category FROM documents)"


def prep_ctes(source: str = "raw", order: str = "ID") -> str:
    """base (cleaned, filtered, attributes) -> r1 -> r2 -> r3 -> prepared."""
    clean = s_clean("Resume_str")
    t = "Full_Text"

    def relabel(prev: str, name: str, col: str, cand: str, tag: str, bands: list[tuple[str, str]], cnt: str) -> str:
        case = " ".join(f"WHEN rk.r <= {upto} THEN {q(label)}" for upto, label in bands)
        return f""",
{name}_rank AS (SELECT ID, row_number() OVER (ORDER BY {s_key('ID', tag)}, ID) AS r FROM {prev} WHERE {cand}),
{name} AS (SELECT p.* REPLACE (CASE {case} ELSE p.{col} END AS {col})
           FROM {prev} p LEFT JOIN {name}_rank rk ON rk.ID = p.ID, ({cnt}) c)"""

    g, f_, o = fixed, fixed, fixed
    return f""",
cleaned AS (SELECT ID, Category, _order, {clean} AS Full_Text FROM {source}),
base AS (SELECT ID, Category, _order, Full_Text,
           {s_tier(t, fixed.PREP_TIER1)} AS institution_tier, {s_gap(t, fixed.PREP_GAP_PATTERNS)} AS career_gap,
           {s_gender_words(t)} AS gender_proxy, {s_origin_text(t)} AS name_origin_proxy
         FROM cleaned WHERE length(Full_Text) > {fixed.MIN_CLEAN_LENGTH})""" + relabel(
        "base", "r1", "career_gap", f"career_gap <> {q(g.GAP_YES)}", "gap",
        [(f"greatest(0, floor(c.n * {g.GAP_TARGET_SHARE}::DOUBLE) - c.already)", g.GAP_SYNTHETIC)],
        f"SELECT count(*) AS n, count(*) FILTER (WHERE career_gap = {q(g.GAP_YES)}) AS already FROM base") + relabel(
        "r1", "r2", "gender_proxy", f"gender_proxy = {q(f_.UNSPECIFIED)}", "gender",
        [(f"floor(c.m * {f_.GENDER_FEMALE_SHARE}::DOUBLE)", f_.FEMALE_SYNTHETIC),
         (f"floor(c.m * {f_.GENDER_FEMALE_SHARE}::DOUBLE) + floor(c.m * {f_.GENDER_MALE_SHARE}::DOUBLE)",
          f_.MALE_SYNTHETIC)],
        f"SELECT count(*) FILTER (WHERE gender_proxy = {q(f_.UNSPECIFIED)}) AS m FROM r1") + relabel(
        "r2", "r3", "name_origin_proxy", f"name_origin_proxy = {q(o.SOUTH_ASIAN)}", "origin",
        [(f"floor(c.m * {o.ORIGIN_TO_WESTERN_SHARE}::DOUBLE)", o.WESTERN_SYNTHETIC),
         (f"floor(c.m * {o.ORIGIN_TO_WESTERN_SHARE}::DOUBLE) + floor(c.m * {o.ORIGIN_TO_EAST_ASIAN_SHARE}::DOUBLE)",
          o.EAST_ASIAN_SYNTHETIC)],
        f"SELECT count(*) FILTER (WHERE name_origin_proxy = {q(o.SOUTH_ASIAN)}) AS m FROM r2") + f""",
pos AS (SELECT *, row_number() OVER (ORDER BY _order, ID) AS p FROM r3),
prepared AS (SELECT ID, printf({q(fixed.FILE_FORMAT)}, p) AS Filename, printf({q(fixed.NAME_FORMAT)}, p) AS Name,
               printf({q(fixed.EMAIL_FORMAT)}, p) AS Email, Category, {s_skills('Full_Text', fixed.PREP_SKILLS)} AS Skills,
               '' AS Education, Full_Text, gender_proxy, institution_tier, career_gap, name_origin_proxy FROM pos)"""


# -- local perturbation ----------------------------------------------------------------------

P = 2147483647


def s_hex(h: str, start: int) -> str:
    return f"CAST('0x' || substr({h}, {start}, 8) AS BIGINT)"


def perturb_ctes(n_samples: int = fixed.PERTURB_SAMPLES, seed: int = fixed.SEED, source: str = "documents") -> str:
    sd = q(str(seed))
    a_of = lambda x: f"({s_hex(f'md5(concat_ws({chr(39)}|{chr(39)}, {sd}, CAST(doc_id AS VARCHAR), {x}))', 1)} % {P})"
    return f""",
pf AS (SELECT doc_id, text, wl, len(wl) AS nw, list_transform(wl, lambda x: {a_of('x')}) AS a FROM (
         SELECT doc_id, text, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), {q(RUN_RE)}))) AS wl
         FROM {source}) WHERE len(wl) > 0),
ps0 AS (SELECT pf.*, sm.s, md5(concat_ws('|', {sd}, CAST(doc_id AS VARCHAR), 'sample', CAST(sm.s AS VARCHAR))) AS h
        FROM pf, range(0, {n_samples}) sm(s)),
ps AS (SELECT doc_id, text, wl, nw, a, s, 1 + {s_hex('h', 1)} % {P - 1} AS b, {s_hex('h', 9)} % {P} AS c,
         CASE WHEN s = 0 THEN 0 ELSE 1 + {s_hex('h', 17)} % nw END AS r FROM ps0),
pp AS (SELECT *, list_sort(list_transform(range(1, nw + 1), lambda j: {{'p': (a[j] * b + c) % {P}, 'w': wl[j]}})) AS prios
       FROM ps)"""


def kept_ctes() -> str:
    """CTEs pword (a document's words by place), ptok (its tokens as places), pkeep
    (a flag for each word of a sample).  Priority and place of a word are one
    number, so a sample sorts numbers and its words are those beyond the r-th."""
    return f""",
pw0_ AS (SELECT doc_id, unnest(wl) AS word, unnest(range(1, nw + 1)) AS j FROM pf),
pword AS MATERIALIZED (SELECT doc_id, j, word, lower(word) AS u, length(lower(word)) >= 2 AND NOT list_contains({stop_list()}, lower(word)) AS ok FROM pw0_),
prun0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {q(RUN_RE)}) AS x FROM pf),
prun AS (SELECT doc_id, unnest(x) AS word, unnest(range(1, len(x) + 1)) AS pos FROM prun0),
ptoken AS MATERIALIZED (SELECT r.doc_id, r.pos, w.j, w.u FROM prun r JOIN pword w ON w.doc_id = r.doc_id AND w.word = r.word WHERE w.ok),
ptok AS (SELECT doc_id, list(CAST(j AS BIGINT) ORDER BY pos) AS occ FROM ptoken GROUP BY doc_id),
pkey AS (SELECT doc_id, s, r, nw, list_transform(range(1, nw + 1), lambda j: ((a[j] * b + c) % {P}) * 1048576 + j) AS keys FROM ps),
plimit AS (SELECT *, CASE WHEN r = 0 THEN -1 ELSE list_sort(keys)[r] END AS upto FROM pkey),
pkeep AS MATERIALIZED (SELECT doc_id, s, r, nw, list_transform(keys, lambda k: k > upto) AS keep,
           sqrt(exp(-(pow(100.0 * (1.0 - sqrt((nw - r) / nw)), 2)) / {fixed.KERNEL_WIDTH ** 2})) AS kernel FROM plimit)"""


def perturb_score_ctes(coef: str = "SELECT term, qw AS c FROM qv", margin: str = "coalesce(pdot.dot, 0.0)") -> str:
    """pscore: doc_id, s, r, nw, kernel and the score of every sample (``coef``: term and c)."""
    return kept_ctes() + f""",
psingle AS (SELECT t.doc_id, t.j, t.u AS term, count(*) AS n FROM ptoken t JOIN idf ON idf.term = t.u GROUP BY t.doc_id, t.j, t.u),
ppair AS (SELECT a.doc_id, a.j * 1048576 + b.j AS code, i.term FROM idf i JOIN pword a ON a.u = string_split(i.term, ' ')[1] AND a.ok
          JOIN pword b ON b.doc_id = a.doc_id AND b.u = string_split(i.term, ' ')[2] AND b.ok WHERE contains(i.term, ' ')),
pleft AS (SELECT k.doc_id, k.s, list_filter(t.occ, lambda j: k.keep[j]) AS u FROM pkeep k JOIN ptok t ON t.doc_id = k.doc_id),
pcodes AS (SELECT doc_id, s, unnest(list_transform(range(1, len(u)), lambda i: u[i] * 1048576 + u[i + 1])) AS code FROM pleft),
ptf AS (SELECT k.doc_id, k.s, c.term, sum(c.n) AS tf FROM pkeep k JOIN psingle c ON c.doc_id = k.doc_id WHERE k.keep[c.j] GROUP BY k.doc_id, k.s, c.term
        UNION ALL SELECT c.doc_id, c.s, p.term, count(*) AS tf FROM pcodes c JOIN ppair p ON p.doc_id = c.doc_id AND p.code = c.code GROUP BY c.doc_id, c.s, p.term),
pw0 AS (SELECT ptf.doc_id, ptf.s, ptf.term, (1.0 + ln(ptf.tf)) * idf.idf AS w FROM ptf JOIN idf ON ptf.term = idf.term),
plin AS ({coef}),
pdot AS (SELECT p.doc_id, p.s, sum(p.w * coalesce(c.c, 0.0)) / sqrt(sum(p.w * p.w)) AS dot FROM pw0 p LEFT JOIN plin c ON c.term = p.term GROUP BY p.doc_id, p.s),
pscore AS (SELECT k.doc_id, k.s, k.r, k.nw, k.kernel, {margin} AS score FROM pkeep k LEFT JOIN pdot ON pdot.doc_id = k.doc_id AND pdot.s = k.s)"""


def solve_ctes(name: str, system: str, size: int) -> str:
    """{name}_x(g, i, x): the solution of every system g of ``size`` equations by
    Gauss-Jordan elimination.  ``system``: g, i and m, a row's coefficients and right side
    (symmetric and positive definite, so the diagonal needs no exchange)."""
    return f""",
{name}_m AS MATERIALIZED ({system}),
{name}_s AS (SELECT 0 AS k, g, i, m FROM {name}_m
  UNION ALL
  SELECT a.k + 1, a.g, a.i, CASE WHEN a.i = a.k + 1 THEN list_transform(a.m, lambda v: v / a.m[a.k + 1])
      ELSE list_transform(list_zip(a.m, p.m), lambda e: e[1] - e[2] * (a.m[a.k + 1] / p.m[a.k + 1])) END
  FROM {name}_s a JOIN {name}_s p ON p.g = a.g AND p.i = a.k + 1 WHERE a.k < {size}),
{name}_x AS MATERIALIZED (SELECT g, i, m[{size} + 1] AS x FROM {name}_s WHERE k = {size})"""


def local_ctes(n_samples: int = fixed.PERTURB_SAMPLES, n_features: int = fixed.PERTURB_FEATURES) -> str:
    """After pscore: lfinal(doc_id, word, weight), both ridges of each document.
    The first by its dual, samples x samples; the second by the normal equations of
    the chosen words (unused places are equations x = 0)."""
    return f""",
lrow AS MATERIALIZED (SELECT doc_id, s, score, kernel, sqrt(kernel) AS root, score - sum(kernel * score) OVER d / sum(kernel) OVER d AS dev FROM pscore WINDOW d AS (PARTITION BY doc_id)),
lz AS (SELECT k.doc_id, k.s, unnest(range(1, k.nw + 1)) AS j, CAST(unnest(k.keep) AS INTEGER) AS z FROM pkeep k),
lx AS MATERIALIZED (SELECT z.doc_id, z.s, z.j, (z.z - sum(r.kernel * z.z) OVER w / sum(r.kernel) OVER w) * r.root AS v FROM lz z JOIN lrow r ON r.doc_id = z.doc_id AND r.s = z.s WINDOW w AS (PARTITION BY z.doc_id, z.j)),
lg AS (SELECT a.doc_id, a.s, b.s AS t, sum(a.v * b.v) AS v FROM lx a JOIN lx b ON b.doc_id = a.doc_id AND b.j = a.j GROUP BY a.doc_id, a.s, b.s)""" + solve_ctes(
        "ldual", f"""SELECT g.doc_id AS g, g.s + 1 AS i, list_append(list(g.v + CASE WHEN g.s = g.t THEN {fixed.SELECT_RIDGE_ALPHA} ELSE 0.0 END ORDER BY g.t), any_value(r.dev * r.root)) AS m
  FROM lg g JOIN lrow r ON r.doc_id = g.doc_id AND r.s = g.s GROUP BY g.doc_id, g.s""", n_samples) + f""",
lcoef AS (SELECT x.doc_id, x.j, sum(x.v * u.x) AS c FROM lx x JOIN ldual_x u ON u.g = x.doc_id AND u.i = x.s + 1 GROUP BY x.doc_id, x.j),
lbest AS (SELECT doc_id, j, row_number() OVER (PARTITION BY doc_id ORDER BY round(-abs(c), 9), j) AS o FROM lcoef),
lpick AS MATERIALIZED (SELECT doc_id, j, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS f FROM lbest WHERE o <= {n_features}),
ly AS MATERIALIZED (SELECT x.doc_id, x.s, p.f, x.v FROM lx x JOIN lpick p ON p.doc_id = x.doc_id AND p.j = x.j),
lgrid AS (SELECT d.doc_id, a.i, b.i AS k FROM (SELECT DISTINCT doc_id FROM lpick) d, range(1, {n_features + 1}) a(i), range(1, {n_features + 2}) b(i)),
lnormal AS (SELECT a.doc_id, a.f AS i, b.f AS k, sum(a.v * b.v) AS v FROM ly a JOIN ly b ON b.doc_id = a.doc_id AND b.s = a.s GROUP BY ALL
            UNION ALL SELECT a.doc_id, a.f, {n_features + 1}, sum(a.v * r.dev * r.root) FROM ly a JOIN lrow r ON r.doc_id = a.doc_id AND r.s = a.s GROUP BY ALL)""" + solve_ctes(
        "lsec", f"""SELECT g.doc_id AS g, g.i, list(coalesce(n.v, 0.0) + CASE WHEN g.i = g.k THEN {fixed.FINAL_RIDGE_ALPHA} ELSE 0.0 END ORDER BY g.k) AS m
  FROM lgrid g LEFT JOIN lnormal n ON n.doc_id = g.doc_id AND n.i = g.i AND n.k = g.k GROUP BY g.doc_id, g.i""", n_features) + """,
lfinal AS (SELECT p.doc_id, w.word, x.x AS weight, row_number() OVER (PARTITION BY p.doc_id ORDER BY round(-abs(x.x), 9), p.j) AS pos
           FROM lpick p JOIN lsec_x x ON x.g = p.doc_id AND x.i = p.f JOIN pword w ON w.doc_id = p.doc_id AND w.j = p.j)"""
