"""Oracle SQL per registered query name."""

from __future__ import annotations

from ..functions import fixed
from . import oracle as o
from .queries import TOP_K


def _text_queries() -> dict[str, str]:
    clean = o.s_clean("text")
    return {
        "extract_email": f"SELECT doc_id, {o.s_email('text')} AS email FROM documents",
        "extract_title_line": f"SELECT doc_id, {o.s_name('text')} AS name FROM documents",
        "keyword_tags": f"SELECT doc_id, {o.s_skills('text')} AS skills FROM documents",
        "first_matching_line": f"SELECT doc_id, {o.s_education('text')} AS education FROM documents",
        "attr_tier": f"SELECT doc_id, {o.s_tier('text')} AS institution_tier FROM documents",
        "attr_gap": f"SELECT doc_id, {o.s_gap('text')} AS career_gap FROM documents",
        "attr_gender": f"SELECT doc_id, {o.s_gender('text')} AS gender_proxy FROM documents",
        "attr_origin": f"SELECT doc_id, name, {o.s_origin('name')} AS name_origin_proxy FROM "
                       f"(SELECT doc_id, {o.s_name('text')} AS name FROM documents)",
        "attributes_text": f"""SELECT doc_id, {o.s_tier('clean', fixed.PREP_TIER1)} AS institution_tier,
  {o.s_gap('clean', fixed.PREP_GAP_PATTERNS)} AS career_gap, {o.s_gender_words('clean')} AS gender_proxy,
  {o.s_origin_text('clean')} AS name_origin_proxy, {o.s_skills('clean', fixed.PREP_SKILLS)} AS skills
FROM (SELECT doc_id, {clean} AS clean FROM documents)""",
        "clean_text": f"SELECT page_id, {o.s_clean('html')} AS clean FROM pages",
        "parse_documents": f"SELECT doc_id, {o.s_parse_select('text')} FROM documents",
        "synthetic_identity": f"""SELECT doc_id, pos, printf({o.q(fixed.NAME_FORMAT)}, pos) AS Name,
  printf({o.q(fixed.EMAIL_FORMAT)}, pos) AS Email, printf({o.q(fixed.FILE_FORMAT)}, pos) AS Filename
FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS pos FROM documents)""",
    }


def oracle_sql() -> dict[str, str]:
    out = {
        "rank_topk": o.sql_rank_topk(TOP_K),
        "cosine_score": o.with_tfidf("SELECT doc_id, score FROM score"),
    }
    out.update(_text_queries())
    out.update(_vector_rank_audit())
    out.update(_attribution())
    out.update(_prepare())
    out.update(_local())
    out.update(_prepared())
    out.update(_model())
    return out


def _prepared() -> dict[str, str]:
    """The flow on the preparation job's output: rank, audit, attribution, contrast."""
    full = "WITH " + o.raw_cte() + ", src AS (SELECT *, ID AS _order FROM raw)" + o.prep_ctes("src")
    attrs = ", ".join(fixed.AUDIT_ATTRIBUTES)
    flow = full + f", pdocs AS (SELECT ID AS doc_id, Full_Text AS text, Name AS name, {attrs} FROM prepared)," + o.tfidf_ctes(source="pdocs")
    a = o.attribution_ctes("SELECT doc_id, name FROM pdocs")
    return {
        "prepared_rank": flow + o.labeled_cte() + "\nSELECT doc_id, score, label, "
                         "CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM lab",
        "prepared_audit": flow + o.audit_ctes(fixed.AUDIT_ATTRIBUTES, "pdocs") + f"""
SELECT position, attr, n_groups, disparity, favoured, disadvantaged, {o.severity_sql()} AS severity FROM report""",
        "prepared_noise": flow + a + "\nSELECT term, is_noise FROM noise",
        "prepared_attribution": flow + a + "\nSELECT doc_id, CAST(pos AS BIGINT) AS pos, term, "
                                "round(value, 6) + 0.0 AS value FROM disp",
        "prepared_contrast": flow + a + "\nSELECT doc_id, CAST(pos AS BIGINT) AS pos, term, round(gap, 6) + 0.0 AS gap "
                             f"FROM gtop WHERE pos <= {fixed.CONTRAST_TERMS}",
        "prepared_contrast_text": flow + a + o.contrast_text_sql(),
    }


def _model() -> dict[str, str]:
    """The logistic model and what is shown, audited and explained with it."""
    flow = "WITH RECURSIVE " + o.tfidf_ctes() + o.model_ctes()
    quality = "WITH RECURSIVE " + o.tfidf_ctes() + o.model_ctes("SELECT doc_id, quality AS label FROM labels WHERE doc_id IN (SELECT doc_id FROM docs)")
    ranked = ", ranked AS (SELECT p.*, lab.label, CAST(row_number() OVER (ORDER BY p.score DESC, p.doc_id) AS BIGINT) AS rank FROM pred p JOIN lab ON lab.doc_id = p.doc_id)"
    a = o.attribution_ctes(coef="SELECT term, c FROM coef")
    d = fixed.SCORE_DECIMALS
    return {
        "rank_model": flow + ranked + "\nSELECT doc_id, score, label, model_score, recommended, rank FROM ranked",
        "rank_model_quality": quality + "\nSELECT doc_id, score, model_score, recommended FROM pred",
        "rank_display": flow + ranked + f"""
SELECT r.rank AS "Rank", {o.s_name('d.text')} AS "Name", r.score AS "TF_IDF_Score", r.model_score AS "Model_Score", r.recommended AS "Recommended",
  {o.s_tier('d.text')} AS institution_tier, {o.s_gap('d.text')} AS career_gap, {o.s_origin(o.s_name('d.text'))} AS name_origin_proxy, {o.s_gender('d.text')} AS gender_proxy
FROM ranked r JOIN documents d ON d.doc_id = r.doc_id""",
        "rank_summary_model": flow + f"""
SELECT count(*) AS total, CAST(sum(recommended) AS BIGINT) AS recommended, max(score) AS top_score, round(max(score) - min(score), {d}) AS score_range,
  round(median(score), {d + 1}) AS threshold, CAST((sum(CAST(round(model_score * {10 ** d}) AS BIGINT)) * 2 + count(*)) // (2 * count(*)) AS DOUBLE) / {10 ** d} AS mean_model_score FROM pred""",
        "audit_model": flow + o.audit_ctes(fixed.AUDIT_ATTRIBUTES, recommended="pred") + f"""
SELECT position, attr, n_groups, disparity, favoured, disadvantaged, {o.severity_sql()} AS severity FROM report""",
        "audit_nested_model": flow + o.audit_ctes(fixed.AUDIT_ATTRIBUTES, recommended="pred") + """
SELECT r.position, r.attr, r.disparity, r.favoured, r.disadvantaged,
  (SELECT string_agg(g.grp || ':' || CAST(CAST(round(g.mean_score * 10000) AS BIGINT) AS VARCHAR), ';' ORDER BY g.grp) FROM g WHERE g.attr = r.attr) AS mean_score,
  (SELECT string_agg(g.grp || ':' || CAST(CAST(round(g.rec_rate * 1000) AS BIGINT) AS VARCHAR), ';' ORDER BY g.grp) FROM g WHERE g.attr = r.attr) AS rec_rate FROM report r""",
        "attribution_model": flow + a + "\nSELECT doc_id, CAST(pos AS BIGINT) AS pos, term, round(value, 6) + 0.0 AS value FROM disp",
        "contrast_model": flow + ranked + a + ", told AS (" + o.contrast_text_sql().replace(",\ngagg AS", "WITH gagg AS", 1) + """)
SELECT t.doc_id, r.rank, t.contrastive FROM told t JOIN ranked r ON r.doc_id = t.doc_id""",
    }


def _local() -> dict[str, str]:
    pc = o.perturb_ctes()
    return {
        "perturb_words": "WITH dummy AS (SELECT 1)" + pc + "\nSELECT doc_id, CAST(nw AS BIGINT) AS W, "
                         "md5(array_to_string(wl, ' ')) AS words_md5 FROM pf",
        "perturb_masks": "WITH dummy AS (SELECT 1)" + pc + "\nSELECT doc_id, CAST(s AS BIGINT) AS s, CAST(r AS BIGINT) AS r, "
                         "md5(array_to_string(list_sort(list_transform(list_slice(prios, 1, r), lambda e: e.w)), ' ')) "
                         "AS removed_md5 FROM pp",
        "perturb_scores": o.with_tfidf(pc + o.perturb_score_ctes() + "\nSELECT doc_id, CAST(s AS BIGINT) AS s, "
                          "CAST(r AS BIGINT) AS r, round(kernel, 6) + 0.0 AS kernel, round(score, 6) + 0.0 AS score "
                          "FROM pscore"),
        "local_attribution_top": "WITH RECURSIVE " + o.tfidf_ctes() + o.model_ctes()
                                 + f", shown AS (SELECT d.* FROM documents d WHERE doc_id IN (SELECT doc_id FROM score ORDER BY score DESC, doc_id LIMIT {TOP_K}))"
                                 + o.perturb_ctes(source="shown")
                                 + o.perturb_score_ctes("SELECT term, c FROM coef", "1.0 / (1.0 + exp(-(coalesce(pdot.dot, 0.0) + (SELECT b FROM free))))") + o.local_ctes()
                                 + f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, word, round(weight, 6) + 0.0 AS weight, CASE WHEN weight > 0 THEN {o.q(fixed.HELPED)} ELSE {o.q(fixed.HURT)} END AS direction FROM lfinal""",
    }


def _prepare() -> dict[str, str]:
    from .queries import SAMPLE_N
    raw = "WITH " + o.raw_cte()
    full = raw + ", src AS (SELECT *, ID AS _order FROM raw)" + o.prep_ctes("src")
    sample = (raw + f", src AS (SELECT *, {o.s_key('ID')} AS _order FROM raw ORDER BY _order, ID LIMIT {SAMPLE_N})"
              + o.prep_ctes("src"))
    cols = ("Filename, Name, Email, Category, Skills, Education, Full_Text, gender_proxy, institution_tier, "
            "career_gap, name_origin_proxy")
    attrs = ["institution_tier", "career_gap", "gender_proxy", "name_origin_proxy"]
    unions = " UNION ALL ".join(f"SELECT {o.q(a)} AS attr, {a} AS grp FROM prepared" for a in attrs)
    return {
        "filter_category": raw + "\nSELECT ID, Category FROM raw WHERE lower(Category) = 'src3'",
        "filter_category_partial": raw + """,
cats AS (SELECT Category, min(ID) AS first FROM raw GROUP BY Category),
chosen AS (SELECT Category FROM cats WHERE contains(lower(Category), 'rc1') ORDER BY first, Category LIMIT 1)
SELECT ID, Category FROM raw WHERE CASE WHEN EXISTS (SELECT 1 FROM raw WHERE lower(Category) = 'rc1')
  THEN lower(Category) = 'rc1' ELSE Category = (SELECT Category FROM chosen) END""",
        "filter_min_length": raw + f"\nSELECT ID, length(c) AS length FROM (SELECT ID, {o.s_clean('Resume_str')} AS c "
                                   f"FROM raw) WHERE length(c) > {fixed.MIN_CLEAN_LENGTH}",
        "dropped_short": raw + f"\nSELECT count(*) FILTER (WHERE length(c) <= {fixed.MIN_CLEAN_LENGTH}) AS dropped "
                               f"FROM (SELECT {o.s_clean('Resume_str')} AS c FROM raw)",
        "seeded_sample": raw + f"\nSELECT ID, {o.s_key('ID')} AS sample_key FROM raw ORDER BY sample_key, ID LIMIT {SAMPLE_N}",
        "rebalance_topup": full + "\nSELECT ID, career_gap FROM r1",
        "rebalance_split": full + "\nSELECT ID, gender_proxy FROM r2",
        "rebalance_reassign": full + "\nSELECT ID, name_origin_proxy FROM r3",
        "prepare_corpus": full + f"\nSELECT ID, {cols} FROM prepared",
        "prepare_sample": sample + f"\nSELECT ID, {cols} FROM prepared",
        "profile_categories": raw + "\nSELECT Category AS category, count(*) AS n FROM raw GROUP BY Category",
        "profile_attributes": full + f"""
SELECT attr, grp, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM prepared), 2) AS pct
FROM ({unions}) GROUP BY attr, grp""",
        "profile_length": full + "\nSELECT CAST(floor(avg(length(Full_Text))) AS BIGINT) AS avg_length FROM prepared",
    }


def _attribution() -> dict[str, str]:
    a = o.attribution_ctes()
    hd = f"CASE WHEN value > 0 THEN {o.q(fixed.HELPED)} ELSE {o.q(fixed.HURT)} END"
    return {
        "linear_attribution": o.with_tfidf(a + "\nSELECT doc_id, term, round(value, 6) + 0.0 AS value FROM vals "
                                              "WHERE value <> 0"),
        "attribution_sparse": o.with_tfidf(a + "\nSELECT v.doc_id, v.term, round(v.value, 6) + 0.0 AS value FROM vals v JOIN w ON w.doc_id = v.doc_id AND w.term = v.term "
                                              "UNION ALL SELECT NULL, term, round(-c * m, 6) + 0.0 FROM feat"),
        "name_tokens": o.with_tfidf(a + "\nSELECT token FROM name_tokens"),
        "noise_terms": o.with_tfidf(a + "\nSELECT term, is_noise FROM noise"),
        "attribution_topn": o.with_tfidf(a + "\nSELECT doc_id, CAST(pos AS BIGINT) AS pos, term, "
                                            "round(value, 6) + 0.0 AS value FROM disp"),
        "attribution_top6": o.with_tfidf(a + f"\nSELECT doc_id, CAST(pos AS BIGINT) AS pos, term, value, {hd} "
                                            f"AS direction FROM top6 WHERE pos <= {fixed.TOP_TABLE_TERMS}"),
        "attribution_bias_note": o.with_tfidf(a + "\nSELECT doc_id, CAST(pos AS BIGINT) AS pos, term, value FROM bias "
                                                 f"WHERE pos <= {fixed.TOP_BIAS_TERMS}"),
        "contrast_topn": o.with_tfidf(a + "\nSELECT doc_id, CAST(pos AS BIGINT) AS pos, term, round(gap, 6) + 0.0 AS gap "
                                         f"FROM gtop WHERE pos <= {fixed.CONTRAST_TERMS}"),
        "contrast_text": o.with_tfidf(a + o.contrast_text_sql()),
    }


def _vector_rank_audit() -> dict[str, str]:
    from .queries import AUDIT_ATTRS
    tok = f"regexp_extract_all(lower(coalesce(text, '')), {o.q(o.TOKEN_RE)})"
    return {
        "tokenize": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 "
                    f"FROM (SELECT doc_id, {tok} AS t FROM documents)",
        "term_counts": o.with_tfidf("SELECT doc_id, term, tf FROM tf"),
        "vocabulary": o.with_tfidf("SELECT term, CAST(cf AS BIGINT) AS cf, df, round(idf, 6) AS idf FROM idf"),
        "tfidf_weights": o.with_tfidf("SELECT doc_id, term, round(w, 6) AS weight FROM w"),
        "tfidf_transform": o.with_tfidf(o.transform_ctes("conversations", ["conv_id", "turn"])
                                        + "\nSELECT conv_id, turn, term, round(wn, 6) AS weight FROM xw"),
        "median_label": o.with_tfidf(o.labeled_cte() + "\nSELECT doc_id, score, label FROM lab"),
        "rank_documents": o.with_tfidf(o.labeled_cte() + "\nSELECT doc_id, score, label, "
                                       "CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM lab"),
        "rank_summary": o.with_tfidf(o.labeled_cte() + f"""
SELECT count(*) AS total, CAST(sum(label) AS BIGINT) AS n_label, max(score) AS top_score,
       round(max(score) - min(score), {fixed.SCORE_DECIMALS}) AS score_range,
       round(median(score), {fixed.SCORE_DECIMALS + 1}) AS threshold FROM lab"""),
        "audit_groups": o.with_tfidf(o.audit_ctes(AUDIT_ATTRS) + "\nSELECT attr, grp, n, mean_score, rec_rate FROM g"),
        "audit_report": o.with_tfidf(o.audit_ctes(AUDIT_ATTRS) + f"""
SELECT position, attr, n_groups, disparity, favoured, disadvantaged, {o.severity_sql()} AS severity FROM report"""),
        "audit_labels": o.with_tfidf(o.audit_ctes(AUDIT_ATTRS + ["toxic"]) + f"""
SELECT position, attr, n_groups, disparity, favoured, disadvantaged, {o.severity_sql()} AS severity FROM report"""),
    }
