"""Whole-text rules and term counts in Arrow batches say the same as the plain ones."""

from collections import Counter

from pyspark.sql import functions as F

from equilens.functions import fixed
from equilens.functions import scans as sc
from equilens.functions import text as tx
from equilens.operators import prepare as pr
from equilens.operators import vectorize as vz
from equilens.plans import context as cx

TEXTS = ["", None, "She", "the  she\n", "ashe she's", "xhis", "her_ he", "Career \t break", "careerbreak gap  year", "freelance, then a break", "freelance\nbreak", "MIT", "mit graduate of BITS Pilani",
         "Lee", "lee kim", "wu li", "Ali Smith", "chen, smith", "SQL excel Java javascript", "r programming.git", "é she é", "École MATERNITY he/him", "She/Her", "career-break", "career\U00010400break", "İIT ahmed", "x" * 60 + " his\n"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attributes_equal_the_rules_one_by_one(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    clean = d.select("id", tx.clean_text(F.col("t")).alias("c"))
    c = F.col("c")
    plain = [tx.institution_tier(c, fixed.PREP_TIER1), tx.career_gap(c, fixed.PREP_GAP_PATTERNS), tx.gender_proxy_words(c),
             tx.name_origin_text(c), tx.skills_string(tx.extract_skills(c, fixed.PREP_SKILLS))]
    names = [*pr.ATTRIBUTES, "Skills"]
    want = clean.select("id", "c", *[p.alias(n) for p, n in zip(plain, names)]).collect()
    assert sorted(pr.with_attributes(clean, "c").select("id", "c", *names).collect()) == sorted(want)
    t = F.col("t")
    want = d.select("id", tx.gender_proxy(t).alias("gender_proxy"), tx.institution_tier(t).alias("institution_tier"), tx.career_gap(t).alias("career_gap")).collect()
    got = sc.with_scans(tx.with_lowered(d, "t"), "_tl", cx.PARSER_RULES)
    assert sorted(got.select("id", "gender_proxy", "institution_tier", "career_gap").collect()) == sorted(want)


def test_a_list_of_words_is_one_pass(spark):
    """A rule's words are not looked for one after the other in a row's text."""
    d = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS * 3)], "ID int, Resume_str string, Category string")
    assert "arrays_zip" not in _plan(pr.with_attributes(d.select("ID", F.col("Resume_str").alias("Full_Text"))))
    long = d.withColumn("Resume_str", F.concat(F.coalesce("Resume_str", F.lit("")), F.repeat(F.lit(" word"), 30)))
    r = pr.relabelled(long, keep_text=False)
    assert "Full_Text" not in r.columns and "Skills" in r.columns
    whole = pr.relabelled(long)
    assert sorted(whole.drop("Full_Text").collect()) == sorted(r.select(*[c for c in whole.columns if c != "Full_Text"]).collect())


def test_short_cleaned_texts_are_dropped_by_length(spark):
    rows = [(1, "a" * 100, "c"), (2, "a" * 101, "c"), (3, "<b>" + "a" * 99, "c"), (4, None, "c"), (None, "b" * 200, "c"), (2, "c" * 150, "c")]
    d = spark.createDataFrame(rows, "ID int, Resume_str string, Category string")
    assert sorted((r.ID or 0) for r in pr.relabelled(d).collect()) == [0, 2, 2]


def _py_counts(words, known):
    gaps = [w if known is None or w in known else None for w in words]
    return Counter([w for w in gaps if w] + [f"{a} {b}" for a, b in zip(gaps, gaps[1:]) if a and b])


def test_term_sums_add_up_whatever_a_task_holds(spark):
    rows = [["a", "b", "a", "b", "a"], [], ["b"], ["c", "a", "a", "é"], ["a", "b"]] * 3
    d = spark.createDataFrame([(r,) for r in rows], "terms array<string>").repartition(2)
    for known in (None, ["a", "é", "b"], []):
        by = [_py_counts(r, known) for r in rows]
        want = {t: (sum(c[t] for c in by), sum(t in c for c in by)) for t in set().union(*by)}
        for held in (1, 1000):
            got = vz.term_sums(d, known, held).groupBy("term").agg(F.sum("c").alias("c"), F.sum("d").alias("d")).collect()
            assert {r.term: (r.c, r.d) for r in got} == want


def test_terms_are_not_exploded_one_row_an_occurrence(spark):
    docs = spark.createDataFrame([(1, "aa bb aa cc"), (2, None), (3, "bb aa"), (3, "é aa bb")], "doc_id long, text string")
    plan = _plan(vz.top_terms(vz.corpus_of(docs, vz.query_from_text(spark, "aa")), 5, ()))
    assert "Generate" not in plan and "MapInArrow" in plan


def test_entries_equal_the_count_vectorizer(spark):
    docs = spark.createDataFrame([(1, "aa bb aa cc", "x"), (2, None, None), (3, "bb aa", "y"), (3, "é ÉÉ aa, bb", "z"), (None, "zz", "w"), (4, "the cc cc cc", "v")], "doc_id long, text string, k string")
    for size in (0, 3, 50):
        vocab = vz.fit_vocabulary(docs, vz.query_from_text(spark, "aa bb aa"), max_features=size) if size else vz.Vocabulary((), (), (), 3)
        t = vocab.add_terms(docs, "text", "_t")
        plain = vocab.sparse_weights(vocab.counts(t, "_t", "_v"), "_v").select("doc_id", "k", "sw").collect() if size else [(r.doc_id, r.k, []) for r in docs.collect()]
        key = lambda r: str(r[1])
        got = vz.sparse_docs(docs, vocab, "text", ["doc_id", "k"])
        assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(plain, key=key)]
        assert "UDF" not in _plan(got)


def test_cleaning_leaves_out_scans_that_cannot_match(spark):
    texts = ["a <b", "<b>x</b>", "<\n>", "a>b<c>", "http", "http x", "httpx y", "www.", "www.q  r", "<http://x y>", "ht<i>tp://x", "é", "a é\u2003\u00a0 b", "\u2028x", "plain", " two  blanks ", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string").unionByName(spark.sql("select 99 id, cast(unhex('61C3622080') as string) t"))
    t = F.coalesce("t", F.lit(""))
    for pattern in (fixed.TAG_RE, fixed.URL_RE, fixed.WS_RUN_RE, fixed.NON_ASCII_RE):
        t = F.regexp_replace(t, pattern, " ")
    got = d.select("id", tx.clean_text(F.col("t")).alias("a"), F.trim(t).alias("b")).collect()
    assert all(r.a == r.b for r in got), got
    assert "http" in _plan(d.select(tx.clean_text(F.col("t")))).replace("http[", "")  # looked for before the scan
