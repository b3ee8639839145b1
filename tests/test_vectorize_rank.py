"""TF-IDF, scoring and ranking against brute-force Python on small inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from equilens.functions.tokens import english_stop_words, terms, tokenize
from equilens.operators import rank as rk
from equilens.session import materialize
from equilens.operators import vectorize as vz

DOCS = [
    (1, "Python developer with pandas and SQL; python python."),
    (2, "Java and Kubernetes engineer, docker docker."),
    (3, "Data analysis using pandas, scikit-learn and NLP."),
    (4, ""),
    (5, None),
    (6, "the and of"),          # stop words only
    (7, "word"),                # one token, no bigram
]
QUERY = "Python developer: data analysis with pandas, scikit-learn, NLP and SQL."


def py_terms(text, stop):
    toks = [t for t in re.findall(r"(?u)\b\w\w+\b", (text or "").lower()) if t not in stop]
    return toks + [a + " " + b for a, b in zip(toks, toks[1:])]


def brute_tfidf(texts, max_features):
    stop = set(english_stop_words())
    tl = [py_terms(t, stop) for t in texts]
    cf = Counter(t for ts in tl for t in ts)
    vocab = sorted(sorted(cf, key=lambda t: (-cf[t], t))[:max_features])
    n = len(texts)
    df = {t: sum(1 for ts in tl if t in ts) for t in vocab}
    idf = np.array([math.log((1 + n) / (1 + df[t])) + 1 for t in vocab])
    X = np.zeros((n, len(vocab)))
    for i, ts in enumerate(tl):
        c = Counter(ts)
        for j, t in enumerate(vocab):
            if c[t]:
                X[i, j] = (1 + math.log(c[t])) * idf[j]
        nrm = np.linalg.norm(X[i])
        if nrm > 0:
            X[i] /= nrm
    return vocab, X


def test_tfidf_and_cosine_match_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    q = vz.query_from_text(spark, QUERY)
    vocab, qw = vz.fit_corpus(docs, q, max_features=12)
    bv, X = brute_tfidf([t for _, t in DOCS] + [QUERY], 12)
    assert list(vocab.terms) == bv
    assert np.allclose(qw, X[-1])
    scored = rk.cosine_score(vz.weighted_docs(docs, vocab, "text", ["doc_id"]), qw).collect()
    got = {r["doc_id"]: (r["w"], r["score"]) for r in scored}
    for i, (d, _) in enumerate(DOCS):
        assert np.allclose(got[d][0], X[i])
        assert got[d][1] == round(float(X[i] @ X[-1]), 4)
    assert got[4][1] == 0.0 and got[5][1] == 0.0 and got[6][1] == 0.0


def test_bigrams_bridge_removed_stop_words(spark):
    df = spark.createDataFrame([("machine and learning a",)], "t string")
    out = df.select(terms(F.col("t")).alias("x")).first()["x"]
    assert out == ["machine", "learning", "machine learning"]


def test_query_scores_one_against_itself(spark):
    docs = spark.createDataFrame([(1, QUERY), (2, "unrelated words entirely")], "doc_id long, text string")
    q = vz.query_from_text(spark, QUERY)
    vocab, qw = vz.fit_corpus(docs, q)
    s = {r["doc_id"]: r["score"] for r in rk.cosine_score(vz.weighted_docs(docs, vocab, "text", ["doc_id"]), qw).collect()}
    assert s[1] == 1.0 and s[2] == 0.0


def test_query_with_no_known_term_scores_zero(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc_id long, text string")
    vocab, qw = vz.fit_corpus(docs, vz.query_from_text(spark, "the of and"))
    assert all(x == 0.0 for x in qw)
    s = rk.cosine_score(vz.weighted_docs(docs, vocab, "text", ["doc_id"]), qw).collect()
    assert [r["score"] for r in s] == [0.0, 0.0]


def test_global_rank_skewed_ties_any_partitioning(spark):
    rows = [(i, 0.5 if i % 3 == 0 else round((i * 37 % 101) / 101, 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, score double")
    expect = {d: k + 1 for k, (d, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    for n in (1, 3, 7):
        got = rk.global_rank(df.repartition(n), ["-score", "doc_id"], "rank", rows_per_range=max(1, 3000 // n))
        assert {r["doc_id"]: r["rank"] for r in got.collect()} == expect


def test_global_rank_of_many_wide_rows(spark):
    """More rows than a range sampler looks at, with other columns beside the
    keys, and without reuse of exchanges: ranks are 1..n in order."""
    n = 320_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.round(F.rand(7), 4)).alias("score"),
                               F.md5(F.col("id").cast("string")).alias("a"), F.array(F.col("id"), F.col("id")).alias("b"), F.lit("x").alias("c"))
    df = materialize(df)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for rows_per_range in (20_000, 75_000):
            out = rk.global_rank(df, ["-score", "doc_id"], "rank", rows_per_range)
            assert set(out.columns) == set(df.columns) | {"rank"}
            w = Window.orderBy("rank")
            bad = out.select("rank", "score", "doc_id", F.row_number().over(w).alias("k"), F.lag("score").over(w).alias("s"), F.lag("doc_id").over(w).alias("d"))
            bad = bad.where((F.col("rank") != F.col("k")) | (F.col("s") < F.col("score")) | (F.col("s") == F.col("score")) & (F.col("d") >= F.col("doc_id")))
            assert out.count() == n and bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_median_label_and_top_k(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.2), (4, 0.4)], "doc_id long, score double")
    lab = {r["doc_id"]: r["label"] for r in rk.median_label(df).collect()}
    assert lab == {1: 0, 3: 1, 2: 1, 4: 1} or lab == {1: 0, 3: 0, 2: 1, 4: 1}
    assert lab[3] == 0  # median is 0.25
    top = rk.top_k(df, 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in top] == [(4, 1), (2, 2)]


def newton_logistic(X, y, C):
    n, p = X.shape
    A = np.hstack([X, np.ones((n, 1))])
    w = np.zeros(p + 1)
    for _ in range(100):
        z = A @ w
        pr = 1 / (1 + np.exp(-z))
        reg = np.r_[w[:p], 0.0]
        g = A.T @ (pr - y) + reg / C
        H = A.T @ (A * (pr * (1 - pr))[:, None]) + np.diag(np.r_[np.ones(p) / C, 0.0])
        w -= np.linalg.solve(H, g)
    return w[:p], w[p]


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(0)
    X = np.abs(rng.normal(size=(60, 5)))
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    y = (X[:, 0] + 0.3 * rng.normal(size=60) > 0.45).astype(int)
    df = spark.createDataFrame([(X[i].tolist(), int(y[i])) for i in range(60)], "w array<double>, label int")
    model = rk.fit_logistic(df, "w", "label")
    coef, b = rk.model_coefficients(model)
    ec, eb = newton_logistic(X, y, 1.0)
    assert np.allclose(coef, ec, atol=1e-5) and abs(b - eb) < 1e-5
    p = rk.predict(df, coef, b).collect()
    q = rk.predict_with_model(model, df).collect()
    assert [r["model_score"] for r in p] == [r["model_score"] for r in q]
    assert [r["recommended"] for r in p] == [r["recommended"] for r in q]


def test_newton_fit_matches_newton_on_dense_and_sparse_rows(spark):
    rng = np.random.default_rng(4)
    for n, p, spread in ((60, 5, 1), (400, 30, 7), (30, 40, 3)):
        X = np.abs(rng.normal(size=(n, p))) * (rng.random((n, p)) < 0.4)
        y = (X[:, 0] + 0.3 * rng.normal(size=n) > 0.2).astype(int)
        dense = spark.createDataFrame([(X[i].tolist(), int(y[i])) for i in range(n)], "w array<double>, label int").repartition(spread)
        sparse = spark.createDataFrame([([(int(j), float(X[i, j])) for j in np.flatnonzero(X[i])], int(y[i])) for i in range(n)] + [([(0, 1.0)], None)],
                                       "sw array<struct<i:int,x:double>>, label int").repartition(spread)
        ec, eb = newton_logistic(X, y, 1.0)
        for model in (rk.fit_newton(dense, p, "w"), rk.fit_newton(sparse, p), rk.fit_newton(sparse, p, tasks=1)):
            assert np.allclose(model.coef, ec, atol=1e-9) and abs(model.intercept - eb) < 1e-9
            assert model.steps <= 12 and model.gradient < 1e-6
        for a, b in ((rk.predict(dense, ec, eb), rk.predict(sparse.where("label is not null"), ec, eb, "sw")),):
            assert sorted((r.model_score, r.recommended) for r in a.collect()) == sorted((r.model_score, r.recommended) for r in b.collect())


def test_newton_fit_halves_steps_that_overshoot(spark):
    """Nearly separable with a weak penalty: full Newton steps raise the loss."""
    x = [-3.0, -2.0, -1.0, 1.0, 2.0, 30.0]
    df = spark.createDataFrame([([v], int(v > 0)) for v in x], "w array<double>, label int")
    model = rk.fit_newton(df, 1, "w", C=1e4)
    A = np.c_[x, np.ones(6)]
    b = np.array([*model.coef, model.intercept])
    g = A.T @ (1 / (1 + np.exp(-A @ b)) - (np.array(x) > 0)) + np.array([b[0] / 1e4, 0.0])
    assert np.abs(g).max() < 1e-8


def test_newton_fit_refuses_what_it_cannot_fit(spark):
    df = spark.createDataFrame([([1.0], 1), ([0.5], 1)], "w array<double>, label int")
    for bad, size in ((df, 1), (df.limit(0), 1), (df, rk.MAX_GRAM + 1)):
        try:
            rk.fit_newton(bad, size, "w")
        except ValueError:
            continue
        raise AssertionError("expected ValueError")


def test_entries_and_dense_weights_agree(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    vocab, qw = vz.fit_corpus(docs, vz.query_from_text(spark, QUERY), max_features=12)
    dense = {r.doc_id: r.w for r in vz.weighted_docs(docs, vocab, "text", ["doc_id"]).collect()}
    rows = vz.sparse_docs(docs, vocab, "text", ["doc_id"]).collect()
    assert {r.doc_id: vz.dense_row(r.sw, 12) for r in rows} == dense
    assert all(e.x != 0 for r in rows for e in r.sw) and {r.doc_id for r in rows if not r.sw} == {4, 5, 6, 7}


def test_no_vocabulary_wide_array_in_the_scoring_plan(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    vocab, qw = vz.fit_corpus(docs, vz.query_from_text(spark, QUERY), max_features=12)
    plan = rk.cosine_score(vz.sparse_docs(docs, vocab, "text", ["doc_id"]), qw, "sw").drop("sw")._jdf.queryExecution().optimizedPlan().toString()
    assert "vector_to_array" not in plan and "Exchange" not in plan


def test_single_class_is_rejected(spark):
    df = spark.createDataFrame([([1.0], 1), ([0.5], 1)], "w array<double>, label int")
    try:
        rk.fit_logistic(df, "w", "label")
    except ValueError as e:
        assert "two classes" in str(e)
    else:
        raise AssertionError("expected ValueError")


def _counted(texts, k):
    """The ``k`` most frequent words and bigrams with their counts, in plain Python."""
    cf, df = Counter(), Counter()
    for t in texts:
        w = t.split()
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        cf.update(terms)
        df.update(set(terms))
    return [(t, cf[t], df[t]) for t in sorted(cf, key=lambda t: (-cf[t], t))[:k]]


def _corpus(spark, texts, tasks=4):
    return spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, part boolean").repartition(tasks, "doc_id")


def _zipf(seed, n, size):
    rng = random.Random(seed)
    return [" ".join(f"w{int(rng.paretovariate(0.9))}" for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("counters, told", [(20_000, True), (400, True), (12, False)])
def test_top_terms_by_summaries_equal_full_counts(spark, counters, told):
    texts = _zipf(counters, 300, 40) + ["", "w1", "w1 w1 w1"]
    corpus = _corpus(spark, texts)
    tokens = tokenize(F.col("text"))
    words = vz.frequent_words(corpus.select("part", tokens.alias("terms")), 30, counters)
    assert (words is not None) == told  # too few counters: everything is counted
    got = [tuple(r) for r in vz.top_terms(corpus, 30, (), counters=counters).collect()]
    assert got == _counted(texts, 30)
    assert [tuple(r) for r in vz.top_terms(corpus, 30, (), counters=counters, max_candidates=5).collect()] == got


def test_word_summaries_bound_the_counts(spark):
    texts = _zipf(7, 400, 50)
    cf = Counter(w for t in texts for w in t.split())
    rows = vz.word_summaries(_corpus(spark, texts, 6).select(tokenize(F.col("text")).alias("terms")), counters=100).collect()
    lost = sum(r.n for r in rows if r.term is None)
    kept = {r.term: r.n for r in rows if r.term is not None}
    assert 0 < lost and len(kept) < len(cf)
    assert all(kept.get(w, 0) <= n <= kept.get(w, 0) + lost for w, n in cf.items())


def test_top_terms_of_ties_and_nothing(spark):
    texts = [f"t{i:03d} t{i:03d}" for i in range(50)]  # all words equally frequent
    assert [tuple(r) for r in vz.top_terms(_corpus(spark, texts), 10, ()).collect()] == _counted(texts, 10)
    assert [tuple(r) for r in vz.top_terms(_corpus(spark, texts), 10, (), counters=3).collect()] == _counted(texts, 10)
    assert vz.top_terms(_corpus(spark, []), 10, ()).collect() == []
    assert vz.top_terms(_corpus(spark, ["", " "]), 10, ()).collect() == []


def test_exploded_arrays_are_made_once(spark):
    """No filter inferred from the explode evaluates the weights a second time."""
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta"), (3, None)], "doc_id long, text string")
    vocab, _ = vz.fit_corpus(docs, vz.query_from_text(spark, "alpha beta"))
    long = vz.explode_weights(vz.sparse_docs(docs, vocab, "text", ["doc_id"]), vocab, ["doc_id"], "sw")
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert {(r.doc_id, r.term) for r in long.collect()} == {(1, "alpha"), (1, "alpha beta"), (1, "beta"), (1, "beta gamma"), (1, "gamma"), (2, "beta")}


def test_document_terms_adds_up_rows_that_share_an_id(spark):
    """Counted in the row, and by id only where an id is there more than once (null ids too)."""
    rows = [(1, "alpha beta alpha beta"), (2, "Beta the gamma"), (2, "beta"), (None, "x1 x1"), (None, "x1"), (3, ""), (4, None), (5, "the of"), (6, "ärger Über ärger")]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.term, r.tf) for r in vz.document_terms(corpus).collect()))
    assert got == sorted([(1, "alpha", 2), (1, "beta", 2), (1, "alpha beta", 2), (1, "beta alpha", 1), (2, "beta", 2), (2, "gamma", 1), (2, "beta gamma", 1),
                          (0, "x1", 3), (0, "x1 x1", 1), (6, "ärger", 2), (6, "über", 1), (6, "ärger über", 1), (6, "über ärger", 1)])
    plan = vz.document_terms(corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
