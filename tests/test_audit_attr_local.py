"""Audit, exact attribution and the local explainer."""

import numpy as np
from pyspark.sql import functions as F

from equilens.functions import fixed
from equilens.operators import attribute as at
from equilens.operators import audit as au
from equilens.operators import local as lo
from equilens.operators import rank as rk
from equilens.operators import vectorize as vz
from equilens.plans import flow as pl
from equilens.functions import text as tx
from tests.fixture_texts import QUERY, TEXTS

def fixture_docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t = F.col("text")
    return df.select("doc_id", "text", tx.extract_name(t).alias("name"), tx.gender_proxy(t).alias("gender_proxy"),
                     tx.institution_tier(t).alias("institution_tier"), tx.career_gap(t).alias("career_gap"),
                     tx.name_origin(tx.extract_name(t)).alias("name_origin_proxy"))


def test_audit_group_sizes_and_report(spark):
    d = fixture_docs(spark).withColumn("score", F.lit(0.5)).withColumn("recommended", F.lit(1)) \
        .withColumn("single", F.lit("x"))
    g = au.audit_groups(d, ["gender_proxy", "institution_tier", "career_gap", "name_origin_proxy", "single"])
    sizes = {(r["attr"], r["grp"]): r["n"] for r in g.collect()}
    assert sizes[("gender_proxy", "Female proxy")] == 1 and sizes[("gender_proxy", "Unspecified")] == 9
    assert sizes[("institution_tier", "Tier 1")] == 3 and sizes[("institution_tier", "Tier 2/3")] == 7
    assert sizes[("career_gap", "Yes")] == 1
    assert sizes[("name_origin_proxy", "South Asian proxy")] == 3 and sizes[("name_origin_proxy", "Other")] == 2
    rep = au.audit_report(g).orderBy("position").collect()
    assert "single" not in [r["attr"] for r in rep]           # one group -> not reported
    assert [r["disparity"] for r in rep] == [0.0] * 4         # all scores equal
    assert [r["attr"] for r in rep] == ["gender_proxy", "institution_tier", "career_gap", "name_origin_proxy"]
    # ties go to the group seen first in rank order (score desc, id asc): doc 0 is Unspecified
    assert rep[0]["favoured"] == "Unspecified" and rep[0]["disadvantaged"] == "Unspecified"
    assert [r["severity"] for r in rep] == ["Highest", "Moderate", "Lower", "Lower"]


def test_audit_means_are_exact_half_up(spark):
    d = spark.createDataFrame([(1, "a", 0.1234, 1), (2, "a", 0.1235, 0), (3, "b", 0.2, 1)],
                              "doc_id long, g string, score double, recommended int")
    r = {x["grp"]: x for x in au.audit_groups(d, ["g"]).collect()}
    assert r["a"]["mean_score"] == 0.1235 and r["a"]["rec_rate"] == 0.5
    rep = au.audit_report(au.audit_groups(d, ["g"])).first()
    assert rep["disparity"] == 0.0765 and rep["favoured"] == "b" and rep["disadvantaged"] == "a"


def ranked_fixture(spark):
    d = fixture_docs(spark)
    return pl.rank_documents(d, vz.query_from_text(spark, QUERY), keep=["name", "gender_proxy", "institution_tier",
                                                                      "career_gap", "name_origin_proxy"])


def test_flow_attributions_sum_to_margin(spark):
    res = ranked_fixture(spark)
    ranked = res.ranked.collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 11))
    ex = pl.model_explainer(res, res.ranked.select("name"))
    X = np.array([r["w"] for r in ranked])
    coef = np.array(res.coef)
    mean = X.mean(axis=0)
    assert np.allclose(ex.mean, mean)
    for r in ranked:
        attr = ex.attributions(r["w"])
        margin = float(np.dot(coef, r["w"]))
        assert abs(sum(attr) - (margin - float(coef @ mean))) < 1e-9
    out = pl.explain_ranked(res, ex).collect()
    assert len(out) == 10
    for r in out:
        assert 1 <= len(r["ordered"]) <= 10 and len(r["top_features"]) <= 6 and len(r["bias_note"]) <= 3
        if r["rank"] == 1:
            assert "is the top-ranked candidate" in r["contrastive"]
    _, report, nested = pl.fairness_audit(res.ranked)
    assert report.count() == nested.count() >= 1


def test_attribution_rows_add_up_to_the_dense_ones(spark):
    """A document's own rows over the base rows are all its attributions."""
    rng = np.random.default_rng(3)
    V = 9
    ex = at.LinearExplainer(tuple(f"t{j}" for j in range(V)), tuple(rng.normal(size=V)), tuple(np.abs(rng.normal(size=V))), (False,) * V)
    rows = [(i, [float(x) if rng.random() < 0.5 else 0.0 for x in rng.random(V)]) for i in range(12)] + [(12, [0.0] * V)]
    df = spark.createDataFrame(rows, "doc_id long, w array<double>")
    out = at.attribution_sparse(df, ex, ["doc_id"]).collect()
    base = {r.term: r.value for r in out if r.doc_id is None}
    own = {(r.doc_id, r.term): r.value for r in out if r.doc_id is not None}
    assert len(base) == V and set(own) == {(i, f"t{j}") for i, x in rows for j in range(V) if x[j]}
    long = {(r.doc_id, r.term): r.value for r in at.attribution_long(df, ex, ["doc_id"]).collect()}
    for i, x in rows:
        for j, v in enumerate(ex.attributions(x)):
            assert abs(own.get((i, f"t{j}"), base[f"t{j}"]) - v) < 1e-6 and abs(long[i, f"t{j}"] - v) < 1e-6


def test_explain_order_and_fallback(spark):
    ex = at.LinearExplainer(("a", "b", "c"), (1.0, -1.0, 2.0), (0.0, 0.0, 0.0), (False, False, True))
    df = spark.createDataFrame([([0.5, 0.25, 0.1],)], "w array<double>")
    r = at.explain(df, ex, n=2).first()
    # clean terms a (+0.5) and b (-0.25): non-positive first, then positive descending
    assert [(e["term"], e["value"]) for e in r["ordered"]] == [("b", -0.25), ("a", 0.5)]
    assert [(e["term"], e["value"]) for e in r["bias_note"]] == [("c", 0.2)]
    allnoise = at.LinearExplainer(("a", "b"), (1.0, 1.0), (0.0, 0.0), (True, True))
    r2 = at.explain(spark.createDataFrame([([0.1, 0.3],)], "w array<double>"), allnoise).first()
    assert [e["term"] for e in r2["ordered"]] == ["a", "b"]     # ascending |value| fallback


def test_weighted_ridge_dual_equals_primal():
    rng = np.random.default_rng(1)
    X = (rng.random((30, 8)) > 0.5).astype(float)
    y = rng.random(30)
    sw = rng.random(30) + 0.1
    primal = lo.weighted_ridge(X, y, sw, 0.5)
    wide = np.hstack([X, np.zeros((30, 40))])
    dual = lo.weighted_ridge(wide, y, sw, 0.5)[:8]
    assert np.allclose(primal, dual)


def test_local_attribution_runs_and_sample_zero_is_intact(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS.values())], "doc_id long, text string")
    vocab, qw = vz.fit_corpus(docs, vz.query_from_text(spark, QUERY))
    s = lo.perturbed_scores(docs, vocab, qw, None, n_samples=20)
    base = {r["doc_id"]: r["score"] for r in rk.cosine_score(vz.weighted_docs(docs, vocab, "text", ["doc_id"]), qw,
                                                             decimals=12).collect()}
    for r in s.where("s = 0").collect():
        assert abs(r["label"] - base[r["doc_id"]]) < 1e-9
    m = lo.removed_words(lo.samples(lo.word_features(docs), 20)).collect()
    assert all(len(r["removed"]) == r["r"] and 1 <= r["r"] <= r["W"] for r in m if r["s"] > 0)
    out = lo.local_attribution(docs, vocab, qw, 0.0, n_samples=30).collect()
    per_doc = {}
    for r in out:
        per_doc.setdefault(r["doc_id"], []).append(r)
    assert set(per_doc) == set(range(10))
    assert all(len(v) == 10 for v in per_doc.values())


def test_local_explanation_finds_the_planted_word_and_solves_the_ridge(spark):
    """A score that one word decides; weights compared with an independent solve."""
    texts = [(i, " ".join(f"word{(i * 7 + k) % 23}" for k in range(12)) + " planted") for i in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    vocab, _ = vz.fit_corpus(docs, vz.query_from_text(spark, "planted"))
    coef = [1.0 if t == "planted" else 0.0 for t in vocab.terms]
    out = lo.local_attribution(docs, vocab, coef, None, n_samples=60).collect()
    assert {r["doc_id"] for r in out if r["pos"] == 1 and r["word"] == "planted" and r["weight"] > 0} == set(range(6))
    scores = {(r["doc_id"], r["s"]): r for r in lo.perturbed_scores(docs, vocab, coef, None, n_samples=60).collect()}
    gone = {(r["doc_id"], r["s"]): set(r["removed"]) for r in lo.removed_words(lo.samples(lo.word_features(docs), 60)).collect()}
    for i, text in texts:
        top = [(r["word"], r["weight"]) for r in sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["pos"])]
        names = [w for w, _ in top]
        z = np.array([[w not in gone[i, s] for w in names] for s in range(60)], float)
        y = np.array([scores[i, s]["label"] for s in range(60)])
        k = np.array([scores[i, s]["kernel"] for s in range(60)])
        # normal equations with an explicit intercept column that is not penalized
        x = np.hstack([z, np.ones((60, 1))])
        penalty = fixed.FINAL_RIDGE_ALPHA * np.diag([1.0] * len(names) + [0.0])
        want = np.linalg.solve(x.T @ (k[:, None] * x) + penalty, x.T @ (k * y))[:-1]
        assert np.allclose([v for _, v in top], want, atol=1e-9)


def _brute(ex, x, n=10, n_bias=3, lead=None):
    vals = [c * (xi - m) for c, xi, m in zip(ex.coef, x, ex.mean)]
    key = lambda j: (round(-abs(vals[j]), 12), ex.terms[j])
    clean = [j for j in range(len(vals)) if not ex.noise[j]]
    top = sorted(clean, key=key)[:n]
    disp = sorted(top, key=lambda j: (1 if vals[j] > 0 else 0, round(-vals[j] if vals[j] > 0 else vals[j], 12),
                                      top.index(j)))
    bias = sorted([j for j in range(len(vals)) if ex.noise[j] and abs(vals[j]) > 1e-6], key=key)[:n_bias]
    out = {"ordered": [(ex.terms[j], vals[j]) for j in disp], "bias": [ex.terms[j] for j in bias]}
    if lead is not None:
        gaps = {j: lead[j] - vals[j] for j in clean if lead[j] - vals[j] > 0}
        out["gap"] = [ex.terms[j] for j in sorted(gaps, key=lambda j: (round(-gaps[j], 12), ex.terms[j]))[:3]]
    return out


def test_pruned_attribution_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    V = 60
    terms = tuple(f"t{j:03d}" for j in range(V))
    coef = rng.normal(size=V)
    coef[rng.random(V) < 0.2] = 0.0
    ex = at.LinearExplainer(terms, tuple(coef), tuple(np.abs(rng.normal(size=V)) * 0.1),
                            tuple(bool(b) for b in rng.random(V) < 0.3))
    rows = []
    for i in range(40):
        x = np.zeros(V)
        nz = rng.choice(V, size=rng.integers(0, 25), replace=False)
        x[nz] = rng.random(len(nz))
        rows.append((i, x.tolist()))
    df = spark.createDataFrame(rows, "doc_id long, w array<double>")
    lead = ex.attributions(rows[0][1])
    got = {r["doc_id"]: r for r in at.contrast(at.explain(df, ex), ex, lead).collect()}
    for i, x in rows:
        want = _brute(ex, x, lead=lead)
        assert [(e["term"], e["value"]) for e in got[i]["ordered"]] == [(t, v) for t, v in want["ordered"]]
        assert [e["term"] for e in got[i]["bias_note"]] == want["bias"]
        assert [e["term"] for e in got[i]["gap_terms"]] == want["gap"]


def test_sample_scores_equal_scoring_each_perturbed_text(spark):
    """Matrix scores against building every perturbed text and weighing it anew,
    also when arrays are cut into blocks of samples."""
    import random

    r = random.Random(2)
    words = ["alpha", "Beta", "beta", "gamma", "the", "x", "delta", "it's", "Gamma"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 30, 90])))) for i in range(12)] + [(50, None), (51, "the of"), (52, "alpha beta")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    vocab, qw = vz.fit_corpus(docs, vz.query_from_text(spark, "alpha beta gamma delta beta"), max_features=14)
    assert any(" " in t for t in vocab.terms)
    gone = {(x.doc_id, x.s): set(x.removed) for x in lo.removed_words(lo.samples(lo.word_features(docs), 25)).collect()}
    import re
    left = [(d, s, " ".join(w for w in re.findall(r"\w+", dict(texts)[d] or "") if w not in gone[d, s])) for d, s in gone]
    again = spark.createDataFrame(left, "doc_id long, s int, text string")
    want = {(x.doc_id, x.s): x.score for x in rk.cosine_score(vz.sparse_docs(again, vocab, "text", ["doc_id", "s"]), qw, "sw", decimals=12).collect()}
    got = {(x.doc_id, x.s): x.label for x in lo.perturbed_scores(docs, vocab, qw, None, n_samples=25).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in got) < 1e-9
    kept = np.array([[True, False, True], [True, True, True], [False, False, False]])
    scorer = lo.Scorer.of(vocab, qw, 0.5)
    at_, toks = np.array([0, 1, 2, 0]), ["alpha", "beta", "gamma", "alpha"]
    whole = scorer.scores(at_, toks, kept)
    cells, lo.CELLS = lo.CELLS, 4
    try:
        assert np.allclose(whole, scorer.scores(at_, toks, kept))
        a, b, c = np.array([5, 9, 5]), np.array([3, 7, 11, 2]), np.array([1, 0, 4, 9])
        small = lo.kept_words(a, b, c, np.array([0, 1, 2, 3]))
    finally:
        lo.CELLS = cells
    assert (small == lo.kept_words(a, b, c, np.array([0, 1, 2, 3]))).all() and list(small.sum(1)) == [3, 2, 1, 0]


def test_stacked_ridges_equal_one_by_one():
    rng = np.random.default_rng(6)
    masks = [(rng.random((20, w)) > 0.4).astype(float) for w in (1, 5, 30, 200)]
    scores = [rng.random(20) for _ in masks]
    kernels = [rng.random(20) + 0.05 for _ in masks]
    for got, z, y, k in zip(lo.ridge_of_batch(masks, scores, kernels, 0.3), masks, scores, kernels):
        assert np.allclose(got, lo.weighted_ridge(z, y, k, 0.3), atol=1e-10)


def test_local_attribution_of_short_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, ""), (3, None), (4, "alpha beta alpha"), (4, "alpha beta alpha")], "doc_id long, text string")
    vocab, qw = vz.fit_corpus(docs, vz.query_from_text(spark, "alpha"))
    out = lo.local_attribution(docs, vocab, qw, 0.0, n_samples=12).collect()
    assert sorted((r.doc_id, r.pos, r.word) for r in out if r.doc_id == 1) == [(1, 1, "alpha")]
    assert len([r for r in out if r.doc_id == 4]) == 4 and not [r for r in out if r.doc_id in (2, 3)]


def test_removed_digests_are_those_of_the_words_removed(spark):
    """One mask matrix per document against ordering the words of every sample by
    its keyed priority; ids that are null or repeat, and words of one multiplier."""
    import hashlib

    text = "one two three two Zwei über été x y z"
    docs = spark.createDataFrame([(1, text), (None, "a b c"), (1, "solo"), (2, ""), (3, None)], "doc_id long, text string")
    number = lambda s, k: int(hashlib.md5(s.encode()).hexdigest()[k:k + 8], 16)

    def want(doc, words, s):
        key = f"{fixed.SEED}|" + ("" if doc is None else f"{doc}|")
        b, c, r = 1 + number(f"{key}sample|{s}", 0) % (lo.P - 1), number(f"{key}sample|{s}", 8) % lo.P, 1 + number(f"{key}sample|{s}", 16) % len(words)
        first = sorted(words, key=lambda w: ((number(key + w, 0) % lo.P * b + c) % lo.P, w))
        return sorted(first[:r if s else 0])

    f = lo.samples(lo.word_features(docs), 9)
    listed = {(r.doc_id, r.W, r.s): r.removed for r in lo.removed_words(f).collect()}
    assert listed == {(d, len(w), s): want(d, w, s) for d, w in ((1, sorted(set(text.split()))), (None, ["a", "b", "c"]), (1, ["solo"])) for s in range(9)}
    cells, lo.CELLS = lo.CELLS, 10
    try:
        digests = lo.removed_words(f, digest=True).collect()
    finally:
        lo.CELLS = cells
    assert {(r.doc_id, r.W, r.s): r.removed_md5 for r in digests} == {k: hashlib.md5(" ".join(w).encode()).hexdigest() for k, w in listed.items()}
    same = np.array([5, 9, 5, 5]), np.array([3, 7]), np.array([1, 0]), np.array([2, 3])
    order = [np.argsort((same[0] * b + c) % lo.P, kind="stable")[:r] for b, c, r in zip(*same[1:])]
    assert [sorted(np.flatnonzero(~k)) for k in lo.kept_words(*same)] == [sorted(o) for o in order]


def test_masks_make_no_row_of_words_a_sample(spark):
    """The masks explode nothing and the runs are made once: no filter repeats them."""
    docs = spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string")
    plan = lo.removed_words(lo.samples(lo.word_features(docs)), digest=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("regexp_extract_all") == 1
