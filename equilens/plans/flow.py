"""End-to-end flows: rank -> audit -> explain (E1), prepare (E2), parse a
folder (E3).  Every step is a function of DataFrames returning DataFrames;
the only eager steps are the bounded fits (vocabulary, query vector, model,
column means, noise flags, leader vector)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import attribute as at
from ..operators import audit as au
from ..operators import rank as rk
from ..operators import vectorize as vz
from ..session import materialize


@dataclass
class RankResult:
    ranked: DataFrame            # input columns + sw (and w), score, label, model_score, recommended, rank
    vocab: vz.Vocabulary
    query_weights: tuple
    model: rk.LinearModel
    coef: tuple
    intercept: float


def rank_documents(docs: DataFrame, query: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_features: int = fixed.MAX_FEATURES, keep: list[str] | None = None,
                   cut_lineage: bool = True) -> RankResult:
    """Fit TF-IDF on documents + query, score by cosine, label by the median,
    fit the logistic model on the TF-IDF vectors, predict, and rank."""
    vocab, qw = vz.fit_corpus(docs, query, id_col, text_col, max_features)
    cols = [id_col] + [c for c in (keep or []) if c != id_col]
    t = vocab.add_terms(docs.select(*dict.fromkeys(cols + [text_col])), text_col, "_terms")
    if text_col not in cols:
        t = t.drop(text_col)
    counts = vocab.counts(t, "_terms", "tf_vec").drop("_terms")
    if cut_lineage:
        # Reused by the model fit, the predictions, the audit and both
        # explainers: cut lineage once instead of re-tokenizing per consumer.
        counts = materialize(counts)
    # ``w`` is the dense form of ``sw``; only a caller who selects it has it made.
    scored = rk.cosine_score(vocab.weights_from_counts(vocab.sparse_weights(counts, "tf_vec"), "tf_vec", "w"), qw, "sw")
    return model_and_rank(scored, vocab, qw, id_col)


def model_and_rank(scored: DataFrame, vocab: vz.Vocabulary, query_weights, id_col: str = "doc_id") -> RankResult:
    """From scored documents (with entries ``sw``): median label, logistic
    fit, predictions and the distributed rank."""
    labeled = rk.median_label(scored)
    model = rk.fit_newton(labeled, vocab.size)
    pred = rk.predict(labeled, model.coef, model.intercept, "sw")
    ranked = rk.global_rank(pred, ["-score", id_col], "rank")
    return RankResult(ranked, vocab, tuple(query_weights), model, model.coef, model.intercept)


def fairness_audit(ranked: DataFrame, attrs=fixed.AUDIT_ATTRIBUTES, rec_col: str = "recommended",
                   id_col: str = "doc_id"):
    """(groups, report, nested report)."""
    groups = au.audit_groups(ranked, list(attrs), "score", rec_col, id_col)
    report = au.audit_report(groups)
    return groups, report, au.audit_nested(groups, report)


def model_explainer(result: RankResult, names: DataFrame, name_col: str = "name",
                    name_split: str = "tokens") -> at.LinearExplainer:
    """Explainer of the model's log-odds: coefficients of the fitted model,
    means over all ranked documents, noise flags from all names."""
    spark = result.ranked.sparkSession
    mean = at.feature_means(result.ranked, "sw", result.vocab.size)
    noise = at.noise_terms(result.vocab.table(spark), at.name_words_frame(names, name_col, name_split))
    return at.build_explainer(result.vocab.terms, result.coef, mean, noise, result.intercept)


def explain_ranked(result: RankResult, ex: at.LinearExplainer, name_col: str = "name",
                   id_col: str = "doc_id") -> DataFrame:
    """Per document: ordered terms, top-features table, bias note, contrast
    terms and sentence, rank, score, recommendation text."""
    lead = result.ranked.orderBy(F.desc("score"), F.asc(id_col)).select("sw").first()
    lead_attr = ex.attributions(vz.dense_row(lead["sw"], len(ex.terms))) if lead is not None else [0.0] * len(ex.terms)
    d = at.contrast(at.explain(result.ranked, ex, "sw"), ex, lead_attr, "sw")
    return d.select(id_col, "rank", "score", tx.recommended_text(F.col("recommended")).alias("recommended_text"),
                    "ordered", "top_features", "bias_note", "gap_terms",
                    at.contrast_text(F.col(name_col), F.col("rank"), F.col("gap_terms"),
                                     F.col("top_features")).alias("contrastive"))
