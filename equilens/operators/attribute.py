"""Exact attribution for a linear score.

For a linear model ``f(x) = b + sum_j c_j x_j`` with independent features,
the per-term attribution against the corpus mean is exactly
``c_j (x_j - mean_j)`` (absent terms included).  The attribution matrix is
dense (n x V) but a term's value is the same, ``-c_j mean_j``, in all documents
that have it not: these base values and their order are made once, and a row
looks at its own terms and at as many of the first base terms as could reach
its top few.  No shuffle, no join.

Inputs that reach the driver are bounded by the vocabulary size: the
coefficients, the column means (one aggregation by term), the noise flags
(a broadcast semi-join of vocabulary words against the name tokens), and
the leader's attribution vector (a top-1).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.tokens import bigrams, elements, tokenize
from .vectorize import entries

ORDER_DECIMALS = 12   # attributions equal to 12 decimals count as ties (broken by term)


@dataclass(frozen=True)
class LinearExplainer:
    terms: tuple[str, ...]
    coef: tuple[float, ...]
    mean: tuple[float, ...]
    noise: tuple[bool, ...]
    intercept: float = 0.0

    def attributions(self, x) -> list[float]:
        """Python-side attributions of one bounded vector (the leader's)."""
        return [c * (xi - m) for c, xi, m in zip(self.coef, x, self.mean)]


# -- corpus statistics ----------------------------------------------------------

def feature_means(weighted: DataFrame, w_col: str = "w", size: int | None = None) -> tuple[float, ...]:
    """Column means of the weights.  Entries are summed by term number, combined
    in each partition to at most one row per term; ``size`` is the number of terms
    (read off the first row of a dense column)."""
    if size is None:
        first = weighted.select(w_col).first()
        size = len(first[w_col]) if first is not None else 0
    sums = weighted.select(F.explode(elements(entries(weighted, w_col))).alias("e")).groupBy(F.col("e.i").alias("i")).agg(F.sum("e.x").alias("s")).collect()
    n, out = weighted.count(), [0.0] * size
    for r in sums:
        out[r["i"]] = r["s"] / n
    return tuple(out)


# -- name tokens and noise terms (X2-X4) ------------------------------------------

def name_words(names: DataFrame, name_col: str = "name", split: str = "tokens") -> Column:
    c = F.col(name_col)
    if split == "tokens":
        return tokenize(c)
    if split == "whitespace":
        return F.filter(F.split(F.lower(tx.text_or_empty(c)), f"[{tx.WS}]+"), lambda w: w != F.lit(""))
    raise ValueError(f"split must be 'tokens' or 'whitespace', not {split!r}")


def name_tokens(names: DataFrame, name_col: str = "name", split: str = "tokens",
                with_bigrams: bool = True) -> DataFrame:
    """Distinct lower-case name words (and adjacent word pairs) of all names."""
    words = names.select(name_words(names, name_col, split).alias("_w"))
    toks = words.select(F.explode(elements(F.col("_w"))).alias("token"))
    if with_bigrams:
        toks = toks.unionByName(words.select(F.explode(bigrams(F.col("_w"))).alias("token")))
    return toks.distinct()


def noise_terms(vocab: DataFrame, name_toks: DataFrame) -> DataFrame:
    """(idx, term, is_noise) for every vocabulary term.

    A term is noise if it is a 19xx/20xx year, contains '@', or one of its
    words is a fixed noise word or a word of any name.  The vocabulary side
    (at most 2 x max_features words) is broadcast; the name tokens, which
    grow with the corpus, stream through a semi-join, and only the matches
    (at most the vocabulary's words) are de-duplicated."""
    vw = vocab.select("idx", F.explode(F.split("term", " ")).alias("word"))
    vocab_words = vw.select("word").distinct()
    matched = (name_toks.select(F.col("token").alias("word"))
               .join(F.broadcast(vocab_words), "word", "left_semi").distinct())
    hit = vw.join(F.broadcast(matched), "word", "left_semi").select("idx").distinct() \
        .withColumn("_name_hit", F.lit(True))
    words = F.split(F.col("term"), " ")
    static = (F.col("term").rlike(fixed.NOISE_YEAR_RE) | F.col("term").contains("@")
              | F.arrays_overlap(words, F.array(*[F.lit(w) for w in fixed.NOISE_WORDS])))
    return (vocab.join(F.broadcast(hit), "idx", "left")
            .select("idx", "term", (static | F.coalesce(F.col("_name_hit"), F.lit(False))).alias("is_noise")))


def name_words_frame(names: DataFrame, name_col: str = "name", split: str = "tokens") -> DataFrame:
    """All name words as rows (no de-duplication: :func:`noise_terms`
    semi-joins them against the vocabulary first)."""
    return names.select(F.explode(name_words(names, name_col, split)).alias("token"))


def build_explainer(terms, coef, mean, noise_df: DataFrame, intercept: float = 0.0) -> LinearExplainer:
    flags = {r["idx"]: bool(r["is_noise"]) for r in noise_df.select("idx", "is_noise").collect()}
    return LinearExplainer(tuple(terms), tuple(float(c) for c in coef), tuple(mean),
                           tuple(flags.get(i, False) for i in range(len(terms))), float(intercept))


# -- per-document attribution (X1, X5-X8) ---------------------------------------------

def _order(values, terms, eligible) -> list[int]:
    """Numbers of the eligible terms by (-|value| rounded, term)."""
    return sorted((j for j in range(len(terms)) if eligible[j]), key=lambda j: (round(-abs(values[j]), ORDER_DECIMALS), terms[j]))


def _literal(values, kind: str) -> Column:
    return F.lit(list(values)) if len(values) else F.array().cast(f"array<{kind}>")


def _top(d: DataFrame, ex: LinearExplainer, present: Column, absent: list[float], order: list[int], n: int) -> Column:
    """The first ``n`` items (k, term, value) by (k, term) of the document's own
    items and the terms it has not.

    A term that a document has not has the same value in all such documents,
    so these terms have one order, ``order``.  Of its first n + (entries) terms the document
    has at most (entries), so the n best absent ones are among them."""
    values, terms = _literal(absent, "double"), _literal(ex.terms, "string")
    keys = _literal([round(-abs(v), ORDER_DECIMALS) for v in absent], "double")
    near = F.slice(_literal(order, "int").cast("array<int>"), 1, F.size("_e") + n)
    best = F.slice(F.array_except(near, F.transform("_e", lambda e: e["i"])), 1, n)
    others = F.transform(best, lambda i: F.struct(keys[i].alias("k"), terms[i].alias("term"), values[i].alias("value")))
    return F.slice(F.array_sort(F.concat(present, others)), 1, n)


def _present(ex: LinearExplainer, value, keep) -> Column:
    """(k, term, value) of the document's entries whose number and value satisfy ``keep``."""
    terms = _literal(ex.terms, "string")
    items = F.transform("_e", lambda e: F.struct(e["i"].alias("i"), value(e).alias("value")))
    return F.transform(F.filter(items, lambda e: keep(e["i"], e["value"])), lambda e: F.struct(
        F.round(F.lit(0.0) - F.abs(e["value"]), ORDER_DECIMALS).alias("k"), terms[e["i"]].alias("term"), e["value"].alias("value")))


def explain(weighted: DataFrame, ex: LinearExplainer, w_col: str = "w", n: int = fixed.TOP_CLEAN_TERMS,
            n_table: int = fixed.TOP_TABLE_TERMS, n_bias: int = fixed.TOP_BIAS_TERMS) -> DataFrame:
    """Adds, per document:

    * ``ordered``: the top-n clean terms (by |value|, ties by term) in display
      order (non-positive ascending, then positive descending); if no term is
      clean, the top-n of all terms in ascending |value|.
    * ``top_features``: the first ``n_table`` of ``ordered`` by |value|, 4 dp.
    * ``bias_note``: top ``n_bias`` noise terms with |value| > 1e-6, 5 dp.

    Work and memory of a row follow the terms that the document has.
    """
    absent = [-c * m for c, m in zip(ex.coef, ex.mean)]
    coef, mean, noise = _literal(ex.coef, "double"), _literal(ex.mean, "double"), _literal(ex.noise, "boolean")
    value = lambda e: coef[e["i"]] * (e["x"] - mean[e["i"]])
    d = weighted.withColumn("_e", entries(weighted, w_col))
    if not all(ex.noise):
        top = _top(d, ex, _present(ex, value, lambda i, v: ~noise[i]), absent, _order(absent, ex.terms, [not f for f in ex.noise]), n)
        pick = F.array_sort(F.transform(top, lambda e, i: F.struct(
            F.when(e["value"] > 0, 1).otherwise(0).alias("g"),
            F.round(F.when(e["value"] > 0, -e["value"]).otherwise(e["value"]), ORDER_DECIMALS).alias("key"),
            i.alias("i"), e["term"].alias("term"), e["value"].alias("value"))))
    else:
        pick = F.reverse(_top(d, ex, _present(ex, value, lambda i, v: F.lit(True)), absent, _order(absent, ex.terms, [True] * len(ex.terms)), n))
    ordered = F.transform(pick, lambda e: F.struct(e["term"].alias("term"), e["value"].alias("value")))
    d = d.withColumn("ordered", ordered)
    table = F.slice(F.array_sort(F.transform("ordered", lambda e, i: F.struct(
        F.round(F.lit(0.0) - F.abs(e["value"]), ORDER_DECIMALS).alias("k"), i.alias("i"),
        e["term"].alias("term"), e["value"].alias("value")))), 1, n_table)
    d = d.withColumn("top_features", F.transform(table, lambda e: F.struct(
        e["term"].alias("term"), (F.round(e["value"], fixed.SCORE_DECIMALS) + F.lit(0.0)).alias("value"))))
    eligible = [f and abs(v) > fixed.BIAS_MIN_ABS for f, v in zip(ex.noise, absent)]
    noisy = _top(d, ex, _present(ex, value, lambda i, v: noise[i] & (F.abs(v) > F.lit(fixed.BIAS_MIN_ABS))), absent, _order(absent, ex.terms, eligible), n_bias)
    d = d.withColumn("bias_note", F.transform(noisy, lambda e: F.struct(
        e["term"].alias("term"), (F.round(e["value"], 5) + F.lit(0.0)).alias("value"))))
    return d.drop("_e")


# -- contrast against the leader (X9-X10) -------------------------------------------------

def contrast(explained: DataFrame, ex: LinearExplainer, leader_attr, w_col: str = "w",
             n: int = fixed.CONTRAST_TERMS) -> DataFrame:
    """Adds ``gap_terms``: clean terms with a positive gap ``attr_leader -
    attr_doc``, largest first (ties by term), at most ``n``."""
    coef, mean, noise, lead = (_literal(x, kind) for x, kind in ((ex.coef, "double"), (ex.mean, "double"), (ex.noise, "boolean"), (list(leader_attr), "double")))
    # The gap of a term that a document has not is lead_j + c_j m_j.
    absent = [a + c * m for a, c, m in zip(leader_attr, ex.coef, ex.mean)]
    eligible = [not f and g > 0 for f, g in zip(ex.noise, absent)]
    d = explained.withColumn("_e", entries(explained, w_col))
    own = _present(ex, lambda e: lead[e["i"]] - coef[e["i"]] * (e["x"] - mean[e["i"]]), lambda i, g: ~noise[i] & (g > 0))
    top = _top(d, ex, own, absent, _order(absent, ex.terms, eligible), n)
    return d.withColumn("gap_terms", F.transform(top, lambda e: F.struct(e["term"].alias("term"), e["value"].alias("gap")))).drop("_e")


_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill(template: str, **cols: Column) -> Column:
    """Template with ``{name}`` placeholders -> concat of literals and columns."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def contrast_text(name: Column, rank: Column, gap_terms: Column, top_features: Column) -> Column:
    """The contrast sentence for a document (three templates)."""
    f = [gap_terms[i]["term"] for i in range(3)]
    improve = F.concat(
        fill(fixed.CONTRAST_IMPROVE, name=name, f0=f[0]),
        F.when(F.size(gap_terms) > 1, fill(fixed.CONTRAST_FOLLOWED, f1=f[1])).otherwise(F.lit("")),
        F.when(F.size(gap_terms) > 2, fill(fixed.CONTRAST_AND, f2=f[2])).otherwise(F.lit("")),
        fill(fixed.CONTRAST_QUESTION, name=name, f0=f[0]))
    best = F.slice(F.filter(top_features, lambda e: e["value"] > 0), 1, 3)
    signals = F.when(F.size(best) > 0, F.array_join(F.transform(best, lambda e: F.concat(
        F.lit("**"), e["term"], F.lit("**"))), ", ")).otherwise(F.lit(fixed.CONTRAST_LEADER_GENERIC))
    leader = F.concat(fill(fixed.CONTRAST_LEADER, name=name), signals, F.lit("."))
    return (F.when(rank == 1, leader)
            .when(F.size(gap_terms) > 0, improve)
            .otherwise(fill(fixed.CONTRAST_NO_GAP, name=name)))


def attribution_long(weighted: DataFrame, ex: LinearExplainer, keys: list[str], w_col: str = "w",
                     decimals: int = 6) -> DataFrame:
    """(keys..., term, value) for every term with a non-zero attribution.  The
    output is documents times terms by definition: :func:`attribution_sparse`
    says the same in rows that follow the entries."""
    base = F.lit([float(-c * m) for c, m in zip(ex.coef, ex.mean)])
    coef, terms = _literal(ex.coef, "double"), _literal(ex.terms, "string")
    # The absent terms' values in order, then those of the document's entries on top.
    d = weighted.select(*keys, entries(weighted, w_col).alias("_e"))
    present = F.map_from_arrays(F.transform("_e", lambda e: e["i"]), F.transform("_e", lambda e: e["x"]))
    d = d.withColumn("_x", present).select(*keys, F.posexplode(base).alias("_i", "_b"), "_x")
    value = F.col("_b") + coef[F.col("_i")] * F.coalesce(F.col("_x")[F.col("_i")], F.lit(0.0))
    d = d.select(*keys, terms[F.col("_i")].alias("term"), value.alias("value"))
    return d.where(F.col("value") != 0).withColumn("value", F.round("value", decimals) + F.lit(0.0))


def attribution_sparse(weighted: DataFrame, ex: LinearExplainer, keys: list[str], w_col: str = "w", decimals: int = 6) -> DataFrame:
    """X1 as base plus difference: (keys..., term, value) of each document's own
    terms, and with null keys one row per term, the value of that term in every
    document that has it not.  A document's attribution of a term is its row or
    else the base row."""
    coef, mean, terms = _literal(ex.coef, "double"), _literal(ex.mean, "double"), _literal(ex.terms, "string")
    own = weighted.select(*keys, F.explode(elements(entries(weighted, w_col))).alias("e"))
    own = own.select(*keys, terms[F.col("e.i")].alias("term"), (coef[F.col("e.i")] * (F.col("e.x") - mean[F.col("e.i")])).alias("value"))
    base = weighted.sparkSession.createDataFrame([(t, float(-c * m)) for t, c, m in zip(ex.terms, ex.coef, ex.mean)], "term string, value double")
    base = base.select(*[F.lit(None).cast(weighted.schema[k].dataType).alias(k) for k in keys], "term", "value")
    return own.unionByName(base).withColumn("value", F.round("value", decimals) + F.lit(0.0))


def explode_pairs(df: DataFrame, keys: list[str], col: str, value_field: str, value_alias: str | None = None,
                  decimals: int | None = None) -> DataFrame:
    """Long form (keys..., pos, term, value) of an array<struct<term, value>>."""
    e = df.select(*keys, F.posexplode(elements(F.col(col))).alias("pos", "e"))
    v = F.col(f"e.{value_field}")
    if decimals is not None:
        v = F.round(v, decimals) + F.lit(0.0)
    return e.select(*keys, (F.col("pos") + 1).cast("long").alias("pos"), F.col("e.term").alias("term"),
                    v.alias(value_alias or value_field))


__all__ = ["LinearExplainer", "feature_means", "name_tokens", "noise_terms", "build_explainer", "explain",
           "contrast", "contrast_text", "explode_pairs", "attribution_long", "attribution_sparse"]
