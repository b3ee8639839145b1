"""Quality rules with risk-controlled cutoffs (operator 2).

A rule rejects a document whose value is above a cutoff.  Cutoffs are chosen
per stratum (``lang``; null is a stratum of its own) from labelled documents:

1. the holdout is one labelled document for each label and set of near copies of
   a stratum, as copies are no independent trials;
2. candidates are quantiles of the rule's values over the documents of the stratum
   that are neither labelled nor near copies of labelled ones, so that they depend
   on nothing in the holdout.  For each candidate, of n good holdout documents k
   are rejected.  It is certified when P(Bin(n, limit) <= k) is at most the error
   level, i.e. the exact (Clopper-Pearson) upper bound of its false rejection rate
   lies within the limit;
3. candidates are tested from the most lenient on and testing stops at the first
   that fails, so a rule in a stratum spends its level once; the level ``delta``
   is divided by rules and strata, and ``alpha``, the false rejection allowed per
   stratum, by the rules.  With probability 1 - delta every stratum's rules
   together reject at most alpha of its good documents;
4. of the certified candidates the one that rejects most bad documents for its
   bound is used, the most lenient of about equals; none where nothing is
   certified or gained, as in a stratum with few labels: then only the fixed base
   rules decide there.

Texts are read once, into a narrow checkpointed table of counts; labels join
that.  A null or empty text has no words and fails the base rules.  Rows that
repeat an id are judged each by its own text (all of them carry the id's labels).
No labels at all, or none but labelled documents in a stratum: no rule is certified.
Quantiles are of values rounded down to three significant digits and counted, so
a rerun chooses the same cutoffs whatever the order of merging.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text_stats
from .common import cut, join_counted, map_texts
from .toxicity import likeness

MIN_WORDS = 20
MAX_REPEAT = 30  # percent of the words
ALPHA = 0.04
DELTA = 0.05
QUANTILES = (0.5, 0.6, 0.7, 0.75, 0.8, 0.84, 0.87, 0.9, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.985, 0.99, 0.9925, 0.995, 0.9975, 0.999)
# Rule: value that is too high.  Values are of the whole text.
RULES = {"symbols": 1, "dup_lines": 1, "repeats": 1, "bars": 1, "shouts": 1, "upper": 1, "mean_word": 1, "distinct": -1}
# A bad document rejected weighs as much as this many in a hundred of the bound.
PRICE = 5.0
# Of cutoffs whose worth is within this of the best, the most lenient is used.
SLACK = 0.01

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """(_id, _stratum, _mark, _near, base counts, values array): one row per document;
    the mark tells texts of one id apart, near copies share ``_near``."""
    def run(_, texts: pa.Array) -> dict:
        base = text_stats.counts(texts)
        ratios = text_stats.shape(texts, base)
        values = np.stack([sign * ratios[r] for r, sign in RULES.items()], axis=1)
        return base | {"values": pa.array(list(values), pa.list_(pa.float64()))}

    carry = {"_stratum": F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")), "_mark": mark(text_col, stratum),
             "_near": likeness(F.col(text_col).cast("string"))}
    out = map_texts(docs.withColumnRenamed(id_col, "_id"), run, ", ".join(f"{c} long" for c in BASE) + ", values array<double>", "_id", text_col, carry)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def mark(text_col: str, stratum: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"), F.col(stratum).cast("string"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly from the log of the first term on."""
    if k >= n or p <= 0:
        return 1.0
    i = np.arange(1, k + 1)
    log = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i)) + i * (np.log(p) - np.log1p(-p))])
    top = log.max()
    return float(min(1.0, np.exp(top) * np.exp(log - top).sum()))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound of a rate seen k times in n, at 1 - level."""
    lo, hi = k / n if n else 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > level else (lo, mid)
    return hi


def choose(cutoffs: np.ndarray, good: np.ndarray, bad: np.ndarray, limit: float, level: float) -> float | None:
    """The cutoff to use.  ``good[i]``, ``bad[i]``: labelled documents whose
    value lies above exactly i of the ascending ``cutoffs``."""
    n, n_bad = int(good.sum()), int(bad.sum())
    worth = []
    for i in range(len(cutoffs) - 1, -1, -1):
        k = int(good[i + 1:].sum())
        if not n or binomial_cdf(k, n, limit) > level:
            break
        worth.append((bad[i + 1:].sum() / max(n_bad, 1) - PRICE * upper_bound(k, n, level), cutoffs[i]))
    best = max((w for w, _ in worth), default=0.0)
    return next((float(c) for w, c in worth if w >= best - SLACK), None) if best > 0 else None


def candidates(rows: DataFrame, rules: int) -> DataFrame:
    """(_stratum, grid): for each rule the ascending candidates, which are the
    :data:`QUANTILES` of its values and the values half-way between them."""
    x = F.col("x")
    scale = F.pow(F.lit(10.0), 2 - F.floor(F.log10(F.abs(x))))
    each = rows.select("_stratum", F.posexplode("values").alias("rule", "x")).withColumn("x", F.when(x != 0, F.floor(x * scale) / scale).otherwise(0.0))
    counts = each.groupBy("_stratum", "rule", "x").agg(F.count(F.lit(1)).alias("n"))  # at most 900 values a power of ten
    one = Window.partitionBy("_stratum", "rule")
    counts = counts.withColumn("upto", F.sum("n").over(one.orderBy("x"))).withColumn("all", F.sum("n").over(one))
    found = counts.groupBy("_stratum", "rule").agg(F.array(*[F.min(F.when(F.col("upto") >= F.col("all") * q, x)) for q in QUANTILES]).alias("q"))
    # Half-way values let a cutoff lie clear of the values of good documents.
    halves = F.filter(F.zip_with("q", F.slice("q", 2, len(QUANTILES)), lambda a, b: (a + b) / 2), lambda v: v.isNotNull())
    found = found.select("_stratum", "rule", F.array_sort(F.array_distinct(F.concat("q", halves))).alias("q"))
    return found.groupBy("_stratum").agg(F.array(*[F.max(F.when(F.col("rule") == k, F.col("q"))) for k in range(rules)]).alias("grid"))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(_stratum, cuts): for each rule in order the cutoff, null if unused.
    ``measured`` must be checkpointed: it is read twice."""
    names = list(RULES)
    marked = labels.where(F.col(label).isNotNull()).select(F.col(label_id).alias("_id"), (F.col(label) > 0).alias("fine"))
    seen = measured.select("_id", "_stratum", "_near", "_mark", "values").join(marked, "_id")
    holdout = cut(seen.groupBy("_stratum", "_near", "fine").agg(F.min(F.struct("_mark", "values")).alias("m")).select("_stratum", "_near", "fine", "m.values"))
    others = join_counted(measured.select("_stratum", "_near", "values"), cut(holdout.select("_stratum", "_near").distinct()), ["_stratum", "_near"], "left_anti")
    grid = cut(candidates(others, len(names)))
    strata = max(1, grid.count())
    seen = join_counted(holdout, grid, "_stratum")
    above = lambda k: F.size(F.filter(F.col("grid")[k], lambda c: c < F.col("values")[k]))
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), above(k).alias("above")) for k in range(len(names))]))
    table = (seen.select("_stratum", "fine", bins.alias("b")).groupBy("_stratum", "b", "fine").count()
             .select("_stratum", F.col("b.rule"), F.col("b.above"), "fine", "count"))
    counted = join_counted(table, grid, "_stratum")
    limit, level = alpha / len(names), delta / (len(names) * strata)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = []
        for k, grid_k in enumerate(pdf["grid"].iloc[0]):
            own = pdf[pdf["rule"] == k]
            tally = np.zeros((2, len(grid_k) + 1), np.int64)
            np.add.at(tally, (own["fine"].to_numpy(int), own["above"].to_numpy(int)), own["count"].to_numpy())
            cuts.append(choose(np.asarray(grid_k), tally[1], tally[0], limit, level))
        return pd.DataFrame({"_stratum": [pdf["_stratum"].iloc[0]], "cuts": [cuts]})

    # A group is the tally of one stratum: rules x cutoffs x 2 rows at most.
    return counted.groupBy("_stratum").applyInPandas(pick, "_stratum string, cuts array<double>")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(id, _mark, base counts, base_failed, broken, kept): one row per document;
    ``broken`` names the rules that reject it."""
    measured = cut(measure(docs, id_col, text_col, stratum))
    limits = cut(cutoffs(measured, labels, alpha, delta, label_id, label))
    limits = limits.withColumnRenamed("_stratum", "_s")
    out = join_counted(measured, limits, F.col("_stratum") == F.col("_s"), "left")
    names = F.array(*map(F.lit, RULES))
    broken = F.filter(F.transform(names, lambda n, k: F.when(F.get("values", k) > F.get("cuts", k), n)), lambda n: n.isNotNull())
    out = out.withColumn("broken", F.coalesce(broken, F.array().cast("array<string>")))
    return out.select(F.col("_id").alias(id_col), "_mark", *BASE, "base_failed", "broken", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    judged = judge(docs, labels, id_col=id_col, text_col=text_col, stratum=stratum, **options)
    gone = cut(judged.where(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.col("_mark").alias("_gone_mark")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("_gone")) & (mark(text_col, stratum) == F.col("_gone_mark"))
    return join_counted(docs, gone, same, "left_anti")
