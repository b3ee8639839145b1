"""Corpus preparation job.

Randomness is a keyed hash: ``md5(seed|tag|key)``.  It is the same in every
engine and under any partitioning, so seeded operators are reproducible.
Exact-count selections ("the first k rows in hash order") compare each row
with the k-th key, which :func:`keys_at` finds by histograms over hash
prefixes of narrow (tag, hash, key) records.  Only bounded values reach the
driver (a histogram, one boundary key per band).  No order over all rows, no
full-row shuffle, no checkpoint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scans as sc
from ..functions import text as tx
from ..session import materialize
from .rank import global_rank
from .select import keys_at


def seeded_key(key: Column, seed: int = fixed.SEED, tag: str | None = None) -> Column:
    parts = [F.lit(str(seed))] + ([F.lit(tag)] if tag else []) + [key.cast("string")]
    return F.md5(F.concat_ws("|", *parts))


# -- F1 / F2 -------------------------------------------------------------------------------

def _spelled(df: DataFrame, category: str, col: str) -> list[str]:
    """The spellings (upper and lower case) of one category that occur."""
    return [r[0] for r in df.where(F.lower(F.col(col)) == category.lower()).select(col).distinct().collect()]


def _only(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """A filter on plain values, which reaches the scan."""
    return df.where(F.col(col).isin(values) if values else F.lit(False))


def filter_category(df: DataFrame, category: str, col: str = "Category") -> DataFrame:
    """Case-insensitive equality; 'all' keeps everything."""
    if category.lower() == "all":
        return df
    return _only(df, col, _spelled(df, category, col))


def filter_category_partial(df: DataFrame, category: str, col: str = "Category",
                            order_col: str = "ID") -> DataFrame:
    """Exact (case-insensitive) match if any row has it; otherwise the first
    category, by first appearance, that contains the text; otherwise no rows.
    The decision reads the category column alone."""
    if category.lower() == "all":
        return df
    values = _spelled(df, category, col)
    if not values:
        part = df.where(F.lower(F.col(col)).contains(category.lower())).groupBy(col).agg(F.min(order_col).alias("_first"))
        values = [r[0] for r in part.orderBy("_first", col).limit(1).collect()]
    return _only(df, col, values)


def categories_of(df: DataFrame, col: str = "Category") -> DataFrame:
    """The categories, one row each with its number of rows."""
    return df.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))


# -- F3 / F4 -------------------------------------------------------------------------------

def filter_min_length(df: DataFrame, col: str = "Full_Text", min_length: int = fixed.MIN_CLEAN_LENGTH) -> DataFrame:
    """Keep rows whose text is strictly longer than ``min_length``."""
    return df.where(F.length(F.col(col)) > min_length)


def dropped_count(df: DataFrame, col: str = "Full_Text", min_length: int = fixed.MIN_CLEAN_LENGTH) -> DataFrame:
    return df.agg(F.count_if(F.length(F.col(col)) <= min_length).alias("dropped"))


def seeded_sample(df: DataFrame, n: int | None, key: str, seed: int = fixed.SEED,
                  out: str = "sample_key") -> DataFrame:
    """Exactly ``n`` rows (all of them when there are fewer), the first by
    keyed hash: rows are compared in place with the n-th (hash, key).  ``key``
    must be unique (rows that repeat the n-th key are all taken)."""
    d = df.withColumn(out, seeded_key(F.col(key), seed))
    if not n:
        return d
    bounds, _ = keys_at(d.select(F.lit("sample").alias("tag"), F.col(out).alias("h"), F.col(key).alias("k")), {"sample": [n]})
    if not bounds:
        return d
    return d.where(_upto(F.col(out), F.col(key), bounds[("sample", n)], df.schema[key].dataType))


def _upto(h: Column, k: Column, bound: tuple, kind) -> Column:
    """(h, k) is not beyond the bound; a null key comes first."""
    return F.struct(h.alias("h"), k.alias("k")) <= F.struct(F.lit(bound[0]).alias("h"), F.lit(bound[1]).cast(kind).alias("k"))


# -- R1-R3 ---------------------------------------------------------------------------------

def relabel_bands(df: DataFrame, key: str, specs, seed: int = fixed.SEED) -> DataFrame:
    """Exact-count relabelling of several columns.

    ``specs``: list of ``(col, cand, tag, bands)`` with ``bands`` a list of
    ``(upto, label)`` (cumulative integer counts).  Among rows where ``cand``
    holds, the ``upto`` first in keyed-hash order get ``label``.  Each row
    contributes one narrow ``(tag, hash, key)`` record per candidacy; one
    :func:`keys_at` over those records yields every band boundary, and rows are
    compared with the boundaries in place: no full-row shuffle."""
    recs = F.array(*[F.when(cand, F.struct(F.lit(tag).alias("tag"), seeded_key(F.col(key), seed, tag).alias("h"),
                                           F.col(key).alias("k")))
                     for _, cand, tag, _ in specs])
    narrow = df.select(F.explode(F.filter(recs, lambda x: x.isNotNull())).alias("c")).select("c.*")
    wanted = {tag: sorted({int(upto) for upto, _ in bands if int(upto) > 0}) for _, _, tag, bands in specs}
    wanted = {tag: ps for tag, ps in wanted.items() if ps}
    bounds = keys_at(narrow, wanted)[0] if wanted else {}
    out = df
    for col, cand, tag, bands in specs:
        expr = None
        for upto, label in bands:
            if int(upto) <= 0:
                continue
            if (tag, int(upto)) not in bounds:
                raise ValueError(f"band {label!r} of {col} ends at row {upto}, but fewer rows are candidates")
            cond = cand & _upto(seeded_key(F.col(key), seed, tag), F.col(key), bounds[(tag, int(upto))], df.schema[key].dataType)
            expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
        if expr is not None:
            out = out.withColumn(col, expr.otherwise(F.col(col)))
    return out


def _topup_spec(counts, col: str = "career_gap", share: float = fixed.GAP_TARGET_SHARE):
    need = max(0, math.floor(counts["n"] * float(share)) - counts["gap_yes"])
    return (col, F.col(col) != fixed.GAP_YES, "gap", [(need, fixed.GAP_SYNTHETIC)])


def _split_spec(m: int, col: str, value: str, shares, labels, tag: str):
    bands, upto = [], 0
    for s_, lab in zip(shares, labels):
        upto += math.floor(m * float(s_))
        bands.append((upto, lab))
    return (col, F.col(col) == value, tag, bands)


def _gender_spec(counts):
    return _split_spec(counts["unspecified"], "gender_proxy", fixed.UNSPECIFIED,
                       (fixed.GENDER_FEMALE_SHARE, fixed.GENDER_MALE_SHARE),
                       (fixed.FEMALE_SYNTHETIC, fixed.MALE_SYNTHETIC), "gender")


def _origin_spec(counts):
    return _split_spec(counts["south_asian"], "name_origin_proxy", fixed.SOUTH_ASIAN,
                       (fixed.ORIGIN_TO_WESTERN_SHARE, fixed.ORIGIN_TO_EAST_ASIAN_SHARE),
                       (fixed.WESTERN_SYNTHETIC, fixed.EAST_ASIAN_SYNTHETIC), "origin")


def group_counts(df: DataFrame) -> dict:
    """The counts the rebalancing needs, in one aggregation (one row);
    columns the frame lacks count as zero."""
    wanted = {"gap_yes": ("career_gap", fixed.GAP_YES), "unspecified": ("gender_proxy", fixed.UNSPECIFIED),
              "south_asian": ("name_origin_proxy", fixed.SOUTH_ASIAN)}
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.col(c) == v).alias(k) for k, (c, v) in wanted.items()
                                             if c in df.columns]
    r = df.agg(*aggs).first().asDict()
    return {k: int(r.get(k) or 0) for k in ["n"] + list(wanted)}


def rebalance_topup(df: DataFrame, key: str = "ID", seed: int = fixed.SEED) -> DataFrame:
    """Top 'Yes' up to floor(n * 0.15) rows by relabelling others."""
    return relabel_bands(df, key, [_topup_spec(group_counts(df))], seed)


def rebalance_split(df: DataFrame, key: str = "ID", seed: int = fixed.SEED) -> DataFrame:
    """R2: of the m 'Unspecified' rows, floor(0.50m) -> female, the next
    floor(0.45m) -> male (synthetic), in keyed-hash order."""
    return relabel_bands(df, key, [_gender_spec(group_counts(df))], seed)


def rebalance_reassign(df: DataFrame, key: str = "ID", seed: int = fixed.SEED) -> DataFrame:
    """Of the m South Asian rows, floor(0.30m) -> Western, the next
    floor(0.15m) -> East Asian (synthetic)."""
    return relabel_bands(df, key, [_origin_spec(group_counts(df))], seed)


def rebalance_all(df: DataFrame, key: str = "ID", seed: int = fixed.SEED) -> DataFrame:
    """R1-R3 together (they touch different columns): one count row, one
    narrow rank."""
    c = group_counts(df)
    return relabel_bands(df, key, [_topup_spec(c), _gender_spec(c), _origin_spec(c)], seed)


# -- whole-text rules -----------------------------------------------------------------------

ATTRIBUTES = ("institution_tier", "career_gap", "gender_proxy", "name_origin_proxy")


def with_attributes(df: DataFrame, text_col: str = "Full_Text") -> DataFrame:
    """``df`` with the whole-text attributes and skills of a cleaned text, as the
    rules of ``functions.text`` give them one by one."""
    b = tx.hash_bucket(F.col(text_col), len(fixed.ORIGIN_BUCKETS))
    bucket = F.element_at(F.array(*[F.lit(x) for x in fixed.ORIGIN_BUCKETS]), (b + 1).cast("int"))
    rules = {
        "institution_tier": ([(sc.any_of(fixed.PREP_TIER1), fixed.TIER1_LABEL)], fixed.TIER23_LABEL),
        "career_gap": ([(tx.gap_regex(fixed.PREP_GAP_PATTERNS), fixed.GAP_YES)], fixed.GAP_NO),
        "gender_proxy": ([(tx.words_regex(fixed.PREP_FEMALE_WORDS), fixed.FEMALE), (tx.words_regex(fixed.PREP_MALE_WORDS), fixed.MALE)], fixed.UNSPECIFIED),
        "name_origin_proxy": ([(sc.any_of(fixed.PREP_SOUTH_ASIAN), fixed.SOUTH_ASIAN), (sc.any_of(fixed.PREP_EAST_ASIAN), fixed.EAST_ASIAN),
                               (sc.any_of(fixed.PREP_WESTERN), fixed.WESTERN)], ("column", "_bucket")),
        "Skills": fixed.PREP_SKILLS,
    }
    return sc.with_scans(tx.with_lowered(df.withColumn("_bucket", bucket), text_col), "_tl", rules, ["_bucket"])


# -- the job -------------------------------------------------------------------------------

def relabelled(raw: DataFrame, category: str = "all", limit: int | None = None, id_col: str = "ID",
               text_col: str = "Resume_str", category_col: str = "Category", seed: int = fixed.SEED, keep_text: bool = True) -> DataFrame:
    """The preparation job without identities: category filter (with fallback),
    seeded sample, clean, length filter, attributes and skills, rebalancing.
    What is stored for the rebalancing is as wide as the texts unless the caller
    does not want them (``keep_text``)."""
    d = filter_category_partial(raw, category, category_col, id_col)
    d = seeded_sample(d, limit, id_col, seed, "_order") if limit else d.withColumn("_order", F.col(id_col))
    # The length filter comes after the attributes: a filter on a computed
    # column is pushed below its projection by substituting the expression,
    # which would run the cleaning rules twice per row.
    d = d.select(F.col(id_col), "_order", F.col(category_col).alias("Category"), tx.clean_text(F.col(text_col)).alias("Full_Text"))
    d = filter_min_length(with_attributes(d), "Full_Text")
    if not keep_text:
        d = d.drop("Full_Text")
    return rebalance_all(materialize(d), id_col, seed)


def prepare(raw: DataFrame, category: str = "all", limit: int | None = None, id_col: str = "ID",
            text_col: str = "Resume_str", category_col: str = "Category", seed: int = fixed.SEED) -> DataFrame:
    """The preparation job: category filter (with fallback), seeded sample,
    clean, length filter, whole-text attributes, rebalancing, synthetic
    identity by position, skills.  Returns the eleven prepared columns plus
    the id.  As in the reference, sampling comes before cleaning, so fewer
    than ``limit`` rows can result."""
    d = relabelled(raw, category, limit, id_col, text_col, category_col, seed)
    # Positions come from the narrow (order, id) records.
    d = global_rank(d, ["_order", id_col], "_pos")
    p = F.col("_pos")
    return d.select(F.col(id_col), tx.synthetic_filename(p).alias("Filename"), tx.synthetic_name(p).alias("Name"),
                    tx.synthetic_email(p).alias("Email"), "Category", "Skills",
                    F.lit("").alias("Education"), "Full_Text", "gender_proxy", "institution_tier", "career_gap",
                    "name_origin_proxy")


def profile_attributes(prepared: DataFrame, attrs=("institution_tier", "career_gap", "gender_proxy",
                                                   "name_origin_proxy")) -> DataFrame:
    """Value counts per attribute with percent of rows, one pass."""
    pairs = F.array(*[F.struct(F.lit(i).alias("attr_pos"), F.lit(a).alias("attr"), F.col(a).alias("grp"))
                      for i, a in enumerate(attrs)])
    g = prepared.select(F.explode(pairs).alias("p")).select("p.*").groupBy("attr_pos", "attr", "grp").count()
    # Every row counts once per attribute, so an attribute's counts add up to all rows.
    total = F.sum("count").over(Window.partitionBy("attr"))
    return g.select("attr", "grp", F.col("count").alias("n"), F.round(F.col("count") * F.lit(100.0) / total, 2).alias("pct"))


def profile_length(prepared: DataFrame, col: str = "Full_Text") -> DataFrame:
    """Mean text length, truncated."""
    return prepared.agg(F.floor(F.avg(F.length(col))).cast("long").alias("avg_length"))
