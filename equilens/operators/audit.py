"""Fairness audit (A1-A8): score and recommendation rate per group.

One pass over the ranked table: the attributes are unpivoted into
``(attr, grp)`` pairs and aggregated with a partial (map-side) hash
aggregate, so a group holding a third of all rows costs one row per
partition in the shuffle.  Everything after that works on a table of
#attributes x #groups rows.

Means are computed exactly in integers: scores carry 4 decimals, so the sum
of ``round(score * 10^4)`` is exact and order-free, and the rounded mean is
``(2*sum + n) div (2*n)`` (half up).  Rates likewise with 3 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

SCALE_SCORE = 10 ** fixed.SCORE_DECIMALS
SCALE_RATE = 10 ** fixed.REC_RATE_DECIMALS


def _group_string(c):
    """Group values as strings; a missing value is its own group."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def audit_groups(ranked: DataFrame, attrs: list[str] = fixed.AUDIT_ATTRIBUTES, score_col: str = "score",
                 rec_col: str = "recommended", id_col: str = "doc_id") -> DataFrame:
    """(attr_pos, attr, grp, n, mean_score, rec_rate, first_score, first_id)

    ``first_*`` identify the group's first member in rank order (score desc,
    id asc), used to break ties the way a first-seen scan would."""
    base = ranked.select(F.col(id_col).alias("_id"),
                         F.round(F.col(score_col) * SCALE_SCORE).cast("long").alias("_s"),
                         F.col(rec_col).cast("long").alias("_r"),
                         *[_group_string(F.col(a)).alias(a) for a in attrs])
    pairs = F.array(*[F.struct(F.lit(i).alias("attr_pos"), F.lit(a).alias("attr"), F.col(a).alias("grp"))
                      for i, a in enumerate(attrs)])
    long = base.select("_id", "_s", "_r", F.explode(pairs).alias("p")).select("_id", "_s", "_r", "p.*")
    g = long.groupBy("attr_pos", "attr", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_s").alias("_ssum"), F.sum("_r").alias("_rsum"),
        F.min(F.struct((-F.col("_s")).alias("ns"), F.col("_id").alias("id"))).alias("_first"))
    mean_i = F.expr("(2 * _ssum + n) div (2 * n)")
    rate_i = F.expr(f"(2 * {SCALE_RATE} * _rsum + n) div (2 * n)")
    return g.select("attr_pos", "attr", "grp", "n",
                    mean_i.alias("mean_units"),
                    (mean_i / F.lit(float(SCALE_SCORE))).alias("mean_score"),
                    (rate_i / F.lit(float(SCALE_RATE))).alias("rec_rate"),
                    (-F.col("_first.ns") / F.lit(float(SCALE_SCORE))).alias("first_score"),
                    F.col("_first.id").alias("first_id"))


def audit_report(groups: DataFrame) -> DataFrame:
    """(position, attr, n_groups, disparity, favoured, disadvantaged, severity)

    Attributes with fewer than two groups are skipped; the rest are ordered by
    disparity (desc), ties keeping attribute order."""
    g = groups.withColumn("_fs", F.round(F.col("first_score") * SCALE_SCORE).cast("long"))
    rep = (g.groupBy("attr_pos", "attr").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.max("mean_units").alias("_hi"), F.min("mean_units").alias("_lo"),
        F.max_by("grp", F.struct("mean_units", "_fs", (-F.col("first_id")).alias("nid"))).alias("favoured"),
        F.min_by("grp", F.struct("mean_units", (-F.col("_fs")).alias("nfs"), "first_id")).alias("disadvantaged"))
        .where(F.col("n_groups") >= 2)
        .withColumn("disparity", (F.col("_hi") - F.col("_lo")) / F.lit(float(SCALE_SCORE))))
    # At most one row per attribute: a global window here is over a handful of rows.
    pos = F.row_number().over(Window.orderBy(F.desc("disparity"), F.asc("attr_pos"))).cast("long")
    rep = rep.withColumn("position", pos)
    sev = (F.when(F.col("position") == 1, F.lit(fixed.SEVERITY[0]))
           .when(F.col("position") == 2, F.lit(fixed.SEVERITY[1])).otherwise(F.lit(fixed.SEVERITY[2])))
    return rep.select("position", "attr", "n_groups", "disparity", "favoured", "disadvantaged",
                      sev.alias("severity"))


def audit_nested(groups: DataFrame, report: DataFrame) -> DataFrame:
    """One row per reported attribute with ``mean_score`` / ``rec_rate`` maps
    (the nested report), in report order."""
    maps = groups.groupBy("attr").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("grp", "mean_score")))).alias("mean_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("grp", "rec_rate")))).alias("rec_rate"))
    return report.join(maps, "attr").select("position", "attr", "mean_score", "rec_rate", "disparity",
                                            "favoured", "disadvantaged", "severity")
