"""Scoring, median labels, ranking and the logistic model (K1-K6).

Global ranks never use an unpartitioned window (that moves every row into
one task).  :func:`global_rank` range-partitions the sort columns alone (ties
broken by a unique id, so sampling-based bounds split even a score shared by
a third of all rows), numbers rows inside each range, stores both, and adds the
ranges' offsets.
"""

from __future__ import annotations

import math

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import materialize, ship_package
from .vectorize import entries, entries_dot

# Rows of a range of the distributed rank, on average.
RANGE_ROWS = 250_000


def cosine_score(weighted: DataFrame, query_weights, w_col: str = "w", out: str = "score",
                 decimals: int = fixed.SCORE_DECIMALS) -> DataFrame:
    """Cosine of L2-normalized vectors = their dot product; 0 for a zero
    vector on either side."""
    return weighted.withColumn(out, F.round(entries_dot(entries(weighted, w_col), query_weights), decimals) + F.lit(0.0))


def median_label(scored: DataFrame, score_col: str = "score", out: str = "label") -> DataFrame:
    """``score >= median(score)`` as 0/1.  The median is exact (interpolated);
    scores are rounded, so its state holds at most 10**decimals+1 values.
    It is planned as a scalar subquery, not a join."""
    med = scored.agg(F.median(score_col)).scalar()
    return scored.withColumn(out, (F.col(score_col) >= med).cast("int"))


def top_k(scored: DataFrame, k: int, score_col: str = "score", id_col: str = "doc_id",
          rank_col: str = "rank") -> DataFrame:
    """Top k by score (ties by id) with a 1-based rank: TakeOrderedAndProject
    on each partition, then a k-row window."""
    top = scored.orderBy(F.desc(score_col), F.asc(id_col)).limit(k)
    w = Window.orderBy(F.desc(score_col), F.asc(id_col))
    return top.withColumn(rank_col, F.row_number().over(w).cast("long"))


def global_rank(df: DataFrame, order_by: list[str], out: str = "rank", rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """1-based row number of every row in ``order_by`` order, distributed.

    ``order_by`` names the sort columns, ``-name`` for descending; together
    they must be a total order, the last one being a unique key.  Only these
    columns are range-partitioned, once: each row's range and its place in
    it are written to a checkpoint, so the counts per range and the rows they
    are added to come from one sampling, whatever Spark prunes or retries.
    The ranks then join the other columns on the unique key."""
    names = [c.lstrip("-") for c in order_by]
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order_by]
    narrow = materialize(df.select(*names))
    ranges = max(1, math.ceil(narrow.count() / rows_per_range))
    placed = (narrow.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
              .withColumn("_range", F.spark_partition_id())
              .withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    placed = materialize(placed)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
               .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    # ``offsets`` has one row per range, i.e. per ``rows_per_range`` rows.
    ranked = (placed.join(F.broadcast(offsets), "_range")
              .select(*names, (F.col("_offset") + F.col("_place") + 1).cast("long").alias(out)))
    if set(df.columns) <= set(names):
        return ranked
    return df.join(ranked.select(names[-1], out), names[-1])


def rank_by_score(scored: DataFrame, score_col: str = "score", id_col: str = "doc_id",
                  out: str = "rank") -> DataFrame:
    return global_rank(scored, ["-" + score_col, id_col], out)


# -- logistic model (K2-K4) ---------------------------------------------------

def fit_logistic(train: DataFrame, w_col: str = "w", label_col: str = "label", C: float = fixed.LOGISTIC_C,
                 max_iter: int = fixed.LOGISTIC_MAX_ITER, tol: float = 1e-9) -> LogisticRegressionModel:
    """L2-penalized logistic regression with an unpenalized intercept.

    ``C`` is the inverse penalty of the sum-of-losses objective; Spark
    minimizes the mean loss, hence ``regParam = 1 / (C * n)``.  A single
    class is rejected up front (the fit is undefined there)."""
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.min(label_col).alias("lo"),
                      F.max(label_col).alias("hi")).first()
    n = int(stats["n"])
    if n == 0:
        raise ValueError("cannot fit a model on an empty corpus")
    if stats["lo"] == stats["hi"]:
        raise ValueError(f"all {n} documents have label {stats['lo']}: a classifier needs two classes")
    data = train.select(array_to_vector(F.col(w_col)).alias("features"), F.col(label_col).cast("double").alias("label"))
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (C * n), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, maxIter=max_iter, tol=tol, family="binomial")
    return lr.fit(data)


@dataclass(frozen=True)
class LinearModel:
    """Coefficients and intercept of a fitted logistic model, the Newton steps
    taken and the gradient's largest component at the end."""

    coef: tuple[float, ...]
    intercept: float
    steps: int
    gradient: float


# Rows of a dense block inside a task; features up to which the Gram matrix is formed.
BLOCK_ROWS = 1024
MAX_GRAM = 4096


def fit_newton(train: DataFrame, size: int, w_col: str = "sw", label_col: str = "label", C: float = fixed.LOGISTIC_C,
               max_steps: int = 100, tol: float = 1e-9, tasks: int | None = None) -> LinearModel:
    """The minimum of :func:`fit_logistic`'s objective (sum of losses plus
    |coef|^2 / 2C, intercept free) by Newton's method: one job a step, in which
    every task adds up the Gram matrix X'WX, the gradient and the loss of its rows
    and Spark sums them by matrix row.  A step that does not lower the loss is
    halved.  About eight steps, whatever the number of rows.

    ``size`` is the number of features; (size + 2)^2 numbers a task are
    shuffled and reach the driver once a step, so it is at most :data:`MAX_GRAM`.
    ``tasks``: into how many tasks the stored rows are put together (one for
    each core), so that this does not grow with the input.  Rows with a null label
    are left out."""
    if size > MAX_GRAM:
        raise ValueError(f"{size} features: the Gram matrix is formed for at most {MAX_GRAM}; use fit_logistic")
    spark = train.sparkSession
    ship_package(spark)
    rows = materialize(train.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("double").alias("label"), entries(train, w_col).alias("e")))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if not stats["n"]:
        raise ValueError("cannot fit a model on an empty corpus")
    if stats["lo"] == stats["hi"]:
        raise ValueError(f"all {stats['n']} documents have label {stats['lo']}: a classifier needs two classes")
    rows = rows.coalesce(tasks or spark.sparkContext.defaultParallelism)
    free = np.r_[np.full(size, 1.0 / C), 0.0]

    def at(beta: np.ndarray):
        parts = rows.mapInArrow(lambda batches: _gram_parts(batches, beta), "k int, v array<double>")
        sums = parts.groupBy("k").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()  # size + 2 rows
        by = {r["k"]: r["v"].toArray() for r in sums}
        hessian = np.stack([by[k] for k in range(size + 1)]) + np.diag(free)
        last = by[size + 1]
        return last[-1] + 0.5 * float(free @ (beta * beta)), last[:-1] + free * beta, hessian

    beta = np.zeros(size + 1)
    loss, gradient, hessian = at(beta)
    steps = 0
    while steps < max_steps and np.abs(gradient).max() > tol:
        move, scale = np.linalg.solve(hessian, gradient), 1.0
        gain = float(gradient @ move)
        while True:
            steps += 1
            new = at(beta - scale * move)
            # Near the minimum the loss no longer tells steps apart.
            if new[0] <= loss - 1e-4 * scale * gain or gain < 1e-9 * max(1.0, abs(loss)) or scale < 1e-6:
                break
            scale /= 2
        done = np.abs(new[1]).max() >= np.abs(gradient).max() and gain < 1e-9 * max(1.0, abs(loss))
        if done:
            break
        beta = beta - scale * move
        loss, gradient, hessian = new
    return LinearModel(tuple(float(x) for x in beta[:-1]), float(beta[-1]), steps, float(np.abs(gradient).max()))


def _gram_parts(batches, beta: np.ndarray):
    """(row number, row) of X'WX, then the gradient and the loss, of a task's rows."""
    n = len(beta)
    gram, gradient, loss = np.zeros((n, n)), np.zeros(n), 0.0
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(first, BLOCK_ROWS)
            y, e = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
            flat = e.flatten()
            x = np.zeros((part.num_rows, n))
            x[np.repeat(np.arange(part.num_rows), np.diff(e.offsets.to_numpy())), flat.field("i").to_numpy()] = flat.field("x").to_numpy()
            x[:, -1] = 1.0
            z = x @ beta
            p = 0.5 * (1.0 + np.tanh(0.5 * z))
            gradient += x.T @ (p - y)
            x *= np.sqrt(p * (1.0 - p))[:, None]
            gram += x.T @ x  # a product with itself: half the work
            loss += float((np.logaddexp(0.0, z) - y * z).sum())
    values = [*gram, np.r_[gradient, loss]]
    yield pa.RecordBatch.from_arrays([pa.array(range(n + 1), pa.int32()), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], ["k", "v"])


def model_coefficients(model: LogisticRegressionModel) -> tuple[tuple[float, ...], float]:
    return tuple(float(x) for x in model.coefficients.toArray()), float(model.intercept)


def predict(weighted: DataFrame, coef, intercept: float, w_col: str = "w", prob_col: str = "model_score",
            class_col: str = "recommended", decimals: int = fixed.SCORE_DECIMALS) -> DataFrame:
    """Class-1 probability (rounded) and the predicted class, computed from
    the fitted coefficients as array expressions (no Python, no shuffle)."""
    margin = entries_dot(entries(weighted, w_col), coef) + F.lit(float(intercept))
    return (weighted.withColumn("_margin", margin)
            .withColumn(prob_col, F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin"))), decimals))
            .withColumn(class_col, (F.col("_margin") > 0).cast("int"))
            .drop("_margin"))


def predict_with_model(model: LogisticRegressionModel, weighted: DataFrame, w_col: str = "w",
                       prob_col: str = "model_score", class_col: str = "recommended") -> DataFrame:
    """Same output through Spark ML's ``transform``."""
    out = model.transform(weighted.withColumn("features", array_to_vector(F.col(w_col))))
    return (out.withColumn(prob_col, F.round(vector_to_array("probability")[1], fixed.SCORE_DECIMALS))
            .withColumn(class_col, F.col("prediction").cast("int"))
            .drop("features", "rawPrediction", "probability", "prediction"))
