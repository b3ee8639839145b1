"""Sinks (S5-S8).  Parquet is the default format; CSV/JSON where a reader
expects them.  Every writer overwrites its target."""

from __future__ import annotations

import json
import os

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import LinearModel
from ..operators.vectorize import Vocabulary
from .readers import PREPARED_COLUMNS
from .versions import current, publish


def _put(spark: SparkSession, path: str, staged: bool, write) -> None:
    """``write(path)``, or the same as a new version under it."""
    if staged:
        publish(spark, path, write)
    else:
        write(path)


def _flat_file(out, fmt: str):
    if fmt == "csv":
        return out.option("header", True).option("escape", '"').csv
    return out.parquet


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet", staged: bool = False) -> None:
    """The eleven prepared columns."""
    out = df.select(*PREPARED_COLUMNS).write.mode("overwrite")
    _put(df.sparkSession, path, staged, _flat_file(out, fmt))


DISPLAY_COLUMNS = {"rank": "Rank", "name": "Name", "score": "TF_IDF_Score", "model_score": "Model_Score", "recommended": "Recommended"}


def write_ranked(df: DataFrame, path: str, fmt: str = "csv", staged: bool = False) -> None:
    """The ranked table in rank order, under its display names; vectors and
    other nested columns stay out, further flat columns follow."""
    flat = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "udt", "vector")]
    first = [c for c in DISPLAY_COLUMNS if c in flat]
    d = df.select(*[F.col(c).alias(DISPLAY_COLUMNS[c]) for c in first], *[c for c in flat if c not in first])
    _put(df.sparkSession, path, staged, _flat_file(d.orderBy("Rank").write.mode("overwrite"), fmt))


def write_audit(report: DataFrame, path: str, staged: bool = False) -> None:
    """The nested audit report as JSON lines, one attribute per line,
    ordered by ``position``."""
    _put(report.sparkSession, path, staged, report.orderBy("position").coalesce(1).write.mode("overwrite").json)


def save_vocabulary(vocab: Vocabulary, spark: SparkSession, path: str, staged: bool = False) -> None:
    """The fitted vectorizer as a Parquet table plus a small JSON header."""
    meta = {"n_docs": vocab.n_docs, "stop_words": list(vocab.stop_words), "ngram_range": list(vocab.ngram_range)}

    def write(folder: str) -> None:
        vocab.table(spark).write.mode("overwrite").parquet(os.path.join(folder, "terms"))
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(os.path.join(folder, "meta"))

    _put(spark, path, staged, write)


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    path = current(spark, path)
    rows = spark.read.parquet(os.path.join(path, "terms")).orderBy("idx").collect()
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()["value"])
    return Vocabulary(tuple(r["term"] for r in rows), tuple(int(r["cf"]) for r in rows),
                      tuple(int(r["df"]) for r in rows), int(meta["n_docs"]), tuple(meta["stop_words"]),
                      tuple(meta["ngram_range"]))


def save_model(model: LogisticRegressionModel, path: str, staged: bool = False) -> None:
    _put(SparkSession.active(), path, staged, model.write().overwrite().save)


def load_model(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(current(SparkSession.active(), path))


def save_linear_model(model: LinearModel, spark: SparkSession, path: str, staged: bool = False) -> None:
    """A Newton fit as one JSON row (its coefficients are vocabulary-sized)."""
    row = spark.createDataFrame([(list(model.coef), model.intercept, model.steps, model.gradient)], "coef array<double>, intercept double, steps int, gradient double")
    _put(spark, path, staged, row.coalesce(1).write.mode("overwrite").parquet)


def load_linear_model(spark: SparkSession, path: str) -> LinearModel:
    r = spark.read.parquet(current(spark, path)).first()
    return LinearModel(tuple(r["coef"]), r["intercept"], r["steps"], r["gradient"])


def report_json(nested: DataFrame) -> str:
    """The nested report as one JSON document (attributes in report order);
    the input has one row per attribute."""
    out = {}
    for r in nested.orderBy("position").collect():
        out[r["attr"]] = {"mean_score": dict(r["mean_score"]), "rec_rate": dict(r["rec_rate"]),
                          "disparity": r["disparity"], "favoured": r["favoured"],
                          "disadvantaged": r["disadvantaged"]}
    return json.dumps(out, indent=2)


__all__ = ["write_prepared", "write_ranked", "write_audit", "save_vocabulary", "load_vocabulary", "save_model",
           "load_model", "save_linear_model", "load_linear_model", "report_json"]
