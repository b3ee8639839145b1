"""Streaming form of the folder source (S1): each new text file dropped into
a folder is parsed and scored against the query with an already fitted
vectorizer (V10, V11).  Stateless per micro-batch; the fitted artifacts are
bounded literals, so no state store is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.rank import cosine_score
from ..operators.vectorize import Vocabulary, sparse_docs


def score_folder_stream(spark: SparkSession, path: str, vocab: Vocabulary, query_weights,
                        suffix: str = ".txt", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of (Filename, parsed columns..., score)."""
    reader = spark.readStream.option("wholetext", "true").option("pathGlobFilter", f"*{suffix}")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.format("text").load(path).select(F.col("_metadata.file_name").alias("Filename"),
                                                  F.col("value").alias("text"))
    cols = tx.parse_columns(F.col("text"))
    parsed = raw.select("Filename", "text", *[c.alias(k) for k, c in cols.items()])
    scored = cosine_score(sparse_docs(parsed, vocab, "text", parsed.columns), query_weights, "sw")
    return scored.drop("text", "sw")
