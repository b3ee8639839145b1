"""Table loading and the fitted state shared by the registered queries.

Fitted artifacts (vocabulary, query vector, model coefficients) are bounded
by ``max_features`` and kept in a :class:`State`, so that a driver running
many queries fits once.  Input tables themselves are never cached here.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scans as sc
from ..functions import text as tx
from ..operators import vectorize as vz
from ..sources.readers import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class State:
    """What queries of one run share: fitted artifacts and checkpointed tables,
    by session and data folder.  The caller starts one (:func:`start`) and by
    starting the next lets go of it, so that new data under an old path is
    read anew."""

    def __init__(self) -> None:
        self.fits: dict = {}
        self.scored: dict = {}
        self.explainers: dict = {}
        self.explained: dict = {}
        self.models: dict = {}


_state = State()


def start(state: State | None = None) -> State:
    global _state
    _state = state or State()
    return _state


def state() -> State:
    return _state


def key_of(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir.rstrip("/")


# A caller whose text tables are single small files sets the number of
# partitions to deal them into (see ``sources.readers.spread``); unset, scans
# stay as they are.
PARTITIONS_KEY = "equilens.text.partitions"
SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if name in SPREAD_KEYS:
        df = spread(df, int(spark.conf.get(PARTITIONS_KEY, "0")), SPREAD_KEYS[name])
    return df


# The parser's whole-text attributes.
PARSER_RULES = {
    "gender_proxy": ([(fixed.PARSER_FEMALE_PATTERN, fixed.FEMALE), (fixed.PARSER_MALE_PATTERN, fixed.MALE)], fixed.UNSPECIFIED),
    "institution_tier": ([(sc.any_of(fixed.PARSER_TIER1), fixed.TIER1_LABEL)], fixed.TIER23_LABEL),
    "career_gap": ([(tx.gap_regex(fixed.PARSER_GAP_PATTERNS), fixed.GAP_YES)], fixed.GAP_NO),
}


@dataclass
class Fitted:
    vocab: vz.Vocabulary
    query_weights: tuple


def fitted(spark: SparkSession, sf_dir: str, max_features: int = fixed.MAX_FEATURES) -> Fitted:
    key = (*key_of(spark, sf_dir), max_features)
    if key not in _state.fits:
        docs = table(spark, sf_dir, "documents")
        query = vz.query_document(table(spark, sf_dir, "benchmark"))
        vocab, qw = vz.fit_corpus(docs, query, max_features=max_features)
        _state.fits[key] = Fitted(vocab, qw)
    return _state.fits[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def parsed_documents(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """Documents with the parser's columns (name from the first line)."""
    return tx.parse_frame(documents(spark, sf_dir), "text", ["doc_id"] + (keep or []))


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored corpus, computed once per data folder and session and cut
    from its lineage: (doc_id, lang, name, the four parser attributes,
    sw, score); ``sw`` holds the entries of the terms a document has."""
    from ..operators.rank import cosine_score
    from ..session import materialize
    key = key_of(spark, sf_dir)
    if key not in _state.scored:
        f = fitted(spark, sf_dir)
        d = documents(spark, sf_dir).select("doc_id", "lang", "text", tx.extract_name(F.col("text")).alias("name"))
        base = sc.with_scans(tx.with_lowered(d, "text"), "_tl", PARSER_RULES)
        base = base.withColumn("name_origin_proxy", tx.name_origin(F.col("name")))
        scored = cosine_score(f.vocab.add_entries(base, "text", "sw"), f.query_weights, "sw")
        _state.scored[key] = materialize(scored)
    return _state.scored[key]


def scored_documents(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, sw, score) over all documents, from the scored table."""
    return scored_table(spark, sf_dir).select("doc_id", *(keep or []), "sw", "score")
