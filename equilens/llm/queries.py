"""Registered queries of the operators in this subpackage.

Each takes (spark, sf_dir), applies its operator with production parameters
to the whole table and derives the digest columns that the query returns."""

from __future__ import annotations

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, filter_audit, html_extract, langid, line_runs, mixing, oracle, periodic_runs, prefix_bpe, quality_gam, quality_rules, secret_scan, toxicity
from . import simhash_dedup as simhash
from .common import fold, read


PIECES = "piece_bpe_32k.model"
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, and the number of stretches restored."""
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    scored = toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "restored")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and the rules that reject."""
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    names = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    model = langid.fit(docs.where(~held_out), [names.id_to_piece(k) for k in range(names.get_piece_size())])
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return prefix_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_extract.extract_pages(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return embedding_dedup.embedding_dedup(read(spark, sf_dir, "embeddings"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    out = simhash.simhash_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and copies and source."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    scored = quality_gam.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    kind_is = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", kind_is(k))).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = line_runs.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley."""
    return filter_audit.audit(filter_audit.corpus_masks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    return periodic_runs.run_digests(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_langid": op3_langid,
    "op4_prefix_bpe": op4_prefix_bpe,
    "op5_html_extract": op5_html_extract,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality_gam": op9_quality_gam,
    "op10_secret_scan": op10_secret_scan,
    "op11_line_runs": op11_line_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}
# The others rest on hashes, tokenizers or fitted models that SQL has not; tests
# compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_embedding_dedup": oracle.embeddings_sql(),
    "op8_mixing": oracle.mixing_sql(),
    "op10_secret_scan": oracle.secrets_sql(),
    "op11_line_runs": oracle.line_runs_sql(),
    "op12_filter_audit": oracle.filter_audit_sql(),
}
