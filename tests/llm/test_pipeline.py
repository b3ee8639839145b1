import hashlib

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry

from .helpers import docs, edge_rows, labels
from .test_dedup import brute_fingerprint
from .test_texts import brute_secrets


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_effect(spark, sf, tmp_path):
    """Each stage on the small tables, checked against what it must do to its own input."""
    before = spark.read.parquet(f"{sf}/documents.parquet")
    columns, tables = before.columns, [before]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
        assert k == 4 or tables[-1].columns == columns
    start, rules, single, clean, mixed, ids = (t.collect() for t in tables)
    assert 0.7 * len(start) < len(rules) < len(start)
    fps = [brute_fingerprint(r.text) for r in single]
    assert len(single) < len(rules) and all(bin(a ^ b).count("1") > 3 for i, a in enumerate(fps) for b in fps[:i])
    gone = {brute_fingerprint(r.text) for r in rules if r.doc_id not in {s.doc_id for s in single}}
    assert gone and len(clean) == len(single)
    assert all(not brute_secrets(r.text) and r.n_chars == len(r.text) for r in clean)
    assert {r.doc_id: r.text for r in clean if not brute_secrets(next(s.text for s in single if s.doc_id == r.doc_id))}.items() <= {s.doc_id: s.text for s in single}.items() | {r.doc_id: r.text for r in clean}.items()
    copies = [r.doc_id for r in mixed]
    assert max(map(copies.count, set(copies))) <= 2 and abs(sum(len(r.text.split()) for r in mixed) / sum(len(r.text.split()) for r in clean) - 1.5) < 0.1
    assert sorted(r.doc_id for r in ids) == sorted(copies) and all(len(r.ids) == r.n_tokens for r in ids)


def test_run_and_edge_cases(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    folder = tmp_path / "edge"
    docs(spark, edge_rows()).write.parquet(str(folder / "documents.parquet"))
    labels(spark, [(None, None, None, None), (1, 1, 0, "x")]).write.parquet(str(folder / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(folder))
    assert set(out.columns) == {"doc_id", "n_tokens", "ids"} and out.count() > 0
    empty = tmp_path / "empty"
    docs(spark, []).write.parquet(str(empty / "documents.parquet"))
    labels(spark, []).write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
