"""Preparation job, sources and sinks, and the driver contract."""

import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from equilens.functions import fixed
from equilens.operators import prepare as pr
from equilens.operators import vectorize as vz
from equilens.plans import context as cx
from equilens.sources import readers as rd
from equilens.sources import sinks as sk
from tests.fixture_texts import TEXTS


def raw(spark, sf):
    return cx.documents(spark, sf).select(F.col("doc_id").alias("ID"), F.col("text").alias("Resume_str"),
                                          F.col("source").alias("Category"))


def test_rebalance_counts_are_exact(spark, sf):
    d = raw(spark, sf).select("ID", F.lit("No").alias("career_gap"), F.lit("Unspecified").alias("gender_proxy"))
    n = d.count()
    g = pr.rebalance_topup(d).groupBy("career_gap").count().collect()
    assert {r["career_gap"]: r["count"] for r in g}[fixed.GAP_SYNTHETIC] == math.floor(n * 0.15)
    s = {r["gender_proxy"]: r["count"] for r in pr.rebalance_split(d).groupBy("gender_proxy").count().collect()}
    assert s[fixed.FEMALE_SYNTHETIC] == math.floor(n * 0.5) and s[fixed.MALE_SYNTHETIC] == math.floor(n * 0.45)


def test_seeded_operators_ignore_partitioning(spark, sf):
    d = raw(spark, sf)
    a = sorted(r["ID"] for r in pr.seeded_sample(d.repartition(1), 37, "ID").collect())
    b = sorted(r["ID"] for r in pr.seeded_sample(d.repartition(5), 37, "ID").collect())
    assert a == b and len(a) == 37
    p1 = {r["ID"]: r for r in pr.prepare(d.repartition(2), "all", None).collect()}
    p2 = {r["ID"]: r for r in pr.prepare(d.repartition(6), "all", None).collect()}
    assert p1 == p2
    names = sorted(r["Name"] for r in p1.values())
    assert names == [fixed.NAME_FORMAT % (i + 1) for i in range(len(p1))]


def test_seeded_sample_has_exactly_n_rows(spark):
    d = spark.range(250_000).select(F.col("id").alias("ID"), F.lit("text").alias("Resume_str"), F.array(F.col("id")).alias("more"))
    for n in (90_000, 130_000):
        got = pr.seeded_sample(d, n, "ID")
        assert got.count() == n and got.select("ID").distinct().count() == n and "more" in got.columns


def test_missing_band_boundary_is_an_error(spark):
    d = spark.createDataFrame([(1, "No"), (2, "No")], "ID long, career_gap string")
    with pytest.raises(ValueError, match="fewer rows"):
        pr.relabel_bands(d, "ID", [("career_gap", F.col("career_gap") == "No", "gap", [(5, "Yes")])])


def test_ranked_sink(spark):
    tmp = os.path.join(tempfile.mkdtemp(prefix="equilens-rank-"), "out")
    d = spark.createDataFrame([(1, "A, \"b\"", [0.1], 0.2, 0, 0.4, 0, 2), (2, "C", [0.2], 0.9, 1, 0.8, 1, 1)],
                              "doc_id long, name string, w array<double>, score double, label int, model_score double, recommended int, rank long")
    for fmt in ("csv", "parquet"):
        sk.write_ranked(d, tmp, fmt)
        back = spark.read.option("header", True).option("escape", '"').option("inferSchema", True).csv(tmp) if fmt == "csv" else spark.read.parquet(tmp)
        assert back.columns == ["Rank", "Name", "TF_IDF_Score", "Model_Score", "Recommended", "doc_id", "label"]
        assert [tuple(r)[:5] for r in back.orderBy("Rank").collect()] == [(1, "C", 0.9, 0.8, 1), (2, 'A, "b"', 0.2, 0.4, 0)]


def test_category_fallback(spark, sf):
    d = raw(spark, sf)
    exact = pr.filter_category_partial(d, "SRC3").select("Category").distinct().collect()
    assert [r["Category"] for r in exact] == ["src3"]
    part = pr.filter_category_partial(d, "rc1").select("Category").distinct().collect()
    assert [r["Category"] for r in part] == ["src1"]
    assert pr.filter_category_partial(d, "nothing-like-this").count() == 0
    assert pr.filter_category(d, "all").count() == d.count()


def test_text_dir_scan_and_csv_round_trip(spark):
    tmp = tempfile.mkdtemp(prefix="equilens-src-")
    for name, text in TEXTS.items():
        with open(os.path.join(tmp, name), "w", encoding="utf-8") as f:
            f.write(text)
    with open(os.path.join(tmp, "notes.md"), "w") as f:
        f.write("ignored")
    parsed = rd.parse_text_dir(spark, tmp).collect()
    assert [r["Filename"] for r in parsed] == sorted(TEXTS)
    assert parsed[0]["Name"] == "Nora Taylor"
    csv_path = os.path.join(tmp, "raw.csv")
    with open(csv_path, "w", encoding="utf-8") as f:
        f.write("ID,Resume_str,Category\n")
        for i, t in enumerate(TEXTS.values()):
            f.write(f'{i},"{t.replace(chr(34), chr(34) * 2)}",Data Science\n')
    r = rd.read_raw_csv(spark, csv_path)
    assert r.count() == 10 and r.orderBy("ID").first()["Resume_str"] == list(TEXTS.values())[0]
    prepared = pr.prepare(r, "data science", None)
    out = os.path.join(tmp, "prepared")
    sk.write_prepared(prepared, out, "csv")
    back = rd.read_prepared(spark, out, "csv")
    assert back.count() == prepared.count()
    assert set(r["Education"] for r in back.collect()) == {""}


def test_vocabulary_model_and_audit_sinks(spark):
    tmp = tempfile.mkdtemp(prefix="equilens-sink-")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS.values())], "doc_id long, text string")
    vocab, _ = vz.fit_corpus(docs, vz.query_from_text(spark, "python pandas sql"))
    sk.save_vocabulary(vocab, spark, os.path.join(tmp, "vocab"))
    assert sk.load_vocabulary(spark, os.path.join(tmp, "vocab")) == vocab


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 20 and df.columns == ["doc_id", "score", "rank"]
    assert [r["rank"] for r in rows] == list(range(1, 21))
    qs, oq = E.queries(), E.oracle_sql()
    assert set(oq) <= set(qs)
    rows_only = {q for q in set(qs) - set(oq) if q != "pipeline" and not q.startswith("op")}
    assert rows_only == {"local_attribution"}


def test_model_and_audit_json_sinks(spark):
    from equilens.operators import audit as au
    from equilens.operators import rank as rk
    tmp = tempfile.mkdtemp(prefix="equilens-model-")
    df = spark.createDataFrame([([1.0, 0.0], 1), ([0.0, 1.0], 0), ([0.9, 0.1], 1), ([0.2, 0.8], 0)],
                               "w array<double>, label int")
    m = rk.fit_logistic(df, "w", "label")
    sk.save_model(m, os.path.join(tmp, "model"))
    back = sk.load_model(os.path.join(tmp, "model"))
    assert list(back.coefficients) == list(m.coefficients) and back.intercept == m.intercept
    d = spark.createDataFrame([(1, "a", "x", 0.5, 1), (2, "b", "x", 0.1, 0), (3, "a", "y", 0.3, 1)],
                              "doc_id long, g string, h string, score double, recommended int")
    groups = au.audit_groups(d, ["g", "h"])
    nested = au.audit_nested(groups, au.audit_report(groups))
    sk.write_audit(nested, os.path.join(tmp, "audit"))
    lines = [json.loads(x["value"]) for x in spark.read.text(os.path.join(tmp, "audit")).collect()]
    assert [x["attr"] for x in sorted(lines, key=lambda x: x["position"])] == ["g", "h"]
    doc = json.loads(sk.report_json(nested))
    assert list(doc) == ["g", "h"] and doc["g"]["mean_score"] == {"a": 0.4, "b": 0.1}
    assert doc["g"]["favoured"] == "a" and doc["g"]["disparity"] == 0.3
