"""Properties from the test strategy: outputs do not depend on input order or
partitioning; the distributed rank equals a sort."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equilens.operators import audit as au
from equilens.operators import rank as rk
from equilens.operators import vectorize as vz
from tests.fixture_texts import TEXTS


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=60),
       st.integers(1, 5))
def test_global_rank_equals_sort(spark, pairs, parts):
    rows = [(i, s / 4.0, g) for i, (s, g) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "doc_id long, score double, g long").repartition(parts)
    got = {r["doc_id"]: r["rank"] for r in rk.global_rank(df, ["-score", "doc_id"], "rank",
                                                             rows_per_range=-(-len(rows) // parts)).collect()}
    want = {d: k + 1 for k, (d, _, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_scores_and_audit_ignore_input_order(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS.values())]
    a = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(list(reversed(rows)), "doc_id long, text string").repartition(3)
    q = vz.query_from_text(spark, "python pandas sql nlp data analysis")
    out = []
    for docs in (a, b):
        vocab, qw = vz.fit_corpus(docs, q)
        s = rk.median_label(rk.cosine_score(vz.weighted_docs(docs, vocab, "text", ["doc_id"]), qw))
        ranked = rk.rank_by_score(s.withColumn("g", F.col("doc_id") % 3).withColumn("recommended", F.col("label")))
        rep = au.audit_report(au.audit_groups(ranked, ["g"])).collect()
        out.append((vocab, sorted((r["doc_id"], r["score"], r["label"], r["rank"]) for r in ranked.collect()),
                    [tuple(r) for r in rep]))
    assert out[0] == out[1]
