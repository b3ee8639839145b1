"""Selection by position in hash order against sorting."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from equilens.operators import prepare as pr
from equilens.operators.select import keys_at


def md5(x):
    return hashlib.md5(str(x).encode()).hexdigest()


@pytest.mark.parametrize("digits, few", [(1, 3), (2, 1), (3, 5000)])
def test_keys_at_every_depth(spark, digits, few):
    r = random.Random(digits)
    rows = [(t, md5((t, k)), k) for t in ("a", "b") for k in range(700)]
    rows += [("a", "f" * 32, 5)] * 40 + [("a", "f" * 32, 9), ("a", "f" * 32, None)]  # one hash, repeated keys and a null one
    df = spark.createDataFrame(rows, "tag string, h string, k long").repartition(5)
    order = {t: sorted((x[1:] for x in rows if x[0] == t), key=lambda x: (x[0], x[1] is not None, x[1] or 0)) for t in ("a", "b")}
    wanted = {"a": [1, 2, 350, 701, 702, 741, 742, 743], "b": r.sample(range(1, 701), 5) + [700, 5000], "c": [1]}
    found, counts = keys_at(df, wanted, digits, few)
    assert counts == {"a": 742, "b": 700}
    assert found == {(t, p): order[t][p - 1] for t in order for p in wanted[t] if p <= len(order[t])}
    assert keys_at(df.limit(0), wanted, digits, few) == ({}, {})


def test_sample_and_bands_neither_order_nor_checkpoint(spark):
    df = spark.range(5000).select(F.col("id").alias("ID"), F.lit(pr.fixed.UNSPECIFIED).alias("gender_proxy"))
    got = pr.seeded_sample(df, 300, "ID")
    assert {r.ID for r in got.collect()} == {k for k in sorted(range(5000), key=lambda k: (md5(f"{pr.fixed.SEED}|{k}"), k))[:300]}
    split = pr.rebalance_split(df)
    for out in (got, split):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "ExistingRDD" not in plan and "Sort" not in plan
    n = {r["gender_proxy"]: r["count"] for r in split.groupBy("gender_proxy").count().collect()}
    assert n[pr.fixed.FEMALE_SYNTHETIC] == 2500 and n[pr.fixed.MALE_SYNTHETIC] == 2250
    assert pr.seeded_sample(df, 9000, "ID").count() == 5000


def test_a_band_beyond_the_candidates_is_refused(spark):
    df = spark.range(10).select(F.col("id").alias("ID"), F.lit("x").alias("c"))
    with pytest.raises(ValueError):
        pr.relabel_bands(df, "ID", [("c", F.col("c") == "x", "t", [(11, "y")])])
