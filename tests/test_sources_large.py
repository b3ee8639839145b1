"""Block-wise CSV against the plain reader; published versions."""

import csv
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from equilens.operators import rank as rk
from equilens.operators import vectorize as vz
from equilens.sources import csv_records, readers, sinks, versions


def write_csv(path, rows, terminator="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, lineterminator=terminator)
        w.writerow(["ID", "Resume_str", "Category"])
        w.writerows(rows)


def nasty(r, k):
    parts = ["plain", 'say "hi"', "a, b", "\n", "\n\n", '"', '""', "ünï 漢", "\n,\n", " ", "x" * 40, '"\n"']
    return "".join(r.choice(parts) for _ in range(r.randint(0, k)))


@pytest.mark.parametrize("block", [64, 300, 5_000, 10_000_000])
def test_blocks_equal_the_plain_reader(spark, block):
    r = random.Random(block)
    rows = [(k, nasty(r, 9), r.choice(["IT", "HR", 'odd "one"', "two\nlines"])) for k in range(120)] + [(500, "line\n" * 400, "long"), (501, "", ""), (502, "last", "IT")]
    path = os.path.join(tempfile.mkdtemp(prefix="equilens-csv-"), "raw.csv")
    write_csv(path, rows)
    keys = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = readers.read_raw_csv(spark, path, by_blocks=True)
        seen = sorted(map(tuple, got.collect()))
        tasks = csv_records.blocks(spark, path).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    plain = readers.read_raw_csv(spark, path)
    assert got.schema == plain.schema and seen == sorted(map(tuple, plain.collect())) and len(seen) == len(rows)
    assert tasks >= min(50, os.path.getsize(path) // block) and plain.rdd.getNumPartitions() == 1


def test_many_files_empty_files_and_a_header_alone(spark):
    folder = tempfile.mkdtemp(prefix="equilens-csv-")
    write_csv(os.path.join(folder, "a.csv"), [(1, "x\ny", "IT"), (2, "z", "HR")])
    write_csv(os.path.join(folder, "b.csv"), [])
    write_csv(os.path.join(folder, "c.csv"), [(3, 'q"q', "IT")])
    open(os.path.join(folder, "d.csv"), "w").close()
    got = readers.read_raw_csv(spark, folder, by_blocks=True).collect()
    assert sorted(map(tuple, got)) == [(1, "x\ny", "IT"), (2, "z", "HR"), (3, 'q"q', "IT")]


def test_lines_come_to_their_blocks_by_a_shuffle_too(spark):
    r = random.Random(1)
    rows = [(k, nasty(r, 6), "c") for k in range(60)]
    path = os.path.join(tempfile.mkdtemp(prefix="equilens-csv-"), "raw.csv")
    write_csv(path, rows)
    limit, size = csv_records.BROADCAST_BLOCKS, spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        csv_records.BROADCAST_BLOCKS = 0
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        seen = sorted(map(tuple, readers.read_raw_csv(spark, path, by_blocks=True).collect()))
    finally:
        csv_records.BROADCAST_BLOCKS = limit
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert seen == sorted(map(tuple, readers.read_raw_csv(spark, path).collect()))


def prepared(spark, tag):
    return spark.createDataFrame([tuple(f"{tag}{c}" for c in readers.PREPARED_COLUMNS)], readers.PREPARED_SCHEMA)


def test_a_write_that_dies_leaves_the_former_version(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="equilens-v-"), "out")
    sinks.write_prepared(prepared(spark, "one-"), path, staged=True)
    assert readers.read_prepared(spark, path).first()["Name"] == "one-Name"
    dying = prepared(spark, "two-").withColumn("Name", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("Name")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_prepared(dying, path, staged=True)
    assert readers.read_prepared(spark, path).first()["Name"] == "one-Name"

    def half(folder):  # some files are there, then the writer is gone
        prepared(spark, "three-").write.parquet(folder)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        versions.publish(spark, path, half)
    assert readers.read_prepared(spark, path).first()["Name"] == "one-Name"
    sinks.write_prepared(prepared(spark, "four-"), path, fmt="parquet", staged=True)
    assert readers.read_prepared(spark, path).first()["Name"] == "four-Name" and len(versions.versions(spark, path)) == 2
    gone = versions.clean(spark, path, keep=1)
    assert len(gone) >= 2 and readers.read_prepared(spark, path).first()["Name"] == "four-Name"


def test_an_unpublished_folder_is_read_as_it_is(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="equilens-v-"), "out")
    sinks.write_prepared(prepared(spark, "plain-"), path)
    assert versions.current(spark, path) == path and readers.read_prepared(spark, path).first()["Email"] == "plain-Email"


def test_models_and_vocabularies_are_published(spark):
    path = tempfile.mkdtemp(prefix="equilens-v-")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id long, text string")
    vocab, qw = vz.fit_corpus(docs, vz.query_from_text(spark, "alpha"))
    for v in (vocab, vz.Vocabulary(("only",), (1,), (1,), 2)):
        sinks.save_vocabulary(v, spark, os.path.join(path, "vocab"), staged=True)
        assert sinks.load_vocabulary(spark, os.path.join(path, "vocab")) == v
    df = spark.createDataFrame([([1.0, 0.0], 1), ([0.0, 1.0], 0), ([0.9, 0.1], 1), ([0.2, 0.8], 0)], "w array<double>, label int")
    model = rk.fit_newton(df, 2, "w")
    sinks.save_linear_model(model, spark, os.path.join(path, "linear"), staged=True)
    assert sinks.load_linear_model(spark, os.path.join(path, "linear")) == model
    ml = rk.fit_logistic(df, "w", "label")
    sinks.save_model(ml, os.path.join(path, "ml"), staged=True)
    assert list(sinks.load_model(os.path.join(path, "ml")).coefficients) == list(ml.coefficients)
