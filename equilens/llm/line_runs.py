"""Line dedup by levelled sorted runs of line hashes (operator 11).

A line's key is the line without ASCII white space at its ends, A-Z in lower
case.  Keys of at least ``least_chars`` code points in at least ``least_docs``
documents lose all their lines but those of the document with the largest id.

**Runs.**  A store holds what documents seen so far have, as *runs*: tables of
(128-bit line hash, documents, largest id), bucketed by the hash and sorted in
each bucket.  A hash is in one run at most.  A new batch of documents becomes a
sorted table of the same buckets and is merge-anti-joined with the runs: hashes in none of
them are the batch's own run, added at level 0; the others, lines that an
earlier batch has had, go into a log of repeats with the batch's counts.  When a
level holds ``fanout`` runs they are compacted into one run of the next level, so a
hash is rewritten once a level and a batch meets a logarithmic number of runs.
Joins and compactions read both sides bucket by bucket: nothing already
in a run is shuffled again.

A key's documents are those of its run and of the log together; keys with enough
of them are joined with the lines.  A document's dropped lines travel as places,
its text is rebuilt by one join on the document.

No task holds the lines of a key: batches are counted before their shuffle (one
row for each partition and key), a hot key is one row of every run, and lines meet
frequent keys by a broadcast (a counted side) or a join that adaptive execution
splits.  Runs are files in the shared checkpoint folder, so a lost executor costs its tasks.

A null or empty text is one empty line.  A document is a row: rows that repeat
an id count each, and if theirs is the largest id all of them keep the lines.
Null ids are below all others and equal to each other.  A key several times in one document
counts once.  An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_counted, shared_folder

LEAST_CHARS = 40
LEAST_DOCS = 5
FANOUT = 2
BATCHES = 4
BLANK = " \t\n\x0b\x0c\r"
_HASH = ["h", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def long_keys(text: Column, least_chars: int) -> Column:
    """The long enough keys of a text's lines, each once."""
    long = F.filter(lines_of(text), lambda x: F.length(F.btrim(x, F.lit(BLANK))) >= least_chars)
    return F.array_distinct(F.transform(long, key_of))


def hashes(c: Column) -> list[Column]:
    """128 bits."""
    return [F.xxhash64(c).alias("h"), F.xxhash64(F.lit(1), c).alias("h2")]


class LineRuns:
    """The store: a database of tables in the shared checkpoint folder.  ``buckets``
    is the number of buckets of every table (the session's shuffle partitions
    unless given)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("a compaction takes two runs or more")
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_folder(spark)}/{self.name}'")
        self.levels: list[list[DataFrame]] = []
        self.log: list[DataFrame] = []
        self._made = 0

    def write(self, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
        """``rows`` as a bucketed, sorted table of the store."""
        name = f"{self.name}.t{self._made}"
        self._made += 1
        rows.write.partitionBy(*(by or [])).bucketBy(self.buckets, *_HASH).sortBy(*_HASH).saveAsTable(name)
        return self.spark.table(name)

    def remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self.name}.{name}")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: h, h2, n, top, one row for each hash; in buckets already where
        it comes from :meth:`write`, else it is shuffled once."""
        new = batch = batch.select(*_HASH, "n", "top")
        for run in self.runs():
            new = new.join(run.select(*_HASH).hint("merge"), _HASH, "left_anti")
        added = self.write(new)
        if self.levels:
            self.log.append(self.write(batch.join(added.select(*_HASH).hint("merge"), _HASH, "left_anti")))
        self._put(0, added)

    def _put(self, k: int, run: DataFrame) -> None:
        """Add a run to level k; compact the level if that fills it."""
        while len(self.levels) <= k:
            self.levels.append([])
        self.levels[k].append(run)
        if len(self.levels[k]) == self.fanout:
            full, self.levels[k] = self.levels[k], []
            self._put(k + 1, self.write(merged(full)))

    def frequent(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """h, h2, top of the keys in at least ``least_docs`` documents, checkpointed:
        each hash is in one run, its repeats are in the log."""
        log, found = None, None
        for part in self.log:
            log = part if log is None else log.unionByName(part)
        if log is not None:
            log = log.groupBy(*_HASH).agg(F.sum("n").alias("more"), F.max("top").alias("later"))
        for run in self.runs():
            if log is not None:
                run = run.join(log, _HASH, "left").select(*_HASH, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("top", "later").alias("top"))
            run = run.where(F.col("n") >= least_docs).select(*_HASH, "top")
            found = run if found is None else found.unionByName(run)
        return cut(found)

    def drop(self) -> None:
        """Delete the tables."""
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")


def merged(runs: list[DataFrame]) -> DataFrame:
    """Runs of different hashes as one, merged bucket by bucket."""
    out = runs[0].select(*_HASH, "n", "top")
    for run in runs[1:]:
        right = run.select(*_HASH, F.col("n").alias("n_b"), F.col("top").alias("top_b")).hint("merge")
        out = out.join(right, _HASH, "full").select(*_HASH, F.coalesce("n", "n_b").alias("n"), F.coalesce("top", "top_b").alias("top"))
    return out


def repeated_keys(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """h, h2, top of the keys in at least ``least_docs`` documents of ``docs`` (doc_id,
    text), which goes through the runs in ``batches`` batches by a hash of the id."""
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    keys = docs.select("doc_id", batch, F.explode(long_keys(F.col("text"), least_chars)).alias("key")).select("doc_id", "batch", *hashes(F.col("key")))
    counted = keys.groupBy("batch", *_HASH).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    store = LineRuns(spark, fanout)
    try:
        arrived = store.write(counted.repartition(store.buckets, *_HASH), ["batch"])
        for k in range(batches):
            store.add(arrived.where(F.col("batch") == k))
        return store.frequent(least_docs)
    finally:
        store.drop()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """id, n_lines (before), n_dropped and ``text``, the other lines joined by a line feed."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = repeated_keys(docs, least_chars, least_docs, batches, fanout)
    same = [F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2")]
    lines = docs.select("doc_id", *same, F.posexplode(lines_of(F.col("text"))).alias("place", "line")).where(F.length("line") >= least_chars)
    keys = lines.select("doc_id", "t", "t2", "place", key_of(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    hit = join_counted(keys.select("doc_id", "t", "t2", "place", *hashes(F.col("key"))), found, _HASH).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    lost = hit.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u"), F.col("t2").alias("u2")).agg(F.collect_set("place").alias("lost"))
    joined = docs.select("doc_id", "text", *same).join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")) & (F.col("t2") == F.col("u2")), "left")
    split = joined.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lines_of(F.col("text")).alias("lines"), "lost")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    rest = F.array_join(F.transform(kept, lambda k: F.col("lines")[k]), "\n")
    return split.select(F.col("doc_id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
                        F.when(F.col("lost").isNull(), F.col("text")).otherwise(rest).alias(text_col))
