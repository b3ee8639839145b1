"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import own_folder, ship_package

# One word of a text: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text that a Python task works on at a time (one longer text is
# still taken whole).
CHUNK_BYTES = 4 << 20
# A side with at most this many rows (counted first) is broadcast; a larger
# one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors
    share; a temporary one only where none is set and the master is local, as in tests."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark, "equilens-llm-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in :func:`shared_folder`: what follows reads files
    that outlive any executor."""
    shared_folder(df.sparkSession)
    ship_package(df.sparkSession)
    return df.checkpoint(eager=True)


def join_counted(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a checkpointed ``right`` side, broadcast only when it has been
    counted at :data:`BROADCAST_ROWS` rows or fewer; else a shuffle join."""
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)


def fold(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string")) % mod if isinstance(id_col, str) else F.crc32(id_col.cast("string")) % mod


def map_texts(df: DataFrame, fn, schema: str, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """``fn(ids, texts) -> dict of columns`` over every row, in chunks of at
    most :data:`CHUNK_BYTES` of text; a row in gives a row out.  The output has
    the id column, the columns of ``carry`` (name to expression, passed through)
    and those of ``schema``.  Nothing else is read, so other columns of any name
    do not matter."""
    carry = carry or {}
    rows = df.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("_id"), *[c.alias(f"_c{k}") for k, c in enumerate(carry.values())])
    kept = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema.fields[1:])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids, *others in chunks(batches):
            out = fn(ids, texts)
            yield pa.RecordBatch.from_arrays([ids, *others, *(x if isinstance(x := out[n], pa.Array) else pa.array(x) for n in names)],
                                             ["_id", *(f"_c{k}" for k in range(len(others))), *names])

    out = rows_bounded(rows).mapInArrow(run, f"{kept}, {schema}")
    return out.toDF(id_col, *carry, *names)


def rows_bounded(df: DataFrame) -> DataFrame:
    """Arrow batches of at most 1,000 rows, so that a batch of very long texts
    stays small; a smaller setting of the session is left alone."""
    ship_package(df.sparkSession)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= 1000:
        conf.set(key, "1000")
    return df


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int = CHUNK_BYTES) -> Iterator[list[pa.Array]]:
    """The columns, the text first, in pieces of about ``max_bytes`` of text:
    small batches are put together, large ones cut between rows."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            n = max(0 if held else 1, int(np.searchsorted(ends, done + max_bytes - size, "right")) - at)
            if n:
                held.append(b.slice(at, n))
                size += int(ends[at + n - 1] - done)
                at += n
            if at < b.num_rows:
                yield _whole(held)
                held, size = [], 0
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([p.column(i) for p in parts]) for i in range(parts[0].num_columns)]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the row that each belongs to."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(words, "")
    return words.filter(real), row[real.to_numpy(zero_copy_only=False)]


def codes_of(values: pa.Array) -> np.ndarray:
    """A number for each value, equal for equal values only."""
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)
