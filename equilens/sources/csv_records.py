"""CSV with quoted line feeds, read by many tasks.

The plain reader hands each file with quoted line feeds to one task, as only its
first byte is known to be outside quotes.  Here files are read in blocks, line
by line.  A line feed ends a record if the quotes before it in the file are even in
number, so

1. one aggregation gives each block's number of quotes modulo 2, and its running
   sum over a file's blocks says which blocks begin inside quotes;
2. each block puts its lines together into records, starting from that state;
3. a record that crosses into further blocks leaves a piece in each.  Pieces, at
   most two a block, are put together by the block in which the record began.

Each record is then parsed by Spark's CSV parser.  Files must keep to the usual
form (a field with quotes is quoted, quotes in it are doubled); for files with
single quotes in unquoted fields use the plain reader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship_package

# Blocks that begin inside quotes and are broadcast (one narrow row each); with
# more, lines are brought to their block's state by a shuffle.
BROADCAST_BLOCKS = 1_000_000
_BLOCK = ["file", "block"]


def blocks(spark: SparkSession, path) -> DataFrame:
    """(file, block, at, value): every line with its file (a hash of the path), the
    first byte of its block and a number that rises within the block."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def opened(lines: DataFrame) -> DataFrame:
    """The blocks that begin inside quotes."""
    odd = lines.groupBy(*_BLOCK).agg((F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row a block
    return odd.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).where("open").select(*_BLOCK, "open")


def _records(batches):
    """Rows (file, block, kind, first, closed, text) of whole blocks in order.

    kind 0: a record; 1: the rest of an earlier block's record (``closed``: its end
    is in this block); 2: a record that goes on in the next block.  ``first``:
    the first record of its file."""
    state = None
    for batch in batches:
        file, block = (batch.column(k).to_numpy() for k in ("file", "block"))
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(file)]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if state is None or state.key != (file[a], block[a]):
                if state is not None:
                    yield state.rest()
                state = _Block((file[a], block[a]), bool(part.column("open")[0].as_py()))
            yield state.take(part.column("value"))
    if state is not None:
        yield state.rest()


class _Block:
    """The records of one block, given line by line in batches."""

    def __init__(self, key, is_open: bool):
        self.key, self.inside = key, is_open
        self.held: list[pa.Array] = []
        self.odd = int(is_open)  # quotes so far, modulo 2
        self.first = key[1] == 0

    def _rows(self, kind, first, closed, text: pa.Array) -> pa.RecordBatch:
        n = len(text)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.key[0])), pa.array(np.full(n, self.key[1])), pa.array(kind, pa.int32()), pa.array(first), pa.array(np.full(n, closed)), text],
                                          ["file", "block", "kind", "first", "closed", "text"])

    def take(self, values: pa.Array) -> pa.RecordBatch:
        state = (self.odd + np.cumsum(pc.count_substring(values, '"').to_numpy())) % 2
        ends = np.flatnonzero(state == 0) + 1
        self.odd = int(state[-1])
        if not len(ends):
            self.held.append(values)
            return self._rows([], np.zeros(0, bool), True, values.slice(0, 0))
        lines = pa.concat_arrays([*self.held, values])
        ends = ends + (len(lines) - len(values))
        self.held = [lines.slice(ends[-1])] if ends[-1] < len(lines) else []
        whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), lines.slice(0, ends[-1]))
        text = pc.binary_join(whole, "\n")
        kind, first = np.zeros(len(text), np.int32), np.zeros(len(text), bool)
        if self.inside:
            kind[0], self.inside = 1, False
        elif self.first:
            first[0] = True
        self.first = False
        return self._rows(kind, first, True, text)

    def rest(self) -> pa.RecordBatch:
        """What the block leaves to the next one."""
        if not self.held:
            return self._rows([], np.zeros(0, bool), False, pa.array([], pa.string()))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, sum(map(len, self.held))], pa.int32()), pa.concat_arrays(self.held)), "\n")
        return self._rows([1 if self.inside else 2], np.array([self.first and not self.inside]), False, text)


def records(spark: SparkSession, path) -> DataFrame:
    """(first, text): the text of every record of the files under ``path``."""
    ship_package(spark)
    lines = blocks(spark, path)
    inside = materialize(opened(lines))
    if inside.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        lines = lines.join(F.broadcast(inside), _BLOCK, "left")
    else:
        lines = lines.join(inside, _BLOCK, "left").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "at")
    found = lines.select(*_BLOCK, F.coalesce("open", F.lit(False)).alias("open"), "value").mapInArrow(_records, "file long, block long, kind int, first boolean, closed boolean, text string")
    pieces = materialize(found.where("kind > 0"))
    # A record begins with each piece of kind 2; narrow rows tell which pieces go on with it.
    order = Window.partitionBy("file").orderBy("block", "kind")
    begun = pieces.select(*_BLOCK, "kind").withColumn("record", F.sum((F.col("kind") == 2).cast("int")).over(order))
    joined = (pieces.join(begun, [*_BLOCK, "kind"]).groupBy("file", "record")
              .agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
              .select("first", F.array_join(F.col("parts.text"), "\n").alias("text")))
    return found.where("kind = 0").select("first", "text").unionByName(joined)


def read_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Header CSV of a fixed schema; quoted fields may hold line feeds."""
    rows = records(spark, path).where(~F.col("first"))
    text = F.regexp_replace("text", "\r$", "")
    parsed = F.from_csv(text, schema.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"', "quote": '"'})
    return rows.where(text != "").select(parsed.alias("r")).select("r.*")
