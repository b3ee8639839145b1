"""Filter interaction audit by min-plus removal ranks (operator 12).

Documents fail some of k filters.  In an order of the filters a document is
removed by the first filter that it fails, so its removal step is the least
place, in that order, of a filter it fails: with a mask matrix M (0 where a
filter is failed, else infinite) and a matrix P that holds, for each order, the
place of each filter (the inverse permutation), the steps are the min-plus
product of M and P transposed.

Documents with one mask have one row of that product, so Spark first counts
documents by part and mask (at most 2^k rows a part, pre-aggregated before the
shuffle, so that a part or mask that holds most rows is no hot key); the product
has 2^k rows and k! columns, whatever the corpus.  A part's counts are then
scattered to (order, step) with those steps as places: removed, kept (all but
what was removed up to the step), redundant (failing the step's filter, removed
by an earlier one) and weighted ones (labelled documents) alike.

:func:`corpus_masks` has the five filters of the audited corpus.  Null texts count as
empty.  A repeat is a text that a smaller id has too: ids that are equal or null
are not smaller, and a null id is no repeat.  Labels of one id that differ count
as a bad quality if none is 1, as toxic if one is 1; null labels say nothing.
Parts with null and with empty name are one.  An empty table has no parts and
gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, rows_bounded

FILTERS = "ABCDE"
GAPS = r"[\x20\x09-\x0D]+"


def orders_of(filters: str) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def places(filters: str) -> np.ndarray:
    """The place (from 1) of each filter in each order: orders × filters."""
    order = np.array(list(permutations(range(len(filters)))))
    return np.argsort(order, axis=1) + 1


def removal_steps(fails: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Min-plus product of masks (rows × filters, true where failed) with the
    places (orders × filters): the step at which each order removes each row, one
    more than there are filters where nothing does."""
    never = place.shape[1] + 1
    cost = np.where(fails, 0, never)
    steps = np.full((len(fails), len(place)), never)
    for f in range(place.shape[1]):
        np.minimum(steps, cost[:, f, None] + place[None, :, f], out=steps)
    return steps


class Audit:
    """What all parts share: the steps of every mask and the tables of places in
    which counts by mask are gathered."""

    def __init__(self, filters: str):
        k = len(filters)
        order = np.array(list(permutations(range(k))))
        self.orders, self.k = orders_of(filters), k
        fails = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1 == 1
        steps = removal_steps(fails, places(filters))
        at = steps[:, :, None] - np.arange(1, k + 1)  # masks × orders × steps
        self.here = (at == 0).reshape(1 << k, -1).astype(np.int64)
        self.later = (at > 0).reshape(1 << k, -1).astype(np.int64)
        self.redundant = ((at < 0) & fails[:, order]).reshape(1 << k, -1).astype(np.int64)
        self.filter = order.reshape(-1)
        self.alone = 1 << self.filter  # the mask of a row that fails this filter only

    def counts(self, weight: np.ndarray) -> dict[str, np.ndarray]:
        """From parts × masks × (rows, good, toxic): a parts × (orders · steps) table of each count."""
        n, good, toxic = weight[:, :, 0], weight[:, :, 1], weight[:, :, 2]
        removed = n @ self.here
        each = np.stack([removed[:, self.filter == f].sum(1) for f in range(self.k)], 1)
        return {"kept": n @ self.later, "removed": removed, "redundant": n @ self.redundant, "unique_fails": n[:, self.alone],
                "good_lost": good @ self.here, "toxic_lost": toxic @ self.here, "shapley": each[:, self.filter]}


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``masks``: part, mask (bit f set: filter f is failed), good, toxic (0 or 1)
    a row for each document.  Returns part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each
    part, order and step."""
    if not 0 < len(filters) <= 6 or len(set(filters)) < len(filters):
        raise ValueError("one to six filters of different names")
    by_mask = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^k
    size = 1 << len(filters)

    def run(batches):
        shared = Audit(filters)
        order = np.repeat(shared.orders, shared.k)
        for b in batches:
            if not b.num_rows:
                continue
            cells = b.column(1)
            row = np.repeat(np.arange(b.num_rows), np.diff(cells.offsets.to_numpy()))
            flat = cells.flatten()
            weight = np.zeros((b.num_rows, size, 3), np.int64)
            for k, name in enumerate(("n", "good", "toxic")):
                weight[row, flat.field("mask").to_numpy(), k] = flat.field(name).to_numpy()
            names = b.column(0)
            for a in range(0, b.num_rows, 64):  # 600 rows a part
                part = names.slice(a, 64)
                out = shared.counts(weight[a:a + 64])
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [part.take(pa.array(np.repeat(np.arange(n), len(order)))), pa.array(np.tile(order, n), pa.string()), pa.array(np.tile(np.arange(len(order)) % shared.k + 1, n).astype(np.int32))]
                    + [pa.array(x.reshape(-1)) for x in out.values()], ["part", "filter_order", "step", *out])

    return rows_bounded(parts).mapInArrow(run, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
                                               "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAPS), lambda w: w != "")


def text_fails(text: Column, words: Column) -> list[Column]:
    """Filters A to D of a text and its words, by expressions."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]


def corpus_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good, toxic of every document.  The texts are read once;
    a repeat is found by 128 bits of its hash."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = sum((c.cast("int") * (1 << f) for f, c in enumerate(text_fails(F.col("text"), F.col("words")))), F.lit(0))
    rows = cut(texts.withColumn("words", words_of(F.col("text"))).select("doc_id", "part", bits.alias("mask"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")))
    groups = rows.groupBy("h", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeated = cut(groups.where("first < last").select("h", "h2", "first"))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = join_counted(rows, repeated, ["h", "h2"], "left").join(marked, "doc_id", "left")
    repeat = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << 4)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    return found.select("part", (F.col("mask") + repeat).alias("mask"), flag("good"), flag("toxic"))
