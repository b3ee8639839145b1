"""Mixing sources to target weights by weighted fair queueing (operator 8).

**Targets.**  Sources in code-point order (null last) weigh ``weights`` in
turn and share ``share`` times all words; a target stops at ``cap`` times its
source's words and the excess goes to the others by weight.  The result is the
water level L with target = min(cap * words, L * weight): sources sorted by
the level at which they fill, the level is read off running sums.

**Queue.**  Each source offers its documents in a shuffled order (a hash of
its values and a seed), once more for each repeat.  A document's virtual finish time is
its source's cumulative words, itself included, divided by the target.  All
offers are merged by finish time and cut where the words taken reach the
budget, the sum of the targets.

No source is ever in one task: running sums go over hash ranges, first per range, then inside it, and the merge cuts finish
time into ranges the same way; only the range in which the budget ends is
looked at row by row.  There are about as many ranges as rows in a range (the
square root of all rows), so neither the list of ranges nor a range grows
large.  Ranges are expressions of a row's own values, so a retried task gives
the same ones.

A row's place in the shuffled order is a hash of its id, source and text, so rows
that share an id, null ids included, are spread like any others and have their own
copies; only rows equal in all three stand next to each other in the queue.

A null text has size 0; rows of size 0 take no words (``copies`` is 0).  Equal
finish times of different sources are taken by turn, then by place, id and size.
A null id, source or text is hashed as empty.  No words at all: every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_counted

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 42
# Finish times reach cap * words / target; the budget ends near 1, so those
# beyond this are put together in one last range.
REACH = 16


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(_id, _source, _key, size, mixed): the words of each whole text and its place
    in the shuffled order; the key is the source with null as a value of its own."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    return docs.select(F.col(id_col).alias("_id"), source.alias("_source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_key"), size.alias("size"),
                       _mixed(F.col(id_col), source, F.col(text_col), seed).alias("mixed"))


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``per_source`` (_source, _key, source_size) with ``target``.  The windows
    run over one row per source."""
    turn = F.array(*[F.lit(float(w)) for w in weights])
    named = Window.orderBy(F.col("_source").asc_nulls_last())
    s = (per_source.withColumn("weight", F.element_at(turn, (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int")))
         .withColumn("full", F.col("source_size") * F.lit(float(cap))))
    filling = Window.orderBy(F.col("full") / F.col("weight"), F.col("_key"))
    before, everyone = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = lambda c: F.sum(c).over(everyone) - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    budget = F.sum("source_size").over(everyone) * F.lit(float(share))
    # The level if the sources before this one are full and the others are not ...
    s = (s.withColumn("level", (budget - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / rest("weight"))
         .withColumn("place", F.row_number().over(filling)))
    # ... holds at the first source that it does not fill; else all sources are full.
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct("place", "level"))
    return (s.withColumn("level", F.min(open_).over(everyone)["level"])
            .select("_source", "_key", "source_size", F.least(F.col("full"), F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target")))


def queue(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(_id, _source, size, source_size, target, mixed, ahead): ``mixed`` is the
    row's place in the shuffled order, ``ahead`` the words of its source up to
    and with it.  A checkpointed table, one row per row of ``docs``."""
    rows = cut(sizes(docs, id_col, text_col, source_col, seed))
    ranges = math.isqrt(rows.count()) + 1
    rows = rows.withColumn("_range", _range_of(F.col("mixed"), ranges))
    sums = cut(rows.groupBy("_key", "_range").agg(F.first("_source").alias("_source"), F.sum("size").alias("words")))
    goals = cut(targets(sums.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("words").alias("source_size")), weights, share, cap).drop("_source"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sums.select("_key", "_range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")))
    inside = Window.partitionBy("_key", "_range").orderBy("mixed", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ahead", F.sum("size").over(inside))
    rows = join_counted(join_counted(rows, starts, ["_key", "_range"]), goals, "_key")
    return cut(rows.select("_id", "_source", "size", "source_size", "target", "mixed", (F.col("start") + F.col("ahead")).alias("ahead")))


def _mixed(key: Column, source: Column, text: Column, seed: int) -> Column:
    """Place in the shuffled order: the first 60 bits of an MD5 of seed, id, source and the text's MD5."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), shown(key), shown(source), F.md5(shown(text))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _range_of(mixed: Column, ranges: int) -> Column:
    """Range 0..ranges-1 of a uniform 60-bit hash, in the order of the hash."""
    return F.least(F.floor(mixed.cast("double") / F.lit(2.0**60) * F.lit(ranges)), F.lit(ranges - 1)).cast("long")


def _finish(turn: Column) -> Column:
    """Words of the source up to and with this offer, over the target."""
    return (turn * F.col("source_size") + F.col("ahead")) / F.when(F.col("target") > 0, F.col("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, mixed, size, source_size, target, copies, taken, finish): ``copies``
    of each row are in the mix, ``taken`` words in all; ``finish`` has the
    virtual finish time of each copy.  Exploded by it and ordered, the rows are
    the mix."""
    rows = queue(docs, weights, share, cap, seed, id_col, text_col, source_col)
    repeats = math.ceil(cap)
    key = ["finish", "turn", "mixed", "_id", "size"]
    offers = (rows.where("size > 0").withColumn("turn", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
              .withColumn("finish", _finish(F.col("turn"))).select(*key))
    words, n = rows.agg(F.sum("size"), F.count("*")).first()
    budget, ranges = math.floor((words or 0) * min(share, cap)), math.isqrt(repeats * n) + 1
    part = lambda finish: F.floor(F.least(finish, F.lit(float(REACH))) * F.lit(ranges)).cast("long")
    sums = offers.groupBy(part(F.col("finish")).alias("part")).agg(F.sum("size").alias("words"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    last = sums.withColumn("upto", F.sum("words").over(so_far)).where(F.col("upto") >= budget).orderBy("part").limit(1).first()
    taken = [F.lit(True)] * repeats  # less on offer than the budget
    if last:
        here = offers.where(part(F.col("finish")) == last["part"])
        upto = F.sum("size").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(last["upto"] - last["words"])
        # The offer in which the budget ends is taken if more than half of it fits.
        end = here.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= budget).agg(F.max(F.struct(*key)).alias("end")).first()["end"]
        for k in range(repeats):
            own = _finish(F.lit(k))
            if end is None:
                taken[k] = part(own) < last["part"]
            else:
                taken[k] = F.struct(own.alias("finish"), F.lit(k).alias("turn"), "mixed", "_id", "size") <= F.struct(*[F.lit(end[c]).cast(offers.schema[c].dataType).alias(c) for c in key])
    copies = sum((F.when((F.col("size") > 0) & t, 1).otherwise(0) for t in taken), F.lit(0))
    out = rows.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "mixed", "size", "source_size", "target", copies.alias("copies"),
                      F.array(*[_finish(F.lit(k)) for k in range(repeats)]).alias("finish"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).withColumn("finish", F.slice("finish", 1, F.col("copies")))


def apply_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it.  Rows are found again
    by their place in the shuffled order and their id; those equal in id, source
    and text are written as often as the one of them taken most."""
    mixed = mix(docs, weights, share, cap, seed, id_col, text_col, source_col)
    copies = cut(mixed.groupBy("mixed", F.col(id_col).alias("id")).agg(F.max("copies").alias("copies")).where("copies > 0"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("own"), _mixed(F.col(id_col), F.col(source_col), F.col(text_col), seed).alias("place"))
    out = join_counted(rows, copies, (F.col("place") == F.col("mixed")) & F.col("own").eqNullSafe(F.col("id")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
