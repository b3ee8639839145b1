"""Connected components of a link table by contraction.

Each round every node joins the least node among its neighbours and itself
(round 0 by id, so that a star around its least node is done at once; later
rounds by a hash that differs from round to round, so that long chains shrink
by a constant factor too).  Links are rewritten to the joined nodes, self
links and repeats go, and the next round works on what is left.  Finding the
least neighbour is an aggregation with map-side combine; the joins have a
unique key on one side and plain exchanges on both, so adaptive execution can
split a hub.  Every round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node in a link; component is the least
    node reachable.  Links with a null end or from a node to itself say
    nothing; repeats and direction do not matter.  No links: no rows."""
    links = cut(_tidy(links.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    steps = []
    while not links.isEmpty():
        order = (lambda c: F.struct(F.lit(0).cast("long").alias("h"), c.alias("v"))) if not steps else (
            lambda c, seed=len(steps): F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), c.alias("v")))
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w")))).alias("e")).select("e.*")
        best = ends.groupBy("u").agg(F.min(order(F.col("w"))).alias("best"))
        step = cut(best.select(F.col("u"), F.least(order(F.col("u")), F.col("best"))["v"].alias("p")))
        steps.append(step)
        pa = step.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        pb = step.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        links = cut(_tidy(links.join(pa, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    top = steps[-1].select("u", F.col("p").alias("rep"))
    for step in reversed(steps[:-1]):
        up = top.select(F.col("u").alias("p"), "rep")
        top = step.join(up, "p", "left").select("u", F.coalesce("rep", "p").alias("rep"))
    if len(steps) == 1:  # by id: the representative is the least node
        return top.select(F.col("u").alias("node"), F.col("rep").alias("component"))
    top = cut(top)
    least = cut(top.groupBy("rep").agg(F.min("u").alias("component")))
    return top.join(least, "rep").select(F.col("u").alias("node"), "component")


def _tidy(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
