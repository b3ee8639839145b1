"""Embedding near-duplicates by a subspace pigeonhole join (operator 6).

Two unit vectors of cosine c are sqrt(2 - 2c) apart.  After a fixed random
rotation the coordinates are split into blocks of ``BLOCK`` dimensions.  If the
squared distance is within the limit, then in some block it is within that
block's share of it, in proportion to its dimensions.  So per block a range join
finds the pairs near enough there, and the union over blocks misses none.

* **Copies** (same label, same components) become one class first, by
  aggregation with map-side combine; a class counts as often as it has members.
* **Range join.**  The first ``axes`` coordinates of a block lie in a grid
  whose cells are twice the block's range wide; a vector also goes to the lower
  neighbour along each axis where it is within range of the border.  A pair in
  range meets in the cell that is the lesser of both homes on every axis, and
  there alone.  ``axes`` follows the size of the largest label.
* **Hot cells** are cut into chunks of about ``CHUNK`` vectors, and each pair of
  chunks is a task of its own.
* **Once each.**  A task keeps a pair only if no earlier block has it in range,
  verifies the cosine in double precision, adds up links and unites what is
  linked; it returns a row per linked class, never the pairs.
* Components over the classes give every vector its component.

Vectors without a label, null, empty, zero, or with a null or non-finite
component link with nothing, nor do vectors of different dimension.  A row with
a null id links like any other, but cannot name a component; one of its own has
a null component and is not kept.  Rows that repeat an id are vectors of their
own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, rows_bounded
from .components import connected_components
from .simhash_dedup import NAMELESS, Union

COSINE = 0.98
BLOCK = 8
SEED = 42
# Vectors of a grid cell or chunk, on average, at which cells are cut further.
CHUNK = 1024
# A cell of twice the range parts the vectors of a label about threefold.
PER_AXIS = 3.0
# Above the rounding errors of a squared distance between unit vectors.
SLACK = 1e-9
TILE = 1024


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The same random orthogonal matrix wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return np.ascontiguousarray(q * np.sign(np.diag(r)))


def turned(unit: np.ndarray) -> np.ndarray:
    """Rotated vectors, bit for bit the same in whatever batch they stand."""
    return np.einsum("ij,jk->ik", unit, rotation(unit.shape[1]), optimize=False)


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def blocks_of(dim: int, cosine: float) -> list[tuple[int, int, float]]:
    """(first, last + 1 coordinate, squared range) of each block."""
    return [(a, min(a + BLOCK, dim), (2 - 2 * cosine) * (min(a + BLOCK, dim) - a) / dim + SLACK) for a in range(0, dim, BLOCK)]


def homes(t: np.ndarray, block: tuple[int, int, float], axes: int) -> np.ndarray:
    a, b, squared = block
    return np.floor(t[:, a:min(b, a + axes)] / (2 * math.sqrt(squared))).astype(np.int64)


def packed(cells: np.ndarray) -> np.ndarray:
    """One number for a cell: seven bits an axis (coordinates lie within -1..1)."""
    out = np.zeros(len(cells), np.int64)
    for k in range(cells.shape[1]):
        out = (out << 7) + np.clip(cells[:, k] + 64, 0, 127)
    return out


def cells_of(x: np.ndarray, cosine: float, axes: int) -> list[list[int]]:
    """For each vector the cells that it goes to, over all blocks, as block number and packed cell in one."""
    t = turned(units(x))
    out: list[list[int]] = [[] for _ in range(len(x))]
    for number, block in enumerate(blocks_of(x.shape[1], cosine)):
        home, reach = homes(t, block, axes), math.sqrt(block[2])
        low = t[:, block[0]:block[0] + home.shape[1]] - home * (2 * reach) <= reach * (1 + 1e-12)
        for step in product((0, 1), repeat=home.shape[1]):
            there = np.flatnonzero(np.all(low | (np.array(step) == 0), axis=1))
            for i, c in zip(there.tolist(), packed(home[there] - np.array(step, np.int64)).tolist()):
                out[i].append(number << 56 | c)
    return out


def links_in(x: np.ndarray, first: np.ndarray, second: np.ndarray, cell: int, cosine: float, axes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (one of ``first``, one of ``second``) linked and met in this
    cell for the first time.  With first equal to second each pair comes once."""
    unit = units(x)
    t, blocks, number = turned(unit), blocks_of(x.shape[1], cosine), cell >> 56
    a, b, squared = blocks[number]
    home, same = homes(t, blocks[number], axes), first is second
    part = np.ascontiguousarray(t[:, a:b])
    norm = np.einsum("ij,ij->i", part, part)
    for p in range(0, len(first), TILE):
        i = first[p:p + TILE]
        for q in range(p if same else 0, len(second), TILE):
            j = second[q:q + TILE]
            near = norm[i][:, None] + norm[j][None, :] - 2 * part[i] @ part[j].T <= squared + SLACK
            if same and p == q:
                near = np.triu(near, 1)
            u, v = np.nonzero(near)
            u, v = i[u], j[v]
            for k, (c, d, limit) in enumerate(blocks[:number + 1]):
                gap = t[u, c:d] - t[v, c:d]
                within = np.einsum("ij,ij->i", gap, gap) <= limit
                keep = within if k == number else ~within
                u, v = u[keep], v[keep]
            keep = packed(np.minimum(home[u], home[v])) == cell & (1 << 56) - 1
            u, v = u[keep], v[keep]
            keep = np.einsum("ij,ij->i", unit[u], unit[v]) >= cosine
            if keep.any():
                yield u[keep], v[keep]


def usable(label: Column, v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return label.isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(root, node, links) for classes (node, n, label, v): a row per class and
    task that links it; ``links`` are the members of the classes it links to
    there, ``root`` is a class that it is connected to."""
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    axes = min(BLOCK, max(1, math.ceil(math.log(max(most, 1) / (2 * CHUNK), PER_AXIS))))
    kind = {f.name: f.dataType.simpleString() for f in classes.schema}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("v").to_pylist()
            cells: list = [None] * len(rows)
            for dim in {len(r) for r in rows}:
                at = [k for k, r in enumerate(rows) if len(r) == dim]
                for k, c in zip(at, cells_of(np.array([rows[k] for k in at]), cosine, axes)):
                    cells[k] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int64()))], [*b.schema.names, "cells"])

    names = ["node", "n", "label", "v"]
    placed = cut(rows_bounded(classes.select(*names)).mapInArrow(place, ", ".join(f"{c} {kind[c]}" for c in names) + ", cells array<long>"))
    each = placed.withColumn("cell", F.explode("cells")).drop("cells").withColumn("dim", F.size("v"))
    full = cut(each.groupBy("label", "dim", "cell").count().where(F.col("count") > 2 * CHUNK).select("label", "dim", "cell", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    each = join_counted(each, full, ["label", "dim", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    each = each.withColumn("own", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("chunks")).cast("int"))
    # Chunk i meets every chunk: tasks (least, greatest).
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    each = each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        x, own = np.stack(pdf["v"].to_numpy()), pdf["own"].to_numpy()
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        first = np.flatnonzero(own == i)
        second = first if i == j else np.flatnonzero(own == j)
        union, n, linked = Union(len(pdf)), pdf["n"].to_numpy(), np.zeros(len(pdf), np.int64)
        for u, v in links_in(x, first, second, int(pdf["cell"].iloc[0]), cosine, axes):
            linked += np.bincount(u, n[v], len(pdf)).astype(np.int64) + np.bincount(v, n[u], len(pdf)).astype(np.int64)
            union.add(u, v)
        hit, node = linked > 0, pdf["node"].to_numpy()
        return pd.DataFrame({"root": node[union.root[hit]], "node": node[hit], "links": linked[hit]})

    return each.groupBy("label", "dim", "cell", "i", "j").applyInPandas(task, "root long, node long, links long")


def embedding_dedup(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row."""
    v, label = F.col(vector_col), F.col(label_col)
    base = rows.select(F.col(id_col).alias("_id"), v.alias("v"), label.cast("string").alias("label"), usable(label, v).alias("ok"))
    # Two 64-bit hashes with different seeds stand for label and components.
    keys = {k: F.when(F.col("ok"), F.xxhash64(F.lit(s), "label", "v")) for k, s in (("h1", 1), ("h2", 2))}
    narrow = cut(base.withColumns(keys).select("_id", "h1", "h2"))
    classes = (base.where("ok").withColumns(keys).groupBy("h1", "h2")
               .agg(F.min(F.col("_id").cast("long")).alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")))
    classes = cut(classes.withColumn("node", F.coalesce("least", F.lit(NAMELESS) + F.monotonically_increasing_id())).drop("least"))
    found = cut(links(classes, cosine))
    component = connected_components(found, "root", "node")
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    # Tasks' rows are few per class; classes without links are not among them.
    facts = classes.select("h1", "h2", "node", "n").join(total, "node", "left").join(component, "node", "left")
    c = F.coalesce("component", "node")
    facts = cut(facts.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(c < NAMELESS, c).alias("component_id")))
    alone = narrow.where("h1 IS NULL").select(F.col("_id"), F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"))
    out = narrow.where("h1 IS NOT NULL").join(facts, ["h1", "h2"]).select("_id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))
