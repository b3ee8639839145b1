"""SimHash near-duplicates by a binary trie self-join (operator 7).

1. **Fingerprint**, in one pass over the texts: words after A-Z lower-casing,
   shingles of ``shingle`` words, XXH64 of each, majority vote per bit.
2. **Classes**: documents with one fingerprint form a class named by it
   (aggregation with map-side combine), so copies never meet as pairs.
3. **Trie self-join** of the distinct fingerprints.  Of ``max_bits`` + 1 disjoint
   blocks of bits at least one is equal in two linked fingerprints, so each
   fingerprint is read in as many rotations, each block leading once: in the
   trie of a rotation only subtrees below one and the same block are joined.
   Such a subtree is a unit of work; a fingerprint goes to ``max_bits`` + 1
   units (4), whatever the input.  A unit of more than ``HEAVY`` fingerprints is
   cut by the same rule: the bits below its block are rotated by blocks in
   turn (4 units for each of its fingerprints), and so on (64, 48, 36, 27, 21 bits
   left), so a unit is never larger than ``HEAVY`` or the values that its last bits
   can take.  Inside a unit the rest of the trie is traversed by pairs of nodes
   level by level, adding the differing bit, and a pair of nodes is dropped as
   soon as the error budget is spent.
4. A unit unites what it links and returns one link per united fingerprint,
   so a dense group of K near copies gives O(K) rows, not K**2.
5. **Components** over the classes (:mod:`components`), named by the least
   doc_id among their rows; every row takes the component of its class.

Null or wordless texts have fingerprint zero and link like any other.  A row
with a null doc_id gets its fingerprint, but takes no part in naming: its component
is that of its class, null where no document of the component
has an id.  Rows are told apart by their values, not by doc_id: rows that repeat
an id with other texts lie in the components of their texts, and
:func:`keep_one` decides for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, map_texts
from .components import connected_components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
# A unit of more fingerprints is cut into smaller ones.
HEAVY = 1 << 17
# Rows of small units that a task works on together.
TOGETHER = 1 << 16
# Above every id: names for classes in which no row has an id (operator 6).
NAMELESS = 2**62
# A pair of nodes with so few pairs of leaves is compared leaf by leaf.
LEAF_PAIRS = 32
# Node pairs worked on at a time; a longer frontier is put aside.
FRONTIER = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text, 0 to 2**64 - 1."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    rows = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    join, digest = b" ".join, xxhash.xxh64_intdigest
    h = np.array([digest(join(r), seed) for r in rows], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, columns of ``carry``, fp) with fp as a signed long; one row per row of ``docs``."""
    def run(_, texts: pa.Array) -> dict:
        return {"fp": np.array([fingerprint(t, shingle, seed) for t in texts.to_pylist()], np.uint64).view(np.int64)}

    return map_texts(docs, run, "fp long", id_col, text_col, carry)


class Trie:
    """Sorted distinct fingerprints seen as a binary trie: level d groups the
    ones that share their first d bits."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        x = fps[1:] ^ fps[:-1]
        # Shared leading bits of neighbours (float logs round up near 2**k, so the high and low halves are taken apart).
        high = (x >> np.uint64(32)).astype(np.int64)
        low = (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
        bits = np.where(high > 0, 32 + _bit_length(high), _bit_length(low))
        self.shared = 64 - bits
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def level(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last+1 leaf of each node of level d, and the node of each leaf."""
        if d not in self.levels:
            new = self.shared < d
            first = np.concatenate([[0], np.flatnonzero(new) + 1])
            self.levels[d] = first, np.append(first[1:], len(self.fps)), np.concatenate([[0], np.cumsum(new)])
        return self.levels[d]


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)  # exact below 2**53


def near_pairs(a: Trie, b: Trie, depth: int, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf indices (i of a, j of b) at ``max_bits`` or fewer differing bits, in
    pieces of bounded size.  Each trie is one subtree below ``depth``.  With
    ``a is b`` each pair is met once, without (i, i), and the trie may hold many
    subtrees: pairs within each of them are found."""
    same = a is b
    if not len(a.fps) or not len(b.fps):
        return
    if same:
        tops = np.arange(len(a.level(depth)[0]))
        todo = [(depth, tops, tops, np.zeros(len(tops), np.int64))]
    else:
        gap = (int(a.fps[0]) ^ int(b.fps[0])) >> (64 - depth) if depth else 0
        todo = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, gap.bit_count(), np.int64))]
    while todo:
        d, na, nb, err = todo.pop()
        if len(na) > FRONTIER:
            half = len(na) // 2
            todo += [(d, na[:half], nb[:half], err[:half]), (d, na[half:], nb[half:], err[half:])]
            continue
        (a0, a1, _), (b0, b1, _) = a.level(d), b.level(d)
        few = (a1[na] - a0[na]) * (b1[nb] - b0[nb]) <= LEAF_PAIRS if d < 64 else np.ones(len(na), bool)
        if few.any():
            x, y = na[few], nb[few]
            wide = b1[y] - b0[y]
            n = (a1[x] - a0[x]) * wide
            pair = np.repeat(np.arange(len(x)), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            i, j = a0[x][pair] + k // wide[pair], b0[y][pair] + k % wide[pair]
            hit = np.bitwise_count(a.fps[i] ^ b.fps[j]) <= max_bits
            if same:
                hit &= i < j
            if hit.any():
                yield i[hit], j[hit]
            na, nb, err = na[~few], nb[~few], err[~few]
        if not len(na):
            continue
        shift = np.uint64(63 - d)
        one = np.uint64(1)
        ka, kb = a.level(d + 1)[2], b.level(d + 1)[2]
        sides = []
        for trie, first, last, kids, node in ((a, a0, a1, ka, na), (b, b0, b1, kb, nb)):
            lo, hi = first[node], last[node] - 1
            sides.append(((kids[lo], (trie.fps[lo] >> shift) & one), (kids[hi], (trie.fps[hi] >> shift) & one)))
        nxt = []
        two_a, two_b = sides[0][0][0] != sides[0][1][0], sides[1][0][0] != sides[1][1][0]
        for s in (0, 1):
            for t in (0, 1):
                keep = (two_a if s else True) & (two_b if t else True)
                if same and (s, t) == (1, 0):
                    keep = keep & (na != nb)  # the mirror of (0, 1)
                (xa, bit_a), (xb, bit_b) = sides[0][s], sides[1][t]
                e = err + (bit_a != bit_b)
                keep = np.flatnonzero(keep & (e <= max_bits))
                nxt.append((xa[keep], xb[keep], e[keep]))
        todo.append((d + 1, *(np.concatenate(z) for z in zip(*nxt))))


class Union:
    """Least-member labels of 0..n-1 under unions given as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            x, y = self.root[i], self.root[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _rotated(x: Column, left: int, by: int) -> Column:
    """``x`` with its last ``left`` bits rotated to the left."""
    if not by:
        return x
    ones = (1 << left) - 1
    low = x.bitwiseAND(F.lit(ones)) if left < 64 else x
    turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, left - by))
    return turned if left == 64 else turned.bitwiseAND(F.lit(ones)).bitwiseOR(x.bitwiseAND(F.lit(~ones)))


def _units(classes: DataFrame, max_bits: int, heavy: int) -> DataFrame:
    """(path, bits, key, x, node): a unit is a path and a key, the first ``bits``
    bits of x; x is the fingerprint with its bits in the order of the path.
    Units of one fingerprint are left out."""
    blocks, left, light = max_bits + 1, 64, []
    todo = classes.select(F.lit(1).cast("long").alias("path"), F.col("fp").alias("x"), "node")
    while True:
        width = left // blocks
        turns = F.array(*[F.struct((F.col("path") * blocks + j).alias("path"), _rotated(F.col("x"), left, j * width).alias("x")) for j in range(blocks)])
        left -= width
        rows = todo.select("node", F.explode(turns).alias("t")).select("t.path", F.lit(64 - left).alias("bits"), F.shiftrightunsigned("t.x", left).alias("key"), "t.x", "node")
        sizes = cut(rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        rows = join_counted(rows, sizes, ["path", "key"])
        if left < blocks or sizes.where(F.col("size") > heavy).isEmpty():
            light.append(rows.drop("size"))
            return reduce(DataFrame.unionByName, light)
        light.append(rows.where(F.col("size") <= heavy).drop("size"))
        todo = rows.where(F.col("size") > heavy)


def trie_links(classes: DataFrame, max_bits: int = MAX_BITS, heavy: int = HEAVY) -> DataFrame:
    """Links (a, b) between nodes of ``classes`` (node long, fp long, both
    distinct) that connect exactly the fingerprints within ``max_bits``."""
    def unit_links(path: np.ndarray, bits: np.ndarray, x: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole units, path by path (on a path a fingerprint occurs once)."""
        ends = np.append(np.flatnonzero(path[1:] != path[:-1]) + 1, len(path))
        for lo, hi in zip(np.append(0, ends[:-1]), ends):
            fps, own = x[lo:hi].view(np.uint64), node[lo:hi]
            order = np.argsort(fps)
            fps, own = fps[order], own[order]
            by_node = np.argsort(own)
            rank = np.empty(len(own), np.int64)
            rank[by_node] = np.arange(len(own))
            t, union = Trie(fps), Union(len(own))
            for i, j in near_pairs(t, t, int(bits[lo]), max_bits):
                union.add(rank[i], rank[j])
            named, joined = own[by_node], union.root != np.arange(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(named[union.root[joined]]), pa.array(named[joined])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += len(batch)
            if rows < TOGETHER:
                continue
            path, bits, key, x, node = map(np.concatenate, zip(*held))
            inside = (path == path[-1]) & (key == key[-1])  # the last unit may go on
            whole = len(path) - int(inside.sum())
            if whole:
                yield from unit_links(path[:whole], bits[:whole], x[:whole], node[:whole])
            held, rows = [[c[whole:] for c in (path, bits, key, x, node)]], 0
        if held:
            path, bits, _, x, node = map(np.concatenate, zip(*held))
            if len(path):
                yield from unit_links(path, bits, x, node)

    units = _units(classes, max_bits, heavy).repartition("path", "key").sortWithinPartitions("path", "key")
    return units.select("path", "bits", "key", "x", "node").mapInArrow(run, "a long, b long")


def _components(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, c): the component of each fingerprint, named by its least fingerprint."""
    classes = cut(fps.select("fp").distinct().withColumn("node", F.col("fp")))
    found = connected_components(trie_links(classes, max_bits), "a", "b")
    return cut(classes.join(found, "node", "left").select("fp", F.coalesce("component", "fp").alias("c")))


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``."""
    fps = cut(fingerprints(docs, shingle, seed, id_col, text_col).withColumnRenamed(id_col, "_id"))
    of = _components(fps, max_bits)
    least = fps.groupBy("fp").agg(F.min(F.col("_id").cast("long")).alias("least"))
    named = cut(least.join(of, "fp").groupBy("c").agg(F.min("least").alias("component_id")))
    component = cut(of.join(named, "c").select("fp", "component_id"))
    return fps.join(component, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def _row_hash(docs: DataFrame) -> Column:
    """The same for rows that agree in every column; a null counts as a value of its own."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``: the first by id (null last), then by
    a hash of all columns.  Rows with neither an id nor words are a group of
    their own, of which one stays."""
    fps = cut(fingerprints(docs, shingle, seed, id_col, text_col, {"_m": _row_hash(docs)}).withColumnRenamed(id_col, "_i"))
    bare = F.col("_i").isNull() & (F.col("fp") == 0)
    order = F.struct(F.col("_i").isNull().alias("none"), "_i", "_m")
    stays = (fps.join(_components(fps, max_bits), "fp").groupBy("c", bare.alias("bare")).agg(F.min(order).alias("s"))
             .select(F.col("s._i").alias("_si"), F.col("s._m").alias("_sm")))
    # Equal id and hash are equal rows, so of one component.
    seen = fps.groupBy("_i", "_m").count()
    chosen = cut(seen.join(stays, (F.col("_m") == F.col("_sm")) & F.col("_i").eqNullSafe(F.col("_si")), "left")
                 .select("_i", "_m", F.col("_sm").isNotNull().alias("stays"), "count"))
    gone = cut(chosen.where("not stays").select("_i", "_m"))
    again = cut(chosen.where("stays and count > 1").select("_i", "_m"))
    same = (F.col("_mark") == F.col("_m")) & F.col(id_col).eqNullSafe(F.col("_i"))
    left = join_counted(docs.withColumn("_mark", _row_hash(docs)), gone, same, "left_anti")
    if again.isEmpty():
        return left.drop("_mark")
    once = join_counted(left, again, same, "left_semi").dropDuplicates([id_col, "_mark"])
    return join_counted(left, again, same, "left_anti").unionByName(once).drop("_mark")
