"""Exact selection by position in a keyed-hash order, without ordering the rows.

Hashes are lower-case hex digits, evenly spread.  A histogram over their first
digits (pre-aggregated in each partition, at most ``16 ** DIGITS`` rows a tag) says
which prefix holds a wanted position; the next histogram looks only at rows with
that prefix and at more digits, until a prefix holds few rows.  Two or three
passes over narrow records find any position among billions of rows; nothing
is range-partitioned, sorted or checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Digits that a histogram adds; rows under one prefix that are looked at by key.
DIGITS = 3
FEW = 5_000


def keys_at(records: DataFrame, wanted: dict[str, list[int]], digits: int = DIGITS, few: int = FEW) -> tuple[dict, dict]:
    """``records``: tag, h, k.  The (h, k) at every wanted position (from 1, by h
    then k, within its tag) as ``{(tag, position): (h, k)}``, and the number of
    records of every tag.  Positions beyond a tag's records are left out.
    Records that repeat a key take a position each."""
    counts: dict[str, int] = {}
    found, open_ = {}, {("", tag): [(p, p) for p in ps] for tag, ps in wanted.items()}  # (prefix, tag) -> (position, position under the prefix)
    width = 0
    rows = records
    while open_ or not width:
        width += digits
        parts = rows.groupBy("tag", F.substring("h", 1, width).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        under: dict = {}
        for r in parts:
            under.setdefault((r["p"][:width - digits], r["tag"]), []).append((r["p"], r["n"]))
        if width == digits:
            for r in parts:
                counts[r["tag"]] = counts.get(r["tag"], 0) + r["n"]
        small, open_ = _descend(open_, under, few, width)
        if small:
            found.update(_by_key(records, small))
        if open_:
            rows = records.where(F.struct("tag", F.substring("h", 1, width)).isin([F.struct(F.lit(t), F.lit(p)) for p, t in open_]))
    return found, counts


def _descend(open_: dict, under: dict, few: int, width: int) -> tuple[dict, dict]:
    """The prefixes in which the positions lie, those with few rows (or whole hashes) apart."""
    small, large = {}, {}
    for (prefix, tag), positions in open_.items():
        before = 0
        for p, n in sorted(under.get((prefix, tag), [])):
            inside = [(name, at - before) for name, at in positions if before < at <= before + n]
            if inside:
                (small if n <= few or width >= 32 else large)[(p, tag)] = inside
            before += n
    return small, large


def _by_key(records: DataFrame, small: dict) -> dict:
    """The keys at positions under prefixes of few rows, or of one hash: a row for each different key."""
    width = len(next(iter(small))[0])
    rows = records.where(F.struct("tag", F.substring("h", 1, width)).isin([F.struct(F.lit(t), F.lit(p)) for p, t in small]))
    keys: dict = {}
    for r in rows.groupBy("tag", "h", "k").agg(F.count(F.lit(1)).alias("n")).collect():
        keys.setdefault((r["h"][:width], r["tag"]), []).append((r["h"], r["k"] is not None, r["k"], r["n"]))
    out = {}
    for group, positions in small.items():
        before = 0
        for h, _, k, n in sorted(keys[group], key=lambda x: x[:3] if x[1] else x[:2]):
            out.update({(group[1], name): (h, k) for name, at in positions if before < at <= before + n})
            before += n
    return out
