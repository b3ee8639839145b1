"""Runs of repeating words by string synchronising sets (operator 13).

A *run* of a sequence of words is a stretch whose smallest period is q (words q
apart are identical), of length at least ``max(least, times * q)``, that no
neighbouring word extends with period q.  A word is dropped if any run holds it
after that run's first q words.

**Synchronising positions.**  At scale t = 1, 2, 4, … every window of t words
has a 64-bit name (of the halves' names).  Position i is in the set S if, of the
windows that begin at i … i + t and are not highly periodic, the one with the
smallest name begins at i or at i + t.  Whether i is in S therefore depends on
its *context*, the words i … i + 2t - 1, alone; and unless all windows beginning
at i … i + 2t - 1 are highly periodic, one of the positions i … i + t - 1 is in
S.  Highly periodic windows (period at most t / 4) are those inside runs that
smaller scales have found, so the omitted small periods are supplied by them.

**Periods.**  A run of period q in [t, 2t) is four periods long, so it holds
a position of S within its first t words, and q words on the same context again,
hence a position of S.  A nearer equal context would, by Fine and Wilf, give
the run a period that divides q.  So each position of S and the next one of equal
context propose their distance, if it is in [t, 2t).  A proposal shows words q
apart to agree over 2t words; proposals that meet or overlap are put together,
and what remains at both ends is shorter than t words, compared by the names of
windows of t, t/2, … 1 words.

Names decide nothing alone: every run is compared word by word, and a chunk in
which that fails (two windows with one name) is done again with other names.

The work of a text grows with its words times the number of scales, whatever it
repeats.  Texts are independent: no shuffle, a lost task is simply done again.

A null or empty text has no words and no runs.  A text under ``least`` words has
no run.  Rows that repeat an id are texts of their own.  An empty table
gives an empty one, other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_texts, words_of

LEAST = 6
TIMES = 4
_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find_runs(code: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run, ordered by start and period.

    ``code`` holds the numbers of the words of several texts one after the other,
    equal for equal words; a text ends before each place of ``ends``."""
    if times < 4:
        raise ValueError("a run must be at least four periods long for the proposals to be complete")
    sizes = np.diff(ends, prepend=0)
    order = np.argsort(-sizes, kind="stable")  # long texts first: a scale works on a prefix
    begins = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
    joined = np.empty(begins[-1], np.int64)
    place = np.arange(len(code)) + np.repeat((begins[:-1] - (ends - sizes)[order])[np.argsort(order, kind="stable")], sizes)
    joined[place] = code
    joined[begins[1:] - 1] = -1 - np.arange(len(order))  # a word of its own after each text
    for seed in range(8):
        start, end, period = _runs_of(joined, begins, sizes[order], seed, times)
        keep = end - start >= np.maximum(least, times * period)
        start, end, period = start[keep], end[keep], period[keep]
        if _agree(joined, start, end, period):
            break
    else:
        raise RuntimeError("names of windows kept colliding")
    text = np.searchsorted(begins, start, "right") - 1
    shift = (ends - sizes)[order][text] - begins[:-1][text]
    start, end = start + shift, end + shift
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _runs_of(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, seed: int, times: int):
    """Stretches of at least ``times`` periods, of all scales."""
    names = [_mix(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))]
    found = [np.empty((3, 0), np.int64)]
    t = 1
    while len(sizes) and times * t <= sizes[0]:
        n = begins[np.searchsorted(-sizes, -times * t, "right")]  # texts long enough for a period of t
        level = [x[:max(0, n - (1 << k) + 1)] for k, x in enumerate(names)]
        whole = level[-1]
        context = _mix(whole[:-t] * np.uint64(0xD6E8FEB86659FD93) + (whole[t:] ^ np.uint64(seed)))
        stretches = _propose(whole, context, _periodic(np.concatenate(found, 1), n, t), t)
        found.append(_extend(stretches, level, n, times))
        names.append(context)
        t *= 2
    start, end, period = np.concatenate(found, 1)
    return start, end, period


def _periodic(found: np.ndarray, n: int, t: int) -> np.ndarray | None:
    """Windows of t words with a period of at most t / 4, from the runs of smaller scales."""
    start, end, period = found
    hold = (period <= t // 4) & (end - start >= t) & (end <= n)
    if not hold.any():
        return None
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, start[hold], 1)
    np.add.at(steps, end[hold] - t + 1, -1)
    return np.cumsum(steps)[:n - t + 1] > 0


def _propose(whole: np.ndarray, context: np.ndarray, periodic: np.ndarray | None, t: int) -> np.ndarray:
    """(from, to, period): words ``period`` apart agree for every place from … to - 1."""
    name = whole if periodic is None else np.where(periodic, _NONE, whole)
    low, width = name, 1
    while width < t:  # smallest of 2, 4, … t windows
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    first, last = name[:len(context)], name[t:t + len(context)]
    low = np.minimum(low[:len(context)], last)
    at = np.flatnonzero((low != _NONE) & ((low == first) | (low == last)))
    by = np.argsort(context[at], kind="stable")
    at, same = at[by], np.diff(context[at][by]) == 0
    gap = np.diff(at)
    hit = same & (gap >= t) & (gap < 2 * t)
    start, period = at[:-1][hit], gap[hit]
    by = np.lexsort((start, period))
    start, period = start[by], period[by]
    if not len(start):
        return np.empty((3, 0), np.int64)
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] > start[:-1] + 2 * t)])
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(start)]]) - 1
    return np.stack([start[heads], start[tails] + 2 * t, period[heads]])


def _extend(stretches: np.ndarray, level: list[np.ndarray], n: int, times: int) -> np.ndarray:
    """The stretches carried on at both ends by ever smaller windows; (start, end, period)."""
    start, to, period = stretches
    for k in reversed(range(len(level))):
        step, names = 1 << k, level[k]
        on = np.flatnonzero(to + period + step <= n)
        on = on[names[to[on]] == names[to[on] + period[on]]]
        to[on] += step
        on = np.flatnonzero(start >= step)
        on = on[names[start[on] - step] == names[start[on] - step + period[on]]]
        start[on] -= step
    out = np.stack([start, to + period, period])
    return np.unique(out[:, out[1] - out[0] >= times * out[2]], axis=1)


def _agree(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Every run word by word, and the words beside it."""
    size = end - start - period
    at = np.arange(size.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.empty(0, np.int64)
    left = start > 0
    return bool((words[at] == words[at + np.repeat(period, size)]).all() and (words[end] != words[end - period]).all()
                and (words[start[left] - 1] != words[start[left] - 1 + period[left]]).all())


def repeats(code: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """True for words that a run holds after its first period."""
    steps = np.zeros(len(code) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps)[:-1] > 0


def planted(ids: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The source place of every word after the contract's planting: of each
    tenth document by crc32 of its id, the words from a on repeat with period p."""
    ends = np.cumsum(sizes)
    source = np.arange(ends[-1] if len(ends) else 0)
    for k, i in enumerate(ids.to_pylist()):
        n = int(sizes[k])
        if i is None or not n or (h := zlib.crc32(str(i).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        first = ends[k] - n
        source[first + a:ends[k]] = first + a + np.arange(n - a) % p
    return source


def _digests(ids: pa.Array, texts: pa.Array, plant: bool) -> dict:
    words, row = words_of(texts)
    n = len(texts)
    sizes = np.bincount(row, minlength=n)
    if plant:
        words = words.take(pa.array(planted(ids, sizes)))
    ends = np.cumsum(sizes)
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.empty(0, np.int64)
    start, end, period = find_runs(code, ends)
    kept = ~repeats(code, start, end, period)
    text = np.searchsorted(ends, start, "right")
    start = start - (ends - sizes)[text]
    end = end - (ends - sizes)[text]
    many = np.bincount(text, minlength=n)
    best = _best(text, start, end - start, period, n)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=n))]).astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(kept))), " ")
    lines = [f"{s},{size},{p}\n" for s, size, p in zip(start.tolist(), (end - start).tolist(), period.tolist())]
    cuts = np.concatenate([[0], np.cumsum(many)]).tolist()
    empty = hashlib.sha256(b"").hexdigest()
    return {
        "n_runs": many.astype(np.int64),
        "start": _pick(start, best), "length": _pick(end - start, best), "period": _pick(period, best),
        "exponent_milli": _pick(1000 * (end - start) // period, best),
        "runs_sha256": [hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() if b > a else empty for a, b in zip(cuts, cuts[1:])],
        "collapsed_sha256": [hashlib.sha256(x.as_buffer()).hexdigest() for x in collapsed],
    }


def _best(text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray, n: int) -> np.ndarray:
    """Each text's run of greatest length, of equal ones the first by start and period; -1: none."""
    best = np.full(n, -1)
    by = np.lexsort((period, start, -length, text))
    first = by[np.flatnonzero(np.diff(text[by], prepend=-1))] if len(by) else by
    best[text[first]] = first
    return best


def _pick(values: np.ndarray, best: np.ndarray) -> pa.Array:
    return pa.array(values[best] if len(values) else np.zeros(len(best), np.int64), pa.int64(), mask=best < 0)


def _listed(ids: pa.Array, texts: pa.Array, least: int, times: int) -> dict:
    words, row = words_of(texts)
    n = len(texts)
    sizes = np.bincount(row, minlength=n)
    ends = np.cumsum(sizes)
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.empty(0, np.int64)
    start, end, period = find_runs(code, ends, least, times)
    kept = ~repeats(code, start, end, period)
    text = np.searchsorted(ends, start, "right")
    first = (ends - sizes)[text]
    many = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(start - first), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=n))]).astype(np.int32)
    return {"runs": pa.ListArray.from_arrays(pa.array(many), runs),
            "collapsed": pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(kept))), " ")}


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """id, ``runs`` (an array of start, length and period, by start and period)
    and ``collapsed`` (the kept words joined by one space) of every row."""
    return map_texts(docs, lambda ids, texts: _listed(ids, texts, least, times),
                     "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", id_col, text_col)


def run_digests(docs: DataFrame, plant: bool = True) -> DataFrame:
    """doc_id, n_runs, the greatest run's start, length, period and
    exponent_milli, runs_sha256 and collapsed_sha256 of every row; ``plant``
    repeats words first as :func:`planted` says."""
    return map_texts(docs, lambda ids, texts: _digests(ids, texts, plant),
                     "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
