"""Byte-level BPE by prefix dynamic programming (operator 4).

A text is split by the public pattern; each piece is encoded on its own.  For
every prefix of a piece's bytes exactly one last token is valid: the token t
whose predecessor (the last token of the prefix without t) and t, put side by
side, would be left apart by the merges.  :class:`Prefixes` stores that token
for each prefix, so the ids are read off backwards, more bytes are appended
exactly, and an edit re-encodes only until the stored tokens agree again.

Whether two tokens stay apart is decided from how each was merged: the pieces
that touch the border, from the last merge back to the first, must not be
joined by a merge that comes before the one that swallows them.

Null texts count as empty: no ids, empty bytes.  Long pieces cost their length
times the longest token.  Rows repeat as they come; other columns do not
matter, as only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, rows_bounded

# Answers about pairs of tokens that a worker keeps; bytes of strings (and of
# pieces) with their ids that it keeps, before what the last texts did not use goes.
CACHED = 120_000
STORED = 24 << 20
# Pieces encoded together; bytes above which a piece is encoded by itself.
BATCH = 20_000
LONG = 256
# White space before a space: such a text is not cut at every space.
_UNSAFE = re.compile(r"\s ")
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")


class Vocabulary:
    """Ranks (bytes -> id) with the merge that makes each token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.longest = max(map(len, ranks))
        self.text = {i: b for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[bytes, int] = {}  # tokens that the merges reach
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.made[token] = rank
                continue
            pieces = self._merged(token, rank)
            if len(pieces) == 2:
                self.parts[rank] = ranks[pieces[0]], ranks[pieces[1]]
                self.made[token] = rank
        # Every end of a reachable token: the token that it is, or -1.
        self.ends = {t[i:]: -1 for t in self.made for i in range(len(t))} | self.made

    def _merged(self, data: bytes, below: int) -> list[bytes]:
        """``data`` after all merges of a rank under ``below``, lowest first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def borders(self, token: int, side: int) -> list[int]:
        """The token and the parts of it that touch its left (0) or right (1) end."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out


def load(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


class Encoder:
    """Encodes with one vocabulary; the caches live as long as it does."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.ranks, self.ends, self.longest = v.ranks, v.ends, v.longest
        self.pieces = regex.compile(v.pattern)
        self.apart: dict[int, bool] = {}
        self.asked, self.answers = np.zeros(0, np.int64), np.zeros(0, bool)  # the same for whole columns
        # The ends of tokens as a trie read backwards: sorted edges, where each leads, the token of a node.
        node = {b"": 0} | {e: k + 1 for k, e in enumerate(sorted(v.ends, key=len))}
        edges = sorted((node[e[1:]] << 8 | e[0], node[e]) for e in v.ends)
        self.edges, self.target = (np.array(x, np.int64) for x in zip(*edges))
        self.token = np.full(len(node), -1, np.int64)
        for e, t in v.ends.items():
            self.token[node[e]] = t
        self.size = np.zeros(max(v.text) + 1, np.int64)
        for t, b in v.text.items():
            self.size[t] = len(b)
        self.left: dict[int, list[int]] = {}
        self.right: dict[int, list[int]] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Do the merges of a's bytes followed by b's end in just a, b?"""
        key = a << 32 | b
        hit = self.apart.get(key)
        if hit is None:
            if len(self.apart) > CACHED:
                self.apart.clear()
            hit = self.apart[key] = self._stays_apart(a, b)
        return hit

    def _stays_apart(self, a: int, b: int) -> bool:
        v = self.vocabulary
        if a not in self.right:
            self.right[a] = v.borders(a, 1)
        if b not in self.left:
            self.left[b] = v.borders(b, 0)
        xs, ys = self.right[a], self.left[b]
        text, ranks = v.text, v.ranks
        i = j = 0
        # Rank of the merge that next swallows the piece at the border; at equal
        # ranks the merge further left comes first.
        until = (float("inf"), 0)
        while True:
            joint = ranks.get(text[xs[i]] + text[ys[j]])
            if joint is not None and (joint, 1) < until:
                return False
            more_x, more_y = i + 1 < len(xs), j + 1 < len(ys)
            if not (more_x or more_y):
                return True
            # Undo the later of the two last merges; single bytes were never merged.
            if more_x and (not more_y or xs[i] > ys[j]):
                until = (xs[i], 0)
                i += 1
            else:
                until = (ys[j], 2)
                j += 1

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        rank = self.ranks.get(data)
        return [rank] if rank is not None else Prefixes(self, data).ids()

    def apart_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.asked, key), max(0, len(self.asked) - 1))
        new = np.unique(key[self.asked[at] != key] if len(self.asked) else key)
        if len(new):
            found = np.array([self._stays_apart(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            if len(self.asked) > 16 * CACHED:
                self.asked, self.answers = np.zeros(0, np.int64), np.zeros(0, bool)
                return self.apart_many(a, b)
            put = np.searchsorted(self.asked, new)
            self.asked, self.answers = np.insert(self.asked, put, new), np.insert(self.answers, put, found)
            at = np.searchsorted(self.asked, key)
        return self.answers[at]

    def pieces_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`piece` for many pieces at once: all ids in order, and how many each
        piece has.  Whole tokens are looked up; the others are encoded together,
        long ones each by itself, byte after byte."""
        ids = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        many, made = np.ones(len(pieces), np.int64), {}
        rest = np.flatnonzero(ids < 0).tolist()
        short = [k for k in rest if len(pieces[k]) <= LONG]
        for a in range(0, len(short), BATCH):
            some = short[a:a + BATCH]
            found, many[some] = self._together([pieces[k] for k in some])
            made.update(zip(some, np.split(found, np.cumsum(many[some])[:-1])))
        for k in rest:
            if k not in made:
                made[k] = np.array(self.piece(pieces[k]), np.int64)
                many[k] = len(made[k])
        out, ends = np.repeat(ids, many).astype(np.int32), np.cumsum(many)
        for k, x in made.items():
            out[ends[k] - many[k]:ends[k]] = x
        return out, many

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The last tokens of all first bytes are found at once, then those of all
        second bytes, and so on."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        end = np.cumsum(length)
        depth = np.arange(len(data)) - np.repeat(end - length, length)  # place of a byte in its piece
        # Tokens that end at each byte, longest first.
        at, node, fits = np.arange(len(data)), np.zeros(len(data), np.int64), []
        for n in range(1, self.longest + 1):
            inside = depth[at] >= n - 1
            at, node = at[inside], node[inside]
            key = node << 8 | data[at - (n - 1)]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            known = self.edges[edge] == key
            at, node = at[known], self.target[edge[known]]
            if not len(at):
                break
            t = self.token[node]
            fits.append((at[t >= 0], t[t >= 0]))
        byte = np.concatenate([f[0] for f in reversed(fits)])
        fit = np.concatenate([f[1] for f in reversed(fits)])[np.argsort(byte, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(byte, minlength=len(data)))])
        last = np.zeros(len(data), np.int64)
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        for d in range(len(edges) - 1):
            todo, k = order[edges[d]:edges[d + 1]], 0
            while len(todo):
                t = fit[first[todo] + k]
                before = todo - self.size[t]
                ok = self.size[t] == d + 1
                ask = np.flatnonzero(~ok)
                ok[ask] = self.apart_many(last[before[ask]], t[ask])
                last[todo[ok]] = t[ok]
                todo, k = todo[~ok], k + 1
        row, at, steps = np.arange(len(pieces)), end - 1, []
        while len(row):  # from the ends of the pieces backwards
            t = last[at]
            steps.append((row, t))
            at = at - self.size[t]
            more = at >= (end - length)[row]
            row, at = row[more], at[more]
        rows, ids = (np.concatenate(x) for x in zip(*reversed(steps)))
        return ids[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(pieces))

    def text(self, s: str) -> list[int]:
        """Ids of a whole text."""
        return [i for p in self.pieces.findall(s) for i in self.piece(p.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.text.__getitem__, ids))


class Prefixes:
    """The last token of every prefix of one piece's bytes."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def _extend(self, end: int) -> None:
        """Stores the last token of the prefix of ``end`` bytes."""
        data, last, ends, apart = self.data, self.last, self.encoder.ends, self.encoder.apart
        fits = []
        for start in range(end - 1, -1, -1):
            t = ends.get(data[start:end])
            if t is None:
                break
            if t >= 0:
                fits.append((start, t))
        for start, t in reversed(fits):  # longest first: it is often the one
            if not start:
                last.append(t)
                return
            ok = apart.get(last[start] << 32 | t)
            if ok or ok is None and self.encoder.stays_apart(last[start], t):
                last.append(t)
                return
        raise ValueError(f"no token ends at byte {end}")

    def append(self, more: bytes) -> None:
        """Exactly as if the piece had been encoded with ``more`` at its end."""
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self._extend(end)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes start..end; returns the number of prefixes that were
        encoded again.  A last token depends on the bytes and last tokens of the
        ``longest`` positions before it, so once that many agree, all do."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start + 1]
        agree = done = 0
        while len(self.last) <= len(self.data):
            at = len(self.last)
            self._extend(at)
            done += 1
            agree = agree + 1 if at >= start + len(new) and self.last[at] == old[at - shift] else 0
            if agree >= self.encoder.longest:
                self.last += old[at + 1 - shift:]
                break
        return done

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.encoder.vocabulary.text[self.last[at]])
        return out[::-1]


def strings(s: str) -> list[str]:
    """The text cut before spaces where no piece of the pattern can reach over
    the cut: those that follow something that is not white space."""
    return _SAFE_CUT.split(s) if _UNSAFE.search(s) else [p if not k else " " + p for k, p in enumerate(s.split(" "))]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All :func:`strings` of the texts, how many each text has, and the order
    of the texts in both (those without white space before a space come first)."""
    unsafe = np.array([bool(_UNSAFE.search(t)) for t in texts.to_pylist()], bool)
    safe = texts.filter(pa.array(~unsafe))
    parts = pc.split_pattern(safe, " ")
    flat, many = parts.flatten(), np.diff(parts.offsets.to_numpy())
    first = np.zeros(len(flat), bool)
    first[np.cumsum(many) - many] = True
    flat = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(" ", flat, ""))
    lists = [strings(t) for t in texts.filter(pa.array(unsafe)).to_pylist()]
    if lists:
        flat = pa.concat_arrays([flat, pa.array([x for l in lists for x in l], pa.string())])
        many = np.concatenate([many, [len(l) for l in lists]])
    return flat, many.astype(np.int64), np.argsort(unsafe, kind="stable")


def _lists(ids: np.ndarray, many: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(ids, pa.int32()))


class Store:
    """Strings and their ids as two Arrow columns, a few bytes a string."""

    def __init__(self):
        self.keys, self.ids = pa.array([], pa.string()), _lists(np.zeros(0, np.int32), np.zeros(0, np.int64))

    def ids_of(self, keys: pa.Array, make) -> pa.ListArray:
        """The ids of different ``keys``; ``make(list of strings)`` gives those of unknown ones.
        A store over its size keeps what was asked for last."""
        at = pc.index_in(keys, value_set=self.keys)
        unknown = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, -1).to_numpy().copy()
        if unknown.any():
            if self.keys.nbytes + self.ids.nbytes > STORED:
                old = pa.array(at[~unknown])
                self.keys, self.ids = self.keys.take(old), self.ids.take(old)
                at[~unknown] = np.arange(len(old))
            new = keys.filter(pa.array(unknown))
            at[unknown] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, new])
            self.ids = pa.concat_arrays([self.ids, make(new.to_pylist())])
        return self.ids.take(pa.array(at))


class Texts:
    """Encodes many texts at once: different strings between safe cuts, and of
    these different pieces, are encoded once and kept for the next texts."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.strings, self.pieces = encoder, Store(), Store()
        text = encoder.vocabulary.text
        self.shown = pa.array([str(i).encode() for i in range(max(text) + 1)], pa.binary())
        self.bytes = pa.array([text.get(i, b"") for i in range(max(text) + 1)], pa.binary())

    def ids(self, texts: pa.Array) -> pa.ListArray:
        """The ids of every text (no null)."""
        flat, many, order = cut(texts)
        lists = self._expand(flat, self.strings, self._strings)
        ends = np.concatenate([[0], np.cumsum(many)])
        whole = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[ends]), lists.values)
        return whole if (order[1:] > order[:-1]).all() else whole.take(pa.array(np.argsort(order)))

    def _expand(self, flat: pa.Array, store: Store, make) -> pa.ListArray:
        """The ids of every string of ``flat``, whose different ones are looked up."""
        coded = flat.dictionary_encode()
        lists = store.ids_of(coded.dictionary, make).take(coded.indices)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int32)), lists.flatten())

    def _strings(self, new: list[str]) -> pa.ListArray:
        found = list(map(self.encoder.pieces.findall, new))
        lists = self._expand(pa.array([p for ps in found for p in ps], pa.string()), self.pieces, self._pieces)
        ends = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[ends]), lists.values)

    def _pieces(self, new: list[str]) -> pa.ListArray:
        return _lists(*self.encoder.pieces_many([p.encode() for p in new]))

    def digests(self, texts: pa.Array) -> dict:
        """For each text the number of ids, SHA-256 of the joined ids, SHA-256 of the decoded bytes."""
        ids = self.ids(texts)
        flat, offsets = ids.flatten(), pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int32))
        sha = lambda column, by: [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(pa.ListArray.from_arrays(offsets, column.take(flat)), by)]
        return {"n_tokens": pc.list_value_length(ids).cast(pa.int64()), "ids_sha256": pa.array(sha(self.shown, b",")), "decoded_sha256": pa.array(sha(self.bytes, b""))}


# Per worker process: tasks that follow each other share the stores.
_KEPT: dict[tuple, Encoder | Texts] = {}


def _kept(kind: type, key: tuple[str, str], shared):
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(shared.value)
    if kind is Encoder:
        return _KEPT[key]
    return _KEPT.setdefault((kind, *key), kind(_KEPT[key]))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path, pattern))

    def run(_, texts: pa.Array) -> dict:
        ids = _kept(Texts, (path, pattern), shared).ids(pc.fill_null(texts, ""))
        return {"n_tokens": pc.list_value_length(ids).cast(pa.int64()), "ids": ids}

    return map_texts(docs, run, "n_tokens long, ids array<int>", id_col, text_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data): the bytes that an array of ids stands for; null for a null array."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path, pattern))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder = _kept(Encoder, (path, pattern), shared)
            data = [None if x is None else encoder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["_id", "data"])

    rows = rows_bounded(encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")))
    return rows.mapInArrow(run, f"_id {kind}, data binary").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and
    its ids decoded again, in one pass; hashes as lowercase hex, of the decimal
    ids joined by commas and of the decoded bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path, pattern))

    def run(_, texts: pa.Array) -> dict:
        return _kept(Texts, (path, pattern), shared).digests(pc.fill_null(texts, ""))

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)
