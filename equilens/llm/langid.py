"""Language identification by segmentation-marginalised unigrams (operator 3).

A word (a run of letters, lower-cased, with a mark in front) can be cut into
pieces of a fixed public vocabulary in many ways.  Each language has a
probability per piece; a word's probability is the sum over all its
segmentations of the product of the pieces' probabilities, computed by the
forward algorithm over the word's positions.  A text's score is the sum of its
words' log probabilities and the language's log prior, and the languages'
posterior follows.  Single letters outside the vocabulary are one common piece.

Training is expectation-maximisation on the same lattice: forward and backward
sums give the expected count of every piece in a word.  The first pass over the
texts counts words per language (with a map-side sum per chunk) and keeps
expected counts under equal piece probabilities, further passes use each
language's own.  Words are distinct rows of a checkpointed table, so a pass
costs the vocabulary of the corpus, not its length.  Only the model, languages x
pieces, reaches the driver and the tasks.

The lattice is walked for many words at once: words of a chunk stand in a
matrix of letters, and for every start the pieces that fit are found letter by
letter in a sorted table of trie edges.  Pieces and words of any length take part
whole: the numbers of long words are scaled as they grow, a long word is walked by
itself, and its arcs are found anew on the way back instead of being kept.

A text that is null or has no letter is ``und`` with score 0; so is every text
if no language was learned.  Ties go to the first language by name.  Rows that
repeat an id are counted and scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, map_texts, rows_bounded

UNKNOWN_LANGUAGE = "und"
BOUNDARY = "▁"  # how the vocabulary marks the start of a word
ROUNDS = 2
SMOOTHING = 0.1
# A word seen n times in a text counts n times; a posterior from thousands of
# words would be 0 or 1 exactly, so log odds are scaled to this many words.
EVIDENCE_WORDS = 20.0


@dataclass
class Pieces:
    """The vocabulary as a trie: sorted edges (node * letters + letter) and the
    node that each leads to; the piece that ends at a node, or -1."""

    letters: np.ndarray  # sorted code points that occur in pieces
    edges: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    n: int
    longest: int  # letters of the longest piece

    @classmethod
    def build(cls, pieces: list[str]) -> Pieces:
        letters = sorted({ord(c) for p in pieces for c in p})
        number = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other letter
        width = len(letters) + 1
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for k, p in enumerate(pieces):
            node = 0
            for c in p:
                node = nodes.setdefault((node, number[ord(c)]), len(nodes) + 1)
            ends[node] = k
        order = sorted(nodes)
        piece = np.full(len(nodes) + 1, -1, np.int64)
        piece[list(ends)] = list(ends.values())
        return cls(np.array(letters, np.int64), np.array([a * width + b for a, b in order], np.int64), np.array([nodes[x] for x in order], np.int64), piece, len(pieces), max(map(len, pieces), default=1))

    def matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter numbers of the words with the boundary in front (padded by -1), and their lengths."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        flat = np.frombuffer("".join([BOUNDARY + w for w in words]).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, flat), len(self.letters) - 1)
        code = np.where(self.letters[at] == flat, at + 1, 0)
        out = np.full((len(words), int(lengths.max())), -1, np.int64)
        out[np.repeat(np.arange(len(words)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = code
        return out, lengths

    def arcs(self, code: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, words, pieces) for all pieces that fit at ``start``.  A letter
        that is no piece by itself is piece ``n``, so all words have a segmentation."""
        width = len(self.letters) + 1
        rows = np.flatnonzero(code[:, start] >= 0)
        node = np.zeros(len(rows), np.int64)
        for length in range(1, min(self.longest, code.shape[1] - start) + 1):
            letter = code[rows, start + length - 1]
            key = node * width + letter
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            found = (letter > 0) & (self.edges[at] == key) if len(self.edges) else np.zeros(len(rows), bool)
            if length == 1:
                single = np.where(found, self.piece[self.target[at]], -1) if len(self.edges) else np.full(len(rows), -1)
                yield 1, rows, np.where(single < 0, self.n, single)
            rows, node = rows[found], self.target[at[found]]
            if not len(rows):
                break
            if length > 1:
                ends = self.piece[node] >= 0
                if ends.any():
                    yield length, rows[ends], self.piece[node[ends]]


# Letters after which the forward numbers are brought near 1 again.
SCALE_EVERY = 8


def _forward(pieces: Pieces, code: np.ndarray, prob: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """alpha[place, word, column], divided at every scaling place by its value there,
    and those values.  alpha[j] lacks the factors of all scaling places up to j.
    The arcs of every start are put into ``kept``."""
    n, width = code.shape
    alpha, scales = np.zeros((width + 1, n, prob.shape[1])), {}
    alpha[0] = 1
    for start in range(width):
        if start and start % SCALE_EVERY == 0:  # alpha[start] is complete
            top = alpha[start].copy()
            top[top == 0] = 1  # words that have ended
            alpha[start:start + pieces.longest] /= top
            scales[start] = top
        arcs = pieces.arcs(code, start)
        if kept is not None:
            arcs = list(arcs)
            kept.append(arcs)
        for length, rows, piece in arcs:
            alpha[start + length, rows] += alpha[start, rows] * prob[piece]
    return alpha, scales


def forward(pieces: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """log P(word | language) for every word and column of ``prob`` (pieces + 1 rows)."""
    code, lengths = pieces.matrix(words)
    alpha, scales = _forward(pieces, code, prob)
    log = sum((np.log(top) for top in scales.values()), np.zeros(alpha.shape[1:]))
    return log + np.log(np.maximum(alpha[lengths, np.arange(len(words))], 1e-300))


def expected(pieces: Pieces, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected count of each piece in the words, each word counted ``weight`` times.

    beta[j] is the probability of the rest after place j, divided by that of the
    word and times the forward factors up to j, so neither grows nor vanishes with
    the word's length; the factors between an arc's ends divide its weight."""
    code, lengths = pieces.matrix(words)
    n, width = code.shape
    kept: list | None = [] if code.size <= CELLS else None  # a longer word's arcs are found again
    alpha, scales = _forward(pieces, code, prob[:, None], kept)
    alpha, beta = alpha[:, :, 0], np.zeros((width + 1, n))
    final = alpha[lengths, np.arange(n)]
    beta[lengths, np.arange(n)] = np.where(final > 0, 1 / np.where(final > 0, final, 1), 0)
    out, used, held = np.zeros(pieces.n + 1), [], 0
    for start in reversed(range(width)):
        for length, rows, piece in pieces.arcs(code, start) if kept is None else kept[start]:
            rest = beta[start + length, rows] * prob[piece]
            for place in range(start - start % SCALE_EVERY + SCALE_EVERY, start + length + 1, SCALE_EVERY):
                if place in scales:
                    rest = rest / scales[place][rows, 0]
            beta[start, rows] += rest
            used.append((piece, alpha[start, rows] * rest * weight[rows]))
            held += len(piece)
        if held > CELLS or not start:
            out += np.bincount(np.concatenate([k for k, _ in used]), np.concatenate([c for _, c in used]), pieces.n + 1)
            used, held = [], 0
    return out


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Whole words of letters in lower case, and the row of each."""
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " "))
    words, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(words, "")
    return words.filter(real), row[real.to_numpy(zero_copy_only=False)]


@dataclass
class Model:
    pieces: Pieces
    languages: list[str]
    prob: np.ndarray  # pieces + 1 rows, a column per language
    prior: np.ndarray
    known: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (texts x languages) and numbers of words."""
        words, row = letter_words(texts)
        out, n = np.zeros((len(texts), len(self.languages))), np.bincount(row, minlength=len(texts))
        if len(words):
            coded = words.dictionary_encode()
            log = np.concatenate([forward(self.pieces, part, self.prob) for part in _by_length(coded.dictionary)])
            order = np.concatenate(_length_order(coded.dictionary))
            table = np.empty_like(log)
            table[order] = log
            each = table[coded.indices.to_numpy()]
            for k in range(out.shape[1]):
                out[:, k] = np.bincount(row, each[:, k], len(texts))
        return out, n


# Words, and places of them, whose lattices are walked together; words of like
# length, so that little is padding.  A longer word is walked alone.
TOGETHER = 16_384
CELLS = 400_000


def groups(lengths: np.ndarray) -> list[np.ndarray]:
    """The words by length, in parts that are walked together."""
    order, out, at = np.argsort(lengths, kind="stable"), [], 0
    while at < len(order):
        to = min(at + TOGETHER, len(order))
        while to - at > 1 and (to - at) * (lengths[order[to - 1]] + 1) > CELLS:
            to = at + max(1, min((to - at) // 2, int(CELLS // (lengths[order[at]] + 1))))
        out.append(order[at:to])
        at = to
    return out


def _length_order(words: pa.Array) -> list[np.ndarray]:
    return groups(pc.utf8_length(words).to_numpy())


def _by_length(words: pa.Array) -> Iterator[list[str]]:
    for part in _length_order(words):
        yield words.take(pa.array(part)).to_pylist()


def word_counts(train: DataFrame, text_col: str, label: str) -> DataFrame:
    """(lang, word, n) over all training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, lang in chunks(batches):
            words, row = letter_words(texts)
            if len(words):
                table = pa.table({"lang": lang.take(pa.array(row)), "word": words}).group_by(["lang", "word"]).aggregate([([], "count_all")])
                yield from table.rename_columns(["lang", "word", "n"]).to_batches()

    rows = rows_bounded(train.select(F.col(text_col).cast("string").alias("_text"), F.col(label).cast("string").alias("lang")))
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: list[str], text_col: str = "text", label: str = "lang", rounds: int = ROUNDS) -> Model:
    """The model of the languages in ``docs`` (rows without a language say nothing)."""
    pieces = Pieces.build(sorted({p for p in vocabulary if p and all(c == BOUNDARY or c.isalpha() for c in p) and p == p.lower() and BOUNDARY not in p[1:]}))
    train = docs.where(F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(F.col(label).cast("string")).count().collect()}
    languages = sorted(sizes)
    prior = np.log(np.array([sizes[x] for x in languages], float) / max(1, sum(sizes.values()))) if languages else np.zeros(0)
    prob = np.full((pieces.n + 1, len(languages)), 1.0 / (pieces.n + 1))
    if not languages:
        return Model(pieces, languages, prob, prior)
    words = cut(word_counts(train, text_col, label))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((pieces, languages, prob))

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            pieces, languages, prob = shared.value
            sums: dict[str, np.ndarray] = {}
            for pdf in batches:
                for lang, part in pdf.groupby("lang"):
                    column = np.ascontiguousarray(prob[:, languages.index(lang)])
                    for at in groups(part["word"].str.len().to_numpy()):
                        some = part.iloc[at]
                        sums[lang] = sums.get(lang, 0) + expected(pieces, some["word"].tolist(), some["n"].to_numpy(float), column)
            for lang, c in sums.items():
                used = np.flatnonzero(c)
                yield pd.DataFrame({"lang": lang, "piece": used, "c": c[used]})

        counts = words.mapInPandas(count, "lang string, piece long, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toPandas()
        prob = np.full((pieces.n + 1, len(languages)), SMOOTHING)
        prob[counts["piece"], [languages.index(x) for x in counts["lang"]]] += counts["c"]
        prob /= prob.sum(axis=0)
        shared.unpersist()
    return Model(pieces, languages, prob, prior)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language and its posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(_, texts: pa.Array) -> dict:
        m = shared.value
        log, n = m.scores(texts)
        if not m.languages:
            return {"lang_pred": [UNKNOWN_LANGUAGE] * len(texts), "score": np.zeros(len(texts))}
        best = (log + m.prior).argmax(axis=1)
        soft = log * np.minimum(1.0, EVIDENCE_WORDS / np.maximum(n, 1))[:, None] + m.prior
        soft = np.exp(soft - soft.max(axis=1, keepdims=True))
        score = soft[np.arange(len(texts)), best] / soft.sum(axis=1)
        names = [m.languages[b] if k else UNKNOWN_LANGUAGE for b, k in zip(best, n)]
        return {"lang_pred": names, "score": np.where(n > 0, score, 0.0)}

    return map_texts(docs, run, "lang_pred string, score double", id_col, text_col)
