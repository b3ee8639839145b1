"""Quality classifier: a generalised additive model with pairwise interactions
(operator 9).

Each text is measured once (:mod:`text_stats`: ratios, no vocabulary), each
measure falls into one of a few bins, and the model is a table per feature and
per chosen pair of features whose entries add up to the log odds.  Fitting goes
round the features again and again: a shallow tree over the bins of one feature
is fitted to the gradient of the log loss and a small step of it is added to
that feature's table.  Then pairs are ranked by what a four-leaf tree on both
could still gain, and the best get tables in the same way.  Scoring is bin
look-ups and additions over whole columns.

The fit uses a bounded sample of labelled rows, at most ``MAX_FIT_ROWS``, those
with the least hash of their id: 14 numbers each, about 6 MB on the driver.  All
else covers every row.  A null or empty text has 0 for every measure and is
scored like any other; rows that repeat an id are scored each; with no or one
class among the labels the score is the share of label 1 (0.5 if none).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_stats
from .common import cut, map_texts

MAX_FIT_ROWS = 50_000
BINS = 32
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.15
LEAVES = 4
L2 = 1.0
SEED = 42

FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "bars", "shouts", "upper", "digits", "stops", "commas", "distinct", "short", "per_line", "log_words")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, values): the measures of every text, as an array in the order of FEATURES."""
    def run(_, texts: pa.Array) -> dict:
        ratios = text_stats.shape(texts, text_stats.counts(texts))
        values = np.stack([np.asarray(ratios[f], float) for f in FEATURES], axis=1)
        return {"values": pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))}

    return map_texts(docs, run, "values array<double>", id_col, text_col)


def tree(grad: np.ndarray, hess: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Value of each ordered bin in a tree grown best split first."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + L2)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (a, b) in enumerate(parts):
            m = np.arange(a + 1, b)
            if len(m):
                more = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(more.argmax())
                best = max(best, (float(more[k]), p, int(m[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + L2)
    return out


def tree2(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """The same for a table of two features: one split of the rows, then one of
    the columns on either side; with its gain."""
    g, h = np.cumsum(grad, axis=0), np.cumsum(hess, axis=0)
    gc, hc = np.cumsum(g, axis=1), np.cumsum(h, axis=1)

    def halves(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best gain of a split of the columns for each run of rows summed up in g, h."""
        total = g[:, -1:] ** 2 / (h[:, -1:] + L2)
        score = g ** 2 / (h + L2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + L2)
        at = score[:, :-1].argmax(axis=1)
        return np.maximum(score[np.arange(len(g)), at], total[:, 0]), at

    above, cut_above = halves(gc[:-1], hc[:-1])
    below, cut_below = halves(gc[-1] - gc[:-1], hc[-1] - hc[:-1])
    r = int((above + below).argmax())
    out = np.zeros(grad.shape)
    for rows, c in ((slice(0, r + 1), cut_above[r] + 1), (slice(r + 1, None), cut_below[r] + 1)):
        for cols in (slice(0, c), slice(c, None)):
            out[rows, cols] = grad[rows, cols].sum() / (hess[rows, cols].sum() + L2)
    return out, float(above[r] + below[r] - gc[-1, -1] ** 2 / (hc[-1, -1] + L2))


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[b[:, i], b[:, j]]
        return out


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Gam:
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    # Edges lie half-way between values seen, so that a bin's ends are not values themselves.
    for k in range(x.shape[1]):
        seen = np.unique(x[:, k])
        at = np.unique(np.searchsorted(seen, np.quantile(x[:, k], q)))
        at = at[at < len(seen) - 1]
        model.edges.append((seen[at] + seen[at + 1]) / 2)
    b = model.bins(x)
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in size]
    logit = np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            g, h = slope()
            step = RATE * tree(np.bincount(b[:, k], g, size[k]), np.bincount(b[:, k], h, size[k]))
            model.tables[k] += step
            logit += step[b[:, k]]
    g, h = slope()
    cell = lambda i, j: b[:, i] * size[j] + b[:, j]
    grid = lambda i, j, w: np.bincount(cell(i, j), w, size[i] * size[j]).reshape(size[i], size[j])
    wide = [(i, j) for i, j in combinations(range(x.shape[1]), 2) if min(size[i], size[j]) > 1]
    model.pairs = sorted(wide, key=lambda p: -tree2(grid(*p, g), grid(*p, h))[1])[:PAIRS]
    model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slope()
            step = RATE * tree2(grid(i, j, g), grid(i, j, h))[0]
            model.pair_tables[k] += step
            logit += step.ravel()[cell(i, j)]
    return model


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_id: str = "doc_id", label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> Gam:
    """The model of the labelled rows of ``measured`` (at most ``max_rows``)."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col(label_id).alias("_l"), (F.col(label) > 0).cast("double").alias("_y"))
    seen = measured.join(marked, F.col(id_col) == F.col("_l")).select("values", "_y", F.xxhash64("_l", F.lit(SEED)).alias("_h"), "_l")
    rows = seen.orderBy("_h", "_l").limit(max_rows).select("values", "_y").collect()
    return fit_arrays(np.array([r[0] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows]))


def score(measured: DataFrame, model: Gam, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every measured row."""
    kind = measured.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-model.log_odds(x))))], ["_id", "score"])

    return measured.select(F.col(id_col).alias("_id"), "values").mapInArrow(run, f"_id {kind}, score double").toDF(id_col, "score")


def classify(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document; the fit uses the labelled ids for which
    ``train`` (a Column over the id) holds."""
    measured = cut(measure(docs, id_col, text_col))
    return score(measured, fit(measured.where(train), labels, id_col), id_col)
