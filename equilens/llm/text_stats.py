"""Per-text counts in vectorised passes over a chunk of texts (shared by the
quality rules and the quality classifier)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import codes_of, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def repeated_words(words: pa.Array, row: np.ndarray, n_rows: int, window: int = WINDOW) -> np.ndarray:
    """For each text, its words inside windows of ``window`` words (a power of
    two) that occur twice or more in it, the first occurrence included.  Exact:
    windows get numbers by doubling, two halves' numbers making the whole's, the
    row being part of the first."""
    covered = np.zeros(len(words), bool)
    if len(words) >= window:
        code = codes_of(words)
        ids, size, at = code + row * np.int64(code.max() + 1), 1, np.arange(len(words))
        ids = np.unique(ids, return_inverse=True)[1]
        while size < window:
            ids = ids[:-size] * np.int64(ids.max() + 1) + ids[size:]
            size *= 2
            # Only windows inside one text that may still be repeated go on.
            ids = np.unique(ids, return_inverse=True)[1]
        inside = row[: len(ids)] == row[window - 1:]
        many = np.bincount(ids[inside], minlength=ids.max() + 1) > 1
        starts = at[: len(ids)][inside & many[ids]]
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + window, -1)
        covered = np.cumsum(edges)[:-1] > 0
    return np.bincount(row[covered], minlength=n_rows)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """For each text, its lines (parted by \\n) with a word that equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    lines, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    real = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    row, n = row[real], len(texts)
    if not len(row):
        return np.zeros(n, np.int64)
    code = codes_of(lines.filter(pa.array(real)))
    first = np.unique(row * np.int64(code.max() + 1) + code, return_index=True)[1]
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text (a null text: zeros)."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    words, row = words_of(texts)
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": np.bincount(row, weights=number(pc.utf8_length(words)), minlength=n).astype(np.int64),
        "n_symbols": number(pc.count_substring_regex(texts, SYMBOLS)),
        "n_dup_lines": duplicate_lines(texts),
        "n_repeat_words": repeated_words(words, row, n),
    }


def shape(texts: pa.Array, base: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ratios of each text, in double; empty texts have 0 everywhere."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    found = lambda p: number(pc.count_substring_regex(texts, p))
    words, chars = np.maximum(base["n_words"], 1), np.maximum(base["word_chars"], 1)
    bare, row = words_of(pc.utf8_lower(texts))
    pair = row * np.int64(len(bare) + 1) + (codes_of(bare) if len(bare) else 0)
    distinct = np.bincount(np.unique(pair) // (len(bare) + 1), minlength=n) if len(bare) else np.zeros(n, np.int64)
    short = np.bincount(row[number(pc.utf8_length(bare)) <= 3], minlength=n) if len(bare) else np.zeros(n, np.int64)
    lines = number(pc.count_substring(texts, "\n")) + 1
    return {
        "mean_word": base["word_chars"] / words,
        "symbols": base["n_symbols"] / words,
        "dup_lines": base["n_dup_lines"] / lines,
        "repeats": base["n_repeat_words"] / words,
        "bars": found(r"\|") / words,
        "shouts": found(r"!") / words,
        "upper": found(r"\p{Lu}") / chars,
        "digits": found(r"[0-9]") / chars,
        "stops": found(r"[.!?]") / words,
        "commas": found(r",") / words,
        "distinct": distinct / words,
        "short": short / words,
        "per_line": np.log1p(base["n_words"] / lines),
        "log_words": np.log1p(base["n_words"]),
    }
