"""Tokenizer, stop words and n-grams as Column expressions.

Token = maximal run of at least two word characters of the lower-cased text
(the usual ``\\b\\w\\w+\\b`` token pattern).  Stop words are removed before
n-grams are formed, so a bigram may bridge a removed word.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, text_or_empty

TOKEN_RE = rf"[{WORD}]{{2,}}"
RUN_RE = rf"[{WORD}]+"
# The same, with the frequent characters tested before the classes.
_TOKEN_SCAN = rf"[a-z0-9_{WORD}][a-z0-9_{WORD}]+"
_RUN_SCAN = rf"[a-zA-Z0-9_{WORD}]+"


@functools.lru_cache(maxsize=None)
def english_stop_words() -> tuple[str, ...]:
    """Spark ML's English stop-word list, read from the installed Spark ML jar
    (no JVM needed).  Entries with an apostrophe are dropped: the tokenizer
    never emits one."""
    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    words: list[str] = []
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/english.txt"
            if name in z.namelist():
                words = z.read(name).decode("utf-8").split()
                break
    if not words:  # pragma: no cover - fall back to the JVM
        from pyspark.ml.feature import StopWordsRemover
        words = list(StopWordsRemover.loadDefaultStopWords("english"))
    seen, out = set(), []
    for w in words:
        if "'" in w or w in seen:
            continue
        seen.add(w)
        out.append(w)
    return tuple(out)


def tokenize(text: Column) -> Column:
    """array<string> of lower-cased word runs of length >= 2."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(_TOKEN_SCAN), 0)


def elements(array: Column) -> Column:
    """The same array as an expression, to be exploded.  Where a plain column is
    exploded the optimizer infers a filter on its size and pushes it below the
    projections that make the column, which are then evaluated once more for
    each place that names them; it does not for an expression."""
    return F.slice(array, 1, 2147483647)


def word_runs(text: Column) -> Column:
    """array<string> of case-preserving word runs of any length."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(_RUN_SCAN), 0)


def remove_stop_words(tokens: Column, stop_words) -> Column:
    stop = list(stop_words)
    if not stop:
        return tokens
    # ``isin`` with many literals becomes a hash-set lookup (InSet).
    return F.filter(tokens, lambda t: ~t.isin(stop))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs joined by a single space."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda x: x.isNotNull())


def ngram_terms(tokens: Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    lo, hi = ngram_range
    if (lo, hi) == (1, 1):
        return tokens
    if (lo, hi) == (2, 2):
        return bigrams(tokens)
    if (lo, hi) == (1, 2):
        return F.concat(tokens, bigrams(tokens))
    raise ValueError(f"unsupported ngram_range {ngram_range}")


def terms(text: Column, stop_words=None, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """Full term list of a text: tokenize, drop stop words, uni+bigrams."""
    sw = english_stop_words() if stop_words is None else stop_words
    return ngram_terms(remove_stop_words(tokenize(text), sw), ngram_range)


def add_terms(df, text_col: str = "text", out: str = "terms", stop_words=None,
              ngram_range: tuple[int, int] = (1, 2)):
    """DataFrame form of :func:`terms`.  Tokens are materialized in their own
    projection first: n-grams reference the token array several times, and a
    non-trivial expression referenced more than once is not inlined by the
    optimizer, so the regex tokenizer runs once per row."""
    sw = english_stop_words() if stop_words is None else stop_words
    tmp = f"_{out}_tokens"
    df = df.withColumn(tmp, remove_stop_words(tokenize(F.col(text_col)), sw))
    return df.withColumn(out, ngram_terms(F.col(tmp), ngram_range)).drop(tmp)
