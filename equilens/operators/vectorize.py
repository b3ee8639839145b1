"""TF-IDF over uni- and bigrams.

Plan shape, chosen for scale:

* Tokenizing, stop-word removal and n-grams are row-local array expressions.
* The vocabulary fit is a pass of bounded word summaries, which name the words
  that may be frequent enough, and one that counts these words and their bigrams
  as numbers, occurrences (``cf``) and documents (``df``) together.  A task
  shuffles one row for each term it has seen, so a term that occurs in a third
  of all documents costs one row per partition.  The top ``max_features`` by ``(cf desc, term asc)`` is a
  TakeOrderedAndProject; only that bounded list reaches the driver.
* Per-document vectors never shuffle: a row's words and bigrams are counted
  inside its Arrow batch by number (``add_entries``; ``counts``, by
  ``CountVectorizerModel``, for callers who want a vector).
* Weights are sparse: ``array<struct<i, x>>``, one entry for each term that the
  document has, by term number.  Sublinear tf, idf, the L2 norm and dot products
  go over those entries and look the term's constants up in a literal array.
  ``weights`` and ``weighted_docs`` give the dense array for callers who want it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import fixed
from ..functions.tokens import add_terms, elements, english_stop_words, remove_stop_words, tokenize
from ..session import materialize, ship_package

QUERY_ID = -1


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vectorizer: terms in feature (alphabetical) order with their
    corpus statistics.  Size is bounded by ``max_features``."""

    terms: tuple[str, ...]
    cf: tuple[int, ...]
    df: tuple[int, ...]
    n_docs: int
    stop_words: tuple[str, ...] = field(default_factory=english_stop_words)
    ngram_range: tuple[int, int] = (1, 2)

    @property
    def size(self) -> int:
        return len(self.terms)

    @property
    def idf(self) -> tuple[float, ...]:
        n = self.n_docs
        return tuple(math.log((1.0 + n) / (1.0 + d)) + 1.0 for d in self.df)

    def index(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms)}

    # -- row-local transforms ------------------------------------------------
    def add_terms(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        return add_terms(df, text_col, out, self.stop_words, self.ngram_range)

    def counts(self, df: DataFrame, terms_col: str, out: str = "tf_vec") -> DataFrame:
        """Sparse term-count vector over the vocabulary; out-of-vocabulary
        terms are dropped."""
        model = CountVectorizerModel.from_vocabulary(list(self.terms), inputCol=terms_col, outputCol=out)
        return model.transform(df)

    def weights(self, df: DataFrame, terms_col: str = "terms", out: str = "w",
                keep_counts: bool = False) -> DataFrame:
        """Add ``out``: array<double> of L2-normalized sublinear tf-idf weights
        (zero vector stays zero)."""
        v = self.weights_from_counts(self.counts(df, terms_col, "_tf_vec"), "_tf_vec", out)
        return v if keep_counts else v.drop("_tf_vec")

    def weights_from_counts(self, df: DataFrame, counts_col: str, out: str = "w") -> DataFrame:
        """Weights from a stored sparse count vector (row-local)."""
        v = df.withColumn("_tf", vector_to_array(counts_col))
        idf = F.lit(list(self.idf))
        v = v.withColumn("_raw", F.zip_with("_tf", idf, lambda t, i: F.when(t > 0, (F.lit(1.0) + F.log(t)) * i)
                                             .otherwise(F.lit(0.0))))
        v = v.withColumn("_norm", F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda acc, x: acc + x * x)))
        # The norm enters through array_repeat so it is evaluated once per row,
        # never once per element.
        v = v.withColumn(out, F.zip_with("_raw", F.array_repeat("_norm", F.size("_raw")),
                                         lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
        return v.drop("_tf", "_raw", "_norm")

    def sparse_weights(self, df: DataFrame, counts_col: str, out: str = "sw") -> DataFrame:
        """Add ``out``: the (i, x) entries of a stored sparse count vector's
        L2-normalized weights, by i; none for a document without known terms."""
        counts = F.unwrap_udt(F.col(counts_col))
        return self._weighed(df, F.zip_with(counts["indices"], counts["values"], lambda i, tf: F.struct(i.alias("i"), tf.alias("tf"))), out)

    def _weighed(self, df: DataFrame, counts: Column, out: str) -> DataFrame:
        """``out`` from (i, tf) entries."""
        idf = F.lit(list(self.idf)) if self.terms else F.array().cast("array<double>")
        v = df.withColumn("_raw", F.transform(counts, lambda e: F.struct(e["i"].alias("i"), ((F.lit(1.0) + F.log(e["tf"])) * idf[e["i"]]).alias("x"))))
        v = v.withColumn("_norm", F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda acc, e: acc + e["x"] * e["x"])))
        # The norm enters through array_repeat: evaluated once per row.
        entries = F.zip_with("_raw", F.array_repeat("_norm", F.size("_raw")), lambda e, n: F.struct(e["i"].alias("i"), (e["x"] / n).alias("x")))
        return v.withColumn(out, entries).drop("_raw", "_norm")

    def table(self, spark: SparkSession) -> DataFrame:
        """(idx, term, cf, df, idf) as a DataFrame (bounded, broadcastable)."""
        rows = [(i, t, int(c), int(d), float(f))
                for i, (t, c, d, f) in enumerate(zip(self.terms, self.cf, self.df, self.idf))]
        schema = "idx int, term string, cf long, df long, idf double"
        return spark.createDataFrame(rows, schema)


    # -- counted in Arrow batches ---------------------------------------------
    def _numbered(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of the terms, the terms' keys over them (see :func:`_cells`)
        in ascending order, and the terms' numbers in that order."""
        parts = [t.split(" ") for t in self.terms]
        words = sorted({w for p in parts for w in p})
        at, n = {w: k for k, w in enumerate(words)}, len(words)
        key = np.array([at[p[0]] if len(p) == 1 else n + at[p[0]] * n + at[p[1]] for p in parts], np.int64)
        order = np.argsort(key)
        return pa.array(words, pa.string()), key[order], order.astype(np.int32)

    def add_entries(self, df: DataFrame, text_col: str, out: str = "sw") -> DataFrame:
        """``df`` with its text replaced by ``out``, the (i, x) entries of the text's
        weights: the same as :meth:`sparse_weights` of :meth:`counts`.  Only words of
        the vocabulary's terms become numbers, and no bigram is spelled out."""
        rest = [c for c in df.columns if c != text_col]
        if self.ngram_range != (1, 2):
            t = self.add_terms(df, text_col, "_terms").drop(text_col)
            return self.sparse_weights(self.counts(t, "_terms", "_tf_vec").drop("_terms"), "_tf_vec", out).drop("_tf_vec")
        words, keys, terms = self._numbered()

        def run(batches):
            for batch in (b.slice(k, TERM_ROWS) for b in batches for k in range(0, b.num_rows, TERM_ROWS)):
                row, key, tf, _ = _cells(batch.column(batch.num_columns - 1), words)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    known = keys[at] == key
                    row, term, tf = row[known], terms[at[known]], tf[known]
                else:
                    term = np.zeros(0, np.int32)
                order = np.lexsort((term, row))
                offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(term[order], pa.int32()), pa.array(tf[order].astype(np.float64))], ["i", "tf"])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pairs)], [*rest, "_tf"])

        ship_package(df.sparkSession)
        tokens = df.select(*rest, remove_stop_words(tokenize(F.col(text_col)), self.stop_words).alias("_words"))
        schema = StructType([*df.select(*rest).schema.fields, StructField("_tf", ArrayType(StructType([StructField("i", IntegerType()), StructField("tf", DoubleType())])))])
        return self._weighed(tokens.mapInArrow(run, schema), F.col("_tf"), out).drop("_tf")


# Counters of a task's word summary, and candidate words that a plan may name.
COUNTERS = 20_000
MAX_CANDIDATES = 10_000


def corpus_of(docs: DataFrame, query: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, part): the documents and the parts of the query document.
    All rows of ``query`` are one document, whose terms are counted part by part
    and added up; bigrams do not reach from one part into the next."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.lit(False).alias("part"))
    return d.unionByName(query.select("doc_id", "text", F.lit(True).alias("part")))


def term_stats(terms: DataFrame, terms_col: str = "terms") -> DataFrame:
    """(term, cf, df) of an array column beside ``part``, in one aggregation."""
    t, part = F.col(terms_col), F.col("part").cast("int")
    occurrences = F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d")))
    distinct = F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(0).alias("c"), F.lit(1).alias("d")))
    e = terms.select(part.alias("q"), F.explode(F.concat(occurrences, distinct)).alias("e"))
    return (e.groupBy(F.col("e.term").alias("term"))
            .agg(F.sum("e.c").cast("long").alias("cf"), (F.sum(F.col("e.d") * (1 - F.col("q"))) + F.max(F.col("e.d") * F.col("q"))).cast("long").alias("df")))


# Rows whose terms are counted together in a task; rows of a broadcast side.
TERM_ROWS = 512
MAX_BROADCAST = 1_000_000


# Different terms that a task of :func:`term_sums` holds.
HELD_TERMS = 1_000_000


def _cells(words, known: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, key, tf, names): how often every row of a list array has each word and
    each bigram of two neighbours, by row and key.  ``names`` are the words that
    count, ``known`` or else the batch's own; others are gaps that no bigram
    spans.  Of n names a word's key is its number, a bigram's is n + first * n + second."""
    coded = words.flatten().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if known is not None:
        number = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        names, code = known, number[code]
    n, row = len(names), np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    width, one = n + n * n, np.flatnonzero(code >= 0)
    two = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (row[:-1] == row[1:]))
    cell = np.sort(np.concatenate([row[one] * width + code[one], row[two] * width + n + code[two] * n + code[two + 1]]))
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    tf, cell = np.diff(first, append=len(cell)), cell[first]
    return cell // max(1, width), cell % max(1, width), tf, names


def _summed(parts: list) -> tuple[np.ndarray, ...]:
    """(key, cf, df) triples of arrays, added up by key."""
    key, cf, df = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return (key[first], np.add.reduceat(cf[order], first), np.add.reduceat(df[order], first)) if len(key) else (key, cf, df)


def term_sums(tokens: DataFrame, words: list[str] | None = None, held: int = HELD_TERMS) -> DataFrame:
    """(term, c, d): occurrences and rows of the words and bigrams of ``tokens``
    (terms), in parts that add up.  With ``words`` only these and the bigrams of
    two of them count, and a task adds up what it reads until it holds ``held``
    terms; otherwise the rows of a part of a batch are added up."""
    known = None if words is None else pa.array(sorted(words), pa.string())

    def spelled(key, cf, df, names):
        n = len(names)
        pair = key[key >= n] - n  # keys are in order, so bigrams come last
        terms = [names.take(pa.array(key[key < n]))]
        if len(pair):
            terms.append(pc.binary_join_element_wise(names.take(pa.array(pair // n)), names.take(pa.array(pair % n)), " "))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(terms), pa.array(cf.astype(np.int64)), pa.array(df.astype(np.int64))], ["term", "c", "d"])

    def run(batches):
        parts = []
        for batch in (b.slice(k, TERM_ROWS) for b in batches for k in range(0, b.num_rows, TERM_ROWS)):
            _, key, tf, names = _cells(batch.column("terms"), known)
            part = _summed([(key, tf, np.ones(len(key), np.int64))])
            if known is None:
                yield spelled(*part, names)
                continue
            parts.append(part)
            if sum(len(p[0]) for p in parts) > held:
                parts = [_summed(parts)]
                if 2 * len(parts[0][0]) > held:
                    yield spelled(*parts.pop(), known)
        if parts:
            yield spelled(*_summed(parts), known)

    ship_package(tokens.sparkSession)
    return tokens.select("terms").mapInArrow(run, "term string, c long, d long")


def row_terms(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf): the words and bigrams of every row of ``tokens``
    (doc_id, terms: its words), counted in the row."""
    def run(batches):
        for batch in (b.slice(k, TERM_ROWS) for b in batches for k in range(0, b.num_rows, TERM_ROWS)):
            words = batch.column("terms")
            flat = words.flatten().dictionary_encode()
            names, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n, row = len(names), np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            next_ = np.flatnonzero(row[:-1] == row[1:])
            # A word's key is its number; a bigram's comes after them, by both numbers.
            key, place = np.unique(np.concatenate([code, n + code[next_] * n + code[next_ + 1]]), return_inverse=True)
            cell, tf = np.unique(np.concatenate([row, row[next_]]) * len(key) + place, return_counts=True)
            pair = key[key >= n] - n
            terms = [names.take(pa.array(key[key < n]))]
            if n:
                terms.append(pc.binary_join_element_wise(names.take(pa.array(pair // n)), names.take(pa.array(pair % n)), " "))
            at = max(1, len(key))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cell // at)), pa.concat_arrays(terms).take(pa.array(cell % at)), pa.array(tf.astype(np.int64))], ["doc_id", "term", "tf"])

    ship_package(tokens.sparkSession)
    return tokens.mapInArrow(run, "doc_id long, term string, tf long")


def document_terms(corpus: DataFrame, stop_words=None) -> DataFrame:
    """(doc_id, term, tf) of the uni- and bigrams of every document.  A row's terms
    are counted in the row; only rows that share their id with others (the query
    document's parts) are added up by (doc_id, term)."""
    sw = tuple(english_stop_words() if stop_words is None else stop_words)
    ids = corpus.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    repeated = materialize(ids.select(F.col("doc_id").alias("_id")))
    if repeated.count() <= MAX_BROADCAST:
        repeated = F.broadcast(repeated)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    terms = lambda how: row_terms(corpus.join(repeated, same, how).select("doc_id", remove_stop_words(tokenize(F.col("text")), sw).alias("terms")))
    return terms("left_anti").unionByName(terms("left_semi").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")))


def word_summaries(tokens: DataFrame, terms_col: str = "terms", counters: int = COUNTERS) -> DataFrame:
    """(term, n) by Misra-Gries summaries of at most ``counters`` words a task,
    added up: ``n`` is never above a word's count.  The row whose term is null
    has in ``n`` by how much a count may at most be above (so much, too, a word
    without a row may have).  There are as many tasks as cores, so what is
    shuffled depends neither on the number of different words nor on the input."""
    def run(batches):
        held, lost = {}, 0
        for b in batches:
            counts = pc.value_counts(pc.list_flatten(b.column(0)).drop_null())
            for w, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()):
                held[w] = held.get(w, 0) + n
            if len(held) > counters:
                least = sorted(held.values(), reverse=True)[counters]
                held = {w: n - least for w, n in held.items() if n > least}
                lost += least
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), lost], pa.int64())], ["term", "n"])

    spark = tokens.sparkSession
    ship_package(spark)
    tasks = tokens.select(terms_col).coalesce(max(1, spark.sparkContext.defaultParallelism))
    return tasks.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def frequent_words(tokens: DataFrame, k: int, counters: int = COUNTERS, max_candidates: int = MAX_CANDIDATES) -> list[str] | None:
    """Words among which are all that are as frequent as the ``k``-th, or None
    where the summaries cannot tell or too many words come into question."""
    summary = materialize(word_summaries(tokens, counters=counters))
    lost = sum(r["n"] for r in summary.where(F.col("term").isNull()).collect())
    known = summary.where(F.col("term").isNotNull())
    top = known.orderBy(F.desc("n")).limit(k).collect()
    least = top[-1]["n"] if len(top) == k else 0
    if lost and least <= lost:
        return None
    words = [r["term"] for r in known.where(F.col("n") + lost >= least).limit(max_candidates + 1).collect()]
    return words if len(words) <= max_candidates else None


def top_terms(corpus: DataFrame, max_features: int = fixed.MAX_FEATURES, stop_words=None,
              ngram_range: tuple[int, int] = (1, 2), counters: int = COUNTERS, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(term, cf, df) of the ``max_features`` terms with the highest corpus
    frequency, ties by term.  A first pass finds the words that may be as
    frequent as the ``max_features``-th one (:func:`frequent_words`).  A bigram
    is never more frequent than either of its words, so a second pass counts
    only these words and the bigrams of two of them; other terms never leave the
    row.  Where the summaries do not separate the words, all terms are counted."""
    sw = tuple(english_stop_words() if stop_words is None else stop_words)
    best = lambda d, n: d.orderBy(F.desc("cf"), F.asc("term")).limit(n)
    if ngram_range != (1, 2):
        return best(term_stats(add_terms(corpus, "text", "terms", sw, ngram_range).select("terms", "part")), max_features)
    tokens = corpus.select("part", remove_stop_words(tokenize(F.col("text")), sw).alias("terms"))
    words = frequent_words(tokens, max_features, counters, max_candidates)
    docs = term_sums(tokens.where(~F.col("part")), words).withColumn("q", F.lit(0))
    query = term_sums(tokens.where("part"), words).withColumns({"d": F.lit(0).cast("long"), "q": F.lit(1)})
    sums = docs.unionByName(query).groupBy("term").agg(F.sum("c").alias("cf"), (F.sum("d") + F.max("q")).cast("long").alias("df"))
    return best(sums, max_features)


def fit_vocabulary(docs: DataFrame, query: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_features: int = fixed.MAX_FEATURES, stop_words=None, ngram_range: tuple[int, int] = (1, 2)) -> Vocabulary:
    """Fit on the documents and the query document, as the reference does."""
    sw = tuple(english_stop_words() if stop_words is None else stop_words)
    top = top_terms(corpus_of(docs, query, id_col, text_col), max_features, sw, ngram_range).collect()
    top = sorted(top, key=lambda r: r["term"])
    return Vocabulary(tuple(r["term"] for r in top), tuple(int(r["cf"]) for r in top),
                      tuple(int(r["df"]) for r in top), docs.count() + 1, sw, ngram_range)


def query_document(benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The benchmark texts as the parts of one query document (doc_id -1)."""
    return benchmark.select(F.lit(QUERY_ID).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def query_from_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(QUERY_ID, text)], "doc_id bigint, text string")


def query_vector(vocab: Vocabulary, query: DataFrame) -> tuple[float, ...]:
    """The query document's weights: its parts' counts of vocabulary terms added
    up (at most one row per term), then weighed like any document's."""
    if not vocab.terms:
        return ()
    t = vocab.add_terms(query.select("text"), "text", "terms").select(F.explode(elements(F.col("terms"))).alias("term"))
    tf = {r["term"]: r["count"] for r in t.where(F.col("term").isin(list(vocab.terms))).groupBy("term").count().collect()}
    raw = [(1.0 + math.log(tf[t])) * i if t in tf else 0.0 for t, i in zip(vocab.terms, vocab.idf)]
    norm = math.sqrt(sum(x * x for x in raw))
    return tuple(x / norm if norm else 0.0 for x in raw)


def fit_corpus(docs: DataFrame, query: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               max_features: int = fixed.MAX_FEATURES, stop_words=None):
    """Fit the vectorizer on documents plus the query document and return
    ``(vocabulary, query_weights)``; the query vector is bounded by
    ``max_features``."""
    vocab = fit_vocabulary(docs, query, id_col, text_col, max_features, stop_words)
    return vocab, query_vector(vocab, query)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def entries(df: DataFrame, w_col: str) -> Column:
    """The (i, x) entries of a weight column, which may be a dense array."""
    if df.schema[w_col].dataType.elementType.typeName() == "struct":
        return F.col(w_col)
    return F.filter(F.transform(w_col, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0)


def entries_dot(e: Column, weights) -> Column:
    """Dot product of (i, x) entries with a literal vector."""
    if not len(weights):
        return F.lit(0.0)
    w = F.lit([float(x) for x in weights])
    return F.aggregate(e, F.lit(0.0), lambda acc, t: acc + t["x"] * w[t["i"]])


def dense_row(values, size: int) -> list[float]:
    """Python-side dense vector of one row's entries (or of its dense array)."""
    out = [0.0] * size
    for k, e in enumerate(values):
        if isinstance(e, float):
            out[k] = e
        else:
            out[e["i"]] = e["x"]
    return out


def sparse_docs(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", keep: list[str] | None = None, out: str = "sw") -> DataFrame:
    """Like :func:`weighted_docs` with (i, x) entries."""
    kept = list(dict.fromkeys(keep or []))
    return vocab.add_entries(docs.select(*kept, F.col(text_col).alias("_text")), "_text", out)


def weighted_docs(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", keep: list[str] | None = None,
                  out: str = "w") -> DataFrame:
    """Documents with their weight array; ``keep`` columns are carried along
    (column pruning keeps the scan to those plus the text)."""
    cols = list(dict.fromkeys((keep or []) + [text_col]))
    t = vocab.add_terms(docs.select(*cols), text_col, "_terms")
    if text_col not in (keep or []):
        t = t.drop(text_col)
    return vocab.weights(t, "_terms", out).drop("_terms")


def vocabulary_frame(docs: DataFrame, query: DataFrame, max_features: int = fixed.MAX_FEATURES,
                     stop_words=None, decimals: int | None = None) -> DataFrame:
    """The fitted vocabulary as a DataFrame: (term, cf, df, idf) of the top
    ``max_features`` terms; the document count enters as a scalar subquery."""
    top = top_terms(corpus_of(docs, query), max_features, stop_words)
    n = docs.select((F.count(F.lit(1)) + 1).cast("double")).scalar()
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    if decimals is not None:
        idf = F.round(idf, decimals)
    return top.withColumn("idf", idf)


def explode_weights(weighted: DataFrame, vocab: Vocabulary, keys: list[str], w_col: str = "w",
                    nonzero: bool = True) -> DataFrame:
    """Long form (keys..., term, weight) of a weight column; entries are exploded as they are."""
    if weighted.schema[w_col].dataType.elementType.typeName() == "struct":
        terms = F.lit(list(vocab.terms)) if vocab.terms else F.array().cast("array<string>")
        return weighted.select(*keys, F.explode(elements(F.col(w_col))).alias("e")).select(*keys, terms[F.col("e.i")].alias("term"), F.col("e.x").alias("weight"))
    z = F.arrays_zip(F.col(w_col).alias("w"), F.lit(list(vocab.terms)).alias("t"))
    e = weighted.select(*keys, F.explode(z).alias("e")).select(*keys, F.col("e.t").alias("term"),
                                                                 F.col("e.w").alias("weight"))
    return e.where(F.col("weight") != 0) if nonzero else e
