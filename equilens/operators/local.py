"""Local perturbation attribution.

For each document: features are its distinct case-sensitive word runs; 100
samples, sample 0 intact and sample s removing r_s (uniform in 1..W) words,
every occurrence; each perturbed text is re-vectorized with the fitted
vocabulary and scored; samples are weighted by a kernel of their cosine
distance to the intact text; a weighted ridge picks 10 words and a second
ridge gives their weights.

Randomness is a keyed hash, identical in every engine: word j gets
``a_j = H(seed|doc|word) mod P``, sample s gets ``b_s, c_s, r_s`` from
``H(seed|doc|sample|s)``; the words removed in sample s are the r_s smallest
by ``((a_j * b_s + c_s) mod P, word)``.

Spark prepares one compact row per document (its word runs); a batch of documents
then goes through one Arrow-batched function in which words and tokens are
numbered once, masks are one samples x words matrix, term counts its product
with an incidence of words and terms, and the ridges of a batch stacked solves.
No row per sample is made and nothing is shuffled.
:func:`samples` and :func:`removed_words` give the masks as Spark rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import text_or_empty
from ..functions.tokens import RUN_RE, english_stop_words, word_runs
from ..session import ship_package
from .vectorize import Vocabulary

P = 2147483647  # 2^31 - 1
# Samples x words (or tokens) that arrays hold at a time; documents solved together.
CELLS = 4_000_000
GROUP = 64


def _hex(h: Column, start: int) -> Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("long")


def compact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, runs): the word runs of every document that has some.  The
    filter looks for a first run; one on the array would make the array twice."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.where(text_or_empty(F.col("text")).rlike(RUN_RE)).withColumn("runs", word_runs(F.col("text")))


def word_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  seed: int = fixed.SEED) -> DataFrame:
    """L1: (id, text, words, W, a): sorted distinct word runs and their keyed
    multipliers.  Documents without words are dropped (nothing to explain)."""
    d = compact(docs, id_col, text_col)
    d = d.select("doc_id", "text", F.sort_array(F.array_distinct("runs")).alias("words"))
    sid = F.lit(str(seed))
    return d.withColumn("W", F.size("words")).withColumn("a", F.transform("words", lambda w: F.pmod(
        _hex(F.md5(F.concat_ws("|", sid, F.col("doc_id").cast("string"), w)), 1), F.lit(P))))


def samples(features: DataFrame, n_samples: int = fixed.PERTURB_SAMPLES, seed: int = fixed.SEED) -> DataFrame:
    """L2: one row per document, its samples as arrays r, b, c and kernel (so
    that its words are there once, not once a sample)."""
    def run(batches):
        for batch in batches:
            ids, sizes = batch.column("doc_id"), batch.column("W").to_pylist()
            numbers = [sample_numbers(i, w, n_samples, seed) for i, w in zip(ids.to_pylist(), sizes)]
            held = [np.concatenate([x[k] for x in numbers] or [np.zeros(0, np.int64)]) for k in range(3)]
            held.append(np.concatenate([kernel_weights(w, x[2]) for w, x in zip(sizes, numbers)] or [np.zeros(0)]))
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * n_samples, pa.int32()), pa.array(x)) for x in held]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("doc_id", "words", "W", "a")] + arrays, ["doc_id", "words", "W", "a", "b", "c", "r", "kernel"])

    kind = features.schema["doc_id"].dataType.simpleString()
    d = _in_python(features.select("doc_id", "words", "W", "a"))
    return d.mapInArrow(run, f"doc_id {kind}, words array<string>, W int, a array<bigint>, b array<bigint>, c array<bigint>, r array<bigint>, kernel array<double>")


def removed_words(sampled: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, W, s, r, kernel, removed) of every sample: its removed words in
    word order, or with ``digest`` as ``removed_md5`` the md5 of them, joined by
    spaces.  A document's samples are one mask matrix."""
    def said(batch, k):
        words, a, b, c, r = (batch.column(x)[k].values for x in ("words", "a", "b", "c", "r"))
        gone = ~kept_words(*(x.to_numpy(zero_copy_only=False) for x in (a, b, c, r)))
        if not digest:
            ends = np.concatenate([[0], np.cumsum(gone.sum(1))])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(np.nonzero(gone)[1])))
        raw = [w.encode() + b" " for w in words.to_pylist()]
        sizes, letters = np.array([len(w) for w in raw]), np.frombuffer(b"".join(raw), np.uint8)
        return pa.array([hashlib.md5(letters[np.repeat(g, sizes)].tobytes()[:-1]).hexdigest() for g in gone], pa.string())

    def run(batches):
        for batch in batches:
            n, first, cells, group = len(batch.column("b")[0]) if batch.num_rows else 0, 0, 0, []
            for k, w in enumerate(batch.column("W").to_pylist(), 1):
                group.append(said(batch, k - 1))
                cells += n * (16 if digest else w)
                if cells >= CELLS or k == batch.num_rows:
                    part = batch.slice(first, k - first)
                    again = pa.array(np.repeat(np.arange(k - first), n))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(again), part.column("W").take(again), pa.array(np.tile(np.arange(n), k - first), pa.int32()), part.column("r").flatten().cast(pa.int32()), part.column("kernel").flatten(), pa.concat_arrays(group)],
                                                     ["doc_id", "W", "s", "r", "kernel", last.split()[0]])
                    first, cells, group = k, 0, []

    kind, last = sampled.schema["doc_id"].dataType.simpleString(), "removed_md5 string" if digest else "removed array<string>"
    return _in_python(sampled).mapInArrow(run, f"doc_id {kind}, W int, s int, r int, kernel double, {last}")


@dataclass(frozen=True)
class Scorer:
    """A linear score of TF-IDF weights, or with an intercept the class-1
    probability of a logistic model."""

    index: dict[str, int]
    idf: np.ndarray
    coef: np.ndarray
    intercept: float | None
    pairs: tuple[tuple[str, str, int], ...] = ()
    stop_words: frozenset[str] = frozenset()

    @classmethod
    def of(cls, vocab: Vocabulary, coef, intercept: float | None) -> Scorer:
        pairs = tuple((*t.split(" "), k) for k, t in enumerate(vocab.terms) if " " in t)
        return cls(vocab.index(), np.array(vocab.idf), np.array(coef, float), intercept, pairs, frozenset(english_stop_words()))

    def scores(self, words_of_token: np.ndarray, tokens: list[str], kept: np.ndarray) -> np.ndarray:
        """Score of a text per row of ``kept`` (samples x words): the terms of the
        tokens whose words are kept, bigrams joining neighbours across those removed."""
        number = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
        return self.score_coded(words_of_token, np.array([number[t] for t in tokens], np.int64), self.coded(number), kept)

    def coded(self, number: dict[str, int]) -> Coded:
        """The vocabulary's terms that consist of the numbered tokens."""
        n, single = len(number), np.full(len(number), -1)
        for t, k in number.items():
            single[k] = self.index.get(t, -1)
        pairs = sorted((number[x] * n + number[y], k) for x, y, k in self.pairs if x in number and y in number)
        keys, terms = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return Coded(n, single, keys, terms)

    def score_coded(self, words_of_token: np.ndarray, seq: np.ndarray, coded: Coded, kept: np.ndarray) -> np.ndarray:
        """:meth:`scores` of numbered tokens.  Term counts are a samples x terms
        matrix.  Single terms: mask matrix times a word x term incidence.  Bigrams:
        each kept token links to the next kept one; of tokens that begin a known
        bigram the links are looked up."""
        here = np.zeros(coded.n, bool)
        here[seq] = True
        single = np.flatnonzero(here & (coded.single >= 0))
        possible = here[coded.keys // max(1, coded.n)] & here[coded.keys % max(1, coded.n)]
        keys, terms = coded.keys[possible], coded.terms[possible]
        known = np.concatenate([coded.single[single], terms])
        tf = np.zeros((len(kept), len(known)), np.float32)  # whole numbers below 2^24
        if len(single):
            column = np.full(coded.n, -1)
            column[single] = np.arange(len(single))
            at = np.flatnonzero(column[seq] >= 0)
            cells = np.bincount(words_of_token[at] * len(single) + column[seq[at]], minlength=kept.shape[1] * len(single))
            tf[:, :len(single)] = kept.astype(np.float32) @ cells.reshape(kept.shape[1], len(single)).astype(np.float32)
        if len(keys):
            self._add_bigrams(tf, kept, words_of_token, seq, coded.n, keys, len(single))
        w = np.where(tf > 0, (1.0 + np.log(np.maximum(tf, 1.0).astype(float))) * self.idf[known], 0.0)
        norm = np.sqrt((w * w).sum(1))
        out = (w @ self.coef[known]) / np.where(norm > 0, norm, 1.0)
        return out if self.intercept is None else 1.0 / (1.0 + np.exp(-(out + self.intercept)))

    def _add_bigrams(self, tf, kept, words_of_token, seq, n, keys, first_column):
        begins = np.flatnonzero(np.isin(seq, keys // n))  # tokens that begin a known bigram
        step = max(1, CELLS // max(1, len(seq)))
        places = np.arange(len(seq), dtype=np.int32)
        for a in range(0, len(kept), step):  # blocks of samples, so that long texts stay small
            here = kept[a:a + step][:, words_of_token]
            place = np.where(here, places, np.int32(len(seq)))
            link = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1]
            link = np.concatenate([link[:, 1:], np.full((len(here), 1), len(seq), np.int32)], 1)[:, begins]
            s, t = np.nonzero(here[:, begins] & (link < len(seq)))
            both = seq[begins[t]] * n + seq[link[s, t]]
            found = np.minimum(np.searchsorted(keys, both), len(keys) - 1)
            hit = keys[found] == both
            np.add.at(tf, (a + s[hit], first_column + found[hit]), np.float32(1.0))


@dataclass(frozen=True)
class Coded:
    """Numbered tokens: the term that each is (-1: none), and the bigrams of two
    of them as sorted ``first * n + second`` with their terms."""

    n: int
    single: np.ndarray
    keys: np.ndarray
    terms: np.ndarray


def _hashed(seed: int, doc_id: int | None, names: list[bytes]) -> list[bytes]:
    """md5 of ``seed|doc_id|name`` for every name (without a null id, as concat_ws)."""
    start = hashlib.md5(f"{seed}|".encode() if doc_id is None else f"{seed}|{doc_id}|".encode())
    out = []
    for name in names:
        h = start.copy()
        h.update(name)
        out.append(h.digest())
    return out


def word_multipliers(doc_id: int | None, words: list[bytes], seed: int) -> np.ndarray:
    """The keyed multipliers that :func:`word_features` gives the words."""
    return np.frombuffer(b"".join(_hashed(seed, doc_id, words)), ">u4").reshape(-1, 4)[:, 0].astype(np.int64) % P


def sample_numbers(doc_id: int | None, n_words: int, n_samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(b, c, r) of every sample of one document."""
    h = np.frombuffer(b"".join(_hashed(seed, doc_id, [b"sample|%d" % s for s in range(n_samples)])), ">u4").reshape(-1, 4).astype(np.int64)
    r = 1 + h[:, 2] % n_words
    r[:1] = 0
    return 1 + h[:, 0] % (P - 1), h[:, 1] % P, r


def kernel_weights(n_words: int, r: np.ndarray) -> np.ndarray:
    distance = 100.0 * (1.0 - np.sqrt((n_words - r) / n_words))
    return np.sqrt(np.exp(-(distance * distance) / fixed.KERNEL_WIDTH ** 2))


def kept_words(a: np.ndarray, b: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Samples x words: true where a word (in sorted order) stays.  Words with
    different multipliers never have equal priorities (P is prime), so where all
    differ the r-th smallest priority decides."""
    kept = np.empty((len(b), len(a)), bool)
    step = max(1, CELLS // max(1, len(a)))
    differ = len(np.unique(a)) == len(a) and (b % P).all()
    for k in range(0, len(b), step):
        priority = ((a[None, :] * b[k:k + step, None] + c[k:k + step, None]) % P).astype(np.int32)
        removed = r[k:k + step, None]
        if differ:
            last = np.take_along_axis(np.sort(priority, axis=1), np.maximum(removed - 1, 0), axis=1)
            kept[k:k + step] = (priority > last) | (removed == 0)
        else:
            order = np.argsort(priority, axis=1, kind="stable")
            np.put_along_axis(kept[k:k + step], order, np.arange(len(a))[None, :] >= removed, axis=1)
    return kept


@dataclass
class Perturbed:
    """One document's samples."""

    doc_id: int
    words: list[str]
    kept: np.ndarray    # samples x words
    r: np.ndarray       # words removed
    kernel: np.ndarray
    score: np.ndarray


def _perturb(batch, scorer: Scorer, n_samples: int, seed: int):
    """The samples of every document of a :func:`compact` batch.  Words and tokens
    are numbered once a batch, words in their order."""
    runs = batch.column("runs")
    flat = runs.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    names = [names[k] for k in order]
    code = place[flat.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.int64)
    number: dict[str, int] = {}
    # A run's token is -1 if the tokenizer drops it (too short or a stop word).
    token = np.array([number.setdefault(t, len(number)) if len(t) >= 2 and t not in scorer.stop_words else -1 for t in (w.lower() for w in names)], np.int64)
    coded, raw, ends = scorer.coded(number), [w.encode() for w in names], np.cumsum(np.diff(runs.offsets.to_numpy()))
    for doc_id, first, end in zip(batch.column("doc_id").to_pylist(), [0, *ends], ends):
        distinct, word = np.unique(code[first:end], return_inverse=True)
        words = distinct.tolist()
        b, c, r = sample_numbers(doc_id, len(words), n_samples, seed)
        kept = kept_words(word_multipliers(doc_id, [raw[k] for k in words], seed), b, c, r)
        seq = token[code[first:end]]
        used = seq >= 0
        score = scorer.score_coded(word[used], seq[used], coded, kept)
        yield Perturbed(doc_id, [names[k] for k in words], kept, r, kernel_weights(len(words), r), score)


def perturbed_scores(docs: DataFrame, vocab: Vocabulary, coef, intercept: float | None, id_col: str = "doc_id",
                     text_col: str = "text", n_samples: int = fixed.PERTURB_SAMPLES, seed: int = fixed.SEED) -> DataFrame:
    """L3, L4: (doc_id, s, r, kernel, label) of every perturbed text."""
    scorer = Scorer.of(vocab, coef, intercept)

    def run(batches):
        for batch in batches:
            group = []
            for k, p in enumerate(_perturb(batch, scorer, n_samples, seed), 1):
                group.append((p.doc_id, p.r, p.kernel, p.score))
                if len(group) == GROUP or k == batch.num_rows:
                    ids, *columns = zip(*group)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), n_samples))), pa.array(np.tile(np.arange(n_samples), len(ids))), *(pa.array(np.concatenate(c)) for c in columns)],
                                                     ["doc_id", "s", "r", "kernel", "label"])
                    group = []

    return _in_python(compact(docs, id_col, text_col).drop("text")).mapInArrow(run, "doc_id long, s long, r long, kernel double, label double")


def _in_python(df: DataFrame) -> DataFrame:
    ship_package(df.sparkSession)
    return df


# -- L5: weighted ridge per document ------------------------------------------------------------

def weighted_ridge(X: np.ndarray, y: np.ndarray, sw: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge with an unpenalized intercept and sample weights; solved in the
    dual when there are more features than samples."""
    tot = sw.sum()
    xm = (sw[:, None] * X).sum(axis=0) / tot
    ym = (sw * y).sum() / tot
    s = np.sqrt(sw)
    A = (X - xm) * s[:, None]
    t = (y - ym) * s
    n, p = A.shape
    if p > n:
        return A.T @ np.linalg.solve(A @ A.T + alpha * np.eye(n), t)
    return np.linalg.solve(A.T @ A + alpha * np.eye(p), A.T @ t)


def ridge_of_batch(masks: list[np.ndarray], scores: list[np.ndarray], kernels: list[np.ndarray], alpha: float) -> list[np.ndarray]:
    """:func:`weighted_ridge` of every document of a batch, in the dual where it
    has as many words as samples.  Systems of the same size are solved together,
    as one stack."""
    by: dict[int, list] = {}
    for k, (z, y, sw) in enumerate(zip(masks, scores, kernels)):
        total, s = sw.sum(), np.sqrt(sw)
        x = (z - (sw @ z) / total) * s[:, None]
        t = (y - (sw @ y) / total) * s
        dual = x.shape[1] >= len(x)
        by.setdefault(min(x.shape), []).append((k, x, x @ x.T if dual else x.T @ x, t if dual else x.T @ t, dual))
    out: list = [None] * len(masks)
    for size, group in by.items():
        stack = np.stack([g[2] for g in group]) + alpha * np.eye(size)
        for (k, x, _, _, dual), u in zip(group, np.linalg.solve(stack, np.stack([g[3] for g in group])[:, :, None])[:, :, 0]):
            out[k] = x.T @ u if dual else u
    return out


def by_size(coef: np.ndarray) -> np.ndarray:
    """Places by falling size, equal ones (to 9 decimals) in word order."""
    return np.argsort(-np.round(np.abs(coef), 9), kind="stable")


def top_words(group: list[Perturbed], n_features: int = fixed.PERTURB_FEATURES) -> list[list[tuple[str, float]]]:
    """Of every document the words with the largest weights in a first ridge,
    weighed by a second one on them alone, by size."""
    masks = [p.kept.astype(float) for p in group]
    scores, kernels = [p.score for p in group], [p.kernel for p in group]
    chosen = [np.sort(by_size(c)[:n_features]) for c in ridge_of_batch(masks, scores, kernels, fixed.SELECT_RIDGE_ALPHA)]
    final = ridge_of_batch([z[:, k] for z, k in zip(masks, chosen)], scores, kernels, fixed.FINAL_RIDGE_ALPHA)
    return [[(p.words[k[j]], float(f[j])) for j in by_size(f)] for p, k, f in zip(group, chosen, final)]


def local_attribution(docs: DataFrame, vocab: Vocabulary, coef, intercept: float | None,
                      id_col: str = "doc_id", text_col: str = "text", n_samples: int = fixed.PERTURB_SAMPLES,
                      seed: int = fixed.SEED) -> DataFrame:
    """(doc_id, pos, word, weight, direction) for every document."""
    scorer = Scorer.of(vocab, coef, intercept)

    def out(group):
        rows = [(p.doc_id, k, w, x) for p, top in zip(group, top_words(group)) for k, (w, x) in enumerate(top, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "pos", "word", "weight"])

    def run(batches):
        group, cells = [], 0
        for batch in batches:
            for p in _perturb(batch, scorer, n_samples, seed):
                group.append(p)
                cells += p.kept.size
                if cells >= CELLS or len(group) == GROUP:
                    yield out(group)
                    group, cells = [], 0
        if group:
            yield out(group)

    found = _in_python(compact(docs, id_col, text_col).drop("text")).mapInArrow(run, "doc_id long, pos long, word string, weight double")
    return found.withColumn("direction", F.when(F.col("weight") > 0, F.lit(fixed.HELPED)).otherwise(F.lit(fixed.HURT)))
