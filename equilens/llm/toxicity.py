"""Toxicity with noisy-channel deobfuscation (operator 1).

**Language model.**  Counts of letter 4-grams (words in lower case, three
spaces before and one after) over *all* documents, each word weighted by how
often it occurs, with shorter contexts backed off to.  Its alphabet has 32
symbols (space, a-z with and without accents, other letters in five), so the
table of all 32 ** 4 counts is whole at any size of the corpus.

**Channel and decoding.**  A lattice is made of every word with a look-alike or
with the same character twice in a row anywhere, of single letters parted by
marks in a word, and of three or more single letters apart by white space; no
length is left out.  A look-alike may be any letter it stands for; before or
after all letters of its word also nothing (punctuation), a sign inside also a
word end, but never nothing there.  A mark between single letters is nothing or a
word end, a repeated letter may be nothing; each with a cost.  Viterbi search
over the last three symbols written finds the cheapest reading under costs and
language model; ties as stated in :func:`decode`.

**Score.**  The restored text is searched for letter 4-grams that restored
labelled documents show to be toxic (Wilson lower bound of P(toxic | gram)).  A
logistic model on the strongest and the number of distinct ones found gives the
probability.

The fit uses a bounded sample: at most ``MAX_FIT_ROWS`` labelled documents, one
per label and set of near copies, so copies do not make evidence; rows of one id
count once.  The language model and the scores cover every text as a whole.  A
null or empty text has no grams and gets the probability of such texts.  Rows
that repeat an id are scored each.  Without labels of both classes the score is
the share of toxic labels (0 if none).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, join_counted, map_texts, rows_bounded, words_of

MAX_FIT_ROWS = 50_000
SEED = 42
# A gram counts as toxic when the share of toxic documents among those with it
# is at least this, by the lower end of the Wilson interval.
MIN_SHARE = 0.5
SIGMAS = 1.64

# Letters that a look-alike can stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou"}
# Marks that part letters; white space does too.
MARKS = "._-*~/|,:;"
# Costs in nats.
LOOKALIKE_COST = 0.5
# A sign after or before the letters is punctuation, seldom for these but "!" and "*".
EDGE_COST, PUNCTUATION_COST = 4.0, 1.0
END_COST = 2.0
MARK_COST = 0.2
BREAK_COST = 1.0
# A letter written twice is common spelling, three times is not.
TWICE_COST, REPEAT_COST = 1.5, 0.3
# Readings that a worker keeps between chunks, of pieces up to this length
# (longer ones are decoded each time).
MEMO_PIECES, MEMO_LENGTH = 300_000, 64

# Symbols of toxic grams: space, a-z, other letters by code point; of the letter
# model: space, a-z with and without accents, other letters in five.
SYMBOLS, OTHERS = 64, 37
MODEL_SYMBOLS, MODEL_OTHERS = 32, 5
_CONTEXT = MODEL_SYMBOLS ** 3 - 1

_LETTER = r"[^\W\d_]"
_LOOK = "".join(re.escape(c) for c in LOOKALIKES)
_APART = "".join(re.escape(c) for c in MARKS)
# A sign that is a mark as well counts as a mark between single letters.
_ONE = rf"(?:{_LETTER}|[{''.join(re.escape(c) for c in LOOKALIKES if c not in MARKS)}])"
_PARTED = rf"(?<![\w{_LOOK}]){_ONE}(?:[{_APART}]{{1,3}}{_ONE}){{2,}}(?![\w{_LOOK}])"
PIECE = re.compile(rf"(?P<parted>{_PARTED})|(?:{_LETTER}|[{_LOOK}])+")


def _symbols(others: int, plain: bool) -> np.ndarray:
    """The symbol of each code point up to U+FFFF: space 0, a-z 1 to 26, the
    others by number; with ``plain`` accented Latin letters are their letter."""
    table = np.arange(0x10000) % others + 27
    for c in range(0x80, 0x250) if plain else ():
        letter = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if "a" <= letter <= "z":
            table[c] = ord(letter) - 96
    table[97:123] = np.arange(1, 27)
    table[32] = 0
    return table


_TOXIC_TABLE, _MODEL_TABLE = _symbols(OTHERS, False), _symbols(MODEL_OTHERS, True)


def symbols(flat: np.ndarray, model: bool) -> np.ndarray:
    table, others = (_MODEL_TABLE, MODEL_OTHERS) if model else (_TOXIC_TABLE, OTHERS)
    return np.where(flat < 0x10000, table[np.minimum(flat, 0xFFFF)], flat % others + 27).astype(np.int64)


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of letters in lower case, and the row of each."""
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " "))
    words, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(words, "")
    return words.filter(real), row[real.to_numpy(zero_copy_only=False)]


def grams(words: pa.Array, lead: int = 1, model: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams of the words, each after ``lead`` spaces and before one, as
    numbers of four symbols, and the word of each."""
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64) + lead + 1
    flat = np.frombuffer("".join([f"{' ' * lead}{w} " for w in words.to_pylist()]).encode("utf-32-le"), "<u4")
    if len(flat) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sym, base = symbols(flat, model), MODEL_SYMBOLS if model else SYMBOLS
    word = np.repeat(np.arange(len(lengths)), lengths)
    inside = word[:-3] == word[3:]
    key = ((sym[:-3] * base + sym[1:-2]) * base + sym[2:-1]) * base + sym[3:]
    return key[inside], word[:-3][inside]


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) of the letter model over all texts; at most ``MODEL_SYMBOLS`` ** 4 rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MODEL_SYMBOLS ** 4, np.int64)
        for (texts,) in chunks(batches):
            words, _ = letter_words(texts)
            if len(words):
                tally = words.value_counts()
                key, word = grams(tally.field("values"), 3, True)
                np.add.at(total, key, tally.field("counts").to_numpy()[word])
        found = np.flatnonzero(total)
        for at in range(0, len(found), 50_000):
            part = found[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["gram", "n"])

    rows = rows_bounded(docs.select(F.col(text_col).cast("string").alias("_text")))
    return rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def letter_costs(key: np.ndarray, n: np.ndarray, weight: float = 2.0) -> np.ndarray:
    """-log P(symbol | three symbols before) for every 4-gram of model symbols:
    counts of longer contexts smoothed by shorter ones."""
    counts = np.zeros(MODEL_SYMBOLS ** 4)
    counts[key] = n
    counts = counts.reshape((MODEL_SYMBOLS,) * 4)
    p = (counts.sum((0, 1, 2)) + 0.5) / (counts.sum() + 0.5 * MODEL_SYMBOLS)
    for axes in ((0, 1), (0,), ()):
        part = counts.sum(axes) if axes else counts
        p = (part + weight * p) / (part.sum(-1, keepdims=True) + weight)
    return -np.log(p).astype(np.float32).ravel()


def readings(s: str, parted: bool) -> list[list[tuple[float, str]]]:
    """The lattice of one stretch: for each character what may be written for
    it ('' nothing, ' ' a word end) and at what cost."""
    if not parted and s.isalpha():
        out, same = [[(0.0, c)] for c in s], 0
        for k in range(1, len(s)):
            if s[k] == s[k - 1]:
                same += 1
                out[k].append((TWICE_COST if same == 1 else REPEAT_COST, ""))
            else:
                same = 0
        return out
    letters = [k for k, c in enumerate(s) if c.isalpha()]
    first, last = (letters[0], letters[-1]) if letters else (0, len(s))
    out, before, same = [], "", 0
    for k, c in enumerate(s):
        options = []
        meant = c + LOOKALIKES.get(c, "")
        same = same + 1 if any(x in before for x in meant) else 0
        mark = parted and (c.isspace() or c in MARKS)
        if c in LOOKALIKES:
            options = [(LOOKALIKE_COST, letter) for letter in LOOKALIKES[c]]
            if not mark and not first < k < last:
                options.append((PUNCTUATION_COST if c in "!*" else EDGE_COST, ""))
            elif not mark and not c.isdigit():
                options.append((END_COST, " "))
        elif not mark:
            options = [(0.0, c)]
        if mark:
            options += [(MARK_COST, ""), (BREAK_COST, " ")]
        elif same:
            options.append((TWICE_COST if same == 1 else REPEAT_COST, ""))
        out.append(options)
        before = meant
    return out


_KNOWN = {"": -1, " ": 0, **{chr(c): c - 96 for c in range(97, 123)}}


def decode(costs, s: str, parted: bool = False) -> str:
    """The likeliest reading of one disguised stretch (in lower case) under
    :func:`readings` and the letter model.  Of equally cheap ways to one context
    the one found first stays, of equally cheap readings the smallest.

    Letters before the first choice cost the same in every reading, and so do
    those from the fourth after the last choice on: they are not searched."""
    lattice = readings(s, parted)
    open_ = [k for k, options in enumerate(lattice) if len(options) > 1 or options[0][0]]
    if not open_:
        return s
    first, stop = open_[0], open_[-1] + 4
    context, known = 0, _KNOWN
    for c in s[max(0, first - 3):first]:
        context = context * MODEL_SYMBOLS + (known.get(c) or _model_symbol(c))
    best: dict[int, tuple] = {context: (0.0, None)}
    for options in lattice[first:stop]:
        after: dict[int, tuple] = {}
        for x, letter in options:
            sym = known.get(letter)
            if sym is None:
                sym = known[letter] = _model_symbol(letter)
            for context, (cost, path) in best.items():
                if sym > 0:
                    at = context * MODEL_SYMBOLS + sym
                    to, total, path = at & _CONTEXT, cost + x + costs[at], (path, letter)
                elif sym < 0:
                    to, total = context, cost + x
                elif context:
                    to, total, path = 0, cost + x + costs[context * MODEL_SYMBOLS], (path, " ")
                else:  # no empty words
                    to, total = 0, cost + x
                held = after.get(to)
                if held is None or total < held[0]:
                    after[to] = (total, path)
        best = after
    ends = [(cost + (costs[context * MODEL_SYMBOLS] if context else 0.0), path) for context, (cost, path) in best.items()]
    least = min(e[0] for e in ends)
    return s[:first] + min(_spell(path) for cost, path in ends if cost == least) + s[stop:]


def _spell(path) -> str:
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def _model_symbol(letter: str) -> int:
    """-1 for nothing."""
    return -1 if not letter else int(symbols(np.array([ord(letter)], np.uint32), True)[0])


_TWICE = re.compile(r"(.)\1")


def disguised(piece: str) -> bool:
    """Whether a run of letters and look-alikes has a letter and either a
    look-alike or the same character twice in a row."""
    return _TWICE.search(piece) is not None if piece.isalpha() else any(map(str.isalpha, piece))


def restore_word(costs, word: str, memo: dict[str, str] | None = None) -> str:
    """``word`` (in lower case, no white space) with its disguised pieces decoded;
    ``memo`` keeps readings of short pieces."""
    def read(m: re.Match) -> str:
        piece, parted = m[0], bool(m["parted"])
        if not parted and not disguised(piece):
            return piece
        if memo is None or len(piece) > MEMO_LENGTH:
            return decode(costs, piece, parted)
        if piece not in memo:
            if len(memo) >= MEMO_PIECES:
                memo.clear()
            memo[piece] = decode(costs, piece, parted)
        return memo[piece]

    return PIECE.sub(read, word)


# Three or more single letters apart by white space, marks among them.
_SPACE = r"\x20\x09-\x0D"
_SINGLES = re.compile(rf"(?<![^{_SPACE}]){_ONE}(?:[{_SPACE}]+(?:{_ONE}|[{_APART}]))+(?![^{_SPACE}])")
_SINGLE = re.compile(_ONE)
_WORD = re.compile(rf"[^{_SPACE}]+")


def restore_singles(costs, run: str) -> str:
    """A run of single letters and marks read as words; fewer than three are left alone."""
    ones = _SINGLE.findall(run)
    return decode(costs, " ".join(run.split()), True) if len(ones) > 2 and any(map(str.isalpha, ones)) else run


def restore(costs, text: str) -> str:
    """``text`` in lower case with its disguised stretches decoded."""
    text, out, at = text.lower(), [], 0
    for m in _SINGLES.finditer(text):
        out += [_WORD.sub(lambda w: restore_word(costs, w[0]), text[at:m.start()]), restore_singles(costs, m[0])]
        at = m.end()
    return "".join(out) + _WORD.sub(lambda w: restore_word(costs, w[0]), text[at:])


def restored_words(costs, lowered: pa.Array, memo: dict[str, str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters in the restored texts, (text, number of its word) of each
    occurrence, and how many stretches of each text were read otherwise than they
    stand.  A token is decoded once a chunk; ``memo`` keeps readings between chunks."""
    tokens, row = words_of(lowered)
    if not len(tokens):
        none = np.zeros(0, np.int64)
        return pa.array([], pa.string()), none, none, np.zeros(len(lowered), np.int32)
    coded = tokens.dictionary_encode()
    shown, code = coded.dictionary, coded.indices.to_numpy()
    plain = shown.to_pylist()
    suspect = pc.or_(pc.and_(pc.match_substring_regex(shown, rf"[{_LOOK}]"), pc.match_substring_regex(shown, r"\p{L}")),
                     pc.match_substring_regex(shown, rf"[\p{{L}}\d][{_APART}]{{1,3}}[\p{{L}}\d][{_APART}]{{1,3}}[\p{{L}}\d]")).to_numpy(zero_copy_only=False).copy()
    lengths = pc.utf8_length(shown).to_numpy().astype(np.int64)
    flat = np.frombuffer("".join(plain).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(plain)), lengths)
    suspect[owner[1:][(flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])]] = True
    other = np.zeros(len(plain), bool)
    for k in np.flatnonzero(suspect):
        token = plain[k]
        plain[k] = restore_word(costs, token, memo)
        other[k] = plain[k] != token and _letters(plain[k]) != _letters(token)
    number = np.bincount(row[other[code]], minlength=len(lowered)).astype(np.int32)

    # Runs of three and more single characters in a text.
    single = np.zeros(len(plain), bool)
    ones = np.flatnonzero(lengths == 1)
    single[ones] = [t in MARKS or bool(_SINGLE.fullmatch(t)) for t in shown.take(pa.array(ones)).to_pylist()]
    atom = single[code]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], atom, [0]])) | np.concatenate([[0], row[1:] != row[:-1], [0]]))
    bounds = np.concatenate([[0], edge, [len(atom)]])
    used, runs, run_row = np.ones(len(atom), bool), [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 2 and atom[a]:
            run = " ".join(shown.take(pa.array(code[a:b])).to_pylist())
            read = _SINGLES.sub(lambda m: restore_singles(costs, m[0]), run)
            if read != run:
                used[a:b] = False
                runs.append(read)
                run_row.append(row[a])
                number[row[a]] += 1
    words, of = letter_words(pa.array(plain + runs, pa.string()))
    first = np.searchsorted(of, np.arange(len(plain) + len(runs) + 1))
    entry = np.concatenate([code[used].astype(np.int64), len(plain) + np.arange(len(runs))])
    text = np.concatenate([row[used], np.array(run_row, np.int64)])
    n = (first[1:] - first[:-1])[entry]
    at = np.repeat(first[entry], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return words, np.repeat(text, n), at, number


def _letters(s: str) -> list[str]:
    return re.sub(r"[\W\d_]+", " ", s).split()


def likeness(text: Column) -> Column:
    """Least and greatest hash of a text's long words (of the whole text if it
    has none): the same for most near copies, seldom for other texts."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 8)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > 0, F.xxhash64(F.array_min(hashes), F.array_max(hashes))).otherwise(F.xxhash64(text))


def sample(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_id: str, label: str, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(_l, _y): at most ``max_rows`` labelled training documents, one per label and set of near copies."""
    marked = cut(labels.where(F.col(label).isNotNull()).select(F.col(label_id).alias("_l"), (F.col(label) > 0).cast("int").alias("_y")))
    seen = join_counted(docs.where(train).select(F.col(id_col).alias("_l"), F.col(text_col).cast("string").alias("_t")), marked, "_l")
    one = seen.select("_l", "_y", likeness(F.col("_t")).alias("_w")).groupBy("_w", "_y").agg(F.min(F.struct(F.xxhash64("_l", F.lit(SEED)).alias("h"), "_l")).alias("m"))
    return cut(one.select("m.h", "m._l", "_y").orderBy("h", "_l").limit(max_rows).select("_l", "_y"))


def toxic_grams(docs: DataFrame, chosen: DataFrame, costs: np.ndarray, id_col: str, text_col: str, n_toxic: int, n_clean: int) -> dict[int, float]:
    """Gram -> log odds of toxic, for grams whose documents are mostly toxic;
    from restored texts, as they are scored."""
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, y in chunks(batches):
            costs = shared.value
            words, row, of, _ = restored_words(memoryview(costs), pc.utf8_lower(pc.fill_null(texts, "")), _memo(costs))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            key, word = grams(coded.dictionary)
            pair = np.unique(row.astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy()[of])
            doc, w = pair // len(coded.dictionary), pair % len(coded.dictionary)
            first = np.searchsorted(word, np.arange(len(coded.dictionary) + 1))
            n = (first[1:] - first[:-1])[w]
            at = np.repeat(first[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found, number = np.unique(key, return_inverse=True)
            pair = np.unique(np.repeat(doc, n) * np.int64(len(found)) + number[at])
            toxic = y.to_numpy()[pair // len(found)]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(pair % len(found), toxic, len(found)).astype(np.int64)),
                                              pa.array(np.bincount(pair % len(found), 1 - toxic, len(found)).astype(np.int64))], ["gram", "t", "c"])

    # The sample is bounded, so it is broadcast.
    texts = docs.select(F.col(id_col).alias("_l"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_l").select("_text", "_y")
    table = rows_bounded(texts).mapInArrow(run, "gram long, t long, c long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    n, z = F.col("t") + F.col("c"), SIGMAS
    p = F.col("t") / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    rows = table.where(low >= MIN_SHARE).collect()  # at most SYMBOLS ** 4 rows, whatever the texts
    odds = lambda t, c: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    return {r["gram"]: odds(r["t"], r["c"]) for r in rows}


def evidence(docs: DataFrame, costs: np.ndarray, weights: dict[int, float], id_col: str, text_col: str, **carry: Column) -> DataFrame:
    """(id, strongest, number, restored): the weight of the strongest toxic gram
    of the restored text, how many distinct ones there are, and how many
    stretches were read otherwise than they stand."""
    found = np.array(sorted(weights), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((costs, found, np.array([weights[g] for g in found.tolist()])))

    def run(_, texts: pa.Array) -> dict:
        costs, toxic, weight = shared.value
        n = len(texts)
        words, text, word, restored = restored_words(memoryview(costs), pc.utf8_lower(pc.fill_null(texts, "")), _memo(costs))
        strongest, number = np.zeros(n), np.zeros(n, np.int32)
        if len(toxic) and len(words):
            coded = words.dictionary_encode()
            key, owner = grams(coded.dictionary)
            at = np.minimum(np.searchsorted(toxic, key), len(toxic) - 1)
            hit = toxic[at] == key
            at, owner = at[hit], owner[hit]
            first = np.searchsorted(owner, np.arange(len(coded.dictionary) + 1))
            w = coded.indices.to_numpy()[word].astype(np.int64)
            many = (first[1:] - first[:-1])[w]
            rows, w, many = text[many > 0], w[many > 0], many[many > 0]
            each = np.repeat(first[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pair = np.unique(np.repeat(rows, many).astype(np.int64) * len(toxic) + at[each])
            number = np.bincount(pair // len(toxic), minlength=n).astype(np.int32)
            strongest = np.full(n, -np.inf)
            np.maximum.at(strongest, pair // len(toxic), weight[pair % len(toxic)])
            strongest = np.where(number > 0, strongest, 0.0)
        return {"strongest": strongest, "number": number, "restored": restored}

    return map_texts(docs, run, "strongest double, number int, restored int", id_col, text_col, carry or None)


_MEMO: list = [None, {}]


def _memo(costs: np.ndarray) -> dict[str, str]:
    """The readings kept for one model."""
    if _MEMO[0] is not costs:
        _MEMO[:] = costs, {}
    return _MEMO[1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method on the log loss; a column of ones comes first in the result."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def classify(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(id, score, restored): the probability that each text is toxic.  Labels
    are learned only from rows for which ``train`` holds."""
    chosen = sample(docs, labels, train, id_col, text_col, label_id, label)
    tally = {r["_y"]: r["count"] for r in chosen.groupBy("_y").count().collect()}
    n_toxic, n_clean = tally.get(1, 0), tally.get(0, 0)
    counted = gram_counts(docs, text_col).toArrow()  # at most MODEL_SYMBOLS ** 4 rows
    costs = letter_costs(counted["gram"].to_numpy(), counted["n"].to_numpy())
    weights = toxic_grams(docs, chosen, costs, id_col, text_col, n_toxic, n_clean) if n_toxic and n_clean else {}
    found = cut(evidence(docs, costs, weights, id_col, text_col))
    if not weights:
        return found.select(id_col, F.lit(n_toxic / max(1, n_toxic + n_clean)).alias("score"), "restored")
    # Rows that share an id are one row here, so the sample's bound holds.
    one = found.join(F.broadcast(chosen), F.col(id_col) == F.col("_l")).groupBy("_l", "_y").agg(F.max(F.struct("strongest", "number")).alias("m"))
    rows = one.select("m.strongest", "m.number", "_y").collect()
    w = logistic(np.array([[r[0], math.log1p(r[1])] for r in rows]), np.array([r[2] for r in rows], float))
    logit = F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("strongest") + F.lit(float(w[2])) * F.log1p("number")
    return found.select(id_col, (1 / (1 + F.exp(-logit))).alias("score"), "restored")
