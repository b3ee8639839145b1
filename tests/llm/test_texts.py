import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equilens.llm import common, html_extract, langid, mixing, oracle, prefix_bpe, quality_gam, quality_rules, queries, secret_scan, text_stats, toxicity

from .helpers import docs, edge_rows, labels, prose, row

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return prefix_bpe.Encoder(prefix_bpe.load(PATH, public_tokenizers.PATTERN))


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def test_chunks_cut_and_join_batches():
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(range(len(t)))], ["t", "i"])
    parts = list(common.chunks(iter([batch(["aa", None, "bbb"]), batch([]), batch(["c" * 50, "d"])]), 6))
    assert [p[0].to_pylist() for p in parts] == [["aa", None, "bbb"], ["c" * 50], ["d"]]


# Operator 4.

@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(list(" \n\tab'sdeé.1漢🙂 \x1c\x85")), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_bpe_equals_tiktoken(encoder, reference, text):
    want = reference.encode_ordinary(text)
    assert encoder.text(text) == want and encoder.decode(want) == text.encode()
    joined = ",".join(map(str, want)).encode()
    got = {k: v.to_pylist() for k, v in prefix_bpe.Texts(encoder).digests(pa.array([text, "", text], pa.string())).items()}
    of = lambda n, a, b: {"n_tokens": n, "ids_sha256": hashlib.sha256(a).hexdigest(), "decoded_sha256": hashlib.sha256(b).hexdigest()}
    assert [dict(zip(got, x)) for x in zip(*got.values())] == [of(len(want), joined, text.encode()), of(0, b"", b""), of(len(want), joined, text.encode())]


@settings(max_examples=80, deadline=None)
@given(data=st.binary(min_size=1, max_size=60), more=st.binary(max_size=30), cut=st.tuples(st.integers(0, 60), st.integers(0, 60)), new=st.binary(max_size=8))
def test_prefixes_append_and_edit_exactly(encoder, data, more, cut, new):
    p = prefix_bpe.Prefixes(encoder, data)
    ids, many = encoder.pieces_many([data, data + more])
    assert ids[many[0]:].tolist() == encoder.piece(data + more) and ids[:many[0]].tolist() == encoder.piece(data)
    p.append(more)
    assert p.last == prefix_bpe.Prefixes(encoder, data + more).last
    a, b = sorted(min(c, len(p.data)) for c in cut)
    p.edit(a, b, new)
    assert p.last == prefix_bpe.Prefixes(encoder, p.data).last


def test_edit_encodes_only_near_the_change(encoder):
    p = prefix_bpe.Prefixes(encoder, b"the thing and the other things " * 200)
    assert p.edit(100, 103, b"xyz") < 400 and p.last == prefix_bpe.Prefixes(encoder, p.data).last


def test_bpe_tables(spark, reference):
    rows = edge_rows()
    got = prefix_bpe.round_trip(docs(spark), PATH, public_tokenizers.PATTERN).collect()
    ids = [reference.encode_ordinary(r[1] or "") for r in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(i), sha(",".join(map(str, i)).encode()), sha((r[1] or "").encode())) for r, i in zip(rows, ids)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    encoded = prefix_bpe.encode(docs(spark), PATH, public_tokenizers.PATTERN)
    assert sorted(map(str, ((r[0], i) for r, i in zip(rows, ids)))) == sorted(str((r.doc_id, r.ids)) for r in encoded.collect())
    back = prefix_bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(str((r[0], (r[1] or "").encode())) for r in rows) == sorted(str((r.doc_id, bytes(r.data))) for r in back)
    assert prefix_bpe.round_trip(docs(spark, []), PATH, public_tokenizers.PATTERN).collect() == []


# Operator 10.

def brute_secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_sql_agrees(spark, tmp_path):
    r = random.Random(6)
    texts = ["".join(r.choice(a) for _ in range(r.randint(18, 34))) for a in (LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER, LOWER + UPPER + DIGITS + "+/=_-", "abc123-", "aB-/") for _ in range(60)]
    rows = edge_rows()[2:] + [row(100 + i, f"x {t} y\n{t[:25]}.") for i, t in enumerate(texts)]
    rows = [x for x in rows if x[0] is not None]
    docs(spark, rows).select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = {x[0]: (x[4], x[5]) for x in con.execute(oracle.secrets_sql()).fetchall()}
    got = {x.doc_id: (x.base_sha256, x.spans) for x in queries.op10_secret_scan(spark, str(tmp_path)).collect()}
    assert got == want and sum("entropy" in x[1] for x in got.values()) > 100


def test_secrets_against_regexes(spark):
    texts = ["🙂 API_KEY: 'abcDEF123-_x' token=short secret==abcdefgh", "token=secret: abcdefghijk", "0" * 40 + " " + "a" * 31 + " AKIA" + "B" * 20, "AKIAAKIAAKIA", "passwd:\"x\" Password =  \"1234567.\" ",
             "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855token:abcdefgh"]
    rows = edge_rows() + [row(100 + i, t) for i, t in enumerate(texts)]
    got = secret_scan.scan(docs(spark, rows)).collect()
    want = sorted(str((r[0], [(a, k, b, n) for a, k, b, n in brute_secrets(r[1])])) for r in rows)
    assert sorted(str((r.doc_id, [tuple(s) for s in r.base])) for r in got) == want
    assert all([s for s in r.spans if s.kind != "entropy"] == r.base for r in got)
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs(spark, rows)).collect()}
    assert clean[8] == "[REDACTED] and [REDACTED]" and clean[2] is None and clean[3] == "" and clean[101] == "token=secret: abcdefghijk".replace("secret: abcdefghijk", "secret: abcdefghijk")
    assert secret_scan.scan(docs(spark, [])).collect() == []


def test_entropy_windows(spark):
    def brute(s, w=20):
        h = lambda x: sum(-c / len(x) * math.log2(c / len(x)) for c in collections.Counter(x).values())
        return max(h(s[i:i + w]) for i in range(max(1, len(s) - w + 1)))

    rows = ["abc", "aaaaaaaaaaaaaaaaaaaaaaaab", "abababababababababababqwertyuiopasdfghjklz1234567890", "x9Kq2LmZ7vTb4RwY8nHs3JdF6gPc"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", secret_scan.window_entropy(F.col("t")).alias("h")).collect()
    assert all(abs(r.h - brute(r.t)) < 1e-9 for r in got)
    texts = {1: "key x9Kq2LmZ7vTb4RwY8nHs3JdF6gPc end", 2: "id 123e4567-e89b-12d3-a456-426614174000 end", 3: "a-long-name-joined-by-hyphens-2024 end", 4: "token=x9Kq2LmZ7vTb4RwY8nHs3JdF6gPc", 5: "thandedblethandedblethandedble1"}
    kinds = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan(docs(spark, [row(i, t) for i, t in texts.items()])).collect()}
    assert kinds == {1: [("entropy", 4, 32)], 2: [], 3: [], 4: [("assign", 0, 34)], 5: []}


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def test_random_tokens_of_every_class_are_found(spark):
    r = random.Random(5)
    classes = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "lower": LOWER + DIGITS, "letters": LOWER + UPPER, "base62": LOWER + UPPER + DIGITS, "wide": LOWER + UPPER + DIGITS + "+/"}
    rows, kind = [], {}
    for name, alphabet in classes.items():
        for n in (20, 24, 28):
            for _ in range(150):
                kind[len(rows)] = (name, n)
                rows.append(row(len(rows), "key " + "".join(r.choice(alphabet) for _ in range(n)) + " end"))
    plain = ["getElementsByClassNameFromDocument", "some/path/to/Readme/2024/07/chapter-12", "a_long_CONSTANT_name_of_2024", "donaudampfschifffahrtsgesellschaft", "AVERYLONGWORDINCAPITALLETTERS", "Einkommensteuererklaerung2023",
             "2024-07-01T120000Z-0000000", "=====================a1", "12345678901234567890m", "123e4567-e89b-12d3-a456-426614174000"]
    clean = range(len(rows), len(rows) + len(plain))
    rows += [row(i, f"see {t} there") for i, t in zip(clean, plain)]
    found = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in secret_scan.scan(docs(spark, rows)).collect()}
    hits = collections.Counter(kind[i] for i in kind if found[i])
    assert all(found[i] in ([], [(4, 4 + kind[i][1])]) for i in kind)
    assert all(hits[name, n] >= 150 * 0.92 for name in classes for n in (20, 24, 28)), hits
    assert not any(found[i] for i in clean), [t for i, t in zip(clean, plain) if found[i]]


# Operator 8.

def fill(sizes, weights, total, cap=2):
    goal, open_ = {}, set(sizes)
    while open_:
        rest, w = total - sum(goal.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if rest * weights[s] / w > cap * sizes[s]]
        if not over:
            goal |= {s: rest * weights[s] / w for s in open_}
            break
        for s in over:
            goal[s] = cap * sizes[s]
            open_.remove(s)
    return goal


def test_mixing_targets_and_amounts(spark):
    rows = [row(i, prose(i, 5 + i % 40), "en", None if i % 11 == 0 else f"s{(i * i) % 7}") for i in range(900)] + edge_rows()
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix(docs(spark, rows[::-1]).repartition(5)).collect()))
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = fill(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()))
    taken = collections.Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        assert list(r.finish) == sorted(r.finish) and len(r.finish) == r.copies
    assert all(abs(taken[s] - goal[s]) <= 100 for s in order if s is not None and s.startswith("s") and len(s) > 1)
    biggest = max(r.size for r in out)
    assert all(abs(taken[s] - goal[s]) <= 2 * biggest for s in order)
    rows_mixed = mixing.apply_mix(docs(spark, rows))
    assert rows_mixed.columns == docs(spark, rows).columns
    assert mixing.mix(docs(spark, [])).collect() == [] and mixing.mix(docs(spark, [row(1, None), row(2, "")])).count() == 2


def test_rows_that_share_ids_have_their_own_copies(spark):
    """Half of the ids null and a tenth equal: the mix stays at its budget, no range
    of the queue is hot, other columns of any name come out as they went in."""
    rows = [row(None if i % 2 else 7 if i % 10 == 0 else i, prose(i, 5 + i % 30), "en", f"s{i % 3}") for i in range(3000)]
    table = docs(spark, rows).withColumns({"mixed": F.lit("m"), "copies": F.lit("c"), "row": F.lit("r"), "place": F.lit("p")})
    out = mixing.apply_mix(table)
    assert out.columns == table.columns and {(r.mixed, r.copies, r.row, r.place) for r in out.select("mixed", "copies", "row", "place").distinct().collect()} == {("m", "c", "r", "p")}
    words = sum(len(r[1].split()) for r in rows)
    got = out.select(F.sum(F.size(F.split("text", " "))).alias("n")).first()["n"]
    assert abs(got - math.floor(1.5 * words)) <= 40
    by = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert set(by.values()) <= {1, 2}
    queue = mixing.queue(table)
    ranges = math.isqrt(3000) + 1
    held = [r["count"] for r in queue.groupBy(mixing._range_of(F.col("mixed"), ranges)).count().collect()]
    assert len(held) == ranges and max(held) < 2.2 * 3000 / ranges


def test_equal_finish_times_are_taken_by_turn_and_place(spark):
    """Two sources alike in everything but their weight's turn: every finish time occurs twice."""
    rows = [row(i, "one two three", "en", s) for i in range(40) for s in ("a", "d")]
    table = docs(spark, rows)
    got = mixing.mix(table, weights=(1,)).collect()
    again = mixing.mix(table.repartition(7), weights=(1,)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and sum(r.taken for r in got) == 1.5 * 3 * len(rows)


def test_mixing_queue_is_fair(spark):
    rows = [row(i, prose(i, 10), "en", "a" if i % 3 else "b") for i in range(600)]
    offers = sorted((f, r.source, r.size) for r in mixing.mix(docs(spark, rows)).collect() for f in r.finish)
    for end in (200, 500, 800):  # any stretch from the start on is shared as the targets are
        part = collections.Counter()
        for _, s, n in offers[:end]:
            part[s] += n
        target = {r.source: r.target for r in mixing.mix(docs(spark, rows)).select("source", "target").distinct().collect()}
        assert abs(part["a"] / target["a"] - part["b"] / target["b"]) < 0.05


# Operator 2.

def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if n[tuple(w[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("ab \n\t\r\x0b\x0c\x1c#|é")), max_size=120)), max_size=5))
def test_counts_against_brute_force(texts):
    got = text_stats.counts(pa.array(texts, pa.string()))
    assert list(zip(*(got[k].tolist() for k in quality_rules.BASE))) == [brute_counts(t) for t in texts]


def test_binomial_bounds():
    for n, p in ((12, 0.3), (400, 0.01)):
        for k in (0, 1, 5, n):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(quality_rules.binomial_cdf(k, n, p) - want) < 1e-9
    assert abs(quality_rules.binomial_cdf(2, 300, quality_rules.upper_bound(2, 300, 0.05)) - 0.05) < 1e-6
    # certified cutoffs stay under the limit; without enough labels there is none
    cuts, good, bad = np.array([0.0, 1.0, 2.0]), np.array([3000, 400, 3, 0]), np.array([10, 0, 0, 500])
    assert quality_rules.choose(cuts, good, bad, 0.01, 0.01) == 2.0
    assert quality_rules.choose(cuts, good // 100, bad, 0.01, 0.01) is None


def test_rules_reject_few_good_documents(spark):
    rows, marks = [], []
    for i in range(3000):
        bad = i % 6 == 0
        text = prose(i, 40)
        rows.append(row(i, text.replace(" ", "### ") if bad else text, "en" if i % 4 else "de"))
        if i % 2 == 0:
            marks.append((i, 0 if bad else 1, 0, "x"))
    limits = {"alpha": 0.2}  # few labels here
    out = {r.doc_id: r for r in quality_rules.judge(docs(spark, rows), labels(spark, marks), **limits).collect()}
    english = [i for i in range(3000) if i % 4]
    assert sum(out[i].kept for i in english if i % 6) >= 0.96 * sum(1 for i in english if i % 6)
    assert not any(out[i].kept for i in english if i % 6 == 0) and "symbols" in out[6].broken
    kept = quality_rules.keep(docs(spark, rows), labels(spark, marks), **limits)
    assert kept.columns == docs(spark, rows).columns and kept.count() == sum(r.kept for r in out.values())


def brute_cutoffs(measured, marks, alpha, delta):
    """Cutoffs of each stratum from plain lists: (stratum, near, mark, values, id) rows."""
    fine = dict(marks)
    holdout = {}
    for s, near, mark, values, i in sorted(measured, key=lambda x: (x[2], x[3])):
        if i in fine:
            holdout.setdefault((s, near, fine[i]), values)
    out = {}
    strata = {s for s, near, *_ in measured if not any((s, near, y) in holdout for y in (0, 1))}
    for s in strata:
        cuts = []
        for k in range(len(quality_rules.RULES)):
            free = []
            for s2, near, _, values, _ in measured:
                if s2 == s and not any((s, near, y) in holdout for y in (0, 1)):
                    scale = 10.0 ** (2 - math.floor(math.log10(abs(values[k])))) if values[k] else 1.0
                    free.append(math.floor(values[k] * scale) / scale)
            free.sort()
            q = [free[max(0, math.ceil(len(free) * x - 1e-9) - 1)] for x in quality_rules.QUANTILES]
            grid = sorted({*q, *((a + b) / 2 for a, b in zip(q, q[1:]))})
            tally = [np.zeros(len(grid) + 1, int), np.zeros(len(grid) + 1, int)]
            for (s2, _, y), values in holdout.items():
                if s2 == s:
                    tally[y][sum(c < values[k] for c in grid)] += 1
            cuts.append(quality_rules.choose(np.array(grid), tally[1], tally[0], alpha / len(quality_rules.RULES), delta / len(quality_rules.RULES) / len(strata)))
        out[s] = cuts
    return out


def test_cutoffs_against_brute_force(spark):
    rows = []
    for i in range(1200):
        bad = i % 5 == 0
        text = prose(i if i % 7 else 7, 40)  # every seventh is a copy of one text
        rows.append(row(i, text.replace(" ", "### ") if bad else text, "en" if i % 3 else None))
    marks = [(i, 0 if i % 5 == 0 else 1, 0, "x") for i in range(0, 1200, 2)]
    measured = common.cut(quality_rules.measure(docs(spark, rows)))
    got = {r._stratum: r.cuts for r in quality_rules.cutoffs(measured, labels(spark, marks), 0.4, 0.05).collect()}
    plain = [(r._stratum, r._near, r._mark, r["values"], r._id) for r in measured.collect()]
    assert len({(r[0], r[1]) for r in plain}) < 1200 * 0.9
    want = brute_cutoffs(plain, [(m[0], m[1]) for m in marks], 0.4, 0.05)
    assert got == want and any(c is not None for c in got["=en"])


def test_rules_edge_cases(spark):
    got = quality_rules.judge(docs(spark), labels(spark, [])).collect()
    want = sorted(str((r[0], *brute_counts(r[1]))) for r in edge_rows())
    assert sorted(str(tuple(r[c] for c in ["doc_id", *quality_rules.BASE])) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.judge(docs(spark, []), labels(spark, [])).collect() == []
    assert quality_rules.keep(docs(spark), labels(spark, [(None, None, None, None)])).count() == sum(r.kept for r in got)


# Operator 3.

def test_forward_sums_all_segmentations():
    names = ["▁", "▁a", "a", "ab", "b", "bab"]
    pieces = langid.Pieces.build(names)
    prob = np.random.default_rng(1).random((len(names) + 1, 2))

    def brute(word, k):
        word, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
            parts, p = [word[a:b] for a, b in zip(at, at[1:])], 1.0
            for x in parts:
                p *= prob[names.index(x), k] if x in names else prob[-1, k] if len(x) == 1 else 0.0
            total += p
        return math.log(total)

    words = ["abab", "b", "xa", "babab", "bbbabababbb"]
    assert np.allclose(langid.forward(pieces, words, prob), [[brute(w, k) for k in (0, 1)] for w in words])
    # expected counts are the derivative of the log likelihood
    base, eps = prob[:, 0].copy(), 1e-6
    for k in range(len(base)):
        up = base.copy()
        up[k] *= 1 + eps
        slope = (langid.forward(pieces, words, up[:, None]) - langid.forward(pieces, words, base[:, None])).sum() / eps
        assert abs(slope - langid.expected(pieces, words, np.ones(len(words)), base)[k]) < 1e-3


def test_long_words_and_pieces_are_whole():
    """Words far beyond what unscaled products can hold, pieces of any length."""
    names = ["▁", "a", "b", "ab", "abcabcabcabcabcabcabc", "▁bab", "ba"]
    pieces = langid.Pieces.build(names)
    assert pieces.longest == 21
    rng = np.random.default_rng(1)
    prob = rng.random((len(names) + 1, 2)) * 1e-6
    words = ["".join(rng.choice(list("abc?"), 700)), "abc" * 150, "ab", "z" * 400, "b" * 41, "abcabcabcabcabcabcabc", "ba" * 8, "b" * 7]

    def log_sum(word, p):
        w = "▁" + word
        out = [0.0] + [-math.inf] * len(w)
        for i in range(len(w)):
            for k in range(1, min(21, len(w) - i) + 1):
                part = w[i:i + k]
                q = p[names.index(part)] if part in names else p[-1] if k == 1 else 0
                if q:
                    out[i + k] = np.logaddexp(out[i + k], out[i] + math.log(q))
        return out[-1]

    got = langid.forward(pieces, words, prob)
    assert np.allclose(got, [[log_sum(w, prob[:, k]) for k in (0, 1)] for w in words], rtol=1e-10) and got.min() < -1500
    weight = np.arange(1.0, len(words) + 1)
    count = langid.expected(pieces, words, weight, prob[:, 0])
    # every letter of every word is in one piece of a segmentation
    letters = np.array([len(n) for n in names] + [1])
    assert abs(count @ letters - weight @ [len(w) + 1 for w in words]) < 1e-6
    base, eps = prob[:, 0].copy(), 1e-6
    for k in range(len(base)):
        up = base.copy()
        up[k] *= 1 + eps
        slope = ((langid.forward(pieces, words, up[:, None]) - langid.forward(pieces, words, base[:, None]))[:, 0] * weight).sum() / eps
        assert abs(slope - count[k]) < 1e-3 * max(1, count[k])
    parts = langid.groups(np.array([3] * 50 + [langid.CELLS * 2] + [9000] * 90))
    assert sorted(np.concatenate(parts).tolist()) == list(range(141)) and all(len(p) == 1 or len(p) * 9001 <= langid.CELLS for p in parts[1:])
    words, row = langid.letter_words(pa.array(["x" * 100 + " y", None, "É" * 45 + "1é"]))
    assert words.to_pylist() == ["x" * 100, "y", "é" * 45, "é"] and row.tolist() == [0, 0, 2, 2]


def test_language_prediction(spark):
    rows = [row(i, prose(i, 30, "abcde" if i % 2 else "defgh"), "x" if i % 2 else "y") for i in range(80)]
    model = langid.fit(docs(spark, rows + [row(900, "abc", None)]), ["▁", *"abcdefgh", "ab", "gh", "▁a", "▁h"])
    got = {r.doc_id: r for r in langid.predict(docs(spark, [row(500, prose(500, 20, "abcde")), row(501, prose(501, 20, "defgh")), row(502, "1234 !"), row(503, None), row(504, "")]), model).collect()}
    assert [got[i].lang_pred for i in range(500, 505)] == ["x", "y", "und", "und", "und"] and got[500].score > 0.9 and got[503].score == 0
    assert langid.predict(docs(spark), model).count() == len(edge_rows())
    nothing = langid.fit(docs(spark, []), ["a"])
    assert {r.lang_pred for r in langid.predict(docs(spark), nothing).collect()} == {"und"}


# Operator 9.

def test_trees_and_pairs():
    g, h = np.array([1.0, 1, -1, -1, 5]), np.ones(5)
    assert np.allclose(quality_gam.tree(g, h, 3), [2 / 3, 2 / 3, -2 / 3, -2 / 3, 5 / 2])
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality_gam.fit_arrays(x, y)
    assert (0, 1) in model.pairs and (((model.log_odds(x) > 0) == y).mean()) > 0.97


def test_quality_scores(spark):
    rows = [row(i, prose(i, 30) if i % 3 else prose(i, 30).replace(" ", "$$$ ")) for i in range(300)]
    marks = labels(spark, [(i, int(i % 3 > 0), 0, "x") for i in range(0, 300, 2)] + [(None, 1, 0, None), (7, None, None, None)])
    got = {r.doc_id: r.score for r in quality_gam.classify(docs(spark, rows + edge_rows()[2:5]), marks, F.col("doc_id") % 5 != 0).collect()}
    assert sum((got[i] > 0.5) == (i % 3 > 0) for i in range(10, 300)) / 290 > 0.97 and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in quality_gam.classify(docs(spark), labels(spark, []), F.lit(True)).collect()} == {0.5}
    assert quality_gam.classify(docs(spark, []), marks, F.lit(True)).collect() == []


# Operator 1.

def letter_model(words):
    tally = collections.Counter(toxicity.grams(pa.array([w for w in words for _ in range(50)]), 3, True)[0].tolist())
    return memoryview(toxicity.letter_costs(np.array(list(tally)), np.array(list(tally.values()))))


def test_deobfuscation():
    model = letter_model("the idiot and a moron are losers of this thing that ended in another idiot and the loser die hate ass kill all hello".split())
    for shown, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("idiiiot", "idiot"), ("L0$er", "loser"), ("plain words", "plain words"), ("and *** % the", "and *** % the"),
                         ("i-d-i-o-t", "idiot"), ("di3", "die"), ("hat3", "hate"), ("a55", "ass"), ("a$$", "ass"), ("kil1", "kill"), ("id" + "1" * 40 + "iot", "idiot"), ("d i e", "die"), ("i/d/i/o/t", "idiot"),
                         ("i\td\ti\to\tt", "idiot"), ("i   d   i   o   t", "idiot"), ("i\nd\ni\no\nt", "idiot"), ("iiddiioott", "idiot"), ("h@te", "hate"), ("h@te!", "hate"), ("hello", "hello"), ("all the", "all the")):
        assert toxicity.restore(model, f"hm {shown} so")[3:-3] == meant, shown
    assert toxicity.restore(model, "") == "" and toxicity.restore(model, " \n 12 \n") == " \n 12 \n"
    assert toxicity.restore(model, "i" * 30_000 + "diot") == "idiot" and len(toxicity.restore(model, "1 d " * 5_000)) > 0


@given(st.text(alphabet="idot10!*$ é", min_size=1, max_size=6), st.booleans())
@settings(max_examples=150, deadline=None)
def test_decoding_is_the_cheapest_of_all_readings(s, parted):
    model = letter_model("idiot dot too it toad".split())

    def price(text):  # of the words of a reading, letter by letter
        total = 0.0
        for w in text.split():
            total += sum(model[g] for g in toxicity.grams(pa.array([w]), 3, True)[0].tolist())
        return total

    def cost(way):
        return sum(x for x, _ in way) + price("".join(c for _, c in way))

    s = s if parted else s.replace(" ", "")  # white space is in lattices of single letters only
    ways = list(itertools.product(*toxicity.readings(s, parted)))
    got = toxicity.decode(model, s, parted)
    of_got = min(cost(w) for w in ways if "".join(c for _, c in w).split() == got.split())
    assert abs(of_got - min(map(cost, ways))) < 1e-3


def test_decoding_ties_and_words_of_restored_texts():
    flat = memoryview(np.ones(toxicity.MODEL_SYMBOLS ** 4, np.float32))  # every reading of a look-alike costs the same
    assert toxicity.decode(flat, "x1x") == "xix" == toxicity.decode(flat, "x1x") and toxicity.decode(flat, "x*x") == "xax"
    model = letter_model("the idiot and a moron are die hate".split())
    texts = ["The 1d10t, m0r0n!", None, "", "a  d i e b", "x " * 4 + "the", "h@te " * 3, "plain words", "D.I.E now", "-- - -", "a\u00a0b i d i o t"]
    words, text, word, number = toxicity.restored_words(model, pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()), "")), {})
    got = collections.defaultdict(list)
    for t, w in zip(text.tolist(), word.tolist()):
        got[t].append(words[w].as_py())
    for k, t in enumerate(texts):
        assert sorted(got[k]) == sorted(toxicity._letters(toxicity.restore(model, t or ""))), t
    assert number[0] == 2 and number[5] == 3 and number[6] == 0 and number[1] == number[2] == 0


def test_disguised_documents_change_their_score(spark):
    rows = [row(i, prose(i, 30) + (" zqidjot wxmoronk" if i % 4 == 0 else "")) for i in range(200)]
    shown = ["zq1dj0t", "z q i d j o t", "zqiiiidjot", "z-q-i-d-j-o-t", "zq!dj0t", "z\tq\ti\td\tj\to\tt", "wxm0r0nk", "w/x/m/o/r/o/n/k", "wwxxmmoorroonnkk"]
    rows += [row(1000 + i, prose(1000 + i, 20) + f" {s} and") for i, s in enumerate(shown)] + [row(2000, prose(2000, 20) + " and")]
    rows += [row(3000, None), row(3000, "zqidjot"), row(3001, "q" * 50_000 + " zq1dj0t")]
    marks = labels(spark, [(i, 1, int(i % 4 == 0), "x") for i in range(200)] + [(3000, 1, 1, None), (3000, 1, 0, None)])
    got = {(r.doc_id, r.score >= 0.3) for r in toxicity.classify(docs(spark, rows), marks, F.lit(True)).collect()}
    assert {(1000 + i, True) for i in range(len(shown))} <= got and (2000, False) in got and (3001, True) in got
    assert {(3000, True), (3000, False)} <= got  # rows that share an id are scored each


def test_toxicity_scores(spark):
    bad = ["zqidjot", "wxmoronk", "vyscumq"]
    rows = []
    for i in range(400):
        w = prose(i, 30).split()
        if i % 4 == 0:
            w[3], w[9] = bad[i % 3], bad[(i + 1) % 3]
        rows.append(row(i, " ".join(w)))
    rows += [row(1000, prose(1000, 20) + " zq1dj0t wxm0ronk"), row(1001, prose(1001, 20) + " v y s c u m q z"), row(1002, prose(1002, 20))]
    marks = labels(spark, [(i, 1, int(i % 4 == 0), "x") for i in range(0, 400) if i % 5] + [(None, 1, 1, None), (3, 1, None, None)])
    got = {r.doc_id: r.score for r in toxicity.classify(docs(spark, rows + edge_rows()[2:5]), marks, F.lit(True)).collect()}
    assert sum((got[i] >= 0.3) == (i % 4 == 0) for i in range(10, 400)) / 390 > 0.97
    assert got[1000] >= 0.3 and got[1001] >= 0.3 and got[1002] < 0.3 and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in toxicity.classify(docs(spark), labels(spark, []), F.lit(True)).collect()} == {0.0}
    assert toxicity.classify(docs(spark, []), marks, F.lit(True)).collect() == []


# Operator 5.

PAGE = """<html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home page link</a></li></ul></nav><div id="cookie-notice">We use cookies on this site, do you agree to this?</div>
<div class="wrap">%s<aside class="sidebar"><p>Side text of some length here</p></aside><div class="ad">Buy this now for little money</div></div>
<section id="comments"><p>First comment, with a text as long as a paragraph of the article itself, to fool ratios.</p></section><footer>&copy; Site</footer></body></html>"""
BODY = """<h2>Title &amp; more</h2><p>A long  paragraph\n of the main text &eacute; &#233;, which goes on for a while.</p><p>Short.</p><form><label>Mail</label><input></form><p><b>Bold<br>next line and
an unclosed tag that goes on for some time</p><ul><li>One</li><li>Two</li></ul>"""
TEXT = "Title & more\nA long paragraph of the main text é é, which goes on for a while.\nShort.\nBold next line and an unclosed tag that goes on for some time\nOne\nTwo"


@pytest.mark.parametrize("wrapped", ["<article>%s</article>", "<main>%s</main>", "<div class='post'>%s</div>", "<section>%s</section>"])
def test_main_text(wrapped):
    assert html_extract.extract(PAGE % (wrapped % BODY)) == TEXT


def test_main_text_edge_cases(spark):
    assert [html_extract.extract(x) for x in (None, "", "plain &lt; text", "<p>a<p>b", "<nav>x</nav>", "<script>x", "<<>><p>ok</b></i>", "<nav><ul><li>menu<article><p>text</p></article>")] == ["", "", "plain < text", "a\nb", "", "", "<<>>\nok", "text"]
    pages = spark.createDataFrame([(1, "u", PAGE % BODY, "c"), (1, "u", PAGE % BODY, "c"), (2, None, None, "c"), (None, "v", "<p>x</p>", "c"), (3, "w", "<p>" + "word " * 200_000, "c")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", len(r.text)) for r in html_extract.extract_pages(pages).collect())
    assert got == [(0, "v", 1), (1, "u", len(TEXT)), (1, "u", len(TEXT)), (2, "", 0), (3, "w", 999_999)]
    assert html_extract.extract_pages(pages.limit(0)).collect() == []


def test_main_text_is_whole():
    long, part = "Words of the main text go on and on. " * 20, "The smaller part of the text has some words as well. " * 3
    for body in ("<div id=post><h1>A title that heads the whole of the entry</h1><div class=entry><p>%s</p><p>%s</p></div></div>",
                 "<h1>A title that heads the whole of the entry</h1><p>%s</p><ul><li>%s</li></ul>",
                 "<h1>A title that heads the whole of the entry</h1><div><p>%s</p></div><div><p>%s</p></div>",
                 "<article><h1>A title that heads the whole of the entry</h1><p>%s</p></article><article><p>%s</p></article>"):
        for one, two in ((long, part), (part, long)):
            page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{body % (one, two)}<footer>Site</footer></body></html>"
            assert html_extract.extract(page) == f"A title that heads the whole of the entry\n{one.strip()}\n{two.strip()}"
    split = f"<div>{f'<p>{part}</p>' * 17}</div><div>{f'<p>{part}</p>' * 3}</div>"
    assert html_extract.extract(f"<html><body><nav>Home</nav>{split}</body></html>") == "\n".join([part.strip()] * 20)
    teasers = f"<aside><article><p>{long}</p></article><article><p>{part}</p></article></aside>"
    assert html_extract.extract(f"<body><article><p>{part}</p></article>{teasers}</body>") == part.strip()


def test_smoothing_finds_the_cluster():
    ratios = np.array([2.0, 1, 3, 2, 80, 4, 90, 120, 70, 3, 2, 1, 2, 3])
    assert html_extract.content_lines(ratios).tolist() == [False] * 3 + [True] * 6 + [True] + [False] * 4


def test_clusters_choose_the_region(monkeypatch):
    long, part = "Words of the main text go on and on. " * 20, "The smaller part of the text has some words as well. " * 3
    # The body is no article; the article is a card beside it.
    card = f"<body><article><p>Short card</p></article><div id=content><h1>Title</h1><p>{long}</p><p>{part}</p></div></body>"
    assert html_extract.extract(card).endswith(f"Title\n{long.strip()}\n{part.strip()}")
    # A name that only begins like furniture, a list of links, a teaser after the article.
    links = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(6))
    page = f"<body><article><h1>Title</h1><p>{long}</p><section class='notice-of-results'><p>{part}</p></section><ul>{links}</ul><p>{part}</p></article>%s</body>"
    assert html_extract.extract(page % "") == f"Title\n{long.strip()}\n{part.strip()}\n{part.strip()}"
    rest = "".join(f"<div><span><b><i>{k}</i></b></span></div>" for k in range(5))
    teaser = rest + "<article><p><a href='/n'><b>Next</b></a></p></article>"
    assert html_extract.extract(page % teaser) == html_extract.extract(page % "")
    # Lists of words, and links inside sentences, stay.
    keep = f"<body><article><p>{long}</p><ul><li>One</li><li>Two</li><li><a href='/'>Three</a></li></ul></article></body>"
    assert html_extract.extract(keep) == f"{long.strip()}\nOne\nTwo\nThree"
    # Scripts and buttons inside a line are no part of it.
    inline = f"<html><head><title>T</title><style>p{{}}</style></head><body><p>{long}<script>var x;</script><button>Share</button> end</p></body></html>"
    assert html_extract.extract(inline) == f"{long.strip()} end"
    whole = html_extract.extract(page % teaser)
    for answer in (False, True):
        monkeypatch.setattr(html_extract, "content_lines", lambda r, a=answer: np.full(len(r), a))
        assert html_extract.extract(page % teaser) != whole


def brute_smooth(ratios, sigma, threshold):
    mean = sum(ratios) / len(ratios)
    std = math.sqrt(sum((x - mean) ** 2 for x in ratios) / len(ratios))
    reach = math.ceil(3 * sigma)
    out = []
    for i in range(len(ratios)):
        near = [(math.exp(-0.5 * ((j - i) / sigma) ** 2), ratios[j]) for j in range(max(0, i - reach), min(len(ratios), i + reach + 1))]
        out.append(sum(w * x for w, x in near) / sum(w for w, _ in near) >= threshold * std)
    return out


@settings(max_examples=60, deadline=None)
@given(ratios=st.lists(st.floats(0, 300), min_size=1, max_size=40), sigma=st.sampled_from([0.5, 1.0, 2.0]))
def test_clusters_against_brute_force(ratios, sigma):
    got = html_extract.content_lines(np.array(ratios), sigma, 0.5)
    want = brute_smooth(ratios, sigma, 0.5)
    assert sum(a != b for a, b in zip(got, want)) <= (1 if len(set(ratios)) > 1 else len(ratios))  # equal to rounding


def test_given_pages_follow_the_clusters(monkeypatch):
    import pyarrow.parquet as pq
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column(0).to_pylist()
    texts = list(map(html_extract.extract, pages))
    monkeypatch.setattr(html_extract, "content_lines", lambda r: np.zeros(len(r), bool))
    assert sum(a != html_extract.extract(p) for a, p in zip(texts, pages)) > len(pages) / 2
