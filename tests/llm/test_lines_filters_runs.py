"""Line runs (11), filter audit (12) and periodic runs (13) against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.llm import filter_audit, line_runs, periodic_runs

from .helpers import docs, labels, prose, row

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# -- 11 -------------------------------------------------------------------------------


def brute_lines(rows, least_chars=40, least_docs=5):
    """(id, text) rows -> (id, lines, dropped, text) of each."""
    seen = defaultdict(list)
    for k, (i, text) in enumerate(rows):
        for key in {low(x.strip(BLANK)) for x in (text or "").split("\n")}:
            if len(key) >= least_chars:
                seen[key].append(i)
    none = float("-inf")
    top = {k: max(none if i is None else i for i in v) for k, v in seen.items() if len(v) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := low(x.strip(BLANK))) not in top or top[k] == (none if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows(seed, n):
    r = random.Random(seed)
    pool = [prose(k, 9) + "é漢"[k % 2] for k in range(25)]
    pool += [p.upper() for p in pool[:5]] + [" \t" + p + "\x0b " for p in pool[:8]] + ["short", "", "  "]
    rows = [(k + 1, "\n".join(r.choices(pool, k=r.randint(0, 12))) if k % 9 else None) for k in range(n)]
    return rows + [(n + 1, pool[0]), (n + 1, pool[0] + "\nother"), (None, pool[1]), (None, pool[1] + "\n" + prose(99, 20)), (3, rows[min(2, n - 1)][1] if n else None), (0, "\n" * 5000 + pool[2])]


@pytest.mark.parametrize("seed, n, least_docs", [(1, 60, 5), (2, 40, 3), (4, 15, 1)])
def test_lines_against_brute_force(spark, seed, n, least_docs):
    rows = line_rows(seed, n)
    table = docs(spark, [row(i, t) for i, t in rows])
    got = line_runs.dedup_lines(table, least_docs=least_docs, batches=5).collect()
    by = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got), key=by) == sorted(brute_lines(rows, least_docs=least_docs), key=by)


def test_lines_edge_rows_and_empty_table(spark):
    got = line_runs.dedup_lines(docs(spark)).collect()
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    by = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got), key=by) == sorted(brute_lines(rows), key=by)
    assert line_runs.dedup_lines(docs(spark, [])).collect() == []


def test_largest_id_keeps_its_lines_and_a_fifth_document_is_needed(spark):
    line = "The same passage, forty code points or more."
    four = line_runs.dedup_lines(docs(spark, [row(i, f"{line}\nown {i}") for i in range(4)])).collect()
    assert {r.n_dropped for r in four} == {0}
    five = line_runs.dedup_lines(docs(spark, [row(i, f"{line}\nown {i}\n {line.upper()} ") for i in range(5)])).collect()
    assert {r.doc_id: r.text for r in five} == {**{i: f"own {i}" for i in range(4)}, 4: f"{line}\nown 4\n {line.upper()} "}


def test_store_levels_hold_each_hash_once(spark):
    """Eleven batches: levels compact, every hash is in one run, counts add up."""
    r = random.Random(6)
    batches = [{r.randrange(300): (r.randint(1, 3), r.randrange(1000)) for _ in range(60)} for _ in range(11)]
    store = line_runs.LineRuns(spark, fanout=3, buckets=4)
    try:
        for b in batches:
            store.add(spark.createDataFrame([(h, h * 7, n, t) for h, (n, t) in b.items()], "h long, h2 long, n long, top long"))
        assert [len(x) for x in store.levels] == [2, 0, 1]
        held = Counter(x.h for run in store.runs() for x in run.collect())
        assert set(held) == set().union(*batches) and set(held.values()) == {1}
        total, top = Counter(), {}
        for b in batches:
            for h, (n, t) in b.items():
                total[h] += n
                top[h] = max(t, top.get(h, t))
        assert {(x.h, x.top) for x in store.frequent(4).collect()} == {(h, top[h]) for h, n in total.items() if n >= 4}
        plan = store.runs()[0].join(store.runs()[1].select("h", "h2").hint("merge"), ["h", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # both sides are read bucket by bucket
    finally:
        store.drop()


# -- 12 -------------------------------------------------------------------------------


def brute_audit(rows, marks):
    """(id, text, source) rows and {id: (good, toxic)}."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails, parts = [], defaultdict(list)
    for k, (i, text, source) in enumerate(rows):
        t = text or ""
        words = WORD.findall(t)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append({x for x in f if f[x]})
        parts[source or ""].append(k)
    out = {}
    for part, ks in parts.items():
        shapley, here = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = list(ks)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                shapley[f] += len(gone)
                good, toxic = (sum(marks.get(rows[k][0], (0, 0))[x] for k in gone) for x in (0, 1))
                here.append((part, order, step, len(left), len(gone), sum(f in fails[k] for k in ks) - len(gone) - sum(f in fails[k] for k in left),
                             sum(fails[k] == {f} for k in ks), good, toxic))
        for x in here:
            out[x[:3]] = x[3:] + (shapley[x[1][x[2] - 1]],)
    return out


def test_audit_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for k in range(160):
        t = prose(k % 37, r.choice([5, 49, 50, 51, 80]), r.choice(["ab", "abcdefghij"]))
        t = t.upper() if r.random() < .2 else t.title() if r.random() < .2 else t
        rows.append((k // 2 if k % 11 == 0 else k, t + r.choice(["", "", " $", " a|b", "\t\n"]), r.choice(["web", "books", None, ""])))
    rows += [(r_[0], r_[1], r_[3]) for r_ in ((x.doc_id, x.text, x.lang, x.source) for x in docs(spark).collect())]
    mark_rows = [(k, k % 2, k % 3 % 2, "x") for k in range(0, 150, 2)] + [(4, 1, None, "x"), (4, 0, 1, "x"), (None, 1, 1, "x"), (7, None, None, "x")]
    marks = {}
    for i, good, toxic, _ in mark_rows:
        a, b = marks.get(i, (0, 0))
        marks[i] = (max(a, int(good == 1)), max(b, int(toxic == 1)))
    marks.pop(None)
    table = docs(spark, [row(i, t, "en", s) for i, t, s in rows]).withColumn("mask", F.lit("x")).withColumn("part", F.lit("y"))
    got = filter_audit.audit(filter_audit.corpus_masks(table, labels(spark, mark_rows))).collect()
    assert {tuple(x)[:3]: tuple(x)[3:] for x in got} == brute_audit(rows, marks)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_audit_of_an_empty_table_and_of_unlabelled_rows(spark):
    assert filter_audit.audit(filter_audit.corpus_masks(docs(spark, []), labels(spark, []))).collect() == []
    got = filter_audit.audit(filter_audit.corpus_masks(docs(spark, [row(1, None)]), labels(spark, []))).collect()
    assert len(got) == 600 and sum(x.good_lost + x.toxic_lost for x in got) == 0 and all((x.removed == 1) == (x.filter_order[x.step - 1] == "A") for x in got)


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_removal_steps_are_the_first_failed_filter(k):
    fails = np.array([[m >> f & 1 == 1 for f in range(k)] for m in range(1 << k)])
    steps = filter_audit.removal_steps(fails, filter_audit.places("ABCD"[:k]))
    for m in range(1 << k):
        for j, order in enumerate(permutations(range(k))):
            assert steps[m, j] == next((s for s, f in enumerate(order, 1) if m >> f & 1), k + 1)


def test_audit_takes_other_filters(spark):
    masks = spark.createDataFrame([("p", 3, 1, 0), ("p", 1, 0, 0), ("q", 0, 1, 1)], "part string, mask int, good int, toxic int")
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.shapley) for x in filter_audit.audit(masks, "XY").collect()}
    assert got[("p", "XY", 1)] == (0, 2, 0, 1, 1, 3) and got[("p", "YX", 2)] == (0, 1, 1, 1, 0, 3) and got[("p", "XY", 2)] == (0, 0, 1, 0, 0, 1) and got[("q", "YX", 2)] == (1, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        filter_audit.audit(masks, "AA")


# -- 13 -------------------------------------------------------------------------------


def brute_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_row(i, text):
    w = WORD.findall(text or "")
    n = len(w)
    if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    drop = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def repeating(r):
    w = []
    for _ in range(r.randint(0, 5)):
        base = [r.choice("abc") for _ in range(r.randint(1, 40))]
        base = base[:r.randint(1, 6)] * r.randint(1, 9) + base if r.random() < .5 else base
        w += (base * r.randint(1, 7))[:r.randint(1, 260)] + [r.choice("abcd") for _ in range(r.randint(0, 3))]
    return w


def test_find_runs_against_brute_force():
    r = random.Random(5)
    for _ in range(300):
        texts = [repeating(r) for _ in range(r.randint(1, 4))]
        code = np.array([ord(x) for t in texts for x in t], np.int64)
        ends = np.cumsum([len(t) for t in texts])
        want = sorted(((s + o, s + o + size, q) for t, o in zip(texts, ends - [len(t) for t in texts]) for s, size, q in brute_runs(t)), key=lambda x: (x[0], x[2]))
        assert list(zip(*(x.tolist() for x in periodic_runs.find_runs(code, ends)))) == want


def test_run_digests_against_brute_force(spark):
    r = random.Random(8)
    rows = [row(k, r.choice([" ", "\n", "\t "]).join(repeating(r))) for k in range(150)] + [row(k, prose(k, r.randint(1, 300))) for k in range(150, 250)]
    rows += [row(2, None), row(2, "a " * 6), row(2, "a " * 5), row(3, "A a A a A a A a"), row(300, " ".join(f"w{k % 5000}" for k in range(20_500)))]
    keep = [x for x in docs(spark).collect() if len(x.text or "") < 10_000]
    got = periodic_runs.run_digests(docs(spark, rows + keep)).collect()
    by = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(x) for x in got if x.doc_id != 300), key=by) == sorted((brute_row(x[0], x[1]) for x in rows + keep if x[0] != 300), key=by)
    long = next(x for x in got if x.doc_id == 300)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 20_500, 5000, 4100)


def test_periodic_runs_returns_runs_and_text(spark):
    got = {x.doc_id: x for x in periodic_runs.periodic_runs(docs(spark, [row(1, "go " + "x y " * 5 + "stop"), row(2, None), row(3, "x x x x x")])).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 10, 2)] and got[1].collapsed == "go x y stop"
    assert got[2].runs == [] and got[2].collapsed == "" and got[3].collapsed == "x x x x x"
    assert periodic_runs.run_digests(docs(spark, [])).collect() == []


def test_runs_need_four_periods():
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(9, np.int64), np.array([9]), times=3)
