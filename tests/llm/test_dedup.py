import random
import re

import numpy as np
import pytest
import xxhash

from equilens.llm import embedding_dedup, simhash_dedup
from equilens.llm.components import connected_components

from .helpers import UnionFind, docs, prose, row


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 3)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100)],
                                   [(random.Random(5).randrange(0, 90), random.Random(i).randrange(0, 90)) for i in range(60)]])
def test_components_against_union_find(spark, links):
    uf = UnionFind()
    for a, b in links:
        if a is not None and a != b:
            uf.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: uf.find(x) for x in list(uf)}


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rows = [row(i, prose(i, 25 + i % 9)) for i in range(20, 40)]
    long = prose(99, 3000).split()
    for i in range(40, 70):  # near copies of one long text
        w = list(long)
        w[i * 7] = "changed"
        rows.append(row(i, " ".join(w)))
    rows += docs(spark).collect()
    got = simhash_dedup.simhash_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = [brute_fingerprint(r[1]) for r in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1)) for r in got) == sorted((r[0] is None, r[0] or 0, f) for r, f in zip(rows, fp))
    uf = UnionFind()
    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 3:
                uf.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[uf.find(i)] = min(least.get(uf.find(i), r[0]), r[0])
    want = sorted(str((rows[i][0], least.get(uf.find(i)))) for i in range(len(rows)))
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == want
    kept = simhash_dedup.keep_one(docs(spark, rows)).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted(set(least.values()))
    assert sum(r.doc_id is None for r in kept) == sum(r[0] is None for r in rows)


def test_simhash_decides_per_row(spark):
    a, b, c = (prose(k, 400) for k in (201, 202, 203))
    near = " ".join(w if k != 7 else "changed" for k, w in enumerate(a.split()))
    assert 0 < bin(brute_fingerprint(a) ^ brute_fingerprint(near)).count("1") <= 3
    rows = [row(5, a), row(5, b), row(3, b), row(9, near), row(None, c), row(None, c), row(None, c, "de"), row(None, a), row(None, None), row(None, "")]
    kept = simhash_dedup.keep_one(docs(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept if r.text) == sorted(str(x) for x in [(5, a), (3, b), (None, c)])
    assert sum(not r.text for r in kept) == 1
    # An id that repeats does not connect the texts it stands on.
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in simhash_dedup.simhash_dedup(docs(spark, [row(5, a), row(5, b), row(3, near)])).collect()}
    assert got == {(5, brute_fingerprint(a)): 3, (5, brute_fingerprint(b)): 5, (3, brute_fingerprint(near)): 3}


def test_simhash_empty_table(spark):
    assert simhash_dedup.simhash_dedup(docs(spark, [])).collect() == []
    assert simhash_dedup.keep_one(docs(spark, [])).collect() == []


@pytest.mark.parametrize("max_bits", [0, 1, 3])
def test_trie_pairs_against_all_pairs(max_bits):
    rng = np.random.default_rng(max_bits)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, np.arange(200, dtype=np.uint64)]))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= max_bits}
    t = simhash_dedup.Trie(fps)
    found = [p for i, j in simhash_dedup.near_pairs(t, t, 0, max_bits) for p in zip(i.tolist(), j.tolist())]
    assert len(found) == len(set(found)) and set(found) == want


def linked(spark, fps, max_bits, heavy):
    classes = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "node long, fp long")
    uf = UnionFind()
    for r in simhash_dedup.trie_links(classes, max_bits, heavy).collect():
        assert (r.a ^ r.b) & (2**64 - 1)
        uf.join(r.a, r.b)
    return {x: uf.find(x) for x in fps.view(np.int64).tolist()}


@pytest.mark.parametrize("max_bits,heavy", [(0, 4), (1, 8), (2, 8), (3, 10**6), (3, 8)])
def test_rotations_and_cut_units_against_all_pairs(spark, max_bits, heavy):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 1 + k % 5, replace=False)) for k in range(200)], np.uint64)
    crowd = (np.uint64(0xABCD) << np.uint64(48)) | rng.integers(0, 2**30, 150, dtype=np.uint64)  # one prefix
    fps = np.unique(np.concatenate([base, base ^ flips, crowd, np.arange(60, dtype=np.uint64), ~np.arange(20, dtype=np.uint64)]))
    uf = UnionFind()
    signed = fps.view(np.int64).tolist()
    for i in range(len(fps)):
        uf.find(signed[i])
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= max_bits):
            uf.join(signed[i], signed[j])
    assert linked(spark, fps, max_bits, heavy) == {x: uf.find(x) for x in signed}


def test_many_fingerprints_under_one_prefix(spark, monkeypatch):
    rng = np.random.default_rng(12)
    fps = np.unique((np.uint64(0x1234) << np.uint64(48)) | rng.integers(0, 2**48, 100_000, dtype=np.uint64))
    pairs = fps[:500] ^ np.uint64(0x400000800001)
    fps = np.unique(np.concatenate([fps, pairs]))
    classes = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "node long, fp long")
    units = simhash_dedup._units(classes, 3, 5_000)
    assert units.groupBy("path", "key").count().agg({"count": "max"}).first()[0] <= 5_000
    assert units.groupBy("node").count().agg({"count": "max"}).first()[0] <= 4 * 4  # copies: four, and four for each heavy unit
    got = linked(spark, fps, 3, 5_000)
    for x in pairs.view(np.int64).tolist():
        assert got[x] == got[int(np.int64(x) ^ np.int64(0x400000800001))]


def brute_embeddings(rows, cosine=0.98):
    ok = [v is not None and l is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, l in rows]
    uf, links = UnionFind(), [0] * len(rows)
    for i in range(len(rows)):
        uf.find(i)
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    uf.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[uf.find(i)] = min(least.get(uf.find(i), r[0]), r[0])
    return sorted(str((r[0], links[i], least.get(uf.find(i)), r[0] is not None and r[0] == least.get(uf.find(i)))) for i, r in enumerate(rows))


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 8)  # many chunks and axes also on this small table
    rng = np.random.default_rng(3)
    rows, centre = [], rng.standard_normal((6, 16))
    for i in range(150):
        v = centre[i % 6] + rng.standard_normal(16) * 0.12 if i % 3 else rng.standard_normal(16)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    nan, inf = float("nan"), float("inf")
    rows += [(200, rows[1][1], 1), (201, rows[1][1], 1), (201, rows[1][1], 1), (202, rows[1][1], None), (203, None, 1), (204, [], 1), (205, [0.0] * 16, 1), (206, [nan] + [1.0] * 15, 1),
             (207, [inf] + [1.0] * 15, 1), (208, [None] + [1.0] * 15, 1), (209, rows[1][1][:8], 1), (None, rows[1][1], 1), (None, None, None), (210, [x * 1e-30 for x in rows[1][1]], 1)]
    rows[-1] = (210, [float(np.float32(x * 1e-10)) for x in rows[1][1]], 1)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = embedding_dedup.embedding_dedup(df).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == brute_embeddings(rows)
    assert embedding_dedup.embedding_dedup(df.limit(0)).collect() == []
