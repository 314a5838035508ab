"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from factloom.llm import simhash


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


TEXTS = [None, "", " \t\n", "one", "One two", "a b c d e", "A B C d E", "É b c\x0bd", "a a a a a a", "\xa0x y z"]


def test_fingerprints(spark):
    rnd = random.Random(4)
    texts = TEXTS + [" ".join(rnd.choice(["x", "y", "Z", "ü"]) for _ in range(rnd.randint(0, 50))) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("lanes", [2, 4, 8])
def test_links(spark, monkeypatch, lanes):
    monkeypatch.setattr(simhash, "MORE_LANES", ((0, lanes),))
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "STRIP", 3)
    rnd = random.Random(lanes)
    fps = [rnd.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 3, 1]
    for _ in range(240):
        fp = rnd.choice(fps)
        for _ in range(rnd.randint(0, 3)):
            fp ^= 1 << rnd.randrange(64)
        fps.append(fp)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.components(simhash.links(nodes, len(fps), 2)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(roots.get(f, f), set()).add(f)
    wanted = {}
    for f, c in zip(fps, brute_components(fps), strict=True):
        wanted.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 301)) and roots[1001] == 1000


def test_odd_rows(spark):
    docs = spark.createDataFrame([(5, None, 1), (None, "", 2), (7, "a b c", 3), (7, "a b c", 4), (9, "A b C", 5), (None, "q r s", 6)], "doc_id long, text string, fp long")
    rows = sorted(((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect()))
    assert rows == [(0, 0), (0, 5), (5, 5), (7, 7), (7, 7), (9, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(spark):
    docs = spark.createDataFrame([(7, "a b c", 1), (5, "A b c", 2), (None, "a b c", 3), (8, "q r s", 4), (8, "q r s", 4), (None, "x y z w", 5)], "doc_id long, text string, _row long").withColumnRenamed("doc_id", "doc_id")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["_row"]) for r in kept.collect()) == [(0, 5), (5, 2), (8, 4)]
    assert simhash.keep_one(docs.limit(0)).count() == 0
