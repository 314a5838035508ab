"""Repeated passages against brute force over all windows."""

import hashlib
import random
from collections import defaultdict

import pytest

from factloom.llm import suffix_dedup


def brute_force(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] += 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(30) for _ in range(4)]
    texts = [prose(rnd.randint(0, 60)) for _ in range(30)]
    for _ in range(60):
        p = rnd.choice(passages)
        a, b = sorted(rnd.sample(range(len(p) + 1), 2))
        texts.append(prose(rnd.randint(0, 20)) + p[a:b] + prose(rnd.randint(0, 20)))
    for _ in range(20):  # near copies
        t = list(rnd.choice(texts))
        for _ in range(rnd.randint(0, 2)):
            if t:
                t[rnd.randrange(len(t))] = "z"
        texts.append("".join(t))
    return texts + [None, "", "ab" * 200, "ab" * 150 + "c", "a" * 300, texts[0], texts[3], texts[3], " " * 90]


@pytest.mark.parametrize(("seed", "length", "segment"), [(1, 24, 1 << 20), (2, 33, 150), (3, 8, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, seed, length, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 5)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, first string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(texts, length)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x" * 50, 1), (None, "x" * 50, 2), (7, "y" * 10, 3), (7, None, 4)], "doc_id long, text string, name long")
    rows = suffix_dedup.digest(docs, 20).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 50, 50), (0, 50, 50), (7, 0, 0), (7, 10, 0)]
    kept = suffix_dedup.remove_repeats(docs, 20)
    assert kept.columns == docs.columns
    assert sorted((r["name"], r["text"]) for r in kept.collect() if r["text"] is not None) == [(1, ""), (2, ""), (3, "y" * 10)]
    assert suffix_dedup.digest(docs.limit(0), 20).count() == 0
