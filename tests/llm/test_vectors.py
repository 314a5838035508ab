"""Exact and approximate vector search against brute force."""

import math
import random

import numpy as np

from factloom.llm import nndescent, topk_kdtree

SCHEMA = "vec_id long, vector array<float>, score double"


def rows(seed, n, width=6):
    rnd = np.random.default_rng(seed)
    out = [(i * 3, rnd.normal(size=width).astype(np.float32).tolist(), 0.0) for i in range(n)]
    same = rnd.normal(size=width).astype(np.float32).tolist()
    out += [(1 + 3 * i, same, 0.0) for i in range(60)]
    out += [(9000, None, 0.0), (9001, [1.0, None, 1.0], 0.0), (9002, [math.nan] * width, 0.0), (9003, [math.inf] * width, 0.0), (9004, [0.0] * width, 0.0), (9005, [1.0, 2.0], 0.0), (9006, [], 0.0), (None, [1.0] * width, 0.0)]
    random.Random(seed).shuffle(out)
    return out


def usable(vector, zero):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector) and (zero or any(vector))


def brute(data, asked, k, score):
    out = set()
    for q, v, *_ in asked:
        found = sorted(((-score(v, w), i) for i, w, *_ in data if i != q))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(found, 1)}
    return out


def test_exact(spark, monkeypatch):
    monkeypatch.setattr(topk_kdtree, "ROWS_PER_LEAF", 8)
    data = rows(1, 400)
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {tuple(r) for r in topk_kdtree.top_k(frame, frame.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), 5, rows_per_shard=70).collect()}
    good = [(i, np.floor(256 * np.array(v, dtype=float)).astype(int).tolist()) for i, v, _ in data if i is not None and usable(v, True)]
    product = lambda v, w: sum(a * b for a, b in zip(v, w, strict=False))
    assert got == brute(good, [g for g in good if g[0] % 5 == 0], 5, product)


def test_exact_few_rows_and_huge_components(spark):
    frame = spark.createDataFrame([(1, [1e30, 1.0], 0.0), (2, [1e30, 2.0], 0.0), (3, [-1e30, 0.5], 0.0)], SCHEMA)
    got = sorted(tuple(r) for r in topk_kdtree.top_k(frame, frame.withColumnRenamed("vec_id", "query_id"), 5).collect())
    top, low = 2**63 - 1, -(2**63)
    assert got == [(1, 1, 2, top), (1, 2, 3, low), (2, 1, 1, top), (2, 2, 3, low), (3, 1, 1, low), (3, 2, 2, low)]
    empty = frame.limit(0)
    assert topk_kdtree.top_k(empty, empty.withColumnRenamed("vec_id", "query_id"), 5).count() == 0


def test_approximate(spark):
    data = rows(2, 1500, 16)
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = nndescent.nearest(frame, frame.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), 20, shard_size=400, beam=64).collect()
    good = [(i, v) for i, v, _ in data if i is not None and usable(v, False)]
    known = dict(good)
    product = lambda v, w: sum(float(a) * float(b) for a, b in zip(v, w, strict=False))
    want = brute(good, [g for g in good if g[0] % 10 == 0], 20, product)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(found & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)
    assert len(got) == len(want)
    for r in got:
        assert abs(r["score"] - product(known[r["query_id"]], known[r["vec_id"]])) < 1e-9
        assert r["vec_id"] != r["query_id"]
    for q in {r["query_id"] for r in got}:
        own = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [o[0] for o in own] == list(range(1, len(own) + 1)) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_approximate_few_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [1.0, 0.0], 0.0), (3, [0.0, 2.0], 0.0)], SCHEMA)
    got = sorted(tuple(r) for r in nndescent.nearest(frame, frame.withColumnRenamed("vec_id", "query_id"), 20).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    empty = frame.limit(0)
    assert nndescent.nearest(empty, empty.withColumnRenamed("vec_id", "query_id"), 20).count() == 0


def test_recall_over_many_shards_of_the_table(spark):
    """The embeddings of sf0.1 in 16 shards, with the production settings, against brute force."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", spark_column("embedding"))
    asked = frame.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = nndescent.nearest(frame, asked, 20, shard_size=320).collect()
    data = [(r["vec_id"], r["vector"]) for r in frame.collect() if usable(r["vector"], False)]
    ids, points = np.array([i for i, _ in data]), np.array([v for _, v in data], dtype=float)
    found: dict = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in found:
        scores = points @ points[ids == q][0]
        order = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hits, total = hits + len(found[q] & set(order)), total + 20
    assert len(found) == sum(i % 100 == 0 for i in ids) and hits >= 0.95 * total


def spark_column(name):
    from pyspark.sql import functions as F

    return F.col(name).alias("vector")


def test_ties_across_shards(spark):
    """Equal products of different vectors in different shards go to the smaller id."""
    data = [(i, [1.0, float(i % 40 - 20) / 8], 0.0) for i in range(400)] + [(1000, [4.0, 0.0], 0.0)]
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    asked = frame.filter("vec_id = 1000").withColumnRenamed("vec_id", "query_id")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(nndescent.nearest(frame, asked, 20, shard_size=8).collect(), key=lambda r: r["rank"])]
    assert got == [(n + 1, n, 4.0) for n in range(20)]
    got = [(r["rank"], r["vec_id"]) for r in sorted(topk_kdtree.top_k(frame, asked, 20, rows_per_shard=30).collect(), key=lambda r: r["rank"])]
    assert got == [(n + 1, n) for n in range(20)]
