"""Shards along a Hilbert curve: the curve, the laws, files that filters skip, odd tables."""

import itertools
import math
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import hilbert_shards, queries, shared

SF = "/root/testdata/sf0.01"


def plain_place(point, bits):
    """Skilling's transform, as published, on a list."""
    x, n, m = list(point), len(point), 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, m
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum((x[i] >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, ", ".join(f"c{i} long" for i in range(n)))
    rows = df.select("*", hilbert_shards.hilbert([F.col(c) for c in df.columns], bits).alias("at")).collect()
    assert all(r["at"] == plain_place(r[:n], bits) for r in rows)
    order = sorted(rows, key=lambda r: r["at"])
    assert [r["at"] for r in order] == list(range(len(points)))
    # Neighbours on the curve are neighbours in space.
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in itertools.pairwise(order))


def sizes(rows):
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r)
    return out


def test_query(spark):
    rows = queries.queries()["op11_hilbert_shards"](spark, SF).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in shared.table(spark, SF, "documents").collect()}
    assert len(rows) == len(docs) and all((r["size"], r.text_crc32) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id])) for r in rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    by = sizes(rows)
    assert sorted(by) == list(range(8))
    total, longest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in own) - total / 8) <= longest for own in by.values())
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    again = queries.queries()["op11_hilbert_shards"](spark, SF).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_files_are_skipped(spark, tmp_path):
    docs = shared.table(spark, SF, "documents").drop("text").withColumn("text", F.lit("x" * 100)).unionByName(shared.table(spark, SF, "documents").limit(0))
    docs = spark.range(4).crossJoin(docs).drop("id").withColumn("doc_id", F.xxhash64("doc_id", F.rand(3)) % 100_000)
    dims = ["lang", "n_chars", "doc_id"]
    hilbert_shards.write(docs, f"{tmp_path}/c", dims, shards=4, file_bytes=4_000)
    rows = hilbert_shards.read(spark, f"{tmp_path}/c", docs.schema)
    files = hilbert_shards.boxes(rows, dims).collect()
    assert sum(f.rows for f in files) == docs.count() and len(files) > 90
    # A third of the values of each of two dimensions meets about a ninth of the rows, and few files more.
    a, b = (sorted(r[0] for r in docs.select(c).collect()) for c in ("n_chars", "doc_id"))
    low = {"n_chars": a[len(a) // 3], "doc_id": b[len(b) // 3]}
    high = {"n_chars": a[2 * len(a) // 3], "doc_id": b[2 * len(b) // 3]}
    met = [f for f in files if all(f[f"low_{d}"] <= high[d] and f[f"high_{d}"] >= low[d] for d in low)]
    assert len(met) < 0.5 * len(files)
    inside = lambda df, at: df.filter(" and ".join(f"{at}{d} between {low[d]} and {high[d]}" for d in low))
    kept = inside(rows, "row.")
    assert kept.count() == inside(docs, "").count() and "PushedFilters" in kept._jdf.queryExecution().toString()
    assert len(spark.read.parquet(f"{tmp_path}/c").filter("shard = 2").inputFiles()) <= len(files)


ODD = [(None, None, None, None), (None, "", "", math.nan), (1, "é", "src", math.inf), (1, "é", "src", -math.inf), (2, "x" * 200_000, "src1", 0.5), *[(3, "same", "srcx", 7.0)] * 40]


@pytest.mark.parametrize(("law", "shards"), [("rows", 7), ("bytes", 3), ("rows", 100)])
def test_odd_tables(spark, tmp_path, law, shards):
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(ODD)], "doc_id long, text string, source string, score double, shard int, at string").repartition(3)
    hilbert_shards.write(docs, f"{tmp_path}/c", ["source", "score"], shards=shards, law=law, file_bytes=50)
    rows = hilbert_shards.read(spark, f"{tmp_path}/c", docs.schema)
    found = hilbert_shards.digest(rows, law).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in found) == sorted((str(r[0]), len((r[1] or "").encode()) + 1) for r in ODD)
    by = sizes(found)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    if law == "rows":
        counts = [len(by.get(i, [])) for i in range(shards)]
        assert max(counts) - min(counts) <= 1
    assert rows.filter("row.shard = 4 and row.at = 'x'").count() == 1
    hilbert_shards.write(docs.limit(0), f"{tmp_path}/e", ["source", "score"], shards=shards, law=law)
    assert hilbert_shards.digest(hilbert_shards.read(spark, f"{tmp_path}/e", docs.schema), law).count() == 0
