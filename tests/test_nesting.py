"""Nested spans at many positions, against loops over all spans of a file."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import nesting


def made(seed, files=3, most=60):
    """Nested spans of some files, with equal, touching and empty ones, and positions."""
    rnd, spans, points = random.Random(seed), [], []

    def split(uri, low, high, depth):
        spans.append((uri, low, high, len(spans), "x"))
        if rnd.random() < 0.2:
            spans.append((uri, low, high, len(spans), "x"))
        cuts = sorted(rnd.randint(low, high) for _ in range(rnd.randint(0, 4)))
        for a, b in zip(cuts[::2], cuts[1::2], strict=False):
            if depth < 5:
                split(uri, a, b, depth + 1)

    for f in range(files):
        split(f"f{f}", 0, most, 0)
        split(f"f{f}", most, 2 * most, 0)
        points += [(f"f{f}", rnd.randint(-2, 2 * most + 2), i, "p") for i in range(80)]
    return spans, [*points, (None, 3, 0, "p"), ("f0", None, 0, "p"), ("none", 3, 0, "p")]


SPANS, POINTS = "uri string, sb int, eb int, id int, name string", "uri string, at int, n int, name string"


@pytest.mark.parametrize("seed", [1, 2])
def test_many_positions(spark, seed):
    spans, points = made(seed)
    s, p = spark.createDataFrame(spans, SPANS).repartition(3), spark.createDataFrame(points, POINTS).repartition(3)

    def holding(u, at, inclusive=False):
        found = [x for x in spans if x[0] == u and at is not None and x[1] <= at and (at < x[2] or (inclusive and at == x[2]))]
        return [x[3] for x in sorted(found, key=lambda x: (x[2] - x[1], x[3]))]

    for inclusive in (False, True):
        rows = nesting.innermost(p, s, ["uri"], "at", ties=["id"], inclusive_end=inclusive).collect()
        wanted = sorted((u, at, n, h[0]) for u, at, n, _ in points if (h := holding(u, at, inclusive)))
        assert sorted((r.uri, r["at"], r.n, r.id) for r in rows) == wanted
        assert {r.name for r in rows} == {"p"}
    rows = nesting.around(p, s, ["uri"], "at", ties=["id"]).collect()
    assert sorted((r.uri, r["at"], r.n, r.up, r.id) for r in rows) == sorted((u, at, n, i, x) for u, at, n, _ in points for i, x in enumerate(holding(u, at)))
    full = [x for x in spans if x[1] < x[2]]
    rows = {r.id: r for r in nesting.parents(s, ["uri"], ties=["id"]).collect()}
    for u, a, b, i, _ in full:
        outer = sorted((y[2] - y[1], y[3]) for y in full if y[0] == u and y[1] <= a and b <= y[2] and (y[2] - y[1], y[3]) > (b - a, i))
        assert (rows[i].parent.id if rows[i].parent else None) == (outer[0][1] if outer else None) and rows[i].level == len(outer) + 1
    assert len(rows) == len(full) and nesting.crossing(s, ["uri"]).count() == 0


def test_crossing_and_empty(spark):
    crossed = spark.createDataFrame([("f", 0, 5, 1, ""), ("f", 3, 8, 2, "")], SPANS)
    assert [r.id for r in nesting.crossing(crossed, ["uri"]).collect()] == [2]
    none, points = crossed.limit(0), spark.createDataFrame([("f", 1, 1, "")], POINTS)
    assert nesting.innermost(points, none, ["uri"], "at").count() == 0
    assert nesting.around(points.limit(0), crossed.filter("id = 1"), ["uri"], "at").count() == 0


def test_one_large_file(spark):
    """10^5 spans and 10^5 positions of one file, in chunks; no step joins them by the file."""
    n = 100_000
    # Span k holds its children 2k and 2k + 1 of a halving tree.
    level = F.floor(F.log2(F.col("id").cast("double"))).cast("int")
    width = F.call_function("shiftright", F.lit(1 << 20), level)
    spans = spark.range(1, n + 1).select(F.lit("f").alias("uri"), "id", ((F.col("id") - F.call_function("shiftleft", F.lit(1).cast("long"), level)) * width).alias("sb"), width.alias("w")).withColumn("eb", F.col("sb") + F.col("w"))
    points = spark.range(n).select(F.lit("f").alias("uri"), (F.col("id") * 7919 % (1 << 20)).alias("at"))
    found = nesting.innermost(points, spans, ["uri"], "at")
    # The deepest node whose span holds the position, by arithmetic.
    deep = F.shiftright(F.lit(1 << 20) + F.col("at"), 4)
    wanted = F.when(deep <= n, deep).otherwise(F.shiftright(deep, 1))
    assert found.count() == n and found.filter(F.col("id") != wanted).count() == 0
    chain = spark.range(n).select(F.lit("f").alias("uri"), F.col("id").alias("sb"), (2 * n - F.col("id")).alias("eb"))
    deepest = nesting.parents(chain, ["uri"]).agg(F.max("level").alias("deep"), F.sum(F.when(F.col("parent.sb") == F.col("sb") - 1, 1).otherwise(0)).alias("right")).first()
    assert (deepest.deep, deepest.right) == (n, n - 1)
