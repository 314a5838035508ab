"""Trees numbered along their tours, against a recursive walk."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import tours


def walk(nodes):
    """(by, id): (root, depth, pre, post, size, sum) of nodes (by, id, parent, order, value)."""
    children, known, out = {}, {(b, i) for b, i, *_ in nodes}, {}
    for b, i, p, o, v in nodes:
        children.setdefault((b, p) if (b, p) in known else (b, None), []).append((o, i, v))
    for b in {n[0] for n in nodes}:
        for o, root, v in children.get((b, None), []):
            pre = post = 0

            def visit(i, depth, v, root=root, b=b):
                nonlocal pre, post
                mine, size, total = pre, 1, v
                pre += 1
                for _, c, w in sorted(children.get((b, i), [])):
                    n, s = visit(c, depth + 1, w)
                    size, total = size + n, total + s
                out[b, i] = (root, depth, mine, post, size, total)
                post += 1
                return size, total

            visit(root, 0, v)
    return out


def test_forest(spark):
    rnd, nodes = random.Random(5), []
    for b in ("a", "b"):
        for i in range(150):
            parent = None if i < 3 else 999 if i == 7 else rnd.randrange(i) if i % 4 else 1
            nodes.append((b, i, parent, rnd.randint(0, 3), i * i))
    rnd.shuffle(nodes)
    df = spark.createDataFrame(nodes, "by string, id long, parent long, place int, value long").repartition(3)
    tree = tours.numbered(df, ["by"], ordered_by=["place"])
    rows = tours.subtree_sums(tree, ["by"], "value", "total").collect()
    assert {(r.by, r.id): (r.root, r.depth, r.pre, r.post, r["size"], r.total) for r in rows} == walk(nodes)
    pairs = tree.alias("o").join(tree.alias("i"), (F.col("o.by") == F.col("i.by")) & tours.above("o", "i")).groupBy("i.by", "i.id").count().collect()
    assert {(r["by"], r["id"]): r["count"] for r in pairs} == {k: v[1] for k, v in walk(nodes).items() if v[1]}


def test_long_chain(spark):
    n = 100_000
    chain = spark.range(n).select(F.lit(1).alias("by"), "id", (F.col("id") - 1).alias("parent"))
    tree = tours.numbered(chain, ["by"])
    assert tree.count() == n
    assert tree.filter((F.col("depth") != F.col("id")) | (F.col("pre") != F.col("id")) | (F.col("post") != n - 1 - F.col("id")) | (F.col("size") != n - F.col("id")) | (F.col("root") != 0)).count() == 0


def test_faults(spark):
    schema = "by int, id int, parent int"
    assert tours.numbered(spark.createDataFrame([], schema), ["by"]).count() == 0
    with pytest.raises(ValueError, match="around themselves"):
        tours.numbered(spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, None)], schema), ["by"])
    with pytest.raises(ValueError, match="repeated"):
        tours.numbered(spark.createDataFrame([(1, 1, None), (1, 1, None)], schema), ["by"])
