"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt into shards of bounded size. Each shard is a KD-tree whose
nodes split at the median of their widest component and carry tight bounding
boxes. A search visits nodes in the order of the largest inner product that
any vector in the node's box can have, and ends when that is below the k-th
best score so far. Queries are answered in two rounds: a query's own shard
first, and then all others, which start with the k-th score of the first.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; a vector with fewer components counts as filled up with zeros; a
query's candidates are all rows with another id; rows with equal ids are
candidates of their own, and queries with equal ids and vectors are answered
once for each distinct vector; ties go to the smaller id; fewer candidates
than k give fewer rows; an empty table gives an empty result. Scores beyond
the range of long are set to its ends. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .vectors import matrix, query_blocks, shard_count, usable, with_shard

ROWS_PER_SHARD, ROWS_PER_LEAF = 8_192, 64
#: Sums of products of integers are exact in doubles below this.
EXACT = 2.0**52


class Tree:
    """A KD-tree over integer vectors (held as doubles), ties broken by the smaller id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.lows, self.highs, self.parts, self.kids = [], [], [], []
        order = self._split(points, np.argsort(ids, kind="stable"))
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.lows), np.array(self.highs)

    def _split(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        order, todo = [], [(rows, -1, 0)]
        start = 0
        while todo:
            rows, parent, side = todo.pop()
            node, own = len(self.parts), points[rows]
            self.lows.append(own.min(axis=0))
            self.highs.append(own.max(axis=0))
            self.kids.append([-1, -1])
            if parent >= 0:
                self.kids[parent][side] = node
            spread = self.highs[-1] - self.lows[-1] if own.shape[1] else np.zeros(1)
            if len(rows) <= ROWS_PER_LEAF or spread.max() == 0:
                self.parts.append((start, start + len(rows)))
                order.append(rows)
                start += len(rows)
                continue
            self.parts.append(None)
            rows = rows[np.argsort(own[:, int(np.argmax(spread))], kind="stable")]
            half = len(rows) // 2
            todo += [(rows[half:], node, 1), (rows[:half], node, 0)]
        return np.concatenate(order)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the largest inner product with any point of the box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, own_id: int, k: int, floor: float) -> list[tuple[float, int]]:
        """(score, id) of the best k points that reach the floor."""
        best: list[tuple[float, int]] = []  # a heap of (score, -id)
        nodes = [(-bound[0], 0)]
        while nodes:
            least = max(floor, best[0][0]) if len(best) == k else floor
            top, node = heapq.heappop(nodes)
            if -top < least:
                break
            if self.parts[node] is None:
                for kid in self.kids[node]:
                    if bound[kid] >= least:
                        heapq.heappush(nodes, (-bound[kid], kid))
                continue
            a, b = self.parts[node]
            scores = self.points[a:b] @ query
            for i in np.flatnonzero(scores >= least):
                item = (scores[i], -self.ids[a + i])
                if self.ids[a + i] == own_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in best]


OUT = "query_no long, query_id long, vec_id long, score long"


def _answers(shard: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of one shard for one block of queries, whose columns are query_no, query_id, vector and floor."""
    out: list[tuple[int, int, int, int]] = []
    width = max([len(v) for v in shard["vector"]] + [len(v) for v in queries["vector"]], default=0)
    points, asked = np.floor(matrix(shard["vector"], width) * 256), np.floor(matrix(queries["vector"], width) * 256)
    ids = shard["vec_id"].to_numpy()
    floors = queries["floor"].fillna(-np.inf).to_numpy(dtype=float)
    exact = width * max(1.0, np.abs(points).max(initial=0)) * max(1.0, np.abs(asked).max(initial=0)) < EXACT
    if exact and width:
        tree = Tree(ids, points)
        for begin in range(0, len(queries), 512):
            bounds = tree.bounds(asked[begin : begin + 512])
            for i in range(len(bounds)):
                j = begin + i
                own = queries["query_id"].iat[j]
                out += [(queries["query_no"].iat[j], own, n, int(s)) for s, n in tree.search(asked[j], bounds[i], own, k, floors[j])]
    else:  # huge components: exact integers of any size, without a tree
        whole = [[int(x) for x in p] for p in points]
        for j, q in enumerate([int(x) for x in a] for a in asked):
            own = queries["query_id"].iat[j]
            scored = ((max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(p, q, strict=True)))), -n) for p, n in zip(whole, ids, strict=True) if n != own)
            out += [(queries["query_no"].iat[j], own, -n, s) for s, n in heapq.nlargest(k, scored)]
    return pd.DataFrame(out, columns=["query_no", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors(vec_id, vector) for queries(query_id, vector)."""
    base = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"), zero=True)).select(F.col("vec_id").cast("long"), "vector")
    asked = queries.filter(F.col("query_id").isNotNull() & usable(F.col("vector"), zero=True)).select(F.col("query_id").cast("long"), "vector").dropDuplicates()
    n, m = base.count(), asked.count()
    shards = shard_count(n, rows_per_shard)
    base = with_shard(base, "vec_id", shards, 1)
    asked = shared.staged(query_blocks(asked, m).withColumn("query_no", F.xxhash64("query_id", "vector")).withColumn("home", F.pmod(F.xxhash64(F.lit(2), "query_id"), F.lit(shards)).cast("int")), "topk-queries")
    blocks = shard_count(m, 4096)

    def search(q: DataFrame) -> DataFrame:
        # A shard is sent to each block of queries, so that a task holds one shard and one block.
        sent = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = lambda left, right: _answers(left, right, k)
        return sent.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInPandas(found, OUT)

    first = search(asked.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("double")))
    first = shared.staged(first, "topk-first")
    floors = first.groupBy("query_no").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("_n")).filter(F.col("_n") == k).drop("_n")
    others = asked.join(floors, "query_no", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard != home")
    rank = F.row_number().over(Window.partitionBy("query_no", "query_id").orderBy(F.col("score").desc(), "vec_id"))
    every = first.unionByName(search(others)) if shards > 1 else first
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
