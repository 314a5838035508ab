"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Vectors are dealt into shards of bounded size, and each shard gets a neighbour
graph. Vectors of a shard are linked at random first. Then, in every
iteration, a join of the edges with themselves yields the neighbours of
neighbours, over edges in both directions, and every vector keeps the best of
them. Queries search every shard's graph greedily: the best vectors found so
far are expanded by their neighbours until none of the best is unexpanded, and
the shards' answers are merged.

Equal vectors are one vertex. Its members' smallest ids answer for it, as many
as can be in any answer, so large groups of copies neither fill up the graph
nor hide their neighbours. Inner products become distances by one further
component, which gives all vectors of a shard the same length.

The graph ranks by products of single precision; returned scores are those of
the original vectors in double precision.

Defined results: vectors that are null or zero, or hold null or non-finite
components, take no part; a vector with fewer components counts as filled up
with zeros; a query's candidates are all rows with another id; rows with equal
ids are candidates of their own; ties go to the smaller id; fewer candidates
than k give fewer rows; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .vectors import matrix, query_blocks, shard_count, usable

#: Vertices of a shard, neighbours of a vertex, iterations, and vertices that a search keeps and expands.
SHARD, NEIGHBOURS, ITERATIONS, BEAM = 4_096, 20, 3, 160


def unit_sphere(points: np.ndarray) -> np.ndarray:
    """Points with a further component that makes their lengths equal: their nearest by distance are those by product."""
    squares = (points**2).sum(axis=1)
    top = squares.max(initial=0.0)
    if not np.isfinite(top) or top == 0:
        scale = np.abs(points).max(initial=1.0) or 1.0
        points = points / scale
        squares = (points**2).sum(axis=1)
        top = squares.max(initial=0.0) or 1.0
    return (np.hstack([points, np.sqrt(np.maximum(top - squares, 0))[:, None]]) / np.sqrt(top)).astype(np.float32)


GRAPH = "shard int, node int, near array<int>"


def random_graph(vectors: DataFrame, degree: int) -> DataFrame:
    """Each vertex with `degree` vertices of its shard; vectors has shard and node (0 to its size - 1) and size."""
    step = F.transform(F.sequence(F.lit(1), F.lit(degree)), lambda i: F.pmod(F.xxhash64("shard", "node", i), F.col("size")).cast("int"))
    return vectors.select("shard", "node", F.array_except(F.array_distinct(step), F.array("node")).alias("near"))


def candidates(graph: DataFrame, degree: int) -> DataFrame:
    """(shard, node, found): neighbours of neighbours, by a join of the edges in both directions with themselves."""
    forward = graph.select("shard", F.col("node").alias("a"), F.posexplode("near").alias("_place", "b"))
    both = forward.union(forward.select("shard", F.col("b").alias("a"), "_place", F.col("a").alias("b")))
    # The nearest edges of both directions: the reverse lists of popular vertices would grow without bound.
    place = F.row_number().over(Window.partitionBy("shard", "a").orderBy("_place", F.xxhash64("a", "b")))
    edges = both.withColumn("_n", place).filter(F.col("_n") <= 2 * degree).select("shard", "a", "b")
    lists = edges.groupBy("shard", F.col("a").alias("b")).agg(F.collect_set("b").alias("around"))
    beyond = edges.join(lists, ["shard", "b"]).select("shard", F.col("a").alias("node"), F.array_append("around", F.col("b")).alias("around"))
    return beyond.groupBy("shard", "node").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("found"))


def _improve(degree: int):
    def improve(key: tuple, vectors: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("node")
        points = unit_sphere(matrix(vectors["vector"]))
        near = []
        for node, ids in zip(found["node"], found["found"], strict=True):
            ids = ids[ids != node]
            scores = points[ids] @ points[node]
            if len(ids) > degree:
                top = np.argpartition(-scores, degree - 1)[:degree]
                ids, scores = ids[top], scores[top]
            near.append(ids[np.lexsort((ids, -scores))])
        return pd.DataFrame({"shard": np.full(len(found), key[0], dtype=np.int32), "node": found["node"], "near": near})

    return improve


def neighbour_graph(vectors: DataFrame, degree: int = NEIGHBOURS, iterations: int = ITERATIONS) -> DataFrame:
    """(shard, node, near): near in order of distance. vectors has shard, node, size and vector."""
    graph = shared.staged(random_graph(vectors, degree), "graph")
    slim = vectors.select("shard", "node", "vector")
    for _ in range(iterations):
        found = candidates(graph, degree)
        graph = shared.staged(slim.groupBy("shard").cogroup(found.groupBy("shard")).applyInPandas(_improve(degree), GRAPH), "graph")
    return graph


def greedy_search(points: np.ndarray, links: list[np.ndarray], query: np.ndarray, beam: int, starts: np.ndarray) -> np.ndarray:
    """Vertices that a search visits and keeps, best first."""
    n = len(points)
    beam = min(beam, n)
    seen, expanded = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    best_ids = np.zeros(0, dtype=np.int64)
    best_scores = np.zeros(0, dtype=np.float32)
    new = np.unique(starts)
    while len(new):
        seen[new] = True
        best_ids = np.concatenate([best_ids, new])
        best_scores = np.concatenate([best_scores, points[new] @ query])
        if len(best_ids) > beam:
            top = np.argpartition(-best_scores, beam - 1)[:beam]
            best_ids, best_scores = best_ids[top], best_scores[top]
        open_ = best_ids[~expanded[best_ids]]
        expanded[open_] = True
        new = np.unique(links[open_].ravel()) if len(open_) else open_
        new = new[(new >= 0)]
        new = new[~seen[new]]
    return best_ids[np.lexsort((best_ids, -best_scores))]


FOUND = "query_no long, query_id long, vec_id long, score double"


def _search(k: int, beam: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        index = index.sort_values("node")
        width = max([len(v) for v in index["vector"]] + [len(v) for v in queries["vector"]], default=0)
        raw = matrix(index["vector"], width)
        points = unit_sphere(raw)
        n = len(points)
        forward = [np.asarray(x, dtype=np.int64) for x in index["near"]]
        a = np.repeat(np.arange(n), [len(x) for x in forward])
        b = np.concatenate(forward) if n else a
        # Edges in both directions, as rows of equal length filled up with -1.
        pairs = np.unique(np.stack([np.concatenate([a, b]), np.concatenate([b, a])]), axis=1)
        counts = np.bincount(pairs[0], minlength=n)
        links = np.full((n, max(1, int(counts.max(initial=0)))), -1, dtype=np.int64)
        links[pairs[0], np.arange(pairs.shape[1]) - np.repeat(np.cumsum(counts) - counts, counts)] = pairs[1]
        starts = np.arange(0, n, max(1, n // 64))
        members = index["members"].tolist()
        asked = matrix(queries["vector"], width)
        out: list[tuple[int, int, int, float]] = []
        for j, (no, own) in enumerate(zip(queries["query_no"], queries["query_id"], strict=True)):
            top = np.abs(asked[j]).max() or 1.0
            query = np.append(asked[j] / top, 0).astype(np.float32)
            kept = greedy_search(points, links, query, beam, starts)
            scores = raw[kept] @ asked[j]
            for i in np.lexsort((kept, -scores))[: k + 1]:
                ids = [m for m in members[kept[i]] if m != own][:k]
                out += [(no, own, m, scores[i]) for m in ids]
        return pd.DataFrame(out, columns=["query_no", "query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int, shard_size: int = SHARD, degree: int = NEIGHBOURS, iterations: int = ITERATIONS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors(vec_id, vector) for queries(query_id, vector)."""
    base = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"), zero=False)).select(F.col("vec_id").cast("long"), "vector")
    asked = queries.filter(F.col("query_id").isNotNull() & usable(F.col("vector"), zero=False)).select(F.col("query_id").cast("long"), "vector").dropDuplicates()
    # Equal vectors are one vertex with its k + 1 smallest ids, found in two steps so that no group is collected whole.
    place = F.row_number().over(Window.partitionBy("vector", "_salt").orderBy("vec_id"))
    few = base.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("_n", place).filter(F.col("_n") <= k + 1)
    classes = few.groupBy("vector").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("members"))
    classes = shared.staged(classes, "ann-vertices")
    shards = shard_count(classes.count(), shard_size)
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64(F.lit(9), "vector"), F.lit(shards)).cast("int"))
    in_shard = Window.partitionBy("shard")
    numbered = dealt.withColumn("node", (F.row_number().over(in_shard.orderBy(F.get("members", F.lit(0)), "vector")) - 1).cast("int")).withColumn("size", F.count("*").over(in_shard))
    numbered = shared.staged(numbered, "ann-vectors")
    graph = neighbour_graph(numbered, degree, iterations)
    index = numbered.join(graph, ["shard", "node"], "left").select("shard", "node", "vector", "members", F.coalesce("near", F.array().cast("array<int>")).alias("near"))
    count = asked.count()
    blocks = shard_count(count, 4096)
    asked = query_blocks(asked, count).withColumn("query_no", F.xxhash64("query_id", "vector")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sent = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = sent.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(_search(k, beam), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_no", "query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
