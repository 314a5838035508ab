"""Near-duplicate documents by SimHash, compared exactly in tiles.

Words are what stands between white space, after A-Z is lower-cased; each run
of three is hashed, repeats included, and a bit of the fingerprint is set if
it is set in more than half of the hashes. Distinct fingerprints are tiled by
the population counts of their lanes (equal parts of the 64 bits). Two
fingerprints that differ in at most r bits have lane counts that differ by at
most r in sum, so only tiles within that distance are compared, pair by pair,
by exclusive-or and bit counts. Each comparison of two tiles keeps a spanning
forest of its links; components come from all forests by iterated joins.

Defined results: null and empty texts, and texts of white space, have
fingerprint zero, which links like any other; texts of one or two words hash
as one shingle; documents with equal fingerprints are linked; rows with a null
id keep their place in components, whose id is then that of the smallest id,
or null if there is none; repeated rows come back repeatedly; an empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import shared

#: Fingerprints of a full tile, and of a strip of it that is compared at once.
TILE, STRIP = 1_024, 128
#: Numbers of distinct fingerprints from which tiles are keyed by the counts of more lanes.
MORE_LANES = ((0, 2), (2_000_000, 4), (200_000_000, 8))
#: Shingles that are counted at once.
CHUNK = 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    width = min(words_per_shingle, len(words))
    n = len(words) - width + 1
    begins, ends = begins[:n].tolist(), ends[width - 1 :].tolist()
    return majority(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins[i : i + CHUNK], ends[i : i + CHUNK], strict=True)], dtype="<u8") for i in range(0, n, CHUNK))


def majority(chunks: Iterable[np.ndarray]) -> int:
    """The 64 bits that are set in more than half of all hashes."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in chunks:
        counts = np.bincount((np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048)
        ones += (counts.reshape(8, 256) @ _BITS).ravel()
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _hash_batch(column: pa.Array, words_per_shingle: int) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py(), words_per_shingle) for t in column], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    shared.bound_batches(docs.sparkSession)

    def hash_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _hash_batch(batch.column("text"), words_per_shingle)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hash_partition, "doc_id long, fp long")


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links, the smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints of two tiles, which may be the same."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    # Strip by strip: the links of a large group of near copies are never held all at once.
    for i in range(0, len(a), STRIP):
        x, y = np.nonzero(np.bitwise_count(a[i : i + STRIP, None] ^ b[None, :]) <= radius)
        left, right = label[place[x + i]], label[place[len(a) + y]]
        new = left != right
        if new.any():
            pairs = np.unique(np.minimum(left[new], right[new]) * len(nodes) + np.maximum(left[new], right[new]))
            label = forest(len(nodes), pairs // len(nodes), pairs % len(nodes))[label]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _lane_counts(fp: Column, lanes: int) -> list[Column]:
    width = 64 // lanes
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(mask))) for i in range(lanes)]


def _key(counts: list[Column]) -> Column:
    return sum((c.cast("long") * (65**i) if len(counts) <= 4 else c.cast("long") * (10**i)) for i, c in enumerate(counts))


def _offsets(lanes: int, radius: int) -> list[int]:
    """Differences of keys of tiles that may hold a link: one of each pair of opposite ones, and zero."""
    steps = [()]
    for _ in range(lanes):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    base = 65 if lanes <= 4 else 10
    return [sum(d * base**i for i, d in enumerate(s)) for s in steps if s >= (0,) * lanes]


def links(fps: DataFrame, count: int, radius: int) -> DataFrame:
    """(a, b): forests of the links between distinct fingerprints, the column fp of fps."""
    lanes = max((n, k) for n, k in MORE_LANES if n <= count)[1]
    keyed = fps.select("fp", _key(_lane_counts(F.col("fp"), lanes)).alias("cell"))
    sizes = keyed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    dealt = keyed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    # At most about TILE fingerprints meet in a list; a cell with more has more parts.
    tiles = shared.staged(dealt.repartition("cell", "part").groupBy("cell", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "simhash-tiles")
    near = tiles.select("cell", "part", F.explode(F.lit(_offsets(lanes, radius))).alias("_step")).withColumn("_other", F.col("cell") + F.col("_step"))
    pairs = near.join(tiles.select(F.col("cell").alias("_other"), F.col("part").alias("_part")), "_other")
    pairs = pairs.filter((F.col("_step") != 0) | (F.col("part") <= F.col("_part"))).select("cell", "part", "_other", "_part")
    pairs = pairs.repartition("cell", "part", "_other", "_part")
    pairs = pairs.join(tiles.withColumnRenamed("fps", "left"), ["cell", "part"])
    pairs = pairs.join(tiles.select(F.col("cell").alias("_other"), F.col("part").alias("_part"), F.col("fps").alias("right")), ["_other", "_part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in ("left", "right"))
                child, root = tile_links(a, b, radius)
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(root.view(np.int64))], ["a", "b"])

    return pairs.select("left", "right").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of edges(a, b) reaches; nodes without edges are absent.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to its smallest neighbour, and then its smaller neighbours to
    the smallest. Smallest neighbours are aggregates, so a node with very many
    neighbours is never collected.
    """
    edges = shared.staged(edges.filter("a != b").distinct(), label)
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = shared.staged(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        before_edges, edges = edges, shared.staged(small, label)
        shared.delete(shared.staged_paths(before_edges, large))
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def grouped(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint of fps, named by one of its fingerprints."""
    nodes = shared.staged(fps.select("fp").distinct(), "simhash-nodes")
    roots = components(links(nodes, nodes.count(), radius), "simhash-components")
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs."""
    fps = shared.staged(fingerprints(docs, words_per_shingle), "simhash-fps")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = shared.settled(lambda: grouped(fps, radius).join(first, "fp"), "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """docs, all columns, with one row of each component: that with the smallest id, or any if none has one."""
    names, rows = docs.columns, shared.packed(docs)

    shared.bound_batches(docs.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_fp", _hash_batch(batch.column("row").field("text"), words_per_shingle))

    rows = rows.mapInArrow(number, StructType([*rows.schema, StructField("_fp", LongType())]))
    rows = shared.staged(rows.withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    # Smallest first by fingerprint, then by component: a hot fingerprint is combined before it is shuffled.
    best = F.min(F.struct(F.col("row.doc_id").isNull().alias("n"), F.col("row.doc_id").alias("doc_id"), "_row"))
    by_fp = rows.groupBy(F.col("_fp").alias("fp")).agg(best.alias("best"))
    kept = shared.settled(lambda: grouped(rows.select(F.col("_fp").alias("fp")), radius).join(by_fp, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best._row").alias("_row")), "simhash-kept")
    return shared.unpacked(rows.join(kept, "_row", "left_semi"), names)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
