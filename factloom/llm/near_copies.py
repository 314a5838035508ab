"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates meet in cells: a cell for each value of a band of min-hashes, and
one for each component of SimHash fingerprints. At a similarity of 0.8 the
fingerprints differ in ten bits of 64 on average, so they alone would find few;
ROWS min-hashes in BANDS bands miss a pair of that similarity with probability
3e-5, and more similar ones less often.

Links are confirmed by exact similarity, in two steps, so that a large group
costs what its size does and not what its pairs do:

1. Every text is compared with one other, which is the first of most of its
   cells. Components of the links that are confirmed come next.
2. Where a cell of a band holds texts of several components still, those outside the
   cell's largest component are compared with all of the cell that are in other
   components than their own. The cell's texts are dealt to tiles, and each two
   tiles are compared in one task, so pairs never become rows. A cell whose texts
   are in one component is done: further links in it change nothing.

So no link between different components of a band's cell is left out. Components of
all links are the groups.

Defined results: words are those of SimHash; texts with the same words in the
same order are one text; texts without words are copies of each other; texts
of fewer than five words are one shingle; a null text has no words; a null id
comes after all others; repeated rows are copies of each other; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import shared
from .encoding import release
from .simhash import components, grouped, majority
from .suffix_dedup import Hashes

WORDS, BANDS, ROWS = 5, 20, 4
#: Least similarity of near copies, as a fraction: 4 of 5 shingles.
SHARED, OF = 4, 5
#: Shingles that are min-hashed, and hashed, at once.
CHUNK, SHINGLES = 1 << 10, 1 << 15

#: Texts whose shingles are kept while pairs are compared, and bytes of shingles in a tile.
HELD, TILE_BYTES = 64, 1 << 20

_RANDOM = np.random.default_rng(5).integers(0, 1 << 63, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
_FLIPS, _FACTORS = _RANDOM[0], _RANDOM[1] * np.uint64(2) + np.uint64(1)
_WEIGHTS = np.random.default_rng(6).integers(0, 1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def all_shingles(of: list[bytes]) -> np.ndarray:
    """Hashes of the shingles, repeats included."""
    if not of:
        return np.zeros(0, dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, of), dtype=np.int64, count=len(of)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    width = min(WORDS, len(of))
    n = len(of) - width + 1
    data = np.frombuffer(b" ".join(of), dtype=np.uint8)
    out = []
    # So many shingles at a time that their bytes are few; a polynomial hash of any length costs the same.
    for i in range(0, n, SHINGLES):
        low, high = int(begins[i]), int(ends[min(n, i + SHINGLES) + width - 2])
        out.append(Hashes(data[low:high]).of(begins[i : i + SHINGLES][: n - i] - low, ends[i + width - 1 : i + width - 1 + SHINGLES][: n - i] - low))
    return np.concatenate(out)


def shingles(of: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    return np.unique(all_shingles(of))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for each band, equal where all its min-hashes are."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[None, i : i + CHUNK] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    mixed = (least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * _WEIGHTS
    return mixed.sum(axis=1, dtype=np.uint64) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity."""
    if SHARED * max(len(a), len(b)) > OF * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARED * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose texts(key, text) are alike. Rows of one a follow each other, and many have the same b, so shingles are kept for a while."""
    both = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("right")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("left")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(key: int, text: pa.Scalar) -> np.ndarray:
            if key not in held:
                if len(held) >= HELD:
                    held.clear()
                held[key] = shingles(words(text.as_py()))
            return held[key]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = [alike(of(x, batch.column("left")[i]), of(y, batch.column("right")[i])) for i, (x, y) in enumerate(zip(a, b, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).filter(pa.array(keep, pa.bool_())) for c in (a, b)], ["a", "b"])

    return both.select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def first_of_cells(cells: DataFrame) -> DataFrame:
    """(a, b): each text with one other, the smallest of a cell: the one that is so in most of its cells."""
    hubs = shared.staged(cells.groupBy("cell").agg(F.min("key").alias("b"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "near-hubs")
    shared_cells = cells.join(hubs, "cell").select(F.col("key").alias("a"), "b").filter("a != b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return shared_cells.groupBy("a").agg(F.max_by("b", F.struct("n", F.bitwise_not("b"))).alias("b"))


def undecided(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell, key, root, outside): members of the cells that hold several components; outside are those that are not in the largest one."""
    named = cells.join(roots.withColumnRenamed("node", "key"), "key", "left").select("cell", "key", F.coalesce("root", "key").alias("root"))
    sizes = named.groupBy("cell", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("cell").agg(F.count("*").alias("_roots"), F.max_by("root", F.struct("n", "root")).alias("_main")).filter("_roots > 1").drop("_roots")
    return named.join(shared.staged(mixed, "near-mixed"), "cell").select("cell", "key", "root", (F.col("root") != F.col("_main")).alias("outside"))


def sets_of(texts: DataFrame) -> DataFrame:
    """(key, hashes, size) of texts(key, text): their sorted shingles, eight bytes each."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(words(text.as_py())).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary()), pa.array(list(map(len, found)), pa.int64())], ["key", "hashes", "size"])

    return texts.select("key", "text").mapInArrow(hash_texts, "key long, hashes binary, size long")


def links_of_tiles(keys: list[int], roots: list[int], outside: list[bool], tiles: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different components among texts of which those outside are compared with all of the other tile, or of the only one.

    A text's shingles are marked, and all others' are counted at once. Of several links between two components one is enough.
    """
    out, above = [], {}

    def top(root: int) -> int:
        while root in above:
            root = above[root]
        return root

    order = np.argsort(tiles, kind="stable").tolist()
    sets = [sets[i] for i in order]
    numbers, places = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    begins = np.cumsum(sizes) - sizes
    second = next((n for n, i in enumerate(order) if tiles[i] != tiles[order[0]]), 0)
    marks = np.zeros(len(numbers), dtype=np.int32)
    for n, i in enumerate(order):
        if not outside[i]:
            continue
        low, high = (0, len(order)) if not second else (second, len(order)) if n < second else (0, second)
        own = places[begins[n] : begins[n] + sizes[n]]
        marks[own] = 1
        end = begins[high] if high < len(order) else len(places)
        both = np.add.reduceat(marks[places[begins[low] : end]], begins[low:high] - begins[low])
        marks[own] = 0
        for m in np.flatnonzero(OF * both >= SHARED * (sizes[n] + sizes[low:high] - both)):
            j = order[low + int(m)]
            a, b = top(roots[i]), top(roots[j])
            if a != b:
                above[a] = b
                out.append((keys[i], keys[j]))
    return out


def compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between the components of the cells of undecided().

    A cell's members are dealt to tiles of about TILE_BYTES, and each two tiles
    meet in one group, in which all pairs are compared without becoming rows.
    """
    sizes = members.join(sets.select("key", "size"), "key").groupBy("cell").agg(F.ceil(F.sum("size") / TILE_BYTES).alias("_tiles"))
    dealt = members.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("_tiles")).cast("long"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_tiles") - 1).cast("long"))))
    met = met.select("cell", F.least("tile", "_other").alias("low"), F.greatest("tile", "_other").alias("high"), "key", "root", "outside", "tile")
    together = met.join(sets.select("key", "hashes"), "key").repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> pa.RecordBatch:
            pairs = links_of_tiles(*map(list, zip(*held, strict=True))) if any(h[2] for h in held) and len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[n] for p in pairs], pa.int64()) for n in (0, 1)], ["a", "b"])

        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("cell", "low", "high", "key", "root", "outside", "tile")]
            for i, (cell, low, high, *row) in enumerate(zip(*rows, strict=True)):
                if (cell, low, high) != now:
                    if held:
                        yield found()
                    now, held = (cell, low, high), []
                held.append((*row, np.frombuffer(batch.column("hashes")[i].as_py(), dtype=np.uint64)))
        if held:
            yield found()

    return together.mapInArrow(compare, "a long, b long")


def links(texts: DataFrame) -> DataFrame:
    """(a, b): links of near copies among the distinct texts(key, fp, bands, text), enough of them for their components."""
    nodes = shared.staged(texts.select("key", "fp", "bands"), "near-nodes")
    by_fp = shared.staged(nodes.select("key", "fp").join(grouped(nodes.select("fp")), "fp").select(F.xxhash64(F.lit("fp"), "root").alias("cell"), "key"), "near-fingerprints")
    cells = nodes.select(F.explode("bands").alias("cell"), "key").union(by_fp)
    several = shared.staged(cells.groupBy("cell").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "near-cells")
    cells = shared.staged(cells.join(several, "cell"), "near-members")
    # Texts of candidates only are shuffled again.
    asked = shared.staged(texts.select("key", "text").join(cells.select("key").distinct(), "key", "left_semi"), "near-texts")
    first = shared.staged(confirmed(first_of_cells(cells), asked), "near-first")
    roots = components(first, "near-stars")
    # Bands find all pairs but 3 in 100,000; components of fingerprints may hold many unlike texts, and only add to the first step.
    banded = cells.join(by_fp.select("cell").distinct(), "cell", "left_anti")
    members = shared.staged(undecided(banded, shared.staged(roots, "near-roots")), "near-members-left")
    sets = shared.staged(sets_of(asked.join(members.select("key").distinct(), "key", "left_semi")), "near-sets")
    return first.union(shared.staged(compared(members, sets), "near-second"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of near copies: that with the smallest id, or any if none has one."""
    names, rows = docs.columns, shared.packed(docs)

    shared.bound_batches(docs.sparkSession, 1_000)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        release()
        for batch in batches:
            keys, fps, cells = [], [], []
            for text in batch.column("row").field("text"):
                text = text.as_py()
                of = words(text)
                keys.append(xxh64_intdigest(b" ".join(of)))
                hashes = all_shingles(of)
                fps.append(majority([hashes]))
                cells.append(bands(np.unique(hashes)).view(np.int64) if of else None)
            for name, numbers in (("_key", keys), ("_fp", fps)):
                batch = batch.append_column(name, pa.array(np.array(numbers, dtype=np.uint64).view(np.int64)))
            yield batch.append_column("_bands", pa.array(cells, pa.list_(pa.int64())))

    fields = [StructField("_key", LongType()), StructField("_fp", LongType()), StructField("_bands", ArrayType(LongType()))]
    rows = rows.mapInArrow(number, StructType([*rows.schema, *fields]))
    rows = shared.staged(rows.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    # Smallest first by text, then by group: a hot text is combined before it is shuffled.
    best = F.min(F.struct(F.col("row.doc_id").isNull().alias("n"), F.col("row.doc_id").alias("doc_id"), "_row"))
    by_key = shared.staged(rows.groupBy(F.col("_key").alias("key")).agg(best.alias("best")), "near-keys")
    one_each = by_key.select(F.col("best._row").alias("_row"))
    texts = rows.filter(F.col("_bands").isNotNull()).join(one_each, "_row", "left_semi")

    def chosen() -> DataFrame:
        found = links(texts.select(F.col("_key").alias("key"), F.col("_fp").alias("fp"), F.col("_bands").alias("bands"), F.col("row.text").alias("text")))
        roots = components(found, "near-components").withColumnRenamed("node", "key")
        kept = by_key.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best"))
        return kept.select(F.col("best._row").alias("_row"))

    return shared.unpacked(rows.join(shared.settled(chosen, "near-kept"), "_row", "left_semi"), names)
