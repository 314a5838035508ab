"""Removal of repeated passages by blockwise suffix sorting with cover samples.

A byte goes if it is covered by a string of `length` bytes that also starts
elsewhere, in the same text or another. Suffixes matter only by their first
`length` bytes, called windows here.

Cover sample. Each window has a sample: the place in it at which half as many
bytes hash lowest, the leftmost of equals. It depends on the window's content
alone, so equal windows have samples with equal names (hashes of those bytes)
at equal distances. That is what a difference cover gives by position, but
with one place in a hundred bytes, not one in fifteen. Runs of neighbouring
windows with the same sample are one item: its name is its bucket, and the
hash of all the bytes under its windows is its rank.

Blockwise sorting, with ties resolved by ranks:
1. Buckets with a single item hold no repeats. They are most of the text, and
   nothing of them is sorted.
2. Items of equal rank repeat each other whole.
3. In buckets with different ranks, one item of each rank is cut into blocks of
   BLOCK windows. A block's bucket is named by the bytes that all its windows
   share, its rank by all bytes under them; blocks of equal rank repeat whole.
4. Blocks of different ranks in a bucket are taken apart into windows.

Each step sees only what the one before left undecided, and each decision is an
aggregate by name and rank, so a passage that very many documents share is
combined before it is shuffled and is never collected. Identical texts are
counted by their hashes; one of them stands for all.

Defined results: null and empty texts keep nothing and lose nothing; matches
are of bytes, so a text cut inside a character loses the rest of that character
where it is wanted as text; identical texts of at least `length` bytes lose
everything, repeated rows too; an empty table gives an empty result. Very long
texts are read in segments that overlap by a window. Only doc_id and text are
read; other columns are carried along under their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Windows of a block, and bytes that are hashed at once.
BLOCK, SEGMENT = 24, 1 << 18
PLACE = np.uint64((1 << 22) - 1)
FACTOR = 0x9E3779B97F4A7C15
#: Characters that stand for a word, of seven bits each.
CODE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = np.array(x, dtype=np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


_POWERS: list[tuple] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and n or more powers of FACTOR and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0][1]) < n:
        names = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        up, down = np.full(n, FACTOR, dtype=np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [(names, np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return _POWERS[0]


class Hashes:
    """Polynomial hashes of any substring of data."""

    def __init__(self, data: np.ndarray):
        self.names, self.up, self.down = _powers(1 << max(10, int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.names[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def combined(*numbers: np.ndarray) -> np.ndarray:
    out = np.uint64(0)
    for x in numbers:
        out = mix(np.asarray(out, dtype=np.uint64) * np.uint64(FACTOR) + np.asarray(x).astype(np.int64).view(np.uint64))
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of values, the place of its smallest one (by 42 bits), the leftmost of equals."""
    n = len(values)
    tagged = (values & ~PLACE) | np.arange(n, dtype=np.uint64)
    padded = np.concatenate([tagged, np.full(-n % width, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & PLACE).astype(np.int64)


def items(data: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Items of the texts that data holds one after the other, between edges.

    Returns name and rank, place of the sample, first and last window, and the
    number of the text.
    """
    sample = length // 2
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    hashes = Hashes(data)
    grams = hashes.of(np.arange(len(data) - sample + 1), np.arange(sample, len(data) + 1))
    place = sliding_argmin(grams, length - sample + 1)
    whole = np.zeros(len(place) + 1, dtype=np.int32)
    long = np.diff(edges) >= length
    np.add.at(whole, edges[:-1][long], 1)
    np.add.at(whole, edges[1:][long] - length + 1, -1)
    valid = np.cumsum(whole)[:-1] > 0
    change = np.ones(len(place) + 1, dtype=bool)
    change[1:-1] = (place[1:] != place[:-1]) | ~valid[1:] | ~valid[:-1]
    change[edges[edges < len(place)]] = True
    first = np.flatnonzero(valid & change[:-1])
    last = np.flatnonzero(valid & change[1:])
    at = place[first]
    rank = combined(hashes.of(first, last + length), at - first, last - first)
    return grams[at], rank, at, first, last, np.searchsorted(edges, first, side="right") - 1


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _words(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts between edges begin and end."""
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # An end of a text ends a word as well.
    cuts = edges[(edges > 0) & (edges < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _pieces(raw: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Pieces of raw[a:b] of about SEGMENT bytes, cut where a word ends."""
    while b - a > SEGMENT:
        spaces = np.flatnonzero(_SPACE[raw[a + SEGMENT : min(b, a + 2 * SEGMENT)]])
        if len(spaces):
            yield a, a + SEGMENT + int(spaces[0])
            a += SEGMENT + int(spaces[0])
        else:
            break
    yield a, b


def coded(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts, CODE characters each, and the edges of the texts: equal words have equal codes, unequal ones but for one pair in 2**35."""
    out, counts = [np.zeros(0, dtype=np.uint8)], np.zeros(len(edges), dtype=np.int64)
    for a, b in _groups(edges, SEGMENT):
        for start, stop in _pieces(raw, int(edges[a]), int(edges[b])):
            begin, end = _words(raw[start:stop], np.clip(edges[a : b + 1], start, stop) - start)
            hashes = Hashes(raw[start:stop]).of(begin, end)
            out.append(((hashes[:, None] >> (np.arange(CODE, dtype=np.uint64) * np.uint64(7))) & np.uint64(127)).astype(np.uint8).ravel())
            counts[a + 1 : b + 1] += np.bincount(np.searchsorted(edges[a : b + 1], begin + start, side="right") - 1, minlength=b - a)[: b - a]
    return np.concatenate(out), CODE * np.cumsum(counts)


def _bytes_of(column: pa.Array, by_words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without nulls, or of the codes of its words, and the edges of its values."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return coded(raw, edges) if by_words else (raw, edges)


def _groups(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of values of at most `most` bytes together, or of one value."""
    begin = 0
    while begin < len(edges) - 1:
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + most, side="right")) - 1)
        yield begin, end
        begin = end


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    signed = [c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c for c in columns]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in signed], names)


ITEMS = "name long, rank long, t1 long, t2 long, place long, first long, last long"


def _scan(length: int, by_words: bool = False) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, edges = _bytes_of(batch.column("text"), by_words)
            keys = [batch.column(c).to_numpy() for c in ("t1", "t2")]
            for a, b in _groups(edges, SEGMENT):
                for start in range(int(edges[a]), int(edges[b]), SEGMENT):
                    stop = min(int(edges[b]), start + SEGMENT + length - 1)
                    inner = np.clip(edges[a : b + 1], start, stop) - start
                    name, rank, place, first, last, text = items(raw[start:stop], inner, length)
                    shift = start - edges[a + text]
                    yield _batch(ITEMS, name, rank, keys[0][a + text], keys[1][a + text], place + shift, first + shift, last + shift)

    return scan


TEXTS = "name long, item long, single boolean, place long, first long, last long, bytes binary"


def _extract(length: int, by_words: bool = False) -> Callable:
    """The bytes under each asked item of a text."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, edges = _bytes_of(batch.column("text"), by_words)
            view = memoryview(raw)
            for i, asked in enumerate(batch.column("asked")):
                rows = [(r["name"], r["item"], r["single"], r["place"], r["first"], r["last"]) for r in asked.as_py()]
                base = int(edges[i])
                found = [bytes(view[base + r[4] : base + r[5] + length]) for r in rows]
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield _batch(TEXTS, *columns, pa.array(found, pa.binary()))

    return extract


PARTS = "name long, rank long, item long, single boolean, first long, last long"


def _parts(length: int, block: int) -> Callable:
    """Blocks of `block` windows of each item: with 1, the windows themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, edges = _bytes_of(batch.column("bytes"))
            name, item, place, first, last = (batch.column(c).to_numpy() for c in ("name", "item", "place", "first", "last"))
            single = np.asarray(batch.column("single"))
            for a, b in _groups(edges, SEGMENT):
                hashes = Hashes(raw[edges[a] : edges[b]])
                own, start = np.arange(a, b), edges[a:b] - edges[a]
                # Blocks are numbered by the distance of windows to the sample, so they are the same in all items of a bucket.
                near, far = (place - last)[own], (place - first)[own]
                count = far // block - near // block + 1
                k = np.repeat(np.arange(len(own)), count)
                number = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + (near // block)[k]
                high, low = np.minimum(far[k], number * block + block - 1), np.maximum(near[k], number * block)
                i = own[k]
                begin, end = place[i] - high, place[i] - low
                at = start[k] - first[i]
                rank = combined(hashes.of(at + begin, at + end + length), high - low, low - number * block)
                if block > 1:
                    inner, outer = place[i] - number * block, place[i] - (number + 1) * block + 1 + length  # all windows of a block have these bytes
                    bucket = combined(name[i], number, hashes.of(at + inner, at + outer))
                else:
                    bucket = rank = combined(name[i], number, rank)
                yield _batch(PARTS, bucket, rank, item[i], single[i], begin, end)

    return cut


def keyed(docs: DataFrame, text: Column) -> DataFrame:
    """docs with two hashes of a text, which stand for it; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    return docs.withColumns({"_t1": F.xxhash64(F.lit(1), text), "_t2": F.xxhash64(F.lit(2), text)})


def text_counts(docs: DataFrame) -> DataFrame:
    """(t1, t2, n, doc_id, size) of each distinct text of docs(doc_id, text): how many rows have it, one of them, and its bytes."""
    texts = keyed(docs, F.col("text")).filter("text is not null")
    counts = texts.groupBy(F.col("_t1").alias("t1"), F.col("_t2").alias("t2")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).alias("size"))
    return shared.staged(counts, "suffix-counts")


def repeats(docs: DataFrame, counts: DataFrame, length: int = 400, by_words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, ranges) of windows that repeat, and (t1, t2) of texts that several rows have; windows of words' codes if asked."""
    shared.bound_batches(docs.sparkSession, 1_000)
    # So many words, each but the last with white space after it, are two bytes each at least.
    least = 2 * (length // CODE) - 1 if by_words else length
    texts = keyed(docs, F.col("text")).filter(F.octet_length("text") >= least).select("doc_id", F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), "text")
    copies = counts.filter(F.col("size") >= least).drop("size")

    def several() -> DataFrame:
        """Step 1: items of buckets with several of them, and whether a bucket has several ranks."""
        found = shared.staged(texts.select("t1", "t2", "text").mapInArrow(_scan(length, by_words), ITEMS), "suffix-items")
        buckets = found.groupBy("name").agg(F.count("*").alias("_n"), (F.min("rank") != F.max("rank")).alias("open")).filter("_n > 1").drop("_n")
        # Staged, so that both sides of the join come from an exchange and a name with very many items can be split.
        joined = found.join(shared.staged(buckets, "suffix-buckets"), "name")
        return joined.repartition("t1", "t2").distinct()

    left = shared.settled(several, "suffix-left")
    # Step 2. Identical texts have identical items, so distinct() keeps one; copies lose everything anyway, yet prove others' repeats.
    alone = left.join(copies.filter("n > 1").select("t1", "t2", F.lit(True).alias("copied")), ["t1", "t2"], "left")
    ranks = alone.groupBy("name", "rank", "open").agg((F.count("*") + F.count("copied")).alias("_n"), F.min(F.struct("t1", "t2", "place", "first", "last")).alias("one"))
    ranks = shared.staged(ranks, "suffix-ranks")
    whole = left.join(ranks.filter("_n > 1").select("name", "rank"), ["name", "rank"]).select("t1", "t2", "first", "last")
    # Step 3.
    asked = ranks.filter("open").select("name", F.xxhash64("name", "rank").alias("item"), (F.col("_n") == 1).alias("single"), "one.*")
    wanted = asked.groupBy("t1", "t2").agg(F.collect_list(F.struct("name", "item", "single", "place", "first", "last")).alias("asked")).join(copies, ["t1", "t2"])
    one_each = texts.alias("x").join(wanted.alias("w"), shared.same([F.col(f"x.{c}") for c in ("t1", "t2", "doc_id")], [F.col(f"w.{c}") for c in ("t1", "t2", "doc_id")]))
    under = shared.staged(one_each.select("x.text", "w.asked").mapInArrow(_extract(length, by_words), TEXTS), "suffix-texts")
    blocks = shared.staged(under.mapInArrow(_parts(length, BLOCK), PARTS), "suffix-blocks")
    by_rank = blocks.groupBy("name", "rank").agg((F.min("item") != F.max("item")).alias("several"), F.min(F.struct("item", "first", "last")).alias("one"))
    by_rank = shared.staged(by_rank, "suffix-block-ranks")
    repeated = blocks.filter("single").join(by_rank.filter("several").select("name", "rank"), ["name", "rank"]).select("item", "first", "last")
    # Step 4: windows of blocks in buckets with several ranks.
    mixed = by_rank.groupBy("name").agg((F.min("rank") != F.max("rank")).alias("_mixed")).filter("_mixed").select("name")
    apart = by_rank.join(mixed, "name").select("one.*")
    ranges = under.select("name", "item", "single", "place", F.col("first").alias("_origin"), "bytes").join(apart, "item")
    cut = F.substring("bytes", (F.col("first") - F.col("_origin") + 1).cast("int"), (F.col("last") - F.col("first") + length).cast("int"))
    windows = shared.staged(ranges.select("name", "item", "single", "place", "first", "last", cut.alias("bytes")).mapInArrow(_parts(length, 1), PARTS), "suffix-windows")
    twice = windows.groupBy("name").agg((F.min("item") != F.max("item")).alias("_several")).filter("_several").select("name")
    seen = windows.filter("single").join(twice, "name").select("item", "first", "last")
    places = asked.filter("single").select("item", "t1", "t2")
    some = repeated.union(seen).join(places, "item").select("t1", "t2", "first", "last")
    marks = whole.union(some).groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return marks, copies.filter("n > 1").select("t1", "t2")


def verdicts(docs: DataFrame, length: int = 400, by_words: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """(_t1, _t2, _copied, _ranges): for the hashes of a text, whether several of docs(doc_id, text) have it, and its repeated windows."""

    def found() -> DataFrame:
        marks, copied = repeats(docs, text_counts(docs) if counts is None else counts, length, by_words)
        both = marks.join(copied.withColumn("_copied", F.lit(True)), ["t1", "t2"], "full_outer")
        return both.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "_copied", F.col("ranges").alias("_ranges"))

    return shared.settled(found, "suffix-verdicts")


def judged(docs: DataFrame, doc_id: str, text: str, length: int = 400, by_words: bool = False) -> DataFrame:
    """docs with _copied and _ranges of repeated windows (null if there are none) of the text in a column or field."""
    found = verdicts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), length, by_words)
    return keyed(docs, F.col(text)).join(found, ["_t1", "_t2"], "left").drop("_t1", "_t2")


def removed_spans(n: int, copied: bool | None, ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    if copied:
        return [(0, n)] if n >= length else []
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in ranges or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def spans_of(ranges: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the maximal runs under the windows in a list column of ranges."""
    sizes = np.diff(ranges.offsets.to_numpy())
    sizes[np.asarray(ranges.is_null())] = 0
    values = ranges.flatten()
    first, last = (values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
    row = np.repeat(np.arange(len(ranges)), sizes)
    if not len(row):
        return row, first, last
    order = np.lexsort((first, row))
    row, first, end = row[order], first[order], last[order] + length
    # Rows are put one after the other on a line, so that one running maximum serves all.
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(row * wide + end)
    begins = np.ones(len(row), dtype=bool)
    begins[1:] = (row * wide + first)[1:] > reach[:-1]
    at = np.flatnonzero(begins)
    return row[at], first[at], reach[np.append(at[1:], len(row)) - 1] - row[at] * wide


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digest(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the kept bytes.

    With words, also n_words_removed: the words of a text in passages of at
    least so many words that occur elsewhere too, whatever white space is
    between them. Most passages of 51 words are shorter than 400 bytes.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_words_removed long" if words else "")
    names = [x.split()[0] for x in schema.split(", ")]
    marks = [("_copied", "_ranges"), *([("_copied_words", "_ranges_words")] if words else [])]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.large_binary()).to_pylist()
            n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            copied = np.asarray(batch.column("_copied").fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            row, begin, end = spans_of(batch.column("_ranges"), length)
            own = ~copied[row]
            row, begin, end = row[own], begin[own], end[own]
            gone = copied & (n >= length)
            removed = np.where(gone, n, np.bincount(row, end - begin, minlength=len(texts)).astype(np.int64))
            count = np.where(gone, 1, np.bincount(row, minlength=len(texts)))
            edges = np.searchsorted(row, np.arange(len(texts) + 1))
            spans = lambda i: [(0, len(texts[i]))] if gone[i] else list(zip(begin[edges[i] : edges[i + 1]].tolist(), end[edges[i] : edges[i + 1]].tolist(), strict=True))
            digests = [hashlib.sha256(kept(t, spans(i)) if count[i] else t).hexdigest() for i, t in enumerate(texts)]
            columns = [batch.column("doc_id"), pa.array(n), pa.array(removed), pa.array(count.astype(np.int64)), pa.array(digests, pa.string())]
            if words:
                whole = np.asarray(batch.column("_copied_words").fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
                row, begin, end = spans_of(batch.column("_ranges_words"), words * CODE)
                number = np.bincount(row, np.maximum(0, end // CODE - -(-begin // CODE)), minlength=len(texts)).astype(np.int64)
                for i in np.flatnonzero(whole):
                    all_words = len(texts[i].split())
                    number[i] = all_words if all_words >= words else 0
                columns.append(pa.array(number))
            yield pa.RecordBatch.from_arrays(columns, names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = text_counts(docs)
    found = verdicts(docs, length, counts=counts)
    if words:
        by_words = verdicts(docs, words * CODE, by_words=True, counts=counts).withColumnsRenamed({"_copied": "_copied_words", "_ranges": "_ranges_words"})
        found = found.join(by_words, ["_t1", "_t2"], "full_outer")
    rows = keyed(docs, F.col("text")).join(found, ["_t1", "_t2"], "left")
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), *[c for pair in marks for c in pair]).mapInArrow(measure, schema)


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs, all columns, with repeated passages cut out of text; bytes of a character that is cut go with it."""

    @F.pandas_udf("string")
    def cut(text, copied, ranges):  # noqa: ANN001
        import pandas as pd

        out = []
        for t, c, r in zip(text, copied, ranges, strict=True):
            data = t.encode()
            spans = removed_spans(len(data), bool(c) if c is not None and c == c else None, None if r is None else list(r), length)
            out.append(kept(data, spans).decode("utf-8", "ignore") if spans else t)
        return pd.Series(out, dtype=object)

    names = docs.columns
    rows = judged(shared.packed(docs), "row.doc_id", "row.text", length)
    # Only texts that lose something go through Python.
    touched = F.coalesce(F.col("_copied"), F.lit(False)) | F.col("_ranges").isNotNull()
    same = rows.filter(~touched).withColumn("_kept", F.col("row.text"))
    changed = rows.filter(touched).withColumn("_kept", cut(F.coalesce("row.text", F.lit("")), F.col("_copied"), F.col("_ranges")))
    chars = {"n_chars": F.when(F.col("_copied").isNull() & F.col("_ranges").isNull(), F.col("row.n_chars")).otherwise(F.length("_kept").cast("long"))} if "n_chars" in names else {}
    return shared.unpacked(same.unionByName(changed), names, text=F.col("_kept"), **chars)


def _whole_words(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words whose whole codes are in spans of codes."""
    return [(a, b) for a, b in ((-(-a // CODE), b // CODE) for a, b in spans) if a < b]


def word_spans(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of bytes of data, each with the white space after it, for spans of its code."""
    import re

    begins = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)] + [len(data)]
    return [(begins[a], begins[b]) for a, b in _whole_words(spans)]


def remove_repeated_words(docs: DataFrame, words: int) -> DataFrame:
    """docs, all columns, with passages of at least so many words that repeat cut out of text, whatever white space is between the words."""
    length = words * CODE

    @F.pandas_udf("string")
    def cut(text, copied, ranges):  # noqa: ANN001
        import pandas as pd

        out = []
        for t, c, r in zip(text, copied, ranges, strict=True):
            data = t.encode()
            spans = removed_spans(CODE * len(data.split()), bool(c) if c is not None and c == c else None, None if r is None else list(r), length)
            out.append(kept(data, word_spans(data, spans)).decode() if spans else t)
        return pd.Series(out, dtype=object)

    names = docs.columns
    rows = judged(shared.packed(docs), "row.doc_id", "row.text", length, by_words=True)
    # Only texts that lose something go through Python again.
    touched = F.coalesce(F.col("_copied"), F.lit(False)) | F.col("_ranges").isNotNull()
    same = rows.filter(~touched).withColumn("_kept", F.col("row.text"))
    changed = rows.filter(touched).withColumn("_kept", cut(F.coalesce("row.text", F.lit("")), F.col("_copied"), F.col("_ranges")))
    chars = {"n_chars": F.when(F.col("_copied").isNull() & F.col("_ranges").isNull(), F.col("row.n_chars")).otherwise(F.length("_kept").cast("long"))} if "n_chars" in names else {}
    return shared.unpacked(same.unionByName(changed), names, text=F.col("_kept"), **chars)
