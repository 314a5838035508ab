"""Token ids as ORC files that readers can prune and read stripe by stripe.

Each row holds one document's ids as an array of integers, which ORC encodes
by run length. Documents are dealt by range and sorted before they are
encoded, so each file holds one range of ids, its rows are in ascending order,
and files are in the order of their numbers. Files have row indexes and Bloom
filters on the id, and are read back with Spark's ORC reader, a stripe or more
per task. Texts are encoded a few megabytes at a time.

Defined results: a null or empty text is the end id alone; a null document id
sorts first; rows with equal ids are ordered by a hash of their texts, so that
many of them spread over several files, and equal rows are kept; an empty
table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .encoding import TextEncoder

#: UTF-8 bytes of text that one file holds on average.
TEXT_BYTES_PER_FILE = 32 << 20
#: Rows that a task is sent at once, and ids that it sends at once.
ROWS_READ, IDS_SENT = 500, 1 << 20
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "10000", "orc.stripe.size": str(16 << 20), "compression": "lz4"}
SCHEMA = "range int, place long, doc_id long, ids array<int>"


def in_ranges(docs: DataFrame, bytes_per_file: int) -> DataFrame:
    """(doc_id, text), sorted within partitions, whose numbers ascend with the ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    return rows.repartitionByRange(max(1, math.ceil(size / bytes_per_file)), *order).sortWithinPartitions(*order, "text")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, bytes_per_file: int | None = None) -> None:
    """Writes the token files of docs to a folder; rows are (range, place in the range, doc_id, ids)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, number, place = TextEncoder.of_process(tokenizer, end_id, spaced=False), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = encoder.encode(batch.column("text").to_pylist())
            groups = np.cumsum([0, *map(len, ids)]) // IDS_SENT
            edges = [*np.flatnonzero(np.diff(groups[:-1], prepend=-1)).tolist(), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                ends = np.cumsum([0, *map(len, ids[a:b])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids[a:b]).view(np.int32)))
                places = pa.array(np.arange(place, place + b - a))
                place += b - a
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number, dtype=np.int32)), places, batch.column("doc_id").slice(a, b - a), lists], ["range", "place", "doc_id", "ids"])

    shared.bound_batches(docs.sparkSession, ROWS_READ)
    in_ranges(docs, bytes_per_file or TEXT_BYTES_PER_FILE).mapInArrow(encode, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(range, place, doc_id, ids) as the files hold them; filters on doc_id prune stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def layout(spark: SparkSession, path: str) -> DataFrame:
    """Where each document's ids lie in the whole: doc_id, start, n_tokens, ids_crc32."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            data = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("range", "place", "doc_id")), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], ["range", "place", "doc_id", "n_tokens", "ids_crc32"])

    shared.bound_batches(spark, ROWS_READ)
    rows = shared.staged(read(spark, path).mapInArrow(measure, "range int, place long, doc_id long, n_tokens long, ids_crc32 long"), "orc-layout")
    totals = rows.groupBy("range").agg(F.sum("n_tokens").alias("_total"))
    # A row per file.
    before = F.coalesce(F.sum("_total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("range", before.alias("_offset"))
    inside = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(offsets, "range").select("doc_id", (F.col("_offset") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32")
