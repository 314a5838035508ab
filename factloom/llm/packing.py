"""Packing of documents into training sequences by vector bin packing.

Every document is tokenized and cut into pieces of at most the sequence
length. Full pieces are sequences of their own. The rest are items with a
demand in three dimensions: tokens, segments (one each) and loss-bearing
tokens. A sequence takes, again and again, the item whose demand has the
largest dot product with what the sequence has left, among those that fit; if
none fits by its tokens, the best one is cut. A sequence that cannot be filled
is cut into sequences whose lengths are powers of two, which need no padding.

Each task packs the documents of its own input partition as a stream, with a
bounded number of open items, so nothing is shuffled and a hot source or a
very long document needs no memory beyond its own text.

Defined results: a null or empty text is the end id alone; repeated rows and
repeated or null ids are documents of their own; an empty table gives an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .encoding import TextEncoder

SCHEMA = "doc_id long, start long, length long, loss long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequences of one task are numbered from its partition's number times this.
TASK_STRIDE = 1 << 33


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens, loss) into sequences; rows collects finished pieces."""

    #: Items from which a sequence chooses.
    OPEN_ITEMS = 256

    def __init__(self, tokens: int, segments: int, loss: int, first_id: int):
        self.capacity = np.array([tokens, segments, loss], dtype=float)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.next_id = first_id
        self.items: list[tuple] = []
        self.demand = np.zeros((0, 3))
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, prompt: int = 0) -> None:
        """prompt: tokens at a document's beginning that bear no loss."""
        ids, n, step = ids.tobytes(), len(ids), min(self.tokens, self.loss)
        for start in range(0, n, step):
            piece = ids[4 * start : 4 * min(n, start + step)]
            length = len(piece) // 4
            item = (doc_id, start, piece, n, min(length, max(0, start + length - max(start, prompt))))
            if length == self.tokens:
                self._close([item])
            else:
                self.items.append(item)
        while len(self.items) > self.OPEN_ITEMS:
            self._fill()

    def finish(self) -> None:
        while self.items:
            self._fill()

    def _fill(self) -> None:
        """Fills one sequence from the open items."""
        demand = np.array([(len(x[2]) // 4, 1, x[4]) for x in self.items], dtype=float)
        free = np.ones(len(self.items), dtype=bool)
        left, chosen = self.capacity.copy(), []
        share = demand / self.capacity
        while left[0] > 0 and left[1] > 0 and free.any():
            worth = np.where(free, share @ (left / self.capacity), -1.0)
            fits = free & (demand <= left).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, worth, -1.0)))
                free[i] = False
                chosen.append(self.items[i])
                left -= demand[i]
                continue
            i = int(np.argmax(worth))
            doc_id, start, piece, n, loss = self.items[i]
            length = len(piece) // 4
            quiet = length - loss  # these come first
            take = int(min(left[0], length - 1, quiet + left[2]))
            if take <= 0:
                break
            spent = max(0, take - quiet)
            chosen.append((doc_id, start, piece[: 4 * take], n, spent))
            self.items[i] = (doc_id, start + take, piece[4 * take :], n, loss - spent)
            left -= (take, 1, spent)
            break
        self.items = [x for x, open_ in zip(self.items, free, strict=True) if open_]
        self._close(chosen)

    def _close(self, chosen: list[tuple]) -> None:
        """Gives the chosen pieces a sequence, or several whose lengths are powers of two."""
        total = sum(len(x[2]) // 4 for x in chosen)
        queue = chosen[::-1]
        while total:
            size = total if total == self.tokens else 1 << (total.bit_length() - 1)
            offset = 0
            while offset < size:
                doc_id, start, piece, n, loss = queue.pop()
                length = len(piece) // 4
                if length > (room := size - offset):
                    spent = max(0, room - (length - loss))
                    queue.append((doc_id, start + room, piece[4 * room :], n, loss - spent))
                    piece, length, loss = piece[: 4 * room], room, spent
                self.rows.append((doc_id, start, length, loss, piece, n, self.next_id, offset))
                offset += length
            self.next_id += 1
            total -= size


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tokens: int = 2048, segments: int = 256, loss: int | None = None, prompt: str | None = None) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids.

    tokenizer is the path of a tokenizers file that executors can read. tokens,
    segments and loss are the limits of a sequence. prompt names a column with
    the number of leading tokens that bear no loss, or with the leading part of
    the text whose tokens bear none; without it all bear loss.
    """
    limit = tokens if loss is None else loss
    columns = ["doc_id", "text"] + ([prompt] if prompt else [])

    shared.bound_batches(docs.sparkSession)

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = TextEncoder.of_process(tokenizer, end_id, spaced=True)
        packer = Packer(tokens, segments, limit, TaskContext.get().partitionId() * TASK_STRIDE)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            prompts = batch.column(prompt).to_pylist() if prompt else [0] * len(texts)
            if any(isinstance(p, str) for p in prompts):
                prompts = [len(ids) - 1 for ids in encoder.encode(prompts)]
            for doc_id, ids, quiet in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), prompts, strict=True):
                packer.add(doc_id, ids, quiet or 0)
            yield from _batches(packer)
        packer.finish()
        yield from _batches(packer)

    return docs.select(*columns).mapInArrow(pack_partition, SCHEMA)


def _batches(packer: Packer) -> Iterator[pa.RecordBatch]:
    rows, packer.rows = packer.rows, []
    types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for i in range(0, len(rows), 4000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4000], strict=True), types, strict=True)], names)


def digest(pieces: DataFrame, *more: str) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more)
