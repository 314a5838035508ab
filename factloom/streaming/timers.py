"""Stateful streams with timers: debounced refreshes, storms of changes, and the last samples of each key.

Rows of a key wait in its state until the watermark has passed them, and are
then taken in the order of their times, whatever order they came in. So the
results are those of the windows over a finished table, also after a restart
from the checkpoint. A key that gets no row for idle_ms starts anew, whichever
batches its rows come in, and its state is dropped some time after.

Defined results: rows later than the watermark allows are dropped, as in every
event-time stream; equal times are ordered by the id; rows without a key or a
time are left out; equal rows all count; the state of a key is as large as
what the watermark still holds back, and what the processor keeps. Keys are of
atomic types.

Calls to the state cost far more than rows, so keys share BUCKETS groups: what
waits is kept as parts of packed rows, and once the watermark has passed some, a
group's rows are read once and taken key by key. A task holds what waits in one
group, 28 bytes a row. A part has a key of its own in the state: what is appended
to a list makes the state store read the list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, TimestampType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that keys are dealt to by hash. A stream that goes on from a checkpoint must keep the number.
BUCKETS = 1024
#: A row that waits; key is a place in the list of keys beside it.
ROWS = np.dtype([("key", "<i4"), ("at", "<i8"), ("id", "<i8"), ("value", "<f8")])
#: Rows that are taken, and handed on, at once.
PART_ROWS = 1 << 16


class InOrder(StatefulProcessor):
    """Takes rows (key, ts, id, value) of a key in order once the watermark has passed them; subclasses say what they do to the state."""

    #: DDL of the state of a key, its value before the first row, and DDL of the output after the key.
    STATE, START, OUTPUT = "", (), ""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", "key string", f"{self.STATE}, _latest long")
        self.waiting = handle.getMapState("waiting", "part long", "keys array<string>, rows binary")
        self.parts = handle.getValueState("parts", "n long")
        self.sweep = handle.getValueState("sweep", "at long")
        self.done = None

    def step(self, state: tuple, at: int, id_: int, value: float) -> tuple[tuple, list[tuple]]:
        """The state after a row, and output rows."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.done, first, parts = None, [], self._parts()
        for batch in rows:
            codes, keys = pd.factorize(batch["key"], use_na_sentinel=False)
            packed = np.empty(len(batch), ROWS)
            for name, column in (("key", codes), ("at", batch["ms"]), ("id", batch["id"]), ("value", batch["value"])):
                packed[name] = column.astype(ROWS[name])
            self.waiting.updateValue((parts,), (keys.tolist(), packed.tobytes()))
            first.append(packed["at"].min())
            parts += 1
        self.parts.update((parts,))
        self._wake(min(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Takes all rows that the watermark has passed; further timers that it has passed find nothing left."""
        mark = timerValues.getCurrentWatermarkInMs()
        if self.done == (key, mark):
            return
        self.done = (key, mark)
        keys, held = self._held()
        passed = held["at"] < mark
        if passed.any():
            due, left = held[passed], held[~passed]
            del held
            yield from self._taken(keys, due[np.lexsort([due[c] for c in ("value", "id", "at", "key")])])
            self._keep(keys, left)
            if len(left):
                self._wake(left["at"].min())
            if self.idle_ms is not None and not self.sweep.exists():
                self._sweep_at(max(int(due["at"].max()) + self.idle_ms, mark + 1))
        if self.idle_ms is not None and self.sweep.exists() and self.sweep.get()[0] <= mark:
            self._forget(mark)

    def _parts(self) -> int:
        return self.parts.get()[0] if self.parts.exists() else 0

    def _held(self) -> tuple[list[str], np.ndarray]:
        """The keys and rows that wait."""
        places: dict[str, int] = {}
        held = [np.empty(0, ROWS)]
        for i in range(self._parts()):
            keys, rows = self.waiting.getValue((i,))
            part = np.frombuffer(rows, ROWS).copy()
            part["key"] = np.array([places.setdefault(k, len(places)) for k in keys], "<i4")[part["key"]]
            held.append(part)
        return list(places), np.concatenate(held)

    def _keep(self, keys: list[str], left: np.ndarray) -> None:
        """These rows wait instead of those before."""
        before, parts = self._parts(), 0
        for begin in range(0, len(left), PART_ROWS):
            part = left[begin : begin + PART_ROWS].copy()
            used, part["key"] = np.unique(part["key"], return_inverse=True)
            self.waiting.updateValue((parts,), ([keys[i] for i in used.tolist()], part.tobytes()))
            parts += 1
        for i in range(parts, before):
            self.waiting.removeKey((i,))
        self.parts.update((parts,))

    def _taken(self, keys: list[str], due: np.ndarray) -> Iterator[pd.DataFrame]:
        """Output of rows in the order of their keys and times; the states after them are kept."""
        out = []
        ends = [*np.flatnonzero(np.diff(due["key"])) + 1, len(due)]
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            name = keys[due["key"][begin]]
            kept = self.states.getValue((name,))
            state, latest = (self.START, None) if kept is None else (tuple(kept[:-1]), kept[-1])
            for at_once in range(begin, end, PART_ROWS):
                for _, at, id_, value in due[at_once : min(at_once + PART_ROWS, end)].tolist():
                    if self.idle_ms is not None and latest is not None and at - latest >= self.idle_ms:
                        state = self.START
                    state, more = self.step(state, at, id_, value)
                    latest = at
                    out += [(name, *row) for row in more]
                if len(out) >= PART_ROWS:
                    yield self._frame(out)
                    out = []
            self.states.updateValue((name,), (*state, latest))
        if out:
            yield self._frame(out)

    def _forget(self, mark: int) -> None:
        """Drops the states of keys that got no row for idle_ms; that they start anew does not depend on when this is done."""
        latest = {name[0]: state[-1] for name, state in self.states.iterator()}
        for name, at in latest.items():
            if at + self.idle_ms <= mark:
                self.states.removeKey((name,))
        kept = [at for at in latest.values() if at + self.idle_ms > mark]
        if kept:
            self._sweep_at(max(kept) + self.idle_ms)
        else:
            self.sweep.clear()

    def _sweep_at(self, at: int) -> None:
        self.sweep.update((at,))
        self.handle.registerTimer(at)

    def _wake(self, at) -> None:
        """Once the watermark is beyond a row at this time."""
        self.handle.registerTimer(int(at) + 1)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        columns = [x.split()[0] for x in self.OUTPUT.split(", ")]
        return pd.DataFrame(out, columns=["key", *columns])

    def close(self) -> None:
        pass


class Refreshes(InOrder):
    """Requests that a debounced refresh lets through: the first, and each that comes wait_ms or more after the last one let through."""

    STATE, START, OUTPUT = "last long", (None,), "ms long, id long"

    def __init__(self, wait_ms: int, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.wait_ms = wait_ms

    def step(self, state, at, id_, value):
        if state[0] is None or at - state[0] >= self.wait_ms:
            return (at,), [(at, id_)]
        return state, []


class Storms(InOrder):
    """pending and storm after each change, whose value is added to pending: a storm begins above a number and ends at none."""

    STATE, START, OUTPUT = "pending long, storm boolean", (0, False), "ms long, id long, pending long, storm boolean"

    def __init__(self, above: int, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.above = above

    def step(self, state, at, id_, value):
        pending = state[0] + int(value)
        storm = True if pending > self.above else False if pending == 0 else state[1]
        return (pending, storm), [(at, id_, pending, storm)]


class Samples(InOrder):
    """The last `most` values of a key after each of its rows: how many, their mean and the greatest."""

    STATE, START, OUTPUT = "held array<double>", ([],), "ms long, id long, n long, mean double, greatest double"

    def __init__(self, most: int, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.most = most

    def step(self, state, at, id_, value):
        held = [*state[0], value][-self.most :]
        return (held,), [(at, id_, len(held), sum(held) / len(held), max(held))]


def _as_text(kind: DataType) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """To strings, from which the values come back as they were."""
    if isinstance(kind, (ArrayType, MapType, StructType)):
        raise ValueError(f"keys of a stream must be of an atomic type, not {kind.simpleString()}")
    if isinstance(kind, TimestampType):
        return lambda c: F.unix_micros(c).cast("string"), lambda c: F.timestamp_micros(c.cast("long"))
    if isinstance(kind, BinaryType):
        return F.hex, F.unhex
    return lambda c: c.cast("string"), lambda c: c.cast(kind)


def followed(rows: DataFrame, processor: InOrder, late: str = "10 minutes") -> DataFrame:
    """A streaming DataFrame of what the processor makes of rows(key, ts, id, value), a stream; value may be missing.

    Needs the state store that keeps timers, and sets it for the session.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    value = F.col("value").cast("double") if "value" in rows.columns else F.lit(0.0)
    known = rows.filter("key is not null and ts is not null").withWatermark("ts", late)
    text, back = _as_text(rows.schema["key"].dataType)
    timed = known.select(text(F.col("key")).alias("key"), "ts", F.unix_millis("ts").alias("ms"), F.col("id").cast("long").alias("id"), F.coalesce(value, F.lit(0.0)).alias("value"))
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    found = dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"key string, {processor.OUTPUT}", outputMode="append", timeMode="EventTime")
    return found.withColumn("key", back(F.col("key")))
