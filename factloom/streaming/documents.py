"""Documents as keyed state over a stream of change events.

Events are (uri, version, action, start, end, text): `open` and `save` replace
a document, `change` replaces a span of it (or all of it, where start is
null), and `close` forgets it. State is ordered by version, not by event time:
an event whose version is not above the state's is stale and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources import fact_log

EVENTS = "uri string, version long, action string, start int, end int, text string"
DOCUMENTS = "uri string, version long, text string, applied int, stale int, open boolean"


def fold(text: str | None, version: int, events: pd.DataFrame) -> tuple[str | None, int, int, int]:
    """Text and version after events in the order of their versions, and how many were applied and stale."""
    applied = stale = 0
    for e in events.sort_values(["version", "start"], kind="stable").itertuples(index=False):
        if e.version <= version and not (e.action == "open" and text is None):
            stale += 1
            continue
        applied += 1
        version = int(e.version)
        if e.action == "close":
            text = None
        elif e.action in ("open", "save") or pd.isna(e.start):
            text = e.text if e.action != "save" or e.text is not None else text
        else:
            base = text or ""
            text = base[: int(e.start)] + (e.text or "") + base[int(e.end) :]
    return text, version, applied, stale


def document_states(events: DataFrame) -> DataFrame:
    """A streaming DataFrame of DOCUMENTS: each document after each batch that touches it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, version = state.get if state.exists else (None, -1)
        frame = pd.concat(list(batches))
        text, version, applied, stale = fold(text, version, frame)
        state.update((text, version))
        yield pd.DataFrame([(key[0], version, text, applied, stale, text is not None)], columns=["uri", "version", "text", "applied", "stale", "open"])

    return events.groupBy("uri").applyInPandasWithState(step, DOCUMENTS, "text string, version long", "update", GroupStateTimeout.NoTimeout)


def latest_documents(events: DataFrame) -> DataFrame:
    """The same over a finished table: the state of every document after all its events."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        text, version, applied, stale = fold(None, -1, frame)
        return pd.DataFrame([(key[0], version, text, applied, stale, text is not None)], columns=["uri", "version", "text", "applied", "stale", "open"])

    return events.groupBy("uri").applyInPandas(run, DOCUMENTS)


def merge_files(spark: SparkSession, changes: DataFrame, path: str, checkpoint: str, buckets: int = 64, most_changes: int = 8):
    """A sink for created, changed and deleted files: each batch is appended to a log of (uri, version, text), see fact_log.

    Only the buckets of files that a batch names are written; those that have
    gathered more than most_changes are compacted. A batch that is run again
    changes nothing.
    """
    fact_log.create(spark, path, StructType.fromDDL("uri string, version long, text string"), buckets)

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("uri").agg(F.max_by(F.struct("version", "action", "text"), "version").alias("_e")).select("uri", "_e.*").persist()
        try:
            fact_log.append(newest.filter("action != 'delete'").select("uri", "version", "text"), newest, path, number)
        finally:
            newest.unpersist()
        fact_log.compact(spark, path, most_changes)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def merged_files(spark: SparkSession, path: str) -> DataFrame:
    """(uri, version, text) of the files that merge_files() has kept at path."""
    return fact_log.read(spark, path)


def sample_windows(samples: DataFrame, op: str = "op", at: str = "ts", value: str = "duration_ms", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Latency samples per operation and window: count, failures, mean and greatest."""
    return (
        samples.withWatermark(at, late).groupBy(F.window(at, width), op)
        .agg(F.count("*").alias("n"), F.sum((~F.col("success")).cast("int")).alias("failures"), F.avg(value).alias("mean"), F.max(value).alias("greatest"))
        .select(F.col("window.start").alias("start"), op, "n", "failures", "mean", "greatest")
    )


# States of an index and where each may go.
TRANSITIONS = {
    "Idle": ["Initializing"], "Initializing": ["Building", "Error"], "Building": ["Ready", "Degraded", "Error"], "Ready": ["Updating", "Building", "Invalidating", "Degraded", "Error"],
    "Updating": ["Ready", "Degraded", "Error"], "Invalidating": ["Building", "Ready", "Error"], "Degraded": ["Building", "Ready", "Error"], "Error": ["Idle", "Initializing"],
}


def run_states(requests: list[str], start: str = "Idle") -> list[tuple[str, bool]]:
    """State after each requested transition, and whether it was allowed."""
    out, state = [], start
    for wanted in requests:
        allowed = wanted in TRANSITIONS[state]
        state = wanted if allowed else state
        out.append((state, allowed))
    return out


def lifecycle(requests: DataFrame, by: str, order: str, wanted: str) -> DataFrame:
    """state and allowed for each transition request of each index, in order: a fold per index."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        done = run_states(frame[wanted].tolist())
        return frame.assign(state=[s for s, _ in done], allowed=[a for _, a in done])

    return requests.groupBy(by).applyInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in requests.schema)}, state string, allowed boolean")
