"""Rows that wait for the watermark cost few calls to the state, equal rows all count, and idle keys start anew."""

import collections
import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import windows
from factloom.plans import catalog
from factloom.streaming import timers

START = datetime.datetime(2024, 1, 1)


class Counting:
    """A handle that counts what it and its states are asked."""

    def __init__(self):
        self.calls = collections.Counter()

    def __getattr__(self, name):
        if name.startswith("get") and name.endswith("State"):
            return lambda *_: self
        return lambda *_: self.calls.update([name])


def test_calls_do_not_grow_with_rows():
    handle, processor = Counting(), timers.Storms(above=3)
    processor.init(handle)
    rows = pd.DataFrame({"key": ["a", "b"] * 250, "ms": range(500), "id": range(500), "value": [1.0] * 500})
    list(processor.handleInputRows(("a",), iter([rows]), None))
    assert handle.calls.total() <= 10


def test_equal_rows_and_the_edge_of_the_watermark(spark, tmp_path):
    at = lambda ms: START + datetime.timedelta(milliseconds=ms)
    rows = [(i, at(i // 3 * 200), i % 3, "error" if i % 11 == 0 else "click") for i in range(200)]
    # Rows that are alike in everything, and keys whose only row is the last before the watermark, or the first after it.
    rows += [(500, at(5_000), 1, "click")] * 4 + [(501, at(9_999), 20, "click"), (502, at(10_000), 21, "click"), (503, at(70_000), 22, "click")]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type"]).astype({"ts": "datetime64[us]"})
    duckdb.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    found = sorted(tuple(r) for r in catalog.QUERIES["streamed_storms"](spark, str(tmp_path)).collect())
    wanted = duckdb.sql(catalog.SQL["streamed_storms"]).fetchall()
    assert found == sorted(wanted) and {20} <= {r[0] for r in found} and not {21, 22} & {r[0] for r in found}


@pytest.mark.parametrize("kind", ["timestamp", "binary"])
def test_idle_keys_start_anew(spark, tmp_path, kind):
    """Whether rows come in one batch or in several; keys come back as they were."""
    seconds = [0, 10, 20, 500, 510, 900, 5000]
    stream = spark.readStream.schema("n long, ts timestamp, id long").parquet(f"{tmp_path}/in/*")
    key = F.timestamp_micros(F.col("n") * 1_000_003) if kind == "timestamp" else F.encode(F.col("n").cast("string"), "utf-8")
    found = timers.followed(stream.select(key.alias("key"), "ts", "id", F.lit(1.0).alias("value")), timers.Storms(above=2, idle_ms=300_000), "1 second")

    for batch, times in enumerate([[0, 10], [20, 500, 510], [900], [5000], [20_000]]):
        rows = [(n, START + datetime.timedelta(seconds=s), s) for n in (1, 2) for s in times]
        spark.createDataFrame(rows, "n long, ts timestamp, id long").coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
        found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    wanted, last, pending, storm = [], None, 0, False
    for s in seconds:
        if last is not None and s - last >= 300:
            pending, storm = 0, False
        pending, last = pending + 1, s
        storm = storm or pending > 2
        wanted.append((s, pending, storm))
    for n in (1, 2):
        same = F.timestamp_micros(F.lit(n * 1_000_003)) if kind == "timestamp" else F.encode(F.lit(str(n)), "utf-8")
        rows = spark.read.parquet(f"{tmp_path}/out").filter(F.col("key") == same)
        assert sorted((r.id, r.pending, r.storm) for r in rows.collect()) == wanted


def test_parts_of_shared_groups(spark, tmp_path, monkeypatch):
    """Keys share a group, and what waits fills several parts from batch to batch."""
    monkeypatch.setattr(timers, "BUCKETS", 2)
    monkeypatch.setattr(timers, "PART_ROWS", 7)
    stream = spark.readStream.schema("key string, ts timestamp, id long, value double").parquet(f"{tmp_path}/in/*")
    found = timers.followed(stream, timers.Storms(above=4), "10 minutes")
    rows = [("abcde"[i * i % 5], START + datetime.timedelta(seconds=i * 15 + i * 37 % 100), i, -1.0 if i % 4 == 3 else 1.0) for i in range(240)]
    for batch, some in enumerate([rows[:100], rows[100:110], rows[110:], [("z", START + datetime.timedelta(days=1), 999, 0.0)]]):
        spark.createDataFrame(some, "key string, ts timestamp, id long, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
        found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    table = spark.createDataFrame(rows, "key string, ts timestamp, id long, value double").withColumn("ms", F.unix_millis("ts"))
    ordered = table.withColumn("place", F.struct("ms", "id")).withColumn("delta", F.col("value").cast("long"))
    wanted = windows.storms(ordered, ["key"], "place", "delta", above=4).select("key", "ms", "id", "pending", "storm")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.key != "z")
    assert got == sorted(tuple(r) for r in wanted.collect()) and len(got) == 240
