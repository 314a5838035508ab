"""Stateful streams give what windows over the finished table give, also after a restart."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import windows
from factloom.streaming import timers

SCHEMA = "key string, ts timestamp, id long, value double"
START = 1_700_000_000_000


def made():
    """Rows of three keys over an hour, slightly out of order, and one far later row that lets the watermark pass all others."""
    rnd, rows = random.Random(3), []
    for i in range(240):
        rows.append((rnd.choice("abc"), START + i * 15_000 + rnd.randint(-200_000, 200_000) // 1000 * 1000, i, rnd.choice([1.0, 1.0, 1.0, -1.0])))
    return rows, ("z", START + 10**8, 999, 0.0)


def written(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"key": k, "ts": f"{__import__('datetime').datetime.fromtimestamp(ms / 1000, __import__('datetime').timezone.utc).isoformat()}", "id": i, "value": v}) for k, ms, i, v in rows))


@pytest.mark.parametrize("kind", ["refreshes", "storms", "samples"])
def test_equals_batch(spark, tmp_path, kind):
    rows, last = made()
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    processor = {"refreshes": lambda: timers.Refreshes(120_000, idle_ms=200_000), "storms": lambda: timers.Storms(4), "samples": lambda: timers.Samples(5)}[kind]
    stream = spark.readStream.schema(SCHEMA).json(str(source))

    def run():
        query = timers.followed(stream, processor(), "10 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start(out)
        query.processAllAvailable()
        query.stop()

    # The second run starts anew from the checkpoint, with rows that still wait.
    written(source, "1.json", rows[:150])
    run()
    written(source, "2.json", rows[150:])
    run()
    written(source, "3.json", [last])
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect() if r.key != "z")
    table = spark.createDataFrame(rows, "key string, ms long, id long, value double")
    if kind == "refreshes":
        wanted = windows.leading_refreshes(table, ["key"], "ms", 120_000, ["id"]).select("key", "ms", "id")
    elif kind == "storms":
        ordered = table.withColumn("place", F.struct("ms", "id")).withColumn("delta", F.col("value").cast("long"))
        wanted = windows.storms(ordered, ["key"], "place", "delta", above=4).select("key", "ms", "id", "pending", "storm")
    else:
        window = "over (partition by key order by ms, id rows between 4 preceding and current row)"
        wanted = table.selectExpr("key", "ms", "id", f"count(*) {window}", f"avg(value) {window}", f"max(value) {window}")
    assert got == sorted(tuple(r) for r in wanted.collect()) and len(got) > 20
