"""Queries that write and read files, follow streams, and select percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..operators import selection, spans
from ..sources import files as sources
from ..sources import framed
from ..streaming import documents as document_state
from ..streaming import timers
from .registry import query


@query("SELECT '{\"order\": ' || o_orderkey || ', \"status\": \"' || o_orderstatus || '\"}' AS body FROM orders")
def framed_files(t):
    """Orders as framed messages: written by tasks with one commit, and read by ranges of a few kilobytes."""
    framed.register(t.spark)
    path = storage.new_path(t.spark, "framed")
    body = F.concat(F.lit('{"order": '), "o_orderkey", F.lit(', "status": "'), "o_orderstatus", F.lit('"}'))
    t.orders.repartition(4).select(F.lit("").alias("path"), F.lit(0).cast("long").alias("at"), body.alias("body")).write.format("framed").mode("append").save(path)
    return t.spark.read.format("framed").option("rangeBytes", 128 << 10).load(path).select("body")


@query("SELECT o_orderpriority AS name, CASE WHEN count(*) > 100 THEN 'pass' ELSE 'fail' END AS status, count(*) AS duration_ms FROM orders GROUP BY o_orderpriority")
def written_receipts(t):
    """A receipt with a gate for each priority, written and read back."""
    path = storage.new_path(t.spark, "receipt")
    gates = t.orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.when(F.count("*") > 100, "pass").otherwise("fail").alias("status"), F.count("*").alias("duration_ms"))
    sources.write_receipt(gates.withColumn("metrics", F.create_map(F.lit("n"), F.col("duration_ms").cast("double"))), path)
    return sources.receipts(t.spark, path).select("name", "status", "duration_ms")


@query("SELECT max(c_mktsegment) AS latest FROM customer")
def latest_folder(t):
    path = storage.new_path(t.spark, "latest")
    t.customer.select("c_mktsegment", F.col("c_name").alias("value")).write.partitionBy("c_mktsegment").text(path)
    return sources.latest_file(t.spark, path).select(F.regexp_extract("path", "c_mktsegment=([A-Z]+)", 1).alias("latest"))


@query("SELECT o_orderkey, o_orderkey % 97 >= o_custkey % 90 AND o_orderkey % 97 < o_custkey % 90 + 20 AS inside FROM orders")
def covered_bytes(t):
    start = F.col("o_custkey") % 90
    return t.orders.select("o_orderkey", spans.covers(start, start + 20, F.col("o_orderkey") % 97).alias("inside"))


@query("""WITH n AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
 SELECT l_returnflag, max(v) FILTER (WHERE r = ceil(0.5 * n)) AS p50, max(v) FILTER (WHERE r = ceil(0.95 * n)) AS p95, max(v) FILTER (WHERE r = ceil(0.99 * n)) AS p99 FROM n GROUP BY l_returnflag""")
def selected_percentiles(t):
    return selection.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


# Streams over finished tables: what is there is read as a stream, to its end


def _events(t):
    """The events as a stream."""
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


@query("SELECT user_id::VARCHAR AS uri, max(event_id) AS version, max_by(event_type, event_id) AS text FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'")
def streamed_files(t):
    """Each event is a change of its user's file, an error deletes it: a stream into a log of changes."""
    path = storage.new_path(t.spark, "stream")
    action = F.when(F.col("event_type") == "error", "delete").otherwise("change")
    changes = _events(t).select(F.col("user_id").cast("string").alias("uri"), F.col("event_id").alias("version"), action.alias("action"), F.col("event_type").alias("text"))
    document_state.merge_files(t.spark, changes, f"{path}/table", f"{path}/check", buckets=8).trigger(availableNow=True).start().awaitTermination()
    return document_state.merged_files(t.spark, f"{path}/table")


@query("""WITH p AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, sum(CASE WHEN event_type = 'error' THEN -2 ELSE 1 END) OVER w AS pending FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id ROWS UNBOUNDED PRECEDING)),
 d AS (SELECT *, CASE WHEN pending > 3 THEN true WHEN pending = 0 THEN false END AS decided FROM p), l AS (SELECT max(epoch_us(ts) // 1000) - 60000 AS mark FROM events)
 SELECT key, id, pending, storm FROM (SELECT user_id AS key, event_id AS id, pending::BIGINT AS pending, ms, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING), false) AS storm FROM d), l WHERE ms + 1 <= mark""")
def streamed_storms(t):
    """Storms of changes from a stream with timers: all events that the watermark, a minute behind the latest, has passed."""
    path = storage.new_path(t.spark, "stream")
    value = F.when(F.col("event_type") == "error", -2.0).otherwise(1.0)
    rows = _events(t).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), value.alias("value"))
    found = timers.followed(rows, timers.Storms(above=3), "1 minute")
    found.writeStream.format("parquet").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return t.spark.read.schema(found.schema).parquet(f"{path}/out").select("key", "id", "pending", "storm")
