"""Facts of modules do not go by the order in which rows come from tasks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import dimensions
from factloom.plans import catalog


@pytest.fixture
def folder(spark, tmp_path):
    events = [(1, "click"), (2, "view"), (3, "error"), (4, None)]
    spark.createDataFrame(events, "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_exports_in_any_order(spark, folder, monkeypatch):
    known = dimensions.dim_known_export(spark).withColumn("_n", F.monotonically_increasing_id())
    monkeypatch.setattr(dimensions, "dim_known_export", lambda spark: known.orderBy(F.desc("_n")).drop("_n"))
    found = sorted(tuple(r) for r in catalog.QUERIES["module_facts"](spark, folder).collect())
    wanted = duckdb.sql(f"WITH events AS (FROM '{folder}/events.parquet/*.parquet') {catalog.SQL['module_facts']}").fetchall()
    assert found == sorted(wanted)
