"""A log of changes against a plain dictionary of files."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from factloom.sources import fact_log

SCHEMA = StructType().add("uri", StringType()).add("n", IntegerType()).add("version", StringType())


def rows_of(spark, files):
    return spark.createDataFrame([(u, n, "x") for u, ns in files.items() for n in ns], SCHEMA), spark.createDataFrame([(u,) for u in files], "uri string")


def held(spark, path):
    found = {}
    for r in fact_log.read(spark, path).collect():
        found.setdefault(r.uri, []).append(r.n)
    return {u: sorted(ns) for u, ns in found.items()}


def listing(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_random_batches(spark, tmp_path):
    rnd, path, plain = random.Random(1), str(tmp_path / "log"), {}
    fact_log.create(spark, path, SCHEMA, buckets=4)
    assert held(spark, path) == {}
    for version in range(9):
        files = {rnd.choice([*"abcdefgh", None]): [rnd.randint(0, 99) for _ in range(rnd.choice([0, 1, 3]))] for _ in range(3)}
        if version in (3, 6):
            # An attempt that fails before its commit leaves files, which the next attempt overwrites.
            wrong = rows_of(spark, dict.fromkeys([*files, "z"], [1]))
            fact_log.append(*wrong, path, version)
            os.remove(f"{path}/commits/{version}")
            assert held(spark, path) == {u: sorted(ns) for u, ns in plain.items() if ns}
        assert fact_log.append(*rows_of(spark, files), path, version)
        assert not fact_log.append(*rows_of(spark, dict.fromkeys(files, [7])), path, version)
        plain |= files
        if version in (4, 5, 8):
            fact_log.compact(spark, path, most_changes=1)
        assert held(spark, path) == {u: sorted(ns) for u, ns in plain.items() if ns}
    with pytest.raises(ValueError, match="later ones"):
        fact_log.append(*rows_of(spark, {"a": [1]}), path, -1)


def test_a_change_writes_one_bucket(spark, tmp_path):
    path = str(tmp_path / "log")
    fact_log.create(spark, path, SCHEMA, buckets=16)
    fact_log.append(*rows_of(spark, {f"f{i}": [i, i + 1] for i in range(200)}), path, 0)
    before = listing(path)
    fact_log.append(*rows_of(spark, {"f7": [99]}), path, 1)
    new = {f for f in listing(path) if f not in before}
    assert {f.split("bucket=")[1].split("/")[0] for f in new} == {str(spark.range(1).select(fact_log.bucket_of(F.lit("f7"), 16)).first()[0])}
    between = listing(path)
    (bucket,) = fact_log.compact(spark, path, most_changes=1)
    after = listing(path)
    assert all(after[f] == between[f] for f in after if f in between)
    assert {f.split("bucket=")[1].split("/")[0] for f in set(after) ^ set(between)} == {str(bucket)}
    assert held(spark, path)["f7"] == [99] and len(held(spark, path)) == 200
