"""Percentiles by refined histograms against sorted values."""

import math
import random

from pyspark.sql import functions as F

from factloom.operators import selection

SHARES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def test_odd_values(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 5)
    rnd, rows = random.Random(7), []
    for group in ("a", "b", "same", "wide", None):
        for _ in range(300):
            v = {"same": 3.5, "wide": rnd.choice([1e300, -1e300, 1e-300, 0.0, 5e-324, 1.0]) * rnd.random()}.get(group, rnd.randint(0, 40) / 8)
            rows.append((group, v))
    rows += [("b", float(x)) for x in ("inf", "-inf", "nan", "nan")] * 20 + [("a", None)] * 9 + [("none", None), ("one", -2.0), ("nans", math.nan), ("infs", math.inf)]
    found = selection.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", SHARES).collect()
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).extend([v] if v is not None else [])
    assert len(found) == len(groups)
    for r in found:
        ordered = sorted(groups[r.g], key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0))
        for name, q in SHARES.items():
            wanted = ordered[max(1, math.ceil(q * len(ordered))) - 1] if ordered else None
            assert repr(r[name]) == repr(wanted)


def test_one_group_of_ten_million(spark):
    n = 10_000_000
    rows = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    found = selection.percentiles(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    assert tuple(found) == (1, n / 2 - 1, n * 0.95 - 1, n * 0.99 - 1)
