"""Exact percentiles of very large groups: ranks are looked up in histograms that are refined.

The values of a group between its least and its greatest are counted in bins.
The bin that holds a rank is the next range, with its own least and greatest
value, and so on, until a range has few values or a single one. Counts are
combined before they are shuffled, so a group of any size sends each task no
more than its bins, and nothing ever holds the values of a group.

Each round narrows a range of values by a factor of BINS, so two or three
rounds are the rule; values that differ by many orders of magnitude take more.

Defined results: the percentile q of n values is the one of rank ceil(q * n),
the first at least, in Spark's order (NaN is the greatest); null values do not
count, and a group without others gets nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

#: Bins of a range, and values of a range from which on they are not sorted but counted.
BINS, FEW = 2_048, 20_000


def percentiles(samples: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each of the shares): the values at those shares of each group."""
    return storage.settled(lambda: _percentiles(samples, by, value, shares), "percentiles")


def _percentiles(samples: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    rows = samples.select(*by, F.col(value).cast("double").alias("_v"))
    known = F.col("_v").isNotNull()
    plain = known & ~F.isnan("_v") & ~F.abs(F.col("_v")).isin(float("inf"))
    size = F.count("_v")
    ends = rows.groupBy(*by).agg(size.alias("_n"), F.min(F.when(plain, F.col("_v"))).alias("_low"), F.max(F.when(plain, F.col("_v"))).alias("_high"))
    asked = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(q).alias("_q")) for n, q in shares.items()])
    targets = ends.withColumn("_s", F.explode(asked)).select(*by, "_s._name", F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("_s._q"))).cast("long").alias("_rank"), "_n", F.coalesce("_low", F.lit(0.0)).alias("_low"), F.coalesce("_high", F.lit(0.0)).alias("_high"), F.lit(True).alias("_ends"))
    targets = storage.staged(targets, "ranks")
    # In the first round values that are not finite have bins of their own at both ends.
    found, open_ = [targets.filter("_n = 0")], targets.filter("_n > 0")
    while not open_.isEmpty():
        narrowed = storage.staged(_narrowed(rows, open_, by), "ranks")
        found.append(narrowed.filter("_low <=> _high"))
        found.append(_sorted(rows, narrowed.filter(f"not (_low <=> _high) and _n <= {FEW}"), by))
        open_ = narrowed.filter(f"not (_low <=> _high) and _n > {FEW}")
    every = found[0].withColumn("_low", F.lit(None).cast("double"))
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_low"))).alias(n) for n in shares])


def _inside(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Values with each range that they lie in; ranges that several ranks share are one."""
    ranges = targets.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], "_low", "_high", "_ends").distinct()
    same = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    within = F.col("_ends") | ((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    return rows.filter(F.col("_v").isNotNull()).join(ranges, [*same, within], "inner").drop(*[f"_by{i}" for i in range(len(by))])


def _narrowed(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """The ranges of the bins that hold the ranks."""
    key = [*by, "_low", "_high", "_ends"]
    # Halves, as the width of a range may be more than the greatest number.
    part = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * BINS
    inner = F.least(F.lit(BINS - 1), F.floor(part)).cast("int")
    bin_ = F.when(F.isnan("_v"), BINS + 1).when(F.col("_v") == float("inf"), BINS).when(F.col("_v") == float("-inf"), -1).when(F.col("_high") > F.col("_low"), inner).otherwise(0)
    counts = _inside(rows, targets, by).groupBy(*key, bin_.alias("_bin")).agg(F.count("*").alias("_count"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    before = F.coalesce(F.sum("_count").over(Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = counts.withColumn("_before", before)
    names = {k: f"_k{i}" for i, k in enumerate(key)}
    bins = bins.select(*[F.col(k).alias(n) for k, n in names.items()], "_before", "_count", "_least", "_most")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    hit = targets.join(bins, [*same, (F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_count"))], "inner")
    return hit.select(*by, "_name", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_count").alias("_n"), F.col("_least").alias("_low"), F.col("_most").alias("_high"), F.lit(False).alias("_ends"))


def _sorted(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """The values at the ranks of ranges with few values."""
    key = [*by, "_low", "_high", "_ends"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_v"))
    names = {k: f"_k{i}" for i, k in enumerate(key)}
    placed = _inside(rows, targets, by).withColumn("_place", place).select(*[F.col(k).alias(n) for k, n in names.items()], "_place", "_v")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return targets.join(placed, [*same, F.col("_place") == F.col("_rank")], "inner").select(*by, "_name", "_rank", "_n", F.col("_v").alias("_low"), F.col("_v").alias("_high"), "_ends")
