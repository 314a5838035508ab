"""Rows in one global order: numbers, running sums and last values that no task holds a whole group for.

A table is range-sorted once and written; a task of that sort is a chunk.
Windows run inside chunks, and what earlier chunks add is carried over in a
table with one row for each chunk and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

#: Rows of a chunk are numbered from its number times 2 to this power.
CHUNK_BITS = 33


def in_order(df: DataFrame, *keys: Column, label: str = "ordered") -> DataFrame:
    """df with _at, which ascends with the keys, and _chunk, staged. Rows with equal keys are spread over chunks, too."""
    names = df.columns
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(*keys, F.col("_tie").asc()).sortWithinPartitions(*keys, F.col("_tie").asc()).select(*[f"`{c}`" for c in names], F.monotonically_increasing_id().alias("_at"))
    return storage.staged(placed, label).withColumn("_chunk", F.shiftright("_at", CHUNK_BITS))


def _carried(local: DataFrame, group: list[str], totals: DataFrame, carry: str) -> DataFrame:
    """local with the column carry of totals, by chunk and group."""
    keys = ["_chunk", *group]
    named = totals.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], carry)
    match = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)]
    return local.join(named, match, "left").drop(*[f"_of{i}" for i in range(len(keys))])


def sums_before(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of value over the earlier rows of the group, in the order of in_order()."""
    keys = ["_chunk", *group]
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total")).select(*keys, F.sum("_total").over(earlier).alias("_carry"))
    rows = _carried(df.withColumn("_local", F.sum(value).over(inside)), group, totals, "_carry")
    zero = F.lit(0)
    return rows.withColumn(name, F.coalesce("_local", zero) + F.coalesce("_carry", zero)).drop("_local", "_carry")


def last_before(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Adds the last value that is not null among the earlier rows of the group, in the order of in_order()."""
    return lasts_before(df, group, {name: value})


def lasts_before(df: DataFrame, group: list[str], values: dict[str, str]) -> DataFrame:
    """last_before() of several columns at once: values has the new names and the columns that they come from."""
    keys = ["_chunk", *group]
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    found = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(f"_last{i}") for i, v in enumerate(values.values())]
    over = [F.last(f"_last{i}", ignorenulls=True).over(earlier).alias(f"_{i}") for i in range(len(values))]
    totals = df.groupBy(*keys).agg(*found).select(*keys, F.struct(*over).alias("_carry"))
    local = df.withColumns({f"_local{i}": F.last(v, ignorenulls=True).over(inside) for i, v in enumerate(values.values())})
    rows = _carried(local, group, totals, "_carry")
    return rows.withColumns({n: F.coalesce(f"_local{i}", F.col(f"_carry._{i}")) for i, n in enumerate(values)}).drop("_carry", *[f"_local{i}" for i in range(len(values))])


def next_value(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the next row of the group, in the order of in_order(); value must not be null."""
    keys = ["_chunk", *group]
    inside = Window.partitionBy(*keys).orderBy("_at")
    later = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    totals = df.groupBy(*keys).agg(F.min_by(value, "_at").alias("_first")).select(*keys, F.first("_first").over(later).alias("_carry"))
    rows = _carried(df.withColumn("_local", F.lead(value).over(inside)), group, totals, "_carry")
    return rows.withColumn(name, F.coalesce("_local", "_carry")).drop("_local", "_carry")
