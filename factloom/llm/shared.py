"""Helpers that several operators use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import delete, delete_path, new_path, noted, settled, shared_folder, staged, staged_paths, unread  # noqa: F401  (operators have them from here)

#: Whitespace between words: space and the control characters tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Sends Python at most so many rows at once from now on, for operators whose rows hold whole texts or lists.

    The setting is read when a plan runs, so it is the session's, and is only ever lowered.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def packed(df: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all of df's columns in one struct, row, where their names clash with none."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *used)


def unpacked(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The columns of the struct row, some of them replaced."""
    return df.select(*[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of two lists of columns."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right, strict=True)))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, before: str) -> DataFrame:
    """Adds `before`: the sum of `value` over the earlier rows of the same group, in the order (bucket, *order).

    Rows meet per (group, bucket) only, so a group that holds most rows is
    spread over its buckets; bucket totals, not rows, are summed per group.
    group and bucket columns must not be null.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, bucket, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(offsets, [*group, bucket]).withColumn(before, F.col("_offset") + F.col("_local")).drop("_offset", "_local")
