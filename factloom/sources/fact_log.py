"""A table of facts by file as a log: changes are appended, and old ones are merged when read.

Rows belong to files (the column uri), and files to buckets by hash. A batch
of changes writes, in a folder of its number, the new rows of the files that
it touches and a mark for each of them; nothing else is read or written. A
row counts if no later batch has touched its file. Compaction writes the rows
that count of single buckets to one base each, after which older changes of
these buckets are not read any more.

A batch counts once its commit is there, and a base once its own is: both are
files that are moved to their places as a whole. What a failed attempt has left
is overwritten by the next attempt with the same number, and a batch that has
been committed is not written again, so replays change nothing.

    path/table               number of buckets and schema
    path/changes/log_version=V/log_bucket=B/    path/commits/V
    path/base/log_bucket=B/log_version=V/       path/compacted/B/V

Defined results: a touched file without rows is a deleted one; rows with a
null uri belong to a file of their own; numbers of batches ascend, and a lower
one than the last raises an error; one writer appends at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from .. import storage


def create(spark: SparkSession, path: str, schema: StructType, buckets: int = 64) -> None:
    """An empty table of rows with this schema; one that exists stays as it is."""
    if not storage.exists(spark, f"{path}/table"):
        storage.put_text(spark, f"{path}/table", json.dumps({"buckets": buckets, "schema": schema.jsonValue()}))


def _table(spark: SparkSession, path: str) -> tuple[int, StructType]:
    known = json.loads(storage.text_of(spark, f"{path}/table"))
    return known["buckets"], StructType.fromJson(known["schema"])


def bucket_of(uri: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(uri), F.lit(buckets)).cast("int")


def append(rows: DataFrame, touched: DataFrame, path: str, version: int) -> bool:
    """Batch number version: the files touched(uri) now have these rows and no others. False if the batch was committed before."""
    spark = rows.sparkSession
    if storage.exists(spark, f"{path}/commits/{version}"):
        return False
    if any(v > version for v in versions(spark, path)):
        raise ValueError(f"batch {version} comes after later ones")
    buckets, schema = _table(spark, path)
    marks = touched.select("uri").distinct()
    new = rows.select(*schema.names).join(marks, rows["uri"].eqNullSafe(marks["uri"]), "left_semi").withColumn("_put", F.lit(True))
    both = new.unionByName(marks.withColumn("_put", F.lit(False)), allowMissingColumns=True).withColumn("log_bucket", bucket_of(F.col("uri"), buckets))
    both.repartition("log_bucket").write.mode("overwrite").partitionBy("log_bucket").parquet(f"{path}/changes/log_version={version}")
    storage.put_text(spark, f"{path}/commits/{version}", "")
    return True


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed batches."""
    return sorted(int(n) for n in storage.names_in(spark, f"{path}/commits") if n.isdigit())


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """The newest base of each bucket that has one."""
    found = {}
    for bucket in storage.names_in(spark, f"{path}/compacted"):
        numbers = [int(n) for n in storage.names_in(spark, f"{path}/compacted/{bucket}") if n.isdigit()]
        if numbers:
            found[int(bucket)] = max(numbers)
    return found


def changes_of(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """For each bucket the committed batches that its base does not hold."""
    bases, found = _bases(spark, path), {}
    for version in versions(spark, path):
        for name in storage.names_in(spark, f"{path}/changes/log_version={version}"):
            if name.startswith("log_bucket=") and version > bases.get(int(name[11:]), -1):
                found.setdefault(int(name[11:]), []).append(version)
    return found


def read(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame:
    """The rows that count, of all buckets or of some."""
    _, schema = _table(spark, path)
    wanted = lambda b: only is None or b in only
    changed = [f"{path}/changes/log_version={v}/log_bucket={b}" for b, vs in changes_of(spark, path).items() if wanted(b) for v in vs]
    based = [f"{path}/base/log_bucket={b}/log_version={v}" for b, v in _bases(spark, path).items() if wanted(b)]
    known = lambda *more: StructType([*schema, *more])
    flags = StructType().add("_put", BooleanType()).add("log_version", LongType())
    load = lambda where, files, fields: spark.read.schema(fields).option("basePath", f"{path}/{where}").parquet(*files) if files else spark.createDataFrame([], fields)
    base, changes = load("base", based, known()), load("changes", changed, known(*flags))
    newest = changes.filter("not _put").groupBy(F.col("uri").alias("_uri")).agg(F.max("log_version").alias("_newest"))
    same = F.col("uri").eqNullSafe(F.col("_uri"))
    kept = base.join(newest, same, "left_anti").select(*schema.names)
    return kept.unionByName(changes.filter("_put").join(newest, same & (F.col("log_version") == F.col("_newest")), "left_semi").select(*schema.names))


def compact(spark: SparkSession, path: str, most_changes: int = 8) -> list[int]:
    """Gives the buckets with more than so many changes a new base, and deletes what it replaces; returns them."""
    done = versions(spark, path)
    due = sorted(b for b, vs in changes_of(spark, path).items() if len(vs) > most_changes)
    if not due:
        return []
    buckets, _ = _table(spark, path)
    old, version = _bases(spark, path), done[-1]
    rows = read(spark, path, set(due)).withColumn("log_bucket", bucket_of(F.col("uri"), buckets))
    draft = f"{path}/draft-{version}"
    # One job for all of them; a bucket that is left without rows has an empty base.
    rows.repartition("log_bucket").write.mode("overwrite").partitionBy("log_bucket").parquet(draft)
    for b in due:
        target = f"{path}/base/log_bucket={b}/log_version={version}"
        storage.delete_path(spark, target)
        storage.move(spark, f"{draft}/log_bucket={b}", target)
        storage.put_text(spark, f"{path}/compacted/{b}/{version}", "")
        if b in old:
            storage.delete_path(spark, f"{path}/compacted/{b}/{old[b]}")
            storage.delete_path(spark, f"{path}/base/log_bucket={b}/log_version={old[b]}")
        for v in done:
            storage.delete_path(spark, f"{path}/changes/log_version={v}/log_bucket={b}")
    storage.delete_path(spark, draft)
    return due
