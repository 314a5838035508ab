"""Tables that are written on the way to a result, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Folders of staged tables that are still there, and for each thread the lists that note them for an earlier deletion.
_written: dict[str, SparkSession] = {}
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder serves a local[...] session, whose
    driver and executors are one process; a cluster without it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    folder = tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    return path


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files of a known schema, all of whose fields may be null; a folder without files is an empty table."""
    nullable = StructType.fromJson(schema.jsonValue())
    for field in nullable:
        field.nullable = True
    return spark.read.schema(nullable).parquet(path)


def staged(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: a cut in the lineage that outlives executors."""
    path = new_path(df.sparkSession, label)
    df.write.partitionBy(*partitions).parquet(path)
    return read(df.sparkSession, path, df.schema)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Within it, the folders of staged tables are added to paths."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append(paths)
    try:
        yield
    finally:
        _scopes.open.pop()


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make() returns, staged. What was staged on the way to it is deleted then."""
    inner: list[str] = []
    with noted(inner):
        made = make()
    out = staged(made, label)
    delete(inner)
    return out


def folders(*tables: DataFrame) -> set[str]:
    """Names of the folders that tables are read from."""
    return {f.rsplit("/", 2)[-2] for t in tables for f in t.inputFiles()}


def unread(paths: list[str], df: DataFrame) -> list[str]:
    """Those of the paths that df does not read."""
    read_ = folders(df)
    return [p for p in paths if p.rsplit("/", 1)[-1] not in read_]


def staged_paths(*tables: DataFrame) -> list[str]:
    """The folders of staged tables."""
    read_ = folders(*tables)
    return [p for p in _written if p.rsplit("/", 1)[-1] in read_]


def delete(paths: list[str]) -> None:
    """Deletes staged tables that nothing will read any more."""
    for path in list(paths):
        spark = _written.pop(path, None)
        if spark is not None:
            delete_path(spark, path)


def _place(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    system, target = _place(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _place(spark, path)
    return system.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, sorted; none if it is missing."""
    system, target = _place(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and moved there as a whole."""
    system, target = _place(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    system.mkdirs(target.getParent())
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(target, False)
    if not system.rename(draft, target):
        raise OSError(f"{path} cannot be written")


def move(spark: SparkSession, source: str, target: str) -> None:
    """A folder moved to where nothing is; a missing one becomes an empty one."""
    system, to = _place(spark, target)
    system.mkdirs(to.getParent())
    if not exists(spark, source):
        system.mkdirs(to)
    elif not system.rename(_place(spark, source)[1], to):
        raise OSError(f"{source} cannot be moved")


def text_of(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # the session may be gone by now, and its folder with it
            return
