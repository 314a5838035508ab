"""Indexes of names on disk: posting lists of grams, and names in order.

A gram is a run of one, two or three characters of a lower-cased name. For
each the index holds the numbers of the names that have it. Rows are sorted by
gram and number and dealt by a hash of the gram to folders; files have Bloom
filters on the gram. A search reads the folders and row groups of its rarest
grams only, keeps the names that all of them hold, and confirms these by their
text. Texts shorter than three characters are grams themselves.

The names lie in their order, in files whose statistics tell which range each
holds, so a prefix is a half-open range and few row groups are read.

Defined results: search is by lower-cased text, prefixes are exact; null names
are not indexed, and match nothing; repeated names are one entry, and every
row that has the name is found; an empty query matches all names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lookups, order

#: Folders of posting lists, posting lists that a search intersects, and rows of a row group of names.
FOLDERS, LISTS, GROUP_ROWS = 64, 4, 20_000
POSTINGS, NAMES, GRAMS = "gram string, number long, folder int", "number long, name string", "gram string, names long, folder int"


def folder_of(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(FOLDERS))


def build(names: DataFrame, path: str, column: str = "name") -> None:
    """Writes the index of the column's distinct values to path: names, postings, and how many names each gram has."""
    distinct = names.select(F.col(column).alias("name")).filter(F.col("name").isNotNull()).distinct()
    numbered = order.in_order(distinct, F.col("name").asc(), label="names").select(F.col("_at").alias("number"), "name")
    # The order of the files is that of the names, and of their numbers.
    numbered.sortWithinPartitions("name").write.option("parquet.block.row.count.limit", GROUP_ROWS).parquet(f"{path}/names")
    stored = names_of(names.sparkSession, path)
    low = F.lower("name")

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - n + 1)), lambda i: F.substring(low, i, F.lit(n)))

    grams = stored.select("number", F.explode(F.array_distinct(F.flatten(F.array(runs(1), runs(2), runs(3))))).alias("gram")).filter("gram != ''").withColumn("folder", folder_of(F.col("gram")).cast("int"))
    placed = grams.repartitionByRange("folder", "gram", "number").sortWithinPartitions("folder", "gram", "number")
    placed.write.option("parquet.bloom.filter.enabled#gram", "true").option("parquet.bloom.filter.expected.ndv#gram", "20000").partitionBy("folder").parquet(f"{path}/postings")
    counts = postings(names.sparkSession, path).groupBy("gram", "folder").agg(F.count("*").alias("names"))
    counts.repartitionByRange("folder", "gram").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/grams")


def names_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NAMES).parquet(f"{path}/names")


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings")


def _hashes(spark: SparkSession, grams: list[str]) -> dict[str, int]:
    """The folder of each gram of a query."""
    if not grams:
        return {}
    rows = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", folder_of(F.col("gram")).alias("folder")).collect()
    return {r["gram"]: r["folder"] for r in rows}


def _having(spark: SparkSession, path: str, grams: list[str]) -> DataFrame | None:
    """Numbers of the names with all of the grams, by the rarest LISTS of them; None if there are no grams."""
    folders = _hashes(spark, grams)
    if not folders:
        return None
    counts = spark.read.schema(GRAMS).parquet(f"{path}/grams").filter(F.col("folder").isin(sorted(set(folders.values()))) & F.col("gram").isin(sorted(folders))).select("gram", "names").collect()
    rarest = [r["gram"] for r in sorted(counts, key=lambda r: (r["names"], r["gram"]))][:LISTS]
    lists = [postings(spark, path).filter((F.col("folder") == folders[g]) & (F.col("gram") == g)).select("number") for g in rarest]
    if len(counts) < len(folders):
        return names_of(spark, path).limit(0).select("number")
    found = lists[0]
    for other in lists[1:]:
        found = found.join(other, "number", "left_semi")
    return found


def matching(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(name) of the index that contain the query, in any case."""
    return _matching(spark, path, query, [query.lower()[i : i + 3] for i in range(max(1, len(query.lower()) - 2))], lambda n: F.contains(F.lower(n), F.lit(query.lower())))


def subsequence(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(name) of the index that hold the characters of the query in order, in any case."""
    pattern = "(?s)" + ".*".join(re.escape(c) for c in query.lower())
    return _matching(spark, path, query, list(query.lower()), lambda n: F.lower(n).rlike(pattern))


def _matching(spark: SparkSession, path: str, query: str, grams: list[str], confirmed) -> DataFrame:
    found = _having(spark, path, sorted(set(grams) - {""}))
    names = names_of(spark, path)
    near = names if found is None else names.join(found, "number", "left_semi")
    return near.select("name").filter(confirmed("name"))


def search(spark: SparkSession, path: str, rows: DataFrame, query: str, column: str) -> DataFrame:
    """Rows whose column contains the query, as lookups.search() finds them."""
    return rows.join(matching(spark, path, query).withColumnRenamed("name", column), column, "left_semi").select(*rows.columns)


def ranked_search(spark: SparkSession, path: str, rows: DataFrame, query: str, column: str, ties: list[str], most: int) -> DataFrame:
    """lookups.ranked_search() of the rows whose names the index finds: every tier is a subsequence."""
    near = rows.join(subsequence(spark, path, query).withColumnRenamed("name", column), column, "left_semi").select(*rows.columns)
    return lookups.ranked_search(near, query, column, ties, most)


def after(prefix: str) -> str | None:
    """The least text that is greater than all texts with the prefix, or None."""
    for i in range(len(prefix) - 1, -1, -1):
        point = ord(prefix[i]) + 1
        if point <= 0x10FFFF:
            # Surrogates are no characters.
            return prefix[:i] + chr(0xE000 if 0xD800 <= point < 0xE000 else point)
    return None


def prefixed(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(name) of the index that begin with the prefix: a range of the sorted names."""
    names = names_of(spark, path).filter(F.col("name") >= F.lit(prefix))
    end = after(prefix)
    return (names if end is None else names.filter(F.col("name") < F.lit(end))).select("name")


def completions(spark: SparkSession, path: str, rows: DataFrame, prefix: str, column: str) -> DataFrame:
    """Rows whose column begins with the prefix."""
    return rows.join(prefixed(spark, path, prefix).withColumnRenamed("name", column), column, "left_semi").select(*rows.columns)
