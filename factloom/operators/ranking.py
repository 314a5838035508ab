"""Orders, limits, and one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_label(items: DataFrame, label: str, sort_key: Column, tie: str) -> DataFrame:
    """Per label the item with the smallest sort key, the earlier one of equals; empty labels go."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(sort_key, tie))
    return items.filter(F.col(label) != "").withColumn("_place", place).filter("_place = 1").drop("_place")


def ordered_completions(items: DataFrame) -> DataFrame:
    """Completions, one per label, by sort key, kind and label."""
    key = F.coalesce("sort_text", "label")
    return best_per_label(items, "label", key, "idx").orderBy(key, "kind", "label")


def dedupe(rows: DataFrame, key: list[str]) -> DataFrame:
    """Distinct rows of the key columns in their order."""
    return rows.select(*key).distinct().orderBy(*key)


def greatest_kind(rows: DataFrame, location: list[str], kind: str) -> DataFrame:
    return rows.groupBy(*location).agg(F.max(kind).alias(kind))


def all_of(*parts: DataFrame) -> DataFrame:
    """All rows of several tables with the same columns, repeats included."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def import_rank(line: Column) -> Column:
    """0 for pragmas, 1 for plain modules, 2 for names with ::, 3 for local paths: by the text of the import."""
    has = lambda w: F.contains(line, F.lit(w))
    pragma = has("strict") | has("warnings") | has("utf8") | has("feature")
    return F.when(pragma, 0).when(has("::"), 2).when(F.startswith(line, F.lit("use lib")) | has("./"), 3).otherwise(1)


def sorted_imports(imports: DataFrame, line: str = "line_text") -> DataFrame:
    """Import lines of each file in their four groups, each sorted."""
    return imports.withColumn("rank", import_rank(F.col(line))).orderBy("uri", "rank", line)


def merged_imports(imports: DataFrame) -> DataFrame:
    """Per file and module one import with all its symbols, sorted."""
    symbols = imports.select("uri", "module", F.explode_outer("symbols").alias("symbol"))
    return symbols.groupBy("uri", "module").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def capped(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows in a stated order: a limit that is part of the feature."""
    return rows.orderBy(*order).limit(most)


def evict(entries: DataFrame, most_items: int, most_bytes: int) -> DataFrame:
    """What a bounded cache holds: the most recently used entries within the number of items and bytes.

    Only the most_items last used can be held, so bytes are summed over those.
    """
    recent = Window.orderBy(F.desc("used_at"), "key").rowsBetween(Window.unboundedPreceding, 0)
    last = entries.orderBy(F.desc("used_at"), "key").limit(most_items)
    return last.withColumn("_bytes", F.sum("bytes").over(recent)).filter(F.col("_bytes") <= most_bytes).drop("_bytes")
