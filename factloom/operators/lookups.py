"""Filters, point lookups and searches over one fact table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from . import nesting


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns have the given values: symbols of a file, a case by its id."""
    return df.filter(reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in values.items())))


def file_dependencies(deps: DataFrame, uri: str) -> DataFrame:
    return deps.filter(F.col("uri") == uri).select("module").distinct()


def dependents(deps: DataFrame, target: Column, owner: str, item: str) -> DataFrame:
    """Owners among whose items is the target."""
    return deps.filter(F.col(item) == target).select(owner).distinct()


def package_members(symbols: DataFrame, package: str, container: str, qualified: str, prefix: str | None = None) -> DataFrame:
    """Rows in a container, or whose qualified name starts with it (with `package::`, unless a prefix is given); each once."""
    return symbols.filter((F.col(container) == package) | F.startswith(F.col(qualified), F.lit(f"{package}::" if prefix is None else prefix)))


def first_definition(symbols: DataFrame, matches: Column, order: list[str], per: list[str] | None = None) -> DataFrame:
    """The first match in a stated order: of all, or of each key."""
    if not per:
        return symbols.filter(matches).orderBy(*order).limit(1)
    place = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return symbols.filter(matches).withColumn("_place", place).filter("_place = 1").drop("_place")


def search(symbols: DataFrame, query: str, *names: str) -> DataFrame:
    """Case-insensitive substring search over any of the name columns."""
    wanted = query.lower()
    return symbols.filter(reduce(lambda a, b: a | b, (F.contains(F.lower(n), F.lit(wanted)) for n in names)))


def match_tier(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 substring, 3 subsequence, null for no match; an empty query matches as a prefix."""
    wanted, low = query.lower(), F.lower(name)
    subsequence = ".*".join(re.escape(c) for c in wanted)
    return (
        F.when(low == wanted, 0)
        .when(F.startswith(low, F.lit(wanted)), 1)
        .when(F.contains(low, F.lit(wanted)), 2)
        .when(low.rlike(f"(?s){subsequence}"), 3)
    )


def ranked_search(symbols: DataFrame, query: str, name: str, ties: list[str], most: int) -> DataFrame:
    """Matches with their tier: exact ones first, then prefixes, then the others by name; the first `most`."""
    found = symbols.withColumn("tier", match_tier(F.col(name), query)).filter("tier is not null")
    return found.orderBy(F.least("tier", F.lit(2)), name, *ties).limit(most)


def candidate_search(symbols: DataFrame, candidates: DataFrame, key: str, sources: DataFrame, source_key: str) -> DataFrame:
    """Rows whose key is among the candidates and whose source is known."""
    return symbols.join(candidates.select(key).distinct(), key, "left_semi").join(sources.select(source_key).distinct(), source_key, "left_semi")


def narrowest_at(spans: DataFrame, position: Column, start: str, end: str, ties: list[str], inclusive_end: bool = True) -> DataFrame:
    """The narrowest span that holds a position. Semantic lookups include the end; node lookups do not."""
    inside = (F.col(start) <= position) & ((position <= F.col(end)) if inclusive_end else (position < F.col(end)))
    return spans.filter(inside).orderBy(F.col(end) - F.col(start), *ties).limit(1)


def deepest_at(nodes: DataFrame, position: int, start: str = "sb", end: str = "eb", depth: str = "depth") -> DataFrame:
    """The deepest node that holds an offset (half-open)."""
    return nodes.filter((F.col(start) <= position) & (F.lit(position) < F.col(end))).orderBy(F.desc(depth), start).limit(1)


def selection_chain(nodes: DataFrame, position: int, start: str = "sb", end: str = "eb", depth: str = "depth") -> DataFrame:
    """All nodes that hold an offset, from the deepest to the root."""
    return nodes.filter((F.col(start) <= position) & (F.lit(position) < F.col(end))).orderBy(F.desc(depth))


def chains_at(nodes: DataFrame, points: DataFrame, by: str, at: str, start: str = "sb", end: str = "eb", ties: list[str] | None = None) -> DataFrame:
    """selection_chain for points(by, at) of many files: the nodes around each, numbered by `up` from the narrowest."""
    return nesting.around(points, nodes, [by], at, start, end, ties)


def with_any_tag(rows: DataFrame, tags: list[str], column: str = "tags") -> DataFrame:
    """Rows with any of the tags; no tags, all rows."""
    return rows if not tags else rows.filter(F.arrays_overlap(column, F.array(*map(F.lit, tags))))


def with_all_tags(rows: DataFrame, tags: list[str], column: str = "tags") -> DataFrame:
    """Rows with all of the tags; no tags, all rows."""
    return reduce(lambda df, t: df.filter(F.array_contains(column, t)), tags, rows)


def seeded_pick(rows: DataFrame, seed: int, order: list[str]) -> DataFrame:
    """The row at place seed modulo the number of rows, in a stated order.

    Rows are range-sorted once; the sizes of the ranges tell which of them
    holds the place, and only that one is numbered.
    """
    placed = storage.staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "picked")
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    if not sizes:
        return rows.limit(0)
    left = seed % sum(n for _, n in sizes)
    for part, n in sizes:
        if left < n:
            break
        left -= n
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.filter(F.col("_part") == part).withColumn("_n", number).filter(F.col("_n") == left + 1).drop("_part", "_n")


def nearest_line(lines: DataFrame, line: int, direction: str, farthest: int | None = None, column: str = "line") -> DataFrame:
    """The valid line nearest to `line`: "forward", "backward" or "both" (the earlier of two equally near)."""
    distance = F.abs(F.col(column) - line)
    keep = {"forward": F.col(column) >= line, "backward": F.col(column) <= line, "both": F.lit(True)}[direction]
    rows = lines.filter(keep & ((distance <= farthest) if farthest is not None else F.lit(True)))
    return rows.orderBy(distance, column).limit(1)


def not_exempt(rows: DataFrame, exemptions: DataFrame, name: str, pattern: str = "pattern") -> DataFrame:
    """Rows that no exemption names; a pattern that ends in /* exempts all names below it."""
    prefix = F.regexp_replace(pattern, r"\*$", "")
    rule = exemptions.select(F.col(pattern).alias("_pattern"), prefix.alias("_prefix"), F.endswith(F.col(pattern), F.lit("/*")).alias("_wild"))
    hit = (F.col(name) == F.col("_pattern")) | (F.col("_wild") & F.startswith(F.col(name), F.col("_prefix")))
    return rows.join(rule, hit, "left_anti")


def unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is new: neither uri and content hash are known."""
    return files.join(known.select("uri", "content_hash"), ["uri", "content_hash"], "left_anti")


def upsert(facts: DataFrame, new: DataFrame, key: str = "uri") -> DataFrame:
    """facts with the rows of new's keys replaced; new may hold several rows of a key."""
    return facts.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove(facts: DataFrame, keys: DataFrame, key: str = "uri") -> DataFrame:
    return facts.join(keys.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the greatest version."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("_row"))
    return best.select(*key, "_row.*")
