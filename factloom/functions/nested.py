"""Arrays, maps and JSON: normalising reports, positions and dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_entries(rows: DataFrame, key: list[str], text: str, value_type: str = "double") -> DataFrame:
    """One row per key of a flat JSON object; malformed text gives none."""
    parsed = F.from_json(text, f"map<string, {value_type}>")
    return rows.select(*key, F.explode(parsed).alias("name", "value"))


def benchmark_rows(reports: DataFrame, text: str = "text") -> DataFrame:
    """(category, name, mean_ns) of benchmark reports in any of three shapes: mean.nanoseconds, mean_ns or mean.point_estimate."""
    whole = reports.select(F.explode(F.from_json(text, "map<string, map<string, string>>")).alias("category", "_entries"))
    entries = whole.select("category", F.explode("_entries").alias("name", "_body"))
    return entries.select("category", "name", mean_ns(F.col("_body")).alias("mean_ns")).filter("mean_ns is not null")


def mean_ns(body: Column) -> Column:
    """The first mean that a JSON body has."""
    paths = ("$.mean.nanoseconds", "$.mean_ns", "$.mean.point_estimate")
    return F.coalesce(*[F.get_json_object(body, p).cast("double") for p in paths])


def position_from_json(text: Column) -> Column:
    return F.from_json(text, "struct<line: int, character: int>")


def position_to_json(line: Column, character: Column) -> Column:
    return F.to_json(F.struct(line.alias("line"), character.alias("character")))


def location_to_json(uri: Column, sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    point = lambda a, b: F.struct(a.alias("line"), b.alias("character"))
    return F.to_json(F.struct(uri.alias("uri"), F.struct(point(sl, sc).alias("start"), point(el, ec).alias("end")).alias("range")))


def file_index(symbols: DataFrame, refs: DataFrame, deps: DataFrame) -> DataFrame:
    """One nested row per file: its symbols, its references by name, and its modules.

    Lists are bounded by what one file holds.
    """
    columns = [c for c in symbols.columns if c != "uri"]
    s = symbols.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("symbols"))
    by_name = refs.groupBy("uri", "name").agg(F.collect_list(F.struct(*[c for c in refs.columns if c not in ("uri", "name")])).alias("_refs"))
    r = by_name.groupBy("uri").agg(F.map_from_entries(F.collect_list(F.struct("name", "_refs"))).alias("refs"))
    d = deps.groupBy("uri").agg(F.sort_array(F.collect_set("module")).alias("modules"))
    return s.join(r, "uri", "full_outer").join(d, "uri", "full_outer")


def stack_frames(outputs: DataFrame, key: list[str], text: str) -> DataFrame:
    """Frames of debugger output lines such as `$ = main::f(1) called from file 'a.pl' line 3`."""
    lines = outputs.select(*key, F.posexplode(F.split(text, "\n")).alias("place", "_line"))
    pattern = r"^\s*[$@.]\s*=\s*([\w:]+)(?:\((.*)\))? called from (?:file )?[`'\"]?(.+?)['\"]? line (\d+)"
    part = lambda i: F.regexp_extract("_line", pattern, i)
    found = lines.filter(F.col("_line").rlike(pattern))
    return found.select(*key, "place", part(1).alias("function"), part(2).alias("arguments"), part(3).alias("path"), part(4).cast("int").alias("line"))


def legend(names: list[str]) -> Column:
    """Map from names to their places."""
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])


def child_count(value: Column) -> Column:
    return F.size(value)
