"""Nested spans, asked at many positions at once: the innermost span around each, or all of them.

The spans of a group (a file, say) are nested: of two that overlap, one holds
the other. Their starts and ends and the positions are sorted in one global
order. The running number of open spans is then the level of each row, and the
span of level n around a row is the last one that was opened at level n before
it. So no position meets the spans of its file; the work is that of one sort
and of one window over levels, and a file with most rows is spread over chunks.

Defined results: spans are half-open unless the end counts in, too; empty spans
hold nothing then; of equal spans the one that the ties put first is innermost;
equal positions are rows of their own; rows with a null group or position are
left out. Spans that cross each other give undefined results: crossing() finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order


def _events(points: DataFrame | None, spans: DataFrame, by: list[str], at: str, start: str, end: str, ties: list[str]) -> DataFrame:
    """(by, _pos, _step, _point, _span) in order: at one position ends come first, then starts, outer ones first, then points."""
    packed = F.struct(*[F.col(f"`{c}`") for c in spans.columns])
    held = spans.filter(F.col(start) < F.col(end))
    key = [*by, "_pos", "_rank", "_outer", "_ties"]
    tie = F.struct(*[F.col(c) for c in ties]) if ties else F.struct(F.lit(0).alias("n"))

    def part(df: DataFrame, position: str, rank: int, step: int, outer: Column, own_tie: Column, point: Column, span: Column) -> DataFrame:
        return df.select(*[F.col(b) for b in by], F.col(position).cast("long").alias("_pos"), F.lit(rank).alias("_rank"), F.lit(step).cast("long").alias("_step"), outer.cast("long").alias("_outer"), own_tie.alias("_ties"), point.alias("_point"), span.alias("_span"))

    no_span, no_tie = F.lit(None).cast(spans.select(packed).schema[0].dataType), F.lit(None).cast(spans.select(tie).schema[0].dataType)
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns]) if points is not None else F.struct(F.lit(0).alias("n"))
    no_row = F.lit(None).cast((points if points is not None else spans).select(row).schema[0].dataType)
    events = part(held, start, 1, 1, -F.col(end), tie, no_row, packed).unionByName(part(held, end, 0, -1, F.lit(0), no_tie, no_row, no_span))
    if points is not None:
        asked = points.filter(F.col(at).isNotNull())
        events = events.unionByName(part(asked, at, 2, 0, F.lit(0), no_tie, row, no_span))
    for b in by:
        events = events.filter(F.col(b).isNotNull())
    # Of equal spans the first by ties is opened last.
    return order.in_order(events, *[F.col(k).desc() if k == "_ties" else F.col(k).asc() for k in key], label="nesting")


def _levels(events: DataFrame) -> DataFrame:
    """events with _level, the number of spans open after each: every group closes what it opens, so the sum runs over all groups."""
    return order.sums_before(events, [], "_step", "_open").withColumn("_level", F.col("_open") + F.col("_step")).drop("_open")


def _sought(levels: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, rows of levels whose _sought is a level, with _found: the last span that was opened at that level before."""
    opened = levels.filter("_step = 1").withColumns({"_sought": F.col("_level"), "_asks": F.lit(False), "_set": F.col("_span")})
    seeking = asked.withColumns({"_asks": F.lit(True), "_set": F.lit(None).cast(levels.schema["_span"].dataType)})
    both = opened.unionByName(seeking)
    return order.last_before(both, ["_sought"], "_set", "_found").filter("_asks")


def _with(found: DataFrame, points: DataFrame, spans: DataFrame, by: list[str], *more: str) -> DataFrame:
    """Columns of the point and of the span; those that both have are the point's."""
    own = [F.col(f"_point.`{c}`").alias(c) for c in points.columns]
    others = [F.col(f"_found.`{c}`").alias(c) for c in spans.columns if c not in (*by, *points.columns)]
    return found.select(*own, *others, *more)


def innermost(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str = "sb", end: str = "eb", ties: list[str] | None = None, inclusive_end: bool = False) -> DataFrame:
    """points(by, at, ...) with the narrowest span around each; points that no span holds are left out.

    With inclusive_end a span holds its end, too; there it meets the narrowest of the spans that end there.
    """
    ties = ties or []
    levels = _levels(_events(points, spans, by, at, start, end, ties))
    asked = levels.filter(F.col("_point").isNotNull()).withColumn("_sought", F.col("_level"))
    if not inclusive_end:
        return _with(_sought(levels, asked.filter("_level > 0")), points, spans, by)
    found = _sought(levels, asked)
    width = F.col(end) - F.col(start)
    ending = spans.groupBy(*by, F.col(end).cast("long").alias("_pos")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in spans.columns]), F.struct(width.alias("w"), *[F.col(c) for c in ties])).alias("_ending"))
    both = found.join(ending, [*by, "_pos"], "left")
    size = lambda s: F.col(f"{s}.`{end}`") - F.col(f"{s}.`{start}`")
    order_of = lambda s: F.struct(size(s).alias("w"), *[F.col(f"{s}.`{c}`").alias(f"t{i}") for i, c in enumerate(ties)])
    ends = F.col("_ending").isNotNull() & (F.col("_found").isNull() | (order_of("_ending") < order_of("_found")))
    chosen = both.withColumn("_found", F.when(ends, F.col("_ending")).otherwise(F.col("_found"))).filter(F.col("_found").isNotNull())
    return _with(chosen, points, spans, by)


def around(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str = "sb", end: str = "eb", ties: list[str] | None = None) -> DataFrame:
    """points(by, at, ...) with every span around each, numbered by `up` from the innermost, 0."""
    levels = _levels(_events(points, spans, by, at, start, end, ties or []))
    asked = levels.filter(F.col("_point").isNotNull() & (F.col("_level") > 0)).withColumn("_sought", F.explode(F.sequence(F.lit(1).cast("long"), "_level")))
    return _with(_sought(levels, asked).withColumn("up", (F.col("_level") - F.col("_sought")).cast("int")), points, spans, by, "up")


def parents(spans: DataFrame, by: list[str], start: str = "sb", end: str = "eb", ties: list[str] | None = None) -> DataFrame:
    """spans with level, from 1, and parent: the narrowest other span around each, as a struct, or null."""
    levels = _levels(_events(None, spans, by, start, start, end, ties or []))
    asked = levels.filter("_step = 1").withColumn("_sought", F.col("_level") - 1)
    found = _sought(levels, asked)
    return found.select(*[F.col(f"_span.`{c}`").alias(c) for c in spans.columns], F.col("_level").alias("level"), F.when(F.col("_sought") > 0, F.col("_found")).alias("parent"))


def crossing(spans: DataFrame, by: list[str], start: str = "sb", end: str = "eb") -> DataFrame:
    """Spans that end after the last one that was opened before them and holds their start; none if all are nested."""
    found = parents(spans, by, start, end)
    return found.filter((F.col(f"parent.`{end}`") < F.col(end)) | (F.col(f"parent.`{end}`") <= F.col(start)))
