"""Half-open spans: predicates and combinations as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def covers(start: Column, end: Column, position: Column) -> Column:
    return (start <= position) & (position < end)


def covers_with_end(start: Column, end: Column, position: Column) -> Column:
    """As semantic lookups do it: the end counts too."""
    return (start <= position) & (position <= end)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def union(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """{start, end} of the smallest span around both."""
    return F.struct(F.least(a_start, b_start).alias("start"), F.greatest(a_end, b_end).alias("end"))


def intersection(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """{start, end} of what both share, or null."""
    start, end = F.greatest(a_start, b_start), F.least(a_end, b_end)
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end")))
