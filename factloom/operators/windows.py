"""Ordered computations: deltas, folds, islands, running counts, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from . import order


def delta_encode(tokens: DataFrame, by: list[str], line: str, start: str) -> DataFrame:
    """delta_line, and delta_start: from the token before if on the same line, else from the line's beginning."""
    order = Window.partitionBy(*by).orderBy(line, start)
    before, at = F.lag(line, 1, 0).over(order), F.lag(start, 1, 0).over(order)
    delta = F.col(line) - before
    return tokens.withColumns({"delta_line": delta, "delta_start": F.when(delta == 0, F.col(start) - at).otherwise(F.col(start))})


def delta_decode(encoded: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The inverse of delta_encode: line, and start as the sum of starts since the line began."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    with_line = encoded.withColumn("line", F.sum("delta_line").over(run))
    in_line = Window.partitionBy(*by, "line").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return with_line.withColumn("start", F.sum("delta_start").over(in_line))


def modifier_bits(names: Column, legend: list[str]) -> Column:
    """Bitset of the names by their place in the legend."""
    bits = [F.when(F.array_contains(names, n), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(legend)]
    return sum(bits[1:], bits[0])


def remove_overlaps(tokens: DataFrame, by: list[str], line: str, start: str, length: str) -> DataFrame:
    """Left to right over each line: a token that overlaps the last kept one replaces it if strictly longer, else goes.

    A token that begins after all earlier ones end is kept whatever came
    before, so lines are cut there, and only tokens that overlap in a row are
    folded together.
    """
    others = [c for c in tokens.columns if c not in (*by, line, start, length)]
    order = Window.partitionBy(*by, line).orderBy(start, length, *others)
    farthest = F.max(F.col(start) + F.col(length)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(farthest.isNull() | (F.col(start) >= farthest), 1).otherwise(0)
    item = F.struct(F.col(start).alias("s"), F.col(length).alias("n"), *others)
    cut = tokens.withColumn("_begins", begins).withColumn("_part", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut.groupBy(*by, line, "_part").agg(F.sort_array(F.collect_list(item)).alias("_all"))

    def step(kept: Column, t: Column) -> Column:
        last = F.element_at(kept, -1)
        replaced = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(t))
        return F.when(t["s"] >= last["s"] + last["n"], F.concat(kept, F.array(t))).when(t["n"] > last["n"], replaced).otherwise(kept)

    folded = F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), F.slice("_all", 1, 1), step)
    rows = parts.withColumn("_t", F.explode(folded))
    return rows.select(*by, line, F.col("_t.s").alias(start), F.col("_t.n").alias(length), *[F.col(f"_t.{c}").alias(c) for c in others])


def merge_intervals(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of spans that touch or overlap: an island begins where a span starts after all ends before it."""
    order = Window.partitionBy(*by).orderBy(start, end)
    farthest = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(farthest.isNull() | (F.col(start) > farthest), 1).otherwise(0)
    island = F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.select(*by, start, end).withColumn("_begins", begins).withColumn("_island", island)
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_island")


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: their first and last place and length (gaps and islands)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    among = F.row_number().over(Window.partitionBy(*by, value).orderBy(*order))
    marked = rows.select(*by, value, place.alias("_i"), (place - among).alias("_run"))
    return marked.groupBy(*by, value, "_run").agg(F.min("_i").alias("first_place"), F.max("_i").alias("last_place"), F.count("*").alias("length")).drop("_run")


def hit_counts(hits: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """hit_count: how often each key was hit so far."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("hit_count", F.count("*").over(so_far))


def hit_condition(condition: Column, count: Column) -> Column:
    """Whether a count meets a condition such as ">= 3", "%5" or "2"; none and empty are met, %0 and anything else are not."""
    text = F.trim(condition)
    op = F.regexp_extract(text, r"^(>=|<=|==|=|>|<|%)?\s*(\d+)$", 1)
    n = F.try_to_number(F.regexp_extract(text, r"^(>=|<=|==|=|>|<|%)?\s*(\d+)$", 2), F.lit("999999999999999999")).cast("long")
    test = (
        F.when(op == ">=", count >= n).when(op == "<=", count <= n).when(op.isin("==", "=", ""), count == n)
        .when(op == ">", count > n).when(op == "<", count < n).when(op == "%", F.when(n == 0, F.lit(False)).otherwise(count % F.nullif(n, F.lit(0)) == 0))
    )
    return F.when(condition.isNull() | (text == ""), F.lit(True)).otherwise(F.coalesce(test, F.lit(False)))


def shift_lines(line: Column, start_line: int, delta: int) -> Column:
    """Lines at or after an edit move by delta, not above line 1."""
    return F.when(line >= start_line, F.greatest(F.lit(1), line + delta)).otherwise(line)


def running_shift(edits: DataFrame, by: list[str], order: list[str], shift: Column) -> DataFrame:
    """shift_before: the sum of the shifts of all earlier edits."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("_shift", shift).withColumn("shift_before", F.coalesce(F.sum("_shift").over(earlier), F.lit(0))).drop("_shift")


def map_position(position: Column, start: Column, old_end: Column, new_end: Column) -> Column:
    """A position after an edit: unchanged before it, moved after it, null inside it."""
    return F.when(position < start, position).when(position >= old_end, position + (new_end - old_end))


def unreachable_lines(files: DataFrame) -> DataFrame:
    """(uri, line, after): the first line with text after one that begins with return, die or exit; one per file, lines from 1."""
    lines = files.select("uri", F.posexplode(F.split("text", "\n")).alias("line", "code"))
    order = Window.partitionBy("uri").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.trim("code").rlike(r"^(return|die|exit)"), F.col("line"))
    armed = lines.withColumn("_after", F.last(ends, ignorenulls=True).over(order))
    dead = armed.filter(F.col("_after").isNotNull() & (F.trim("code") != ""))
    return dead.groupBy("uri").agg((F.min("line") + 1).alias("line"), (F.min_by("_after", "line") + 1).alias("after"))


def bracket_depth(files: DataFrame) -> DataFrame:
    """(uri, line, depth): brackets open at each line's end."""
    lines = files.select("uri", F.posexplode(F.split("text", "\n")).alias("line", "code"))
    net = F.regexp_count("code", F.lit(r"[\(\[\{]")) - F.regexp_count("code", F.lit(r"[\)\]\}]"))
    order = Window.partitionBy("uri").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("depth", F.sum(net).over(order)).select("uri", "line", "depth")


def storms(changes: DataFrame, by: list[str], order: str, delta: str, above: int = 10) -> DataFrame:
    """pending and storm after each change: a storm begins above a number of pending parses and ends at none.

    The state is that of the last change that decides: above the threshold it
    is a storm, at zero it is none, in between it is what it was.
    """
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    pending = changes.withColumn("pending", F.sum(delta).over(run))
    decides = F.when(F.col("pending") > above, F.lit(True)).when(F.col("pending") == 0, F.lit(False))
    return pending.withColumn("storm", F.coalesce(F.last(decides, ignorenulls=True).over(run), F.lit(False)))


def refresh_times(requests: DataFrame, by: list[str], at: str, wait_ms: int = 350, ties: list[str] | None = None) -> DataFrame:
    """Requests that a debounced refresh lets through: the first of each burst, a burst ending after a pause of wait_ms."""
    order = Window.partitionBy(*by).orderBy(at, *(ties or []))
    pause = F.col(at) - F.lag(at).over(order)
    return requests.withColumn("_pause", pause).filter(F.col("_pause").isNull() | (F.col("_pause") >= wait_ms)).drop("_pause")


def leading_refreshes(requests: DataFrame, by: list[str], at: str, wait: int, ties: list[str] | None = None) -> DataFrame:
    """Requests that a debounced refresh lets through: the first, and each that is the first to come `wait` or more after the last one let through.

    Every request points to the one that would follow it, found in one sort;
    those that the first one reaches are marked along pointers of doubling length.
    """
    return storage.settled(lambda: _reached(requests, by, at, wait, ties or []), "refreshes")


def _reached(requests: DataFrame, by: list[str], at: str, wait: int, ties: list[str]) -> DataFrame:
    rows = order.in_order(requests, *[F.col(c).asc() for c in (*by, at, *ties)], label="requests")
    target = rows.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_rank"), F.col("_at").alias("_place"), F.col("_at").alias("_target"))
    seeker = rows.select(*by, (F.col(at) + wait).alias("_t"), F.lit(0).alias("_rank"), F.col("_at").alias("_place"), F.lit(None).cast("long").alias("_target"))
    # From the latest on, so that the last target before a seeker is the earliest that is late enough.
    both = order.in_order(target.unionByName(seeker), *[F.col(c).asc() for c in by], F.col("_t").desc(), F.col("_rank").desc(), F.col("_place").desc(), label="next-requests")
    next_ = order.last_before(both, by, "_target", "_next").filter("_rank = 0 and _next is not null").select(F.col("_place").alias("_from"), "_next")
    jumps = storage.staged(next_, "jumps")
    reached = storage.staged(rows.groupBy(*by).agg(F.min("_at").alias("_from")).select("_from"), "reached")
    while True:
        more = storage.staged(reached.join(jumps, "_from").select(F.col("_next").alias("_from")), "reached")
        if more.isEmpty():
            break
        reached = reached.union(more)
        jumps = storage.staged(jumps.join(jumps.select(F.col("_from").alias("_next"), F.col("_next").alias("_far")), "_next").select("_from", F.col("_far").alias("_next")), "jumps")
    return rows.join(reached.select(F.col("_from").alias("_at")), "_at", "left_semi").select(*requests.columns)


def checkpoints(tokens: DataFrame, by: list[str], order: list[str], boundary: Column) -> DataFrame:
    """Tokens at which a lexer can resume."""
    return tokens.filter(boundary).orderBy(*by, *order)
