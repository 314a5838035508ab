"""Counts, rates, percentiles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(df: DataFrame, group: list[str], distinct: str) -> DataFrame:
    """Rows and distinct keys per group."""
    return df.groupBy(*group).agg(F.count("*").alias("n_rows"), F.count_distinct(distinct).alias("n_keys"))


def check_limits(counts: dict[str, tuple[Column, int]], df: DataFrame) -> DataFrame:
    """Totals of df against limits; violation names the first one exceeded."""
    out = df.agg(*[c.alias(k) for k, (c, _) in counts.items()])
    first = F.lit(None).cast("string")
    for name, (_, limit) in reversed(counts.items()):
        first = F.when(F.col(name) > limit, name).otherwise(first)
    return out.withColumn("violation", first)


def slo_statistics(samples: DataFrame, op: str, value: str, failed: Column, target: Column) -> DataFrame:
    """Per operation: count, failures, error rate, nearest-rank percentiles, mean, and whether the 95th meets the target."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    stats = samples.groupBy(op).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("failures"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.avg(value).alias("mean")
    )
    rate = hit_rate(F.col("failures"), F.col("n") - F.col("failures"))
    return stats.withColumn("error_rate", rate).withColumn("met", F.coalesce(F.col("p95") <= target, F.lit(True)))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses == 0, F.lit(0.0)).otherwise(hits / (hits + misses))


def category_counts(df: DataFrame, group: list[str], **conditions: Column) -> DataFrame:
    """Conditional counts, in one pass."""
    return df.groupBy(*group).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def with_total(df: DataFrame, column: str, **values: Column) -> DataFrame:
    """Aggregates per value of a column and, where it is null and is_total is 1, over all."""
    out = df.rollup(column).agg(F.grouping(column).alias("is_total"), *[v.alias(n) for n, v in values.items()])
    return out.withColumn("is_total", F.col("is_total").cast("int"))


def coverage(known: DataFrame, seen: DataFrame, key: str, seen_key: str, rare: int) -> DataFrame:
    """Known keys with their count in seen, share of all, and a class: never, at risk (fewer than rare) or covered."""
    counts = seen.groupBy(F.col(seen_key).alias(key)).agg(F.count("*").alias("n_seen"))
    joined = known.join(counts, key, "left").withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
    return joined.withColumn("risk", F.when(F.col("n_seen") == 0, "never").when(F.col("n_seen") < rare, "at_risk").otherwise("covered"))


def index_rows(df: DataFrame, tag: str, item: str) -> DataFrame:
    """(tag, item), each once: an index whose lists may be of any length."""
    return df.select(tag, item).distinct()


def inverted_index(df: DataFrame, tag: str, item: str) -> DataFrame:
    """Per tag its items, sorted and each once: lists that a row can hold; index_rows is for longer ones."""
    return df.groupBy(tag).agg(F.sort_array(F.collect_set(item)).alias("items"))


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys of several rows, with their number; keys, which may be long, are shuffled only if their hash repeats."""
    rows = df.select(*key, F.xxhash64(*key).alias("_h"))
    twice = rows.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h")
    return rows.join(twice, "_h", "left_semi").groupBy("_h", *key).agg(F.count("*").alias("n")).filter("n > 1").drop("_h")


def trend(history: DataFrame, at: str, value: str) -> DataFrame:
    """First, last and average value, and the direction: increasing above 1.1 times the first, decreasing below 0.9 times."""
    out = history.agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.avg(value).alias("average"), F.count("*").alias("points"))
    direction = F.when(F.col("last_value") > F.col("first_value") * 1.1, "increasing").when(F.col("last_value") < F.col("first_value") * 0.9, "decreasing").otherwise("stable")
    return out.withColumn("direction", direction)


def last_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group; order ascends."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*[c.desc() for c in order]))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def recent_variance(history: DataFrame, at: str, value: str, n: int = 10) -> DataFrame:
    """Population variance of the last n values if there are more than n, else 0."""
    recent = history.orderBy(F.desc(at)).limit(n).agg(F.var_pop(value).alias("_v"))
    return recent.crossJoin(history.agg(F.count("*").alias("points"))).select("points", F.when(F.col("points") > n, F.col("_v")).otherwise(F.lit(0.0)).alias("variance"))


def regression_check(current: Column, baseline: Column, most_absolute: float, most_percent: float) -> Column:
    """{increase, percent, exceeded}: against an absolute and a relative threshold."""
    increase = current - baseline
    percent = F.when(baseline == 0, F.lit(0.0)).otherwise(increase / baseline * 100)
    return F.struct(increase.alias("increase"), percent.alias("percent"), ((increase > most_absolute) | (percent > most_percent)).alias("exceeded"))


def quality_score(*penalties: Column) -> Column:
    """100 less all penalties, between 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - sum(penalties[1:], penalties[0])))


def token_ranking(names: DataFrame, key: str, tokens: Column, query: list[str]) -> DataFrame:
    """Rows by the number of distinct query tokens among theirs."""
    hits = names.select(key, F.size(F.array_intersect(tokens, F.array(*map(F.lit, query)))).alias("matches"))
    return hits.filter("matches > 0")


def severity_of_change(percent: Column, thresholds: list[tuple[float, str]], otherwise: str) -> Column:
    """The first level whose threshold the change exceeds; thresholds descend."""
    out = F.lit(otherwise)
    for limit, level in reversed(thresholds):
        out = F.when(percent > limit, level).otherwise(out)
    return out
