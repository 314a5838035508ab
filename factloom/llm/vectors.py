"""Reading vectors of a table in blocks that a task can hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that one task answers against one shard.
QUERIES_PER_BLOCK = 4_096


def usable(vector: Column, zero: bool) -> Column:
    """Not null, all components finite; where zero is false, not zero either."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & (F.lit(zero) | F.exists(vector, lambda x: x != 0)), F.lit(False))


def matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    width = max([width or 0, *map(len, column)]) if len(column) else width or 0
    out = np.zeros((len(column), width))
    for i, row in enumerate(column):
        out[i, : len(row)] = row
    return out


def shard_count(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))


def with_shard(df: DataFrame, id_column: str, shards: int, seed: int) -> DataFrame:
    """Deals rows evenly, by a hash of id and vector, so equal vectors and repeated ids are spread too."""
    return df.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), id_column, "vector"), F.lit(shards)).cast("int"))


def query_blocks(queries: DataFrame, count: int) -> DataFrame:
    """Adds block: blocks of about QUERIES_PER_BLOCK queries."""
    return queries.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(shard_count(count, QUERIES_PER_BLOCK))).cast("int"))
