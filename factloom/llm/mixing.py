"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents that may be served several
times over. A document's virtual finish time is the number of its source's
words up to its end, divided by the source's target. Documents are served in
the order of that time, which is a global range sort, and the mix is truncated
at virtual time 1. All sources reach their targets then, so that is where the
total budget (the sum of all targets) is spent. A document that is being
served then is cut after the word it has reached, so every source gets its
target to within a word.

Targets are computed where the sources are: weights go by rank, capped sources
are a prefix of those in the order of size by weight, and what is left is
shared among the others, all by running sums over one row a source.

Defined results: null text has size 0 and is never taken; null source is a
source of its own, which sorts last; a source without words has target 0;
documents without words are in no mix; repeated rows are documents of their
own; an empty table gives an empty result. Columns other than doc_id, text and
source are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows that one bucket of the shuffled order holds on average.
BUCKET_ROWS = 2_000


def targets(sizes: DataFrame, weights: tuple[float, ...], budget_share: float, repeats: int) -> DataFrame:
    """sizes(_key, source_size) with target: shares of the budget by weight, none above `repeats` times its size, the excess reshared.

    In the order of size by weight, a source is capped if its share of what the
    capped ones before it leave is more than its cap; the first that is not
    sets the share by weight of all from it on.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_key") == "n", "_key")) - 1
    cyclic = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("_weight", F.get(cyclic, (rank % len(weights)).cast("int"))).withColumn("_cap", repeats * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_key")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = budget_share * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    share = left / (F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0.0)))
    shares = weighed.withColumn("_share", share).withColumn("_place", F.row_number().over(order))
    open_ = F.when(F.col("_cap") >= F.col("_weight") * F.col("_share"), F.struct("_place", "_share"))
    shares = shares.withColumn("_first", F.min(open_).over(whole))
    capped = F.col("_first").isNull() | (F.col("_place") < F.col("_first._place"))
    return shares.select("_key", "source_size", F.when(capped, F.col("_cap")).otherwise(F.col("_weight") * F.col("_first._share")).alias("target"))


def source_key() -> F.Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def schedule(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget_share: float = 1.5, repeats: int = 2, seed: int = 20, row_id: str | None = None) -> DataFrame:
    """One row per document and round of its source, in no order.

    row_id numbers the documents (ties and repeated rows get numbers of their
    own) unless a column of docs that does so is named, served is the number of words of this round that are taken, and
    virtual_finish is the time that orders the mix. Weights go to the sources
    in code-point order, again and again.
    """
    sized = shared.staged(
        docs.select((F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row_id"), "doc_id", "source", source_key().alias("_key"), shared.word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_shuffle")),
        "mix-sizes",
    )
    totals = shared.staged(sized.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), "mix-totals")
    sources = targets(totals, weights, budget_share, repeats)
    rows = totals.agg(F.sum("_rows")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)))
    bucket = F.shiftrightunsigned("_shuffle", 64 - bits) if bits else F.lit(0)
    rows = sized.withColumn("_bucket", bucket.cast("long"))
    rows = shared.running_total(rows, ["_key"], "_bucket", [F.col("_shuffle"), F.col("doc_id"), F.col("row_id")], "size", "_before")
    rows = rows.join(sources, "_key")
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    begin = F.col("_before") + F.col("round") * F.col("source_size")
    served = F.least(F.col("size"), F.greatest(F.lit(0), F.floor(F.col("target") - begin)))
    finish = F.when(F.col("target") > 0, (begin + F.col("size")) / F.col("target")).otherwise(F.lit(float("inf")))
    return rows.select("row_id", "doc_id", "source", "size", "source_size", "target", "round", F.coalesce(served, F.lit(0)).cast("long").alias("served"), finish.alias("virtual_finish"))


def in_order(rows: DataFrame, finish: str, doc_id: str) -> DataFrame:
    """rows, range-sorted by virtual finish time; ties by id."""
    return rows.repartitionByRange(finish, doc_id).sortWithinPartitions(finish, doc_id)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rounds of documents that get any words, range-sorted by virtual finish time."""
    return in_order(schedule(docs, **settings).filter("served > 0"), "virtual_finish", "doc_id")


def taken_words(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: the words taken in all rounds, range-sorted by the virtual time at which the first round ends."""
    found = schedule(docs, **settings).groupBy("row_id", "doc_id", "size", "source_size", "target").agg(F.sum("served").alias("taken"), F.min("virtual_finish").alias("_first"))
    return in_order(found, "_first", "doc_id").drop("row_id", "_first")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """documents in the order of the mix, each as often as it is taken whole, and cut after its last taken word where the budget ends inside it."""
    names = docs.columns
    rows = shared.staged(shared.packed(docs).withColumn("_row", F.monotonically_increasing_id()), "mix-documents")
    sized = rows.select("_row", *[F.col(f"row.{c}").alias(c) for c in ("doc_id", "text", "source")])
    taken = schedule(sized, **settings, row_id="_row").filter("served > 0")
    taken = taken.select(F.col("row_id").alias("_row"), F.col("size").alias("_size"), F.col("served").alias("_words"), F.col("virtual_finish").alias("_finish"))
    cut = in_order(rows.join(taken, "_row"), "_finish", "row.doc_id")
    # Split off what follows the last taken word: a split at white space into one piece more than there are words.
    space = F.lit(r"[\x20\x09-\x0D]+")
    text = F.col("row.text")
    pieces = F.col("_words") + 1 + text.rlike(r"\A[\x20\x09-\x0D]").cast("int")
    rest = F.element_at(F.call_function("split", text, space, pieces.cast("int")), -1)
    kept = F.call_function("left", text, F.length(text) - F.length(rest))
    whole = F.col("_words") == F.col("_size")
    cut = cut.withColumn("_kept", F.when(whole, text).otherwise(kept))
    chars = {"n_chars": F.when(whole, F.col("row.n_chars")).otherwise(F.length("_kept").cast("long"))} if "n_chars" in names else {}
    return shared.unpacked(cut, names, text=F.col("_kept"), **chars)
