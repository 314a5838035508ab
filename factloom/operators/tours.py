"""Trees from parent edges, numbered along their Euler tours.

A tour enters and leaves every node. Each of these steps knows the one before
it: entering a first child follows entering its parent, another child leaving
its elder sibling, and leaving a node leaving its last child, or entering it.
Sums along these lists are found by pointer jumping, in as many rounds as the
logarithm of the longest tour, each an equi join of one row per step. From
them come the places of a node in preorder and postorder, its depth and the
size of its subtree; whether a node is above another is a comparison of
intervals then, and rows stay linear in nodes, where pairs of nodes and
ancestors would be quadratic for a chain.

Defined results: a node whose parent is null or missing is a root; numbers
count from 0 in each tree; children are in the order of `ordered_by`, then of
their ids; nodes around themselves raise an error, and so do repeated ids;
rows with a null group or id are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from . import order


def numbered(nodes: DataFrame, by: list[str], node: str = "id", parent: str = "parent", ordered_by: list[str] | None = None) -> DataFrame:
    """nodes(by, node, parent, ...) with root, depth, pre, post and size (nodes of the subtree, itself included)."""
    return storage.settled(lambda: _numbered(nodes, by, node, parent, ordered_by or []), "tree")


def _numbered(nodes: DataFrame, by: list[str], node: str, parent: str, ordered_by: list[str]) -> DataFrame:
    for c in (*by, node):
        nodes = nodes.filter(F.col(c).isNotNull())
    rows = order.in_order(nodes, *[F.col(c).asc() for c in (*by, parent, *ordered_by, node)], label="tree-nodes")
    if not rows.groupBy(*by, node).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a node id is repeated")
    above = rows.select(*by, F.col(node).alias(parent), F.col("_at").alias("_above"))
    placed = storage.staged(rows.join(above, [*by, parent], "left").select(*rows.columns, "_above"), "tree-placed")
    elder = order.last_before(placed.filter(F.col("_above").isNotNull()).select("_at", "_chunk", "_above"), ["_above"], "_at", "_elder").select("_at", "_elder")
    youngest = placed.filter(F.col("_above").isNotNull()).groupBy(F.col("_above").alias("_at")).agg(F.max("_at").alias("_youngest"))
    linked = placed.select("_at", "_above").join(elder, "_at", "left").join(youngest, "_at", "left")
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    into = F.struct(enter("_at").alias("step"), F.coalesce(leave("_elder"), enter("_above")).alias("prior"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("balance"))
    out = F.struct(leave("_at").alias("step"), F.coalesce(leave("_youngest"), enter("_at")).alias("prior"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("balance"))
    steps = ranked(linked.select(F.explode(F.array(into, out)).alias("s")).select("s.*"))
    ends = steps.groupBy(F.call_function("shiftright", "step", F.lit(1)).alias("_at")).agg(
        F.max(F.when(F.col("step") % 2 == 0, F.col("entered"))).alias("_in"), F.max(F.when(F.col("step") % 2 == 0, F.col("balance"))).alias("_deep"),
        F.max(F.when(F.col("step") % 2 == 1, F.col("entered"))).alias("_out"), F.call_function("shiftright", F.max("first"), F.lit(1)).alias("_root"),
    )
    roots = placed.filter(F.col("_above").isNull()).select(F.col("_at").alias("_root"), F.col(node).alias("root"))
    pre, depth, size = F.col("_in") - 1, F.col("_deep") - 1, F.col("_out") - F.col("_in") + 1
    return placed.join(ends, "_at").join(roots, "_root").select(*nodes.columns, "root", depth.alias("depth"), pre.alias("pre"), (pre + size - 1 - depth).alias("post"), size.alias("size"))


def ranked(steps: DataFrame) -> DataFrame:
    """steps(step, prior, entered, balance) with the sums from the first step of each list on, and that first step."""
    done: list[DataFrame] = []
    now = storage.staged(steps.withColumn("first", F.when(F.col("prior").isNull(), F.col("step"))), "tour")
    most = math.ceil(math.log2(max(2, now.count()))) + 1
    for _ in range(most + 1):
        ended = now.filter("prior is null")
        far = now.filter("prior is not null")
        if far.isEmpty():
            return now
        # What has ended already only serves as a target.
        before = now.select(F.col("step").alias("prior"), F.col("prior").alias("_prior"), F.col("entered").alias("_entered"), F.col("balance").alias("_balance"), F.col("first").alias("_first"))
        jumped = far.join(before, "prior").select("step", F.col("_prior").alias("prior"), (F.col("entered") + F.col("_entered")).alias("entered"), (F.col("balance") + F.col("_balance")).alias("balance"), F.col("_first").alias("first"))
        done.append(now)
        now = storage.staged(ended.unionByName(jumped), "tour")
        storage.delete(storage.staged_paths(done.pop()))
    raise ValueError("nodes lie around themselves")


def above(outer: str, inner: str, itself: bool = False) -> Column:
    """Whether the node of alias outer is above that of alias inner; both are rows of numbered()."""
    begins = F.col(f"{outer}.pre") <= F.col(f"{inner}.pre") if itself else F.col(f"{outer}.pre") < F.col(f"{inner}.pre")
    return (F.col(f"{outer}.root") == F.col(f"{inner}.root")) & begins & (F.col(f"{inner}.pre") < F.col(f"{outer}.pre") + F.col(f"{outer}.size"))


def subtree_sums(tree: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rows of numbered() with the sum of value over each subtree: a difference of two running sums along the preorder."""
    key = [*by, "root"]
    rows = order.sums_before(order.in_order(tree, *[F.col(c).asc() for c in (*key, "pre")], label="preorder"), key, value, "_before")
    last = rows.select(*key, F.col("pre").alias("_last"), (F.col("_before") + F.coalesce(F.col(value), F.lit(0))).alias("_through"))
    found = rows.withColumn("_last", F.col("pre") + F.col("size") - 1).join(last, [*key, "_last"])
    return found.select(*tree.columns, (F.col("_through") - F.col("_before")).alias(name))
