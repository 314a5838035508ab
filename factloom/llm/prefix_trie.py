"""Conversations as a trie of their turns: which prefixes are shared, and what sharing them saves.

A node is a distinct sequence of turns with which conversations begin; its
members are the conversations that begin with it.

1. Turns are numbered inside each conversation in one global sort, so a
   conversation that holds most turns is spread over tasks. From then on a turn
   is its digest and its number of words.
2. Equal conversations become one sequence, with their number and the smallest
   id, found by a commutative hash that is combined before the shuffle.
3. Sequences are grouped by their first turn. Small groups are dealt to buckets
   by hash; in each bucket applyInPandas builds the pointer tries of its groups
   and sums up their subtrees in postorder, without recursion.
4. A group of more than `most` turns is split: what all its sequences begin
   with is a chain of nodes, and the rest is grouped anew by the next turn,
   until no group is too large. A sequence alone in its group is a chain as
   a whole. Sums of chains come from running totals and from the groups below.

Defined results: null roles and texts are empty; turns are ordered by turn
(null first), of equal ones by digest, and repeated turns are turns of their own;
rows without a conversation id belong to no conversation; an empty table has no
nodes, and other tables have a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Turns of a group that one trie holds at most, and turns that a bucket of groups holds on average.
MOST_TURNS, BUCKET_TURNS = 16_384, 1_024
#: Ids that are hashed as one piece.
PIECE = 4_096
#: Rounds of splitting after which something must be wrong.
MOST_ROUNDS = 10_000
NODES = "group string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_at long, top boolean"
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, words) for each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    turn = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.select("conv_id", "turn", F.unhex(F.md5(turn.cast("binary"))).alias("digest"), shared.word_count(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("_row"))
    # The last one only spreads equal turns, of which a conversation may have very many.
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("_row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("_at"))
    placed = shared.staged(placed, "trie-turns")
    task = F.shiftright("_at", 33)
    # A conversation has a row here for each task that holds turns of it.
    runs = placed.groupBy("conv_id", task.alias("_task")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "_task", "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.withColumn("_task", task).join(runs, ["conv_id", "_task"]).select("conv_id", (F.col("_before") + F.col("_at") - F.col("_from") + 1).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, heads: Column, base: Column, most_heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id) and (conv_id, depth, digest, words): each conversation with its first turns taken from another.

    heads is how many, at most most_heads, and base the other's id, both by conv_id.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select("conv_id", "own", heads.cast("long").alias("h"), base.alias("base"))
    convs = shared.staged(convs, "trie-conversations")
    first = turns.filter(F.col("pos") <= most_heads)
    lent = first.withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "words")
    had = convs.select("conv_id", "h", "base").join(convs.select(F.col("conv_id").alias("base"), F.col("own").alias("_lent")), "base", "left")
    had = had.select("conv_id", "h", F.least("h", F.coalesce("_lent", F.lit(0))).alias("_taken"))
    kept = turns.join(had, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("_taken")).alias("depth"), "digest", "words")
    return convs.select("conv_id"), shared.staged(lent.unionByName(kept), "trie-rebuilt")


def sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, k1, k2, length): equal for equal sequences of turns."""
    marks = [F.xxhash64(F.lit(salt), "depth", "digest") for salt in (1, 2)]
    hashed = turns.groupBy("conv_id").agg(F.bit_xor(marks[0]).alias("k1"), F.bit_xor(marks[1]).alias("k2"), F.count("*").alias("length"))
    return convs.join(hashed, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("k1", "k2", "length")])


def end_digests(keyed: DataFrame) -> DataFrame:
    """(ends_at, ends_sha256): the smallest id of each sequence, and the hash of all its ids.

    Ids are joined to pieces where they lie in a global order; the pieces of a
    sequence pass one task, which hashes them one after the other.
    """
    key = ["k1", "k2", "length"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, ids = batch[key].to_numpy(), batch["conv_id"].tolist()
            begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)) | (np.arange(len(ids)) % PIECE == 0)) if ids else np.zeros(0, dtype=int)
            out = batch.iloc[begins].rename(columns={"conv_id": "_first"})
            yield out.assign(_ids=[",".join(map(str, ids[i:j])) for i, j in zip(begins, [*begins[1:], len(ids)], strict=True)])

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, state = None, None, hashlib.sha256()
        for batch in batches:
            out = []
            for k1, k2, length, begin, ids in batch.itertuples(index=False):
                if (k1, k2, length) != now:
                    if now is not None:
                        out.append((first, state.hexdigest()))
                    now, first, state = (k1, k2, length), begin, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["ends_at", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(first, state.hexdigest())], columns=["ends_at", "ends_sha256"])

    made = keyed.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInPandas(pieces, "k1 long, k2 long, length long, _first long, _ids string")
    return made.repartition(*key).sortWithinPartitions(*key, "_first").mapInPandas(hashes, "ends_at long, ends_sha256 string")


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of one bucket, from rows (group, start, parent, rep, depth, digest, words, weight, length) of its sequences."""
    out = []
    rows = rows.sort_values(["group", "rep", "depth"], kind="stable")
    for group, of in rows.groupby("group", sort=False):
        # One list entry per node; the pointers from a node are those of its dictionary.
        pointers, parent, smallest, members, words, ends = [], [], [], [], [], []
        top, outer, now, last = {}, int(of["parent"].iat[0]), None, None
        for rep, digest, count, weight, depth, length in zip(of["rep"], of["digest"], of["words"], of["weight"], of["depth"], of["length"], strict=True):
            if rep != last:
                now, last = None, rep
            under = top if now is None else pointers[now]
            node = under.get(digest)
            if node is None:
                node = under[digest] = len(parent)
                pointers.append({})
                parent.append(now)
                # Sequences come in the order of their smallest ids.
                smallest.append(rep)
                members.append(0)
                words.append(count)
                ends.append(None)
            members[node] += weight
            if depth == length:
                ends[node] = rep
            now = node
        # Children have larger numbers than their parents, so descending numbers are a postorder.
        n = len(parent)
        leaves = [0 if pointers[i] else 1 for i in range(n)]
        saved = [(members[i] - 1) * words[i] for i in range(n)]
        depths = [0] * n
        for i in range(n):
            depths[i] = int(of["start"].iat[0]) + 1 if parent[i] is None else depths[parent[i]] + 1
        for i in range(n - 1, -1, -1):
            if parent[i] is not None:
                leaves[parent[i]] += leaves[i]
                saved[parent[i]] += saved[i]
        for i in range(n):
            above = outer if parent[i] is None else smallest[parent[i]]
            out.append((group, smallest[i], depths[i], above, members[i], len(pointers[i]), leaves[i], saved[i], ends[i], parent[i] is None))
    frame = pd.DataFrame(out, columns=[x.split()[0] for x in NODES.split(", ")])
    return frame.astype({"ends_at": "Int64"})


def split(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(small, chains, groups): turns of groups that fit one trie, nodes of those that do not, and all groups with those around them.

    rows are (rep, depth, digest, words, weight, length), one row for each turn of each sequence.
    """
    open_ = rows.select("*", F.lit("").alias("outer"), F.lit(0).cast("long").alias("start"))
    small, chains, groups = [], [], []
    top = rows.agg(F.min("rep")).first()[0]
    over = open_.select("rep").limit(0).select(F.lit("").alias("outer"), F.col("rep").alias("parent"), F.array().cast("array<string>").alias("around"))
    for number in range(MOST_ROUNDS):
        # The group that a sequence belongs to: the one around it, and its next turn.
        following = open_.filter(F.col("depth") == F.col("start") + 1).select("rep", F.md5(F.concat("outer", F.hex("digest")).cast("binary")).alias("group"))
        members = shared.staged(open_.join(following, "rep"), "trie-members")
        sizes = members.groupBy("group").agg(
            F.first("outer").alias("outer"), F.count("*").alias("turns"), F.min("rep").alias("least"), F.sum(F.when(F.col("depth") == F.col("start") + 1, 1).otherwise(0)).alias("sequences"),
            F.sum(F.when(F.col("depth") == F.col("start") + 1, F.col("weight"))).alias("members"),
        )
        if number:
            sizes = sizes.join(over, "outer").select("*", F.array_append("around", F.col("outer")).alias("_around")).drop("around").withColumnRenamed("_around", "around")
        else:
            sizes = sizes.select("*", F.lit(top).cast("long").alias("parent"), F.array(F.lit("")).alias("around"))
        sizes = shared.staged(sizes, "trie-groups")
        groups.append(sizes.select("group", "outer", "parent", "around"))
        fits = sizes.filter(F.col("turns") <= most)
        small.append(members.join(fits.select("group", "parent"), "group").select("group", "start", "parent", "rep", "depth", "digest", "words", "weight", "length"))
        large = sizes.filter(F.col("turns") > most)
        if large.isEmpty():
            break
        wide = members.join(large.select("group", "sequences", "members", "least", "parent"), "group")
        # Depths at which all sequences of the group have the same turn, from the first one on.
        levels = wide.groupBy("group", "depth").agg(
            F.count("*").alias("_n"), F.first("sequences").alias("sequences"), F.first("members").alias("members"), F.first("least").alias("conv_id"), F.first("parent").alias("parent"), F.first("start").alias("start"),
            F.min("digest").alias("_low"), F.max("digest").alias("_high"), F.first("words").alias("words"), F.min(F.when(F.col("length") == F.col("depth"), F.col("rep"))).alias("ends_at"),
        )
        levels = shared.staged(levels.withColumn("_same", (F.col("_n") == F.col("sequences")) & (F.col("_low") == F.col("_high"))), "trie-levels")
        shared_to = levels.groupBy("group").agg(F.coalesce(F.min(F.when(~F.col("_same"), F.col("depth"))) - 1, F.max("depth")).alias("last"))
        shared_to = shared.staged(shared_to, "trie-shared")
        chain = levels.join(shared_to, "group").filter("depth <= last")
        chains.append(shared.staged(chain.select("group", "conv_id", "depth", F.when(F.col("depth") == F.col("start") + 1, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("members").alias("n_convs"), "words", "ends_at", "last", "start"), "trie-chains"))
        open_ = shared.staged(members.join(shared_to, "group").filter("depth > last").select("rep", "depth", "digest", "words", "weight", "length", F.col("group").alias("outer"), F.col("last").alias("start")), "trie-open")
        over = large.select(F.col("group").alias("outer"), F.col("least").alias("parent"), "around")
    else:
        raise ValueError(f"groups are still too large after {MOST_ROUNDS} rounds")
    union = lambda parts: shared.staged(parts[0] if len(parts) == 1 else _all(parts), "trie-parts")
    empty = rows.limit(0).select(F.lit("").alias("group"), F.col("rep").alias("conv_id"), "depth", F.col("rep").alias("parent_conv_id"), F.col("weight").alias("n_convs"), "words", F.col("rep").alias("ends_at"), F.col("depth").alias("last"), F.col("depth").alias("start"))
    return union(small), union(chains or [empty]), union(groups)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nodes(convs: DataFrame, turns: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id) whose turns are (conv_id, depth, digest, words)."""
    keyed = shared.staged(sequences(convs, turns), "trie-sequences")
    one = shared.staged(keyed.groupBy("k1", "k2", "length").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "trie-distinct")
    ends = end_digests(keyed)
    rows = shared.staged(turns.join(one.select(F.col("rep").alias("conv_id"), "weight", "length"), "conv_id").withColumnRenamed("conv_id", "rep"), "trie-items")
    small, chains, groups = split(rows, most)
    buckets = max(1, small.count() // BUCKET_TURNS)
    dealt = small.withColumn("_bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    built = shared.staged(dealt.groupBy("_bucket").applyInPandas(build, NODES), "trie-built")
    # What each group adds to all groups around it.
    own = chains.groupBy("group").agg(F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    adds = built.filter("top").select("group", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    adds = adds.unionByName(own.select("group", F.lit(0).cast("long").alias("leaves"), "saved"))
    adds = adds.join(groups, "group").select("*", F.explode("around").alias("of"))
    below = adds.groupBy("of").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum(F.when(F.col("of") == F.col("outer"), 1).otherwise(0)).alias("children"))
    alone = chains.groupBy("group").agg(F.max("last").alias("last")).join(below.withColumnRenamed("of", "group"), "group", "left_anti").select("group")
    # A chain that nothing follows ends in a leaf, which counts for the groups around it, too.
    more = alone.join(groups, "group").select(F.explode("around").alias("of")).groupBy("of").agg(F.count("*").alias("chain_leaves"))
    below = shared.staged(below.join(more, "of", "left").select("of", (F.col("leaves") + F.coalesce("chain_leaves", F.lit(0))).alias("leaves"), "saved", "children"), "trie-below")

    spent = chains.select("*", ((F.col("n_convs") - 1) * F.col("words")).alias("_own"), (-F.shiftright("depth", 12)).alias("_part"))
    summed = shared.running_total(spent, ["group"], "_part", [F.col("depth").desc()], "_own", "_deeper")
    chained = summed.join(below.withColumnRenamed("of", "group"), "group", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.when(F.col("depth") < F.col("last"), 1).otherwise(F.coalesce("children", F.lit(0))).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("_own") + F.col("_deeper") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), "ends_at",
    )
    names = chained.columns
    whole = one.agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min(F.when(F.col("length") == 0, F.col("rep"))).alias("ends_at"))
    sums = below.filter("of = ''").select("children", "leaves", "saved")
    root = whole.unionByName(sums, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in (*whole.columns, *sums.columns)]).filter("conv_id is not null").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), "ends_at",
    )
    every = shared.staged(built.select(names).unionByName(chained).unionByName(root), "trie-nodes")
    ended = every.filter("ends_at is not null").join(ends, "ends_at").drop("ends_at")
    passed = every.filter("ends_at is null").drop("ends_at").withColumn("ends_sha256", F.lit(NOTHING))
    return ended.unionByName(passed)


def trie(conversations: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """The nodes of the conversations (conv_id, turn, role, text) as they are."""
    turns = shared.staged(numbered(conversations), "trie-numbered").withColumnRenamed("pos", "depth")
    return nodes(turns.select("conv_id").distinct(), turns, most)


def lending_trie(conversations: DataFrame, heads: Column, base: Column, most_heads: int, most: int = MOST_TURNS) -> DataFrame:
    """The nodes of conversations that are rebuilt first: see rebuilt()."""
    turns = shared.staged(numbered(conversations), "trie-numbered")
    return nodes(*rebuilt(turns, heads, base, most_heads), most)
