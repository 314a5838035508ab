"""The trie of conversations against one that is grouped by whole prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, group int, rep long"


def plain(rows, lend):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[-1] for x in sorted(turns)] for c, turns in own.items()}
    if lend:
        heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: heads[c]] + own[c][heads[c] :] for c in own}
    nodes = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, below = {}, {}
    for k, convs in nodes.items():
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    for k, convs in nodes.items():
        saved = (len(convs) - 1) * len(k[-1][1].split()) if k else 0
        for d in range(len(k) + 1):
            leaves, total = below.get(k[:d], (0, 0))
            below[k[:d]] = (leaves + (k not in children), total + saved)
    found = []
    for k, convs in nodes.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(own[c]) == len(k))))
        found.append((min(convs), len(k), min(nodes[k[:-1]]) if k else None, len(convs), children.get(k, 0), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found)


def got(found):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found.collect())


def made(seed):
    rnd, rows = random.Random(seed), []
    for c in range(60):
        common = [("user", "hello there"), ("assistant", "a b c"), ("user", "go on")][: rnd.randint(0, 3)] if c % 3 else []
        turns = common + [(rnd.choice(["user", None, "u"]), rnd.choice(["x", "x y", None, "", "ser z"])) for _ in range(rnd.randint(0, 5))]
        if c in (40, 44, 47):
            turns = [("user", "copy"), ("assistant", "of this"), ("user", "x")]
        turns += [("user", f"n {i} of many") for i in range(90)] if c in (20, 21) else []
        rows += [(c, None if i == 0 else i // 2, r, t, "d", 1, 2) for i, (r, t) in enumerate(turns)]
    rows += [(None, 1, "user", "lost", "d", 1, 2), (1000, 5, "user", "same", "d", 1, 2), (1000, 5, "user", "same", "d", 1, 2)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("most", "lend"), [(16_384, True), (30, True), (30, False), (1, False)])
def test_small_and_split_groups(spark, most, lend, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rows = made(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if lend:
        heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
        found = prefix_trie.lending_trie(docs, heads, F.col("conv_id") - F.col("conv_id") % 20, 3, most)
    else:
        found = prefix_trie.trie(docs, most)
    assert got(found) == plain(rows, lend)


def test_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(prefix_trie.trie(empty)) == []
    heads, base = F.lit(3), F.lit(-1).cast("long")
    turnless = [(7, 1, "user", "a", "", 1, 2), (9, None, None, None, "", 1, 2)]
    (root,) = got(prefix_trie.lending_trie(spark.createDataFrame(turnless, SCHEMA), heads, base, 3))
    assert root == (7, 0, None, 2, 0, 1, 0, hashlib.sha256(b"7,9").hexdigest())


def test_very_long_conversation_with_copies(spark):
    long = [(c, i, "user", f"t{i % 7}", "", 1, 2) for c in (1, 2) for i in range(30_000)]
    found = prefix_trie.trie(spark.createDataFrame([*long, (3, 0, "user", "t0", "", 1, 2)], SCHEMA).repartition(4))
    rows = {r.depth: r for r in found.collect()}
    assert len(rows) == 30_001 and rows[1].n_convs == 3 and rows[2].n_convs == 2 and rows[30_000].n_children == 0
    assert (rows[0].saved_tokens, rows[30_000].saved_tokens, rows[29_999].saved_tokens) == (2 + 29_999, 1, 2)
    assert {r.n_leaves for r in rows.values()} == {1}
