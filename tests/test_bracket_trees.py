"""Trees of brackets equal those of a stack, and no join is planned by a size that is not known."""

import random

import pytest

from factloom.extract import facts
from factloom.operators import diagnostics
from factloom.plans import catalog

PAIRS = {")": "(", "]": "[", "}": "{"}


def nodes_of(text):
    """(begin, end, kind, depth) by a stack; closing brackets without an open one are skipped."""
    stack, out = [], []
    for i, c in enumerate(text):
        if c in PAIRS.values():
            stack.append((c, i))
        elif stack:
            kind, begin = stack.pop()
            out.append((begin, i + 1, kind if PAIRS[c] == kind else "error", len(stack) + 1))
    return sorted(out)


def test_nodes_equal_a_stack(spark):
    rnd = random.Random(5)
    texts = {f"f{n}": "".join(rnd.choice("([{)]}") for _ in range(rnd.randint(0, 40))) for n in range(60)}
    rows = [(uri, seq, "operator", c, seq, seq + 1) for uri, text in texts.items() for seq, c in enumerate(text)]
    tokens = spark.createDataFrame(rows, "uri string, seq int, kind string, text string, sb int, eb int")
    nodes = diagnostics.bracket_nodes(tokens)
    found = {}
    for r in nodes.collect():
        found.setdefault(r.uri, []).append((r.sb, r.eb, r.kind, r.depth))
    assert {uri: sorted(x) for uri, x in found.items()} == {uri: nodes_of(text) for uri, text in texts.items() if nodes_of(text)}
    trees = {r.uri: r.tree for r in diagnostics.tree_text(nodes, nodes["kind"]).collect()}
    for uri, text in texts.items():
        marks = sorted([(b, "(" + kind) for b, _, kind, _ in nodes_of(text)] + [(e - 1, ")") for _, e, _, _ in nodes_of(text)])
        assert trees.get(uri, "") == "".join(m for _, m in marks)


@pytest.mark.parametrize("name", ["bracket_trees", "tree_as_text"])
def test_one_pass_without_joins(spark, name):
    """What Python makes of files counts as small as they are: a join would send all brackets to the driver."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_parents(spark):
    files = spark.createDataFrame([("a", "f(g(1), [2, {3 => 4}]);\nh();\n")], "uri string, text string")
    nodes = {r.node: r for r in diagnostics.bracket_nodes(facts.tokens(files)).collect()}
    around = {(n.kind, n.sb): nodes[n.parent].sb if n.parent is not None else None for n in nodes.values()}
    assert around == {("(", 1): None, ("(", 3): 1, ("[", 8): 1, ("{", 12): 8, ("(", 25): None}
