"""Queries over nested spans, trees and sequences of edits.

A customer of key k stands for node k + 1 of a halving tree, whose span is a
part of 2 ** 20 positions; SQL finds nodes by arithmetic on their numbers, by
recursion, or by one edit after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nesting, pieces, tours
from .registry import Tables, query

#: Positions, as a power of 2.
SIZE = 20


def node_spans(t: Tables) -> DataFrame:
    """(uri, id, sb, eb): the nodes of a nation's customers are the spans of a file."""
    node = F.col("c_custkey") + 1
    level = (F.length(F.bin(node)) - 1).cast("int")
    width = F.call_function("shiftright", F.lit(1 << SIZE).cast("long"), level)
    begin = (node - F.call_function("shiftleft", F.lit(1).cast("long"), level)) * width
    return t.customer.select(F.col("c_nationkey").alias("uri"), F.col("c_custkey").alias("id"), begin.alias("sb"), (begin + width).alias("eb"))


def order_points(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_custkey") % 25).cast("int").alias("uri"), (F.col("o_orderkey") * 7919 % (1 << SIZE)).alias("at"), "o_orderkey")


HOLDING = f"""(SELECT o_orderkey, l, c_custkey FROM (SELECT o_orderkey, (o_custkey % 25)::INT AS uri, o_orderkey * 7919 % {1 << SIZE} AS pos, unnest(range({SIZE + 1})) AS l FROM orders)
 JOIN customer ON c_nationkey = uri AND c_custkey = (1::BIGINT << l::INT) + (pos >> ({SIZE} - l)::INT) - 1)"""


@query(f"SELECT o_orderkey, max_by(c_custkey, l) AS id FROM {HOLDING} GROUP BY o_orderkey")
def innermost_spans(t):
    return nesting.innermost(order_points(t), node_spans(t), ["uri"], "at").select("o_orderkey", "id")


@query(f"SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l DESC) - 1)::INT AS up, c_custkey AS id FROM {HOLDING}")
def spans_around(t):
    return nesting.around(order_points(t), node_spans(t), ["uri"], "at").select("o_orderkey", "up", "id")


#: Nodes that end at an order's position, deepest last.
ENDING = HOLDING.replace("(pos >> (20 - l)::INT) - 1)", "(pos >> (20 - l)::INT) - 2 WHERE pos > 0 AND pos % (1::BIGINT << (20 - l)::INT) = 0 AND c_custkey >= (1::BIGINT << l::INT) - 1)")


@query(f"""SELECT o_orderkey, CASE WHEN i.l IS NULL OR e.l > i.l THEN e.id ELSE i.id END AS id FROM (SELECT o_orderkey, max_by(c_custkey, l) AS id, max(l) AS l FROM {HOLDING} GROUP BY o_orderkey) i
 FULL JOIN (SELECT o_orderkey, max_by(c_custkey, l) AS id, max(l) AS l FROM {ENDING} GROUP BY o_orderkey) e USING (o_orderkey)""")
def innermost_with_ends(t):
    """As semantic lookups do, with a span holding its end; the narrowest wins, of equally narrow ones the later."""
    spans = node_spans(t).withColumn("_last", -F.col("sb"))
    return nesting.innermost(order_points(t), spans, ["uri"], "at", ties=["_last"], inclusive_end=True).select("o_orderkey", "id")


@query("""SELECT c.c_custkey AS id, count(p.c_custkey) + 1 AS level, max(p.c_custkey) AS parent FROM customer c
 LEFT JOIN (SELECT c_custkey AS k, unnest(range(1, 21)) AS j FROM customer) u ON u.k = c.c_custkey LEFT JOIN customer p ON p.c_nationkey = c.c_nationkey AND p.c_custkey = ((u.k + 1) >> u.j::INT) - 1 GROUP BY c.c_custkey""")
def span_parents(t):
    return nesting.parents(node_spans(t), ["uri"]).select("id", "level", F.col("parent.id").alias("parent"))


# Trees from parent edges


def customer_tree(t: Tables) -> DataFrame:
    node = F.col("c_custkey") + 1
    return t.customer.select(F.lit(0).alias("tree"), node.alias("id"), F.when(node > 1, F.floor(node / 2)).alias("parent"), F.floor(F.col("c_acctbal")).cast("long").alias("value"))


TREE = """(WITH RECURSIVE n AS (SELECT 1::BIGINT AS id, [1::BIGINT] AS path UNION ALL SELECT c_custkey + 1, list_append(path, c_custkey + 1) FROM n JOIN customer ON c_custkey > 0 AND (c_custkey + 1) // 2 = id) SELECT id, path FROM n)"""


@query(f"""SELECT id, (len(path) - 1)::BIGINT AS depth, row_number() OVER (ORDER BY path) - 1 AS pre, row_number() OVER (ORDER BY path) - 1 + size - len(path) AS post, size
 FROM {TREE} JOIN (SELECT above AS id, count(*) AS size FROM (SELECT unnest(path) AS above FROM {TREE}) GROUP BY above) USING (id)""")
def tree_numbers(t):
    return tours.numbered(customer_tree(t), ["tree"]).select("id", "depth", "pre", "post", "size")


@query("SELECT c_custkey AS id, c_custkey AS depth, c_custkey AS pre, n - 1 - c_custkey AS post, n - c_custkey AS size FROM customer, (SELECT count(*) AS n FROM customer)")
def chain_numbers(t):
    """Every customer is the only child of the one before: as deep as there are rows."""
    chain = t.customer.select(F.lit(0).alias("tree"), F.col("c_custkey").alias("id"), (F.col("c_custkey") - 1).alias("parent"))
    return tours.numbered(chain, ["tree"]).select("id", "depth", "pre", "post", "size")


@query(f"SELECT above AS id, sum(floor(c_acctbal)::BIGINT)::BIGINT AS total FROM (SELECT id - 1 AS k, unnest(path) AS above FROM {TREE}) JOIN customer ON c_custkey = k GROUP BY above")
def subtree_totals(t):
    return tours.subtree_sums(tours.numbered(customer_tree(t), ["tree"]), ["tree"], "value", "total").select("id", "total")


# Sequences of edits


def name_edits(t: Tables) -> DataFrame:
    """Each order replaces two characters of its customer's name, as it is after the orders before."""
    start = F.col("o_orderkey") % 12
    return t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seq"), start.alias("start"), (start + 2).alias("end"), F.concat(F.lit("é"), F.col("o_orderkey") % 1000).alias("text"))


def names(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("text"))


NUMBERED = "(SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, (o_orderkey % 12)::INT AS s, 'é' || o_orderkey % 1000 AS new FROM orders)"


@query(f"""WITH RECURSIVE r AS (SELECT c_custkey AS doc, 0::BIGINT AS n, c_name AS text FROM customer UNION ALL SELECT doc, e.n, text[1:s] || new || text[s + 3:] FROM r JOIN {NUMBERED} e ON o_custkey = doc AND e.n = r.n + 1)
 SELECT doc, max_by(text, n) AS text FROM r GROUP BY doc""")
def edited_names(t):
    return pieces.applied(names(t), name_edits(t))


@query(f"""WITH RECURSIVE r AS (SELECT c_custkey AS doc, 0::BIGINT AS n, range(length(c_name)) AS l FROM customer
  UNION ALL SELECT doc, e.n, l[1:s] || list_transform(range(length(new)), lambda i: -1::BIGINT) || l[s + 3:] FROM r JOIN {NUMBERED} e ON o_custkey = doc AND e.n = r.n + 1),
 f AS (SELECT doc, max_by(l, n) AS l, max(n) AS n FROM r GROUP BY doc)
 SELECT doc, i, (list_position(l, i) - 1)::BIGINT AS place FROM (SELECT doc, l, unnest(range(18)) AS i FROM f WHERE n > 0) WHERE list_contains(l, i)""")
def moved_characters(t):
    """Where the characters of the first names that are still there have gone."""
    edited = pieces.composed(pieces.of_edits(names(t), name_edits(t)))
    asked = name_edits(t).select("doc").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(17).cast("long"))))
    return pieces.mapped(asked, edited, "i").filter("kept").select("doc", "i", "place")
