"""The queries over the test tables: each operator's shape, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import facts
from ..functions import nested, text
from ..operators import aggregates, joins, lookups, ranking, spans, windows
from ..streaming import documents as document_state
from .registry import QUERIES, SQL, Tables, query

__all__ = ["QUERIES", "SQL"]


def two(column: F.Column | str) -> F.Column:
    return F.round(column, 2)


# Filters, lookups and searches


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_tax = 0)")
def unused_symbols(t):
    return joins.unused(t.part.select("p_partkey", "p_name"), t.lineitem.filter("l_returnflag = 'R' and l_tax = 0"), [("p_partkey", "l_partkey")])


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = (SELECT min(p_brand) FROM part)")
def find_references(t):
    first = t.part.agg(F.min("p_brand").alias("p_brand"))
    keys = t.part.join(F.broadcast(first), "p_brand", "left_semi").select(F.col("p_partkey").alias("l_partkey"))
    return joins.references(keys, t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("SELECT l_partkey, count(DISTINCT (l_orderkey, l_linenumber)) AS usages FROM lineitem GROUP BY l_partkey")
def count_usages(t):
    return joins.usage_counts(t.lineitem, "l_partkey", ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def find_definition(t):
    return lookups.first_definition(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), F.lit(True), ["o_orderdate", "o_orderkey"], ["o_custkey"])


@query("""SELECT p_partkey, p_name, tier FROM (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 're' THEN 0 WHEN starts_with(lower(p_name), 're') THEN 1
 WHEN contains(lower(p_name), 're') THEN 2 WHEN regexp_matches(lower(p_name), 'r.*e') THEN 3 END AS tier FROM part) WHERE tier IS NOT NULL
 ORDER BY least(tier, 2), p_name, p_partkey LIMIT 200""")
def symbol_search_ranked(t):
    return lookups.ranked_search(t.part.select("p_partkey", "p_name"), "re", "p_name", ["p_partkey"], 200).select("p_partkey", "p_name", F.col("tier"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '1')")
def symbol_search(t):
    return lookups.search(t.supplier.select("s_suppkey", "s_name"), "1", "s_name")


@query("SELECT p_partkey, p_type FROM part WHERE p_brand = 'Brand#11' OR starts_with(p_type, 'STANDARD ')")
def package_members(t):
    return lookups.package_members(t.part, "Brand#11", "p_brand", "p_type", prefix="STANDARD ").select("p_partkey", "p_type")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 7")
def dependents(t):
    return lookups.dependents(t.lineitem, F.lit(7), "l_orderkey", "l_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AND c_nationkey IN (SELECT s_nationkey FROM supplier)")
def candidate_search(t):
    people = t.customer.select("c_custkey", "c_name", "c_nationkey")
    open_ = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.candidate_search(people, open_, "c_custkey", t.supplier.select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey").select("c_custkey", "c_name")


@query("SELECT event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n, count(*) OVER () AS c FROM events) WHERE n = 12345 % c")
def seeded_pick(t):
    return lookups.seeded_pick(t.events, 12345, ["event_id"]).select("event_type")


@query("SELECT l_linenumber AS line FROM (SELECT DISTINCT l_linenumber FROM lineitem WHERE l_linenumber >= 3) ORDER BY abs(l_linenumber - 3), l_linenumber LIMIT 1")
def nearest_line(t):
    return lookups.nearest_line(t.lineitem.select(F.col("l_linenumber").alias("line")).distinct(), 3, "forward")


@query("SELECT n_nationkey, n_name FROM nation WHERE NOT (n_name = 'NATION_3' OR starts_with(n_name, 'NATION_1'))")
def exemptions(t):
    rules = t.spark.createDataFrame([("NATION_3",), ("NATION_1/*",)], "pattern string")
    names = t.nation.select("n_nationkey", "n_name", F.regexp_replace("n_name", "^NATION_1", "NATION_1/").alias("_path"))
    return lookups.not_exempt(names, rules, "_path").select("n_nationkey", "n_name")


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS tags FROM events GROUP BY user_id HAVING list_has_all(list(DISTINCT event_type), ['click', 'purchase'])")
def tags_all(t):
    users = t.events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("tags"))
    return lookups.with_all_tags(users, ["click", "purchase"])


@query("SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS tags FROM events GROUP BY user_id) WHERE list_has_any(tags, ['signup', 'error'])")
def tags_any(t):
    users = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return lookups.with_any_tag(users, ["signup", "error"]).select("user_id")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n = 1")
def doc_latest_version(t):
    return lookups.latest(t.conversations, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role", "text")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def remove_files(t):
    return lookups.remove(t.documents.select("doc_id", "lang"), t.labels.filter("toxic = 1"), "doc_id")


@query("SELECT o_custkey AS uri, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def upsert_files(t):
    rows = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("uri"), F.col("o_totalprice").alias("v"))
    return lookups.upsert(rows("F"), rows("P"))


# Joins


@query("SELECT e.user_id, e.event_id, (SELECT max_by(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts <= e.ts) AS signup_id FROM events e WHERE e.event_type = 'purchase'")
def pragma_asof(t):
    points = t.events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    changes = t.events.filter("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("signup_id"))
    return joins.as_of(points, changes, ["user_id"], "ts", ["signup_id"]).select("user_id", "event_id", "signup_id")


ORDER_SPANS = "SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(max(l_shipdate) AS DATE)) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate"


def order_spans(t: Tables) -> DataFrame:
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    last = t.lineitem.groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("e"))
    return t.orders.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", day("o_orderdate").alias("s"), "e")


@query(f"WITH w AS ({ORDER_SPANS}) SELECT o_orderkey, o_custkey, s, e FROM w WHERE s <= 9500 AND 9500 <= e ORDER BY e - s, o_orderkey LIMIT 1")
def position_stab(t):
    return lookups.narrowest_at(order_spans(t), F.lit(9500), "s", "e", ["o_orderkey"])


@query(f"WITH w AS ({ORDER_SPANS}) SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s <= a.e AND b.s <= b.e AND a.s < b.e AND b.s < a.e")
def interval_overlap(t):
    w = order_spans(t).filter("s <= e")
    a = w.select(F.col("o_orderkey").alias("left_key"), F.col("o_custkey").alias("left_cust"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = w.select(F.col("o_orderkey").alias("right_key"), F.col("o_custkey").alias("right_cust"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return joins.overlapping(a, b, ("s1", "e1"), ("s2", "e2"), [("left_cust", "right_cust")], 60).filter("left_key < right_key").select("left_key", "right_key")


@query(f"WITH w AS ({ORDER_SPANS}), p AS (SELECT o_custkey AS cust, o_orderkey AS point_key, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS p FROM orders) SELECT point_key, o_orderkey AS span_key FROM p JOIN w ON cust = o_custkey AND s <= p AND p <= e")
def range_join(t):
    points = t.orders.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("point_key"), F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).alias("p"))
    return joins.containing(points, order_spans(t).filter("s <= e"), "p", "s", "e", [("cust", "o_custkey")], 60).select("point_key", F.col("o_orderkey").alias("span_key"))


SCOPES = "SELECT c_custkey AS id, nullif(c_custkey // 2, 0) AS parent FROM customer WHERE c_custkey > 0"


@query(f"WITH RECURSIVE s AS ({SCOPES}), r AS (SELECT id, id AS ancestor, 0 AS depth FROM s UNION ALL SELECT r.id, s.parent, r.depth + 1 FROM r JOIN s ON r.ancestor = s.id WHERE s.parent IS NOT NULL) SELECT id, ancestor, depth FROM r")
def scope_chain(t):
    scopes = t.customer.filter("c_custkey > 0").select(F.lit("f").alias("uri"), F.col("c_custkey").alias("id"), F.expr("nullif(c_custkey div 2, 0)").alias("parent"))
    return joins.scope_ancestors(scopes, 32).select("id", "ancestor", "depth")


@query("SELECT r_name AS parent, n_name AS child FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT n_name, c_name FROM nation JOIN customer ON n_nationkey = c_nationkey")
def hierarchy_sub_super(t):
    upper = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    lower = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("parent"), F.col("c_name").alias("child"))
    edges = upper.unionByName(lower)
    return joins.subtypes(edges, edges.select("parent"), "child", "parent", "parent").select("parent", "child")


@query("SELECT l_suppkey, l_partkey, count(*) AS n_ranges, min(l_orderkey * 10 + l_linenumber) AS first_range FROM lineitem GROUP BY l_suppkey, l_partkey")
def call_graph(t):
    edges = joins.call_edges(t.lineitem, "l_suppkey", "l_partkey", ["l_orderkey", "l_linenumber"])
    first = F.col("first_range")
    return edges.select("l_suppkey", "l_partkey", "n_ranges", (first["l_orderkey"] * 10 + first["l_linenumber"]).alias("first_range"))


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber)::INT AS place FROM lineitem")
def call_ranges(t):
    return joins.call_ranges(t.lineitem, "l_suppkey", "l_partkey", ["l_orderkey", "l_linenumber"])


@query("""WITH b AS (SELECT p_brand, avg(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = 1995 GROUP BY 1),
 c AS (SELECT p_brand, avg(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = 1996 GROUP BY 1)
 SELECT b.p_brand, round(b.v, 2) AS baseline, round(c.v, 2) AS current, round((c.v - b.v) / b.v * 100, 2) AS pct_change,
 CASE WHEN c.v IS NULL THEN 'missing' WHEN (c.v - b.v) / b.v * 100 > 20 THEN 'regression' WHEN (c.v - b.v) / b.v * 100 < -10 THEN 'faster' ELSE 'ok' END AS status FROM b LEFT JOIN c ON b.p_brand = c.p_brand""")
def baseline_diff(t):
    priced = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    mean = lambda y: priced.filter(F.year("l_shipdate") == y).groupBy("p_brand").agg(F.avg("l_extendedprice").alias("v"))
    return joins.compare_to_baseline(mean(1995), mean(1996), ["p_brand"], "v").select("p_brand", two("baseline").alias("baseline"), two("current").alias("current"), two("pct_change").alias("pct_change"), "status")


@query("""WITH b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1994 GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1)
 SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.n AS n_before, a.n AS n_after, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS change
 FROM b FULL OUTER JOIN a ON b.o_custkey = a.o_custkey""")
def receipt_diff(t):
    of = lambda y: t.orders.filter(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return joins.diff(of(1994), of(1995), ["o_custkey"], ["n"])


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 3 THEN 7.5 WHEN n_regionkey = 1 THEN 3.5 ELSE 1.0 END AS threshold FROM nation")
def threshold_lookup(t):
    rows = t.nation.select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("category"))
    named = t.nation.filter("n_nationkey < 3").select(F.col("n_name").alias("name"), F.lit(7.5).alias("threshold"))
    categories = t.region.filter("r_regionkey = 1").select(F.col("r_regionkey").alias("category"), F.lit(3.5).alias("threshold"))
    return joins.resolved_threshold(rows, named, categories, 1.0).select("n_nationkey", F.col("name").alias("n_name"), "threshold")


@query("SELECT n_name, r_name FROM nation CROSS JOIN (SELECT r_name, r_regionkey FROM region) WHERE n_regionkey = r_regionkey AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def module_resolution(t):
    roots = t.region.select(F.col("r_name").alias("root"), F.col("r_regionkey").alias("priority"))
    existing = t.nation.join(t.supplier.select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit("/"), F.regexp_replace("n_name", "::", "/"), F.lit(".pm")).alias("path"))
    found = joins.first_hit(t.nation, "n_name", roots, existing)
    return found.select("n_name", F.regexp_extract("path", "^([^/]*)/", 1).alias("r_name"))


# Aggregations


@query("SELECT source, count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys FROM documents GROUP BY source")
def symbol_counts(t):
    return aggregates.totals(t.documents, ["source"], "doc_id")


@query("SELECT count(*) AS files, count(DISTINCT source) AS sources, CASE WHEN count(*) > 100 THEN 'files' WHEN count(DISTINCT source) > 1000 THEN 'sources' END AS violation FROM documents")
def limit_check(t):
    return aggregates.check_limits({"files": (F.count("*"), 100), "sources": (F.count_distinct("source"), 1000)}, t.documents)


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value < 5) AS failures, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99,
 round(avg(value), 2) AS mean, round(count(*) FILTER (WHERE value < 5) / count(*), 6) AS error_rate, quantile_disc(value, 0.95) <= 100 AS met FROM events GROUP BY event_type""")
def slo_statistics(t):
    stats = aggregates.slo_statistics(t.events, "event_type", "value", F.col("value") < 5, F.lit(100.0))
    return stats.withColumns({"mean": two("mean"), "error_rate": F.round("error_rate", 6)})


@query("SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100")
def slo_last_n(t):
    return aggregates.last_n(t.events, ["event_type"], [F.col("ts"), F.col("event_id")], 100).select("event_id", "event_type", "value")


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 30) AS large, count(*) FILTER (WHERE l_discount = 0) AS undiscounted, count(*) FILTER (WHERE l_linestatus = 'O') AS still_open FROM lineitem GROUP BY l_returnflag")
def dead_code_summary(t):
    return aggregates.category_counts(t.lineitem, ["l_returnflag"], large=F.col("l_quantity") > 30, undiscounted=F.col("l_discount") == 0, still_open=F.col("l_linestatus") == "O")


@query("SELECT lang, grouping(lang) AS is_total, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang)")
def inventory_rollup(t):
    return aggregates.with_total(t.documents, "lang", files=F.count("*"), chars=F.sum("n_chars"))


@query("SELECT n_nationkey, n_name, coalesce(c, 0) AS n_seen, CASE WHEN c IS NULL THEN 'never' WHEN c < 5 THEN 'at_risk' ELSE 'covered' END AS risk FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey")
def coverage_report(t):
    return aggregates.coverage(t.nation.select("n_nationkey", "n_name"), t.supplier, "n_nationkey", "s_nationkey", 5)


@query("SELECT event_type, list_sort(list(DISTINCT user_id)) AS items FROM events GROUP BY event_type")
def tag_index(t):
    return aggregates.inverted_index(t.events, "event_type", "user_id")


@query("SELECT DISTINCT event_type, user_id FROM events")
def tag_rows(t):
    return aggregates.index_rows(t.events, "event_type", "user_id")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(t):
    return aggregates.repeated(t.documents, ["text"])


DAILY = "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1"


def daily(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))


@query(f"WITH h AS ({DAILY}) SELECT min_by(n, d) AS first_value, max_by(n, d) AS last_value, round(avg(n), 4) AS average, count(*) AS points, CASE WHEN max_by(n, d) > min_by(n, d) * 1.1 THEN 'increasing' WHEN max_by(n, d) < min_by(n, d) * 0.9 THEN 'decreasing' ELSE 'stable' END AS direction FROM h")
def trend_report(t):
    return aggregates.trend(daily(t), "d", "n").withColumn("average", F.round("average", 4))


@query(f"WITH h AS ({DAILY}), r AS (SELECT * FROM h ORDER BY d DESC LIMIT 10) SELECT (SELECT count(*) FROM h) AS points, round(CASE WHEN (SELECT count(*) FROM h) > 10 THEN (SELECT var_pop(n) FROM r) ELSE 0 END, 4) AS variance")
def variance_last_10(t):
    return aggregates.recent_variance(daily(t), "d", "n").withColumn("variance", F.round("variance", 4))


@query("SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM orders GROUP BY o_orderpriority")
def hit_rates(t):
    n = t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("h"), F.count_if(F.col("o_orderstatus") != "F").alias("m"))
    return n.select("o_orderpriority", F.round(aggregates.hit_rate(F.col("h"), F.col("m")), 6).alias("rate"))


@query("SELECT p_partkey, matches FROM (SELECT p_partkey, (CASE WHEN list_contains(string_split(lower(p_name), ' '), 'blue') THEN 1 ELSE 0 END + CASE WHEN list_contains(string_split(lower(p_name), ' '), 'steel') THEN 1 ELSE 0 END + CASE WHEN list_contains(string_split(lower(p_name), ' '), 'part') THEN 1 ELSE 0 END)::INT AS matches FROM part) WHERE matches > 0")
def fuzzy_tokens(t):
    return aggregates.token_ranking(t.part, "p_partkey", F.split(F.lower("p_name"), " "), ["blue", "steel", "part"])


@query("SELECT l_partkey, CASE WHEN p > 50 THEN 'critical' WHEN p > 20 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT l_partkey, (max(l_extendedprice) - min(l_extendedprice)) / min(l_extendedprice) * 100 AS p FROM lineitem GROUP BY 1)")
def change_levels(t):
    p = t.lineitem.groupBy("l_partkey").agg(((F.max("l_extendedprice") - F.min("l_extendedprice")) / F.min("l_extendedprice") * 100).alias("p"))
    return p.select("l_partkey", aggregates.severity_of_change(F.col("p"), [(50.0, "critical"), (20.0, "warning")], "ok").alias("level"))


@query("SELECT o_orderkey, greatest(0.0, least(100.0, 100.0 - CASE WHEN o_totalprice < 50000 THEN 30 ELSE 0 END - CASE WHEN o_orderstatus = 'O' THEN 25 ELSE 0 END)) AS score FROM orders")
def quality_scores(t):
    cost = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    return t.orders.select("o_orderkey", aggregates.quality_score(cost(F.col("o_totalprice") < 50000, 30), cost(F.col("o_orderstatus") == "O", 25)).alias("score"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\bthe\\b'))::INT AS n FROM documents")
def text_occurrences(t):
    return t.documents.select("doc_id", text.whole_word_count(F.col("text"), "the").alias("n"))


# Ordered computations


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber - lag(l_linenumber, 1, 0) OVER w AS delta_line,
 CASE WHEN l_linenumber - lag(l_linenumber, 1, 0) OVER w = 0 THEN l_partkey - lag(l_partkey, 1, 0) OVER w ELSE l_partkey END AS delta_start FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)""")
def delta_encode(t):
    return windows.delta_encode(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").distinct(), ["l_orderkey"], "l_linenumber", "l_partkey")


@query("""WITH RECURSIVE t AS (SELECT user_id, dayofyear(ts)::INT AS line, (hour(ts) * 60 + minute(ts))::INT AS start, event_id % 90 + 1 AS length, event_type, event_id FROM events),
 n AS (SELECT *, row_number() OVER (PARTITION BY user_id, line ORDER BY start, length, event_type, event_id) AS i FROM t),
 f AS (SELECT user_id, line, i, 1 AS g, event_id AS kept, start AS s, length AS n FROM n WHERE i = 1
 UNION ALL SELECT n.user_id, n.line, n.i, f.g + CASE WHEN n.start >= f.s + f.n THEN 1 ELSE 0 END, CASE WHEN n.start >= f.s + f.n OR n.length > f.n THEN n.event_id ELSE f.kept END,
 CASE WHEN n.start >= f.s + f.n OR n.length > f.n THEN n.start ELSE f.s END, CASE WHEN n.start >= f.s + f.n OR n.length > f.n THEN n.length ELSE f.n END FROM f JOIN n ON n.user_id = f.user_id AND n.line = f.line AND n.i = f.i + 1),
 k AS (SELECT user_id, line, max_by(kept, i) AS event_id FROM f GROUP BY user_id, line, g) SELECT t.* FROM t JOIN k USING (user_id, line, event_id)""")
def overlap_removal(t):
    tokens = t.events.select("user_id", F.dayofyear("ts").alias("line"), (F.hour("ts") * 60 + F.minute("ts")).alias("start"), (F.col("event_id") % 90 + 1).alias("length"), "event_type", "event_id")
    return windows.remove_overlaps(tokens, ["user_id"], "line", "start", "length")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) // 1000 AS b, epoch_us(ts) // 1000 + 1800000 AS e FROM events), f AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
 i AS (SELECT *, sum(CASE WHEN p IS NULL OR b > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(b) AS b, max(e) AS e, count(*) AS n_merged FROM i GROUP BY user_id, k""")
def interval_merge(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return windows.merge_intervals(t.events.select("user_id", ms.alias("b"), (ms + 1800000).alias("e")), ["user_id"], "b", "e")


@query("SELECT event_id, n AS hit_count FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events) WHERE (event_type = 'click' AND n >= 2) OR (event_type = 'view' AND n % 3 = 0) OR event_type = 'error'")
def hit_counts(t):
    counted = windows.hit_counts(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    condition = F.when(F.col("event_type") == "click", ">= 2").when(F.col("event_type") == "view", "%3").when(F.col("event_type") == "error", "").otherwise("%0")
    return counted.filter(windows.hit_condition(condition, F.col("hit_count"))).select("event_id", "hit_count")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS j FROM events)
 SELECT user_id, event_type, min(i) AS first_place, max(i) AS last_place, count(*) AS length FROM r GROUP BY user_id, event_type, i - j""")
def import_groups(t):
    out = windows.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type")
    return out.withColumns({"first_place": F.col("first_place").cast("long"), "last_place": F.col("last_place").cast("long")})


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift_before FROM lineitem")
def edit_shift(t):
    shift = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return windows.running_shift(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], shift).select("l_orderkey", "l_linenumber", "l_partkey", F.col("shift_before").cast("double").alias("shift_before"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 100 THEN o_orderkey WHEN o_orderkey >= 200 THEN o_orderkey - 50 END AS mapped FROM orders")
def position_mapping(t):
    return t.orders.select("o_orderkey", windows.map_position(F.col("o_orderkey"), F.lit(100), F.lit(200), F.lit(150)).alias("mapped"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linenumber >= 3 THEN greatest(1, l_linenumber - 4) ELSE l_linenumber END AS line FROM lineitem")
def breakpoint_shift(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", windows.shift_lines(F.col("l_linenumber"), 3, -4).alias("line"))


@query("""WITH p AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type = 'error' THEN -2 ELSE 1 END) OVER w AS pending FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
 d AS (SELECT *, CASE WHEN pending > 3 THEN true WHEN pending = 0 THEN false END AS decided FROM p) SELECT user_id, event_id, pending::BIGINT AS pending, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS storm FROM d""")
def parse_storms(t):
    changes = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "error", -2).otherwise(1).alias("delta"))
    return windows.storms(changes, ["user_id"], "event_id", "delta", above=3).select("user_id", "event_id", "pending", "storm")


@query("SELECT user_id, event_id FROM (SELECT *, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS p FROM events) WHERE p IS NULL OR ms - p >= 86400000")
def debounced_refresh(t):
    rows = t.events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return windows.refresh_times(rows, ["user_id"], "ms", 86_400_000, ["event_id"]).select("user_id", "event_id")


# Ranking and sets


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def best_per_label(t):
    items = t.lineitem.withColumn("_label", F.col("l_partkey").cast("string")).withColumn("_tie", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_suppkey"))
    return ranking.best_per_label(items, "_label", F.col("l_extendedprice"), "_tie").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_custkey, o_orderdate, max(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1, 2")
def max_kind_per_location(t):
    return ranking.greatest_kind(t.orders, ["o_custkey", "o_orderdate"], "o_orderpriority")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem")
def dedupe_exact(t):
    return ranking.dedupe(t.lineitem, ["l_returnflag", "l_linestatus", "l_discount", "l_tax"])


@query("SELECT o_orderpriority, list_sort(list(DISTINCT o_orderstatus)) AS symbols FROM orders GROUP BY 1")
def merged_imports(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("uri"), F.lit("m").alias("module"), F.array("o_orderstatus").alias("symbols"))
    return ranking.merged_imports(rows).select(F.col("uri").alias("o_orderpriority"), "symbols")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def capped_results(t):
    return ranking.capped(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 200)


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_all(t):
    return ranking.all_of(t.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")), t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(t):
    return joins.missing_keys(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"])


@query(f"WITH w AS ({ORDER_SPANS}) SELECT o_orderkey, least(s, 9000)::INT AS union_start, greatest(e, 9100)::INT AS union_end, CASE WHEN greatest(s, 9000) < least(e, 9100) THEN greatest(s, 9000)::INT END AS both_start, (s < 9100 AND 9000 < e) AS overlaps FROM w")
def span_algebra(t):
    w = order_spans(t)
    args = (F.col("s"), F.col("e"), F.lit(9000), F.lit(9100))
    u, i = spans.union(*args), spans.intersection(*args)
    return w.select("o_orderkey", u["start"].alias("union_start"), u["end"].alias("union_end"), i["start"].alias("both_start"), spans.overlap(*args).alias("overlaps"))


# Functions


@query("SELECT page_id, i::INT AS line, unnest(regexp_extract_all(l, 'href=\"([^\"]*)\"', 1)) AS link FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS l, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS i FROM pages)")
def line_scan(t):
    return text.line_matches(t.pages, ["page_id"], "html", r'href="([^"]*)"').select("page_id", "line", F.col("match").alias("link"))


@query("SELECT event_id, 'k' AS name, (props->>'$.k')::DOUBLE AS value FROM events WHERE (props->>'$.k') IS NOT NULL")
def json_normalise(t):
    return nested.json_entries(t.events, ["event_id"], "props").filter("name = 'k'")


@query("""SELECT conv_id, turn, role, CASE WHEN contains(lower(text), 'use strict') THEN 'MissingStrict' WHEN contains(lower(text), 'undefined') OR contains(lower(text), 'not declared') THEN 'UndefinedVariable' WHEN contains(lower(text), 'parse error') OR contains(lower(text), 'syntax error') THEN 'ParseError' END AS code,
 length(text) AS n FROM conversations""")
def classify_message(t):
    code = text.code_of_message(F.col("text"))
    return t.conversations.select("conv_id", "turn", "role", code.alias("code"), F.length("text").cast("long").alias("n"))


@query("SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR || 'ns' WHEN n < 1000000 THEN printf('%.1fus', n / 1000.0) WHEN n < 1000000000 THEN printf('%.1fms', n / 1000000.0) ELSE printf('%.2fs', n / 1000000000.0) END AS shown FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 10 + 7 AS n FROM orders)")
def display_units(t):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 10 + 7
    return t.orders.select("o_orderkey", text.display_time(n).alias("shown"))


@query("SELECT page_id, nullif(regexp_extract(regexp_replace(regexp_replace(url, '^.*/', ''), '[?#].*$', ''), '\\.([^.]*)$', 1), '') AS ext FROM pages")
def uri_extensions(t):
    return t.pages.select("page_id", text.extension(F.col("url")).alias("ext"))


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('', 'file') AS special, starts_with(url, 'file://') AS is_file FROM pages WHERE url IS NOT NULL")
def uri_schemes(t):
    return t.pages.filter("url is not null").select("page_id", text.is_special_scheme(F.col("url")).alias("special"), text.is_file_uri(F.col("url")).alias("is_file"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(t):
    return t.part.select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS newlines FROM documents")
def newline_counts(t):
    return t.documents.select("doc_id", text.newlines(F.col("text")).cast("long").alias("newlines"))


@query("SELECT n_nationkey, nullif(regexp_extract(q, '^(.*)::', 1), '') AS container, regexp_replace(q, '^.*::', '') AS bare FROM (SELECT n_nationkey, r_name || '::' || n_name AS q FROM nation JOIN region ON n_regionkey = r_regionkey)")
def qualified_names(t):
    q = F.concat("r_name", F.lit("::"), "n_name")
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", text.container_name(q).alias("container"), text.last_name(q).alias("bare"))


@query("""SELECT k AS n, round(r / 255.0, 6) AS red, round(g / 255.0, 6) AS green, round(b / 255.0, 6) AS blue FROM (SELECT k, CASE WHEN k < 232 THEN ((k - 16) // 36) * 51 ELSE (k - 232) * 10 + 8 END AS r,
 CASE WHEN k < 232 THEN (((k - 16) // 6) % 6) * 51 ELSE (k - 232) * 10 + 8 END AS g, CASE WHEN k < 232 THEN ((k - 16) % 6) * 51 ELSE (k - 232) * 10 + 8 END AS b FROM (SELECT DISTINCT (o_orderkey % 240 + 16)::INT AS k FROM orders))""")
def terminal_colors(t):
    n = t.orders.select((F.col("o_orderkey") % 240 + 16).cast("int").alias("n")).distinct()
    c = text.terminal_color(F.col("n"))
    return n.select("n", *[F.round(c[x], 6).alias(x) for x in ("red", "green", "blue")])


@query("SELECT c_custkey, round(('0x' || substr(h, 1, 2))::INT / 255.0, 6) AS red, round(('0x' || substr(h, 5, 2))::INT / 255.0, 6) AS blue FROM (SELECT c_custkey, printf('%06x', c_custkey % 16777216) AS h FROM customer)")
def hex_colors(t):
    c = text.color_channels(F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("c_custkey") % 16777216)), 6, "0")))
    return t.customer.select("c_custkey", F.round(c["red"], 6).alias("red"), F.round(c["blue"], 6).alias("blue"))


# State and extraction


@query("SELECT conv_id::VARCHAR AS uri, max(turn) AS version, count(DISTINCT turn)::INT AS applied, (count(*) - count(DISTINCT turn))::INT AS stale FROM conversations GROUP BY conv_id")
def doc_state(t):
    events = t.conversations.select(
        F.col("conv_id").cast("string").alias("uri"), F.col("turn").alias("version"), F.lit("change").alias("action"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "text"
    )
    return document_state.latest_documents(events).select("uri", "version", "applied", "stale")


from . import code_queries, column_queries, editor_queries, source_queries, tree_queries  # noqa: E402, F401  (they register their queries)
