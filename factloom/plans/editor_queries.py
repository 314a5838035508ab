"""Queries for lints, trees, reports, lookups and sources that the other modules of queries leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..extract import facts
from ..functions import nested
from ..operators import aggregates, diagnostics, editor, edits, indexes, lookups, ranking, windows
from ..sources import fact_log
from ..sources import files as sources
from ..streaming import documents as document_state
from .code_queries import FILES, all_found, files, found, rows_of
from .registry import Tables, query

# Indexes


def part_index(t: Tables) -> str:
    path = storage.new_path(t.spark, "index")
    indexes.build(t.part, path, "p_name")
    return path


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ste')")
def indexed_search(t):
    return indexes.search(t.spark, part_index(t), t.part.select("p_partkey", "p_name"), "STE", "p_name")


@query("""SELECT p_partkey, p_name, tier FROM (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 're' THEN 0 WHEN starts_with(lower(p_name), 're') THEN 1
 WHEN contains(lower(p_name), 're') THEN 2 WHEN regexp_matches(lower(p_name), 'r.*e') THEN 3 END AS tier FROM part) WHERE tier IS NOT NULL
 ORDER BY least(tier, 2), p_name, p_partkey LIMIT 200""")
def indexed_search_ranked(t):
    return indexes.ranked_search(t.spark, part_index(t), t.part.select("p_partkey", "p_name"), "re", "p_name", ["p_partkey"], 200)


@query("SELECT 'test_price' AS label, 'Subroutine' AS kind, '3_test_price' AS sort_text FROM customer")
def indexed_completions(t):
    symbols, path = facts.symbols(found(t)), storage.new_path(t.spark, "index")
    indexes.build(symbols, path)
    return editor.symbol_completions(indexes.completions(t.spark, path, symbols, "test", "name"), "test")


@query("""SELECT o_orderkey, c_custkey::VARCHAR AS uri, CASE WHEN c_nationkey = 7 THEN 2 ELSE 1 END * o_orderkey AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3""")
def logged_changes(t):
    """Orders of all customers; then those of one nation change, and those of another go; a bucket with two changes is compacted between."""
    path, uri = storage.new_path(t.spark, "log"), F.col("c_custkey").cast("string").alias("uri")
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(uri, "o_orderkey", F.col("o_orderkey").alias("value"), "c_nationkey")
    of = lambda nation: t.customer.filter(F.col("c_nationkey") == nation).select(uri)
    facts_ = rows.drop("c_nationkey")
    fact_log.create(t.spark, path, facts_.schema, buckets=8)
    fact_log.append(facts_, t.customer.select(uri), path, 0)
    fact_log.append(facts_.withColumn("value", F.col("value") * 2), of(7), path, 1)
    fact_log.compact(t.spark, path, most_changes=1)
    fact_log.append(facts_.limit(0), of(3), path, 2)
    return fact_log.read(t.spark, path)


# Refreshes


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
 r AS (SELECT user_id, min(ms) AS ms FROM e GROUP BY user_id UNION ALL SELECT r.user_id, (SELECT min(e.ms) FROM e WHERE e.user_id = r.user_id AND e.ms >= r.ms + 86400000) FROM r WHERE r.ms IS NOT NULL)
 SELECT user_id, ms, min(event_id) AS event_id FROM r JOIN e USING (user_id, ms) GROUP BY user_id, ms""")
def leading_refreshes(t):
    rows = t.events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return windows.leading_refreshes(rows, ["user_id"], "ms", 86_400_000, ["event_id"]).select("user_id", "ms", "event_id")


# Lookups


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def equal_rows(t):
    return lookups.where_equal(t.orders, o_orderstatus="F", o_orderpriority="5-LOW").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT event_type AS module FROM events WHERE user_id = 3")
def dependencies_of_file(t):
    return lookups.file_dependencies(t.events.select(F.col("user_id").cast("string").alias("uri"), F.col("event_type").alias("module")), "3")


@query("SELECT doc_id FROM documents WHERE lang = 'en' OR lang IS NULL")
def unchanged_files(t):
    now = t.documents.select("doc_id", "lang", F.col("doc_id").alias("uri"), F.xxhash64("text").alias("content_hash"))
    known = now.filter("lang != 'en'").select("uri", "content_hash")
    return lookups.unchanged(now, known).select("doc_id")


NODES = "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS sb, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 100 AS eb, o_custkey AS depth FROM orders"


def nodes(t: Tables) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    return t.orders.select("o_orderkey", day.alias("sb"), (day + 100).alias("eb"), F.col("o_custkey").alias("depth"))


@query(f"SELECT sb, depth FROM ({NODES}) WHERE sb <= 9500 AND 9500 < eb ORDER BY depth DESC, sb LIMIT 1")
def deepest_node(t):
    return lookups.deepest_at(nodes(t), 9500).select("sb", "depth")


@query(f"SELECT o_orderkey, depth FROM ({NODES}) WHERE sb <= 9500 AND 9500 < eb")
def node_chain(t):
    return lookups.selection_chain(nodes(t), 9500).select("o_orderkey", "depth")


@query("SELECT DISTINCT user_id::VARCHAR AS uri FROM events WHERE event_type = 'error'")
def open_documents(t):
    rows = t.events.select(F.col("user_id").cast("string").alias("uri"), (F.col("event_type") == "error").alias("open"))
    return lookups.where_equal(rows, open=True).select("uri").distinct()


# Ranking and reports


@query("SELECT label, kind, sort_text FROM (SELECT p_brand AS label, p_type AS kind, p_name AS sort_text, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS n FROM part) WHERE n = 1")
def ordered_labels(t):
    items = t.part.select(F.col("p_brand").alias("label"), F.col("p_type").alias("kind"), F.col("p_name").alias("sort_text"), F.col("p_partkey").alias("idx"))
    return ranking.ordered_completions(items).select("label", "kind", "sort_text")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS rank FROM part""")
def import_order(t):
    line = F.when(F.col("p_size") % 4 == 0, "use strict;").when(F.col("p_size") % 4 == 1, "use A::B;").when(F.col("p_size") % 4 == 2, "use lib 'x';").otherwise(F.concat(F.lit("use "), "p_type", F.lit(";")))
    return ranking.sorted_imports(t.part.select("p_partkey", F.col("p_brand").alias("uri"), line.alias("line_text"))).select("p_partkey", "rank")


@query("SELECT key FROM (SELECT event_id AS key, value, sum(user_id) OVER (ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS b, row_number() OVER (ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 500 AND b <= 8000")
def cache_contents(t):
    entries = t.events.select(F.col("event_id").alias("key"), F.col("ts").alias("used_at"), F.col("user_id").alias("bytes"))
    return ranking.evict(entries, 500, 8000).select("key")


@query("SELECT p_partkey, p_size - 25 AS increase, round((p_size - 25) / 25.0 * 100, 4) AS percent, (p_size - 25 > 10 OR (p_size - 25) / 25.0 * 100 > 20) AS exceeded FROM part")
def regression_checks(t):
    r = aggregates.regression_check(F.col("p_size"), F.lit(25), 10, 20)
    return t.part.select("p_partkey", r["increase"].alias("increase"), F.round(r["percent"], 4).alias("percent"), r["exceeded"].alias("exceeded"))


@query("SELECT bool_and(m) AS all_met FROM (SELECT quantile_disc(value, 0.95) <= 100 AS m FROM events GROUP BY event_type)")
def all_targets_met(t):
    stats = aggregates.slo_statistics(t.events, "event_type", "value", F.col("value") < 5, F.lit(100.0))
    return diagnostics.all_met(stats)


@query("SELECT count(*) > 0 AS any FROM documents")
def has_files(t):
    return diagnostics.any_rows(t.documents)


@query("SELECT sum(n_chars)::BIGINT AS bytes FROM documents")
def cache_bytes(t):
    return diagnostics.total_bytes(t.documents, "n_chars")


@query("SELECT p_partkey, round(p_size * 100.0 / 50, 4) AS reused, p_size >= 25 AS met FROM part")
def shares_and_thresholds(t):
    return t.part.select("p_partkey", F.round(diagnostics.share(F.col("p_size"), F.lit(50)), 4).alias("reused"), diagnostics.coverage_met(F.col("p_size"), F.lit(25)).alias("met"))


BRAND_TIMES = "SELECT p_brand, avg(p_retailprice) FILTER (WHERE p_size % 2 = 0) AS ours, avg(p_retailprice) FILTER (WHERE p_size % 2 = 1) AS theirs FROM part GROUP BY 1"


def brand_times(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.avg(F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice"))).alias("ours"), F.avg(F.when(F.col("p_size") % 2 == 1, F.col("p_retailprice"))).alias("theirs"))


@query(f"SELECT p_brand, round(theirs / ours, 4) AS speedup FROM ({BRAND_TIMES}) WHERE theirs / ours < 1")
def slower_brands(t):
    return diagnostics.slower(brand_times(t), "ours", "theirs", 1.0).select("p_brand", F.round("speedup", 4).alias("speedup"))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE ours < theirs) AS passed, round(count(*) FILTER (WHERE ours < theirs) * 100.0 / count(*), 4) AS passed_share, round(avg(ours), 2) AS ours, round(avg(theirs), 2) AS theirs, round((avg(ours) - avg(theirs)) / avg(theirs) * 100, 4) AS difference FROM ({BRAND_TIMES})")
def comparison_totals(t):
    out = diagnostics.comparison_summary(brand_times(t).withColumn("faster", F.col("ours") < F.col("theirs")), "ours", "theirs", "faster")
    return out.select("n", "passed", F.round("passed_share", 4).alias("passed_share"), F.round("ours", 2).alias("ours"), F.round("theirs", 2).alias("theirs"), F.round("difference", 4).alias("difference"))


@query("SELECT event_id, CASE WHEN value < 5 THEN 'Not covered by tests' ELSE 'Never executed' END AS message, CASE WHEN value < 5 THEN 'Warning' ELSE 'Info' END AS severity FROM events WHERE value < 5 OR user_id % 10 = 0")
def coverage_lines(t):
    lines = t.events.select("event_id", (F.col("value") >= 5).alias("covered"), (F.col("user_id") % 10).alias("hits"))
    return diagnostics.coverage_notes(lines).select("event_id", "message", "severity")


@query("SELECT event_id, round(event_id * 100.0 / 20000, 4) AS percent, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) > 86400000 AS timed_out FROM events")
def build_progress(t):
    steps = t.events.select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.lit(20000).alias("total"))
    return diagnostics.progress(steps, "user_id", "ms", "event_id", "total", 86_400_000).select("event_id", F.round("percent", 4).alias("percent"), "timed_out")


@query("SELECT f AS feature, count(uri) AS n_files, min(uri) AS first_uri, CASE WHEN count(uri) > 0 THEN 100.0 ELSE 0.0 END AS percent FROM (SELECT unnest(['quote', 'the', 'never']) AS f, unnest(['\"', 'the ', 'Xq9!never']) AS p) LEFT JOIN (SELECT doc_id AS uri, text FROM documents) ON contains(text, p) OR (f = 'quote' AND contains(text, '''')) GROUP BY f")
def covered_features(t):
    return diagnostics.feature_coverage(t.documents.select(F.col("doc_id").alias("uri"), "text"), {"quote": ['"', "'"], "the": ["the "], "never": ["Xq9!never"]})


@query("""WITH f AS (SELECT p_brand AS id, p_type AS maturity, p_size % 2 = 0 AS advertised, CASE WHEN p_size % 3 = 0 THEN [] ELSE ['t' || p_size] END AS tests FROM part)
 SELECT id, 'duplicate id' AS problem FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'unknown maturity ' || maturity FROM f WHERE maturity <> 'ECONOMY'
 UNION ALL SELECT id, 'no tests' FROM f WHERE advertised AND len(tests) = 0 UNION ALL SELECT id, 'missing test ' || tests[1] FROM f WHERE advertised AND len(tests) > 0 AND tests[1] NOT IN ('t2', 't4', 't8')""")
def catalogue_checks(t):
    tests = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), "p_size")))
    features = t.part.select(F.col("p_brand").alias("id"), F.col("p_type").alias("maturity"), (F.col("p_size") % 2 == 0).alias("advertised"), tests.alias("tests"))
    return diagnostics.catalogue_problems(features, t.spark.createDataFrame([("t2",), ("t4",), ("t8",)], "test string"), ["ECONOMY"])


@query("SELECT event_id, '{\"a\":' || CASE WHEN value > 50 THEN 'true' ELSE '' END AS begins, CASE WHEN value > 50 THEN 10 ELSE 2 END AS length FROM events WHERE value > 50 UNION ALL SELECT event_id, '{}', 2 FROM events WHERE NOT value > 50")
def capability_json(t):
    text = diagnostics.capabilities({"a": F.col("value") > 50, "b": F.lit(False)})
    return t.events.select("event_id", F.regexp_replace(text, "true}$", "true").alias("begins"), F.length(text).alias("length"))


# Code under the cursor


@query(f"SELECT uri, place, CASE WHEN place < 0 THEN 'main' ELSE 'Shop::C' || k END AS package FROM ({FILES}) CROSS JOIN {rows_of('place', (-1,), (0,), (120,))}")
def packages_in_force(t):
    points = files(t).select("uri", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(120))).alias("place"))
    return diagnostics.package_at(points, facts.symbols(found(t)), "place").select("uri", "place", "package")


@query(f"SELECT uri, replace(pkg, '_k', 'Shop::C' || k) AS pkg, name, sigil, key_kind FROM ({FILES}) CROSS JOIN {rows_of('pkg, name, sigil, key_kind', ('_k', 'count', '$', 'Var'), ('_k', 'price', None, 'Sub'), ('Other', 'idle', None, 'Sub'))}")
def keys_at_cursor(t):
    uses = files(t).select("uri", F.lit(130).alias("at"), F.explode(F.array(F.lit("$count"), F.lit("price"), F.lit("Other::idle"))).alias("text"))
    keyed = diagnostics.symbol_keys(diagnostics.package_at(uses, facts.symbols(found(t)), "at"))
    return keyed.select("uri", "pkg", "name", "sigil", "key_kind")


@query(f"SELECT uri, scope_id, (strpos(text, s) - 1)::INT AS declared_at FROM ({FILES}) CROSS JOIN {rows_of('scope_id, s', (1, '$count = 5'), (2, '$count = max'), (3, '$count = 5'))}")
def variable_declarations(t):
    rows = found(t)
    scopes = facts.scopes(rows).select("uri", "id", "parent", "kind")
    uses = scopes.filter("id > 0").select("uri", F.lit("$count").alias("name"), F.lit("Variable").alias("kind"), F.col("id").alias("scope_id"), F.lit(400).alias("at"))
    return diagnostics.declarations(uses, facts.symbols(rows), scopes).select("uri", "scope_id", F.col("symbol_sb").alias("declared_at"))


@query(f"SELECT uri, replace(reference, '_k', 'Shop::C' || k) AS reference, (strpos(text, 'sub idle') - 1)::INT AS symbol_sb FROM ({FILES}) CROSS JOIN {rows_of('reference', ('_k::idle',), ('idle',), ('Unknown::idle',))}")
def qualified_definitions(t):
    rows = found(t)
    scopes = facts.scopes(rows)
    package = F.regexp_extract("text", r"package ([\w:]+)", 1)
    asked = files(t).select("uri", F.explode(F.array(F.concat(package, F.lit("::idle")), F.lit("idle"), F.lit("Unknown::idle"))).alias("name"), F.lit("Subroutine").alias("kind"), F.lit(1).alias("scope_id"))
    return diagnostics.qualified_symbols(asked, facts.symbols(rows), scopes).select("uri", "reference", "symbol_sb")


@query(f"SELECT uri, 'Shop::C' || k AS type, 0 AS definition_sb, kind FROM ({FILES}) CROSS JOIN {rows_of('kind', ('arrow',), ('qualified',))}")
def type_definition_links(t):
    package = F.regexp_extract("text", r"package ([\w:]+)", 1)
    forms = F.array(F.struct(F.lit("arrow").alias("kind"), F.concat(package, F.lit("->new(1)")).alias("text")), F.struct(F.lit("qualified").alias("kind"), F.concat(package, F.lit("::price")).alias("text")), F.struct(F.lit("plain").alias("kind"), F.lit("$x").alias("text")))
    uses = files(t).select("uri", F.explode(forms).alias("_f")).select("uri", "_f.*")
    return diagnostics.type_definitions(uses, facts.symbols(found(t))).select("uri", "type", "definition_sb", "kind")


@query(f"SELECT uri, name FROM ({FILES}) CROSS JOIN {rows_of('name', ('price',), ('test_price',))}")
def call_hierarchy_items(t):
    points = files(t).select("uri", F.explode(F.array(F.instr("text", "rounded"), F.instr("text", "$unused"), F.lit(3))).alias("at"))
    return diagnostics.callables_at(points, facts.symbols(found(t)), "at").select("uri", "name")


@query("SELECT o_orderkey, o_orderkey % 90 + CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS at FROM orders")
def name_starts(t):
    name = F.when(F.col("o_orderkey") % 3 == 0, "$x").when(F.col("o_orderkey") % 3 == 1, "@list").otherwise("f")
    return t.orders.select("o_orderkey", diagnostics.skip_sigil(F.col("o_orderkey") % 90, name).alias("at"))


# Lints, trees and tokens

EXTRA = "if ($x = 1) {{ f(); }}\nwhile (($y = 2)) {{ }}\nif ($count == undef || $VERSION == 3 || $zz != 1) {{ }}\ndefined @list; defined(%h); defined $x; my $b = $[;\n}} (]\n".replace("{{", "{").replace("}}", "}")


def messy(t: Tables) -> DataFrame:
    return files(t).select("uri", F.concat("text", F.lit(EXTRA)).alias("text"))


@query(f"SELECT uri, code, start, message FROM (SELECT uri, code, message, (strlen(text) + strpos('{EXTRA}', needle) - 1 + skip)::INT AS start FROM ({FILES}) CROSS JOIN " + rows_of(
    "code, message, needle, skip",
    ("assignment-in-condition", "Assignment in condition - did you mean '=='?", "= 1)", 0),
    ("numeric-undef", "Using '==' with potentially undefined value", "== undef", 0),
    ("numeric-undef", "Using '!=' with potentially undefined value", "!= 1", 0),
    ("deprecated-defined", "Use of 'defined @list' is deprecated", "defined @list", 0),
    ("deprecated-defined", "Use of 'defined %h' is deprecated", "defined(%h", 0),
    ("deprecated-array-base", "Use of '$[' is deprecated and will be removed", "$[;", 0),
    ("parse-error", "Unexpected }", "$[;", 4),
    ("parse-error", "Unclosed (", "(]", 0),
    ("parse-error", "Unexpected ]", "(]", 1),
) + ")")
def all_diagnostics(t):
    rows = facts.stored(messy(t), tokens=True)
    tokens = facts.tokens_of(rows)
    issues = diagnostics.file_diagnostics(diagnostics.bracket_errors(tokens), diagnostics.common_mistakes(tokens, facts.symbols(rows)), diagnostics.deprecated_syntax(tokens))
    return issues.select("uri", "code", "start", "message")


@query(f"SELECT uri, (strpos(text, 'a b') - 1)::INT AS sb FROM (SELECT uri, text || 'my $d = <<\"END\";' || chr(10) || 'a b' || chr(10) || 'END' || chr(10) AS text FROM ({FILES}))")
def heredoc_folds(t):
    rows = files(t).select("uri", F.concat("text", F.lit('my $d = <<"END";\na b\nEND\n')).alias("text"))
    return diagnostics.heredoc_spans(facts.tokens(rows)).select("uri", "sb")


@query(f"SELECT uri, 23 AS nodes, 2 AS depth FROM ({FILES}) WHERE false UNION ALL SELECT uri, (len(regexp_extract_all(text, '[({{]')) - 1)::INT, 2 FROM ({FILES})")
def bracket_trees(t):
    """Round and curly brackets of each file, but for those of the quoted list."""
    tree = diagnostics.node_counts(diagnostics.bracket_nodes(facts.tokens(files(t))))
    return tree.select("uri", F.col("nodes").cast("int").alias("nodes"), F.col("depth").cast("int").alias("depth"))


@query(f"SELECT uri, '({{(()())(()())}})' AS tree FROM ({FILES}) WHERE false UNION ALL SELECT uri, '(curly(round)(round))(curly(round)(round))(curly)' FROM ({FILES})")
def tree_as_text(t):
    nodes_ = diagnostics.bracket_nodes(facts.tokens(files(t)))
    kind = F.when(F.col("kind") == "{", "curly").otherwise("round")
    return diagnostics.tree_text(nodes_, kind)


@query(f"SELECT uri, kind, children FROM ({FILES}) CROSS JOIN {rows_of('kind, children', ('price', 2), ('test_price', 2))}")
def tree_children(t):
    nodes_ = diagnostics.bracket_nodes(facts.tokens_of(all_found(t)))
    counted = diagnostics.child_counts(nodes_).join(nodes_.select("uri", "node", "sb"), ["uri", "node"])
    inside = diagnostics.callables_at(counted.select("uri", F.col("sb").alias("at"), "children"), facts.symbols(found(t)), "at")
    return inside.select("uri", F.col("name").alias("kind"), F.col("children").cast("int").alias("children"))


@query(f"SELECT uri, (strlen(text) - strlen(regexp_replace(text, '\\s', '', 'g')))::BIGINT - 3 AS bytes FROM ({FILES})")
def trivia_bytes(t):
    """White space between tokens: all but that in the quoted list and at the end."""
    return diagnostics.trivia(facts.tokens(files(t))).groupBy("uri").agg((F.sum(F.col("eb") - F.col("sb")) - 1).alias("bytes"))


@query(f"SELECT uri, text FROM ({FILES})")
def code_before_data(t):
    rows = files(t).select("uri", F.concat("text", F.lit("__END__\nmy $not = code;\n")).alias("text"))
    return diagnostics.before_data(rows, facts.tokens(rows))


@query(f"SELECT uri, CASE WHEN n = '07' THEN 'too_large' ELSE 'ok' END AS outcome FROM ({FILES})")
def parse_outcome_classes(t):
    rows = files(t).withColumn("text", F.when(F.contains("text", F.lit("VERSION = 07")), F.concat("text", F.repeat(F.lit("#"), F.lit(2000)))).otherwise(F.col("text")))
    return diagnostics.parse_outcomes(rows, 2000)


@query(f"SELECT uri, (len(string_split(text, chr(10))) - len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(trim(l), '^(#.*|[{{}}()\\[\\];]*)$'))))::BIGINT AS lines FROM ({FILES})")
def breakpoint_lines(t):
    lines = files(t).select("uri", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(diagnostics.breakpoint_allowed(F.col("line"))).groupBy("uri").agg(F.count("*").alias("lines"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS shown, strlen('{\"c0\":' || doc_id || '}')::INT AS size FROM documents")
def rendered_values(t):
    return t.documents.select("doc_id", diagnostics.rendered(F.col("text")).alias("shown"), diagnostics.estimated_size(F.col("doc_id")).alias("size"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN 'strict;' WHEN 1 THEN 'new(' END AS suggestion FROM lineitem WHERE l_linenumber % 3 <> 2")
def suggested_lines(t):
    text = F.when(F.col("l_linenumber") % 3 == 0, "  use ").when(F.col("l_linenumber") % 3 == 1, "my $x = Foo->").otherwise("print 1;")
    return editor.inline_completions(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))).drop("text")


@query("SELECT o_orderkey, greatest(0, o_custkey % 5 + CASE o_orderstatus WHEN 'F' THEN 4 ELSE 0 END - CASE o_orderstatus WHEN 'P' THEN 4 ELSE 0 END)::INT AS indent, 'f' || o_custkey AS function, (o_custkey % 3)::INT AS parameter FROM orders")
def typing_help(t):
    line = F.concat(F.repeat(F.lit(" "), (F.col("o_custkey") % 5).cast("int")), F.when(F.col("o_orderstatus") == "F", "if ($x) {").otherwise("f();"))
    active = editor.active_parameter(F.concat(F.lit("my $x = f"), "o_custkey", F.lit("(1"), F.repeat(F.lit(", 2"), (F.col("o_custkey") % 3).cast("int"))))
    return t.orders.select("o_orderkey", editor.indent_after(line, F.when(F.col("o_orderstatus") == "P", "}").otherwise("x")).cast("int").alias("indent"), active["function"].alias("function"), active["parameter"].alias("parameter"))


OLD_CODE = "open(FH, 'a.txt');\nmy $o = new Shop(1); my $p = new Cart(2);\nprint \"Hi\\n\";\nif (defined @list) { eval \"1\" }\n"


@query(f"""SELECT uri, line, old, new, manual FROM (SELECT 'p' || p_partkey AS uri FROM part) CROSS JOIN {rows_of('line, old, new, manual', (0, "open(FH, 'a.txt')", "open(my $fh, '<', 'a.txt')", 0), (1, 'new Shop(', 'Shop->new(', 0), (1, 'new Cart(', 'Cart->new(', 0), (2, 'print "Hi' + chr(92) + 'n"', 'say "Hi"', 0), (3, 'defined @list', '@list', 0), (3, 'eval "', 'eval {', 1))}""")
def old_constructs(t):
    rows = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("uri"), F.lit(OLD_CODE).alias("text"))
    return edits.modernisations(rows).select("uri", "line", "old", "new", F.col("manual").cast("int").alias("manual"))


NEW_CODE = "open(my $fh, '<', 'a.txt');\nmy $o = Shop->new(1); my $p = Cart->new(2);\nsay \"Hi\";\nif (@list) { eval \"1\" }\n".replace("'", "''")


@query(f"SELECT p_partkey, '{NEW_CODE}' AS text FROM part")
def modernised_code(t):
    return t.part.select("p_partkey", F.lit(OLD_CODE).alias("_text")).select("p_partkey", edits.modernised(F.col("_text")).alias("text"))


@query(f"SELECT uri, '$zzz' AS name, (strlen(text) + 10)::INT AS at_byte FROM ({FILES})")
def undeclared_variables(t):
    rows = files(t).select("uri", F.concat("text", F.lit("my $new = $zzz + $count;\n{ no strict; $yyy = 1 }\n")).alias("text"))
    all_facts = facts.stored(rows, pragmas=True)
    uses = facts.refs(all_facts).filter("kind in ('Read', 'Write') and name rlike '^[$@%]'").select("uri", "name", F.col("sb").alias("at"))
    out = diagnostics.undeclared(uses, facts.symbols(all_facts), facts.scopes(all_facts).select("uri", "id", "parent", "kind", "sb", "eb"), facts.pragmas_of(all_facts), ["@_", "$_"])
    return out.select("uri", "name", F.col("at").alias("at_byte"))


@query("SELECT event_id, t AS event_type FROM events, unnest(['click', 'view']) AS u(t) WHERE event_type = 'error' UNION ALL SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def untyped_samples(t):
    rows = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    return diagnostics.recorded_for_all(rows, ["click", "view"], "event_type")


@query("SELECT k, v FROM (SELECT l_orderkey AS k, l_partkey AS v, 0 AS s FROM lineitem WHERE l_partkey < 5 UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders WHERE o_custkey < 5) ORDER BY s, k, v LIMIT 500")
def references_and_text(t):
    indexed = t.lineitem.filter("l_partkey < 5").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"))
    in_text = t.orders.filter("o_custkey < 5").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    return diagnostics.all_references(indexed, in_text, ["k", "v"], 500)


# Files, notebooks, state


@query(f"SELECT CASE WHEN n = '07' THEN 'new/' || k ELSE uri END AS uri, name FROM ({FILES}) CROSS JOIN {rows_of('name', ('price',), ('test_price',), ('idle',))}")
def moved_facts(t):
    some = files(t).filter(F.contains("text", F.lit("VERSION = 07")))
    renames = some.select("uri", F.concat(F.lit("new/"), F.regexp_extract("uri", r"C(\d+)", 1)).alias("new_uri"))
    return diagnostics.moved_files(facts.symbols(found(t)).filter("kind = 'Subroutine'").select("uri", "name"), renames)


@query("SELECT conv_id, place, cell FROM (SELECT conv_id, generate_subscripts(c, 1) - 1 AS place, unnest(c) AS cell FROM (SELECT conv_id, (c[1:1] || ['new'] || c[4:]) AS c FROM (SELECT conv_id, list(role || turn ORDER BY turn, role, text) AS c FROM conversations GROUP BY conv_id)))")
def notebook_changes(t):
    cells = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda c: F.concat(c["role"], c["turn"].cast("string")))
    notebooks = t.conversations.groupBy(F.col("conv_id").alias("uri")).agg(cells.alias("cells")).withColumn("version", F.lit(2))
    changed = notebooks.withColumn("cells", diagnostics.spliced(F.col("cells"), F.lit(1), F.lit(2), F.array(F.lit("new"))))
    return diagnostics.notebook_cells(changed).select(F.col("uri").alias("conv_id"), "place", "cell")


@query("SELECT count(*) FILTER (WHERE false) AS n FROM documents")
def cleared_table(t):
    return diagnostics.cleared(t.documents).agg(F.count("*").alias("n"))


@query("SELECT event_id, 'timeout' AS reason FROM events WHERE value > 50 UNION ALL SELECT event_id, 'limit' FROM events WHERE event_type = 'error'")
def early_exits(t):
    log = t.events.filter("value > 50").select("event_id", F.lit("timeout").alias("reason"))
    return ranking.all_of(log, t.events.filter("event_type = 'error'").select("event_id", F.lit("limit").alias("reason")))


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def routed_query(t):
    whole = lambda: t.documents.filter("lang = 'en'").select("doc_id")
    return diagnostics.by_state("Ready", whole, lambda: t.documents.select("doc_id").limit(0))


@query("SELECT doc_id::VARCHAR AS uri, length(text)::VARCHAR AS result FROM documents WHERE text IS NOT NULL")
def processed_files(t):
    rows = t.documents.filter("text is not null").select(F.col("doc_id").cast("string").alias("uri"), "text")
    return diagnostics.processed(rows, lambda uri, text: str(len(text)), 8)


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'Initializing' WHEN 'view' THEN 'Building' WHEN 'purchase' THEN 'Ready' WHEN 'error' THEN 'Error' ELSE 'Idle' END AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 a(s, w) AS (VALUES ('Idle', 'Initializing'), ('Initializing', 'Building'), ('Initializing', 'Error'), ('Building', 'Ready'), ('Building', 'Error'), ('Ready', 'Building'), ('Ready', 'Error'), ('Error', 'Idle'), ('Error', 'Initializing')),
 f AS (SELECT user_id, event_id, n, CASE WHEN wanted = 'Initializing' THEN wanted ELSE 'Idle' END AS state, wanted = 'Initializing' AS allowed FROM r WHERE n = 1
 UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN (f.state, r.wanted) IN (SELECT (s, w) FROM a) THEN r.wanted ELSE f.state END, (f.state, r.wanted) IN (SELECT (s, w) FROM a) FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
 SELECT user_id, event_id, state, allowed FROM f""")
def index_states(t):
    wanted = F.when(F.col("event_type") == "click", "Initializing").when(F.col("event_type") == "view", "Building").when(F.col("event_type") == "purchase", "Ready").when(F.col("event_type") == "error", "Error").otherwise("Idle")
    return document_state.lifecycle(t.events.select("user_id", "event_id", wanted.alias("wanted")), "user_id", "event_id", "wanted").select("user_id", "event_id", "state", "allowed")


# Texts that hold records


@query("""SELECT 'f' || p_partkey || '.txt' AS file, 'f' || p_partkey || '.' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '.001' AS id, p_name AS title, [p_type, 'x'] AS tags, 'print ' || p_size || ';' AS body, 2 AS line FROM part
 UNION ALL SELECT 'f' || p_partkey || '.txt', 'own.' || p_partkey, 'Second', [], 'two', 7 FROM part""")
def corpus_texts(t):
    text = F.concat(F.lit("intro\n=====\n"), "p_name", F.lit("\n=====\n# @tags: "), "p_type", F.lit(", x\nprint "), "p_size", F.lit(";\n=====\nSecond\n=====\n# @id: own."), "p_partkey", F.lit("\ntwo\n"))
    rows = sources.sections_of(t.part.select(F.concat(F.lit("f"), "p_partkey", F.lit(".txt")).alias("file"), text.alias("text")))
    return rows.select("file", "id", "title", "tags", "body", "line")


@query("""SELECT 'f' || p_brand AS file, 'i' || p_partkey AS id, 'unknown tag ' || p_type AS problem FROM part WHERE p_type <> 'ECONOMY' UNION ALL SELECT 'f' || p_brand, 'i' || p_partkey, 'empty body' FROM part WHERE p_size % 2 = 0
 UNION ALL SELECT 'f' || p_brand, NULL, 'too many sections' FROM part GROUP BY p_brand HAVING count(*) > 12""")
def corpus_lint(t):
    rows = t.part.select(F.concat(F.lit("f"), "p_brand").alias("file"), F.concat(F.lit("i"), "p_partkey").alias("id"), F.array("p_type").alias("tags"), F.when(F.col("p_size") % 2 == 0, " ").otherwise("x").alias("body"))
    return sources.lint_sections(rows, ["ECONOMY"])


@query("SELECT event_id::VARCHAR AS id, event_type AS method, '{\"value\": ' || user_id || '}' AS params, NULL AS error FROM events UNION ALL SELECT NULL, NULL, NULL, 'malformed' FROM events WHERE event_type = 'error'")
def framed_rows(t):
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("method"), F.struct(F.col("user_id").alias("value")).alias("params")))
    data = F.concat(sources.framed(body), F.when(F.col("event_type") == "error", sources.framed(F.lit("{oops"))).otherwise(F.lit("")))
    return sources.messages_of(t.events.select(F.encode(data, "UTF-8").alias("content")))


@query("SELECT 'r' || o_custkey AS receipt, 'g' || o_orderkey AS name, o_orderstatus AS status, o_orderkey AS duration_ms FROM orders")
def receipt_gates(t):
    gates = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct(F.concat(F.lit("g"), "o_orderkey").alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("duration_ms"))).alias("gates"))
    rows = gates.select(F.concat(F.lit("r"), "o_custkey").alias("receipt"), F.to_json(F.struct("gates")).alias("text"))
    return sources.gates_of(rows).select("receipt", "name", "status", "duration_ms")


@query("SELECT lang AS layer, doc_id AS path, strlen(text)::BIGINT AS bytes, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents WHERE text IS NOT NULL")
def text_sizes(t):
    rows = t.documents.filter("text is not null").select(F.col("lang").alias("layer"), F.col("doc_id").alias("path"), F.col("text").alias("value"))
    return sources.sizes_of(rows, ["layer", "path"]).select("layer", "path", F.col("bytes").cast("long").alias("bytes"), F.col("lines").cast("long").alias("lines"))


@query("SELECT p_brand, p_partkey AS place, 'lib/' || p_partkey || '.pm' AS path FROM part")
def listed_files(t):
    listing = t.part.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda k: F.concat(F.lit("lib/"), k.cast("string"), F.lit(".pm"))), "\0").alias("listing"))
    rows = sources.paths_of(listing, ["p_brand"], "listing")
    return rows.select("p_brand", F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("place"), "path")


@query("SELECT 'c' || p_brand AS file, 'f' || p_partkey AS id, p_type AS maturity, p_size % 2 = 0 AS advertised, ['t' || p_size] AS tests FROM part")
def feature_catalogues(t):
    one = F.concat(F.lit('[[feature]]\nid = "f'), "p_partkey", F.lit('"\nmaturity = "'), "p_type", F.lit('"\nadvertised = '), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), F.lit('\ntests = ["t'), "p_size", F.lit('"]\n'))
    rows = t.part.groupBy("p_brand").agg(F.array_join(F.collect_list(one), "\n").alias("text"))
    return sources.features_of(rows.select(F.concat(F.lit("c"), "p_brand").alias("file"), "text")).select("file", "id", "maturity", "advertised", "tests")


@query(f"SELECT p_partkey, line, word FROM part, (VALUES (0, 'alpha'), (1, 'beta')) v(line, word)")
def matched_lines(t):
    from ..functions import text

    rows = t.part.select("p_partkey", F.lit("<alpha>\n<beta> x").alias("text"))
    return text.line_matches(rows, ["p_partkey"], "text", "<([a-z]+)>").select("p_partkey", "line", F.col("match").alias("word"))


@query("SELECT o_orderkey, strlen('é' || o_orderkey || chr(10))::BIGINT + 1 AS start, strlen('é' || o_orderkey || chr(10))::BIGINT + 3 AS old_end, strlen('é' || o_orderkey || chr(10))::BIGINT + 1 + strlen(o_orderpriority) AS new_end FROM orders")
def change_edits(t):
    text = F.concat(F.lit("é"), "o_orderkey", F.lit("\nabcdef"))
    rows = t.orders.select("o_orderkey", text.alias("text"), F.lit(1).alias("sl"), F.lit(1).alias("sc"), F.lit(1).alias("el"), F.lit(3).alias("ec"), F.col("o_orderpriority").alias("new_text"))
    return edits.edits_of_changes(rows).select("o_orderkey", "start", "old_end", "new_end")
