"""Queries over code: a source file for each customer, whose facts SQL can tell from the template and the row.

The tables hold no code, so each customer is made into a file of the same shape
with names of its own. SQL finds places in the same text by searching for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import facts
from ..operators import diagnostics, editor, edits, joins, lookups, windows
from .registry import Tables, query

TEMPLATE = """package Shop::C{k};
use strict;
use warnings;
use parent 'Base::N{n}';
use List::Util qw(first max);
our $VERSION = {n};
my $count = 5;
sub price {
    my ($self, $n) = @_;
    return rounded($n) + $count;
}
sub test_price {
    my $unused = 3;
    my $count = max(1, 2);
    Shop::C{m}::idle($count);
}
sub idle { 1 }
1;
"""

FILES = f"""SELECT 'lib/C' || k || '.pm' AS uri, replace(replace(replace('{TEMPLATE.replace("'", "''")}', '{{k}}', k), '{{n}}', n), '{{m}}', m) AS text, k, n, m
 FROM (SELECT substr(c_name, 10) AS k, lpad(c_nationkey::VARCHAR, 2, '0') AS n, lpad((c_custkey // 2)::VARCHAR, 9, '0') AS m FROM customer)"""


def files(t: Tables) -> DataFrame:
    k, n, m = F.substring("c_name", 10, 9), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad(F.expr("c_custkey div 2").cast("string"), 9, "0")
    text = F.lit(TEMPLATE)
    for mark, value in (("{k}", k), ("{n}", n), ("{m}", m)):
        text = F.replace(text, F.lit(mark), value)
    return t.customer.select(F.concat(F.lit("lib/C"), k, F.lit(".pm")).alias("uri"), text.alias("text"))


def found(t: Tables) -> DataFrame:
    """The facts of all files, parsed and written once for a query."""
    if "facts" not in t.made:
        t.made["facts"] = facts.stored(files(t))
    return t.made["facts"]


def all_found(t: Tables) -> DataFrame:
    """The same with tokens and pragma states."""
    if "all" not in t.made:
        t.made["all"] = t.made["facts"] = facts.stored(files(t), tokens=True, pragmas=True)
    return t.made["all"]


def rows_of(columns: str, *rows: tuple) -> str:
    """SQL of a small table of expected facts."""
    value = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS v({columns})"


def keyed(column: str) -> str:
    return f"replace(replace(replace({column}, '{{k}}', k), '{{n}}', n), '{{m}}', m)"


#: name, kind, qualified name, declaration, scope; text that the symbol begins, and ends (exclusive of the second's end).
SYMBOLS = rows_of(
    "name, kind, qualified, declaration, scope_id, starts, skip, span",
    ("Shop::C{k}", "Package", "Shop::C{k}", None, 0, "package", 0, "package Shop::C{k}"),
    ("$VERSION", "Variable", None, "our", 0, "$VERSION", 0, "$VERSION"),
    ("$count", "Variable", None, "my", 0, "$count = 5", 0, "$count"),
    ("price", "Subroutine", "Shop::C{k}::price", None, 0, "sub price", 0, "sub price {\n    my ($self, $n) = @_;\n    return rounded($n) + $count;\n}"),
    ("$self", "Variable", None, "my", 1, "$self", 0, "$self"),
    ("$n", "Variable", None, "my", 1, "$n)", 0, "$n"),
    ("test_price", "Subroutine", "Shop::C{k}::test_price", None, 0, "sub test_price", 0, "sub test_price {\n    my $unused = 3;\n    my $count = max(1, 2);\n    Shop::C{m}::idle($count);\n}"),
    ("$unused", "Variable", None, "my", 2, "$unused", 0, "$unused"),
    ("$count", "Variable", None, "my", 2, "$count = max", 0, "$count"),
    ("idle", "Subroutine", "Shop::C{k}::idle", None, 0, "sub idle", 0, "sub idle { 1 }"),
)
PLACED = f"SELECT uri, text, k, n, m, {keyed('name')} AS name, kind, {keyed('qualified')} AS qualified, declaration, scope_id, (strpos(text, starts) - 1)::INT AS sb, (strpos(text, starts) - 1 + strlen({keyed('span')}))::INT AS eb FROM ({FILES}) CROSS JOIN {SYMBOLS}"


@query(f"SELECT uri, name, kind, qualified AS qualified_name, declaration, scope_id, sb, eb FROM ({PLACED})")
def code_symbols(t):
    return facts.symbols(found(t)).select("uri", "name", "kind", "qualified_name", "declaration", "scope_id", "sb", "eb")


REFS = rows_of(
    "name, kind, n_times",
    ("strict", "Import", 1), ("warnings", "Import", 1), ("parent", "Import", 1), ("List::Util", "Import", 1), ("$VERSION", "Definition", 1), ("$count", "Definition", 2), ("price", "Definition", 1),
    ("test_price", "Definition", 1), ("idle", "Definition", 1), ("$self", "Definition", 1), ("$n", "Definition", 1), ("$unused", "Definition", 1), ("@_", "Read", 1), ("$n", "Read", 1), ("$count", "Read", 2),
    ("rounded", "Usage", 1), ("Shop::C{k}::rounded", "Usage", 1), ("max", "Usage", 1), ("Shop::C{k}::max", "Usage", 1), ("idle", "Usage", 1), ("Shop::C{m}::idle", "Usage", 1),
)


@query(f"SELECT uri, {keyed('name')} AS name, kind, n_times FROM ({FILES}) CROSS JOIN {REFS}")
def code_references(t):
    return facts.refs(found(t)).groupBy("uri", "name", "kind").agg(F.count("*").cast("int").alias("n_times"))


@query(f"SELECT uri, module, CASE module WHEN 'List::Util' THEN ['first', 'max'] WHEN 'parent' THEN ['Base::N' || n] ELSE [] END AS symbols, line FROM ({FILES}) CROSS JOIN {rows_of('module, line', ('strict', 1), ('warnings', 2), ('parent', 3), ('List::Util', 4))}")
def code_imports(t):
    return facts.imports(found(t)).select("uri", "module", "symbols", "line")


@query(f"SELECT DISTINCT 'Shop::C' || k AS child, 'Base::N' || n AS parent FROM ({FILES})")
def code_inheritance(t):
    return facts.inherits(found(t)).select("child", "parent")


@query(f"SELECT uri, 'Shop::C' || k || '::' || caller AS caller, callee FROM ({FILES}) CROSS JOIN {rows_of('caller, callee', ('price', 'rounded'), ('test_price', 'max'), ('test_price', 'idle'))}")
def code_calls(t):
    return facts.calls(found(t)).select("uri", "caller", "callee")


@query(f"SELECT uri, id, parent, kind FROM ({FILES}) CROSS JOIN {rows_of('id, parent, kind', (0, None, 'Global'), (1, 0, 'Subroutine'), (2, 0, 'Subroutine'), (3, 0, 'Subroutine'))}")
def code_scopes(t):
    return facts.scopes(found(t)).select("uri", "id", "parent", "kind")


@query(f"SELECT uri, list_sort(list_distinct(regexp_extract_all(text, '[$@][A-Za-z_]\\w*'))) AS variables, len(regexp_extract_all(text, '[$@][A-Za-z_]\\w*'))::BIGINT AS n FROM ({FILES})")
def code_variables(t):
    return diagnostics.variables_of(facts.tokens(files(t)).filter("kind = 'variable'"), ["uri"], "text").select("uri", "variables", "n")


@query(f"SELECT uri, strpos(text, w) - 1 AS sb, w = 'use warnings' AS warnings FROM ({FILES}) CROSS JOIN {rows_of('w', ('use strict',), ('use warnings',))}")
def code_pragmas(t):
    return facts.pragmas(files(t)).select("uri", F.col("sb").cast("long").alias("sb"), "warnings")


@query(f"SELECT uri, 'Shop::C' || k || '::price' AS qualified_name, 'unused_subroutine' AS code FROM ({FILES}) UNION ALL SELECT uri, 'Shop::C' || k || '::test_price', 'unused_subroutine' FROM ({FILES})")
def code_dead_subs(t):
    rows = found(t)
    return joins.dead_code(facts.symbols(rows), facts.refs(rows)).filter("kind = 'Subroutine'").select("uri", "qualified_name", "code")


@query(f"SELECT uri, {keyed('name')} AS name, kind, code FROM ({FILES}) CROSS JOIN {rows_of('name, kind, code', ('Shop::C{k}', 'Package', 'unused_package'), ('$VERSION', 'Variable', 'unused_variable'), ('$self', 'Variable', 'unused_variable'), ('$unused', 'Variable', 'unused_variable'), ('price', 'Subroutine', 'unused_subroutine'), ('test_price', 'Subroutine', 'unused_subroutine'))}")
def unused_subs_of_fixture(t):
    rows = found(t)
    return joins.dead_code(facts.symbols(rows), facts.refs(rows)).select("uri", "name", "kind", "code")


@query(f"SELECT uri, fact, amount FROM ({FILES}) CROSS JOIN {rows_of('fact, amount', ('symbol', 10), ('ref', 23), ('dep', 4), ('import', 4), ('inherits', 1), ('call', 3), ('scope', 4))}")
def extract_facts(t):
    return found(t).groupBy("uri", "fact").agg(F.count("*").cast("int").alias("amount"))


@query(f"SELECT uri, name FROM ({FILES}) CROSS JOIN {rows_of('name', ('$self',), ('$unused',))}")
def code_unused_variables(t):
    rows = found(t)
    return joins.unused_variables(facts.symbols(rows).filter("kind = 'Variable'"), facts.refs(rows).filter("kind != 'Definition'")).select("uri", "name")


@query(f"SELECT uri, '$count' AS name, 2 AS scope_id, 'shadows' AS issue FROM ({FILES})")
def code_redeclarations(t):
    rows = found(t)
    variables = facts.symbols(rows).filter("kind = 'Variable'").select("uri", "name", "scope_id", "sb")
    return joins.redeclarations(variables, facts.scopes(rows).select("uri", "id", "parent")).select("uri", "name", "scope_id", "issue")


@query(f"SELECT uri, module FROM ({FILES}) CROSS JOIN {rows_of('module', ('utf8',), ('Carp',))}")
def code_lacking(t):
    return joins.lacking(files(t), facts.deps(found(t)), ["strict", "utf8", "Carp"])


@query(f"SELECT uri, scope_id, depth, (strpos(text, s) - 1)::INT AS symbol_sb FROM ({FILES}) CROSS JOIN {rows_of('scope_id, depth, s', (1, 1, '$count = 5'), (2, 0, '$count = max'), (2, 1, '$count = 5'), (3, 1, '$count = 5'))}")
def scoped_lookup(t):
    rows = found(t)
    scopes = facts.scopes(rows).select("uri", "id", "parent", "kind")
    asked = scopes.filter("id > 0").select("uri", F.lit("$count").alias("name"), F.lit("Variable").alias("kind"), F.col("id").alias("scope_id"))
    return joins.resolve_in_scopes(asked, facts.symbols(rows), scopes).select("uri", "scope_id", "depth", "symbol_sb")


@query(f"SELECT uri, scope_id, name FROM ({FILES}) CROSS JOIN {rows_of('scope_id, name', (1, '$self'), (1, '$n'), (1, '$count'), (1, '$VERSION'), (2, '$count'), (2, '$unused'), (2, '$count'), (2, '$VERSION'), (3, '$count'), (3, '$VERSION'))}")
def visible_symbols(t):
    rows = found(t)
    scopes = facts.scopes(rows).select("uri", "id", "parent", "kind")
    uses = scopes.filter("id > 0").select("uri", F.col("id").alias("scope_id"))
    return joins.visible(facts.symbols(rows).filter("kind = 'Variable'").select("uri", "name", "scope_id"), uses, scopes).select("uri", "scope_id", "name")


@query(f"SELECT uri, (strpos(text, 'Shop::C' || m || '::idle') - 1)::INT AS sb FROM ({FILES}) WHERE m = '000000003'")
def references_by_key(t):
    rows = found(t)
    return joins.keyed_references(facts.refs(rows), facts.symbols(rows), "Shop::C000000003", "idle", None, ["uri", "sb", "eb"]).select("uri", "sb")


@query(f"SELECT uri, (strpos(text, s) - 1)::INT AS sb FROM ({FILES}) CROSS JOIN {rows_of('s', ('sub idle',), ('Shop::C{m}::idle',))} WHERE s = 'sub idle' UNION ALL SELECT uri, (strpos(text, 'Shop::C' || m || '::idle') - 1)::INT FROM ({FILES})")
def references_by_name(t):
    return joins.references_of(facts.refs(found(t)), "Shop::C000000001::idle", ["uri", "sb", "eb"]).select("uri", "sb")


@query(f"SELECT uri, 10 AS n_symbols FROM ({FILES})")
def ingested_files(t):
    """Files of every second nation are known with their present text, and others with an older one."""
    now = files(t)
    old = now.withColumn("text", F.when(F.contains("text", F.lit("VERSION = 01")), "sub old {}").otherwise(F.col("text")))
    known = facts.extract_facts(old)
    out = facts.ingest(now, old.select("uri", F.xxhash64("text").alias("content_hash")), known)
    return facts.symbols(out).groupBy("uri").agg(F.count("*").cast("int").alias("n_symbols"))


@query(f"SELECT uri, CASE WHEN n = '07' AND name = 'idle' THEN 'rest' ELSE name END AS name FROM ({FILES}) CROSS JOIN {rows_of('name', ('price',), ('test_price',), ('idle',))}")
def reindexed_files(t):
    """Facts after an edit of some files: only those are read again."""
    before = files(t)
    known = before.select("uri", F.xxhash64("text").alias("content_hash"))
    edited = before.filter(F.contains("text", F.lit("VERSION = 07"))).withColumn("text", F.replace("text", F.lit("sub idle"), F.lit("sub rest")))
    return facts.symbols(facts.ingest(edited, known, facts.extract_facts(before))).filter("kind = 'Subroutine'").select("uri", "name")


@query(f"SELECT uri, symbol, module, kind FROM ({FILES}) CROSS JOIN {rows_of('symbol, module, kind', ('first', 'List::Util', 'unused'), ('encode_json', 'JSON', 'missing'), (None, 'strict', 'duplicate'))}")
def import_audits(t):
    rows = facts.imports(all_found(t)).select("uri", "module", "symbols", "line")
    rows = rows.unionByName(rows.filter("module = 'strict'").withColumn("line", F.lit(9)))
    tokens = facts.tokens_of(all_found(t)).filter("kind = 'word'").select("uri", "text").unionByName(files(t).select("uri", F.lit("encode_json").alias("text")))
    exports = t.spark.createDataFrame([("List::Util", "first"), ("List::Util", "max"), ("JSON", "encode_json")], "module string, symbol string")
    audit = joins.import_audit(rows, tokens, exports, ["strict", "warnings", "parent"])
    one = lambda k: audit[k].select("uri", *([F.lit(None).cast("string").alias("symbol")] if k == "duplicate" else ["symbol"]), "module", F.lit(k).alias("kind"))
    return one("unused").unionByName(one("missing")).unionByName(one("duplicate"))


# What an editor asks


@query(f"SELECT uri, name, kind, CASE WHEN name = 'max' THEN 'List::Util' END AS module FROM ({FILES}) CROSS JOIN {rows_of('name, kind', ('price', 'export'), ('max', 'import'), ('idle', 'local'))}")
def code_monikers(t):
    rows = found(t)
    keys = files(t).select("uri", F.explode(F.array(*map(F.lit, ("price", "max", "idle")))).alias("name"))
    exports = files(t).select("uri", F.lit("price").alias("name"))
    return editor.monikers(keys, exports, facts.imports(rows)).select("uri", "name", "kind", "module")


@query(f"SELECT uri, 'price' AS name FROM ({FILES}) WHERE n = '07'")
def method_implementations(t):
    rows = found(t)
    return editor.implementations(facts.symbols(rows), facts.inherits(rows), "Base::N07", "price").select("uri", "name")


@query(f"SELECT uri, 'Shop::C' || k AS name FROM ({FILES}) WHERE n = '07'")
def package_implementations(t):
    rows = found(t)
    return editor.implementations(facts.symbols(rows), facts.inherits(rows), "Base::N07").select("uri", "name")


@query(f"SELECT uri, 1 AS layer FROM ({FILES}) WHERE k = '000000002'")
def layered_definitions(t):
    return editor.layered_definition(facts.symbols(found(t)), "bin/other.pl", "Shop::C000000002", "idle").select("uri", "layer")


@query(f"SELECT uri, ['test_price'] AS tests, NULL::BIGINT AS assertions FROM ({FILES})")
def test_discovery(t):
    rows = found(t)
    return editor.test_items(facts.symbols(rows), facts.calls(rows)).select("uri", "tests", "assertions")


@query(f"SELECT uri, name, title FROM ({FILES}) CROSS JOIN {rows_of('name, title', ('price', '0 references'), ('test_price', '0 references'), ('test_price', 'Run test'))} UNION ALL SELECT uri, 'idle', (SELECT count(*) FROM customer) || ' references' FROM ({FILES}) UNION ALL SELECT uri, 'Shop::C' || k, '0 references' FROM ({FILES})")
def reference_lenses(t):
    rows = found(t)
    counts = joins.usage_counts(facts.refs(rows).filter("kind = 'Usage'"), "name", ["uri", "sb"])
    return edits.code_lenses(facts.symbols(rows), counts).select("uri", "name", "title")


@query(f"SELECT uri, name, line FROM ({FILES}) CROSS JOIN {rows_of('name, line', ('$VERSION', 6), ('$count', 7), ('$self', 9), ('$n', 9), ('$n', 10), ('$count', 10))}")
def shown_variables(t):
    return editor.inline_values(files(t), 6, 10).filter("name != '@_'").select("uri", "name", "line")


@query(f"SELECT uri, class, amount FROM ({FILES}) CROSS JOIN {rows_of('class, amount', ('number', 7), ('string', 2), ('subroutine', 3), ('variable', 10))}")
def semantic_classes(t):
    rows = editor.token_classes(facts.tokens_of(all_found(t)), facts.symbols(found(t)))
    return rows.groupBy("uri", "class").agg(F.count("*").cast("int").alias("amount")).filter("class in ('string', 'variable', 'number', 'subroutine')")


@query("SELECT label, kind, sort_text FROM (VALUES ('$price_list', 'Variable', '1_$price_list')) v(label, kind, sort_text) WHERE false UNION ALL SELECT 'print', 'Function', '2_print' UNION ALL SELECT 'printf', 'Function', '2_printf' UNION ALL SELECT 'price', 'Subroutine', '3_price'")
def completion_list(t):
    symbols = facts.symbols(found(t))
    near = symbols.filter("kind = 'Variable'").select("name", "kind").distinct()
    return editor.completions(t.spark, symbols, near, "pri").select("label", "kind", "sort_text")


@query("SELECT 'test_price' AS label, 'Subroutine' AS kind, '3_test_price' AS sort_text FROM customer")
def workspace_completions(t):
    return editor.symbol_completions(facts.symbols(found(t)), "test")


@query(f"SELECT uri, policy, line FROM ({FILES}) CROSS JOIN {rows_of('policy, line', ('ProhibitTwoArgOpen', 18), ('RequireUniqueSubs', 19))}")
def policy_violations(t):
    rows = files(t).withColumn("text", F.concat("text", F.lit("open(FH, $path) or die;\nsub idle { 2 }\n")))
    all_facts = facts.stored(rows)
    return editor.violations({"files": rows, "symbols": facts.symbols(all_facts), "refs": facts.refs(all_facts), "deps": facts.deps(all_facts)}).select("uri", "policy", "line")


# Edits


@query(f"SELECT uri, replace(text, 'price', 'cost') AS text FROM ({FILES.replace('sub test_price', 'sub test_total')})")
def renamed_files(t):
    rows = files(t).withColumn("text", F.replace("text", F.lit("sub test_price"), F.lit("sub test_total")))
    return edits.apply_edits(rows, edits.rename(rows, facts.symbols(facts.extract_facts(rows)), "price", "cost")).select("uri", "text")


@query(f"SELECT uri, replace(text, 'my $unused = 3;' || chr(10) || '    my $count', 'my $count') AS text FROM ({FILES})")
def inlined_variables(t):
    cut = edits.inline_variable(files(t), "$unused")
    # The declaration's own line goes whole, its indentation included.
    return edits.apply_edits(files(t), cut).select("uri", "text")


@query(f"SELECT uri, replace(text, 'sub idle {{ 1 }}' || chr(10), 'use Moved;' || chr(10)) AS kept, 'package Moved;' || chr(10) || chr(10) || 'sub idle {{ 1 }}' || chr(10) || chr(10) || '1;' || chr(10) AS moved FROM ({FILES})")
def extracted_modules(t):
    out = edits.extract_module(F.col("text"), 17, 17, "Moved")
    return files(t).select("uri", out["kept"].alias("kept"), out["moved"].alias("moved"))


@query(f"""SELECT uri, replace(text, 'sub idle {{ 1 }}', '') AS text FROM ({FILES}) WHERE k = '000000004' UNION ALL SELECT uri, text || chr(10) || 'sub idle {{ 1 }}' || chr(10) FROM ({FILES}) WHERE k = '000000005'""")
def moved_symbols(t):
    some = files(t)
    symbol = facts.symbols(found(t)).filter("uri = 'lib/C000000004.pm' and name = 'idle'").select("uri", F.col("sb").alias("start"), F.col("eb").alias("end"))
    changes = edits.move_symbol(some, symbol, "lib/C000000005.pm")
    return edits.apply_edits(some.join(changes.select("uri").distinct(), "uri", "left_semi"), changes).select("uri", "text")


@query(f"SELECT uri, name FROM ({FILES}) CROSS JOIN {rows_of('name', ('$self',), ('price',))}")
def requested_fixes(t):
    rows = found(t)
    asked = files(t).select("uri", (F.instr("text", "$self") - 1).alias("start"), F.instr("text", "$self").alias("end"))
    return edits.fixes_for(facts.symbols(rows), asked).select("uri", "name")


@query("SELECT o_orderkey, place, argument, parameter FROM (SELECT o_orderkey, o_orderstatus FROM orders) CROSS JOIN (VALUES (0, 'ARRAY'), (1, 'LIST')) v(place, parameter) CROSS JOIN LATERAL (SELECT CASE place WHEN 0 THEN '@list' ELSE o_orderstatus END AS argument)")
def parameter_names(t):
    from ..functions import dimensions

    calls = t.orders.select(F.lit("f").alias("uri"), "o_orderkey", F.lit("push").alias("name"), F.array(F.lit("@list"), "o_orderstatus").alias("args"))
    hints = edits.parameter_hints(calls.withColumn("uri", F.col("o_orderkey").cast("string")), dimensions.dim_builtin(t.spark))
    return hints.select(F.col("uri").cast("long").alias("o_orderkey"), "place", "argument", "parameter")


# Lines


@query(f"SELECT uri, 5 AS line, 3 AS after FROM ({FILES})")
def dead_lines(t):
    rows = files(t).select("uri", F.concat(F.lit("my $x;\n\nreturn 1;\n\n$x++;\n"), "text").alias("text"))
    return windows.unreachable_lines(rows).select("uri", "line", "after")


@query(f"SELECT uri, line, depth FROM ({FILES}) CROSS JOIN {rows_of('line, depth', (0, 0), (7, 1), (8, 1), (9, 1), (10, 0), (11, 1), (14, 1), (15, 0), (16, 0))}")
def open_brackets(t):
    return windows.bracket_depth(files(t)).filter("line in (0, 7, 8, 9, 10, 11, 14, 15, 16)").select("uri", "line", F.col("depth").cast("int").alias("depth"))


@query(f"SELECT uri, count(*) AS n FROM ({FILES}), unnest(string_split(text, ';')) GROUP BY uri HAVING count(*) > 1")
def lexer_checkpoints(t):
    points = windows.checkpoints(facts.tokens(files(t)), ["uri"], ["seq"], F.col("text") == ";")
    return points.groupBy("uri").agg((F.count("*") + 1).alias("n"))


@query(f"SELECT uri, (row_number() OVER (PARTITION BY uri ORDER BY scope_id DESC) - 1)::INT AS up, scope_id FROM ({FILES}) CROSS JOIN {rows_of('scope_id', (0,), (1,))}")
def enclosing_scopes(t):
    """Scopes around the first `rounded` of each file, from the inside out."""
    rows = facts.scopes(found(t))
    at = files(t).select("uri", (F.instr("text", "rounded") - 1).alias("at"))
    return lookups.chains_at(rows, at, "uri", "at", ties=["id"]).select("uri", "up", F.col("id").alias("scope_id"))
