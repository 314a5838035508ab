"""Operators on hand-written fact rows: documented behaviours and invariants."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import dimensions, nested, text
from factloom.operators import aggregates, edits, joins, lookups, ranking, spans, windows


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()), key=repr)


def one(spark, expression, **row):
    types = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(expression.alias("x")).first()["x"]


def test_qualified_lookup_returns_bare_references_too(spark):
    refs = spark.createDataFrame([("a", "P::f", 1), ("b", "f", 2), ("a", "f", 1), ("c", "g", 3)], "uri string, name string, sl int")
    assert values(joins.references_of(refs, "P::f", ["uri", "sl"]), "uri", "sl") == [("a", 1), ("b", 2)]


def test_unused_joins_on_bare_names(spark):
    symbols = spark.createDataFrame([("f", "P::f"), ("g", "P::g")], "name string, qualified_name string")
    refs = spark.createDataFrame([("P::f", "Usage"), ("g", "Usage"), ("f", "Definition")], "name string, kind string")
    idle = joins.unused(symbols, refs.filter("kind != 'Definition'"), [("name", "name")])
    assert values(idle, "name") == ["f"]
    used = symbols.join(idle, "name", "left_anti")
    assert values(used.unionByName(idle), "name") == values(symbols, "name")


def test_keyed_references_leave_out_the_definition(spark):
    refs = spark.createDataFrame([("a", "f", 1), ("a", "main::f", 4), ("b", "P::f", 9)], "uri string, name string, sl int")
    symbols = spark.createDataFrame([("a", "f", "main::f", 1)], "uri string, name string, qualified_name string, sl int")
    assert values(joins.keyed_references(refs, symbols, "main", "f", None, ["uri", "sl"]), "uri", "sl") == [("a", 4)]


def test_scopes(spark):
    scopes = spark.createDataFrame([("u", 0, None, "Global"), ("u", 1, 0, "Package"), ("u", 2, 1, "Subroutine"), ("u", 3, 2, "Block"), ("u", 4, 3, "Block")], "uri string, id int, parent int, kind string")
    pairs = joins.scope_ancestors(scopes, 8)
    assert values(pairs.filter("id = 4"), "ancestor", "depth") == [(0, 4), (1, 3), (2, 2), (3, 1), (4, 0)]
    symbols = spark.createDataFrame([("u", "x", "S", 2, "my", 5), ("u", "x", "S", 4, "my", 9), ("u", "y", "S", 3, "our", 7)], "uri string, name string, kind string, scope_id int, declaration string, sb int")
    asked = spark.createDataFrame([("u", "x", "S", 4), ("u", "y", "S", 2), ("u", "y", "S", 1)], "uri string, name string, kind string, scope_id int")
    found = joins.resolve_in_scopes(asked, symbols, scopes, 8)
    assert values(found.filter("name = 'x'").orderBy("depth").limit(1), "symbol_sb") == [9]
    assert values(found.filter("name = 'y'"), "scope_id") == [2]
    issues = joins.redeclarations(spark.createDataFrame([("u", "$x", 2, 1), ("u", "$x", 2, 5), ("u", "$x", 4, 9)], "uri string, name string, scope_id int, sb int"), scopes, 8)
    assert values(issues, "issue", "sb") == [("redeclared", 5), ("shadows", 9)]
    uses = spark.createDataFrame([("u", 1)], "uri string, scope_id int")
    top = spark.createDataFrame([("u", 0, "g"), ("u", 3, "h")], "uri string, scope_id int, name string")
    assert values(joins.visible(top, uses, scopes, 8), "name") == ["g"]


def test_as_of_prefers_the_last_change(spark):
    points = spark.createDataFrame([("u", 5, "p"), ("u", 1, "q"), ("v", 9, "r")], "uri string, at int, id string")
    changes = spark.createDataFrame([("u", 2, True), ("u", 5, None), ("u", 6, True)], "uri string, at int, strict boolean")
    assert values(joins.as_of(points, changes, ["uri"], "at", ["strict"]), "id", "strict") == [("p", None), ("q", None), ("r", None)]


def test_percentiles_are_nearest_rank(spark):
    for n in (1, 7, 20, 100):
        samples = spark.range(1, n + 1).select(F.lit("op").alias("op"), F.col("id").alias("ms"))
        row = aggregates.slo_statistics(samples, "op", "ms", F.col("ms") > n, F.lit(50)).first()
        assert (row["p50"], row["p95"], row["p99"]) == (-(-n // 2), -(-95 * n // 100), -(-99 * n // 100))


def test_empty_tag_lists_return_all(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, [])], "id int, tags array<string>")
    assert values(lookups.with_any_tag(rows, []), "id") == values(lookups.with_all_tags(rows, []), "id") == [1, 2, 3]
    assert values(lookups.with_any_tag(rows, ["b"]), "id") == [2]
    assert values(lookups.with_all_tags(rows, ["a", "b"]), "id") == [2]


def test_completions_keep_the_smaller_key_and_the_earlier_row(spark):
    items = spark.createDataFrame([("x", "k", "2", 0), ("x", "k", "1", 1), ("x", "k", "1", 2), ("", "k", "0", 3), ("a", "k", None, 4)], "label string, kind string, sort_text string, idx int")
    assert [(r["label"], r["idx"]) for r in ranking.ordered_completions(items).collect()] == [("x", 1), ("a", 4)]
    assert values(ranking.ordered_completions(ranking.ordered_completions(items)), "label") == ["a", "x"]


def test_overlap_removal_is_a_fold(spark):
    tokens = spark.createDataFrame([("u", 1, 0, 4), ("u", 1, 2, 6), ("u", 1, 7, 2), ("u", 1, 8, 1), ("u", 2, 3, 1), ("u", 1, 20, 3), ("u", 1, 20, 3)], "uri string, line int, start int, length int")
    assert values(windows.remove_overlaps(tokens, ["uri"], "line", "start", "length"), "line", "start", "length") == [(1, 2, 6), (1, 20, 3), (1, 8, 1), (2, 3, 1)]


def test_touching_intervals_merge(spark):
    rows = spark.createDataFrame([("u", 1, 3), ("u", 3, 5), ("u", 2, 9), ("u", 10, 11), ("u", 1, 2)], "uri string, s int, e int")
    merged = windows.merge_intervals(rows, ["uri"], "s", "e")
    assert values(merged, "s", "e", "n_merged") == [(1, 9, 4), (10, 11, 1)]
    assert values(windows.merge_intervals(merged.drop("n_merged"), ["uri"], "s", "e"), "s", "e") == values(merged, "s", "e")


def test_delta_coding_inverts(spark):
    tokens = spark.createDataFrame([("u", 0, 4), ("u", 0, 9), ("u", 3, 1), ("u", 3, 8), ("v", 2, 2)], "uri string, line int, start int")
    encoded = windows.delta_encode(tokens, ["uri"], "line", "start").withColumn("i", F.col("line") * 100 + F.col("start"))
    assert values(encoded, "uri", "delta_line", "delta_start") == [("u", 0, 4), ("u", 0, 5), ("u", 0, 7), ("u", 3, 1), ("v", 2, 2)]
    decoded = windows.delta_decode(encoded.select("uri", "i", "delta_line", "delta_start"), ["uri"], ["i"])
    assert values(decoded, "uri", "line", "start") == values(tokens, "uri", "line", "start")


@pytest.mark.parametrize(("condition", "met"), [(None, [1, 2, 3, 4]), ("", [1, 2, 3, 4]), (">= 3", [3, 4]), ("<=2", [1, 2]), ("== 2", [2]), ("=2", [2]), ("> 3", [4]), ("<2", [1]), ("%2", [2, 4]), ("3", [3]), ("%0", []), ("x", [])])
def test_hit_conditions(spark, condition, met):
    rows = spark.range(1, 5).withColumn("c", F.lit(condition).cast("string"))
    assert values(rows.filter(windows.hit_condition(F.col("c"), F.col("id"))), "id") == met


def test_baseline_thresholds_are_strict(spark):
    old = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 100.0), ("d", 100.0), ("e", 1.0)], "name string, v double")
    new = spark.createDataFrame([("a", 120.0), ("b", 120.1), ("c", 90.0), ("d", 89.9), ("f", 5.0)], "name string, v double")
    assert values(joins.compare_to_baseline(old, new, ["name"], "v"), "name", "status") == [("a", "ok"), ("b", "regression"), ("c", "ok"), ("d", "faster"), ("e", "missing")]


def test_variance_needs_more_than_ten_points(spark):
    history = lambda n: spark.range(n).select(F.col("id").alias("ts"), (F.col("id") % 2).alias("n"))
    assert aggregates.recent_variance(history(10), "ts", "n").first()["variance"] == 0
    assert aggregates.recent_variance(history(11), "ts", "n").first()["variance"] == 0.25


def test_storms_have_hysteresis(spark):
    changes = spark.createDataFrame([("u", i, d) for i, d in enumerate([3, 3, -3, -2, 3, -4, 2])], "uri string, i int, delta int")
    rows = windows.storms(changes, ["uri"], "i", "delta", above=5).orderBy("i").collect()
    assert [(r["pending"], r["storm"]) for r in rows] == [(3, False), (6, True), (3, True), (1, True), (4, True), (0, False), (2, False)]


def test_ranges_and_joins(spark):
    a = spark.createDataFrame([("u", 0, 10), ("u", 20, 25)], "l string, s1 int, e1 int")
    b = spark.createDataFrame([("u", 5, 21), ("u", 10, 20), ("u", 24, 90)], "r string, s2 int, e2 int")
    assert values(joins.overlapping(a, b, ("s1", "e1"), ("s2", "e2"), [("l", "r")], 7), "s1", "s2") == [(0, 5), (20, 24), (20, 5)]
    p = spark.createDataFrame([("u", 10)], "k string, p int")
    assert values(joins.containing(p, b, "p", "s2", "e2", [("k", "r")], 7, inclusive_end=False), "s2") == [10, 5]
    row = spark.range(1).select(spans.intersection(*map(F.lit, (1, 3, 3, 9))).alias("i"), spans.union(*map(F.lit, (1, 3, 3, 9))).alias("u")).first()
    assert row["i"] is None and tuple(row["u"]) == (1, 9)


def test_import_audit(spark):
    imports = spark.createDataFrame([("u", "strict", [], 1), ("u", "List::Util", ["max", "min"], 2), ("u", "List::Util", ["sum"], 5), ("u", "JSON", [], 3)], "uri string, module string, symbols array<string>, line int")
    used = spark.createDataFrame([("u", "max"), ("u", "sum"), ("u", "Dumper")], "uri string, text string")
    out = joins.import_audit(imports, used, dimensions.dim_known_export(spark), dimensions.PRAGMAS)
    assert values(out["unused"], "module", "symbol") == [("JSON", None), ("List::Util", "min")]
    assert values(out["missing"], "module", "symbol") == [("Data::Dumper", "Dumper")]
    assert values(out["duplicate"], "module", "lines") == [("List::Util", [2, 5])]


def test_unreachable_line_is_the_first_only(spark):
    files = spark.createDataFrame([("u", "x\n return 1;\n\n  y\nz"), ("v", "ok\n")], "uri string, text string")
    assert values(windows.unreachable_lines(files), "uri", "line", "after") == [("u", 4, 2)]


def test_text_functions(spark):
    assert one(spark, text.utf16_width(F.col("s")), s="é😀") == 3
    assert tuple(one(spark, text.position_of(F.col("s"), F.lit(8)), s="a\né😀x")) == (1, 3)
    assert one(spark, text.module_of_path(F.col("s")), s="file:///w/lib/A/B.pm") == "A::B"
    assert one(spark, text.module_of_path(F.col("s")), s="/w/script.pl") == "script"
    assert one(spark, text.uri_key(F.col("s")), s="file:///C:/x") == "file:///c:/x"
    assert one(spark, text.uri_to_path(F.col("s")), s="file:///a%20b+c") == "/a b+c"
    assert one(spark, text.path_to_uri(F.col("s")), s="/a b/é") == "file:///a%20b/%C3%A9"
    assert one(spark, text.word_tokens(F.col("s")), s="parseHTTPRequest_v2::x") == ["parse", "http", "request", "v2", "x"]
    assert one(spark, text.names_of_list(F.col("s")), s="qw(A B::C)") == ["A", "B::C"]
    assert tuple(one(spark, text.substitution_parts(F.col("s")), s=r"s/a\/b/c/gi")) == (r"a\/b", "c", "gi")
    assert tuple(one(spark, text.substitution_parts(F.col("s")), s="s{a}{b}e")) == ("a", "b", "e")
    assert tuple(one(spark, text.regex_parts(F.col("s")), s="qr{a+}x")) == ("a+", "x")
    assert [round(x, 3) for x in one(spark, text.color_channels(F.col("s")), s="#f80")] == [1.0, 0.533, 0.0, 1.0]
    assert tuple(one(spark, text.hsl(F.lit(1.0), F.lit(0.0), F.lit(0.0)), s="")) == (0, 100, 50)
    assert one(spark, text.nested_quantifiers(F.col("s")), s="(a+)+") is True
    assert one(spark, text.runs_code(F.col("s")), s="a(?{ x })") is True
    assert one(spark, text.error_category(F.lit("bad delimiter"), F.col("s")), s="x") == "QuoteLike"
    assert one(spark, text.error_category(F.lit("bad"), F.col("s")), s="class Foo") == "ModernFeature"
    assert one(spark, text.code_of_message(F.col("s")), s="Variable is never used") == "UnusedVariable"
    assert one(spark, text.in_string(F.col("s"), F.lit(4)), s="a 'b c'") is True
    assert one(spark, text.in_comment(F.col("s"), F.lit(5)), s="a # b\nc") is True
    assert one(spark, text.paths_match(F.col("s"), F.lit("b.pl")), s="/a/b.pl") is True
    assert one(spark, text.can_rename(F.col("s")), s="print") is False


def test_nested_values(spark):
    report = spark.createDataFrame([('{"p": {"a": {"mean": {"nanoseconds": 5}}, "b": {"mean_ns": 7}, "c": {}}}',)], "text string")
    assert values(nested.benchmark_rows(report), "category", "name", "mean_ns") == [("p", "a", 5.0), ("p", "b", 7.0)]
    frames = spark.createDataFrame([("$ = main::f(1) called from file 'a.pl' line 3\nnoise\n@ = g() called from b.pl line 9",)], "out string")
    assert values(nested.stack_frames(frames, [], "out"), "function", "path", "line") == [("g", "b.pl", 9), ("main::f", "a.pl", 3)]


def test_edits(spark):
    files = spark.createDataFrame([("a", "my $x = 1;\nfoo($x); xfoo(); Foo::foo();"), ("b", "nothing")], "uri string, text string")
    symbols = spark.createDataFrame([("foo", "main::foo")], "name string, qualified_name string")
    changes = edits.rename(files, symbols, "main::foo", "bar")
    assert values(edits.apply_edits(files, changes), "text") == ["my $x = 1;\nbar($x); xfoo(); Foo::foo();", "nothing"]
    inlined = edits.apply_edits(files, edits.inline_variable(files, "$x"))
    assert values(inlined, "text") == ["foo(1); xfoo(); Foo::foo();", "nothing"]
    with pytest.raises(ValueError, match="in use"):
        edits.rename(files, symbols, "x", "foo")
    assert one(spark, edits.extract_module(F.col("s"), 2, 3, "M")["kept"], s="a\nb\nc\nd") == "a\nuse M;\nd"
    moved = edits.move_symbol(files, spark.createDataFrame([("a", 0, 10)], "uri string, start int, end int"), "b")
    assert values(edits.apply_edits(files, moved), "text") == ["\nfoo($x); xfoo(); Foo::foo();", "nothing\nmy $x = 1;\n"]
    assert windows and one(spark, windows.map_position(F.col("p"), F.lit(3), F.lit(5), F.lit(9)), p=4) is None


def test_containment_ends_differ(spark):
    """Semantic lookups include a span's end, node lookups do not."""
    nodes = spark.createDataFrame([(0, 10, 1, "n")], "sb int, eb int, depth int, name string")
    assert lookups.narrowest_at(nodes, F.lit(10), "sb", "eb", ["sb"]).count() == 1
    assert lookups.narrowest_at(nodes, F.lit(10), "sb", "eb", ["sb"], inclusive_end=False).count() == 0
    assert lookups.deepest_at(nodes, 10).count() == 0 and lookups.deepest_at(nodes, 9).count() == 1


def test_selection_goes_outwards(spark):
    nodes = spark.createDataFrame([("f", 0, 100, 0), ("f", 10, 50, 1), ("f", 20, 30, 2), ("f", 60, 70, 1)], "uri string, sb int, eb int, depth int")
    assert [r["depth"] for r in lookups.selection_chain(nodes, 25).collect()] == [2, 1, 0]
    points = spark.createDataFrame([("f", 25), ("f", 65)], "uri string, at int")
    assert sorted((r["at"], r["up"], r["depth"]) for r in lookups.chains_at(nodes, points, "uri", "at").collect()) == [(25, 0, 2), (25, 1, 1), (25, 2, 0), (65, 0, 1), (65, 1, 0)]


def test_paths_match_by_either_end(spark):
    rows = [("/a/lib/X.pm", "lib/X.pm", True), ("X.pm", "/b/X.pm", True), ("/a/Y.pm", "X.pm", False)]
    found = spark.createDataFrame(rows, "a string, b string, want boolean").select(text.paths_match(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in found)


def test_a_redeclared_variable_keeps_its_first_row(spark):
    scopes = spark.createDataFrame([("u", 0, None)], "uri string, id int, parent int")
    variables = spark.createDataFrame([("u", "$x", 0, 1), ("u", "$x", 0, 5), ("u", "$x", 0, 9)], "uri string, name string, scope_id int, sb int")
    assert sorted((r["issue"], r["sb"]) for r in joins.redeclarations(variables, scopes).collect()) == [("redeclared", 5), ("redeclared", 9)]


def test_the_whole_source_decides_the_category(spark):
    rows = spark.createDataFrame([("unexpected token", "class X {}"), ("bad regex", "x"), ("odd", "qr/x/; class Y")], "m string, s string")
    assert [r[0] for r in rows.select(text.error_category(F.col("m"), F.col("s"))).collect()] == ["ModernFeature", "Regex", "ModernFeature"]


def test_scope_chains_have_no_depth_limit_and_cycles_are_errors(spark):
    chain = spark.createDataFrame([("u", i, i - 1 if i else None) for i in range(101)], "uri string, id int, parent int")
    assert joins.scope_ancestors(chain).count() == 101 * 102 // 2
    cycle = spark.createDataFrame([("u", 0, 1), ("u", 1, 0)], "uri string, id int, parent int")
    with pytest.raises(ValueError):
        joins.scope_ancestors(cycle).count()
