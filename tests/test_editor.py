"""Completions, monikers, policies, token classes and parsed values."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.extract import facts
from factloom.functions import values
from factloom.operators import editor

SOURCE = "package A;\nuse List::Util qw(max);\nsub test_one { ok(1); my $x = max(1, 2); }\nsub test_one { open(FH, $f) or die; } # $no\n"


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame([("a.t", SOURCE), ("b.pm", "use strict; use warnings;\npackage B; use parent 'A'; sub test_one {1} sub maxi {2}")], "uri string, text string")
    rows = facts.extract_facts(files).cache()
    return {"files": files, "symbols": facts.symbols(rows), "refs": facts.refs(rows), "deps": facts.deps(rows), "imports": facts.imports(rows), "inherits": facts.inherits(rows), "calls": facts.calls(rows), "tokens": facts.tokens(files)}


def test_completions(spark, tables):
    found = editor.completions(spark, tables["symbols"], tables["symbols"].filter("name = 'maxi'"), "ma")
    assert [(r["label"], r["sort_text"]) for r in found.collect()] == [("maxi", "1_maxi"), ("map", "2_map")]
    lines = spark.createDataFrame([("  use ",), ("$x->",), ("1;",)], "text string")
    assert sorted(r["suggestion"] for r in editor.inline_completions(lines).collect()) == ["new(", "strict;"]
    row = lines.limit(1).select(editor.indent_after(F.lit("  if {"), F.lit("\n")).alias("a"), editor.indent_after(F.lit("    x"), F.lit("}")).alias("b"), editor.active_parameter(F.lit("f(1); substr($s, g(1), ")).alias("c"), editor.active_parameter(F.lit("push(@a, 1, ")).alias("d")).first()
    assert (row["a"], row["b"], row["c"]) == (6, 0, None) and tuple(row["d"]) == ("push", 2)


def test_navigation(spark, tables):
    keys = spark.createDataFrame([("a.t", "max"), ("a.t", "test_one"), ("a.t", "other")], "uri string, name string")
    exports = spark.createDataFrame([("a.t", "test_one")], "uri string, name string")
    kinds = {r["name"]: (r["kind"], r["module"]) for r in editor.monikers(keys, exports, tables["imports"]).collect()}
    assert kinds == {"max": ("import", "List::Util"), "test_one": ("export", None), "other": ("local", None)}
    assert [r["uri"] for r in editor.implementations(tables["symbols"], tables["inherits"], "A", "test_one").collect()] == ["b.pm"]
    assert [r["name"] for r in editor.implementations(tables["symbols"], tables["inherits"], "A").collect()] == ["B"]
    assert editor.layered_definition(tables["symbols"], "c.pm", "B", "test_one").first()["uri"] == "b.pm"
    items = {r["uri"]: (r["tests"], r["assertions"]) for r in editor.test_items(tables["symbols"], tables["calls"]).collect()}
    assert items["a.t"] == (["test_one"], 1)
    assert sorted(tuple(r) for r in editor.inline_values(tables["files"], 3, 4).filter("uri = 'a.t'").collect()) == [("a.t", 3, "$x"), ("a.t", 4, "$f")]


def test_policies_and_tokens(tables):
    found = {(r["uri"], r["policy"]) for r in editor.violations(tables).collect()}
    assert found == {("a.t", "RequireUseStrict"), ("a.t", "RequireUseWarnings"), ("a.t", "ProhibitTwoArgOpen"), ("a.t", "RequireUniqueSubs")}
    classes = {(r["text"], r["class"]) for r in editor.token_classes(tables["tokens"], tables["symbols"]).collect()}
    assert {("test_one", "subroutine"), ("sub", "keyword"), ("$x", "variable"), ("# $no", "comment"), ("1", "number")} <= classes


def test_values(spark):
    text = "$x = [1, 'a\\'b', undef]; %h = { k => { n => 1.5 } }; $o = bless({}, 'P'); $bad = ["
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(values.dump_variables("t")).alias("v")).select("v.*").collect()
    assert [(r["name"], json.loads(r["value"])) for r in rows] == [("$x", [1, "a'b", None]), ("%h", {"k": {"n": 1.5}}), ("$o", {"class": "P", "value": {}})]
    with pytest.raises(ValueError, match="deep"):
        values.parse_dump("[" * 60)
    assert [values.simple_type(e) for e in ("1", "1.5", "'s'", "[1]", "{}", "sub { }", "A::B->new(1)", "@x", "f()", "")] == ["Scalar(Integer)", "Scalar(Float)", "Scalar(String)", "Reference(Array)", "Reference(Hash)", "Reference(Subroutine)", "Object(A::B)", "Array", "Any", "Void"]
    assert [values.offset_of("a\né😀x", 1, c) for c in range(6)] == [2, 4, 4, 8, 9, 9] and values.offset_of("a", 5, 0) == 1
    assert values.matching_delimiter("f(a[1]{2})", 1) == (1, 9) and values.matching_delimiter("f(a)", 3) == (1, 3) and values.matching_delimiter("(", 0) is None
