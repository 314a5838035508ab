"""Extraction on small code fixtures."""

import random

from factloom.extract import facts, perl
from factloom.operators import joins

SOURCE = """package Shop::Cart;
use strict;
use parent qw(Base::Cart);
use List::Util qw(sum max);
our $VERSION = '1.0';   # not $this
my ($total, @items) = (0);
sub add {
    my $self = shift;
    $total += price($self);
    $total++;
    for my $i (@items) { Other::log($i) }
    foreach $x (@items) { $obj->ship("q{ $no }"); Shop::Order->new($x) }
    return $total / 2; # a division
}
sub add { 1 }
my $re = qr/a\\/b{2}/x;
my $doc = <<"END";
sub hidden { $fake }
END
no warnings;
class Point :isa(Shape) { method draw { 1 } }
=pod

sub in_pod { }

=cut
sub last_one { split /,/, $_[0] }
__END__
sub after { }
"""


def test_symbols_and_references():
    found = perl.extract(SOURCE)
    names = {(s["name"], s["kind"]) for s in found.symbols}
    assert {("Shop::Cart", "Package"), ("add", "Subroutine"), ("$total", "Variable"), ("@items", "Variable"), ("Point", "Class"), ("draw", "Method"), ("last_one", "Subroutine")} <= names
    assert not {n for n, _ in names} & {"hidden", "in_pod", "after", "$fake"}
    refs = [(r["name"], r["kind"]) for r in found.refs]
    assert [k for n, k in refs if n == "$total"] == ["Definition", "Read", "Write", "Read", "Write", "Read"]
    assert ("price", "Usage") in refs and ("Shop::Cart::price", "Usage") in refs
    assert ("log", "Usage") in refs and ("Other::log", "Usage") in refs
    assert ("ship", "Usage") in refs and ("Shop::Order::new", "Usage") in refs and ("new", "Usage") not in refs
    assert [k for n, k in refs if n == "$x"][:2] == ["Write", "Read"]
    assert found.deps == {"strict", "parent", "List::Util", "warnings"}
    assert {(e["child"], e["parent"]) for e in found.inherits} == {("Shop::Cart", "Base::Cart"), ("Point", "Shape")}
    # A sub that is declared again moves its symbol; both are definitions.
    assert sum(s["name"] == "add" for s in found.symbols) == 1 and sum(r == ("add", "Definition") for r in refs) == 2
    assert {"caller": "Shop::Cart::add", "callee": "price", "kind": "function"}.items() <= next(c for c in found.calls if c["callee"] == "price").items()


def test_slashes_and_quotes():
    kinds = [(t.kind, t.text) for t in perl.tokenize("$a / 2; m{x{1}}i; s/a/b/; f(/x/); y => 1; $h{q}; tr(a)(b); print $x if /z/;")]
    assert ("operator", "/") in kinds and ("m", "m{x{1}}i") in kinds and ("s", "s/a/b/") in kinds and ("pattern", "/x/") in kinds
    assert ("word", "y") in kinds and ("tr", "tr(a)(b)") in kinds and ("pattern", "/z/") in kinds
    assert [t.kind for t in perl.tokenize("my $s = 'open")][-1] == "unparsed"


def test_tokens_cover_random_text():
    rnd = random.Random(1)
    parts = ["sub ", "{", "}", "'", '"', "q(", ")", "$x", "/", "<<E\n", "E\n", "=pod\n", "=cut\n", "é", "😀", "\n", ";", "my ", "foreach ", "->", "use ", "package "]
    for _ in range(300):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 40)))
        tokens = perl.tokenize(text)
        assert all(a.end <= b.start for a, b in zip(tokens, tokens[1:], strict=False)) and all(t.text == text[t.start : t.end] for t in tokens)
        perl.extract(text)
        list(perl.rows("u", text))


def test_tables(spark):
    files = spark.createDataFrame([("a.pm", SOURCE), ("b.pl", "use Shop::Cart;\nmy $é = 1; add($é);"), ("c.pl", None)], "uri string, text string")
    rows = facts.extract_facts(files).cache()
    assert {r["uri"] for r in facts.deps(rows).filter("module = 'Shop::Cart'").collect()} == {"b.pl"}
    assert facts.inherits(rows).count() == 2 and facts.imports(rows).count() == 4
    place = facts.symbols(rows).filter("uri = 'b.pl'").first()
    assert (place["sl"], place["sc"], place["ec"], place["eb"] - place["sb"]) == (1, 3, 5, 3)
    idle = joins.unused(facts.symbols(rows), facts.refs(rows).filter("kind != 'Definition'"), [("name", "name")])
    assert "last_one" in {r["name"] for r in idle.collect()} and "add" not in {r["name"] for r in idle.collect()}
    assert facts.tokens(files).filter("kind = 'heredoc'").count() == 1
    states = facts.pragmas(files).filter("uri = 'a.pm'").orderBy("sb").collect()
    assert [(r["strict_vars"], r["warnings"]) for r in states] == [(True, False), (True, False)]
    known = files.selectExpr("uri", "xxhash64(text) as content_hash")
    changed = spark.createDataFrame([("a.pm", SOURCE), ("b.pl", "sub only {}")], "uri string, text string")
    merged = facts.ingest(changed, known, rows)
    assert {r["name"] for r in facts.symbols(merged).filter("uri = 'b.pl'").collect()} == {"only"}
    assert facts.symbols(merged).filter("uri = 'a.pm'").count() == facts.symbols(rows).filter("uri = 'a.pm'").count()
