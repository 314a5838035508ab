"""What an editor asks of the fact tables: completions, hints, monikers, tests, policies, token classes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dimensions
from . import ranking

# Completions


def symbol_completions(symbols: DataFrame, prefix: str) -> DataFrame:
    """Workspace symbols that begin with a prefix, after all other sources in order."""
    found = symbols.filter(F.startswith("name", F.lit(prefix)))
    return found.select(F.col("name").alias("label"), "kind", F.concat(F.lit("3_"), "name").alias("sort_text"))


def completions(spark: SparkSession, symbols: DataFrame, locals_: DataFrame, prefix: str) -> DataFrame:
    """Candidates of all sources with a prefix: local variables, then builtins, then the workspace; one per label."""
    near = locals_.filter(F.startswith("name", F.lit(prefix))).select(F.col("name").alias("label"), "kind", F.concat(F.lit("1_"), "name").alias("sort_text"))
    builtin = dimensions.dim_builtin(spark).filter(F.startswith("name", F.lit(prefix))).select(F.col("name").alias("label"), F.lit("Function").alias("kind"), F.concat(F.lit("2_"), "name").alias("sort_text"))
    every = near.unionByName(builtin).unionByName(symbol_completions(symbols, prefix))
    return ranking.ordered_completions(every.withColumn("idx", F.monotonically_increasing_id()))


# What a line's beginning suggests to write next.
LINE_RULES = [(r"^\s*use\s*$", "strict;"), (r"^\s*package\s*$", "main;"), (r"^\s*sub\s+\w+\s*$", "{\n    my ($self) = @_;\n}"), (r"^\s*for(each)?\s*$", "my $item (@items) {"), (r"->$", "new("), (r"^#!\s*$", "/usr/bin/env perl")]


def inline_completions(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines with the text that rules suggest after them; lines without a suggestion go."""
    suggestion = reduce(lambda out, rule: F.when(F.col(text).rlike(rule[0]), rule[1]).otherwise(out), reversed(LINE_RULES), F.lit(None).cast("string"))
    return lines.withColumn("suggestion", suggestion).filter("suggestion is not null")


def indent_after(line: Column, typed: Column, width: int = 4) -> Column:
    """Spaces to begin the next line with: one level more after an opening brace, one less before a typed closing one."""
    own = F.length(F.regexp_extract(line, r"^( *)", 1))
    return F.greatest(F.lit(0), own + F.when(F.trim(line).rlike(r"[\{\(\[]$"), width).otherwise(0) - F.when(typed == "}", width).otherwise(0))


def active_parameter(before: Column) -> Column:
    """{function, parameter}: the call that the end of a text stands in, and how many arguments are before."""
    call = F.regexp_extract(before, r"([A-Za-z_][\w:]*)\s*\(([^()]*)$", 1)
    arguments = F.regexp_extract(before, r"([A-Za-z_][\w:]*)\s*\(([^()]*)$", 2)
    return F.when(call != "", F.struct(call.alias("function"), (F.length(arguments) - F.length(F.replace(arguments, F.lit(","), F.lit("")))).alias("parameter")))


# Navigation and classification


def monikers(keys: DataFrame, exports: DataFrame, imports: DataFrame) -> DataFrame:
    """keys(uri, name) as export, import (with the module it comes from) or local."""
    given = exports.select("uri", "name", F.lit(True).alias("_exported")).distinct()
    taken = imports.select("uri", F.explode("symbols").alias("name"), "module").groupBy("uri", "name").agg(F.min("module").alias("module"))
    joined = keys.join(given, ["uri", "name"], "left").join(taken, ["uri", "name"], "left")
    kind = F.when(F.col("_exported"), "export").when(F.col("module").isNotNull(), "import").otherwise("local")
    return joined.withColumn("kind", kind).drop("_exported")


def implementations(symbols: DataFrame, inherits: DataFrame, base: str, method: str | None = None) -> DataFrame:
    """Packages that inherit from a base, or a method's namesakes in them."""
    children = inherits.filter(F.col("parent") == base).select(F.col("child").alias("container_name")).distinct()
    if method is None:
        return symbols.join(children.withColumnRenamed("container_name", "name"), "name", "left_semi").filter(F.col("kind").isin("Package", "Class"))
    return symbols.filter(F.col("name") == method).join(children, "container_name", "left_semi")


def layered_definition(symbols: DataFrame, uri: str, package: str, name: str) -> DataFrame:
    """The definition that the nearest source gives: the same file, the same package, any bare name."""
    layer = F.when((F.col("uri") == uri) & (F.col("name") == name), 0).when(F.col("qualified_name") == f"{package}::{name}", 1).when(F.col("name") == name, 2)
    return symbols.withColumn("layer", layer).filter("layer is not null").orderBy("layer", "uri", "sb").limit(1)


def test_items(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(uri, tests): test files and their tests, which are subs named like tests, and the calls of test functions by number."""
    named = symbols.filter((F.col("kind") == "Subroutine") & F.col("name").rlike(r"^test_|_test$|^t_")).groupBy("uri").agg(F.sort_array(F.collect_set("name")).alias("tests"))
    asserted = calls.filter(F.col("callee").isin("ok", "is", "isnt", "like", "unlike", "is_deeply", "cmp_ok", "pass", "fail", "subtest", "can_ok", "isa_ok")).groupBy("uri").agg(F.count("*").alias("assertions"))
    return named.join(asserted, "uri", "full_outer")


def inline_values(files: DataFrame, start_line: int, end_line: int) -> DataFrame:
    """(uri, line, name): variables on a range of lines (from 1), each once a line."""
    lines = files.select("uri", F.posexplode(F.split("text", "\n")).alias("_i", "_line")).withColumn("line", F.col("_i") + 1).filter(F.col("line").between(start_line, end_line))
    code = F.regexp_replace("_line", r"#.*$", "")
    return lines.select("uri", "line", F.explode(F.array_distinct(F.regexp_extract_all(code, F.lit(r"([$@%][A-Za-z_]\w*)"), 1))).alias("name"))


# Token kinds of the tokeniser and the classes they are shown in.
TOKEN_CLASSES = {"comment": "comment", "pod": "comment", "string": "string", "q": "string", "qq": "string", "qw": "string", "heredoc": "string", "number": "number", "variable": "variable", "pattern": "regexp", "qr": "regexp", "m": "regexp", "s": "regexp", "operator": "operator", "word": "keyword"}


def token_classes(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tokens of one line each with a class; words that are symbols of their file get the symbol's class instead."""
    own = symbols.filter("kind in ('Subroutine', 'Method', 'Package', 'Class')").select("uri", F.col("name").alias("text"), F.lower("kind").alias("_kind")).distinct()
    base = reduce(lambda out, pair: F.when(F.col("kind") == pair[0], pair[1]).otherwise(out), TOKEN_CLASSES.items(), F.lit(None).cast("string"))
    joined = tokens.filter(~F.contains("text", F.lit("\n"))).join(own, ["uri", "text"], "left")
    return joined.withColumn("class", F.when(F.col("kind") == "word", F.coalesce("_kind", F.lit("keyword"))).otherwise(base)).drop("_kind").filter("class is not null")


# Policies

#: A policy takes files, symbols, refs and deps and returns (uri, policy, line, message).
Policy = Callable[[dict[str, DataFrame]], DataFrame]
POLICIES: dict[str, Policy] = {}


def policy(name: str) -> Callable[[Policy], Policy]:
    def register(f: Policy) -> Policy:
        POLICIES[name] = f
        return f

    return register


def _violations(rows: DataFrame, name: str, line: Column, message: str) -> DataFrame:
    return rows.select("uri", F.lit(name).alias("policy"), line.cast("int").alias("line"), F.lit(message).alias("message"))


@policy("RequireUseStrict")
def _strict(facts: dict[str, DataFrame]) -> DataFrame:
    using = facts["deps"].filter("module = 'strict'").select("uri")
    return _violations(facts["files"].join(using, "uri", "left_anti"), "RequireUseStrict", F.lit(0), "no use strict")


@policy("RequireUseWarnings")
def _warnings(facts: dict[str, DataFrame]) -> DataFrame:
    using = facts["deps"].filter("module = 'warnings'").select("uri")
    return _violations(facts["files"].join(using, "uri", "left_anti"), "RequireUseWarnings", F.lit(0), "no use warnings")


@policy("ProhibitTwoArgOpen")
def _two_arg_open(facts: dict[str, DataFrame]) -> DataFrame:
    lines = facts["files"].select("uri", F.posexplode(F.split("text", "\n")).alias("line", "_line"))
    return _violations(lines.filter(F.col("_line").rlike(r"\bopen\s*\(?\s*[$\w]+(?:\s+\$?\w+)?\s*,\s*[^,()]+\)?\s*(?:or|;|\|\|)")), "ProhibitTwoArgOpen", F.col("line"), "open with two arguments")


@policy("RequireUniqueSubs")
def _unique_subs(facts: dict[str, DataFrame]) -> DataFrame:
    twice = facts["refs"].filter("kind = 'Definition' and not startswith(name, '$') and not startswith(name, '@') and not startswith(name, '%')").groupBy("uri", "name").agg(F.count("*").alias("n"), F.max("sl").alias("line")).filter("n > 1")
    return _violations(twice, "RequireUniqueSubs", F.col("line"), "sub is defined twice")


def violations(facts: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """The union of what the policies find; new ones register themselves with @policy."""
    return reduce(lambda a, b: a.unionByName(b), (POLICIES[n](facts) for n in names or sorted(POLICIES)))
