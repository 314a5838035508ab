"""Lints, trees of brackets, packages and declarations in force, and reports on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, nesting

# What is in force where


def variables_of(tokens: DataFrame, by: list[str], name: str) -> DataFrame:
    """Variables of each part of the code, each once and sorted, and how often any is named."""
    return tokens.groupBy(*by).agg(F.sort_array(F.collect_set(name)).alias("variables"), F.count("*").alias("n"))


def package_at(points: DataFrame, symbols: DataFrame, at: str) -> DataFrame:
    """points(uri, at, ...) with the package in force: that of the last declaration at or before them, or main."""
    declared = symbols.filter("kind = 'Package'").groupBy("uri", F.col("sb").alias(at)).agg(F.max("name").alias("package"))
    return joins.as_of(points, declared, ["uri"], at, ["package"]).withColumn("package", F.coalesce("package", F.lit("main")))


def symbol_keys(uses: DataFrame) -> DataFrame:
    """uses(text, package, ...) with the key of what they name: pkg, name, sigil and kind; qualified names carry their package."""
    sigil = F.nullif(F.regexp_extract("text", r"^([$@%])", 1), F.lit(""))
    qualified = F.col("text").rlike(r"^\w.*::")
    pkg = F.when(qualified, F.regexp_extract("text", r"^(.*)::", 1)).otherwise(F.col("package"))
    name = F.when(sigil.isNotNull(), F.expr("substring(text, 2)")).otherwise(F.regexp_replace("text", r"^.*::", ""))
    return uses.withColumns({"pkg": pkg, "name": name, "sigil": sigil, "key_kind": F.when(sigil.isNotNull(), "Var").otherwise("Sub")})


def declarations(uses: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """uses(uri, name, kind, scope_id, at) with where the name is declared: in the nearest scope, last before the use."""
    asked = uses.select("uri", "name", "kind", "scope_id").distinct()
    seen = joins.resolve_in_scopes(asked, symbols, scopes).select("uri", "name", "kind", "scope_id", "depth", "symbol_sb")
    hits = uses.join(seen, ["uri", "name", "kind", "scope_id"]).filter(F.col("symbol_sb") <= F.col("at"))
    best = F.row_number().over(Window.partitionBy("uri", "name", "kind", "scope_id", "at").orderBy("depth", F.desc("symbol_sb")))
    return hits.withColumn("_n", best).filter("_n = 1").drop("_n")


def qualified_symbols(references: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """references(uri, name, kind, scope_id) with the symbols they resolve to.

    The package part of a qualified name is looked up as a package symbol; the
    search begins in the scope of the same span, or in the first scope inside
    it. Names whose package is unknown, and bare ones, are searched for in
    their own scope.
    """
    at = references.withColumns({"_pkg": F.nullif(F.regexp_extract("name", r"^(.*)::", 1), F.lit("")), "_bare": F.regexp_replace("name", r"^.*::", "")})
    packages = symbols.filter("kind = 'Package'").select("uri", F.col("name").alias("_pkg"), "sb", "eb", F.col("scope_id").alias("_outer"))
    spans = scopes.filter("kind = 'Package'").select("uri", "sb", "eb", F.col("id").alias("_span"))
    inner = scopes.filter("parent is not null").groupBy("uri", F.col("parent").alias("_at")).agg(F.min("id").alias("_inner"))
    homes = packages.join(spans, ["uri", "sb", "eb"], "left").withColumn("_at", F.coalesce("_span", "_outer"))
    homes = homes.join(inner, ["uri", "_at"], "left").select("uri", "_pkg", F.coalesce(F.when(F.col("_span").isNotNull(), F.col("_inner")), "_at").alias("_home"))
    placed = at.join(homes, ["uri", "_pkg"], "left")
    known = F.col("_home").isNotNull()
    asked = placed.select("uri", F.col("name").alias("reference"), F.when(known | F.col("_pkg").isNotNull(), F.col("_bare")).otherwise(F.col("name")).alias("name"), "kind", F.coalesce("_home", "scope_id").alias("scope_id"))
    return joins.resolve_in_scopes(asked.distinct(), symbols, scopes)


def type_name(text: Column) -> Column:
    """The package that an expression speaks of: before an arrow, before the last ::, or a capitalised name; null for others."""
    before = F.nullif(F.regexp_extract(text, r"^([A-Za-z_][\w:]*)\s*->", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(text, r"^([A-Za-z_][\w:]*)::\w+$", 1), F.lit(""))
    return F.coalesce(before, outer, F.when(text.rlike(r"^[A-Z]\w*$"), text))


def type_definitions(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """uses(uri, text) with the packages of the same file that their types name."""
    packages = symbols.filter("kind in ('Package', 'Class')").select("uri", F.col("name").alias("type"), F.col("sb").alias("definition_sb"))
    return uses.withColumn("type", type_name(F.col("text"))).join(packages, ["uri", "type"])


def callables_at(points: DataFrame, symbols: DataFrame, at: str) -> DataFrame:
    """points(uri, at) with the narrowest routine around each."""
    routines = symbols.filter("kind in ('Subroutine', 'Method')").select("uri", "name", "sb", "eb")
    return nesting.innermost(points, routines, ["uri"], at, ties=["sb", "name"])


# Lints over tokens(uri, seq, kind, text, sb, eb)


def _in_file() -> Window:
    return Window.partitionBy("uri").orderBy("seq")


def issue(rows: DataFrame, code: str, start: Column, end: Column, severity: str, message: Column) -> DataFrame:
    return rows.select("uri", F.lit(code).alias("code"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(severity).alias("severity"), message.alias("message"))


def common_mistakes(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """Assignments that are a whole condition of if or while, and == or != beside undef or a variable that the file's outermost scope lacks."""
    code = tokens.filter("kind not in ('comment', 'pod')")
    step = F.when(F.col("text") == "(", 1).when(F.col("text") == ")", -1).otherwise(0)
    run = _in_file().rowsBetween(Window.unboundedPreceding, 0)
    deep = code.withColumns({"_depth": F.sum(step).over(run), "_before": F.lag("text").over(_in_file()), "_left": F.struct(F.lag("text").over(_in_file()).alias("text"), F.lag("kind").over(_in_file()).alias("kind")), "_right": F.struct(F.lead("text").over(_in_file()).alias("text"), F.lead("kind").over(_in_file()).alias("kind"))})
    opens = (F.col("text") == "(") & F.col("_before").isin("if", "while")
    # A condition is the last one begun, until the depth falls below its own.
    numbered = deep.withColumn("_opened", F.last(F.when(opens, F.struct("seq", "_depth")), ignorenulls=True).over(run))
    since = Window.partitionBy("uri", "_opened.seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn("_least", F.min("_depth").over(since))
    assigned = numbered.filter((F.col("text") == "=") & (F.col("_depth") == F.col("_opened._depth")) & (F.col("_least") >= F.col("_opened._depth")))
    compared = deep.filter(F.col("text").isin("==", "!="))
    outer = symbols.filter("kind = 'Variable' and scope_id = 0").select("uri", F.col("name").alias("_name"), F.lit(True).alias("_known")).distinct()
    sides = compared.select("uri", "seq", "text", "sb", "eb", F.explode(F.array("_left", "_right")).alias("_side"))
    sides = sides.withColumn("_name", F.col("_side.text")).join(outer, ["uri", "_name"], "left")
    maybe = (F.col("_side.text") == "undef") | ((F.col("_side.kind") == "variable") & F.startswith("_name", F.lit("$")) & F.col("_known").isNull())
    undefined = sides.filter(maybe).select("uri", "seq", "text", "sb", "eb").distinct()
    return issue(assigned, "assignment-in-condition", F.col("sb"), F.col("eb"), "Warning", F.lit("Assignment in condition - did you mean '=='?")).unionByName(
        issue(undefined, "numeric-undef", F.col("sb"), F.col("eb"), "Warning", F.concat(F.lit("Using '"), "text", F.lit("' with potentially undefined value")))
    )


def deprecated_syntax(tokens: DataFrame) -> DataFrame:
    """`defined` of a whole array or hash, and the variable $[."""
    code = tokens.filter("kind not in ('comment', 'pod')").withColumns({"_1": F.lead("text", 1).over(_in_file()), "_2": F.lead("text", 2).over(_in_file())})
    argument = F.when(F.col("_1") == "(", F.col("_2")).otherwise(F.col("_1"))
    whole = code.filter((F.col("text") == "defined") & argument.rlike(r"^[@%]\w"))
    base = code.filter(F.col("text") == "$[")
    return issue(whole, "deprecated-defined", F.col("sb"), F.col("eb"), "Warning", F.concat(F.lit("Use of 'defined "), argument, F.lit("' is deprecated"))).unionByName(
        issue(base, "deprecated-array-base", F.col("sb"), F.col("sb") + 2, "Warning", F.lit("Use of '$[' is deprecated and will be removed"))
    )


def undeclared(uses: DataFrame, symbols: DataFrame, scopes: DataFrame, pragmas: DataFrame, special: list[str]) -> DataFrame:
    """uses(uri, name, at) of variables that nothing visible declares before them, where strict subs is in force: that state, not strict vars, is what the check goes by."""
    spans = scopes.select("uri", F.col("id").alias("scope_id"), "sb", "eb")
    asked = uses.filter(~F.col("name").isin(special)).select("uri", "name", "at").distinct()
    placed = nesting.innermost(asked, spans, ["uri"], "at", ties=["scope_id"]).select("uri", "name", F.lit("Variable").alias("kind"), "scope_id", "at")
    known = declarations(placed, symbols, scopes).select("uri", "name", "at")
    state = pragmas.groupBy("uri", F.col("sb").alias("at")).agg(F.max("strict_subs").alias("strict_subs"))
    return joins.as_of(placed.join(known, ["uri", "name", "at"], "left_anti"), state, ["uri"], "at", ["strict_subs"]).filter("strict_subs")


def file_diagnostics(errors: DataFrame, *issues: DataFrame) -> DataFrame:
    """All that is to be shown: parse errors(uri, at, message), one character wide, and issues."""
    parsed = issue(errors, "parse-error", F.col("at"), F.col("at") + 1, "Error", F.col("message"))
    return reduce(lambda a, b: a.unionByName(b), issues, parsed)


def heredoc_spans(tokens: DataFrame) -> DataFrame:
    return tokens.filter("kind = 'heredoc'").select("uri", "sb", "eb")


def trivia(tokens: DataFrame) -> DataFrame:
    """(uri, sb, eb): what lies between tokens, and comments."""
    before = F.coalesce(F.lag("eb").over(_in_file()), F.lit(0))
    gaps = tokens.withColumn("_from", before).filter("_from < sb").select("uri", F.col("_from").alias("sb"), F.col("sb").alias("eb"))
    return gaps.unionByName(tokens.filter("kind in ('comment', 'pod')").select("uri", "sb", "eb"))


def before_data(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """(uri, text) of files(uri, text) before a data marker; markers in strings and comments are no tokens and do not count."""
    ends = tokens.filter("kind = 'marker'").groupBy("uri").agg(F.min("sb").alias("_end"))
    cut = F.decode(F.call_function("left", F.encode("text", "UTF-8"), F.col("_end")), "UTF-8")
    return files.join(ends, "uri", "left").select("uri", F.when(F.col("_end").isNull(), F.col("text")).otherwise(cut).alias("text"))


# Trees of brackets

OPENING, CLOSING = ("(", "[", "{"), (")", "]", "}")


def _depths(tokens: DataFrame) -> DataFrame:
    """Brackets with their depth and whether they are surplus: closing ones that nothing has opened, which do not count for what follows."""
    marks = tokens.filter(F.col("text").isin(*OPENING, *CLOSING) & (F.col("kind") == "operator"))
    opening = F.col("text").isin(*OPENING)
    run = _in_file().rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("opening", opening).withColumn("_sum", F.sum(F.when(opening, 1).otherwise(-1)).over(run))
    least = F.least(F.lit(0), F.min("_sum").over(run))
    counted = counted.withColumn("_least", least).withColumn("surplus", ~F.col("opening") & (F.col("_least") < F.coalesce(F.lag("_least").over(_in_file()), F.lit(0))))
    # A closing bracket has the depth of the opening one that it closes.
    return counted.withColumn("depth", F.col("_sum") - F.col("_least") + F.when(opening, 0).otherwise(1)).drop("_sum", "_least")


def _turns(marks: DataFrame) -> DataFrame:
    """Brackets that are not surplus with _k: at each depth of a file openings and closings take turns, so the k-th of one belongs to the k-th of the other."""
    number = F.row_number().over(Window.partitionBy("uri", "depth", "opening").orderBy("seq"))
    return marks.filter("not surplus").withColumn("_k", number)


def _closes(opening: Column, closing: Column) -> Column:
    return reduce(lambda out, pair: out | ((opening == pair[0]) & (closing == pair[1])), zip(OPENING, CLOSING, strict=True), F.lit(False))


def bracket_nodes(tokens: DataFrame) -> DataFrame:
    """(uri, node, parent, kind, depth, sb, eb): a node for each pair of brackets, numbered by its opening token, and its parent or null.

    kind is the opening bracket, or `error` where another kind closes it. At
    each depth of a file openings and closings take turns, so the bracket after
    an opening one closes it: pairs are one window, and parents one as-of join.
    No join chooses its method by the size of tokens, which is not known before.
    """
    following = lambda name: F.lead(name).over(Window.partitionBy("uri", "depth").orderBy("seq"))
    marks = _depths(tokens).filter("not surplus").select("uri", "depth", "seq", "text", "opening", "sb", following("eb").alias("eb"), following("text").alias("_close"))
    kind = F.when(_closes(F.col("text"), F.col("_close")), F.col("text")).otherwise("error").alias("kind")
    pairs = marks.filter("opening and _close is not null").select("uri", "depth", F.col("seq").alias("node"), kind, "sb", "eb")
    above = pairs.select("uri", (F.col("depth") + 1).alias("depth"), "node", F.col("node").alias("parent"))
    return joins.as_of(pairs, above, ["uri", "depth"], "node", ["parent"]).select("uri", "node", "parent", "kind", "depth", "sb", "eb")


def bracket_errors(tokens: DataFrame) -> DataFrame:
    """(uri, at, message): brackets that nothing opens or closes, or that another kind closes."""
    marks = _depths(tokens)
    side = lambda name: F.max(F.when(F.col("opening") == (name == "open"), F.struct("text", "sb"))).alias(name)
    both = _turns(marks).groupBy("uri", "depth", "_k").agg(side("open"), side("close"))
    wrong = both.filter(F.col("open").isNull() | F.col("close").isNull() | ~_closes(F.col("open.text"), F.col("close.text")))
    error = lambda df, word, text, at: df.select("uri", at.alias("at"), F.concat(F.lit(f"{word} "), text).alias("message"))
    surplus = error(marks.filter("surplus"), "Unexpected", F.col("text"), F.col("sb"))
    found = [error(wrong.filter(f"{s} is not null"), w, F.col(f"{s}.text"), F.col(f"{s}.sb")) for s, w in (("open", "Unclosed"), ("close", "Unexpected"))]
    return surplus.unionByName(found[0]).unionByName(found[1])


def child_counts(nodes: DataFrame) -> DataFrame:
    """(uri, node, children) for nodes with children."""
    return nodes.filter("parent is not null").groupBy("uri", F.col("parent").alias("node")).agg(F.count("*").alias("children"))


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("uri").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


def tree_text(nodes: DataFrame, kind: Column) -> DataFrame:
    """(uri, tree): each file's nodes as nested parentheses, in order; as long as the file has nodes."""
    begin = F.struct(F.col("sb").alias("_at"), F.concat(F.lit("("), kind).alias("_text"))
    end = F.struct((F.col("eb") - 1).alias("_at"), F.lit(")").alias("_text"))
    # Both rows of a node at once: a union would make the nodes twice.
    marks = nodes.select("uri", F.explode(F.array(begin, end)).alias("_mark"))
    return marks.groupBy("uri").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_mark")), lambda x: x["_text"]), "").alias("tree"))


def parse_outcomes(files: DataFrame, most_characters: int = 1_000_000) -> DataFrame:
    """(uri, outcome): whether facts can be had of a file: ok, error or too_large."""
    from ..extract import perl

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                try:
                    out.append("too_large" if len(text or "") > most_characters else "ok" if perl.extract(text or "") is not None else "error")
                except (ValueError, IndexError, RecursionError):
                    out.append("error")
            yield pd.DataFrame({"uri": batch["uri"], "outcome": out})

    return files.select("uri", "text").mapInPandas(run, "uri string, outcome string")


# Catalogues and reports


def feature_coverage(files: DataFrame, features: dict[str, list[str]]) -> DataFrame:
    """(feature, n_files, first_uri, percent) of a configured list of features and the texts that show each; those without files too."""
    tests = F.filter(F.array(*[F.when(reduce(lambda a, b: a | b, (F.contains("text", F.lit(p)) for p in patterns)), F.lit(name)) for name, patterns in features.items()]), lambda x: x.isNotNull())
    seen = files.select("uri", F.explode(tests).alias("feature")).groupBy("feature").agg(F.count("*").alias("n_files"), F.min("uri").alias("first_uri"))
    known = files.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    found = known.join(seen, "feature", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    # One file is enough: a feature is covered whole or not at all.
    return found.withColumn("percent", F.when(F.col("n_files") > 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def catalogue_problems(features: DataFrame, tests: DataFrame, maturities: list[str]) -> DataFrame:
    """(id, problem) of features(id, maturity, advertised, tests): repeated ids, unknown maturity, advertised ones without tests or with tests that are not there."""
    twice = features.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    odd = features.filter(~F.col("maturity").isin(maturities)).select("id", F.concat(F.lit("unknown maturity "), "maturity").alias("problem"))
    shown = features.filter("advertised")
    untested = shown.filter(F.size("tests") == 0).select("id", F.lit("no tests").alias("problem"))
    named = shown.select("id", F.explode("tests").alias("test"))
    gone = named.join(tests.select("test").distinct(), "test", "left_anti").select("id", F.concat(F.lit("missing test "), "test").alias("problem"))
    return reduce(lambda a, b: a.unionByName(b), (odd, untested, gone), twice)


def recorded_for_all(samples: DataFrame, types: list[str], column: str) -> DataFrame:
    """A sample without a type counts for every type of a fixed list."""
    return samples.withColumn(column, F.explode(F.when(F.col(column).isNull(), F.array(*map(F.lit, types))).otherwise(F.array(column))))


def all_references(indexed: DataFrame, in_text: DataFrame, order: list[str], most: int = 500) -> DataFrame:
    """References of the index, then matches in text, repeats included, and only the first `most` of them all."""
    every = indexed.withColumn("_source", F.lit(0)).unionByName(in_text.withColumn("_source", F.lit(1)))
    return every.orderBy("_source", *order).limit(most).drop("_source")


def all_met(statistics: DataFrame, met: str = "met") -> DataFrame:
    return statistics.agg(F.coalesce(F.bool_and(met), F.lit(True)).alias("all_met"))


def any_rows(rows: DataFrame) -> DataFrame:
    return rows.limit(1).agg((F.count("*") > 0).alias("any"))


def total_bytes(caches: DataFrame, column: str) -> DataFrame:
    return caches.agg(F.coalesce(F.sum(column), F.lit(0)).alias("bytes"))


def share(part: Column, whole: Column) -> Column:
    """part of whole in percent; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)) * 100)


def speedup(ours: Column, theirs: Column) -> Column:
    return theirs / ours


def slower(rows: DataFrame, ours: str, theirs: str, least: float = 0.9) -> DataFrame:
    """Rows whose speed-up over another implementation is below the least."""
    return rows.withColumn("speedup", speedup(F.col(ours), F.col(theirs))).filter(F.col("speedup") < least)


def comparison_summary(rows: DataFrame, ours: str, theirs: str, passed: str) -> DataFrame:
    """One row over a comparison: rows, passes, their share, mean of each side and the difference in percent."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("passed"), F.avg(ours).alias("ours"), F.avg(theirs).alias("theirs"))
    return out.withColumns({"passed_share": share(F.col("passed"), F.col("n")), "difference": (F.col("ours") - F.col("theirs")) / F.col("theirs") * 100})


def coverage_notes(lines: DataFrame) -> DataFrame:
    """lines(covered, hits, ...) that tests do not cover, or that never run, with a message and its severity."""
    message = F.when(~F.col("covered"), "Not covered by tests").when(F.col("hits") == 0, "Never executed")
    return lines.withColumns({"message": message, "severity": F.when(~F.col("covered"), "Warning").otherwise("Info")}).filter("message is not null")


def coverage_met(total: Column, threshold: Column) -> Column:
    return total >= threshold


def progress(steps: DataFrame, by: str, at: str, indexed: str, total: str, most_ms: int) -> DataFrame:
    """steps with percent done and whether a scan has run longer than it may since its first step."""
    begun = F.min(at).over(Window.partitionBy(by))
    return steps.withColumns({"percent": share(F.col(indexed), F.col(total)), "timed_out": F.col(at) - begun > most_ms})


# Places and values


def skip_sigil(start: Column, name: Column) -> Column:
    """Where a variable's name begins without its sigil."""
    return start + F.length(F.regexp_extract(name, r"^([$@%&]?)", 1))


def breakpoint_allowed(line: Column) -> Column:
    """Whether a line has code to stop at: not blank, not a comment, not only brackets or a heading of pod."""
    return ~F.trim(line).rlike(r"^(#.*|=\w.*|[\{\}\(\)\[\];]*)$")


def estimated_size(*columns: Column) -> Column:
    """Bytes of columns as JSON."""
    return F.octet_length(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])))


def rendered(value: Column, most: int = 40) -> Column:
    """A value as it is shown: cut after some characters."""
    return F.when(F.length(value) > most, F.concat(F.call_function("left", value, F.lit(most)), F.lit("..."))).otherwise(value)


def capabilities(flags: dict[str, Column]) -> Column:
    """JSON of the features that are on."""
    return F.to_json(F.map_filter(F.create_map(*[x for n, c in flags.items() for x in (F.lit(n), c)]), lambda k, v: v))


# Notebooks, renames, jobs


def spliced(cells: Column, start: Column, deleted: Column, added: Column) -> Column:
    """A list of cells after some from a place on are replaced by others; places beyond the end are the end."""
    at = F.least(start, F.size(cells))
    return F.concat(F.slice(cells, F.lit(1), at), added, F.slice(cells, at + F.least(deleted, F.size(cells) - at) + 1, F.size(cells)))


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """notebooks(uri, version, cells) as one row per cell."""
    return notebooks.select("uri", "version", F.posexplode("cells").alias("place", "cell"))


def moved_files(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """rows with the uris of renamed files replaced; renames(uri, new_uri) has a row per file."""
    columns = rows.columns
    return rows.join(renames, "uri", "left").withColumn("uri", F.coalesce("new_uri", "uri")).select(*columns)


def cleared(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def by_state(state: str, full: Callable[[], DataFrame], partial: Callable[[], DataFrame]) -> DataFrame:
    """What a complete index answers, or while it is not ready what can be said without it."""
    return full() if state in ("Ready", "Updating") else partial()


def processed(files: DataFrame, f: Callable[[str, str], str], tasks: int) -> DataFrame:
    """(uri, result) of a function of uri and text, over so many tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"uri": batch["uri"], "result": [f(u, t) for u, t in zip(batch["uri"], batch["text"], strict=True)]})

    return files.select("uri", "text").repartition(tasks).mapInPandas(run, "uri string, result string")


def cancellable(rows: DataFrame, tag: str, action: Callable[[DataFrame], object]) -> object:
    """Runs an action under a tag; spark.interruptTag(tag) in another thread ends it."""
    spark = rows.sparkSession
    spark.addTag(tag)
    try:
        return action(rows)
    finally:
        spark.removeTag(tag)
