"""Edits as rows: producing them, and applying them to texts."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from . import joins

EDITS = "uri string, start int, end int, new_text string"


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files(uri, text) after edits(uri, start, end, new_text), from the last to the first.

    Offsets count characters. A file's edits are a list bounded by the file;
    overlapping edits of a file raise an error.
    """
    lists = edits.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("start", "end", "new_text"))).alias("_edits"))

    @F.pandas_udf("string")
    def run(text: pd.Series, changes: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(text, changes, strict=True):
            parts, at = [], 0
            for r in rows if rows is not None else ():
                if r["start"] < at:
                    raise ValueError("edits overlap")
                parts += [t[at : r["start"]], r["new_text"]]
                at = r["end"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    joined = files.join(lists, "uri", "left")
    return joined.withColumn("text", F.when(F.col("_edits").isNull(), F.col("text")).otherwise(run("text", "_edits"))).drop("_edits")


def word_edits(files: DataFrame, old: str, new: str) -> DataFrame:
    """An edit for every whole-word occurrence of a name; sigils stay. Files without the name are not searched by pattern."""
    pattern = rf"(?<![\w:]){re.escape(old)}(?!\w)" if re.match(r"\w", old) else rf"{re.escape(old)}(?!\w)"
    hits = files.filter(F.contains("text", F.lit(old)))

    def run(batches):
        for batch in batches:
            rows = [(u, m.start(), m.end(), new) for u, t in zip(batch["uri"], batch["text"], strict=True) for m in re.finditer(pattern, t)]
            yield pd.DataFrame(rows, columns=["uri", "start", "end", "new_text"])

    return hits.select("uri", "text").mapInPandas(run, EDITS)


def rename(files: DataFrame, symbols: DataFrame, old: str, new: str) -> DataFrame:
    """Edits that rename a symbol in all files; qualified names rename their last part. A name in use raises an error."""
    if not re.fullmatch(r"[$@%]?[A-Za-z_]\w*", new):
        raise ValueError(f"not a name: {new}")
    bare_old, bare_new = old.rsplit("::", 1)[-1], new
    if symbols.filter((F.col("name") == bare_new) | F.endswith(F.col("qualified_name"), F.lit(f"::{bare_new}"))).limit(1).count():
        raise ValueError(f"{new} is in use")
    return word_edits(files, bare_old, bare_new)


def extract_module(file: Column, start_line: int, end_line: int, module: str) -> Column:
    """{kept, moved}: a file without the lines (from 1), which become a module of their own, and that module."""
    lines = F.split(file, "\n")
    moved = F.array_join(F.slice(lines, start_line, end_line - start_line + 1), "\n")
    kept = F.concat(F.slice(lines, 1, start_line - 1), F.array(F.lit(f"use {module};")), F.slice(lines, F.lit(end_line + 1), F.greatest(F.lit(0), F.size(lines) - end_line)))
    return F.struct(F.array_join(kept, "\n").alias("kept"), F.concat(F.lit(f"package {module};\n\n"), moved, F.lit("\n\n1;\n")).alias("moved"))


def move_symbol(files: DataFrame, symbol: DataFrame, target_uri: str) -> DataFrame:
    """Two edits: the symbol's text (uri, start, end; one row) is cut from its file and appended to another."""
    source = files.join(symbol, "uri").select("uri", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("body"))
    target = files.filter(F.col("uri") == target_uri).select(F.col("uri").alias("_target"), F.length("text").alias("_n"))
    cut = source.select("uri", "start", "end", F.lit("").alias("new_text"))
    added = source.join(F.broadcast(target.limit(1))).select(F.col("_target").alias("uri"), F.col("_n").alias("start"), F.col("_n").alias("end"), F.concat(F.lit("\n"), "body", F.lit("\n")).alias("new_text"))
    return cut.unionByName(added)


def inline_variable(files: DataFrame, name: str) -> DataFrame:
    """Edits that replace a scalar by the simple value it is declared with, and take its declaration away."""
    sigil = re.escape(name)
    declaration = rf"(?m)^[^\S\n]*my\s+{sigil}\s*=\s*([^;\n]+);[^\S\n]*\n?"

    def run(batches):
        for batch in batches:
            rows = []
            for u, t in zip(batch["uri"], batch["text"], strict=True):
                if m := re.search(declaration, t):
                    rows.append((u, m.start(), m.end(), ""))
                    rows += [(u, x.start(), x.end(), m[1]) for x in re.finditer(rf"{sigil}(?!\w)", t) if not m.start() <= x.start() < m.end()]
            yield pd.DataFrame(rows, columns=["uri", "start", "end", "new_text"])

    return files.filter(F.contains("text", F.lit(name))).select("uri", "text").mapInPandas(run, EDITS)


#: Old constructs: a pattern, what to write instead, and whether a person must look at it.
MODERN = [
    (r"\bopen\s+[A-Z]+\b", "open my $fh", False),
    (r"\bopen\s*\(\s*[A-Z]+\s*,\s*('[^']*')\s*\)", "open(my $fh, '<', $1)", False),
    (r"\bdefined\s*(?:\(\s*(@\w+)\s*\)|(@\w+))", "$1$2", False),
    (r"\bnew\s+([A-Z]\w*)\(", "$1->new(", False),
    (r"\beach\s+@(\w+)", "0..$#$1", False),
    (r"\beval\s+\"", "eval {", True),
    (r"\bprint\s+\"([^\"\\]*)\\n\"", 'say "$1"', False),
]


def modernisations(files: DataFrame) -> DataFrame:
    """(uri, line, start, old, new, manual): every old construct of each file, lines and characters from 0."""
    each = [text.line_spans(files, ["uri"], "text", p).select("uri", "line", "start", F.col("match").alias("old"), F.regexp_replace("match", p, _java(new)).alias("new"), F.lit(m).alias("manual")) for p, new, m in MODERN]
    return reduce(lambda a, b: a.unionByName(b), each)


def modernised(source: Column) -> Column:
    """A text with the old constructs replaced that need nobody's look."""
    return reduce(lambda out, rule: out if rule[2] else F.regexp_replace(out, rule[0], _java(rule[1])), MODERN, source)


def _java(new: str) -> str:
    """A replacement in which only $1 and $2 stand for groups."""
    return re.sub(r"\$(?![12])", r"\\$", new)


def fixes_for(diagnostics: DataFrame, ranges: DataFrame, width: int = 256) -> DataFrame:
    """Diagnostics(uri, sb, eb, ...) that overlap requested ranges(uri, start, end): range joins over cells of width."""
    asked = ranges.withColumnRenamed("uri", "_uri")
    return joins.overlapping(diagnostics, asked, ("sb", "eb"), ("start", "end"), [("uri", "_uri")], width).drop("_uri")


def code_lenses(symbols: DataFrame, counts: DataFrame) -> DataFrame:
    """Lenses with the number of references of subs and packages, and one to run a test."""
    shown = symbols.filter(F.col("kind").isin("Subroutine", "Package"))
    title = F.concat(F.coalesce("usages", F.lit(0)).cast("string"), F.when(F.coalesce("usages", F.lit(0)) == 1, F.lit(" reference")).otherwise(F.lit(" references")))
    lenses = shown.join(counts, "name", "left").select("uri", "name", "sl", title.alias("title"))
    tests = shown.filter(F.col("name").rlike(r"^test_|_test$|^t_")).select("uri", "name", "sl", F.lit("Run test").alias("title"))
    return lenses.unionByName(tests)


def parameter_hints(calls: DataFrame, builtins: DataFrame) -> DataFrame:
    """calls(uri, name, args) with the parameter name of each argument."""
    args = calls.select("uri", "name", F.posexplode("args").alias("place", "argument"))
    return args.join(builtins, "name").withColumn("parameter", F.get("parameters", F.col("place"))).filter("parameter is not null").drop("parameters")


def edits_of_changes(changes: DataFrame) -> DataFrame:
    """changes(text, sl, sc, el, ec, new_text) of a document as byte edits: start, old_end and new_end; columns count UTF-16 units."""
    placed = changes.withColumns({"start": values.byte_offset("text", "sl", "sc"), "old_end": values.byte_offset("text", "el", "ec")})
    return placed.withColumn("new_end", F.col("start") + F.octet_length("new_text"))
