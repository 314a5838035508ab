"""Fact tables of a files(uri, text) DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from . import perl

FACTS = (
    "uri string, fact string, name string, other string, kind string, var_kind string, qualified_name string, container_name string, declaration string, "
    "symbols array<string>, scope_id int, parent int, sb int, sl int, sc int, eb int, el int, ec int"
)
#: What tokens and pragma states have besides.
MORE = "seq int, text string, strict_vars boolean, strict_subs boolean, strict_refs boolean, warnings boolean"
COLUMNS = [x.split()[0] for x in FACTS.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
ARROW = {x.split()[0]: _TYPES[x.split()[1]] for x in f"{FACTS}, {MORE}".split(", ")}
#: Bytes of text that a task reads.
TASK_BYTES = 4 << 20


def spread(files: DataFrame) -> DataFrame:
    """(uri, text), dealt by hash of the uri to tasks that read about TASK_BYTES each."""
    size = files.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    return files.select("uri", "text").repartition(tasks, "uri")


def parsed(files: DataFrame, tokens: bool = False, pragmas: bool = False) -> DataFrame:
    """All facts of all files in one pass, one row each; `fact` tells the table. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The rows of a table of facts have the same columns; the others are null.
            found: dict[str, dict[str, list]] = {}
            for uri, text in zip(batch.column("uri").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for row in perl.rows(uri, text or "", tokens, pragmas):
                    columns = found.get(row["fact"])
                    if columns is None:
                        columns = found[row["fact"]] = {name: [] for name in row}
                    for name, value in row.items():
                        columns[name].append(value)
            for columns in found.values():
                n = len(columns["uri"])
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in ARROW.items()], list(ARROW))

    return spread(files).mapInArrow(run, f"{FACTS}, {MORE}")


def stored(files: DataFrame, tokens: bool = False, pragmas: bool = False) -> DataFrame:
    """parsed(), written once, a folder for each table of facts; what reads a table reads no other, and parses nothing again."""
    return storage.staged(parsed(files, tokens, pragmas), "facts", "fact")


def extract_facts(files: DataFrame) -> DataFrame:
    return parsed(files).select(*COLUMNS)


def tokens(files: DataFrame) -> DataFrame:
    """(uri, seq, kind, text, sb, eb): tokens with UTF-8 offsets."""
    return tokens_of(parsed(files, tokens=True))


def tokens_of(facts: DataFrame) -> DataFrame:
    """The tokens among facts that were parsed with them."""
    return table(facts, "token", **{n: n for n in ("seq", "kind", "text", "sb", "eb")})


def pragmas(files: DataFrame) -> DataFrame:
    """(uri, sb, strict_vars, strict_subs, strict_refs, warnings): the state from each change on."""
    return pragmas_of(parsed(files, pragmas=True))


def pragmas_of(facts: DataFrame) -> DataFrame:
    return table(facts, "pragma", **{n: n for n in ("sb", "strict_vars", "strict_subs", "strict_refs", "warnings")})


def table(facts: DataFrame, fact: str, **columns: str) -> DataFrame:
    """One fact table; columns renames those of the facts' rows."""
    rows = facts.filter(F.col("fact") == fact)
    return rows.select("uri", *[F.col(c).alias(n) for n, c in columns.items()])


def symbols(facts: DataFrame) -> DataFrame:
    names = ["name", "kind", "var_kind", "qualified_name", "container_name", "declaration", "scope_id", "sb", "sl", "sc", "eb", "el", "ec"]
    return table(facts, "symbol", **{n: n for n in names})


def refs(facts: DataFrame) -> DataFrame:
    return table(facts, "ref", **{n: n for n in ("name", "kind", "sb", "sl", "sc", "eb", "el", "ec")})


def deps(facts: DataFrame) -> DataFrame:
    return table(facts, "dep", module="name")


def imports(facts: DataFrame) -> DataFrame:
    return table(facts, "import", module="name", symbols="symbols", line="sl")


def inherits(facts: DataFrame) -> DataFrame:
    return table(facts, "inherits", child="name", parent="other").distinct()


def calls(facts: DataFrame) -> DataFrame:
    return table(facts, "call", caller="name", callee="other", kind="kind", sb="sb", eb="eb")


def scopes(facts: DataFrame) -> DataFrame:
    return table(facts, "scope", id="scope_id", parent="parent", kind="kind", sb="sb", eb="eb")


def ingest(files: DataFrame, known_files: DataFrame, known_facts: DataFrame) -> DataFrame:
    """Facts after new versions of files: those with a known hash are not parsed again, others replace their file's facts."""
    hashed = files.withColumn("content_hash", F.xxhash64("text"))
    new = hashed.join(known_files.select("uri", "content_hash"), ["uri", "content_hash"], "left_anti")
    kept = known_facts.join(new.select("uri").distinct(), "uri", "left_anti")
    return kept.unionByName(extract_facts(new), allowMissingColumns=True)
