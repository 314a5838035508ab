"""Values of other texts: debugger dumps, simple types, positions back to offsets, matching delimiters."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DEPTH = 50
SCALAR = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(undef)|(\w+))")


def parse_dump(text: str, at: int = 0, depth: int = 0) -> tuple[object, int]:
    """A dumped value and where it ends: arrays, hashes, blessed objects, references, scalars."""
    if depth > MOST_DEPTH:
        raise ValueError("too deep")
    while at < len(text) and text[at].isspace():
        at += 1
    if text.startswith("bless(", at):
        value, at = parse_dump(text, at + 6, depth + 1)
        m = re.compile(r"\s*,\s*'([^']*)'\s*\)").match(text, at)
        if not m:
            raise ValueError("bless without a class")
        return {"class": m[1], "value": value}, m.end()
    if at < len(text) and text[at] == "\\":
        value, at = parse_dump(text, at + 1, depth + 1)
        return {"reference": value}, at
    if at < len(text) and text[at] in "[{":
        closing, keyed = ("]", False) if text[at] == "[" else ("}", True)
        items: list = []
        at += 1
        while True:
            m = re.compile(r"[\s,]*").match(text, at)
            at = m.end()
            if at >= len(text):
                raise ValueError("value breaks off")
            if text[at] == closing:
                return (dict(items) if keyed else items), at + 1
            value, at = parse_dump(text, at, depth + 1)
            if keyed:
                m = re.compile(r"\s*=>").match(text, at)
                if not m:
                    raise ValueError("key without a value")
                item, at = parse_dump(text, m.end(), depth + 1)
                items.append((str(value), item))
            else:
                items.append(value)
    m = SCALAR.match(text, at)
    if not m:
        raise ValueError(f"no value at {at}")
    if m[3] is not None:
        return (float(m[3]) if re.search(r"[.eE]", m[3]) else int(m[3])), m.end()
    if m[4]:
        return None, m.end()
    quoted = m[1] if m[1] is not None else m[2]
    return (re.sub(r"\\(.)", r"\1", quoted) if quoted is not None else m[5]), m.end()


def parse_assignments(text: str) -> list[tuple[str, str]]:
    """(name, JSON) of `$name = value` assignments in a dump; what cannot be read is left out."""
    out = []
    for m in re.finditer(r"([$@%]\w+)\s*=\s*", text):
        try:
            out.append((m[1], json.dumps(parse_dump(text, m.end())[0], ensure_ascii=False)))
        except ValueError:
            continue
    return out


def dump_variables(dumps: str) -> Column:
    """Assignments of a column of dumps as an array of {name, value}, values as JSON."""

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n, "value": v} for n, v in parse_assignments(t or "")] for t in column])

    return F.pandas_udf(run, "array<struct<name: string, value: string>>")(dumps)


def simple_type(expression: str | None) -> str:
    """The type that the form of an expression tells: a documented part of inference."""
    e = (expression or "").strip()
    if re.fullmatch(r"-?\d[\d_]*", e):
        return "Scalar(Integer)"
    if re.fullmatch(r"-?\d[\d_]*\.\d+(?:[eE][+-]?\d+)?", e):
        return "Scalar(Float)"
    if re.fullmatch(r"'[^']*'|\"[^\"]*\"", e):
        return "Scalar(String)"
    if e.startswith("["):
        return "Reference(Array)"
    if e.startswith("{"):
        return "Reference(Hash)"
    if re.match(r"sub\b", e):
        return "Reference(Subroutine)"
    if m := re.fullmatch(r"([A-Z]\w*(?:::\w+)*)->new\b.*", e, re.DOTALL):
        return f"Object({m[1]})"
    return {"(": "Array", "@": "Array", "%": "Hash", "\\": "Reference(Any)"}.get(e[:1], "Void" if not e or e == "undef" else "Any")


def inferred_type(expressions: str) -> Column:
    def run(column: pd.Series) -> pd.Series:
        return column.map(simple_type)

    return F.pandas_udf(run, "string")(expressions)


def offset_of(text: str, line: int, column: int) -> int:
    """UTF-8 byte offset of a zero-based line and UTF-16 column; beyond a line is its end, beyond the text the text's."""
    lines = text.split("\n")
    if line >= len(lines):
        return len(text.encode())
    before = sum(len(x.encode()) + 1 for x in lines[:line])
    taken = units = 0
    for c in lines[line]:
        width = 2 if ord(c) > 0xFFFF else 1
        if units + width > column:
            break
        units += width
        taken += len(c.encode())
    return before + taken


def byte_offset(text: str, line: str, column: str) -> Column:
    def run(texts: pd.Series, lines: pd.Series, columns: pd.Series) -> pd.Series:
        return pd.Series([offset_of(t or "", int(a), int(b)) for t, a, b in zip(texts, lines, columns, strict=True)])

    return F.pandas_udf(run, "long")(text, line, column)


PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def matching_delimiter(text: str, at: int) -> tuple[int, int] | None:
    """Places of the delimiter at a place and of its match, or None."""
    c = text[at : at + 1]
    if c in PAIRS and c:
        opening, closing, step = c, PAIRS[c], 1
    elif c and c in PAIRS.values():
        opening, closing, step = c, next(k for k, v in PAIRS.items() if v == c), -1
    else:
        return None
    depth, i = 0, at
    while 0 <= i < len(text):
        depth += (text[i] == opening) - (text[i] == closing)
        if depth == 0:
            return (at, i) if step > 0 else (i, at)
        i += step
    return None


def matching_pair(text: str, at: Column) -> Column:
    """{opening, closing}: places of the delimiter at a place and of its match, or null."""

    def run(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        found = [matching_delimiter(t or "", int(i)) for t, i in zip(texts, places, strict=True)]
        return pd.DataFrame({"opening": pd.array([f and f[0] for f in found], "Int32"), "closing": pd.array([f and f[1] for f in found], "Int32")})

    return F.pandas_udf(run, "opening int, closing int")(text, at)


def shown_type(value: Column) -> Column:
    """The type that a debugger shows for a value in JSON: its class, Array, Hash, Reference or Scalar."""
    of = F.get_json_object(value, "$.class")
    return (
        F.when(F.startswith(value, F.lit("[")), "Array").when(of.isNotNull(), of).when(F.startswith(value, F.lit('{"reference"')), "Reference")
        .when(F.startswith(value, F.lit("{")), "Hash").otherwise("Scalar")
    )
