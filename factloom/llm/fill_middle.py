"""Fill-in-middle: texts cut into prefix, middle and suffix at borders of units, and put together again around sentinels.

One Aho-Corasick automaton finds in one pass over a text both the sentinels
and the ASCII characters at which units may end. What lies between two such
events is a gap, whose units are counted by arithmetic: of lines a gap ends
none, of characters it has as many as it is long. So ranks are looked up in
the events alone, and a text costs eight bytes for each event.

Units are lines (each with its newline, and what follows the last one),
characters (code points), or words (each with the ASCII white space after it;
white space that leads the text is a unit of its own).

Only positions come back from Python; texts are cut and joined by Spark. A
text that contains a sentinel stays plain, so the sentinels of an output are
those that were put there, and restored() gives back the exact text.

Defined results: a null or empty text has no units and stays plain, as the
empty text; a null id is hashed as the empty string; rows with equal ids are
cut by the same draws; repeated rows are kept; an empty table gives an empty
result; texts are processed whole. Columns other than the id and the text are
kept as they are in the struct row.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SPACES = " \t\n\v\f\r"
SENTINEL = 2
CUTS = "n long, cut boolean, first long, second long"


def automaton(kind: str) -> ahocorasick.Automaton:
    """Its events have value 1 (a unit may end after this character) or SENTINEL."""
    found = ahocorasick.Automaton()
    for character in {"lines": "\n", "words": SPACES, "characters": ""}[kind]:
        found.add_word(character, 1)
    for sentinel in SENTINELS:
        found.add_word(sentinel, SENTINEL)
    found.make_automaton()
    return found


class Units:
    """The events of one text, and the unit counts that they give."""

    def __init__(self, text: str, kind: str, events: ahocorasick.Automaton):
        self.kind, self.size, self.sentinel = kind, len(text), False
        self.ends = np.fromiter(self._ends(text, events), dtype=np.int64)
        if kind == "words" and len(self.ends):
            # Of a run of white space the last character ends the unit.
            self.ends = self.ends[np.append(np.diff(self.ends) > 1, True)]
        if kind == "characters":
            self.count = self.size
        else:
            tail = self.size > (self.ends[-1] if len(self.ends) else 0)
            self.count = len(self.ends) + int(tail)

    def _ends(self, text: str, events: ahocorasick.Automaton) -> Iterator[int]:
        for at, value in events.iter(text):
            if value == SENTINEL:
                self.sentinel = True
            else:
                yield at + 1

    def offset(self, units: int) -> int:
        """Characters of the first so many units."""
        if self.kind == "characters":
            return units
        if units == 0:
            return 0
        return int(self.ends[units - 1]) if units <= len(self.ends) else self.size


def cuts(kind: str):
    """A column function of (text, first draw, second draw): the number of units, whether the text can be cut, and where, in characters."""
    events = automaton(kind)

    @F.pandas_udf(CUTS)
    def of(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for whole, a, b in zip(text, one, two, strict=True):
            units = Units(whole, kind, events)
            low, high = sorted((int(a) % (units.count + 1), int(b) % (units.count + 1)))
            rows.append((units.count, bool(whole) and not units.sentinel, units.offset(low), units.offset(high)))
        return pd.DataFrame(rows, columns=["n", "cut", "first", "second"])

    return of


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32, by hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, kind: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(row, doc_id, n, form, prefix_chars, middle_chars, output) for each document.

    rate of a hundred documents are cut at random units, spm of a hundred of
    these put the suffix first; the rest are psm. The others are plain.
    """
    shared.bound_batches(docs.sparkSession, 500)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select("*", F.array(*draws(F.col("doc_id"), seed)).alias("_h"))
    rows = rows.select("*", cuts(kind)("_text", F.col("_h")[0], F.col("_h")[1]).alias("_cut"))
    plain = ~F.col("_cut.cut") | (F.col("_h")[2] % 100 >= rate)
    rows = rows.select("*", F.when(plain, "plain").when(F.col("_h")[3] % 100 < spm, "spm").otherwise("psm").alias("form"))
    first, second = F.col("_cut.first"), F.col("_cut.second")
    part = {
        "prefix": F.substring(F.col("_text"), F.lit(1), first.cast("int")),
        "middle": F.substring(F.col("_text"), (first + 1).cast("int"), (second - first).cast("int")),
        "suffix": F.substring(F.col("_text"), (second + 1).cast("int"), F.length("_text")),
    }
    p, s, m = (F.lit(x) for x in SENTINELS)
    output = (
        F.when(F.col("form") == "plain", F.col("_text"))
        .when(F.col("form") == "psm", F.concat(p, part["prefix"], s, part["suffix"], m, part["middle"]))
        .otherwise(F.concat(s, part["suffix"], p, part["prefix"], m, part["middle"]))
    )
    cut = F.col("form") != "plain"
    return rows.select("row", "doc_id", F.col("_cut.n").alias("n"), "form", F.when(cut, first).alias("prefix_chars"), F.when(cut, second - first).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form alone. Each sentinel is in an output of a cut text once."""
    after = {x: F.instr(output, x) for x in SENTINELS}
    p, s, m = (after[x] for x in SENTINELS)
    width = len(SENTINELS[0])

    def between(begin: Column, end: Column | None) -> Column:
        return F.substring(output, begin + width, (end - begin - width) if end is not None else F.length(output))

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(found: DataFrame) -> DataFrame:
    """transformed(), with hashes in the place of texts."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
