"""Sequences of edits as piece tables.

The text after some edits is a list of pieces: parts of the text before, and
of what the edits insert. Each edit is such a list for itself, of three pieces
at most. Two lists that follow each other compose to one: the kept pieces of
the later are cut where pieces of the earlier begin, by one sort of all
borders. So edits whose offsets refer to the text after earlier edits compose
in pairs, in as many rounds as the logarithm of their number, and no task goes
through the edits of a document one after the other. Texts are put together
once, at the end.

Offsets count characters. Defined results: edits of a document apply in the
order of seq, which must not repeat; a null text inserts nothing; an edit that
does not lie in the text that it applies to raises an error; documents without
edits stay as they are, a null text is empty; rows with a null doc are left
out, and so are edits of unknown documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from . import order


def of_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc, batch, last, place, length, edit, origin) for docs(doc, text) and edits(doc, seq, start, end, text): the pieces of each edit.

    batch numbers the edits of a document from 0, and last is its last batch. A
    piece lies at place of the text after; edit is null for a part of the text
    before, else the seq of what inserted it, and origin is where it begins there.
    """
    sizes = docs.filter(F.col("doc").isNotNull()).select("doc", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_size"))
    known = edits.select("doc", "seq", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_new")).join(sizes, "doc")
    rows = order.in_order(known, F.col("doc").asc(), F.col("seq").asc(), label="edits")
    rows = rows.withColumns({"_one": F.lit(1).cast("long"), "_grown": F.col("_new") - F.col("end") + F.col("start")})
    rows = order.sums_before(order.sums_before(rows, ["doc"], "_one", "batch"), ["doc"], "_grown", "_shift")
    rows = rows.join(rows.groupBy("doc").agg((F.count("*") - 1).alias("last")), "doc").withColumn("_size", F.col("_size") + F.col("_shift"))
    rows = storage.staged(rows, "edit-sizes")
    wrong = ~((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("_size")))
    bad = rows.filter(F.coalesce(wrong, F.lit(True))).select("doc", "seq").first()
    if bad is not None:
        raise ValueError(f"edit {bad['seq']} of document {bad['doc']} is outside its text")
    none = F.lit(None).cast(edits.schema["seq"].dataType)
    piece = lambda place, length, edit, origin: F.struct(place.alias("place"), length.alias("length"), edit.alias("edit"), origin.alias("origin"))
    start, end, new, zero = F.col("start"), F.col("end"), F.col("_new"), F.lit(0).cast("long")
    three = F.array(piece(zero, start, none, zero), piece(start, new, F.col("seq"), zero), piece(start + new, F.col("_size") - end, none, end))
    return rows.select("doc", "batch", "last", F.explode(three).alias("p")).select("doc", "batch", "last", "p.*").filter("length > 0")


def composed(pieces: DataFrame) -> DataFrame:
    """of_edits() with all batches of each document composed to one, (doc, place, length, edit, origin): edit is null for parts of the first text."""
    now = storage.staged(pieces, "pieces")
    while not now.filter("last > 0").isEmpty():
        now = storage.settled(lambda now=now: _halved(now), "pieces")
    return now.select("doc", "place", "length", "edit", "origin")


def _halved(now: DataFrame) -> DataFrame:
    """Each two batches composed to one."""
    alone = (F.col("batch") % 2 == 0) & (F.col("batch") == F.col("last"))
    kind = now.schema["edit"].dataType
    first = F.struct("place", "edit", "origin")
    first_of = now.select(first).schema[0].dataType
    later = F.col("batch") % 2 == 1
    rows = now.withColumns({"pair": F.floor(F.col("batch") / 2), "_last": F.floor(F.col("last") / 2)})
    both = rows.filter(~alone)
    kept = both.filter(later & F.col("edit").isNull())
    # What begins where, in the text between the two batches; a kept piece also ends.
    no_first, no_then = F.lit(None).cast(first_of), F.lit(None).cast("struct<place:bigint,origin:bigint,open:boolean>")
    then = lambda open_: F.struct("place", "origin", F.lit(open_).alias("open"))
    event = lambda df, at, rank, a, b: df.select("doc", "pair", "_last", at.alias("_pos"), F.lit(rank).alias("_rank"), a.alias("_first"), b.alias("_then"))
    events = event(both.filter(~later), F.col("place"), 1, first, no_then)
    events = events.unionByName(event(kept, F.col("origin"), 2, no_first, then(True))).unionByName(event(kept, F.col("origin") + F.col("length"), 0, no_first, then(False)))
    group = ["doc", "pair"]
    rows_in = order.in_order(events, *[F.col(c).asc() for c in (*group, "_pos", "_rank")], label="borders")
    seen = order.next_value(order.lasts_before(rows_in, group, {"_a": "_first", "_b": "_then"}), group, "_pos", "_next")
    a, b = F.coalesce("_first", "_a"), F.coalesce("_then", "_b")
    parts = seen.withColumns({"_a": a, "_b": b}).filter(F.col("_b.open") & (F.col("_next") > F.col("_pos")))
    cut = parts.select(
        "doc", F.col("pair").alias("batch"), F.col("_last").alias("last"), (F.col("_b.place") + F.col("_pos") - F.col("_b.origin")).alias("place"), (F.col("_next") - F.col("_pos")).alias("length"),
        F.col("_a.edit").cast(kind).alias("edit"), (F.col("_a.origin") + F.col("_pos") - F.col("_a.place")).alias("origin"),
    )
    rest = rows.filter(alone | (later & F.col("edit").isNotNull())).select("doc", F.col("pair").alias("batch"), F.col("_last").alias("last"), "place", "length", "edit", "origin")
    return cut.unionByName(rest)


def applied(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs(doc, text, ...) with the texts after all their edits(doc, seq, start, end, text)."""
    pieces = composed(of_edits(docs, edits))
    inserted = edits.select("doc", F.col("seq").alias("edit"), F.col("text").alias("_text"))
    parts = pieces.join(inserted, ["doc", "edit"], "left").withColumn("_text", F.substring("_text", (F.col("origin") + 1).cast("int"), F.col("length").cast("int")))
    listed = parts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("place", "edit", "origin", "length", "_text"))).alias("_parts"))
    edited = edits.select("doc").distinct().withColumn("_edited", F.lit(True))
    whole = docs.join(listed, "doc", "left").join(edited, "doc", "left")
    text = F.coalesce("text", F.lit(""))
    joined = F.array_join(F.transform("_parts", lambda p: F.when(p["edit"].isNull(), F.substring(text, (p["origin"] + 1).cast("int"), p["length"].cast("int"))).otherwise(p["_text"])), "")
    return whole.withColumn("text", F.when(F.col("_edited").isNull(), text).otherwise(F.coalesce(joined, F.lit("")))).select(*docs.columns)


def mapped(points: DataFrame, pieces: DataFrame, at: str) -> DataFrame:
    """points(doc, at, ...) of first texts with where they are after the edits, `place`, and whether their character is still there, `kept`.

    A removed character's place is the end of the last kept one before it. pieces are those of composed(), of documents that have edits.
    """
    row, kept = F.struct(*[F.col(f"`{c}`") for c in points.columns]), pieces.filter("edit is null")
    span = F.struct("origin", "length", "place")
    events = points.select("doc", F.col(at).cast("long").alias("_pos"), F.lit(1).alias("_rank"), row.alias("_point"), F.lit(None).cast(kept.select(span).schema[0].dataType).alias("_span"))
    events = events.unionByName(kept.select("doc", F.col("origin").alias("_pos"), F.lit(0).alias("_rank"), F.lit(None).cast(events.schema["_point"].dataType).alias("_point"), span.alias("_span")))
    seen = order.last_before(order.in_order(events, *[F.col(c).asc() for c in ("doc", "_pos", "_rank")], label="mapped"), ["doc"], "_span", "_last").filter(F.col("_point").isNotNull())
    inside = F.coalesce(F.col("_pos") < F.col("_last.origin") + F.col("_last.length"), F.lit(False))
    place = F.coalesce(F.col("_last.place") + F.least(F.col("_pos") - F.col("_last.origin"), F.col("_last.length")), F.lit(0))
    return seen.select("_point.*", place.alias("place"), inside.alias("kept"))
