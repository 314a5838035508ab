"""Sequences of edits against one edit after the other."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import pieces

EDITS = "doc string, seq int, start int, end int, text string"


def made(rnd, doc, text, count):
    """Random edits of one document, its text after them, and where its characters went."""
    edits, now = [], list(enumerate(text))
    for seq in range(count):
        a = rnd.randint(0, len(now))
        b = min(len(now), a + rnd.choice([0, 0, 1, 3, 20]))
        new = "".join(rnd.choices("xyzé😀\n", k=rnd.choice([0, 1, 2, 6]))) or rnd.choice(["", None])
        edits.append((doc, seq * 3 - 5, a, b, new))
        now[a:b] = [(None, c) for c in new or ""]
    return edits, "".join(c for _, c in now), {i: place for place, (i, _) in enumerate(now) if i is not None}


def test_sequences(spark):
    rnd = random.Random(8)
    docs = [(f"d{i}", "".join(rnd.choices("abcdé ", k=rnd.choice([0, 5, 60]))), i) for i in range(9)] + [("none", None, 1), ("still", "still", 2), ("gone", "gone", 3), (None, "x", 4)]
    edits, wanted, places = [("gone", 1, 0, 4, None), ("unknown", 1, 9, 3, "x")], {"none": "", "still": "still", "gone": ""}, {}
    for i, (doc, text, _) in enumerate(docs[:9]):
        made_, wanted[doc], places[doc] = made(rnd, doc, text, [1, 2, 3, 7, 16, 33, 5, 1, 12][i])
        edits += made_
    rnd.shuffle(edits)
    d, e = spark.createDataFrame(docs, "doc string, text string, n int").repartition(2), spark.createDataFrame(edits, EDITS).repartition(3)
    out = pieces.applied(d, e).collect()
    assert {r.doc: r.text for r in out if r.doc} == wanted and {r.n for r in out if r.doc} <= set(range(9)) | {1, 2, 3}
    asked = spark.createDataFrame([(doc, i) for doc, text, _ in docs[:9] for i in range(len(text))], "doc string, i int")
    for r in pieces.mapped(asked, pieces.composed(pieces.of_edits(d, e)), "i").collect():
        known = places[r.doc]
        before = [known[j] for j in range(r.i) if j in known]
        assert (r.place, r.kept) == ((known[r.i], True) if r.i in known else (before[-1] + 1 if before else 0, False))


def test_ten_thousand_edits_of_one_document(spark):
    rnd = random.Random(9)
    text = "line of text\n" * 1_000
    edits, wanted, _ = made(rnd, "d", text, 10_000)
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    assert pieces.applied(docs, spark.createDataFrame(edits, EDITS)).first().text == wanted


def test_edits_outside(spark):
    docs = spark.createDataFrame([("d", "abc")], "doc string, text string")
    for edit in (("d", 1, 2, 9, ""), ("d", 1, 2, 1, ""), ("d", 1, None, 1, "")):
        with pytest.raises(ValueError, match="outside"):
            pieces.applied(docs, spark.createDataFrame([edit], EDITS))
    assert pieces.applied(docs, spark.createDataFrame([], EDITS)).first().text == "abc"
    assert pieces.applied(docs.limit(0), spark.createDataFrame([("d", 1, 0, 0, "x")], EDITS)).select(F.count("*")).first()[0] == 0
