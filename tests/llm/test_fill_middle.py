"""Fill-in-middle against a plain one, by regular expressions, and exact round trips."""

import hashlib
import random
import re

import pytest

from factloom.llm import fill_middle

PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", "characters": r"(?s)."}
TEXTS = [None, "", "\n", "a", "\n\n\n", "one\ntwo\nthree", "one\ntwo\n", "has <P> inside\nx", "<S", "<M>", "a<", "<\n>\n", "é漢😀\nß\n\r\n x", " lead\n trail ", "P>\n<S\n>M<M\n", "x\n" * 5000, "<P\n" * 30, "word " * 4000]


def plain(doc_id, text, kind, rate, spm):
    text = text or ""
    units = re.findall(PATTERNS[kind], text)
    assert "".join(units) == text
    sha = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("kind", "rate", "spm"), [("lines", 100, 50), ("lines", 60, 0), ("words", 100, 50), ("characters", 90, 100)])
def test_forms(spark, kind, rate, spm):
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choices("ab<>PSM \t\n\né😀", k=rnd.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(None if i == 9 else i // 2 if i < 8 else i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, n string, row int").repartition(3)
    found = fill_middle.transformed(docs, kind=kind, rate=rate, spm=spm)
    rows = found.withColumn("back", fill_middle.restored(found.output, found.form)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.row.text, kind, rate, spm)
        assert r.back == (r.row.text or "") and r.row.n == "x" and r.row.row == 5
    assert fill_middle.digest(fill_middle.transformed(docs.limit(0))).count() == 0


def test_long_text_and_digest(spark):
    text = "line é\n" * 300_000
    row = fill_middle.digest(fill_middle.transformed(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    n, form, p, m, output = plain(1, text, "lines", 100, 50)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars) == (n, form, p, m)
    assert (row.output_sha256, row.restored_sha256) == (sha(output), sha(text))
