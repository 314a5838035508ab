"""File trees, corpus texts, framed messages and JSON reports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(uri, text, content_hash) of source files below a folder, skipping what tools keep there."""
    rows = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))
    return rows.filter(t.is_source_file(F.col("uri")) & ~t.is_skipped_folder(F.col("uri"))).withColumn("content_hash", F.xxhash64("text"))


def file_sizes(spark: SparkSession, layers: dict[str, str]) -> DataFrame:
    """(layer, path, bytes, lines) of the files of several folders."""
    out = None
    for layer, root in layers.items():
        rows = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
        rows = sizes_of(rows.select(F.lit(layer).alias("layer"), F.col("_metadata.file_path").alias("path"), "value"), ["layer", "path"])
        out = rows if out is None else out.unionByName(rows)
    return out


def sizes_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, bytes, lines) of the texts in the column value."""
    return rows.select(*key, F.octet_length("value").alias("bytes"), (t.newlines(F.col("value")) + 1).alias("lines"))


def paths_of(listings: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, path) of listings whose paths are separated by NUL, as version control prints them; what tools keep is left out."""
    rows = listings.select(*key, F.explode(F.split(column, "\\x00")).alias("path"))
    return rows.filter(t.is_source_file(F.col("path")) & ~t.is_skipped_folder(F.col("path")))


FEATURES = "file string, id string, area string, maturity string, advertised boolean, tests array<string>"


def features_of(files: DataFrame) -> DataFrame:
    """Features of TOML catalogues(file, text)."""
    import tomllib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, x.get("id"), x.get("area"), x.get("maturity"), x.get("advertised", False), x.get("tests", [])) for f, text in zip(batch["file"], batch["text"], strict=True) for x in tomllib.loads(text).get("feature", [])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return files.select("file", "text").mapInPandas(run, FEATURES)


SECTIONS = "file string, id string, title string, tags array<string>, flags array<string>, perl string, body string, line int"
FENCE = re.compile(r"^=+[ \t]*$", re.MULTILINE)
FIELD = re.compile(r"^#\s*@(id|tags|flags|perl):\s*(.*)$", re.MULTILINE)


def parse_sections(file: str, text: str) -> Iterator[tuple]:
    """Sections of a corpus text: a title between two lines of =, @-fields in comments, a body."""
    marks = [(m.start(), m.end()) for m in FENCE.finditer(text)]
    pairs, i = [], 0
    while i + 1 < len(marks):
        title = text[marks[i][1] : marks[i + 1][0]].strip()
        if title and "\n" not in title:
            pairs.append((marks[i][0], marks[i + 1][1], title))
            i += 2
        else:
            i += 1
    for n, (start, end, title) in enumerate(pairs):
        body = text[end : pairs[n + 1][0] if n + 1 < len(pairs) else len(text)]
        fields = dict(FIELD.findall(body))
        words = lambda k: re.split(r"[\s,]+", fields[k].strip()) if fields.get(k, "").strip() else []
        slug = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")
        yield file, fields.get("id") or f"{file.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.{slug}.{n + 1:03d}", title, words("tags"), words("flags"), fields.get("perl"), FIELD.sub("", body).strip(), text.count("\n", 0, start) + 1


def corpus_sections(spark: SparkSession, root: str) -> DataFrame:
    """Sections of all texts below a folder, but of files that begin with _ or a dot."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    return sections_of(files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).filter(~F.col("file").rlike(r"/[_.][^/]*$")))


def sections_of(files: DataFrame) -> DataFrame:
    """Sections of files(file, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [s for f, x in zip(batch["file"], batch["text"], strict=True) for s in parse_sections(f, x)]
            yield pd.DataFrame(found, columns=[x.split()[0] for x in SECTIONS.split(", ")])

    return files.select("file", "text").mapInPandas(run, SECTIONS)


def lint_sections(sections: DataFrame, known_tags: list[str], most_per_file: int = 12) -> DataFrame:
    """(file, id, problem): duplicate ids, unknown tags, empty bodies, and files with too many sections."""
    twice = sections.groupBy("id").agg(F.min("file").alias("file"), F.count("*").alias("n")).filter("n > 1").select("file", "id", F.lit("duplicate id").alias("problem"))
    odd = sections.select("file", "id", F.explode("tags").alias("tag")).filter(~F.col("tag").isin(known_tags)).select("file", "id", F.concat(F.lit("unknown tag "), "tag").alias("problem"))
    empty = sections.filter(F.trim("body") == "").select("file", "id", F.lit("empty body").alias("problem"))
    many = sections.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") > most_per_file).select("file", F.lit(None).cast("string").alias("id"), F.lit("too many sections").alias("problem"))
    return twice.unionByName(odd).unionByName(empty).unionByName(many)


def frame(messages: list[dict]) -> bytes:
    """Messages with Content-Length headers."""
    return b"".join(b"Content-Length: %d\r\n\r\n%s" % (len(b), b) for b in (json.dumps(m, ensure_ascii=False).encode() for m in messages))


MESSAGES = "id string, method string, params string, error string"


def unframe(data: bytes) -> Iterator[tuple]:
    """(id, method, params, error) of framed messages; what is no JSON gives a row with an error, a broken frame ends the data."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        length = re.search(rb"(?i)content-length:\s*(\d+)", data[at : max(end, at)])
        if end < 0 or not length:
            yield None, None, None, "broken frame"
            return
        body = data[end + 4 : end + 4 + int(length[1])]
        at = end + 4 + int(length[1])
        try:
            m = json.loads(body)
            yield None if m.get("id") is None else str(m["id"]), m.get("method"), json.dumps(m.get("params"), ensure_ascii=False), None
        except (ValueError, AttributeError):
            yield None, None, None, "malformed"


def framed_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of files of framed JSON."""
    return messages_of(spark.read.format("binaryFile").load(path))


def framed(body: Column) -> Column:
    """A message with its header."""
    return F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def messages_of(files: DataFrame) -> DataFrame:
    """Messages in the binary column content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([m for data in batch["content"] for m in unframe(data)], columns=["id", "method", "params", "error"])

    return files.select("content").mapInPandas(run, MESSAGES)


RECEIPT = "struct<gates: array<struct<name: string, status: string, duration_ms: bigint, metrics: map<string, double>>>>"


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """(receipt, name, status, duration_ms, metrics): gate results of JSON receipts."""
    return gates_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("receipt"), F.col("value").alias("text")))


def gates_of(receipts_: DataFrame) -> DataFrame:
    """The gates of JSON receipts(receipt, text)."""
    return receipts_.select("receipt", F.explode(F.from_json("text", RECEIPT)["gates"]).alias("_g")).select("receipt", "_g.*")


def write_receipt(gates: DataFrame, path: str) -> None:
    """One JSON receipt of all gates; a run has few."""
    gates.agg(F.collect_list(F.struct(*gates.columns)).alias("gates")).write.mode("overwrite").json(path)


def latest_file(spark: SparkSession, path: str) -> DataFrame:
    """The file of a folder whose name sorts last."""
    return spark.read.format("binaryFile").load(path).agg(F.max("path").alias("path"))
