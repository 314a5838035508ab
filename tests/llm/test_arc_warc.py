"""Archives of both versions, and exact round trips."""

import base64
import hashlib

import pytest

from factloom.llm import arc_warc


def test_versions_parse_alike():
    body = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\npay\r\n\r\nload\n"
    for version in (1, 2):
        data = arc_warc.arc_head(version) + arc_warc.arc_record(version, "http://a/", body) + b"\n" + arc_warc.arc_record(version, "http://b/", b"", kind="text/x; charset=y z")
        first, second = arc_warc.parse_arc(data)
        assert (first["url"], first["body"], second["url"], second["body"], second["type"]) == ("http://a/", body, "http://b/", b"", "text/x; charset=y z")
        assert arc_warc.http_payload(first["body"])[1] == b"pay\r\n\r\nload\n"
        with pytest.raises(ValueError, match="breaks off"):
            list(arc_warc.parse_arc(data[: data.index(b"pay")]))
    with pytest.raises(ValueError, match="version block"):
        list(arc_warc.parse_arc(arc_warc.arc_record(1, "http://a/", b"x y")))
    assert arc_warc.iso_date("1999") == "1999-00-00T00:00:00Z"


PAGES = [
    (3, "http://a/ b\n", "<p>ä</p>\r\n\r\nWARC/1.1\r\n"),
    (1, None, None),
    (2, "", ""),
    (7, "http://c", "<p>ä</p>\r\n\r\nWARC/1.1\r\n"),
    (7, "http://c", "<p>ä</p>\r\n\r\nWARC/1.1\r\n"),
    (3, "http://d", "x" * 300_000),
    (None, "http://e", "x"),
    (9, "http://f", "x"),
    (10, "http://g", "x"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    rows = arc_warc.round_trip(pages).collect()
    assert len(rows) == len(PAGES)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    least = {}
    for i, _, t in PAGES:
        if i is not None:
            least[digest(t)] = min(i, least.get(digest(t), i))
    wanted = []
    for i, _, t in PAGES:
        first = least[digest(t)]
        revisit = i is not None and i != first
        wanted.append((i or 0, len((t or "").encode()), digest(t), "revisit" if revisit else "response", first if revisit else 0, None if revisit else (t or "").encode()))
    got = [(r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0, None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    key = lambda r: (*r[:5], r[5] or b"")
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert arc_warc.round_trip(pages.limit(0)).count() == 0
