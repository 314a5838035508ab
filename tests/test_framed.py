"""Framed messages as a data source: byte ranges, streams, one commit."""

import json
import os

import pytest

from factloom.sources import framed

BODIES = [json.dumps({"id": i, "text": "é" * (i % 50) + "Content-Length: 5\r\n\r\nfake" * (i % 3 == 0)}, ensure_ascii=False) for i in range(400)]


@pytest.fixture(scope="module")
def known(spark):
    framed.register(spark)
    return spark


def message(body, more=b""):
    data = body.encode()
    return more + b"Content-Length: %d\r\n" % len(data) + b"X: y\r\n" * (len(data) % 2) + b"\r\n" + data


def test_ranges_split_files_at_frames(known, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.framed").write_bytes(b"".join(message(b, b"Content-Type: z\r\n" * (i % 2)) for i, b in enumerate(BODIES[:300])))
    (folder / "b.framed").write_bytes(b"".join(message(b).replace(b"Content-Length", b"content-length", 1) for b in BODIES[300:]) + b"Content-Length: 99\r\n\r\n{")
    (folder / "_skipped").write_bytes(message("no"))
    size = sum((folder / n).stat().st_size for n in ("a.framed", "b.framed"))
    for step in (337, 1_000, 1 << 20):
        df = known.read.format("framed").option("rangeBytes", step).load(str(folder))
        rows = df.collect()
        assert sorted(r.body for r in rows) == sorted(BODIES)
        assert step != 1_000 or size // 1_000 <= df.rdd.getNumPartitions() <= size // 1_000 + 2
        assert {(os.path.basename(r.path), r["at"]) for r in rows} and len({(r.path, r["at"]) for r in rows}) == len(BODIES)


def test_round_trip_and_commit(known, tmp_path):
    folder = str(tmp_path / "out")
    table = known.createDataFrame([(b,) for b in BODIES] + [(None,)], "body string").repartition(5)
    for _ in range(2):
        table.selectExpr("'' as path", "0L as at", "body").write.format("framed").mode("append").save(folder)
    assert sorted(r.body for r in known.read.format("framed").load(folder).collect()) == sorted(BODIES * 2)
    table.selectExpr("'' as path", "0L as at", "body").write.format("framed").mode("overwrite").save(folder)
    assert sorted(r.body for r in known.read.format("framed").load(folder).collect()) == sorted(BODIES)
    # Of attempts only those that the commit names stay, and a failed run leaves nothing.
    writer = framed.FramedWriter(folder, overwrite=False)
    kept, lost = (writer.write(iter([{"body": b}])) for b in ('{"a": 1}', '{"b": 2}'))
    writer.commit([kept, None])
    bodies = [r.body for r in known.read.format("framed").load(folder).collect()]
    assert '{"a": 1}' in bodies and '{"b": 2}' not in bodies and lost.name not in os.listdir(folder)
    failed = framed.FramedWriter(folder, overwrite=True)
    failed.abort([failed.write(iter([{"body": "{}"}]))])
    assert known.read.format("framed").load(folder).count() == len(BODIES) + 1
    assert not [f for f in os.listdir(folder) if f.startswith("_attempts")]


def test_stream_follows_growing_files(known, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    data = b"".join(map(message, BODIES[:100]))

    def run():
        query = known.readStream.format("framed").option("rangeBytes", 500).load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
        query.awaitTermination()

    half = len(data) // 2
    (folder / "a").write_bytes(data[:half])
    run()
    (folder / "a").write_bytes(data)
    (folder / "b").write_bytes(message("{}"))
    run()
    run()
    assert sorted(r.body for r in known.read.parquet(out).collect()) == sorted([*BODIES[:100], "{}"])
