"""Framed messages as a data source: files are read by byte ranges, in tables and in streams, and written with one commit.

    spark.read.format("framed").load(folder)
    spark.readStream.format("framed").load(folder)
    messages.write.format("framed").mode("append").save(folder)

A frame is a header, which has a line `Content-Length: n`, an empty line, and
n bytes of JSON. A range reads the frames whose length line begins in it, to
their ends, wherever these are. Inside JSON no such line can follow a line
end, as strings hold no raw line ends; so the first line of that form in a
range begins a frame.

A task writes a file of its own beside the others; the commit moves the files
of the attempts that succeeded to their places, and deletes the rest.

Options: `rangeBytes`, the size of a range. Paths are those that pyarrow's file
systems open on the driver and on executors, such as a shared folder.

Defined results: rows are (path, at, body), with the place of the length line;
header names are in any case, and other header lines are skipped; a frame
whose body breaks off is not complete, and is left out; a null body writes no
frame; a stream reads complete frames only, each once, and expects files to
grow at their ends. A stream's offset has an entry for each file.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, at long, body string"
LENGTH, EMPTY = re.compile(rb"content-length:[ \t]*(\d+)[ \t]*\r?\n", re.IGNORECASE), re.compile(rb"(?:[^\r\n]+\r?\n)*\r?\n")
#: Bytes of a range and of a block that is read, and of the longest length line and header.
RANGE_BYTES, READ_BYTES, MOST_LINE, MOST_HEADER = 32 << 20, 1 << 20, 64, 16 << 10


def _opened(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, int]:
    """Paths and sizes of the files in a folder; what begins with a dot or an underscore is no data."""
    from pyarrow import fs

    system, inner = _opened(path)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "._"}


class Window:
    """Bytes of a file, read a block at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.begin, self.data = file, size, 0, b""

    def get(self, start: int, length: int) -> bytes:
        """Bytes from start on: so many, or more, or fewer at the end of the file."""
        if not self.begin <= start <= start + length <= self.begin + len(self.data):
            self.file.seek(start)
            self.begin, self.data = start, self.file.read(min(max(length, READ_BYTES), self.size - start))
        return self.data[start - self.begin :]


def frames(file, start: int, end: int, size: int, bodies: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """(place, end, body) of the complete frames whose length line begins in [start, end); without bodies they are passed over."""
    window, at = Window(file, size), start
    while at < min(end, size):
        data = window.get(at, min(MOST_LINE, size - at))
        m = LENGTH.search(data)
        if m is None:
            at += max(1, len(data) - MOST_LINE)
            continue
        place, line = at + m.start(), at + m.end()
        if place >= end:
            return
        # The other lines of the header, up to the empty one.
        empty = EMPTY.match(window.get(line, min(MOST_HEADER, size - line))) if line < size else None
        if empty is None:
            return
        begin, length = line + empty.end(), int(m[1])
        if begin + length > size:
            return
        yield place, begin + length, window.get(begin, length)[:length] if bodies else b""
        at = begin + length


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


def _ranges(path: str, start: int, size: int, step: int) -> list[Range]:
    return [Range(path, a, min(size, a + step), size) for a in range(start, size, step)]


def _read(folder: str, part: Range) -> Iterator[tuple[str, int, str]]:
    system, _ = _opened(folder)
    with system.open_input_file(part.path) as file:
        for place, _, body in frames(file, part.start, part.end, part.size):
            yield part.path, place, body.decode("utf-8", "replace")


class FramedReader(DataSourceReader):
    def __init__(self, folder: str, step: int):
        self.folder, self.step = folder, step

    def partitions(self) -> list[Range]:
        return [r for path, size in listed(self.folder).items() for r in _ranges(path, 0, size, self.step)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _read(self.folder, partition) if partition.path else iter(())


class FramedStream(DataSourceStreamReader):
    def __init__(self, folder: str, step: int):
        self.folder, self.step, self.known = folder, step, {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """The ends of the last complete frames, found from the headers that came since."""
        system, _ = _opened(self.folder)
        for path, size in listed(self.folder).items():
            end = self.known.get(path, 0)
            if size > end:
                with system.open_input_file(path) as file:
                    for _, end in ((p, e) for p, e, _ in frames(file, end, size, size, bodies=False)):
                        self.known[path] = end
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**after, **{p: max(n, after.get(p, 0)) for p, n in self.known.items()}}
        return [r for path, size in sorted(after.items()) for r in _ranges(path, before.get(path, 0), size, self.step)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _read(self.folder, partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str


class FramedWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = folder, overwrite, uuid.uuid4().hex

    def _place(self, name: str = ""):
        system, inner = _opened(self.folder)
        return system, f"{inner}/_attempts-{self.run}" + (f"/{name}" if name else ""), f"{inner}/{name}"

    def write(self, iterator) -> Written:
        name = f"part-{uuid.uuid4().hex}.framed"
        system, draft, _ = self._place(name)
        system.create_dir(draft.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(draft) as out:
            for row in iterator:
                if row["body"] is not None:
                    body = row["body"].encode()
                    out.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        old = list(listed(self.folder)) if self.overwrite else []
        for message in messages:
            if message is not None:
                system, draft, target = self._place(message.name)
                system.move(draft, target)
        for path in old:
            _opened(self.folder)[0].delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, drafts, _ = self._place()
        if system.get_file_info(drafts).type != fs.FileType.NotFound:
            system.delete_dir(drafts)


class Framed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCHEMA

    def _step(self) -> int:
        # Options come in lower case.
        return int(self.options.get("rangebytes", RANGE_BYTES))

    def reader(self, schema) -> FramedReader:
        return FramedReader(self.options["path"], self._step())

    def streamReader(self, schema) -> FramedStream:
        return FramedStream(self.options["path"], self._step())

    def writer(self, schema, overwrite: bool) -> FramedWriter:
        return FramedWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(Framed)
