"""A source of page texts: files that hold one page after the other, each behind a line that says so.

    spark.dataSource.register(PageFiles)
    spark.read.format("page_files").load(folder)

A row is (file, page, text) for each mark ``[DOCUMENT PAGE n]`` on a line of its own. Files are cut into ranges of
``range_bytes``; a range's reading takes the pages whose mark begins in it, past the range's end up to the next mark, so a
page that is cut by a border is read once and whole. A task reads ranges of a megabyte together, or of a two-hundredth of
all bytes where that is more, up to 32 MB: small ranges make no more tasks. What stands before a file's first mark is no page. A schema of
fewer columns reads only those: without ``text`` no page is put together. Bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, page long, text string"
MARK = re.compile(rb"(?m)^\[DOCUMENT PAGE ([0-9]+)\][ \t\r]*(?:\n|\Z)")
RANGE_BYTES = 32 << 20
BLOCK = 1 << 20
#: Bytes of the ranges that a task reads: at least, at most, and in how many parts all bytes are cut between these.
TASK_LEAST, TASK_MOST, TASKS = 1 << 20, 32 << 20, 200
#: Longer than any mark with its line: so much of a block waits for the next one.
KEEP = 256


class FileRanges(InputPartition):
    """Neighbouring ranges of a file, which one task reads in turn."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def marks(stream: BinaryIO, start: int, most: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(page, first byte of the mark, first byte after it) of all marks from a place on; the place may be within a line."""
    begin = max(0, start - 1)  # the byte before tells whether a line begins at start
    stream.seek(begin)
    rest, at, last = b"", begin, -1
    while True:
        block = stream.read(min(BLOCK, most or BLOCK))
        data, size = rest + block, len(block)
        for m in MARK.finditer(data):
            first = at + m.start()
            line_start = first == 0 or m.start() > 0
            if line_start and first >= start and first > last and (not block or m.end() < len(data)):
                last = first
                yield int(m[1]), first, at + m.end()
        if not size:
            return
        keep = min(len(data), KEEP)
        at += len(data) - keep
        rest = data[len(data) - keep :]


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.fieldNames()
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[FileRanges]:
        files, path = open_fs(self.path)
        info = files.get_file_info(path)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(path, recursive=True))
        kept = sorted((f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))
        share = min(max(sum(size for _, size in kept) // TASKS, TASK_LEAST), TASK_MOST)
        step = max(1, share // self.range_bytes) * self.range_bytes
        return [FileRanges(p, at, min(at + step, size)) for p, size in kept for at in range(0, size, step)]

    def read(self, partition: FileRanges) -> Iterator[tuple]:
        files, _ = open_fs(self.path)
        name = partition.path.rsplit("/", 1)[-1]
        with files.open_input_file(partition.path) as stream, files.open_input_file(partition.path) as texts:
            for start in range(partition.start, partition.end, self.range_bytes):
                yield from self._range(name, stream, texts, start, min(start + self.range_bytes, partition.end))

    def _range(self, name: str, stream: BinaryIO, texts: BinaryIO, start: int, stop: int) -> Iterator[tuple]:
        held: tuple[int, int] | None = None  # a page and where its text begins

        def row(end: int | None) -> tuple:
            value = {"file": name, "page": held[0]}
            if "text" in self.columns:
                texts.seek(held[1])
                raw = texts.read() if end is None else texts.read(end - held[1])
                value["text"] = raw.decode("utf-8", "replace").removesuffix("\n")
            return tuple(value[c] for c in self.columns)

        for page, first, after in marks(stream, start, max(self.range_bytes, 16 * KEEP)):
            if held:
                yield row(first)
                held = None
            if first >= stop:
                return
            held = page, after
            if "text" not in self.columns:
                yield row(None)
                held = None
        if held:
            yield row(None)


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options, schema)
