"""Lines of a log that is still being written, as a stream source.

Spark's file stream takes a file once, when it first sees it; lines that a writer appends to the same
file later are never read.  This source keeps a byte position per file instead, reads on from there, and
holds a last line back until its line feed is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file that one task reads; and those in memory at a time, beside the longest line.
PIECE_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20


class Piece(NamedTuple):
    """Lines that start in `[start, stop)`; `first` is where this batch begins to read the file, `end` its last line's end."""

    path: str
    first: int
    start: int
    stop: int
    end: int


class _Part(InputPartition):
    def __init__(self, piece: Piece):
        super().__init__(piece)


class LogLines(DataSource):
    """`spark.readStream.format("log_lines").load(path)`: one row `value` per finished line.

    `path` is a file or a folder (its files, without those in folders below it and names that begin with
    `_` or `.`), local on all executors or a URI that pyarrow opens.  A file that became shorter than what
    was read of it began anew and is read from its start.  Bytes that are no UTF-8 become U+FFFD.  The
    offset holds a number per file, so a log should be few large files rather than many small ones.
    """

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogLinesReader(self.options["path"], int(self.options.get("pieceBytes", PIECE_BYTES)))


class LogLinesReader(DataSourceStreamReader):
    def __init__(self, path: str, piece_bytes: int):
        self.path = path
        self.piece_bytes = piece_bytes
        self.ends: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Where the last finished line of each file ends."""
        system, root = _open(self.path)
        for info in _files(system, root):
            size, end = self.ends.get(info.path, (0, 0))
            if info.size != size:
                low = end if info.size > size else 0
                self.ends[info.path] = info.size, _last_end(system, info.path, low, info.size)
        return {path: end for path, (_, end) in self.ends.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pieces = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            if first > stop:
                first = 0
            cuts = [*range(first, stop, self.piece_bytes), stop]
            pieces += [_Part(Piece(path, first, a, b, stop)) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pieces

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        return lines_of(system, partition.value)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(system: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    info = system.get_file_info(root)
    if info.type == fs.FileType.Directory:
        below = system.get_file_info(fs.FileSelector(root))
        return [x for x in below if x.type == fs.FileType.File and x.base_name[0] not in "_."]
    return [info] if info.type == fs.FileType.File else []


def _last_end(system: fs.FileSystem, path: str, low: int, size: int) -> int:
    """The place after the last line feed in `[low, size)`, or `low`: read backwards, a block at a time."""
    with system.open_input_file(path) as file:
        stop = size
        while stop > low:
            start = max(low, stop - BLOCK_BYTES)
            at = file.read_at(stop - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return low


def lines_of(system: fs.FileSystem, piece: Piece) -> Iterator[pa.RecordBatch]:
    """The piece's lines, in batches of about a block of bytes; a line belongs to the piece it starts in."""
    with system.open_input_file(piece.path) as file:
        at = piece.start
        if at > piece.first:  # a line that starts right here has its predecessor's line feed just before
            at = _next_line(file, at - 1, piece.end)
        rest: list[bytes] = []
        place = at  # of the next byte to read; `at` is where the line that is open begins
        while at < piece.stop:
            block = file.read_at(min(BLOCK_BYTES, piece.end - place), place)
            if not block:
                return
            place += len(block)
            *done, tail = block.split(b"\n")
            if done:
                done[0] = b"".join([*rest, done[0]])
                rest = []
                # Lines that start beyond the piece belong to the next one.
                keep = 0
                for line in done:
                    if at >= piece.stop:
                        break
                    at += len(line) + 1
                    keep += 1
                yield pa.RecordBatch.from_pydict({"value": pa.array([x.decode("utf-8", "replace") for x in done[:keep]], pa.string())})
            rest.append(tail)


def _next_line(file: pa.NativeFile, place: int, end: int) -> int:
    """The first place after a line feed at or behind `place`."""
    while place < end:
        block = file.read_at(min(BLOCK_BYTES, end - place), place)
        found = block.find(b"\n")
        if found >= 0:
            return place + found + 1
        if not block:
            return end
        place += len(block)
    return end
