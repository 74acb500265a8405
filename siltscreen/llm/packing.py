"""Token ids packed into rows of one length: best-fit decreasing with a segment tree over capacities.

Texts longer than a row are split, losslessly, into pieces of a row and a rest.  The pieces of a step of
a task are placed longest first, each into the fullest row that still has room; a segment tree over
capacities finds it in a logarithm of the row length.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltscreen.llm.bpe import Encoder, encode_texts
from siltscreen.llm.common import bounded_batches, col, gather, steps, tidy, utf8

LENGTH = 2048
#: Tokens that are packed together: the bound of a task's memory beside its longest text.
STEP_TOKENS = 2 << 20


class Capacities:
    """Open rows by their free places; a segment tree over 0..length marks which capacities have a row."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.marks = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.marks[at] += by
            at >>= 1

    def add(self, capacity: int, row: int) -> None:
        if not self.rows[capacity]:
            self._count(capacity, 1)
        self.rows[capacity].append(row)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the smallest capacity of at least `least`, and that capacity; it is removed."""
        at = least + self.size
        if not self.marks[at]:
            # Up until a right neighbour has one, then down to its leftmost.
            while at > 1 and (at & 1 or not self.marks[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.marks[2 * at] else 2 * at + 1
        capacity = at - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self._count(capacity, -1)
        return row, capacity


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """The row of each piece (pieces of 1..length tokens), and the number of rows."""
    place = np.zeros(len(sizes), np.int64)
    open_rows = Capacities(length)
    n = 0
    listed = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        found = open_rows.take(listed[i])
        row, room = found if found else (n, length)
        n += not found
        place[i] = row
        if room > listed[i]:
            open_rows.add(room - listed[i], row)
    return place, n


def _packed(ids: np.ndarray, bounds: np.ndarray, docs: pa.Array, length: int, pad: int) -> list[pa.Array]:
    count = np.diff(bounds)
    pieces = -(-count // length)
    owner = np.repeat(np.arange(len(count)), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    at = (np.arange(len(owner)) - first[owner]) * length
    size = np.minimum(length, count[owner] - at)
    row, n = best_fit(size, length)
    order = np.argsort(row, kind="stable")  # within a row, pieces keep the order of the texts
    row, owner, at, size = row[order], owner[order], at[order], size[order]
    segments = np.searchsorted(row, np.arange(n + 1))
    ends = np.cumsum(size)
    before = np.concatenate([[0], ends])
    column = before[:-1] - before[segments[row]]
    source, piece_bounds = gather(bounds[owner] + at, size)
    target, _ = gather(row * length + column, size)
    matrix = np.full(n * length, pad, "<u4")
    matrix[target] = ids[source]
    positions = np.zeros(n * length, "<u4")
    positions[target] = np.arange(len(target)) - np.repeat(piece_bounds[:-1], size)
    wide = np.arange(n + 1) * length * 4
    binary = lambda x: pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(wide.astype(np.int64)), pa.py_buffer(x.tobytes())]).cast(pa.binary())
    # Cumulative lengths: one number more than segments in each row.
    cumulative = np.zeros(len(size) + n, np.int32)
    cumulative[np.arange(len(size)) + row + 1] = column + size
    parts = pa.StructArray.from_arrays([docs.take(pa.array(owner)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))], ["doc", "start", "n_tokens"])
    listed = lambda values, cuts: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)
    used = np.bincount(row, weights=size, minlength=n).astype(np.int32)
    return [pa.array(used), binary(matrix), binary(positions), listed(pa.array(cumulative), segments + np.arange(n + 1)), listed(parts, segments)]


def pack(docs: DataFrame, encoder: Encoder, text: str = "text", doc: str = "doc_id", length: int = LENGTH, pad: int = 0) -> DataFrame:
    """Rows of `length` tokens: `n_tokens, ids, position_ids, cu_seqlens, segments`.

    `ids` and `position_ids` are binary (little-endian unsigned 32-bit), `pad` and 0 fill a row's end,
    positions start at 0 with every segment.  `cu_seqlens` holds 0 and the end of each segment,
    `segments` the document, the token where the piece starts in it and its tokens.  Null and empty
    texts have no pieces; repeated rows and null ids are packed like others; other columns are not read.
    """
    if length < 1:
        raise ValueError("a row holds one token at least")
    kind = docs.schema[doc].dataType
    schema = (
        T.StructType().add("n_tokens", T.IntegerType()).add("ids", T.BinaryType()).add("position_ids", T.BinaryType()).add("cu_seqlens", T.ArrayType(T.IntegerType()))
        .add("segments", T.ArrayType(T.StructType().add("doc", kind).add("start", T.IntegerType()).add("n_tokens", T.IntegerType())))
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, lexicon = encoder.parts()
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b, _ in held]))])
                made = _packed(np.concatenate([i for i, _, _ in held]), bounds, pa.concat_arrays([d for _, _, d in held]), length, pad)
                held.clear()
                whole = pa.RecordBatch.from_arrays(made, names)
                for low in range(0, len(whole), 256):
                    yield whole.slice(low, 256)

        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for low, high in steps(offsets):
                part = batch.slice(low, high - low)
                ids, bounds = encode_texts(part.column(1).to_pylist(), v, lexicon)
                held.append((ids, bounds, part.column(0)))
                if sum(len(i) for i, _, _ in held) >= STEP_TOKENS:
                    yield from flush()
        yield from flush()

    bounded_batches(docs.sparkSession)
    return docs.select(col(doc).alias("_doc"), col(text).alias("_text")).mapInArrow(tidy(run), schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Parquet files of packed rows; a reader views `ids` and `position_ids` as matrices without parsing."""
    packed.write.mode("error").parquet(path)
