"""Helpers the operators share: column handling, Arrow mapping, shared tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of a task works on at a time; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of `df` but for `names`; names are compared as Spark compares them, without case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learned from: crc32 of the id as text, modulo 4, is 2 (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; only a local session without it (tests) gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltscreen-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it from there.

    Spark removes it after use only with spark.cleaner.referenceTracking.cleanCheckpoints; else the folder is the caller's to empty.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of one Arrow batch between Spark and a Python worker, where the session sets no bound of its own.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: ten thousand rows, Spark's other bound, may be gigabytes of text."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, and at a task's end give freed memory back: the worker process waits idle for later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


#: Rows of a narrow table, and bytes of text and binary in it, that may be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def is_small(table: DataFrame) -> bool:
    """Whether a stored table of numbers and short texts may be broadcast, by counts of all of it."""
    sized = [F.coalesce(F.octet_length(col(c)), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "binary")]
    row = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(sized, F.lit(0)).cast("bigint")), F.lit(0)).alias("b")).first()
    return row.n <= BROADCAST_ROWS and row.b <= BROADCAST_BYTES


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a stored narrow table: broadcast if it is small as counted, else by a shuffle of both."""
    few = is_small(small)
    return big.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows, from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from bytes and row offsets."""
    made = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return made.cast(pa.string())


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def gather(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices start, start+1, ... of every piece in turn, and the pieces' new offsets."""
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return np.repeat(starts - bounds[:-1], lengths) + np.arange(bounds[-1]), bounds


def with_text_columns(
    df: DataFrame,
    text: str,
    make: Callable[[pa.Array], list[pa.Array]],
    made: T.StructType,
    keep: list[str],
    more: tuple[str, ...] = (),
    step: int = STEP_BYTES,
) -> DataFrame:
    """`keep`, then the columns `made` that `make` returns for a step's text column (and the columns `more`).

    Narrow: one Arrow pass, at most `step` bytes of text (or one row) at a time.  Columns of `keep`
    that clash with `made` are left out.
    """
    keep = [c for c in keep if c.lower() not in {f.name.lower() for f in made}]
    inputs = [text, *more]
    n = len(inputs)
    packed = df.select(*[col(c).alias(f"_in{i}") for i, c in enumerate(inputs)], *[col(c).alias(f"_keep{i}") for i, c in enumerate(keep)])
    types = [df.schema[c].dataType for c in keep]
    fields = [T.StructField(f"_keep{i}", t) for i, t in enumerate(types)]
    results = [T.StructField(f"_made{i}", f.dataType) for i, f in enumerate(made)]
    names = [f.name for f in fields + results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            offsets = np.zeros(len(texts) + 1, np.int64)
            np.cumsum(lengths, out=offsets[1:])
            for low, high in steps(offsets, step):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns[n:], *make(*part.columns[:n])], names)

    bounded_batches(df.sparkSession)
    out = packed.mapInArrow(tidy(run), T.StructType(fields + results))
    return out.select(
        *[F.col(f.name).alias(c) for f, c in zip(fields, keep, strict=True)],
        *[F.col(r.name).alias(f.name) for r, f in zip(results, made, strict=True)],
    )
