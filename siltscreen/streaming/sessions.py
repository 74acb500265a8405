"""Running sessions: totals per session that go on from micro-batch to micro-batch, without time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltscreen.schema import COUNTERS, SESSION_COUNTERS

SUMS = ["total_requests", *COUNTERS]
#: `_seen` counts the rows that have statistics.
_HELD = ["_seen", *SUMS]
_LONGS = [T.StructField(c, T.LongType()) for c in _HELD]
_PART = T.StructType([T.StructField("_first", T.LongType()), T.StructField("_last", T.LongType()), *_LONGS])
_RUN = T.StructType([T.StructField("_opened", T.LongType()), *_PART.fields])


def stream_sessions(sanitized: DataFrame, session: str, ts: str, gap_ms: int | None = None) -> DataFrame:
    """The totals of every session that a micro-batch touches: a stream of updates.

    Returns `session, opened, first_at, last_at, closed, total_requests` and the 19 counters; the newest
    row of (`session`, `opened`) counts (`jobs.latest_updates`).  State is one row of sums per session.
    With `gap_ms`, a session without rows for that long on the wall clock is closed: its last row comes
    with `closed`, its state goes, and rows that come later open it anew under another `opened` (the time
    of the batch that opened it); this is for a job that goes on, as Spark keeps an `availableNow` query with
    such timeouts running.  Without it, sessions stay for ever.  No row is late: whatever its time,
    it counts, so sums over a session's runs equal `session_totals` after any split into batches.

    A NULL session is a session; counters are NULL as long as all its rows have NULL statistics; NULL times
    are left out of `first_at` and `last_at`.  A hot session is no hot task: rows become sums per Arrow batch before the exchange.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    counts = [F.coalesce(F.col(f"stats.{c}"), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]
    rows = sanitized.select(
        F.col(session).alias("_session"),
        at.alias("_first"),
        at.alias("_last"),
        F.col("stats").isNotNull().cast("bigint").alias("_seen"),
        F.lit(1).cast("bigint").alias("total_requests"),
        *counts,
    )
    key = T.StructField("_session", rows.schema["_session"].dataType)
    partial = rows.mapInArrow(_summed, T.StructType([key, *_PART.fields]))
    timeout = GroupStateTimeout.NoTimeout if gap_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    made = T.StructType([key, T.StructField("_closed", T.BooleanType()), *_RUN.fields])

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = state.hasTimedOut
        if closed:
            run = state.get
            state.remove()
        else:
            run = state.get if state.exists else (state.getCurrentProcessingTimeMs(), None, None, *[0] * len(_HELD))
            for part in parts:
                run = _added(run, part)
            state.update(run)
            if gap_ms is not None:
                state.setTimeoutDuration(gap_ms)
        row = [key[0], closed, *run]
        yield pd.DataFrame({f.name: pd.Series([v], dtype="object") for f, v in zip(made, row, strict=True)})

    runs = partial.groupBy("_session").applyInPandasWithState(advance, made, _RUN, "update", timeout)
    return runs.select(
        F.col("_session").alias(session),
        F.timestamp_millis("_opened").alias("opened"),
        F.timestamp_micros("_first").alias("first_at"),
        F.timestamp_micros("_last").alias("last_at"),
        F.col("_closed").alias("closed"),
        "total_requests",
        *[F.when(F.col("_seen") > 0, F.col(c)).alias(c) for c in COUNTERS],
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per session of each Arrow batch."""
    wanted = [("_first", "min"), ("_last", "max"), *[(c, "sum") for c in _HELD]]
    for batch in batches:
        if batch.num_rows:
            sums = pa.Table.from_batches([batch]).group_by("_session").aggregate(wanted)
            names = {f"{c}_{how}": c for c, how in wanted}
            sums = sums.rename_columns([names.get(c, c) for c in sums.column_names])
            yield from sums.select(batch.schema.names).combine_chunks().to_batches()


def _added(run: tuple, part: pd.DataFrame) -> tuple:
    opened, first, last, *sums = run
    firsts = [int(x) for x in (first, part["_first"].min()) if not pd.isna(x)]
    lasts = [int(x) for x in (last, part["_last"].max()) if not pd.isna(x)]
    added = [int(old) + int(part[c].sum()) for old, c in zip(sums, _HELD, strict=True)]
    return (opened, min(firsts, default=None), max(lasts, default=None), *added)


def totals_of_runs(runs: DataFrame, session: str) -> DataFrame:
    """What `session_totals` gives, from the newest row of every run of a session."""
    return runs.groupBy(session).agg(*[F.sum(c).alias(c) for c in SUMS])


def report_of_runs(runs: DataFrame, session: str) -> DataFrame:
    """What `session_report` gives, from the newest row of every run of a session."""
    totals = totals_of_runs(runs, session).select(session, "total_requests", *SESSION_COUNTERS)
    return totals.unpivot([session, "total_requests"], SESSION_COUNTERS, "counter", "total")
