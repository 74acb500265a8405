"""Structured Streaming versions of the text path, the totals and the HTML path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltscreen.options import SanitizeOptions
from siltscreen.plans.html_path import sanitize_html
from siltscreen.plans.text_path import sanitize_text
from siltscreen.schema import COUNTERS

DEFAULTS = SanitizeOptions()
#: Work through what is there and stop; a job that goes on passes e.g. {"processingTime": "1 minute"}.
ONCE = {"availableNow": True}


def stream_sanitize(
    stream: DataFrame, text: str = "text", options: SanitizeOptions = DEFAULTS
) -> DataFrame:
    """The text path has no state: a stream goes through the batch transformation as it is."""
    return sanitize_text(stream, text, options)


def stream_totals(sanitized: DataFrame, ts: str, *keys: str, lateness: str = "1 hour") -> DataFrame:
    """Counter sums per key and hour; state is bounded by the watermark, late rows are dropped.

    What is late depends on the order in which files arrive: with several micro-batches, rows more than
    `lateness` behind the latest time of earlier batches do not count.
    """
    return (
        sanitized.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 hour").alias("hour"), *keys)
        .agg(F.count("*").alias("total_requests"), *[F.sum(f"stats.{c}").alias(c) for c in COUNTERS])
    )


def stream_html(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    html: str = "html",
    key: list[str] | None = None,
    options: SanitizeOptions = DEFAULTS,
    trigger: dict = ONCE,
) -> StreamingQuery:
    """The HTML path per micro-batch.

    Its windows are per page, not per time, so each batch runs the batch job.  A batch that is
    replayed after a failure overwrites its own folder, which keeps the output exactly-once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = sanitize_html(batch, html, key, options)
        done.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def write_stream(df: DataFrame, target: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def write_updates(df: DataFrame, target: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Changed groups of every micro-batch, one folder per batch (safe to replay)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        df.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each group from what `write_updates` wrote."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), F.col("batch")).alias("_v")
    return updates.groupBy(*keys).agg(newest).select(*keys, "_v.*")
