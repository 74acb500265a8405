"""The sanitisation log: JSON lines, one per processed row."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltscreen.schema import LOG_SCHEMA, PAGE_TOOL
from siltscreen.sources.log_lines import LogLines


def log_write(entries: DataFrame, path: str) -> None:
    """Append; NULL fields (an empty description) are left out of the line."""
    entries.write.mode("append").option("ignoreNullFields", "true").json(path)


def log_stream_write(entries: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the entries of a stream to a log folder of its own, each line exactly once.

    Every micro-batch lists its files in a manifest inside the folder when all are written, and a batch
    that is replayed after a failure is listed once.  `log_scan` and `log_stream` read what the manifest
    lists, so neither a half-written nor a doubled file counts.  `log_write` must not write to the same
    folder: its files would be in no manifest.
    """
    return (
        entries.writeStream.format("json")
        .outputMode("append")
        .option("ignoreNullFields", "true")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder of `log_write` or `log_stream_write`, whose files never grow."""
    return parse_lines(spark.readStream.text(path))


def log_tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream over log files that another program appends to: see `LogLines`."""
    spark.dataSource.register(LogLines)
    return parse_lines(spark.readStream.format("log_lines").options(**options).load(path))


def log_scan(spark: SparkSession, path: str) -> DataFrame:
    """Read lines back; older lines may carry `url` for `source` and no `tool`.

    Unreadable lines do not stop the job: they keep their text in `_corrupt_record`.  Every line is
    parsed whole, whatever columns are asked for, so all reports reject the same lines.  A path that is
    not there is a log without lines.
    """
    try:
        text = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return _named(spark.createDataFrame([], LOG_SCHEMA))
    return parse_lines(text)


def parse_lines(text: DataFrame, line: str = "value") -> DataFrame:
    """Log rows from a column of lines."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json(F.col(line), LOG_SCHEMA, options)
    # Out of a one-element `inline`, so that asking for fewer columns does not parse fewer.
    return _named(text.filter(F.trim(F.col(line)) != "").select(F.inline(F.array(parsed))))


def _named(lines: DataFrame) -> DataFrame:
    return lines.withColumns(
        {
            "source": F.coalesce("source", "url", F.lit("?")),
            "tool": F.coalesce("tool", F.lit(PAGE_TOOL)),
        }
    ).drop("url")


def log_rows(log: DataFrame) -> DataFrame:
    return log.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def log_rejects(log: DataFrame) -> DataFrame:
    return log.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
