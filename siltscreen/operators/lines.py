"""Sanitised documents as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_table(
    df: DataFrame,
    content: str = "content",
    offset: int | None = None,
    limit: int | None = None,
    max_line: int | None = None,
) -> DataFrame:
    """One row per line, from line `max(1, offset)` on.

    `limit` is the number of lines a document gives at most, `max_line` the characters of a line that
    are shown before "..."; without them all lines come whole.
    """
    first = max(1, 1 if offset is None else offset)
    count = 2**31 - 1 if limit is None else limit
    keys = [c for c in df.columns if c != content]
    # Slicing before the explode: a document never yields more rows than asked for.
    wanted = F.slice(F.split(content, "\n", -1), first, count)
    line = F.col("line")
    return (
        df.select(*keys, F.posexplode(wanted).alias("_i", "line"))
        .select(
            *keys,
            (F.col("_i") + first).cast("bigint").alias("line_no"),
            _shortened(line, max_line).alias("line"),
        )
    )


def _shortened(line: Column, size: int | None) -> Column:
    if size is None:
        return line
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size), F.lit("..."))).otherwise(line)


def numbered(df: DataFrame) -> DataFrame:
    """Add `shown`: the line number right-justified to six places, a tab, the line."""
    shown = F.concat(F.format_string("%6d", F.col("line_no")), F.lit("\t"), F.col("line"))
    return df.withColumn("shown", shown)
