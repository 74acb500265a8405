"""Pages, files, command output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscreen.operators.html_tokens import ROW_KEY


def with_row_key(scan: DataFrame) -> DataFrame:
    """Add `_row_key`, a hash of each row's file and place in it, to a parquet scan or stream.

    The key differs between copies of a page and is the same on every read, so pages can be
    spread evenly by it whatever their ids, urls or contents are.
    """
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    return scan.select("*", place.alias(ROW_KEY))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return with_row_key(spark.read.parquet(path))


def pages_scan(df: DataFrame) -> DataFrame:
    """Fetched pages that succeeded; the filter reaches the scan."""
    return df.filter(F.col("status").between(200, 299))


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None, **options: str) -> DataFrame:
    """`path, length, text` of all files.

    With `max_bytes`, larger files are listed with a NULL text, never read: the two filters on `length`
    are pushed into the scan, and the listing of oversized files does not select `content`.
    """
    files = spark.read.format("binaryFile").options(**options).load(path)
    if max_bytes is None:
        return files.select("path", "length", utf8(F.col("content")).alias("text"))
    small = files.filter(F.col("length") <= max_bytes).select(
        "path", "length", utf8(F.col("content")).alias("text")
    )
    large = files.filter(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("string").alias("text")
    )
    return small.unionByName(large)


def utf8(raw: Column) -> Column:
    """Bytes as text: invalid sequences become U+FFFD, a byte order mark stays."""
    return F.make_valid_utf8(raw.cast("string"))


def command_output(df: DataFrame, stdout: str = "stdout", stderr: str = "stderr") -> DataFrame:
    """Add `text`: stdout, followed by stderr under a heading when there is any."""
    out = F.coalesce(stdout, F.lit(""))
    err = F.coalesce(stderr, F.lit(""))
    merged = F.when(err == "", out).otherwise(F.concat(out, F.lit("\n--- stderr ---\n"), err))
    return df.withColumn("text", merged)
