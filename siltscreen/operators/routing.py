"""Which rows are rejected and which path the others take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscreen.functions import patterns as P


def looks_like_html(content: Column, path: Column | None = None) -> Column:
    by_content = F.coalesce(content.rlike(P.HTML_CONTENT), F.lit(False))
    if path is None:
        return by_content
    extension = F.lower(F.regexp_extract(path, r"(\.[^.]*+)$", 1))
    return F.coalesce(extension.isin(P.HTML_EXTENSIONS), F.lit(False)) | by_content


def too_large(size: Column, max_bytes: int | None = None) -> Column:
    """Above `max_bytes`; without a limit nothing is."""
    return F.lit(False) if max_bytes is None else F.coalesce(size > max_bytes, F.lit(False))


def is_binary(text: Column, within: int | None = None) -> Column:
    """Has a NUL character, anywhere or among the first `within` characters."""
    searched = text if within is None else F.substring(text, 1, within)
    return F.coalesce(F.instr(searched, "\0") > 0, F.lit(False))


def route_files(
    df: DataFrame, text: str = "text", path: str = "path", size: str = "length", max_bytes: int | None = None
) -> DataFrame:
    """Add `route`: too_large (above `max_bytes`, if given), binary, html or text, decided in this order."""
    return df.withColumn(
        "route",
        F.when(too_large(F.col(size), max_bytes), "too_large")
        .when(is_binary(F.col(text)), "binary")
        .when(looks_like_html(F.col(text), F.col(path)), "html")
        .otherwise("text"),
    )


def route_output(df: DataFrame, text: str = "text") -> DataFrame:
    """Command output has no path: only its content decides."""
    return df.withColumn("route", F.when(looks_like_html(F.col(text)), "html").otherwise("text"))


# --- rejects ---------------------------------------------------------------------


def file_rejects(
    df: DataFrame, path: str = "path", size: str = "length", max_bytes: int | None = None, failure: str | None = None
) -> DataFrame:
    """Add `error` (NULL for accepted rows) to routed files.

    `failure` names a column with the reason why a file could not be read (NULL: it was read).
    """
    megabytes = F.floor(F.col(size) / (1024 * 1024) + 0.5).cast("bigint").cast("string")
    limit = "" if max_bytes is None else f", max {max_bytes >> 20}MB"
    message = F.when(F.lit(False), "")
    if failure is not None:
        reason = F.col(failure)
        message = F.when(reason.isNotNull(), F.concat(F.lit("Error reading "), F.col(path), F.lit(": "), reason))
    message = message.when(
        F.col("route") == "too_large",
        F.concat(F.lit("File too large ("), megabytes, F.lit(f"MB{limit}): "), F.col(path)),
    ).when(F.col("route") == "binary", F.concat(F.lit("Skipped binary file: "), F.col(path)))
    return df.withColumn("error", message).withColumn("is_error", F.col("error").isNotNull())


def page_rejects(df: DataFrame, url: str = "url", status: str = "status") -> DataFrame:
    """Add `error` to fetched pages: every status outside 200-299 is an error, not data."""
    failed = ~F.coalesce(F.col(status).between(200, 299), F.lit(False))
    message = F.concat(
        F.lit("Error fetching "), F.col(url), F.lit(": HTTP "), F.coalesce(F.col(status).cast("string"), F.lit("?"))
    )
    return df.withColumn("error", F.when(failed, message)).withColumn("is_error", failed)


def command_rejects(df: DataFrame, command: str = "command", failure: str = "failure") -> DataFrame:
    """Add `error` to command outputs: a command that could not be run has a reason and no output.

    A command that ran and returned another code than 0 is data; its `exit_code` stays a column.
    """
    reason = F.col(failure)
    message = F.when(reason.isNotNull(), F.concat(F.lit("Error executing "), F.col(command), F.lit(": "), reason))
    return df.withColumn("error", message).withColumn("is_error", reason.isNotNull())


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows); only the first go on to be sanitised or counted."""
    return df.filter(~F.col("is_error")).drop("error", "is_error"), df.filter("is_error")
