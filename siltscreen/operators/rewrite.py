"""Conditional rewriting of regex matches, the step shared by four operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscreen.functions import text as fn


def rewrite_matches(
    df: DataFrame,
    pattern: str,
    replace: Callable[[Column], Column],
    counter: str,
    text: str = "text",
    gate: str | None = None,
) -> DataFrame:
    """Replace each match `m` by `replace(m)` and count the matches that changed.

    `gate` is a cheaper pattern that every text with a match satisfies.  The match arrays are built only for rows that contain the pattern, the text is cut and
    rejoined only where at least one match changes.
    """
    t = F.col(text)
    found, new = F.col("_found"), F.col("_new")
    df = df.withColumn("_found", F.when(t.rlike(gate or pattern), fn.matches(t, pattern)))
    df = df.withColumn("_new", F.transform(found, replace))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda c: c))
    df = df.withColumn(
        counter,
        F.when(t.isNotNull(), F.when(found.isNull(), 0).otherwise(changed).cast("bigint")),
    )
    return df.withColumn(
        text, F.when(F.col(counter) > 0, fn.rewritten(t, pattern, new)).otherwise(t)
    ).drop("_found", "_new")
