"""Invisible characters and NFKC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscreen.functions import patterns as P
from siltscreen.functions import text as fn


def strip_class(df: DataFrame, counter: str, text: str = "text") -> DataFrame:
    """Count and delete one of the five invisible character classes."""
    pattern = P.INVISIBLE[counter]
    return df.withColumns(
        {
            counter: fn.count_matches(F.col(text), pattern),
            text: F.regexp_replace(text, pattern, ""),
        }
    )


def nfkc(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, fn.nfkc(F.col(text)))


def sanitize_unicode(df: DataFrame, text: str = "text") -> DataFrame:
    """All five counts on the input, one merged deletion, then NFKC."""
    t, hit = F.col(text), F.col("_invisible")
    counters = {
        name: F.when(hit, fn.count_matches(t, pattern)).when(~hit, F.lit(0).cast("bigint"))
        for name, pattern in P.INVISIBLE.items()
    }
    stripped = F.when(hit, F.regexp_replace(t, P.ANY_INVISIBLE, "")).otherwise(t)
    df = df.withColumn("_invisible", t.rlike(P.ANY_INVISIBLE))
    df = df.withColumns({**counters, text: stripped}).drop("_invisible")
    return nfkc(df, text)
