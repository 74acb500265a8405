"""Model delimiters and user-defined phrases."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscreen.functions import patterns as P
from siltscreen.functions.hosts import let
from siltscreen.functions.phrases import remove_phrases


def literal_pattern(phrase: str) -> str:
    return "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", phrase, flags=re.ASCII)


def _remove_in_order(text: Column, patterns: list[str]) -> Column:
    """Delete each pattern from what the one before left; a struct of the text and the count."""

    def step(pattern: str) -> Callable[[Column], Column]:
        # The pattern is a literal, so it is compiled once, not once a row.
        found = lambda state: F.regexp_count(state["text"], F.lit(pattern))
        left = lambda state: F.regexp_replace(state["text"], pattern, "")
        return lambda state: F.struct(left(state).alias("text"), (state["n"] + found(state)).alias("n"))

    state = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n"))
    for pattern in patterns:
        state = let(state, step(pattern))
    return state


def _strip(df: DataFrame, patterns: list[str], gate: str, counter: str, text: str) -> DataFrame:
    t, done = F.col(text), F.col("_done")
    df = df.withColumn("_done", F.when(t.rlike(gate), _remove_in_order(t, patterns)))
    return df.withColumns(
        {
            counter: F.when(t.isNotNull(), F.coalesce(done["n"], F.lit(0).cast("bigint"))),
            text: F.coalesce(done["text"], t),
        }
    ).drop("_done")


def llm_delimiters(df: DataFrame, text: str = "text") -> DataFrame:
    """The thirteen delimiters, in order.  A row without any of them is left after one scan:
    where nothing matches at the start, no removal can create a match."""
    return _strip(df, P.DELIMITERS, P.ANY_DELIMITER, "llm_delimiters", text)


#: More phrases than these are looked for by one automaton instead of a pattern each; the result is the same.
FEW_PHRASES = 16
#: Phrases of a table and their characters, at most: they go along with every task.
MOST_PHRASES, MOST_CHARACTERS = 1_000_000, 64 << 20


def phrase_list(table: DataFrame, phrase: str = "phrase", rank: str = "rank") -> tuple[str, ...]:
    """The phrases of a table in order of their rank, equal ranks by phrase; null and repeated ones once or not at all.

    The table's size is counted first: more than MOST_PHRASES rows or MOST_CHARACTERS is an error.
    """
    rows = table.select(F.col(phrase).alias("_phrase"), F.col(rank).alias("_rank")).filter("_phrase is not null and _phrase != ''")
    rows = rows.groupBy("_phrase").agg(F.min("_rank").alias("_rank"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_phrase")), F.lit(0)).alias("c")).first()
    if size.n > MOST_PHRASES or size.c > MOST_CHARACTERS:
        raise ValueError(f"{size.n} phrases of {size.c} characters are more than go along with a task")
    return tuple(r["_phrase"] for r in rows.orderBy("_rank", "_phrase").toLocalIterator())


def custom_patterns(df: DataFrame, phrases: tuple[str, ...], text: str = "text") -> DataFrame:
    """User phrases as case-insensitive literals, in list order; `phrase_list` gives those of a table."""
    if any(p == "" for p in phrases):
        raise ValueError("a custom pattern must not be empty")
    if not phrases:
        zero = F.when(F.col(text).isNotNull(), F.lit(0).cast("bigint"))
        return df.withColumn("custom_patterns", zero)
    if len(phrases) > FEW_PHRASES:
        df = df.withColumn("_done", remove_phrases(F.col(text), tuple(phrases)))
        return df.withColumns({"custom_patterns": F.col("_done.n"), text: F.col("_done.text")}).drop("_done")
    patterns = [literal_pattern(p) for p in phrases]
    gate = "|".join(f"(?:{p})" for p in patterns)
    return _strip(df, patterns, gate, "custom_patterns", text)


def sanitize_delimiters(
    df: DataFrame, text: str = "text", phrases: tuple[str, ...] = ()
) -> DataFrame:
    return custom_patterns(llm_delimiters(df, text), phrases, text)
