"""The plain-text path: narrow, no exchange, the same plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscreen.operators.delimiters import sanitize_delimiters
from siltscreen.operators.encoded import sanitize_encoded
from siltscreen.operators.exfiltration import sanitize_exfiltration
from siltscreen.operators.unicode import sanitize_unicode
from siltscreen.options import SanitizeOptions
from siltscreen.schema import COUNTERS, HTML_COUNTERS

DEFAULTS = SanitizeOptions()


def text_steps(df: DataFrame, text: str, options: SanitizeOptions) -> DataFrame:
    """The four text steps in their fixed order: NFKC must run before the delimiters."""
    df = sanitize_unicode(df, text)
    df = sanitize_encoded(df, text, options)
    df = sanitize_exfiltration(df, text)
    return sanitize_delimiters(df, text, options.custom_patterns)


RESULTS = ["content", "stats", "input_size", "output_size"]


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """The other columns under reserved names, so that no step meets a name of its own; and their names."""
    others = [c for c in df.columns if c not in used]
    if clash := {c.lower() for c in others} & set(RESULTS):
        raise ValueError(f"rename the input columns {sorted(clash)}: results have these names")
    names = {f"_other{i}": c for i, c in enumerate(others)}
    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(n) for n, c in names.items()]
    return df.select(*quoted, *[u for u in used if u in df.columns]), names


def brought_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for n, c in names.items()], *[c for c in df.columns if c not in names])


def with_stats(df: DataFrame, content: str = "content") -> DataFrame:
    """Fold the counter columns into one `stats` struct and add the output size.

    The results come out of a one-element `inline`.  A later filter on a counter stops there;
    pushed further down it would be rewritten in terms of the raw text and repeat the whole
    chain of steps once per use.  Filters on the other columns still reach the scan.
    """
    c = F.col(content)
    stats = F.when(c.isNotNull(), F.struct(*[F.col(name) for name in COUNTERS]))
    result = F.struct(
        c.alias(content), stats.alias("stats"), F.octet_length(c).cast("bigint").alias("output_size")
    )
    others = [name for name in df.columns if name not in (content, *COUNTERS)]
    return df.select(*others, F.inline(F.array(result)))


def sanitize_text(
    df: DataFrame, text: str = "text", options: SanitizeOptions = DEFAULTS
) -> DataFrame:
    """Replace `text` by `content, stats, input_size, output_size`; NULL text stays NULL."""
    df, names = set_aside(df, text)
    df = df.withColumnRenamed(text, "content").withColumn(
        "input_size", F.octet_length("content").cast("bigint")
    )
    df = text_steps(df, "content", options)
    zero = F.when(F.col("content").isNotNull(), F.lit(0).cast("bigint"))
    return brought_back(with_stats(df.withColumns({c: zero for c in HTML_COUNTERS})), names)
