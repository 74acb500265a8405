"""Markdown images whose URL carries data out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscreen.functions import patterns as P
from siltscreen.functions import text as fn
from siltscreen.functions.hosts import let
from siltscreen.operators.rewrite import rewrite_matches


def md_images(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per markdown image: `image_no, alt, url, suspicious`."""
    keys = [c for c in df.columns if c != text]
    images = F.posexplode(fn.matches(F.col(text), P.MD_IMAGE)).alias("image_no", "image")
    return (
        df.filter(F.col(text).rlike(P.MD_IMAGE))
        .select(*keys, images)
        .withColumns({"alt": fn.image_alt(F.col("image")), "url": fn.image_url(F.col("image"))})
        .withColumn("suspicious", fn.suspicious_url(F.col("url")))
        .drop("image")
    )


def _neutral(image: Column) -> Column:
    def label(alt: Column) -> Column:
        return F.when(alt == "", "[image removed]").otherwise(F.concat(F.lit("[image: "), alt, F.lit("]")))

    return F.when(fn.suspicious_url(fn.image_url(image)), let(fn.image_alt(image), label)).otherwise(image)


def sanitize_exfiltration(df: DataFrame, text: str = "text") -> DataFrame:
    return rewrite_matches(df, P.MD_IMAGE, _neutral, "exfiltration_urls", text)
