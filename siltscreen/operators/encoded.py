"""Text data URIs, base64 and hex payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscreen.functions import patterns as P
from siltscreen.functions import text as fn
from siltscreen.operators.rewrite import rewrite_matches
from siltscreen.options import SanitizeOptions

DEFAULTS = SanitizeOptions()


def data_uris(df: DataFrame, text: str = "text", options: SanitizeOptions = DEFAULTS) -> DataFrame:
    """Replace text data URIs; when they are allowed the scan is left out of the plan."""
    t, zero = F.col(text), F.lit(0).cast("bigint")
    if options.allow_data_uris:
        return df.withColumn("data_uris", F.when(t.isNotNull(), zero))
    hit = F.col("_uri")
    df = df.withColumn("_uri", t.rlike(P.DATA_URI))
    return df.withColumns(
        {
            "data_uris": F.when(hit, fn.count_matches(t, P.DATA_URI)).when(~hit, zero),
            text: F.when(hit, F.regexp_replace(t, P.DATA_URI, P.DATA_URI_REPLACEMENT)).otherwise(t),
        }
    ).drop("_uri")


def _unless(run: Column, payload: Column) -> Column:
    return F.when(payload, F.lit(P.ENCODED_REPLACEMENT)).otherwise(run)


def base64_payloads(
    df: DataFrame, text: str = "text", options: SanitizeOptions = DEFAULTS
) -> DataFrame:
    def replace(run: Column) -> Column:
        return _unless(run, fn.base64_is_payload(run, options.max_base64_run))

    return rewrite_matches(df, P.BASE64_RUN, replace, "base64_payloads", text, P.BASE64_GATE)


def hex_payloads(df: DataFrame, text: str = "text") -> DataFrame:
    def replace(run: Column) -> Column:
        return _unless(run, fn.hex_is_payload(run))

    return rewrite_matches(df, P.HEX_RUN, replace, "hex_payloads", text, P.HEX_GATE)


def sanitize_encoded(
    df: DataFrame, text: str = "text", options: SanitizeOptions = DEFAULTS
) -> DataFrame:
    """Data URIs, then base64, then hex, each on the output of the step before."""
    df = data_uris(df, text, options)
    df = base64_payloads(df, text, options)
    return hex_payloads(df, text)


def base64_candidates(
    df: DataFrame, text: str = "text", options: SanitizeOptions = DEFAULTS
) -> DataFrame:
    """One row per base64 run: its place in the text, what it decodes to, and the verdict."""
    decoded = fn.decode_base64(F.col("run"))
    if options.max_base64_run is not None:
        decoded = F.when(F.length("run") <= F.lit(options.max_base64_run), decoded)
    return _candidates(df, text, P.BASE64_RUN, decoded, P.BASE64_GATE)


def hex_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per hex run: its place in the text, what it decodes to, and the verdict."""
    return _candidates(df, text, P.HEX_RUN, fn.decode_hex(F.col("run")), P.HEX_GATE)


def candidate_bytes(run: Column, base: int) -> Column:
    """What a run decodes to, before it is read as text."""
    return fn.base64_bytes(run) if base == 64 else fn.hex_bytes(run)


def _candidates(df: DataFrame, text: str, pattern: str, decoded: Column, gate: str) -> DataFrame:
    keys = [c for c in df.columns if c != text]
    df = df.filter(F.col(text).rlike(gate))
    return (
        df.select(*keys, F.posexplode(fn.matches(F.col(text), pattern)).alias("run_no", "run"))
        .withColumn("decoded", decoded)
        .withColumn("is_payload", fn.instruction_like(F.col("decoded")))
    )
