"""Column names and schemas of the sanitised output and of the log."""

from pyspark.sql import types as T

# The counter vector in its canonical order.
HTML_COUNTERS = [
    "hidden_elements",
    "html_comments",
    "script_tags",
    "style_tags",
    "noscript_tags",
    "meta_tags",
    "off_screen_elements",
    "same_color_text",
]
UNICODE_COUNTERS = [
    "zero_width_chars",
    "control_chars",
    "bidi_overrides",
    "unicode_tags",
    "variation_selectors",
]
ENCODED_COUNTERS = ["base64_payloads", "hex_payloads", "data_uris"]
LINK_COUNTERS = ["exfiltration_urls"]
DELIMITER_COUNTERS = ["llm_delimiters", "custom_patterns"]
TEXT_COUNTERS = UNICODE_COUNTERS + ENCODED_COUNTERS + LINK_COUNTERS + DELIMITER_COUNTERS
COUNTERS = HTML_COUNTERS + TEXT_COUNTERS

# Counters shown in a row's label list, in display order.
LABELS = [
    ("hidden_elements", "hidden elements"),
    ("script_tags", "script tags"),
    ("style_tags", "style tags"),
    ("zero_width_chars", "zero-width chars"),
    ("base64_payloads", "base64 payloads"),
    ("data_uris", "data URIs"),
    ("exfiltration_urls", "exfiltration URLs"),
    ("off_screen_elements", "off-screen elements"),
    ("same_color_text", "same-color text"),
    ("llm_delimiters", "LLM delimiters"),
    ("bidi_overrides", "bidi overrides"),
    ("control_chars", "control chars"),
    ("custom_patterns", "custom patterns"),
]

# Counters listed in the session report, in display order.
SESSION_COUNTERS = [
    "hidden_elements",
    "script_tags",
    "style_tags",
    "zero_width_chars",
    "llm_delimiters",
    "bidi_overrides",
    "base64_payloads",
    "exfiltration_urls",
    "control_chars",
]

# Fixed values of the log format: one tool name per kind of source.
PAGE_TOOL = "safe_fetch"
FILE_TOOL = "safe_read"
COMMAND_TOOL = "safe_exec"

STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTERS])


def camel(name: str) -> str:
    """`hidden_elements` -> `hiddenElements`, the spelling used in log files."""
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


LOG_KEYS = {c: camel(c) for c in COUNTERS}

# `stripped` is read as a map: the log carries dynamic keys, unknown ones included.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("tool", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("stripped", T.MapType(T.StringType(), T.LongType())),
        T.StructField("inputSize", T.LongType()),
        T.StructField("outputSize", T.LongType()),
        T.StructField("reductionPercent", T.DoubleType()),
        T.StructField("durationMs", T.LongType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
