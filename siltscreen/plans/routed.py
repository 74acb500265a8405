"""Rows of mixed kind: reject, route, sanitise each branch on its own path, put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscreen.operators.html_tokens import ROW_KEY
from siltscreen.options import SanitizeOptions
from siltscreen.plans.html_path import sanitize_html
from siltscreen.plans.text_path import sanitize_text

DEFAULTS = SanitizeOptions()


def sanitize_routed(
    routed: DataFrame,
    text: str = "text",
    key: list[str] | None = None,
    options: SanitizeOptions = DEFAULTS,
) -> DataFrame:
    """Sanitise rows that carry a `route`; rows with any other route are left out."""
    html = sanitize_html(routed.filter(F.col("route") == "html"), text, key, options)
    plain = sanitize_text(routed.filter(F.col("route") == "text").drop(ROW_KEY), text, options)
    return html.unionByName(plain)
