"""The HTML path: token table -> removal -> markdown -> the text steps.  One exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscreen.operators.html_tokens import ROW_KEY
from siltscreen.operators.markdown import html_to_markdown
from siltscreen.options import SanitizeOptions
from siltscreen.plans.text_path import brought_back, set_aside, text_steps, with_stats
from siltscreen.schema import HTML_COUNTERS

DEFAULTS = SanitizeOptions()


def sanitize_html(
    df: DataFrame,
    html: str = "html",
    key: list[str] | None = None,
    options: SanitizeOptions = DEFAULTS,
) -> DataFrame:
    """Replace `html` by `content, stats, input_size, output_size`; NULL html stays NULL."""
    known = F.col("content").isNotNull()
    df, names = set_aside(df, html, ROW_KEY)
    reserved = {c: n for n, c in names.items()}
    df = html_to_markdown(df, html, [reserved.get(k, k) for k in key] if key else None, options.reopen_formatting)
    df = df.withColumns({c: F.when(known, F.col(c)) for c in HTML_COUNTERS})
    return brought_back(with_stats(text_steps(df, "content", options)), names)
