"""Corpus sanitisation as Spark DataFrame jobs."""

from siltscreen.options import SanitizeOptions
from siltscreen.plans.html_path import sanitize_html
from siltscreen.plans.routed import sanitize_routed
from siltscreen.plans.text_path import sanitize_text

__all__ = ["SanitizeOptions", "sanitize_html", "sanitize_routed", "sanitize_text"]
