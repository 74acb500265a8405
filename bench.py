"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Each query is planned and run to completion twice; the second, warm time counts.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from siltscreen.plans import catalog  # noqa: E402

HEADLINE = [
    "a5_log_scan",
    "b4_route",
    "b4_routed_run",
    "c1_html_tokens",
    "c10_html_to_markdown",
    "c11_html_clean",
    "c12_html_stats",
    "d7_sanitize_unicode",
    "d9_base64_candidates",
    "d14_sanitize_encoded",
    "d17_exfiltration_urls",
    "d18_llm_delimiters",
    "d22_sanitize_text",
    "d22_sanitize_text_chat",
    "d23_sanitize_html",
    "e4_session_totals",
    "e5_session_sources",
    "e9_line_table",
    "h1_stream_sanitize",
    "h2_stream_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
