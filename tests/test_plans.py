"""The shape of the plans."""

from pyspark.sql import functions as F

from siltscreen import sanitize_html, sanitize_text
from siltscreen.operators import reports

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def test_text_path_does_not_shuffle(spark):
    text = plan(sanitize_text(documents(spark)))
    assert "Exchange" not in text
    assert text.count("ArrowEvalPython") == 1


def test_html_path_shuffles_once_before_the_tokens(spark):
    text = plan(sanitize_html(pages(spark)))
    assert text.count("Exchange") == 1
    # The exchange moves whole pages: what cuts them up stands above it, and stays one row a page.
    assert text.index("regexp_extract_all") < text.index("Exchange")
    assert not any(node in text for node in ("Join", "Sort", "Window", "Aggregate", "posexplode"))


def test_counters_and_clean_markup_need_no_exchange(spark):
    from siltscreen.operators.html_clean import html_clean, html_stats

    for run in (html_stats, html_clean):
        text = plan(run(pages(spark)))
        assert not any(node in text for node in ("Exchange", "Sort ", "Window", "Aggregate"))


def test_totals_add_one_exchange_after_partial_sums(spark):
    text = plan(reports.session_totals(sanitize_text(documents(spark)), "source"))
    assert text.count("Exchange") == 1
    assert "partial_sum" in text[text.index("Exchange") :]


def test_filters_on_other_columns_reach_the_scan(spark):
    text = plan(sanitize_text(documents(spark)).filter("lang = 'en' AND stats.llm_delimiters > 0"))
    assert "EqualTo(lang,en)" in text
    assert len(text) < 60_000  # the counter filter is not expanded into the chain


def test_columns_are_pruned(spark):
    text = plan(sanitize_text(documents(spark)).groupBy("source").agg(F.sum("output_size")))
    schema = text[text.index("ReadSchema") :]
    assert "text:string" in schema and "source:string" in schema and "n_chars" not in schema


def test_allowed_data_uris_leave_the_plan(spark):
    from siltscreen import SanitizeOptions

    assert "data:text/" not in plan(sanitize_text(documents(spark), options=SanitizeOptions(allow_data_uris=True)))


def test_no_cross_join_and_no_broadcast_in_the_library():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "siltscreen"
    # The training-data operators broadcast behind a checked size and are tested beside their own tests.
    for file in (f for f in root.rglob("*.py") if "llm" not in f.relative_to(root).parts):
        code = file.read_text()
        for banned in ("crossJoin", "broadcast(", ".localCheckpoint", ".toPandas(", ".collect()"):
            assert banned not in code, (file, banned)


def test_copies_of_one_page_are_spread(spark, tmp_path):
    """Nine of ten rows are one page under one id and url: no partition gets the lot."""
    from siltscreen.operators.html_tokens import html_tokens
    from siltscreen.sources.tables import read_pages

    rows = [(1, "u", "<p>same</p>")] * 900 + [(i, f"u{i}", f"<p>{i}</p>") for i in range(100)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id int, url string, html string").coalesce(2).write.parquet(path)
    pages = read_pages(spark, path)
    loads = html_tokens(pages).groupBy(F.spark_partition_id()).count().collect()
    assert len(loads) == 8 and max(r["count"] for r in loads) < 1.5 * 3000 / 8
    done = sanitize_html(pages)
    assert "_row_key" not in done.columns and done.filter("content = 'same'").count() == 900


def test_registered_text_queries_do_not_shuffle(spark):
    from siltscreen.plans import catalog

    for name in ("d22_sanitize_text", "d22_sanitize_text_chat", "d7_sanitize_unicode"):
        assert "Exchange" not in plan(catalog.QUERIES[name](spark, SF)), name
