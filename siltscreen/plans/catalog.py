"""One registered query per operator, each over the whole of the given tables.

Inputs are the tables themselves or the seeded copies from `plans.seeds`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscreen.functions import patterns as P
from siltscreen.functions import text as fn
from siltscreen.functions import elements
from siltscreen.operators import delimiters, encoded, exfiltration, html_clean, html_tokens, lines
from siltscreen.operators import markdown, reports, routing, unicode
from siltscreen.operators.html_tokens import ROW_KEY
from siltscreen.operators.rewrite import rewrite_matches
from siltscreen.options import SanitizeOptions
from siltscreen.plans import seeds
from siltscreen.plans.html_path import sanitize_html
from siltscreen.plans.routed import sanitize_routed
from siltscreen.plans.text_path import sanitize_text
from siltscreen.schema import COMMAND_TOOL, COUNTERS, FILE_TOOL, HTML_COUNTERS, LOG_KEYS, PAGE_TOOL
from siltscreen.sources import log as log_source
from siltscreen.sources import tables
from siltscreen.sources.scratch import scratch_dir
from siltscreen.streaming import jobs, sessions

WITH_PHRASE = SanitizeOptions(custom_patterns=(seeds.PHRASE,))


# --- inputs ----------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    df = seeds.table(spark, sf_dir, "documents").select("doc_id", *keep, "text")
    return seeds.seeded_text(df, "doc_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_turns(seeds.table(spark, sf_dir, "conversations"))


def seeded_turns(df: DataFrame) -> DataFrame:
    return seeds.seeded_text(df.withColumn("_k", F.col("conv_id") * 7 + F.col("turn")), "_k").drop("_k")


def pages(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    df = tables.read_pages(spark, f"{sf_dir}/pages.parquet")
    return seeds.seeded_html(df.select("page_id", *keep, "html", ROW_KEY))


def flat(df: DataFrame, *keys: str) -> DataFrame:
    """The `stats` struct as 19 plain columns."""
    return df.select(
        *keys, "content", *[F.col(f"stats.{c}").alias(c) for c in COUNTERS], "input_size", "output_size"
    )


# --- text operators ----------------------------------------------------------------


def _class_query(counter: str):
    return lambda spark, sf: unicode.strip_class(documents(spark, sf), counter)


def d06(spark, sf):
    return unicode.nfkc(documents(spark, sf))


def d07(spark, sf):
    return unicode.sanitize_unicode(documents(spark, sf))


def d08(spark, sf):
    return encoded.data_uris(documents(spark, sf))


#: The subject of d9 and d12: runs that stand for more text than this are not decoded.
LIMITED = SanitizeOptions(max_base64_decode_length=500)


def _as_bytes(df: DataFrame, base: int) -> DataFrame:
    """The decoded bytes in hex: what a lenient reading as text makes of bad ones has no SQL form."""
    raw = F.when(F.col("decoded").isNotNull(), F.hex(encoded.candidate_bytes(F.col("run"), base)))
    return df.select("doc_id", F.col("run_no").cast("bigint").alias("run_no"), "run", raw.alias("decoded_hex"), "is_payload")


def d09(spark, sf):
    return _as_bytes(encoded.base64_candidates(documents(spark, sf), options=LIMITED), 64)


def d10(spark, sf):
    return _as_bytes(encoded.hex_candidates(documents(spark, sf)), 16)


def d11(spark, sf):
    return documents(spark, sf).select(
        "doc_id", fn.instruction_like(F.col("text")).alias("instruction_like")
    )


def d12(spark, sf):
    return encoded.base64_payloads(documents(spark, sf), options=LIMITED)


def d13(spark, sf):
    return encoded.hex_payloads(documents(spark, sf))


def d14(spark, sf):
    return encoded.sanitize_encoded(documents(spark, sf))


def d15(spark, sf):
    images = exfiltration.md_images(documents(spark, sf))
    return images.select("doc_id", F.col("image_no").cast("bigint").alias("image_no"), "alt", "url")


def d16(spark, sf):
    images = exfiltration.md_images(documents(spark, sf))
    return images.select("doc_id", F.col("image_no").cast("bigint").alias("image_no"), "url", "suspicious")


def d17(spark, sf):
    return exfiltration.sanitize_exfiltration(documents(spark, sf))


def d18(spark, sf):
    return delimiters.llm_delimiters(documents(spark, sf))


def d18_chat(spark, sf):
    return delimiters.llm_delimiters(conversations(spark, sf)).drop("role")


def d19(spark, sf):
    return delimiters.custom_patterns(documents(spark, sf), (seeds.PHRASE, "note", "[link]"))


def d20(spark, sf):
    def label(run: Column) -> Column:
        return F.when(
            F.length(run) > 100, F.concat(F.lit("[run of "), F.length(run).cast("string"), F.lit("]"))
        ).otherwise(run)

    return rewrite_matches(documents(spark, sf), P.BASE64_RUN, label, "rewritten")


def d21(spark, sf):
    df = documents(spark, sf)
    return df.select("doc_id", F.octet_length("text").cast("bigint").alias("input_size"))


def d22(spark, sf):
    return flat(sanitize_text(documents(spark, sf), options=WITH_PHRASE), "doc_id")


def d22_chat(spark, sf):
    return flat(sanitize_text(conversations(spark, sf), options=WITH_PHRASE), "conv_id", "turn")


def d23(spark, sf):
    return flat(sanitize_html(pages(spark, sf), options=WITH_PHRASE), "page_id")


# --- HTML operators ----------------------------------------------------------------


def _tokens(spark, sf) -> DataFrame:
    return html_tokens.html_tokens(pages(spark, sf), carry=("page_id",))


def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two neighbouring words of the benchmark as a phrase, ranked by item and place."""
    words = seeds.table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = words.filter("size(w) > 1").select("item_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.concat_ws(" ", F.slice("w", k, 2)))).alias("k", "phrase"))
    return pairs.select("phrase", (F.col("item_id") * 1_000_000 + F.col("k")).alias("rank"))


def d19_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the phrases of a table, some thousands of them, one after the other."""
    docs = seeds.table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n_chars"))
    done = delimiters.custom_patterns(docs, delimiters.phrase_list(phrase_table(spark, sf_dir)))
    return done.select("doc_id", F.md5("text").alias("content_md5"), (F.col("n_chars") - F.length("text")).cast("bigint").alias("removed_chars"))


def _elements(spark, sf) -> DataFrame:
    return html_clean.flag_elements(_tokens(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


def c01(spark, sf):
    return _tokens(spark, sf).select("page_id", F.col("pos").cast("bigint").alias("pos"), "kind", "tag", "tok")


def c02(spark, sf):
    return _elements(spark, sf).filter("hidden").select("page_id", "pos", "tag")


def c03(spark, sf):
    return _elements(spark, sf).filter("off_screen").select("page_id", "pos", "tag")


def c04(spark, sf):
    style = F.col("style")
    styled = _elements(spark, sf).filter(style.rlike("(?i)color|background"))
    return styled.select(
        "page_id",
        "pos",
        fn.normalize_color(F.regexp_extract(style, P.FOREGROUND, 1)).alias("foreground"),
        fn.normalize_color(F.regexp_extract(style, P.BACKGROUND, 1)).alias("background"),
    )


def c05(spark, sf):
    return _elements(spark, sf).filter("same_color").select("page_id", "pos", "tag")


def c06(spark, sf):
    stats = html_clean.html_stats(pages(spark, sf))
    return stats.select("page_id", "script_tags", "style_tags", "noscript_tags", "meta_tags")


def c07(spark, sf):
    return html_clean.html_stats(pages(spark, sf)).select("page_id", "html_comments")


def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two neighbouring words of the benchmark as a phrase, ranked by item and place."""
    words = seeds.table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = words.filter("size(w) > 1").select("item_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.concat_ws(" ", F.slice("w", k, 2)))).alias("k", "phrase"))
    return pairs.select("phrase", (F.col("item_id") * 1_000_000 + F.col("k")).alias("rank"))


def d19_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the phrases of a table, some thousands of them, one after the other."""
    docs = seeds.table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n_chars"))
    done = delimiters.custom_patterns(docs, delimiters.phrase_list(phrase_table(spark, sf_dir)))
    return done.select("doc_id", F.md5("text").alias("content_md5"), (F.col("n_chars") - F.length("text")).cast("bigint").alias("removed_chars"))


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_clean.page_structure(pages(spark, sf_dir).drop(ROW_KEY), carry=("page_id",)).withColumn("pos", F.col("pos").cast("bigint"))


def c08(spark, sf):
    removes = (F.col("bits").bitwiseAND(elements.REMOVED) != 0) & (F.col("end") >= 0)
    return _structure(spark, sf).filter(removes).select("page_id", "pos", "tag", F.col("end").cast("bigint").alias("end_pos"))


def c09(spark, sf):
    counters = [hit.alias(name) for name, hit in html_clean.token_counters().items()]
    return _structure(spark, sf).filter(~F.col("alive")).select("page_id", "pos", *counters)


def c10(spark, sf):
    return markdown.html_to_markdown(pages(spark, sf)).select("page_id", "content")


def c11(spark, sf):
    return html_clean.html_clean(pages(spark, sf)).select("page_id", "clean_html")


def c12(spark, sf):
    return html_clean.html_stats(pages(spark, sf)).select("page_id", *HTML_COUNTERS)


# --- routing and sources -------------------------------------------------------------


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as files: paths with eight kinds of extension, some NUL bytes, some
    declared sizes above the limit."""
    doc_ext = F.element_at(
        F.array(*[F.lit(e) for e in (".txt", ".md", ".HTML", ".svg", "", ".json", ".htm.bak", ".log")]),
        (F.col("id") % 8 + 1).cast("int"),
    )
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    docs = docs.select(F.concat(F.lit("docs/"), F.col("id").cast("string"), doc_ext).alias("path"), "id", "text")
    web = pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    web = web.select(
        F.concat(F.lit("pages/"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ".Xhtml").otherwise(".dump"))
        .alias("path"),
        "id",
        F.concat(F.when(F.col("id") % 2 == 0, F.lit("  \n")).otherwise(""), "text").alias("text"),
    )
    files = docs.unionByName(web)
    nul = F.when(F.col("id") % 19 == 0, F.concat(F.lit("\0"), F.col("text"))).otherwise(F.col("text"))
    files = files.withColumn("text", nul)
    size = F.when(F.col("id") % 17 == 0, F.lit(P.MAX_FILE_BYTES + 1 + F.col("id"))).otherwise(
        F.octet_length("text")
    )
    return files.withColumn("length", size.cast("bigint"))


def a01(spark, sf):
    return tables.pages_scan(fetched(spark, sf)).select("page_id", "url", "status")


def fetched(spark, sf) -> DataFrame:
    status = F.when(F.col("page_id") % 13 == 0, 404).when(F.col("page_id") % 13 == 1, 301).otherwise(
        F.lit(200) + (F.col("page_id") % 7).cast("int")
    )
    return pages(spark, sf, "url").withColumn("status", status.cast("int"))


def a02(spark, sf):
    """Write every benchmark item as a text file, then read the files back."""
    folder = scratch_dir(spark, "files")
    items = seeds.table(spark, sf, "benchmark").select("item_id", "text")
    items.write.partitionBy("item_id").text(folder)
    files = tables.read_files(spark, folder, recursiveFileLookup="true", pathGlobFilter="*.txt")
    item = F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint")
    return files.select(item.alias("item_id"), "length", "text")


def outputs(spark, sf) -> DataFrame:
    """Every turn as the output of a command: answers on stdout, questions on stderr, some answers with both."""
    answer = F.col("role") == "assistant"
    command = F.concat(F.lit("run "), F.col("conv_id").cast("string"))
    return conversations(spark, sf).select(
        "conv_id",
        "turn",
        command.alias("command"),
        (F.col("turn") % 3).cast("int").alias("exit_code"),
        F.when(F.col("turn") % 5 == 4, "timed out").alias("failure"),
        F.when(answer, F.col("text")).otherwise("").alias("stdout"),
        F.when(~answer, F.col("text")).when(F.col("turn") % 3 == 0, command).otherwise("").alias("stderr"),
    )


def a03(spark, sf):
    return tables.command_output(outputs(spark, sf)).select("conv_id", "turn", "command", "exit_code", "text")


def a07(spark, sf):
    """All four kinds: files too large or binary, files that could not be read, pages, commands."""
    failure = F.when(F.col("id") % 23 == 0, F.lit("permission denied"))
    files = routing.route_files(mixed_files(spark, sf).withColumn("failure", failure), max_bytes=P.MAX_FILE_BYTES)
    files = routing.file_rejects(files, max_bytes=P.MAX_FILE_BYTES, failure="failure")
    bad_files = routing.split_rejects(files)[1].select(F.col("path").alias("source"), "error")
    bad_pages = routing.split_rejects(routing.page_rejects(fetched(spark, sf)))[1].select(F.col("url").alias("source"), "error")
    bad_runs = routing.split_rejects(routing.command_rejects(outputs(spark, sf)))[1].select(F.col("command").alias("source"), "error")
    return bad_files.unionByName(bad_pages).unionByName(bad_runs)


def b01(spark, sf):
    html = routing.looks_like_html(F.col("text"), F.col("path"))
    return mixed_files(spark, sf).select("path", html.alias("looks_like_html"))


def b02(spark, sf):
    return mixed_files(spark, sf).filter(routing.too_large(F.col("length"), P.MAX_FILE_BYTES)).select("path", "length")


def b03(spark, sf):
    return mixed_files(spark, sf).select("path", routing.is_binary(F.col("text"), P.BINARY_SAMPLE_CHARS).alias("is_binary"))


def b04(spark, sf):
    return routing.route_files(mixed_files(spark, sf), max_bytes=P.MAX_FILE_BYTES).select("path", "route")


def b04_run(spark, sf):
    """Routed once and written by route; each branch reads its own part and goes its own path."""
    folder = scratch_dir(spark, "routed")
    routing.route_files(mixed_files(spark, sf), max_bytes=P.MAX_FILE_BYTES).write.partitionBy("route").parquet(folder)
    return flat(sanitize_routed(tables.read_pages(spark, folder), options=WITH_PHRASE), "path")


# --- reports -------------------------------------------------------------------------


def cleaned(spark, sf) -> DataFrame:
    return sanitize_text(documents(spark, sf, "source"), options=WITH_PHRASE)


def e01(spark, sf):
    labels = F.array_join(reports.threat_labels(F.col("stats")), "; ")
    return cleaned(spark, sf).select("doc_id", labels.alias("labels"))


def e01_pages(spark, sf):
    labels = F.array_join(reports.threat_labels(F.col("stats")), "; ")
    return sanitize_html(pages(spark, sf)).select("page_id", labels.alias("labels"))


def e02(spark, sf):
    return (
        cleaned(spark, sf)
        .groupBy("source", reports.is_clean(F.col("stats")).alias("is_clean"))
        .agg(F.count("*").alias("n"))
    )


def e03(spark, sf):
    share = reports.reduction_percent(F.col("input_size"), F.col("output_size"))
    return cleaned(spark, sf).select("doc_id", share.alias("reduction_percent"))


def e04(spark, sf):
    return reports.session_totals(cleaned(spark, sf), "source")


def e04_observed(spark, sf):
    """Clean documents are written; their totals come with the write."""
    done, totals = reports.observed_totals(cleaned(spark, sf))
    done.select("doc_id", "content").write.parquet(scratch_dir(spark, "clean"))
    return reports.totals_of(spark, totals)


def session_rows(spark, sf) -> DataFrame:
    tool = F.when(F.col("turn") % 3 == 0, PAGE_TOOL).when(F.col("turn") % 3 == 1, FILE_TOOL).otherwise(COMMAND_TOOL)
    source = F.concat(F.col("role"), F.lit("/"), F.col("turn").cast("string"))
    return conversations(spark, sf).withColumns({"tool": tool, "source": source})


def e05(spark, sf):
    return reports.session_report(sanitize_text(session_rows(spark, sf), options=WITH_PHRASE), "conv_id")


def e05_sources(spark, sf):
    return reports.session_sources(session_rows(spark, sf), "conv_id", "turn")


def log_rows(spark, sf) -> DataFrame:
    """Log entries of all sanitised documents; times and durations follow from the id."""
    return as_entries(cleaned(spark, sf))


def as_entries(rows: DataFrame) -> DataFrame:
    tool = F.when(F.col("doc_id") % 3 == 0, PAGE_TOOL).when(F.col("doc_id") % 3 == 1, FILE_TOOL).otherwise(COMMAND_TOOL)
    return reports.log_entries(
        rows,
        tool,
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")),
        F.timestamp_millis(F.lit(1704067200000) + F.col("doc_id") * 61007),
        F.col("doc_id") * 7919 % 997,
        F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("read "), F.col("source"))),
    )


def _written_log(spark, sf) -> DataFrame:
    path = scratch_dir(spark, "log")
    log_source.log_write(log_rows(spark, sf), path)
    return log_source.log_scan(spark, path)


def _log_columns(log: DataFrame) -> DataFrame:
    return log.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("logged_at"),
        "tool",
        "source",
        "description",
        *[F.col("stripped")[k].alias(k) for k in LOG_KEYS.values()],
        F.col("inputSize").alias("input_size"),
        F.col("outputSize").alias("output_size"),
        F.col("reductionPercent").alias("reduction_percent"),
        F.col("durationMs").alias("duration_ms"),
    )


def a04(spark, sf):
    """Append twice: the second write adds to the first."""
    path = scratch_dir(spark, "log")
    entries = log_rows(spark, sf)
    log_source.log_write(entries.filter(F.col("tool") != COMMAND_TOOL), path)
    log_source.log_write(entries.filter(F.col("tool") == COMMAND_TOOL), path)
    log = log_source.log_rows(log_source.log_scan(spark, path))
    return log.groupBy("tool").agg(F.count("*").alias("n"), F.sum("outputSize").alias("total_output"))


def a05(spark, sf):
    return _log_columns(log_source.log_rows(_written_log(spark, sf)))


def _raw_line():
    """The log line of a document: of three, one is good, one has a bad number, one is cut off."""
    number = F.col("doc_id").cast("string")
    size = F.when(F.col("doc_id") % 3 == 1, F.lit('"bad"')).otherwise(number)
    line = F.concat(F.lit('{"tool":"' + FILE_TOOL + '","source":"doc/'), number, F.lit('","inputSize":'), size, F.lit(',"outputSize":1,"durationMs":2}'))
    return F.when(F.col("doc_id") % 3 == 2, F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def a05_rejects(spark, sf):
    """Rejected lines of a log with a line a document, a third of them with a bad number, a third cut off."""
    path = scratch_dir(spark, "log")
    seeds.table(spark, sf, "documents").select(_raw_line().alias("value")).write.text(path)
    return log_source.log_rejects(log_source.log_scan(spark, path)).withColumnRenamed("_corrupt_record", "line")


def a04_stream(spark, sf):
    """The text path over a stream of documents, logged line by line by an exactly-once sink."""
    source = stream_table(spark, sf, "documents").select("doc_id", "source", "text")
    done = sanitize_text(seeds.seeded_text(source, "doc_id"), options=WITH_PHRASE)
    out = scratch_dir(spark, "log")
    log_source.log_stream_write(as_entries(done), f"{out}/log", f"{out}/checkpoint").awaitTermination()
    log = log_source.log_rows(log_source.log_scan(spark, f"{out}/log"))
    return log.groupBy("tool").agg(F.count("*").alias("n"), F.sum("outputSize").alias("total_output"))


def a05_tail(spark, sf):
    """A log with a line a document, good ones and bad ones, read by byte positions."""
    out = scratch_dir(spark, "log")
    seeds.table(spark, sf, "documents").select(_raw_line().alias("value")).write.text(f"{out}/log")
    log = log_source.log_tail(spark, f"{out}/log")
    jobs.write_stream(log, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    good = F.col("_corrupt_record").isNull()
    return rows.select(
        F.when(good, F.col("source")).alias("source"), F.when(good, F.col("inputSize")).alias("input_size"), F.col("_corrupt_record").alias("rejected")
    )


def a06(spark, sf):
    return _log_columns(log_rows(spark, sf))


def e06(spark, sf):
    return reports.log_summary(log_rows(spark, sf))


def e07(spark, sf):
    return reports.stripped_by_key(log_rows(spark, sf))


def e08(spark, sf):
    return reports.recent(log_rows(spark, sf))


def e09(spark, sf):
    return lines.line_table(sanitize_text(documents(spark, sf)).select("doc_id", "content"))


def e09_pages(spark, sf):
    done = sanitize_html(pages(spark, sf)).select("page_id", "content")
    return lines.numbered(lines.line_table(done, offset=2, limit=5, max_line=2000)).select("page_id", "line_no", "shown")


# --- streams ---------------------------------------------------------------------------


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A file stream over one table, whether the table is a folder or a single file."""
    schema = seeds.table(spark, sf_dir, name).schema
    # A pattern, for a plain path must be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def h01(spark, sf):
    source = stream_table(spark, sf, "documents").select("doc_id", "text")
    done = jobs.stream_sanitize(seeds.seeded_text(source, "doc_id"), options=WITH_PHRASE)
    out = scratch_dir(spark, "stream")
    jobs.write_stream(done, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return flat(spark.read.parquet(f"{out}/rows"), "doc_id")


def h02(spark, sf):
    source = stream_table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.col("props").alias("text")
    )
    totals = jobs.stream_totals(
        jobs.stream_sanitize(seeds.seeded_text(source, "event_id"), options=WITH_PHRASE), "ts", "tool"
    )
    out = scratch_dir(spark, "stream")
    jobs.write_updates(totals, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    latest = jobs.latest_updates(spark.read.parquet(f"{out}/rows"), ["hour", "tool"])
    return latest.select(
        F.date_format("hour.start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "tool", "total_requests", *COUNTERS
    )


def h04(spark, sf):
    """Every turn of a stream of conversations, in the running totals of its conversation."""
    rows = jobs.stream_sanitize(seeded_turns(stream_table(spark, sf, "conversations")), options=WITH_PHRASE)
    runs = sessions.stream_sessions(rows.withColumn("at", F.timestamp_seconds("turn")), "conv_id", "at")
    out = scratch_dir(spark, "stream")
    jobs.write_updates(runs, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    latest = jobs.latest_updates(spark.read.parquet(f"{out}/rows"), ["conv_id", "opened"])
    return sessions.totals_of_runs(latest, "conv_id")


def h03(spark, sf):
    source = tables.with_row_key(stream_table(spark, sf, "pages")).select("page_id", "html", ROW_KEY)
    out = scratch_dir(spark, "stream")
    jobs.stream_html(
        seeds.seeded_html(source), f"{out}/rows", f"{out}/checkpoint", options=WITH_PHRASE
    ).awaitTermination()
    return flat(spark.read.parquet(f"{out}/rows"), "page_id")


QUERIES = {
    "a1_pages_scan": a01,
    "a2_files_scan": a02,
    "a3_command_output": a03,
    "a4_log_write": a04,
    "a4_log_stream": a04_stream,
    "a5_log_scan": a05,
    "a5_log_tail": a05_tail,
    "a5_log_rejects": a05_rejects,
    "a6_log_entry": a06,
    "a7_rejects": a07,
    "b1_looks_like_html": b01,
    "b2_too_large": b02,
    "b3_is_binary": b03,
    "b4_route": b04,
    "b4_routed_run": b04_run,
    "d19_phrase_table": d19_phrases,
    "c1_html_tokens": c01,
    "c2_hidden_elements": c02,
    "c3_offscreen_elements": c03,
    "c4_normalize_color": c04,
    "c5_same_color_text": c05,
    "c6_strip_tags": c06,
    "c7_html_comments": c07,
    "c8_subtree_removal": c08,
    "c9_phase_order": c09,
    "c10_html_to_markdown": c10,
    "c11_html_clean": c11,
    "c12_html_stats": c12,
    "d1_zero_width": _class_query("zero_width_chars"),
    "d2_bidi": _class_query("bidi_overrides"),
    "d3_variation_selectors": _class_query("variation_selectors"),
    "d4_unicode_tags": _class_query("unicode_tags"),
    "d5_control_chars": _class_query("control_chars"),
    "d6_nfkc": d06,
    "d7_sanitize_unicode": d07,
    "d8_data_uris": d08,
    "d9_base64_candidates": d09,
    "d10_hex_candidates": d10,
    "d11_instruction_like": d11,
    "d12_base64_payloads": d12,
    "d13_hex_payloads": d13,
    "d14_sanitize_encoded": d14,
    "d15_md_images": d15,
    "d16_suspicious_url": d16,
    "d17_exfiltration_urls": d17,
    "d18_llm_delimiters": d18,
    "d18_llm_delimiters_chat": d18_chat,
    "d19_custom_patterns": d19,
    "d20_rewrite_matches": d20,
    "d21_byte_size": d21,
    "d22_sanitize_text": d22,
    "d22_sanitize_text_chat": d22_chat,
    "d23_sanitize_html": d23,
    "e1_threat_labels": e01,
    "e1_threat_labels_pages": e01_pages,
    "e2_clean_flag": e02,
    "e3_reduction_percent": e03,
    "e4_session_totals": e04,
    "e4_observed_totals": e04_observed,
    "e5_session_report": e05,
    "e5_session_sources": e05_sources,
    "e6_log_summary": e06,
    "e7_stripped_by_key": e07,
    "e8_recent": e08,
    "e9_line_table": e09,
    "e9_line_table_pages": e09_pages,
    "h1_stream_sanitize": h01,
    "h2_stream_totals": h02,
    "h3_stream_html": h03,
    "h4_running_sessions": h04,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitise the documents and total the counters per source."""
    return reports.session_totals(cleaned(spark, sf_dir), "source")
