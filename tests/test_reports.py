"""Labels, totals, reports and the log."""

from pyspark.sql import functions as F

from siltscreen import sanitize_text
from siltscreen.operators import reports
from siltscreen.schema import COUNTERS, LABELS, STATS_TYPE
from siltscreen.sources import log as log_source


def stats(**hits):
    return tuple(hits.get(c, 0) for c in COUNTERS)


def test_labels_and_clean(spark):
    rows = [
        (1, stats(hidden_elements=3, llm_delimiters=2, data_uris=1)),
        (2, stats(html_comments=5, noscript_tags=1, meta_tags=1, unicode_tags=2, variation_selectors=1, hex_payloads=4)),
        (3, stats(**{c: 1 for c in COUNTERS})),
    ]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("stats", STATS_TYPE)])
    df = spark.createDataFrame(rows, schema)
    got = df.select("id", reports.threat_labels(F.col("stats")).alias("l"), reports.is_clean(F.col("stats")).alias("c")).collect()
    assert got[0].l == ["3 hidden elements", "1 data URIs", "2 LLM delimiters"] and not got[0].c
    assert got[1].l == [] and got[1].c
    assert got[2].l == [f"1 {label}" for _, label in LABELS]


def test_reduction_rounds_half_up(spark):
    rows = [(0, 0, 0.0), (1000, 1, 99.9), (100, 50, 50.0), (16, 15, 6.3), (80, 82, -2.5), (4000, 4001, 0.0)]
    df = spark.createDataFrame(rows, "i bigint, o bigint, want double")
    got = df.withColumn("got", reports.reduction_percent(F.col("i"), F.col("o")))
    assert got.filter("got <> want").collect() == []


def test_session_totals_and_report(spark):
    rows = [("s1", "a​​"), ("s1", "<|pad|>"), ("s2", "clean"), ("s1", None)]
    done = sanitize_text(spark.createDataFrame(rows, "session string, text string"))
    totals = {r.session: r for r in reports.session_totals(done, "session").collect()}
    assert totals["s1"].total_requests == 3 and totals["s1"].zero_width_chars == 2 and totals["s1"].llm_delimiters == 1
    report = reports.session_report(done, "session")
    assert report.count() == 18
    assert report.filter("session = 's1' AND counter = 'zero_width_chars'").first().total == 2


def test_session_sources_rank_across_buckets(spark):
    """A hot session is ranked exactly, whatever the bucket width."""
    rows = [("hot" if i % 3 else f"s{i % 7}", "safe_read" if i % 2 else "safe_fetch", i, f"f{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "session string, tool string, ts int, source string")
    want = {}
    for session, tool, ts, source in sorted(rows, key=lambda r: r[2]):
        key = (session, "files" if tool == "safe_read" else "urls")
        want.setdefault(key, []).append(source)
    for width in (1, 10, 10_000):
        got = {}
        ranked = reports.session_sources(df, "session", "ts", F.floor(F.col("ts") / width))
        for r in sorted(ranked.collect(), key=lambda r: r.position):
            got.setdefault((r.session, r.kind), []).append((r.position, r.source))
        assert got == {k: list(enumerate(v, 1)) for k, v in want.items()}


def test_session_sources_keep_every_row(spark):
    rows = [(None, "safe_read", 1, "a"), ("s", "other_tool", 2, "b"), ("s", None, 3, "c"), ("s", "safe_exec", None, "d")]
    df = spark.createDataFrame(rows, "session string, tool string, ts int, source string")
    got = {(r.session, r.kind, r.position, r.source) for r in reports.session_sources(df, "session", "ts", reports.order_buckets(df, "ts")).collect()}
    assert got == {(None, "files", 1, "a"), ("s", "other", 1, "b"), ("s", "other", 2, "c"), ("s", "commands", 1, "d")}


def test_a_hot_session_is_spread_over_its_buckets(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 999)).alias("session"), "id")
    loads = df.groupBy("session", reports.order_buckets(df, "id").alias("bucket")).count().collect()
    assert max(r["count"] for r in loads) <= 2 * 10_000 / 64
    assert len({r.bucket for r in loads}) >= 60


def test_all_reports_reject_the_same_lines(spark, tmp_path):
    good = '{"tool":"safe_read","source":"g","stripped":{"zeroWidthChars":2},"inputSize":4,"outputSize":2,"durationMs":1}'
    (tmp_path / "log.json").write_text("\n".join([good, good.replace(":4", ':"bad"'), "[", "", good[:-1]]) + "\n")
    log = log_source.log_scan(spark, str(tmp_path / "log.json"))
    assert log_source.log_rejects(log).count() == 3
    rows = log_source.log_rows(log)
    assert rows.count() == reports.log_summary(rows).first().requests == reports.recent(rows).count() == 1
    assert [(r.key, r.total) for r in reports.stripped_by_key(rows).collect()] == [("zeroWidthChars", 2)]


def test_no_log_is_an_empty_log(spark, tmp_path):
    log = log_source.log_scan(spark, str(tmp_path / "none"))
    assert log_source.log_rows(log).count() == log_source.log_rejects(log).count() == 0
    assert reports.log_summary(log_source.log_rows(log)).first().requests == 0


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    done = sanitize_text(spark.createDataFrame([(1, "a​b"), (2, "[INST]x")], "id int, text string"))
    at = F.to_timestamp(F.concat(F.lit("2024-01-01 00:00:0"), F.col("id").cast("string")))
    describe = F.when(F.col("id") == 1, "").otherwise("second")
    entries = reports.log_entries(done, F.lit("safe_read"), F.concat(F.lit("f"), F.col("id")), at, F.col("id") * 3, describe)
    log_source.log_write(entries.coalesce(1), path)
    log_source.log_write(entries.coalesce(1), path)  # appends
    (tmp_path / "log" / "old.json").write_text(
        '{"timestamp":"2023-01-01T00:00:00.000Z","url":"http://old","stripped":{"other":2,"zeroWidthChars":1},'
        '"inputSize":10,"outputSize":5,"durationMs":4}\nnot json\n'
    )
    assert "description" not in spark.read.text(path).filter("value LIKE '%f1%'").first().value
    log = log_source.log_scan(spark, path)
    assert [r[0] for r in log_source.log_rejects(log).collect()] == ["not json"]
    rows = log_source.log_rows(log)
    assert rows.count() == 5
    old = rows.filter("source = 'http://old'").first()
    assert old.tool == "safe_fetch" and old.stripped["other"] == 2
    by_key = {r.key: r.total for r in reports.stripped_by_key(rows).collect()}
    assert by_key == {"zeroWidthChars": 3, "llmDelimiters": 2, "other": 2}
    summary = reports.log_summary(rows).first()
    assert (summary.requests, summary.total_input, summary.total_output) == (5, 34, 11)
    assert summary.avg_duration_ms == 4  # (3 + 6 + 3 + 6 + 4) / 5 = 4.4
    last = reports.recent(rows, 2).collect()
    assert [r.source for r in last] == ["f2", "f2"] and last[0].logged_at == "2024-01-01 00:00:02"


def test_log_summary_of_nothing(spark, tmp_path):
    empty = sanitize_text(spark.createDataFrame([], "id int, text string"))
    path = str(tmp_path / "log")
    log_source.log_write(reports.log_entries(empty, F.lit("safe_read"), F.lit("x")), path)
    row = reports.log_summary(log_source.log_rows(log_source.log_scan(spark, path))).first()
    assert (row.requests, row.total_input, row.avg_reduction, row.avg_duration_ms) == (0, 0, 0, None)


def test_session_sources_of_any_order(spark):
    """Times as the order, a hot session over many ranges, copies, NULLs and clashing names."""
    many = spark.range(40_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("kind"),
        F.when(F.col("id") % 2 == 0, "safe_read").otherwise("safe_fetch").alias("tool"),
        F.when(F.col("id") % 1001 > 0, F.timestamp_seconds(1_700_000_000 + F.col("id") * 7919 % 20_011)).alias("ts"),
        F.concat(F.lit("f"), F.col("id") % 997).alias("source"),
    )
    want = {}
    for r in sorted(many.collect(), key=lambda r: (r.ts is not None, r.ts and r.ts.timestamp(), r.source)):
        want.setdefault((r.kind, "files" if r.tool == "safe_read" else "urls"), []).append(r.source)
    listed = many.withColumnRenamed("kind", "who")
    got = {}
    for r in sorted(reports.session_sources(listed, "who", "ts").collect(), key=lambda r: r.position):
        got.setdefault((r.who, r.kind), []).append((r.position, r.source))
    assert got == {k: list(enumerate(v, 1)) for k, v in want.items()}


def test_session_sources_spread_a_hot_session_and_its_copies(spark):
    one = spark.range(1_000_000).select(F.lit("hot").alias("s"), F.lit("safe_read").alias("tool"), "id", F.concat(F.lit("f"), "id").alias("source"))
    listed = one.select("s", "tool", "id", "source")
    loads = reports.ranged_sources(listed).groupBy("_bucket").count().collect()
    assert len(loads) == 8 and max(r["count"] for r in loads) < 2 * 1_000_000 / 8
    got = reports.session_sources(listed, "s", "id")
    assert got.filter("position <> bigint(substr(source, 2)) + 1").count() == 0
    same = one.select("s", "tool", F.lit(None).cast("date").alias("day"), F.lit("f").alias("source"))
    got = reports.session_sources(same, "s", "day").agg(F.count("*").alias("n"), F.min("position").alias("a"), F.max("position").alias("z"), F.count_distinct("position").alias("d"))
    assert got.first() == (1_000_000, 1, 1_000_000, 1_000_000)
    assert reports.session_sources(same.limit(0), "s", "day").collect() == []


def test_totals_come_with_the_write(spark, tmp_path):
    """The observed totals are those of a second scan, and the source is read once."""
    rows = [(i, ["a​b", "[INST] x", "clean", None][i % 4]) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    done, observation = reports.observed_totals(sanitize_text(df.mapInPandas(counted, df.schema)))
    done.write.parquet(str(tmp_path / "out"))
    got = reports.totals_of(spark, observation).first()
    assert read.value == 100 and spark.read.parquet(str(tmp_path / "out")).count() == 100
    want = reports.session_totals(sanitize_text(df)).first()
    assert {c: got[c] for c in want.asDict()} == want.asDict()
    assert (got.total_input, got.total_output) == tuple(sanitize_text(df).agg(F.sum("input_size"), F.sum("output_size")).first())
    none, observation = reports.observed_totals(sanitize_text(df.limit(0)))
    none.write.parquet(str(tmp_path / "none"))
    row = reports.totals_of(spark, observation).first()
    assert set(row.asDict().values()) == {0}
