"""Streams give the batch results."""

import os

from pyspark.sql import functions as F

from siltscreen import sanitize_html, sanitize_text
from siltscreen.operators import reports
from siltscreen.sources.tables import with_row_key
from siltscreen.streaming import jobs

TEXTS = ["a​b", "<|pad|> x", "clean", "[INST] y", "Ａ"] * 4


def test_text_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    jobs.write_stream(jobs.stream_sanitize(stream), out, ckpt).awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(sanitize_text(df).collect())
    # A restart finds nothing new and adds nothing.
    jobs.write_stream(jobs.stream_sanitize(stream), out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == len(TEXTS)


def test_html_stream_equals_batch(spark, tmp_path):
    pages = [f"<p>{i}</p><div hidden>x</div><script>s</script>" for i in range(12)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    jobs.stream_html(with_row_key(stream), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(got.collect()) == sorted(sanitize_html(df).select(*got.columns).collect())


def test_totals_per_hour_and_late_rows(spark, tmp_path):
    day = [(f"2024-01-01 {h:02d}:{m:02d}:00", "t1" if m % 2 else "t2", "<|pad|>" * (h % 3)) for h in range(4) for m in range(0, 60, 7)]
    schema = "at string, tool string, text string"
    first = spark.createDataFrame(day, schema).withColumn("ts", F.to_timestamp("at"))
    source = str(tmp_path / "in")
    first.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(first.schema).parquet(source)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        totals = jobs.stream_totals(jobs.stream_sanitize(stream), "ts", "tool")
        jobs.write_updates(totals, out, ckpt).awaitTermination()
        latest = jobs.latest_updates(spark.read.parquet(out), ["hour", "tool"])
        return {(r.hour.start.hour, r.tool): (r.total_requests, r.llm_delimiters) for r in latest.collect()}

    batch = reports.session_totals(sanitize_text(first), "tool")
    assert sum(r.total_requests for r in batch.collect()) == len(day)
    want = {}
    for at, tool, text in day:
        n, d = want.get((int(at[11:13]), tool), (0, 0))
        want[(int(at[11:13]), tool)] = (n + 1, d + text.count("<|pad|>"))
    assert run() == want
    # The watermark stands at 02:5x: hour 0 is closed, hour 3 still open.
    more = [("2024-01-01 00:30:00", "t1", "<|pad|>"), ("2024-01-01 03:30:00", "t1", "<|pad|>")]
    spark.createDataFrame(more, schema).withColumn("ts", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(source)
    n, d = want[(3, "t1")]
    assert run() == {**want, (3, "t1"): (n + 1, d + 1)}


def test_late_rows_of_later_batches_do_not_count(spark, tmp_path):
    """Files are read one a batch, oldest first: a row behind the watermark is left out."""
    schema = "ts timestamp, tool string, text string"
    for k, hour in enumerate(["10:05", "15:00", "15:10", "10:30"]):
        path = f"{tmp_path}/part{k}"
        df = spark.sql(f"SELECT timestamp'2024-01-01 {hour}:00' AS ts, 't' AS tool, 'x' AS text")
        df.coalesce(1).write.parquet(path)
        file = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(f"{path}/{file}", tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    totals = jobs.stream_totals(jobs.stream_sanitize(stream), "ts", "tool")
    query = jobs.write_updates(totals, f"{tmp_path}/out", f"{tmp_path}/ckpt", trigger={"availableNow": True})
    query.awaitTermination()
    rows = jobs.latest_updates(spark.read.parquet(f"{tmp_path}/out"), ["hour", "tool"]).collect()
    assert sorted((r.hour.start.hour, r.total_requests) for r in rows) == [(10, 1), (15, 2)]
