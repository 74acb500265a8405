"""Running sessions equal the batch totals after any split into micro-batches."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from siltscreen import sanitize_text
from siltscreen.operators import reports
from siltscreen.schema import COUNTERS
from siltscreen.streaming import jobs, sessions

SCHEMA = "n int, who string, ts timestamp, text string"
TEXTS = ["a​b", "<|pad|> x", "clean", "[INST] y", None]


def table(spark, rows):
    return spark.createDataFrame(rows, "n int, who string, s int, text string").select(
        "n", "who", F.timestamp_seconds("s").alias("ts"), "text"
    )


def turns(spark, n=200):
    """A session with half of all rows, a NULL session, NULL times; times run backwards between batches."""
    return table(spark, [(i, None if i % 7 == 0 else "hot" if i % 2 else f"s{i % 5}", None if i % 11 == 0 else (i * 37) % 5000, TEXTS[i % 5]) for i in range(n)])


def run(spark, tmp_path, files=1):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    runs = sessions.stream_sessions(jobs.stream_sanitize(stream), "who", "ts")
    jobs.write_updates(runs, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    return jobs.latest_updates(spark.read.parquet(f"{tmp_path}/out"), ["who", "opened"])


def same(a, b):
    key = lambda r: repr(r)
    return sorted((r.asDict() for r in a.collect()), key=key) == sorted((r.asDict() for r in b.select(*a.columns).collect()), key=key)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_equal_to_batch_after_any_split(spark, tmp_path, parts):
    df = turns(spark)
    df.repartition(parts, "n").write.parquet(f"{tmp_path}/in")
    latest = run(spark, tmp_path)
    done = sanitize_text(df)
    assert same(reports.session_totals(done, "who"), sessions.totals_of_runs(latest, "who"))
    assert same(reports.session_report(done, "who"), sessions.report_of_runs(latest, "who"))
    times = done.groupBy("who").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    assert same(times, latest.select("who", "first_at", "last_at"))
    assert latest.filter("closed").count() == 0


def test_goes_on_after_a_restart(spark, tmp_path):
    df = turns(spark)
    df.filter("n < 90").write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path, 2)
    df.filter("n >= 90").write.mode("append").parquet(f"{tmp_path}/in")
    latest = run(spark, tmp_path, 2)
    assert same(reports.session_totals(sanitize_text(df), "who"), sessions.totals_of_runs(latest, "who"))


def test_silent_sessions_close_and_open_anew(spark, tmp_path):
    """A job that goes on: every session closes after a millisecond without rows."""
    parts = [table(spark, [(0, "a", 5, "[INST] x"), (1, "b", 9, "x")]), table(spark, [(2, "c", 2, "​")]), table(spark, [(3, "a", 7, "[INST][INST]")])]
    parts[0].coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    runs = sessions.stream_sessions(jobs.stream_sanitize(stream), "who", "ts", 1)
    query = jobs.write_updates(runs, f"{tmp_path}/out", f"{tmp_path}/checkpoint", {"processingTime": "1 second"})

    def closed(n):
        """The runs, once there are `n` and all are closed."""
        end = time.monotonic() + 60
        while time.monotonic() < end and query.isActive:
            time.sleep(1)
            done = sorted(glob.glob(f"{tmp_path}/out/batch=*/_SUCCESS"))
            if done:
                written = spark.read.option("basePath", f"{tmp_path}/out").parquet(*[os.path.dirname(x) for x in done])
                latest = jobs.latest_updates(written, ["who", "opened"])
                rows = latest.collect()
                if len(rows) == n and all(r.closed for r in rows):
                    return rows, sessions.totals_of_runs(latest, "who").collect()
        raise AssertionError(f"no {n} closed runs: {query.exception()}")

    try:
        closed(2)
        for k, part in enumerate(parts[1:]):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            rows, totals = closed(3 + k)
    finally:
        query.stop()
    assert sorted((r.who, r.total_requests, r.llm_delimiters) for r in rows) == [("a", 1, 1), ("a", 1, 2), ("b", 1, 0), ("c", 1, 0)]
    batch = reports.session_totals(sanitize_text(parts[0].union(parts[1]).union(parts[2])), "who").collect()
    assert {r.who: r.asDict() for r in totals} == {r.who: r.asDict() for r in batch}


def test_partial_sums_come_before_the_exchange(spark, tmp_path):
    """A hot session is one row per Arrow batch when it is shuffled, whatever its number of rows."""
    import pyarrow as pa

    n = 50_000
    batch = pa.RecordBatch.from_pydict(
        {"_session": pa.array(["hot"] * (n - 1) + [None]), "_first": pa.array(range(n)), "_last": pa.array(range(n)), "_seen": pa.array([1] * n), "total_requests": pa.array([1] * n), **{c: pa.array([2] * n) for c in COUNTERS}}
    )
    (out,) = list(sessions._summed(iter([batch, batch.slice(0, 0)])))
    assert out.schema.names == batch.schema.names
    assert [r["total_requests"] for r in out.to_pylist()] == [n - 1, 1] and out.to_pylist()[0][COUNTERS[0]] == 2 * (n - 1)
