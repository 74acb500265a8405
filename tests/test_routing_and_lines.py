"""Routing, rejects, sources and the line table."""

import os

from pyspark.sql import functions as F

from siltscreen.operators import lines, routing
from siltscreen.sources import tables


def test_looks_like_html(spark):
    cases = [
        ("tide table", "pier/may.html", True),
        ("tide table", "pier/old/may.htm", True),
        ("tide table", "may.v2.xhtml", True),
        ("tide table", "/pier/buoy.svg", True),
        ("tide table", "s3a://pier/MAY.HtMl", True),
        ("<!DOCTYPE html><html>", None, True),
        ("<html><body>hi", None, True),
        ("  \n  <!doctype html>", None, True),
        ("﻿ <HTML>", None, True),
        ("<htmlx>", None, False),
        ("x <html>", None, False),
        ("just text", None, False),
        ("some", "/tmp/file.txt", False),
        ("some", "/tmp/html", False),
        ("some", "/tmp/a.html.bak", False),
        ("<html>", "/tmp/file.txt", True),
        ("", "", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, text string, path string, want boolean")
    got = df.withColumn("got", routing.looks_like_html(F.col("text"), F.col("path")))
    assert got.filter("got <> want").collect() == []


def test_route_order_and_rejects(spark):
    big = 52428801
    rows = [
        ("a.html", big, "\0<html>"),
        ("b.html", 10, "Hel\0o"),
        ("c.html", 52428800, "x"),
        ("d.txt", 5, "x" * 8192 + "\0"),
    ]
    limit = 52428800
    df = spark.createDataFrame(rows, "path string, length bigint, text string")
    df = routing.file_rejects(routing.route_files(df, max_bytes=limit), max_bytes=limit)
    got = {r.path: (r.route, r.error) for r in df.collect()}
    assert got["a.html"] == ("too_large", "File too large (50MB, max 50MB): a.html")
    assert got["b.html"] == ("binary", "Skipped binary file: b.html")
    assert got["c.html"] == ("html", None)
    # A NUL counts wherever it stands, unless only a prefix is asked about.
    assert got["d.txt"] == ("binary", "Skipped binary file: d.txt")
    good, bad = routing.split_rejects(df)
    assert (good.count(), bad.count()) == (1, 3)
    prefix = spark.createDataFrame(rows, "path string, length bigint, text string").select("path", routing.is_binary(F.col("text"), 8192).alias("b"))
    assert {r.path for r in prefix.collect() if r.b} == {"a.html", "b.html"}
    # Without a limit no file is too large.
    free = routing.route_files(spark.createDataFrame(rows, "path string, length bigint, text string"))
    assert free.filter("route = 'too_large'").count() == 0


def test_read_and_run_failures(spark):
    files = spark.createDataFrame([("a", 1, "x", None), ("b", 1, None, "gone")], "path string, length bigint, text string, why string")
    got = routing.file_rejects(routing.route_files(files), failure="why").collect()
    assert [r.error for r in got] == [None, "Error reading b: gone"]
    runs = spark.createDataFrame([("ls", 0, None), ("make", 2, None), ("nap", None, "timed out")], "command string, exit_code int, failure string")
    got = routing.command_rejects(runs).collect()
    assert [(r.exit_code, r.error) for r in got] == [(0, None), (2, None), (None, "Error executing nap: timed out")]


def test_page_rejects(spark):
    df = spark.createDataFrame([("u1", 200), ("u2", 404), ("u3", 299), ("u4", 301), ("u5", None)], "url string, status int")
    _, bad = routing.split_rejects(routing.page_rejects(df))
    assert {r.url: r.error for r in bad.collect()} == {
        "u2": "Error fetching u2: HTTP 404",
        "u4": "Error fetching u4: HTTP 301",
        "u5": "Error fetching u5: HTTP ?",
    }
    assert {r.url for r in tables.pages_scan(df).collect()} == {"u1", "u3"}


def test_files_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfok \xff end")
    (tmp_path / "b.bin").write_bytes(b"Hel\x00o")
    with open(tmp_path / "c.txt", "wb") as f:
        f.truncate(52428801)  # sparse
    rows = {os.path.basename(r.path): r for r in routing.route_files(tables.read_files(spark, str(tmp_path), max_bytes=52428800), max_bytes=52428800).collect()}
    assert rows["a.txt"].text == "﻿ok � end" and rows["a.txt"].route == "text"
    assert rows["b.bin"].route == "binary"
    assert rows["c.txt"].route == "too_large" and rows["c.txt"].text is None


def test_oversized_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = tables.read_files(spark, str(tmp_path), max_bytes=52428800)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,52428800)" in plan and "GreaterThan(length,52428800)" in plan


def test_command_output(spark):
    rows = [("out", "err"), ("out", ""), ("", "err"), ("out", None)]
    got = tables.command_output(spark.createDataFrame(rows, "stdout string, stderr string")).collect()
    assert [r.text for r in got] == ["out\n--- stderr ---\nerr", "out", "\n--- stderr ---\nerr", "out"]


def test_line_table(spark):
    df = spark.createDataFrame([("a", "a\nb\nc\nd\ne\n"), ("b", ""), ("c", "x" * 2500 + "\n" + "y" * 2000)], "k string, content string")

    def shown(**window):
        rows = lines.numbered(lines.line_table(df, **window)).orderBy("k", "line_no").collect()
        return {k: [r.shown for r in rows if r.k == k] for k in "abc"}

    everything = shown()
    assert everything["a"] == [f"     {i + 1}\t{c}" for i, c in enumerate(["a", "b", "c", "d", "e", ""])]
    assert everything["b"] == ["     1\t"]
    assert everything["c"] == ["     1\t" + "x" * 2500, "     2\t" + "y" * 2000]
    assert shown(max_line=2000)["c"] == ["     1\t" + "x" * 2000 + "...", "     2\t" + "y" * 2000]
    assert shown(offset=3)["a"][0] == "     3\tc"
    assert len(shown(limit=2)["a"]) == 2
    assert shown(offset=2, limit=2)["a"] == ["     2\tb", "     3\tc"]
    assert shown(offset=-4, limit=1)["a"] == ["     1\ta"]
    assert shown(offset=9)["b"] == []
