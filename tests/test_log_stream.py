"""The log as a stream: an exactly-once sink, and a reader of files that grow."""

import os

import pyarrow.fs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltscreen import sanitize_text
from siltscreen.operators import reports
from siltscreen.sources import log as log_source
from siltscreen.sources import log_lines
from siltscreen.streaming import jobs


def line(source, size=4):
    return '{"tool":"safe_read","source":"%s","stripped":{"zeroWidthChars":2},"inputSize":%s,"outputSize":2,"durationMs":1}\n' % (source, size)


def test_replayed_batch_logs_no_line_twice(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a​{i}") for i in range(40)], "id int, text string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    source = F.concat(F.lit("f"), F.col("id").cast("string"))
    entries = reports.log_entries(sanitize_text(stream), F.lit("safe_read"), source)
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    log_source.log_stream_write(entries, path, checkpoint).awaitTermination()

    def logged():
        return sorted(r.source for r in log_source.log_rows(log_source.log_scan(spark, path)).collect())

    want = sorted(f"f{i}" for i in range(40))
    assert logged() == want
    # The process dies after the last batch's files and manifest are written, before the batch is committed.
    last = max((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    os.remove(f"{checkpoint}/commits/{last}")
    os.remove(f"{checkpoint}/commits/.{last}.crc")
    # A file of an attempt that failed is in no manifest.
    (tmp_path / "log" / "part-lost.json").write_text(line("lost"))
    log_source.log_stream_write(entries, path, checkpoint).awaitTermination()
    assert logged() == want
    summary = reports.log_summary(log_source.log_rows(log_source.log_scan(spark, path))).first()
    assert summary.requests == 40 and summary.total_input - summary.total_output == 3 * 40
    again = log_source.log_rows(log_source.log_stream(spark, path)).select("source")
    jobs.write_stream(again, str(tmp_path / "copy"), str(tmp_path / "copy-checkpoint")).awaitTermination()
    assert sorted(r.source for r in spark.read.parquet(str(tmp_path / "copy")).collect()) == want


def test_tail_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    (folder / "_manifest").write_text(line("hidden"))

    def run():
        tail = log_source.log_tail(spark, str(folder), pieceBytes="300").select("source", "_corrupt_record")
        jobs.write_stream(tail, out, checkpoint).awaitTermination()
        return sorted((r.source, r._corrupt_record is None) for r in spark.read.parquet(out).collect())

    with open(folder / "a.json", "w") as file:
        file.write("".join(line(f"a{i}") for i in range(20)) + line("half")[:30])
    want = sorted((f"a{i}", True) for i in range(20))
    assert run() == want  # the half-written line is held back
    assert run() == want
    with open(folder / "a.json", "a") as file:
        file.write(line("half")[30:] + "\n" + line("b", '"bad"') + line("c")[:-1])
    (folder / "new.json").write_text(line("n"))
    want = sorted([*want, ("half", True), ("b", False), ("n", True)])
    assert run() == want
    with open(folder / "a.json", "a") as file:
        file.write("\n")
    want = sorted([*want, ("c", True)])
    assert run() == want
    (folder / "a.json").write_text(line("anew"))  # shorter than before: it began anew
    assert run() == sorted([*want, ("anew", True)])


def test_tail_of_nothing(spark, tmp_path):
    (tmp_path / "log").mkdir()
    tail = log_source.log_tail(spark, str(tmp_path / "log"))
    jobs.write_stream(tail, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.schema(tail.schema).parquet(str(tmp_path / "out")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé", max_size=9), max_size=12), st.text("ab", max_size=5), st.integers(1, 9), st.integers(1, 7))
def test_every_finished_line_is_in_one_piece(tmp_path_factory, lines, tail, piece, block):
    """Whatever the sizes of pieces and blocks, lines come once and in order."""
    path = str(tmp_path_factory.mktemp("log") / "x")
    with open(path, "w", encoding="utf-8") as file:
        file.write("".join(x + "\n" for x in lines) + tail)
    old, log_lines.BLOCK_BYTES = log_lines.BLOCK_BYTES, block
    try:
        reader = log_lines.LogLinesReader(path, piece)
        end = reader.latestOffset()
        got = []
        for part in reader.partitions({}, end):
            got += [x for b in log_lines.lines_of(pyarrow.fs.LocalFileSystem(), part.value) for x in b["value"].to_pylist()]
    finally:
        log_lines.BLOCK_BYTES = old
    assert got == lines
