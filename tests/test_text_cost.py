"""Runs, addresses and instructions are read with few passes, with the same results as by a plain reading."""

import base64
import string

from pyspark.sql import functions as F

from siltscreen.functions import patterns as P
from siltscreen.functions import text as fn


def column(spark, use, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    return [r[1] for r in sorted(df.select("id", use(F.col("v")).alias("x")).collect(), key=lambda r: r[0])]


def test_runs_decode_as_by_a_plain_reading(spark):
    runs = ["", "6", "61", "616", "61 62,63;64", "0x6162", "\\x6162", "61 62", "616é", "é61", "6162,", "616,", "61x", "0X6"]
    digits = ["".join(c for c in r if c in string.hexdigits) for r in runs]
    assert [bytes(v) for v in column(spark, fn.hex_bytes, runs)] == [bytes.fromhex(d[: len(d) // 2 * 2]) for d in digits]
    runs = ["", "YQ==", "YWI=", "YWJj", "YWJjZ", "YWJjZA", "YWJjZA=", "=", "=="]
    bare = [r.rstrip("=") for r in runs]
    bare = [b[:-1] if len(b) % 4 == 1 else b for b in bare]
    assert [bytes(v) for v in column(spark, fn.base64_bytes, runs)] == [base64.b64decode(b + "=" * (-len(b) % 4)) for b in bare]


def test_hex_runs_and_their_gate(spark):
    pairs = "61 " * 20
    values = ["0x" + "61" * 20, "\\X" + "61" * 20, "x" + "61" * 19, "0x" + "61" * 19, pairs, "\\\\x" + "ab" * 21, "z0" + "0" * 39, "0x0x" + "61" * 20]
    found = [["0x" + "61" * 20], ["\\X" + "61" * 20], [], ["0x" + "61" * 19][:0], [pairs], ["\\x" + "ab" * 21], ["0" * 40], ["0x" + "61" * 20]]
    assert column(spark, lambda v: fn.matches(v, P.HEX_RUN), values) == found
    assert column(spark, lambda v: v.rlike(P.HEX_GATE), values) == [bool(f) for f in found]


def test_ports_and_white_space_of_addresses(spark):
    ports = ["", "0", "080", "65535", "65536", "0065535", "99999", "655350", "8a", "70000", "59999", "65529"]
    good = [p.isdigit() and int(p) <= 65535 or p == "" for p in ports]
    assert column(spark, fn.suspicious_url, [f"https://evil.example:{p}/?exfil=1" for p in ports]) == good
    assert column(spark, fn.suspicious_url, [" https://e.example/?ex\tfil=1\n", "https://e%78.example/?d%61ta", "https://e.example/?a=1+2&du%6Dp", "https://e.example/?+dump", None]) == [True, True, True, False, False]
    assert column(spark, fn.trim_ws, [" a b ", "a b", "﻿a\n", "", None]) == ["a b", "a b", "a", "", None]


def test_instructions_begin_a_word(spark):
    values = ["please IGNORE it", "xignore", "_forget", "-Forget", "İgnore", "nothing here", None]
    assert column(spark, fn.instruction_like, values) == [True, False, False, True, False, False, False]


def test_a_run_is_cleaned_once(spark):
    """A lambda evaluates what it mentions as often as it mentions it."""
    count = lambda made, part: made(F.col("v"))._jc.toString().count(part)
    assert count(fn.hex_bytes, "regexp_replace") == 1
    assert count(fn.base64_bytes, "rtrim") + count(fn.base64_bytes, "TRIM(TRAILING") <= 1
