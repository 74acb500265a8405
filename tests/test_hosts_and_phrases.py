"""Hosts against a plain parser, and many phrases against one after the other."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from siltscreen.functions import hosts
from siltscreen.functions.text import suspicious_url
from siltscreen.operators import delimiters


def run(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    return [r[1] for r in sorted(df.select("id", fn(F.col("v")).alias("x")).collect())]


def test_addresses_with_hosts_that_cannot_be_read(spark):
    bad = ["256.256.256.256", "1.2.3.4.5", "0x100000000", "foo.09", "[1:2]", "xn--a", "​", "1.2.3.08", "a..0x", "[::1::2]", "[1:2:3:4:5:6:7:8:9]", "[:1]", "xn--", "xn--a-"]
    good = ["1.2.3.4", "1.2.3.4.", "0x7f.1", "017700000001", "4294967295", "a.example", "[::1]", "[::ffff:1.2.3.4]", "[1:2:3:4:5:6:7:8]", "xn--mnchen-3ya.example", "XN--BCHER-KVA.example", "a_b.example", "1.2.3.x", "9a"]
    urls = [f"https://{h}/?exfil=1" for h in bad + good]
    assert run(spark, suspicious_url, urls) == [False] * len(bad) + [True] * len(good)


def test_numbers_and_groups_against_a_plain_parser(spark):
    rng = random.Random(4)
    groups = lambda: ":".join(rng.choice(["0", "1f", "abcd", "12345", "", "g"]) if rng.random() < 0.3 else f"{rng.randrange(65536):x}" for _ in range(rng.choice([6, 7, 8, 8, 8, 9])))
    values = [groups() for _ in range(150)] + ["::", "::1", "1::", "1::2", "1:2::3:4:5:6:7", "::1.2.3.4", "::1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "1.2.3.4", "1:2:3:4:5:6:7::"]

    def known(v):
        try:
            ipaddress.IPv6Address(v)
            return True
        except ValueError:
            return False

    assert run(spark, hosts.valid_ipv6, [f"[{v}]" for v in values]) == [known(v) for v in values]


def test_bootstring_against_the_interpreter(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcz09-éüßжя日本語한") for _ in range(rng.randint(1, 12))) for _ in range(120)] + ["\U0001f600a", "ü", "bücher", "zzzéz"]
    names = [n for n in names if not n.isascii()]
    labels = ["xn--" + n.encode("punycode").decode() for n in names]
    assert run(spark, hosts.decoded_label, labels) == [[ord(c) for c in n] for n in names]
    assert run(spark, hosts.decoded_label, ["xn--99999999999", "xn--a_b", "xn--abc-"]) == [None] * 3


def one_by_one(text, phrases):
    count = 0
    for p in phrases:
        text, n = re.subn(re.escape(p), "", text, flags=re.IGNORECASE)
        count += n
    return text, count


def test_many_phrases_equal_one_after_the_other(spark):
    rng = random.Random(6)
    phrases = tuple(dict.fromkeys("".join(rng.choice("abAB ") for _ in range(rng.randint(1, 5))) for _ in range(60))) + ("aaaa", "É", "straße")
    texts = ["".join(rng.choice("abcABC éÉ") for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["", "STRASSE straße", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.text, r.custom_patterns) for r in delimiters.custom_patterns(df, phrases).collect()}
    assert got == {i: (None, None) if t is None else one_by_one(t, phrases) for i, t in enumerate(texts)}
    few = phrases[:10]
    want = {r.id: (r.text, r.custom_patterns) for r in delimiters.custom_patterns(df, few).collect()}
    assert want == {i: (None, None) if t is None else one_by_one(t, few) for i, t in enumerate(texts)}


def test_phrases_of_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("b", 2), ("a", 1), (None, 0), ("b", 0), ("", 5), ("c", 2)], "phrase string, rank int")
    assert delimiters.phrase_list(table) == ("b", "a", "c") and delimiters.phrase_list(table.limit(0)) == ()
    monkeypatch.setattr(delimiters, "MOST_PHRASES", 2)
    with pytest.raises(ValueError, match="3 phrases"):
        delimiters.phrase_list(table)
