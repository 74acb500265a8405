"""Quality, toxicity, decontamination, URL lists and sharding."""

import datetime as dt
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siltscreen.llm import decontaminate, quality, queries, sharding, toxicity, urls

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# Decontamination


def hits(text, items, n=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        for k in range(max(len(x) - n + 1, 1 if x else 0)):
            window = x[k : k + n]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
    return hit, found


ITEMS = [
    ("a", "Zebra one two three four five six seven eight nine ten eleven"),
    ("b", "short item"),
    ("c", "Zebra one two three four five six seven eight nine other end"),
    ("d", ""),
    ("e", None),
    ("f", "...!"),
    ("g", "één twee, één twee! één twee één twee één twee één twee"),
    ("b2", "SHORT--ITEM"),
]


@pytest.fixture
def items(table):
    return table("item_id string, text string", ITEMS)


def check_spans(rows, texts):
    for r in rows:
        hit, found = hits(texts[r.doc_id], [(i, t) for i, t in ITEMS])
        covered = [k for s in r.hit_spans for k in range(s.start, s.stop)]
        assert covered == sorted(hit) and set(r.hit_items) == found and r.n_words == len(words(texts[r.doc_id]))
        w = words(texts[r.doc_id])
        for m in r.matches:
            x = words(dict(ITEMS)[m.item_id])
            assert w[m.doc_word : m.doc_word + m.n_words] == x[m.item_word : m.item_word + m.n_words]
            # Neither side can be longer.
            after = (w[m.doc_word + m.n_words : m.doc_word + m.n_words + 1], x[m.item_word + m.n_words : m.item_word + m.n_words + 1])
            assert not after[0] or after[0] != after[1]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 70])
def test_leaks_equal_brute_force(table, items, block, monkeypatch):
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", (block,))
    rng = random.Random(2)
    texts = {}
    for k in range(80):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = words(rng.choice(ITEMS)[1]) or ["x"]
            a = rng.randrange(len(w))
            parts.append(rng.choice([" ", ", ", "-"]).join(w[a if rng.random() < 0.5 else 0 : rng.randint(a, len(w)) if rng.random() < 0.4 else len(w)]))
        texts[k] = rng.choice(["", "Filler "]) + " ".join(parts)
    texts[100] = None
    rows = decontaminate.leaks(table("doc_id bigint, text string, hit_items string", [(k, t, "old") for k, t in texts.items()]), items).collect()
    assert len(rows) == len(texts)
    check_spans(rows, texts)
    if block == decontaminate.BLOCK_BYTES:
        assert any(m.n_words == 12 for r in rows for m in r.matches)


def test_decontaminated_keeps_rows_and_columns(table, items, awkward):
    bad = table("doc_id bigint, text string, lang string, source string, n_chars bigint, score string", [(9, "a SHORT item here", None, None, None, None)])
    docs = awkward.union(bad).withColumn("matches", F.lit(1))
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("doc_id is null or doc_id <> 9").collect()))
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.decontaminated(docs.limit(0), items).collect() == []


def test_query_op5(spark):
    found = {r.item_id: r.text for r in queries.table(spark, SF, "benchmark").collect()}
    windows = {}
    for i, t in found.items():
        w = words(t)
        for k in range(max(len(w) - 9, 1 if w else 0)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.QUERIES["op5_benchmark_decontamination"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w, hit, names = words(texts[r.doc_id]), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    names |= own
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(names), digest, bool(hit))


# Models


def labelled(spark):
    docs, labels = queries.table(spark, LARGER, "documents"), queries.table(spark, LARGER, "labels")
    return docs, labels, {r.doc_id: r for r in labels.collect()}


def test_query_op9_on_held_out_labels(spark):
    rows = queries.QUERIES["op9_toxicity"](spark, LARGER).collect()
    _, _, known = labelled(spark)
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, known[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in known]
    good = [s for s, y in held if y == 0]
    bad = [s for s, y in held if y == 1]
    assert np.mean([b > g for b in bad for g in good]) > 0.85
    assert sum(s >= 0.3 for s in good) <= 0.05 * len(good)


def test_toxicity_learns_words_and_their_forms():
    rng = np.random.default_rng(0)
    plain, rude = [f"plain{i}" for i in range(300)], [f"grumpf{i}" for i in range(40)]
    texts, labels = [], []
    for k in range(500):
        w = list(rng.choice(plain, rng.integers(5, 60)))
        if k % 5 == 0:
            w[rng.integers(len(w))] = rude[rng.integers(20)]
        texts.append(" ".join(w))
        labels.append(int(k % 5 == 0))
    parts = lambda t: _parts(toxicity, t)
    model = toxicity.fit([parts(t) for t in texts], np.array(labels), [None] * 500)
    new = [" ".join([*rng.choice(plain, 200), *([rude[30 + k]] if k % 2 else [])]) for k in range(10)]
    p = toxicity.score_words(model, *_flat([parts(t) for t in new]))
    assert (p[1::2] > 0.5).all() and (p[::2] < 0.3).all()


def _parts(module, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    found = module.words(raw, np.array([0, len(raw)]))
    return module.word_parts(raw, found.starts, found.ends)


def _flat(parts):
    return np.concatenate(parts), np.arange(sum(map(len, parts))), np.cumsum([0, *map(len, parts)])


def test_responses_stop_at_a_texts_end():
    places = [np.array([[1.0], [2.0], [4.0]], np.float32), np.array([[10.0], [20.0], [40.0]], np.float32)]
    best, _ = toxicity._responses(places, np.zeros(1, np.float32), np.array([0, 2, 3]), np.array([2, 1, 0]))
    # Text one: 1 + 20 and 2; text two: 4; text three has no words.
    assert best[:, 0].tolist() == [21, 4, 0]


def test_models_of_no_or_one_label(spark, table, awkward):
    none = table("doc_id bigint, quality int, toxic int", [])
    one = table("doc_id bigint, quality int, toxic int", [(1, 1, 0), (4, 1, 0), (None, 0, 1), (6, None, None)])
    for labels in (none, one):
        model = toxicity.train(awkward, labels)
        rows = toxicity.score(awkward, model).collect()
        assert len(rows) == 8 and len({r.score for r in rows}) == 1
        assert toxicity.civil(awkward, model).columns == awkward.columns
        good = quality.good_documents(awkward, quality.train(awkward, labels))
        assert good.columns == awkward.columns and good.count() == 8
    assert quality.good_documents(awkward.limit(0), quality.train(awkward, none)).collect() == []
    assert toxicity.civil(awkward.limit(0), toxicity.train(awkward, none)).collect() == []


def test_query_op1_on_held_out_labels(spark):
    rows = queries.QUERIES["op1_quality_classifier"](spark, LARGER).collect()
    _, _, known = labelled(spark)
    held = [(r.good, known[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in known]
    assert len(rows) == 1000 and np.mean([g == bool(y) for g, y in held]) > 0.95
    assert all(g for g, y in held if y == 1)


def test_copies_of_one_id_displace_no_other_label(table, monkeypatch):
    rows = [(i, f"Plain {i} sentence about gardens, rivers and towns." if i % 2 else f"VILE {i} TRASH!!! $$$ 000 |||", "en") for i in range(40)]
    known = [(i, i % 2, 1 - i % 2) for i in range(40)]
    first = min((r for r in table("doc_id bigint", [(i,) for i in range(40)]).select("doc_id", F.xxhash64("doc_id").alias("h"), quality.held_out(F.col("doc_id")).alias("o")).collect() if not r.o), key=lambda r: r.h).doc_id
    docs = table("doc_id bigint, text string, lang string", rows + [rows[first]] * 30)
    labels = table("doc_id bigint, quality int, toxic int", known + [known[first]] * 30)
    plain = table("doc_id bigint, text string, lang string", rows), table("doc_id bigint, quality int, toxic int", known)
    for module in (quality, toxicity):
        learned = []
        monkeypatch.setattr(module, "fit", lambda x, y, *more, seen=learned: seen.append(sorted(y.tolist())))
        module.train(docs, labels, rows=25)
        module.train(*plain, rows=25)
        assert learned[0] == learned[1] and set(learned[0]) == {0, 1} and len(learned[0]) == 25


def test_sites_are_shrunk_by_their_rows(table):
    rows = [("big", "p", 0.2)] * 400 + [("big", "q", 0.9)] * 100 + [("mid", "p", 0.8)] * 300 + [("tiny", "p", 0.05)]
    scored = table("_host string, _path string, _p double", rows)
    known = quality.sites(scored)
    p = np.array([r[2] for r in rows])
    assert known.mean == pytest.approx(p.mean())
    found = {(r._host, r._path): r for r in known.paths.collect()}
    k0, k1 = known.host_strength, known.path_strength
    for host in ("big", "mid", "tiny"):
        own = [r[2] for r in rows if r[0] == host]
        assert found[host, "p"]._host_mean == pytest.approx((sum(own) + k0 * known.mean) / (len(own) + k0))
    # A single row moves its site less than many do.
    assert abs(found["tiny", "p"]._host_mean - known.mean) < abs(0.05 - known.mean) / 1.5
    out = quality.posterior(scored.withColumn("_odds", F.lit(0.0)), known, 0.0).collect()
    big = next(r for r in out if r._host == "big" and r._path == "q")
    assert big.site_prior == pytest.approx((0.9 * 99 + k1 * found["big", "q"]._host_mean) / (99 + k1))
    assert 0.5 < big.posterior < 1


def test_url_sites(table):
    df = table("u string", [("https://User@Host.Example.org:8080/en/1?x",), ("http://a.example",), ("nothing",), (None,)])
    assert [tuple(r) for r in df.select(*quality.url_sites(F.col("u"))).collect()] == [("host.example.org", "en"), ("a.example", ""), ("", ""), (None, None)]


def test_features_of_odd_texts():
    x = quality.features(pa.array(["", None, "a", "  ", "é" * 10_000, "x | y | z\n" * 5], pa.string()))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()


# URL lists


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_listed_captures(table):
    entries = table(
        "list string, kind string, value string, dated timestamp, listed boolean",
        [
            ("spam", "domain", "bad.example", at(10), True), ("spam", "domain", "bad.example", at(12), True), ("spam", "domain", "bad.example", at(20), False),
            ("spam", "domain", "bad.example", at(30), True), ("ads", "host", "x.bad.example", at(15), True), ("abuse", "prefix", "ok.example/a/b", at(0), True),
            ("phish", "url", "ok.example/a/b/c?q=1", at(0), True), ("tie", "host", "t.example", at(5), False), ("tie", "host", "t.example", at(5), True),
            ("spam", "domain", None, at(1), True), ("spam", "domain", "late.example", None, True),
        ],
    )
    rows = [
        (1, "http://x.bad.example/p", at(9), ()), (2, "http://x.bad.example/p", at(10), ("spam",)), (3, "HTTP://u@X.BAD.example.:80/p", at(16), ("ads", "spam")),
        (4, "http://x.bad.example/p", at(20), ("ads",)), (5, "http://bad.example", at(400), ("spam",)), (6, "http://notbad.example", at(400), ()),
        (7, "https://ok.example/a/b/c?q=1#f", at(3), ("abuse", "phish")), (8, "https://ok.example/a/bc", at(3), ()), (9, "https://t.example/", at(5), ("tie",)),
        (10, None, at(3), ()), (11, "http://bad.example", None, ()), (12, "no address", at(3), ()), (12, "no address", at(3), ()), (13, "http://late.example/" + "a/" * 3000, at(3), ()),
    ]
    captures = table("id int, url string, fetched_at timestamp, lists string", [(i, u, t, "old") for i, u, t, _ in rows])
    found = urls.listed_captures(captures, entries).collect()
    assert sorted((r.id, tuple(r.lists)) for r in found) == sorted((i, want) for i, _, _, want in rows)
    assert all(r.blocked == bool(r.lists) and r.n_entries == len(r.lists) for r in found)
    assert {r.listed_since for r in found if r.id == 5} == {at(30)} and {r.listed_since for r in found if r.id == 2} == {at(10)}
    assert not any(r.blocked for r in urls.listed_captures(captures, entries.limit(0)).collect())
    assert urls.listed_captures(captures.limit(0), entries).collect() == []


def brute_lists(entries, captures):
    """(address, time) -> lists that hold the host then, by walking all entries in order."""
    out = {}
    for url, when in set(captures):
        state = {}
        for name, _, host, dated, listed in sorted(entries, key=lambda e: (e[3], e[4])):
            if dated <= when and url == f"http://{host}/":
                state[name] = listed
        out[url, when] = sorted(k for k, v in state.items() if v)
    return out


def test_as_of_join_equals_brute_force(table, monkeypatch):
    rng = random.Random(1)
    entries = [("l%d" % rng.randrange(3), "host", "h%d.example" % rng.randrange(4), at(rng.randrange(100)), rng.random() < 0.6) for _ in range(300)]
    asked = [("http://h%d.example/" % rng.choice([0, 0, 0, 1, 2, 3, 4]), at(rng.randrange(110))) for i in range(400)]
    want = brute_lists(entries, asked)
    captures = table("url string, fetched_at timestamp", asked)
    dated = table("list string, kind string, value string, dated timestamp, listed boolean", entries)
    for rows, small in ((200_000, True), (3, True), (1, False)):
        monkeypatch.setattr(urls, "PART_ROWS", rows)
        if not small:
            monkeypatch.setattr("siltscreen.llm.common.is_small", lambda _: False)
        found = urls.listed_captures(captures, dated).collect()
        assert len(found) == 400 and all(r.lists == want[r.url, r.fetched_at] for r in found)


def test_a_key_with_many_states(spark, table):
    """One host changes state 100,000 times; no window of the join sees more than an hour of it."""
    n = 100_000
    entries = spark.range(n).selectExpr("'l' list", "'host' kind", "'h.example' value", "timestamp_seconds(1700000000 + id * 7) dated", "id % 2 = 0 listed")
    captures = spark.range(500).selectExpr("id", "'http://h.example/x' url", "timestamp_seconds(1700000003 + id * 1387) fetched_at")
    found = urls.listed_captures(captures, entries)
    for r in found.collect():
        state = (r.id * 1387 + 3) // 7
        assert r.blocked == (state % 2 == 0) and r.n_entries == r.blocked, r
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window " in line]
    assert all("_slot" in line for line in windows)
    hours = urls.intervals(entries).groupBy(F.date_trunc(urls.SLOT, "since")).count().agg(F.max("count")).first()[0]
    assert hours <= 515


def test_every_event_is_an_entry(spark):
    pages, events = queries.table(spark, SF, "pages"), queries.table(spark, SF, "events")
    entries = queries.url_entries(pages.select("page_id", "url"), events)
    assert entries.count() == events.count()
    assert urls.intervals(entries).groupBy("list", "kind", "value").count().filter("count > 1 and kind = 'url'").count() > 0


def test_op3_runs_without_python(spark):
    plan = queries.QUERIES["op3_url_filters"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Sharding


def spread(rows, shards):
    out = {k: [] for k in range(shards)}
    for r in rows:
        out[r.shard].append(r)
    for own in out.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in own) for own in out.values()]


def test_query_op10(spark):
    rows = queries.QUERIES["op10_histogram_sharding"](spark, LARGER).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, LARGER, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    sizes = spread(rows, 24)
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_a_hot_text_is_cut_and_small_groups_are_not(table):
    docs = [(i, "hot text of a third of all rows") for i in range(400)] + [(1000 + i, f"text {i // 2} " + "x" * (i % 50)) for i in range(600)]
    df = table("doc_id bigint, text string, slot string", [(*d, "old") for d in docs]).repartition(7)
    rows = sharding.shard(df, shards=8, range_bytes=2000).collect()
    sizes = spread(rows, 8)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8 + 2 * max(r.size for r in rows)
    cut = {}
    for r in rows:
        cut.setdefault(r.text, set()).add(r.shard)
    assert len(cut["hot text of a third of all rows"]) >= 3
    assert sum(len(s) > 1 for t, s in cut.items() if t.startswith("text")) <= 7


def key_of(text, row):
    """The 128-bit key as two signed numbers, by the xxhash library; Spark's hash starts from 42 and passes nulls by."""
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    high = 42 if text is None else signed(xxhash.xxh64_intdigest(text.encode(), 42))
    low = 42 if row is None else xxhash.xxh64_intdigest(str(row).encode(), 42)
    return high, signed(xxhash.xxh64_intdigest(b"row", low))


@pytest.mark.parametrize(("sf", "shards"), [(SF, 5), (LARGER, 24)])
def test_shards_equal_brute_force(spark, sf, shards):
    docs = queries.table(spark, sf, "documents").select("doc_id", "text")
    found = sorted((r.shard, r.slot, key_of(r.text, r.doc_id), r.size, r.text) for r in sharding.shard(docs, shards=shards).collect())
    keys = [f[2] for f in found]
    assert keys == sorted(key_of(r.text, r.doc_id) for r in docs.collect())  # the order of shards and slots is that of the keys
    total = sum(f[3] for f in found)
    ends = np.cumsum([f[3] for f in found])
    edges = np.append(0, ends)
    differ = np.array([True, *[a[2][0] != b[2][0] for a, b in zip(found, found[1:])], True])
    for cut in range(1, shards):
        at = sum(f[0] < cut for f in found)
        place = cut * total / shards
        assert differ[at]  # no text's rows are in two shards: no group is large here
        nearest = np.abs(edges[differ] - place).min()
        assert abs(edges[at] - place) <= max(nearest, sharding.TOLERANCE * total / shards) + 1e-6


def test_small_groups_share_a_shard_and_large_ones_are_cut(table):
    docs = [(i, f"pair {i // 2} " + "x" * 200) for i in range(2000)] + [(5000 + i, "hot " * 50) for i in range(900)]
    rows = sharding.shard(table("doc_id bigint, text string", docs), shards=6).collect()
    where = {}
    for r in rows:
        where.setdefault(r.text, set()).add(r.shard)
    assert len(where.pop("hot " * 50)) >= 2 and all(len(s) == 1 for s in where.values())
    sizes = spread(rows, 6)
    assert max(sizes) - min(sizes) <= 0.1 * sum(sizes) / 6


def test_ranges_and_probes_are_bounded(table, monkeypatch):
    tera = 100 << 40
    assert sharding.number_of_ranges(tera, 24, sharding.RANGE_BYTES) == sharding.RANGES // 24 * 24
    assert sharding.number_of_ranges(tera, 100, 1 << 30) == 65_500 and sharding.number_of_ranges(0, 24, 10) == 24
    with pytest.raises(ValueError, match="shards"):
        sharding.number_of_ranges(tera, 100_000, 1 << 30)
    # With few ranges and probes allowed, every round still counts at no more places than that.
    monkeypatch.setattr(sharding, "RANGES", 64)
    monkeypatch.setattr(sharding, "PROBES", 256)
    monkeypatch.setattr(sharding, "FIRST_BITS", 8)
    df = table("doc_id bigint, text string", [(i, f"text {i}") for i in range(3000)])
    seen = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    rows = sharding.shard(df, shards=8, range_bytes=10).collect()
    assert len(seen) > 2 and max(map(len, seen[:-1])) <= 256
    sizes = spread(rows, 8)
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_shards_of_awkward_rows(awkward):
    rows = sharding.shard(awkward.withColumn("size", F.lit("old")), shards=3).collect()
    assert len(rows) == 8
    spread(rows, 3)
    assert {r.size for r in rows if r.text is None} == {8}
    assert sharding.shard(awkward.limit(0), shards=3).collect() == []


def test_op10_runs_without_python(spark):
    plan = queries.QUERIES["op10_histogram_sharding"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
