"""Ranked search, filter audit and language identification against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltscreen.llm import audit, language, queries, search
from siltscreen.llm.common import utf8

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, top=10):
    """docs: (id, text); items: (item, text) -> {item: [(rank, id, score)]}"""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = {}
    for item, wanted in asked.items():
        scored = []
        for d, b in bags:
            m = 100 - 90 + 90 * sum(b.values()) * n_docs // n_terms
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in wanted if t in b}
            score = sum(w * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, w in weight.items())
            if score > 0:
                scored.append((-score, d is None, d or 0))
        best = [(i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:top])]
        if best:
            out[item] = best
    return out


def searched(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return out


def corpus_rows(n=400):
    rng = random.Random(3)
    common, rare = [f"w{i}" for i in range(12)], [f"Rare{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    rows += [(7, rows[7][1]), (7, "w1 w2 rare7"), (n, None), (n + 1, ""), (n + 2, "... !"), (None, rows[3][1]), (None, "rare5 Ünï"), (n + 3, "ünï UNÏ ünï")]
    rows += [(1000 + i, "w1 w2 w3 rare1") for i in range(40)] + [(5000, " ".join(f"w{i % 12} long{i}" for i in range(9000)))]
    return rows


ITEMS = [(1, "w1 W2 rare1, rare5 rare5"), (2, "rare9 rare10 rare11 w0 w1 w2 w3 w4 w5"), (3, None), (4, ""), (5, "nowhere"), (6, "ÜNÏ ünï Ünï"), (2, "rare12"), (None, "w3 rare20"), (7, "long77 w1")]


def test_search_equals_brute_force(table):
    rows = corpus_rows()
    docs = table("doc_id bigint, text string, score string, _n int", [(*r, "x", 1) for r in rows]).repartition(5)
    items = table("item_id int, text string", ITEMS)
    want = brute_search(rows, ITEMS)
    assert searched(search.ranked(docs, items)) == want
    # Several blocks of queries, another number of results.
    assert searched(search.ranked(docs, items, top=3, block_pairs=4)) == brute_search(rows, ITEMS, 3)
    few = search.ranked(docs.drop("score", "_n"), items, top=1000)
    assert searched(few) == brute_search(rows, ITEMS, 1000)


def test_search_of_empty_tables_and_string_ids(table):
    docs, items = table("doc_id bigint, text string", []), table("item_id int, text string", ITEMS)
    assert search.ranked(docs, items).collect() == []
    some = table("doc_id bigint, text string", [(1, "w1")])
    assert search.ranked(some, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.ranked(some, items.limit(0)).collect() == []
    with pytest.raises(ValueError, match="whole numbers"):
        search.ranked(some.withColumn("doc_id", F.col("doc_id").cast("string")), items)


def test_awkward_documents_are_searched(awkward, table):
    items = table("item_id string, text string", [("a", "cat DOG 日本語"), ("b", "tail"), ("c", "number 42")])
    got = searched(search.ranked(awkward, items))
    assert got == brute_search([(r.doc_id, r.text) for r in awkward.collect()], [("a", "cat DOG 日本語"), ("b", "tail"), ("c", "number 42")])
    assert sorted(d for _, d, _ in got["a"]) == [1, 1, 6] and got["c"][0][1] is None


def test_skipping_loses_nothing():
    """Many spans, short and long lists, equal scores; and the walk does skip."""
    rng = np.random.default_rng(5)
    rows, vocabulary = 3000, 40
    share = np.concatenate([np.full(10, 0.5), np.full(30, 0.01)])
    hit = rng.random((rows, vocabulary)) < share
    place, term = np.nonzero(hit)
    tf = rng.integers(1, 5, len(place))
    n = np.full(rows, 30) + rng.integers(0, 3, rows)
    stats = search.Corpus(rows, int(n.sum()), rng.integers(0, 4, vocabulary) * 700 + 10)
    lists = search.Lists(n, np.searchsorted(place, np.arange(rows + 1)), term, tf, stats)
    for k in range(30):
        query = np.sort(rng.choice(vocabulary, 6, replace=False))
        adds = stats.weights[term] * (10**9 * tf // (1000 * tf + 8 * stats.lengths(n)[place]))
        total = np.bincount(place, np.where(np.isin(term, query), adds, 0), minlength=rows).astype(np.int64)
        order = [i for i in np.lexsort((np.arange(rows), -total))[:10] if total[i] > 0]
        places, scores = lists.best(query, 10)
        assert places.tolist() == order and scores.tolist() == total[order].tolist(), k


def test_shards_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 10)
    monkeypatch.setattr(search, "SHARD_ROWS", 7)
    rng = random.Random(1)
    batches = []
    for _ in range(6):
        lists = [list(range(rng.choice([0, 1, 3, 25]))) for _ in range(rng.randint(1, 9))]
        batches.append(pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array([len(x) for x in lists]), pa.array(lists, pa.list_(pa.int32()))], ["d", "n", "t"]))
    made = list(search.shards(iter(batches)))
    assert [x for t in made for x in t.column(2).to_pylist()] == [x for b in batches for x in b.column(2).to_pylist()]
    assert all(t.num_rows == 1 or (t.num_rows <= 7 and sum(map(len, t.column(2).to_pylist())) <= 10) for t in made)


def test_search_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    assert searched(queries.QUERIES["op11_lexical_search"](spark, SF)) == brute_search(docs, items)


# Filter audit


def brute_audit(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic) -> {(part, order, step): numbers}"""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        caps = sum("A" <= c <= "Z" for c in t)
        bad = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * caps > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and d > first[t],
        }
        mine = [x for x in labels if x[0] == d and d is not None]
        rows.append((s or "", {k for k, v in bad.items() if v}, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        share = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                kept = [r for r in left if x not in r[1]]
                failing = sum(x in r[1] for r in mine)
                share[x] += len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), failing - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_brute_force(awkward, table):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    rows += [(10, long, "a"), (11, long, "b"), (12, long, "a"), (9, long, "c"), (9, long, "c"), (9, long, "a"), (None, long, "a"), (13, "A B C #", "c"), (14, "same " * 300, "a"), (15, "SAME\x0b\x1cx " * 300, None), (16, "", "")]
    labels = [(1, 1, 0), (1, 0, 1), (9, 1, 1), (11, 0, 1), (12, 1, None), (None, 1, 1), (777, 1, 1), (14, None, 1)]
    docs = table("doc_id bigint, text string, source string, part string, n int, step int", [(*r, "x", 3, 4) for r in rows])
    got = audited(audit.filter_audit(docs, table("doc_id bigint, quality int, toxic int", labels)))
    assert got == brute_audit(rows, labels)


def test_audit_of_empty_tables(table, awkward):
    none = table("doc_id bigint, quality int, toxic int", [])
    assert audit.filter_audit(table("doc_id bigint, text string, source string", []), none).collect() == []
    got = audited(audit.filter_audit(awkward, none))
    assert len(got) == 3 * 600 and all(v[4] == v[5] == 0 for v in got.values())


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_kernel_solution_is_the_shapley_value(n):
    weights, divisor = audit.kernel_solution(n)
    for i in range(n):
        for c in range(1 << n):
            s = c.bit_count()
            share = Fraction(math.factorial(s - 1) * math.factorial(n - s), math.factorial(n)) if c >> i & 1 else -Fraction(math.factorial(s) * math.factorial(n - s - 1), math.factorial(n))
            assert Fraction(weights[i][c], divisor) == (share if c else 0), (i, c)


def test_audit_with_other_filters(table):
    docs = table("doc_id int, text string, source string", [(1, "a", "p"), (2, "b!", "p"), (3, "c!" * 9, "p"), (4, "c!" * 9, "q")])
    filters = [audit.Filter("X", lambda text, words, kinds: text.contains("!")), audit.Filter("Y", audit.COPY), audit.Filter("Z", lambda text, words, kinds: F.length(text) > 5)]
    got = audited(audit.filter_audit(docs, table("doc_id int, quality int, toxic int", [(4, 1, 1)]), filters))
    assert got["p", "XYZ", 1] == [1, 2, 0, 1, 0, 0, 9] and got["q", "ZYX", 1] == [0, 1, 0, 0, 1, 1, 2]
    assert len(got) == 2 * 18


def test_audit_shuffles_no_texts(spark):
    plan = queries.QUERIES["op13_filter_audit"](spark, SF)._jdf.queryExecution().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("_text" in line for line in exchanges) and "Python" not in plan and "InArrow" not in plan


# Language identification


def brute_grams(text):
    body = " " + "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in text.translate(LOWER)) + " "
    units = re.sub(rb" +", b" ", body.encode())
    return Counter(units[i : i + n] for n in (2, 3, 4) for i in range(len(units) - n + 1))


def test_gram_counts():
    texts = ["The cat, the CAT; 12 mats!", "", None, " 1 2 ", "Ünïcödé 日本語", "x", "a  b\n\tc"]
    data, offsets = utf8(pa.array(texts))
    found = language.count_grams(data, offsets)
    for i, t in enumerate(texts):
        want = Counter()
        for gram, n in brute_grams(t or "").items():
            # The sizes come in turn; only the gram's own size fits it once.
            _, bucket = list(language.grams(np.frombuffer(gram, np.uint8), np.zeros(len(gram), np.uint32)))[len(gram) - 2]
            want[int(bucket[0])] += n
        mine = found.rows == i
        assert dict(zip(found.buckets[mine].tolist(), found.counts[mine].tolist())) == dict(want), t


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(f"Wörd{i} ,; 17 x{'yz' * (i % 5)}" for i in range(300)) + "  "
    data, offsets = utf8(pa.array([text]))
    whole = language.count_grams(data, offsets)
    for step in (5, 64, 1000):
        monkeypatch.setattr(language, "STEP_BYTES", step)
        parts = language.count_grams(data, offsets)
        assert parts.buckets.tolist() == whole.buckets.tolist() and parts.counts.tolist() == whole.counts.tolist(), step


def test_languages_of_held_out_documents(spark):
    docs = queries.table(spark, LARGER, "documents")
    rows = queries.QUERIES["op12_language_id"](spark, LARGER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == docs.count()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_not_learned(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text", "lang")
    one = language.train(docs)
    other = language.train(docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))))
    assert one.languages == other.languages and np.array_equal(one.centroids, other.centroids) and np.array_equal(one.idf, other.idf)


def test_identify_equals_brute_force(spark, awkward):
    model = language.train(queries.table(spark, SF, "documents"))
    done = language.identify(awkward.withColumn("LANG_PRED", F.lit(1)), model, reject=False)
    assert [c for c in done.columns] == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "rejected"]
    rows = done.collect()
    assert len(rows) == 8
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, False)
            continue
        found = language.count_grams(*utf8(pa.array([r.text])))
        x = np.zeros(language.DIMENSIONS)
        x[found.buckets] = (1 + np.log(found.counts)) * model.idf[found.buckets]
        close = model.centroids @ (x / np.linalg.norm(x))
        best = int(close.argmax())
        assert r.lang_pred == model.languages[model.owners[best]] and abs(r.score - max(close[best], 0)) < 1e-9
        assert r.rejected == (r.score < model.least[model.owners[best]])
    strict = {r.text: r for r in language.identify(awkward, model).collect()}
    assert strict["Ünïcödé 日本語 \U0001f600"].lang_pred == "und" and strict["Ünïcödé 日本語 \U0001f600"].rejected
    assert strict["The cat sat on the mat and looked at the dog by the door."].lang_pred == "en"


def test_languages_of_empty_and_unlabelled_tables(table):
    none = table("doc_id bigint, text string, lang string", [])
    model = language.train(none)
    assert model.languages == [] and language.identify(none, model).collect() == []
    rows = table("doc_id bigint, text string, lang string", [(1, "some text", None), (None, None, "en"), (2, "", "")])
    assert [r.lang_pred for r in language.identify(rows, language.train(rows)).collect() if r.text] in (["und"], [""])


def test_sample_is_bounded_and_copies_are_one(table):
    rows = [(i % 3, "the same text over and over", "en") for i in range(300)] + [(1000 + i, f"der die das {i}", "de") for i in range(60)]
    model = language.train(table("doc_id bigint, text string, lang string", rows), rows=20)
    assert model.languages == ["de", "en"] and len(model.centroids) <= 2 * language.CENTROIDS
    done = language.identify(table("doc_id bigint, text string", [(1, "das der die"), (2, "the text over")]), model, reject=False)
    assert [r.lang_pred for r in done.orderBy("doc_id").collect()] == ["de", "en"]
