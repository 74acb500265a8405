"""BPE encoding, packing and edit-aware counts against the tokenizers library and brute force."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltscreen.llm import bpe, edits, packing, queries
from siltscreen.llm.lexicon import Lexicon, compiled

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(PATH)
V = bpe.read_vocabulary(PATH)


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def got(texts, lexicon=None):
    ids, bounds = bpe.encode_texts(texts, V, lexicon)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def lexicon_of(words):
    words = sorted(set(words))
    raw = [w.encode() for w in words]
    ids, bounds = bpe.merged(V, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return Lexicon(compiled(words, ids, bounds)), words


TEXTS = [
    "", None, "It's 'tis ''s we'll I'D x'S 'LL o'm'm 's't rock'n'roll '", "<|endoftext|>Hi<|startoftext|><|endoftext",
    "ΑΣ ΣΑΣ. ΌΣ", "é İstanbul ﬁ Å", "日本語 123 四五 ½ ²", "a" * 700 + " " + "ab" * 300, "\U0001f600\U0001f603 x‍y",
    "\x00\x1c\x85z　q", "a b  c\n\nd",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_decoded_text_match_the_library(text):
    ids = got([text])[0]
    assert ids == want(text)
    data, bounds = bpe.decode_ids(np.array(ids, np.int64), np.array([0, len(ids)]), V)
    assert data.tobytes().decode() == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abest' \n'smldrvté1٣!?<|>ΣßÅ漢́"), max_size=40), max_size=6))
def test_any_text(texts):
    lexicon, _ = lexicon_of(["best", "a", "s", "t", "best's"])
    assert got(texts) == got(texts, lexicon) == [want(t) for t in texts]


def test_lexicon_numbers_words_in_order_and_shares_suffixes():
    lexicon, words = lexicon_of(["car", "cars", "cat", "cats", "bar", "bars", "bat", "bats", "é", ""])
    words = [w for w in words if w]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0, *map(len, words)])
    assert lexicon.find(codes, bounds[:-1], bounds[1:]).tolist() == list(range(1, len(words) + 1))
    # b and c lead to the same states: root, after b or c, after a, after r or t, after s (and é).
    assert len(lexicon.final) == 5
    other = np.frombuffer("ca".encode("utf-32-le") + "carsx".encode("utf-32-le"), np.uint32)
    assert lexicon.find(other, np.array([0, 2]), np.array([2, 7])).tolist() == [-1, -1]


def test_vocabulary_words_encode_to_one_token(spark):
    words = bpe.vocabulary_words(PATH)
    assert len(words) > 20_000
    v, lexicon = bpe.vocabulary_encoder(spark, PATH).parts()
    sample = words[::501]
    assert [len(i) for i in got(sample, lexicon)] == [len(want(w)) for w in sample]


def test_no_words_at_all():
    lexicon, _ = lexicon_of([])
    assert got(["a b"], lexicon) == [want("a b")]


def test_encode_and_decode_awkward_rows(awkward):
    clash = awkward.withColumn("ids", F.lit("old")).withColumn("decoded", F.lit(1))
    encoder = bpe.make_encoder(clash, PATH, lexicon_size=50)
    rows = bpe.decode(bpe.encode(clash, encoder), encoder, packed="packed").collect()
    texts = {r.doc_id: r.text for r in awkward.collect()}
    assert len(rows) == 8
    for r in rows:
        ids = want(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.packed == struct.pack(f"<{len(ids)}I", *ids)
        assert r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    empty = clash.limit(0)
    assert bpe.encode(empty, bpe.make_encoder(empty, PATH)).collect() == []


def test_long_words_stay_out_of_the_lexicon(table):
    long, edge = "é" * 40 + "xyz" * 3000, "ab" * 32
    docs = table("doc_id bigint, text string", [(i, f"{long} short {edge} {edge}c") for i in range(20)])
    assert sorted(bpe.lexicon_words(docs, "text", V, 100)) == [edge, "short"]
    encoder = bpe.make_encoder(docs, PATH)
    assert encoder.parts()[1].longest == 64
    assert all(r.ids == want(f"{long} short {edge} {edge}c") for r in bpe.encode(docs, encoder).collect())


def test_query_op7(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.QUERIES["op7_bpe_encode_decode"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = want(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_best_fit_decreasing_matches_a_plain_search():
    rng = np.random.default_rng(3)
    for length in (1, 7, 64, 100):
        sizes = rng.integers(1, length + 1, 300)
        rooms, place = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            fits = [(room, k) for k, room in enumerate(rooms) if room >= sizes[i]]
            k = min(fits)[1] if fits else len(rooms)
            if not fits:
                rooms.append(length)
            rooms[k] -= sizes[i]
            place[i] = k
        found, n = packing.best_fit(sizes, length)
        # Rows with equal room may be taken in another order; the rooms left are the same.
        assert n == len(rooms)
        assert sorted(length - np.bincount(found, weights=sizes, minlength=n)) == sorted(rooms)


def unpacked(rows, length):
    """Pieces by document, checked against ends and positions."""
    out = {}
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(places) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert len(r.cu_seqlens) == len(r.segments) + 1
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a)) and b - a == s.n_tokens
            out.setdefault(s.doc, []).append((s.start, ids[a:b].tolist()))
        assert not places[r.n_tokens :].any() and (ids[r.n_tokens :] == 9).all()
    return out


def test_packing_is_lossless(awkward):
    encoder = bpe.make_encoder(awkward, PATH)
    pieces = unpacked(packing.pack(awkward, encoder, length=64, pad=9).collect(), 64)
    for doc, text in {r.doc_id: r.text for r in awkward.collect()}.items():
        times = 2 if doc == 1 else 1
        found = sorted(pieces.get(doc, []))
        assert [i for _, part in found[::times] for i in part] == want(text)
    assert packing.pack(awkward.limit(0), encoder).collect() == []


def test_packed_rows_survive_a_file(awkward, tmp_path, spark):
    packed = packing.pack(awkward, bpe.make_encoder(awkward, PATH), length=64)
    packing.write_packed(packed, f"{tmp_path}/packed")
    assert spark.read.parquet(f"{tmp_path}/packed").count() == packed.count()


def test_query_op6(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.QUERIES["op6_token_packing"](spark, SF).collect()
    held = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:]):
            held.setdefault(s.doc, {})[s.start] = ids[a:b].tolist()
    assert {d: [i for k in sorted(p) for i in p[k]] for d, p in held.items()} == {d: want(t) for d, t in texts.items() if want(t)}
    assert sum(r.n_tokens for r in rows) / (2048 * len(rows)) > 0.9


def apply_plainly(text, changes):
    limit = len(text)
    for start, stop, new in sorted(changes, key=lambda e: e[0])[::-1]:
        start = min(max(0, start), limit)
        stop = min(max(start, stop), limit)
        text, limit = text[:start] + new + text[stop:], start
    return text


def test_edited_counts_equal_counts_from_scratch():
    rng = random.Random(5)
    alphabet = "ab c'stΣé́ \n<1"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 300, 3000]))) + rng.choice(["", "<|endoftext|>"])
        cuts = [*edits.leaves(text), len(text)]
        counts = np.array([len(want(text[a:b])) for a, b in zip(cuts, cuts[1:])])
        assert counts.sum() == len(want(text))
        chars, tokens = edits.build(np.diff(cuts), counts)
        changes = []
        for _ in range(rng.randint(0, 4)):
            start = rng.randint(-2, len(text) + 2)
            changes.append((start, start + rng.choice([0, 1, 5, 900]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 7])))))
        new, regions = edits.edited(text, chars, [{"start": a, "stop": b, "text": t} for a, b, t in changes])
        half = len(chars) // 2
        for r in regions:
            for leaf in range(r.low, r.high + 1):
                edits.update(chars, half + leaf, len(r.text) if leaf == r.low else 0)
                edits.update(tokens, half + leaf, len(want(r.text)) if leaf == r.low else 0)
        assert new == apply_plainly(text, changes)
        assert chars[1] == len(new) and tokens[1] == len(want(new))


def test_second_edits_use_the_updated_tree(awkward):
    encoder = bpe.make_encoder(awkward, PATH)
    plan = lambda a, b, t: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(t).alias("text")))
    counted = edits.count_trees(awkward.withColumn("edits", plan(5, 9, "dog's")).withColumn("tree", F.lit("old")), encoder)
    once = edits.apply_edits(counted, encoder)
    twice = edits.apply_edits(once.withColumn("edits", plan(2000, 2500, " x")), encoder)
    none = edits.apply_edits(twice.withColumn("edits", F.lit(None).cast("array<struct<start:int,stop:int,text:string>>")), encoder)
    before = {r.doc_id: r.text or "" for r in awkward.collect()}
    rows = none.collect()
    assert len(rows) == 8
    for r in rows:
        text = apply_plainly(apply_plainly(before[r.doc_id], [(5, 9, "dog's")]), [(2000, 2500, " x")])
        assert r.text == text and r.n_tokens == len(want(text)) and r.n_encoded == 0


def tree_after(text, chars, tokens, changes):
    new, regions = edits.edited(text, chars, [{"start": a, "stop": b, "text": t} for a, b, t in changes])
    known = []
    for r in regions:
        own = edits.pieces(r)
        known.append((r, [len(p) for p in own], [len(want(p)) for p in own]))
    assert new == apply_plainly(text, changes)
    return new, *edits.renewed(chars, tokens, known)


def first_tree(text):
    cuts = [*edits.leaves(text), len(text)]
    return edits.build(np.diff(cuts), np.array([len(want(text[a:b])) for a, b in zip(cuts, cuts[1:])]))


def test_leaves_stay_short_under_many_edits():
    rng = random.Random(6)
    text = "some words of a text, and more. " * 80
    chars, tokens = first_tree(text)
    for k in range(3000):
        at = rng.randrange(len(text) + 1) if k % 3 else 700  # every third one meets the same place
        text, chars, tokens = tree_after(text, chars, tokens, [(at, at + (k % 11 == 0) * 30, rng.choice(["x", " y", "it's ", "\u3000"]))])
        assert chars[len(chars) // 2 :].max() < 1024
    assert chars[1] == len(text) and tokens[1] == len(want(text))
    paste = "pasted words " * 30_000
    text, chars, tokens = tree_after(text, chars, tokens, [(900, 900, paste)])
    assert chars[len(chars) // 2 :].max() < 1024 and tokens[1] == len(want(text))
    text, chars, tokens = tree_after(text, chars, tokens, [(300, len(text) - 300, "")])
    assert len(chars) <= 64 and tokens[1] == len(want(text))


def test_leaves_of_a_text_without_ascii_white_space():
    rng = random.Random(7)
    text = "".join(rng.choice("\u4f60\u597d\u518d\u89c1e\u0301s'1_\u3002\uff0c\uff01") for _ in range(12_000))
    chars, tokens = first_tree(text)
    assert np.count_nonzero(chars[len(chars) // 2 :]) > 20 and tokens[1] == len(want(text))
    for _ in range(300):
        at = rng.randrange(len(text) + 1)
        text, chars, tokens = tree_after(text, chars, tokens, [(at, at + rng.choice([0, 1, 2, 40]), rng.choice(["", "\u3002", "\uff01a", "\u0301", "'s"]))])
        assert chars[1] == len(text) and tokens[1] == len(want(text))
        assert chars[len(chars) // 2 :].max() < 1024


def test_edits_of_no_rows(awkward):
    encoder = bpe.make_encoder(awkward, PATH)
    none = F.lit(None).cast("array<struct<start:int,stop:int,text:string>>")
    empty = edits.count_trees(awkward.limit(0).withColumn("edits", none), encoder)
    assert edits.apply_edits(empty, encoder).collect() == []


def test_query_op8(spark):
    rows = queries.QUERIES["op8_edited_token_counts"](spark, SF).collect()
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").withColumn("edits", queries.planned_edits()).collect()
    assert len(rows) == len(docs)
    plain = {r.doc_id: (r.text or "", [tuple(e) for e in r.edits]) for r in docs}
    for r in rows:
        text, changes = plain[r.doc_id]
        after = apply_plainly(text, changes)
        assert (r.n_tokens_before, r.n_tokens, r.n_chars) == (len(want(text)), len(want(after)), len(after))
        assert r.text_sha256 == hashlib.sha256(after.encode()).hexdigest()
    # Short texts are one leaf; of long ones a part is encoded.
    assert all(r.n_encoded < r.n_chars / 2 for r in rows if r.n_chars > 8000)
