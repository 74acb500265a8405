"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

A tokenizer file of the `tokenizers` library (BPE with word ends, lower case, white space dropped) is
read on the driver; its path is a parameter.  Words counted over the whole corpus fill a transducer
(`lexicon.Lexicon`) that every Python worker maps into memory.  A step of a task splits its texts into
words with array operations, looks the different words up, and merges the unseen ones exactly.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import tempfile
import unicodedata
import uuid
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.llm.common import STEP_BYTES, col, gather, lists, steps, stored, strings, tidy, with_text_columns, without
from siltscreen.llm.lexicon import Lexicon, compiled
from siltscreen.llm.words import run_hashes

#: Words of the lexicon: a bound of the driver's and each worker's memory, not of the result.
LEXICON_WORDS = 1 << 16
#: Bytes of a word of the lexicon: with their number, a bound of the bytes that come to the driver.
LEXICON_BYTES = 64
#: Words with more bytes are merged one at a time with a heap.
BATCHED = 128
NEVER = np.int32(2**31 - 1)

#: Fixed values of the tokenizer format: white space of its patterns, and the endings split off after an apostrophe.
SPACES = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
LAST_CODE = 0x110000


@functools.lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point; values from LAST_CODE on stand for special tokens."""
    table = np.full(LAST_CODE + 1024, OTHER, np.uint8)
    for code in range(LAST_CODE):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            table[code] = LETTER if kind == "L" else NUMBER
    table[SPACES] = SPACE
    table[LAST_CODE:] = SPECIAL
    return table


class Vocabulary(NamedTuple):
    """A tokenizer file as arrays."""

    #: Ids of the 256 bytes within a word and at its end.
    inner: np.ndarray
    final: np.ndarray
    #: Merges, by `left << 32 | right`: rank and result.
    pairs: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    #: Token strings in UTF-8 end to end, and where each begins.
    text: np.ndarray
    text_bounds: np.ndarray
    special: dict[str, int]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def read_vocabulary(path: str) -> Vocabulary:
    """Only the kind named above is accepted; another one would give other ids."""
    described = json.loads(Path(path).read_text(encoding="utf-8"))
    model = described["model"]
    kinds = [n["type"] for n in described["normalizer"]["normalizers"]]
    end = model["end_of_word_suffix"]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not end or described["decoder"]:
        raise ValueError(f"{path}: not a BPE file with NFC, lower case and word ends")
    vocab: dict[str, int] = model["vocab"]
    letters = byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right, result = (np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], strict=True))
    pairs = left << 32 | right
    order = np.argsort(pairs, kind="stable")
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    named = {i: t for t, i in (vocab | special).items()}
    tokens = [named.get(i, "").encode() for i in range(max(named) + 1)]
    return Vocabulary(
        np.array([vocab[x] for x in letters], np.int32),
        np.array([vocab[x + end] for x in letters], np.int32),
        pairs[order],
        order.astype(np.int32),
        result[order].astype(np.int32),
        np.frombuffer(b"".join(tokens), np.uint8),
        np.cumsum([0, *map(len, tokens)]),
        special,
    )


def _ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = left.astype(np.int64) << 32 | right
    at = np.minimum(np.searchsorted(v.pairs, keys), len(v.pairs) - 1)
    found = (v.pairs[at] == keys) & (left >= 0) & (right >= 0)
    return np.where(found, v.ranks[at], NEVER), v.results[at]


def _merge_long(v: Vocabulary, symbols: list[int]) -> list[int]:
    """One word by a heap of (rank, place): the lowest rank first, the leftmost of equals."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    array = np.array(symbols, np.int64)
    rank, made = _ranks(v, array[:-1], array[1:])
    heap = [(int(r), i, symbols[i], symbols[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r != NEVER]
    heapq.heapify(heap)
    pairs, ranks, results = v.pairs, v.ranks, v.results

    def push(i: int) -> None:
        j = after[i]
        if i >= 0 and j >= 0:
            key = symbols[i] << 32 | symbols[j]
            at = int(np.searchsorted(pairs, key))
            if at < len(pairs) and pairs[at] == key:
                heapq.heappush(heap, (int(ranks[at]), i, symbols[i], symbols[j], int(results[at])))

    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue
        symbols[i], symbols[j] = new, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [s for s in symbols if s >= 0]


def _merge_same(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Merge words padded to one width with -1, all words one merge at a time; merged places become -1."""
    n, width = symbols.shape
    flat = symbols.reshape(-1).astype(np.int32)
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
    before = after - 2
    ranks = np.full((n, width), NEVER, np.int32)
    made = np.zeros((n, width), np.int32)
    ranks[:, :-1], made[:, :-1] = _ranks(v, symbols[:, :-1], symbols[:, 1:])
    r, m = ranks.reshape(-1), made.reshape(-1)
    live = np.arange(n)
    while len(live):
        at = np.argmin(ranks[live], axis=1)
        place = live * width + at
        go = r[place] != NEVER
        live, place, at = live[go], place[go], at[go]
        base = live * width
        gone = base + after[place]
        flat[place] = m[place]
        flat[gone] = -1
        r[gone] = NEVER
        nxt = after[gone]
        after[place] = nxt
        inside = nxt < width
        before[(base + nxt)[inside]] = at[inside]
        follower = np.where(inside, flat[np.minimum(base + nxt, len(flat) - 1)], -1)
        r[place], m[place] = _ranks(v, flat[place], follower)
        has = before[place] >= 0
        earlier = (base + before[place])[has]
        r[earlier], m[earlier] = _ranks(v, flat[earlier], flat[place][has])
    return flat.reshape(n, width)


def merged(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words given as UTF-8 bytes, and where each word's ids begin."""
    lengths = np.diff(offsets)
    pieces: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    low = 0
    widths = [4, 6, 8, 10, 12, 16, 24, 48, BATCHED]
    places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for width in widths:
        chosen = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        for part in np.array_split(chosen, max(1, len(chosen) * width >> 20)):
            if not len(part):
                continue
            grid = np.arange(width)[None, :]
            size = lengths[part][:, None]
            at = offsets[:-1][part][:, None] + np.minimum(grid, size - 1)
            symbols = np.where(grid < size - 1, v.inner[data[at]], np.where(grid == size - 1, v.final[data[at]], -1))
            symbols = _merge_same(v, symbols.astype(np.int32))
            row, _ = np.nonzero(symbols >= 0)
            places.append(part[row])
            values.append(symbols[symbols >= 0])
    for i in np.flatnonzero(lengths > BATCHED):
        raw = data[offsets[i] : offsets[i + 1]]
        ids = _merge_long(v, [*v.inner[raw[:-1]].tolist(), int(v.final[raw[-1]])])
        places.append(np.full(len(ids), i))
        values.append(np.array(ids, np.int32))
    place, value = np.concatenate(places), np.concatenate(values)
    order = np.argsort(place, kind="stable")
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.bincount(place, minlength=len(lengths)), out=bounds[1:])
    return value[order], bounds


def _normal(text: str) -> str:
    if not text.isascii():
        # Lower case is taken letter by letter, so a sigma at a word's end is no special case.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Split(NamedTuple):
    """Texts cut into words: code points, word places, and where each row's words begin."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def split_words(texts: list[str | None], special: dict[str, int]) -> Split:
    """Words as the tokenizer's normalizer and pattern give them; a special token is a word of one code."""
    finder = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    order = {t: i for i, t in enumerate(special)}
    rows = []
    for text in texts:
        text = text or ""
        if finder and "<" in text and finder.search(text):
            parts = finder.split(text)
            rows.append(
                np.concatenate([np.array([LAST_CODE + order[p]], np.uint32) if i % 2 else np.frombuffer(_normal(p).encode("utf-32-le"), np.uint32) for i, p in enumerate(parts)])
            )
        else:
            rows.append(np.frombuffer(_normal(text).encode("utf-32-le"), np.uint32))
    codes = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    edges = np.cumsum([0, *map(len, rows)])
    n = len(codes)
    if not n:
        return Split(codes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(edges), np.int64))
    kind = character_classes()[codes]
    fresh = np.zeros(n + 1, bool)
    fresh[edges] = True
    begins = np.ones(n + 1, bool)
    begins[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == SPECIAL)
    begins |= fresh
    for at in _apostrophes(codes, begins):
        ending = next((e for e in ENDINGS if at + len(e) < n and not fresh[at + 1 : at + 1 + len(e)].any() and (codes[at + 1 : at + 1 + len(e)] == [ord(x) for x in e]).all()), None)
        if ending:
            begins[at + 1 : at + 1 + len(ending)] = False
            begins[at + 1 + len(ending)] = True
    solid = kind != SPACE
    starts = np.flatnonzero(begins[:n] & solid)
    ends = np.flatnonzero(begins[1:] & solid) + 1
    return Split(codes, starts, ends, np.searchsorted(starts, edges))


def _apostrophes(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of an apostrophe that is a run by itself, followed by one of the endings' first letters."""
    at = np.flatnonzero((codes[:-1] == 0x27) & begins[: len(codes) - 1] & begins[1 : len(codes)])
    return at[np.isin(codes[at + 1], [ord(e[0]) for e in ENDINGS])]


def different(split: Split) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its kind, and for each kind the first word of it."""
    kinds, _ = pd.factorize(run_hashes(split.codes, split.starts, split.ends))
    first = np.zeros(kinds.max() + 1 if len(kinds) else 0, np.int64)
    first[kinds[::-1]] = np.arange(len(kinds))[::-1]
    return kinds, first


def word_bytes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of words, end to end, and where each begins."""
    at, bounds = gather(starts, ends - starts)
    chosen = codes[at]
    size = 1 + (chosen >= 0x80) + (chosen >= 0x800) + (chosen >= 0x10000)
    total = np.zeros(len(chosen) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    data = chosen.astype("<u4").tobytes().decode("utf-32-le").encode()
    return np.frombuffer(data, np.uint8), total[bounds]


def encode_texts(texts: list[str | None], v: Vocabulary, lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's ids begin."""
    ids, token_bounds, split = encode_words(texts, v, lexicon)
    return ids, token_bounds[split.bounds]


def encode_words(texts: list[str | None], v: Vocabulary, lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray, Split]:
    """Ids of all words end to end, where each word's ids begin, and the words."""
    split = split_words(texts, v.special)
    kinds, first = different(split)
    starts, ends = split.starts[first], split.ends[first]
    special = split.codes[starts] >= LAST_CODE if len(starts) else np.zeros(0, bool)
    known = lexicon.find(split.codes, starts, ends) if lexicon is not None else np.full(len(starts), -1, np.int64)
    unseen = np.flatnonzero((known < 0) & ~special)
    data, offsets = word_bytes(split.codes, starts[unseen], ends[unseen])
    new_ids, new_bounds = merged(v, data, offsets)
    count = np.ones(len(starts), np.int64)
    count[unseen] = np.diff(new_bounds)
    seen = np.flatnonzero(known >= 0)
    if lexicon is not None:
        count[seen] = lexicon.counts(known[seen])
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(count, out=bounds[1:])
    ids = np.zeros(bounds[-1], np.int32)
    ids[gather(bounds[:-1][unseen], count[unseen])[0]] = new_ids
    if lexicon is not None:
        ids[gather(bounds[:-1][seen], count[seen])[0]] = lexicon.ids(known[seen])
    if special.any():
        ids[bounds[:-1][special]] = np.array([*v.special.values()])[split.codes[starts[special]] - LAST_CODE]
    at, token_bounds = gather(bounds[:-1][kinds], count[kinds])
    return ids[at], token_bounds, split


def decode_ids(ids: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token strings joined by spaces, of each row; ids that name no token are left out."""
    known = (ids >= 0) & (ids < len(v.text_bounds) - 1)
    known[known] &= np.diff(v.text_bounds)[ids[known]] > 0
    kept = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(known, out=kept[1:])
    ids, bounds = ids[known], kept[bounds]
    size = np.diff(v.text_bounds)[ids]
    last = np.zeros(len(ids), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    # The vocabulary's text is followed by one space, which ends every token but a row's last.
    spaced = np.append(v.text, np.uint8(0x20))
    at, where = gather(v.text_bounds[ids], size + ~last)
    at[where[1:][~last] - 1] = len(v.text)
    return spaced[at], where[bounds]


def lexicon_words(df: DataFrame, text: str, v: Vocabulary, size: int) -> list[str]:
    """The most frequent words of up to LEXICON_BYTES over all texts, counted by Spark: every word of at least such a count that at most `size` have it.

    So at most `size * LEXICON_BYTES` bytes come to the driver; longer words are merged where they occur.

    The least count comes from a histogram of counts by powers of 2 ** (1 / 8), so no task sends the
    driver more than its own share of the chosen words.  Words that occur once are never among them.
    """

    def count(column: pa.Array) -> list[pa.Array]:
        split = split_words(column.to_pylist(), v.special)
        kinds, first = different(split)
        plain = split.codes[split.starts[first]] < LAST_CODE if len(first) else np.zeros(0, bool)
        numbers = np.bincount(kinds, minlength=len(first))[plain]
        data, offsets = word_bytes(split.codes, split.starts[first[plain]], split.ends[first[plain]])
        pairs = pa.StructArray.from_arrays([strings(data, offsets), pa.array(numbers.astype(np.int64))], ["word", "n"])
        whole = np.zeros(len(column) + 1, np.int64)
        whole[1:] = len(pairs)
        return [lists(pairs, whole)]

    made = T.StructType().add("words", T.ArrayType(T.StructType().add("word", T.StringType()).add("n", T.LongType())))
    counted = with_text_columns(df, text, count, made, []).select(F.inline("words")).filter(F.octet_length("word") <= LEXICON_BYTES)
    step = F.floor(F.log2("n") * 8).cast("int")
    often = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").withColumn("step", step))
    least, room = 1 << 20, size
    for row in sorted(often.groupBy("step").count().collect(), key=lambda r: -r.step):
        room -= row["count"]
        if room < 0:
            break
        least = row.step
    return [r.word for r in often.filter(F.col("step") >= least).select("word").collect()]


class Encoder:
    """A vocabulary and a lexicon, ready for use in tasks; lost executors fetch both again."""

    def __init__(self, vocabulary: Broadcast, file: str) -> None:
        self.vocabulary, self.file = vocabulary, file

    def parts(self) -> tuple[Vocabulary, Lexicon]:
        return self.vocabulary.value, Lexicon.mapped(SparkFiles.get(self.file))


def make_encoder(df: DataFrame, path: str, text: str = "text", lexicon_size: int = LEXICON_WORDS) -> Encoder:
    """Count words, compile the transducer, hand it and the vocabulary to the executors."""
    v = read_vocabulary(path)
    return ship(df.sparkSession, v, lexicon_words(df, text, v, lexicon_size))


def vocabulary_words(path: str) -> list[str]:
    """Words that are a token by themselves."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    end = model["end_of_word_suffix"]
    raw = [bytes(byte_of[x] for x in token[: -len(end)]) for token in model["vocab"] if token.endswith(end) and len(token) > len(end)]
    words = [r.decode(errors="ignore") for r in raw]
    return [w for w, r in zip(words, raw, strict=True) if w.encode() == r]


def vocabulary_encoder(spark: SparkSession, path: str) -> Encoder:
    """An encoder whose transducer holds the vocabulary's own words, for jobs not worth a count of the corpus first."""
    return ship(spark, read_vocabulary(path), vocabulary_words(path))


def ship(spark: SparkSession, v: Vocabulary, chosen: list[str]) -> Encoder:
    chosen = sorted(set(chosen))
    raw = [w.encode() for w in chosen]
    ids, bounds = merged(v, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    file = Path(tempfile.mkdtemp(prefix="lexicon-")) / f"lexicon-{uuid.uuid4().hex}.bin"
    compiled(chosen, ids, bounds).tofile(file)
    spark.sparkContext.addFile(str(file))
    return Encoder(spark.sparkContext.broadcast(v), file.name)


def encode(df: DataFrame, encoder: Encoder, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """Replace `text` by `ids` (array of int) and `n_tokens`; null and empty texts have no ids.

    Repeated rows stay repeated, other columns stay as they are; columns named like the two results
    give way to them.
    """

    def make(column: pa.Array) -> list[pa.Array]:
        v, lexicon = encoder.parts()
        found, bounds = encode_texts(column.to_pylist(), v, lexicon)
        return [lists(pa.array(found), bounds), pa.array(np.diff(bounds))]

    made = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(count, T.LongType())])
    return with_text_columns(df, text, make, made, without(df, text))


def decode(df: DataFrame, encoder: Encoder, ids: str = "ids", decoded: str = "decoded", packed: str | None = None) -> DataFrame:
    """Add `decoded`, the token strings of `ids` joined by spaces; null ids give an empty text.

    With `packed`, also add the ids as binary: little-endian unsigned 32-bit integers.
    """
    fields = [T.StructField(decoded, T.StringType())] + ([T.StructField(packed, T.BinaryType())] if packed else [])
    width = bool(packed)

    def make(column: pa.Array, *_: pa.Array) -> list[pa.Array]:
        v = encoder.vocabulary.value
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.zeros(len(column) + 1, np.int64)
        np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False), out=bounds[1:])
        data, offsets = decode_ids(values, bounds, v)
        out = [strings(data, offsets)]
        if width:
            raw = values.astype("<u4").tobytes()
            out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(bounds * 4), pa.py_buffer(raw)]).cast(pa.binary()))
        return out

    return _with_list_columns(df, ids, make, T.StructType(fields))


def _with_list_columns(df: DataFrame, ids: str, make, made: T.StructType) -> DataFrame:
    keep = [c for c in df.columns if c.lower() not in {f.name.lower() for f in made}]
    names = [f"_c{i}" for i in range(len(keep))]
    at = keep.index(ids)
    results = [f"_made{i}" for i in range(len(made))]
    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for n, c in zip(names, keep, strict=True)] + [T.StructField(r, f.dataType) for r, f in zip(results, made, strict=True)])

    def run(batches):
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            # A token is a few bytes of decoded text.
            for low, high in steps(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), STEP_BYTES // 8):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(at))], names + results)

    out = df.select(*[col(c).alias(n) for n, c in zip(names, keep, strict=True)]).mapInArrow(tidy(run), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *[F.col(r).alias(f.name) for r, f in zip(results, made, strict=True)])
