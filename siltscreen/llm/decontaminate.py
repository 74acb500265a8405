"""Benchmark decontamination with suffix arrays over the training texts.

The texts of each step of a task are a shard.  A shard's suffix array is sparse: it holds the suffixes
that begin with a word n-gram of the benchmark, for no other suffix can match a benchmark window.  Every
different window of the benchmark is binary-searched in every shard; the range of suffixes that share it
gives the hit words, and matches are the windows found, extended word by word.  So the longest match of an
item's suffix is given only if it holds a whole window (ten words, or all of a shorter item): shorter
matches are not searched, nor are the last nine suffixes of an item by themselves.  All of it is one
narrow pass: nothing of the corpus is shuffled, and the benchmark goes to the tasks in blocks of
bounded size, one pass a block.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.llm.common import col, gather, lists, utf8, with_text_columns, without
from siltscreen.llm.words import Words, words

WINDOW = 10
#: Bytes of benchmark text in one block: the bound of what is broadcast at a time.
BLOCK_BYTES = 16 << 20
#: Text of a shard.
SHARD_BYTES = 1 << 20
#: Words that start an indexed suffix, at most; fewer where an item is shorter.
LEAD = 3

SPAN = "array<struct<start:bigint,stop:bigint>>"
_LONG, _STRING = T.LongType(), T.StringType()
MADE = (
    T.StructType()
    .add("n_words", _LONG)
    .add("hit_spans", T.ArrayType(T.StructType().add("start", _LONG).add("stop", _LONG)))
    .add("hit_items", T.ArrayType(_STRING))
    .add("matches", T.ArrayType(T.StructType().add("item_id", _STRING).add("doc_word", _LONG).add("item_word", _LONG).add("n_words", _LONG)))
)


class Benchmark(NamedTuple):
    """A block of items as word numbers, and its windows."""

    #: Hashes of the block's words in order; a word's number is its place here, from 1.
    vocabulary: np.ndarray
    #: Word numbers of all items, a 0 after each, and each place's item.
    words: np.ndarray
    items: np.ndarray
    item_ids: list[str]
    item_starts: np.ndarray
    #: Start and length of one occurrence of every different window, and all its occurrences.
    window_at: np.ndarray
    window_size: np.ndarray
    places: np.ndarray
    place_bounds: np.ndarray
    #: Words that start an indexed suffix, and their keys in order.
    lead: int
    leads: np.ndarray
    depth: int


def _numbers(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def _keys(values: np.ndarray, at: np.ndarray, n: int, base: int) -> np.ndarray:
    """The n values from each place on as one number; 0 stands beyond the end and after a 0."""
    key = np.zeros(len(at), np.int64)
    live = np.ones(len(at), bool)
    for k in range(n):
        here = np.where(at + k < len(values), values[np.minimum(at + k, len(values) - 1)], 0)
        live &= here > 0
        key = key * base + np.where(live, here, 0)
    return key


def index_benchmark(items: list[tuple[str, str]], window: int = WINDOW) -> Benchmark:
    text = pa.array([t for _, t in items], pa.string())
    found = words(*utf8(text))
    vocabulary = np.unique(found.hashes)
    counts = np.diff(found.bounds)
    starts = found.bounds[:-1] + np.arange(len(items))
    values = np.zeros(len(found.hashes) + len(items), np.int64)
    values[np.arange(len(found.hashes)) + found.rows] = _numbers(found.hashes, vocabulary)
    owner = np.repeat(np.arange(len(items)), counts + 1)
    made = np.maximum(counts - window + 1, (counts > 0).astype(np.int64))
    at, _ = gather(starts, made)
    size = np.repeat(np.minimum(counts, window), made)
    known: dict[bytes, int] = {}
    kinds = np.array([known.setdefault(values[a : a + s].tobytes(), len(known)) for a, s in zip(at.tolist(), size.tolist(), strict=True)], np.int64)
    first = np.zeros(len(known), np.int64)
    first[kinds[::-1]] = np.arange(len(kinds))[::-1]
    order = np.argsort(kinds, kind="stable")
    bounds = np.searchsorted(kinds[order], np.arange(len(known) + 1))
    base = len(vocabulary) + 1
    lead = int(min([LEAD, *counts[counts > 0].tolist(), max(1, 62 // max(1, base.bit_length()))]))
    leads = np.unique(_keys(values, at[first], lead, base)) if len(first) else np.zeros(0, np.int64)
    return Benchmark(vocabulary, values, owner, [i for i, _ in items], starts, at[first], size[first], at[order], bounds, lead, leads, int(counts.max(initial=0)))


class Shard(NamedTuple):
    """Word numbers of a shard's texts, a 0 after each text, and the sorted places of its suffixes."""

    words: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    suffixes: np.ndarray


def suffix_array(found: Words, bench: Benchmark) -> Shard:
    n_rows = len(found.bounds) - 1
    values = np.zeros(len(found.hashes) + n_rows, np.int64)
    values[np.arange(len(found.hashes)) + found.rows] = _numbers(found.hashes, bench.vocabulary)
    rows = np.repeat(np.arange(n_rows), np.diff(found.bounds) + 1)
    starts = found.bounds[:-1] + np.arange(n_rows)
    base = len(bench.vocabulary) + 1
    places = np.flatnonzero(values)
    if len(bench.leads):
        for k in range(1, bench.lead):  # cheap first: only places whose first words are all of the benchmark
            places = places[values[np.minimum(places + k, len(values) - 1)] > 0]
        key = _keys(values, places, bench.lead, base)
        at = np.minimum(np.searchsorted(bench.leads, key), len(bench.leads) - 1)
        places = places[bench.leads[at] == key]
    else:
        places = places[:0]
    # Sort by a few words at a time; only places still tied are looked at again, to the longest item's length.
    group = np.zeros(len(places), np.int64)
    width = max(1, 62 // max(1, base.bit_length()))
    tied = np.arange(len(places))
    for depth in range(0, bench.depth, width):
        if not len(tied):
            break
        key = _keys(values, places[tied] + depth, width, base)
        order = np.lexsort((key, group[tied]))
        places[tied], key, old = places[tied][order], key[order], group[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        # A group's number is the place in the array where it begins.
        group[tied] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        more = np.zeros(len(tied), bool)
        same = ~new
        more |= same
        more[:-1] |= same[1:]
        # A suffix that has ended inside these words is equal to its ties for good.
        tied = tied[more & (key % base > 0)]
    return Shard(values, rows, starts, places)


def _below(shard: Shard, bench: Benchmark, at: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
    """Suffixes below each pattern bench.words[at:at+size] (or below and with it as their start)."""
    base = len(bench.vocabulary) + 1
    width = max(1, 62 // max(1, base.bit_length()))
    low = np.zeros(len(at), np.int64)
    high = np.full(len(at), len(shard.suffixes))
    longest = int(size.max(initial=0))
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        sign = np.zeros(len(open_), np.int64)
        left = np.arange(len(open_))
        for depth in range(0, longest, width):
            a, s = at[open_[left]] + depth, size[open_[left]] - depth
            mine = _keys(shard.words, shard.suffixes[middle[left]] + depth, width, base)
            other = _keys(bench.words, a, width, base)
            cut = np.power(base, np.maximum(width - s, 0))
            mine, other = mine // cut, other // cut
            sign[left] = np.sign(mine - other)
            left = left[(mine == other) & (s > width)]
            if not len(left):
                break
        right = sign < 0 if not upper else sign <= 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
    return low


def search(shard: Shard, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence of every window: place in the shard, number of the window."""
    low = _below(shard, bench, bench.window_at, bench.window_size, False)
    high = _below(shard, bench, bench.window_at, bench.window_size, True)
    at, _ = gather(low, high - low)
    return shard.suffixes[at], np.repeat(np.arange(len(low)), high - low)


def longest_matches(shard: Shard, bench: Benchmark, place: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal verbatim matches that hold a window: place in the shard, place in the items, words."""
    size = np.diff(bench.place_bounds)[window]
    at, _ = gather(bench.place_bounds[window], size)
    mine, theirs = np.repeat(place, size), bench.places[at]
    before = lambda values, x: np.where(x > 0, values[np.maximum(x - 1, 0)], 0)
    a, b = before(shard.words, mine), before(bench.words, theirs)
    first = (a != b) | (a == 0)
    mine, theirs = mine[first], theirs[first]
    length = np.zeros(len(mine), np.int64)
    live = np.arange(len(mine))
    while len(live):
        a, b = shard.words[mine[live] + length[live]], bench.words[theirs[live] + length[live]]
        live = live[(a == b) & (a > 0)]
        length[live] += 1
    return mine, theirs, length


def _spans(hit: np.ndarray, rows: np.ndarray, starts: np.ndarray, n_rows: int) -> tuple[pa.Array, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = rows[begin]
    values = pa.StructArray.from_arrays([pa.array(begin - starts[owner]), pa.array(end - starts[owner])], ["start", "stop"])
    return values, np.searchsorted(owner, np.arange(n_rows + 1))


def find_leaks(texts: pa.Array, bench: Benchmark) -> list[pa.Array]:
    found = words(*utf8(texts))
    n = len(texts)
    shard = suffix_array(found, bench)
    place, window = search(shard, bench)
    change = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + bench.window_size[window], -1)
    spans, span_bounds = _spans(np.cumsum(change[:-1]) > 0, shard.rows, shard.starts, n)
    mine, theirs, length = longest_matches(shard, bench, place, window)
    order = np.lexsort((theirs, mine))
    mine, theirs, length = mine[order], theirs[order], length[order]
    row, item = shard.rows[mine], bench.items[theirs] if len(theirs) else theirs
    names = pa.array(bench.item_ids, pa.string())
    matches = pa.StructArray.from_arrays(
        [names.take(pa.array(item)), pa.array(mine - shard.starts[row]), pa.array(theirs - bench.item_starts[item]), pa.array(length)],
        ["item_id", "doc_word", "item_word", "n_words"],
    )
    pairs = np.unique(row * len(names) + item) if len(row) else np.zeros(0, np.int64)
    items = names.take(pa.array(pairs % max(1, len(names))))
    each = np.arange(n + 1)
    return [
        pa.array(np.diff(found.bounds)),
        lists(spans, span_bounds),
        lists(items, np.searchsorted(pairs, each * len(names))),
        lists(matches, np.searchsorted(row, each)),
    ]


def benchmark_blocks(benchmark: DataFrame, text: str, item: str, limit: int = BLOCK_BYTES) -> list[list[tuple[str, str]]]:
    """Items in blocks of at most `limit` bytes, or of one item."""
    blocks: list[list[tuple[str, str]]] = []
    size = limit
    for row in benchmark.select(col(item).cast("string").alias("i"), F.coalesce(col(text), F.lit("")).alias("t")).toLocalIterator():
        n = len(row.t.encode())
        if size + n > limit:
            blocks.append([])
            size = 0
        blocks[-1].append((row.i if row.i is not None else "null", row.t))
        size += n
    return blocks


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item: str = "item_id", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Add `n_words, hit_spans, hit_items, matches` to each document; drop `text` unless asked to keep it.

    A word is a run of digits, a-z (A-Z count as a-z) and characters beyond ASCII.  A window is `window`
    consecutive words of an item; an item of fewer, but not none, is one window.  `hit_spans` are the runs
    of document words inside any occurrence (stop is exclusive), `hit_items` the items with an occurring
    window, `matches` the longest verbatim matches that hold a window.  Null and empty texts have no
    words; items without words match nothing; items that share an id count once; an item id that is null
    is called null.  Repeated documents keep their rows.  Columns named like the four results give way.
    """
    spark = docs.sparkSession
    keep = [c for c in without(docs, *MADE.names) if keep_text or c.lower() != text.lower()]
    blocks = [spark.sparkContext.broadcast(index_benchmark(b, window)) for b in benchmark_blocks(benchmark, item_text, item) or [[]]]
    out = docs.select(*[col(c).alias(f"_d{i}") for i, c in enumerate(keep)], col(text).alias("_text"))
    parts = []
    for k, block in enumerate(blocks):
        # The text goes along to the next block's pass.
        rest = without(out, "_text") if k == len(blocks) - 1 else out.columns
        made = T.StructType([T.StructField(f"_leak{k}_{f.name}", f.dataType) for f in MADE])
        out = with_text_columns(out, "_text", lambda t, b=block: find_leaks(t, b.value), made, rest, step=SHARD_BYTES)
        parts.append(made.names)
    columns = [F.col(p) for p in parts[0]] if len(parts) == 1 else _united(parts)
    return out.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(keep)], *[c.alias(f.name) for c, f in zip(columns, MADE, strict=True)])


def _united(parts: list[list[str]]) -> list:
    """The results of several blocks as one: spans joined where they touch, items without repeats."""
    spans = F.array_sort(F.flatten(F.array(*[F.col(p[1]) for p in parts])))

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        touching = (F.size(done) > 0) & F.coalesce(last["stop"] >= span["start"], F.lit(False))
        return F.when(touching, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    united = F.aggregate(spans, F.array().cast(SPAN), add)
    items = F.array_distinct(F.flatten(F.array(*[F.col(p[2]) for p in parts])))
    matches = F.flatten(F.array(*[F.col(p[3]) for p in parts]))
    return [F.col(parts[0][0]), united, items, matches]


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a benchmark window, with their columns as they came."""
    names = docs.columns
    bare = docs.select(*[col(c).alias(f"_d{i}") for i, c in enumerate(names)])
    found = leaks(bare, benchmark, text=f"_d{names.index(text)}", keep_text=True, **options)
    clean = found.filter(F.size("hit_items") == 0)
    return clean.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)])
