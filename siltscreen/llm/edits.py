"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf is a stretch of text of some dozen words that begins at the text's start, at white space, or at
East Asian punctuation after a letter or digit: no word, contraction or composed character crosses there.
Inner nodes hold the characters and tokens below them.  An edit is located by descending the tree; the
leaves it touches, and the one before where it changes their first character, are encoded again, and the
sums on the paths above them are updated.  A touched stretch that has grown is cut into leaves again, so
leaves stay short however many edits follow; only a single word may be longer than that.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltscreen.llm.bpe import SPACES, Encoder, Vocabulary, encode_texts
from siltscreen.llm.common import strings, with_text_columns, without
from siltscreen.llm.lexicon import Lexicon

#: Characters of a leaf, at least, unless the text ends; a touched stretch of twice as many is cut again.
LEAF = 256
#: What leaves may begin with.
BREAK = re.compile("[" + "".join(map(chr, SPACES)) + r"]|(?<=[^\W_])[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]")

TREE = T.StructType().add("chars", T.ArrayType(T.IntegerType())).add("tokens", T.ArrayType(T.IntegerType()))
EDIT = T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()).add("text", T.StringType())


def leaves(text: str) -> list[int]:
    """Where leaves begin."""
    cuts = [0]
    while found := BREAK.search(text, cuts[-1] + LEAF):
        cuts.append(found.start())
    return cuts


def build(chars: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a perfect binary tree, root at 1, leaves from half its length on."""
    size = 1 << max(0, int(len(chars) - 1).bit_length())
    out = []
    for values in (chars, tokens):
        tree = np.zeros(2 * size, np.int32)
        tree[size : size + len(values)] = values
        at = size
        while at > 1:
            tree[at // 2 : at] = tree[at : 2 * at : 2] + tree[at + 1 : 2 * at : 2]
            at //= 2
        out.append(tree)
    return out[0], out[1]


def locate(chars: np.ndarray, at: int) -> tuple[int, int]:
    """The node of the leaf that holds the character `at` (the last leaf that has any, for the text's end), and where it begins."""
    node, begin, half = 1, 0, len(chars) // 2
    if at >= chars[1]:
        at = max(0, int(chars[1]) - 1)
    while node < half:
        left = int(chars[2 * node])
        if at < begin + left:
            node = 2 * node
        else:
            node, begin = 2 * node + 1, begin + left
    return node, begin


def update(tree: np.ndarray, node: int, value: int) -> None:
    by = value - int(tree[node])
    while node:
        tree[node] += by
        node >>= 1


class Region:
    """Leaves low..high of a tree that one or more edits touch, and their text after them."""

    def __init__(self, low: int, high: int, text: str) -> None:
        self.low, self.high, self.text = low, high, text


def edited(text: str, chars: np.ndarray, edits: list[dict]) -> tuple[str, list[Region]]:
    """The text after all edits, and the regions to encode again.

    Edits name places of the text as it was; they are applied from its end to its start.  Places are cut
    to the text, a stop before its start counts as the start, and where edits overlap the one that starts
    earlier (of equals, the later in the list) gives way: it ends where the next one starts.
    """
    n = len(text)
    plan, limit = [], n
    for e in sorted((e for e in edits if e is not None), key=lambda e: e["start"] or 0)[::-1]:
        start = min(max(0, e["start"] or 0), limit)
        stop = min(max(start, e["stop"] if e["stop"] is not None else start), limit)
        plan.append((start, stop, e["text"] or ""))
        limit = start
    plan.reverse()
    regions: list[tuple[int, int, list]] = []
    for start, stop, new in plan:
        low, begin = locate(chars, start)
        if start <= begin and begin > 0:
            low, _ = locate(chars, begin - 1)  # its leading space may go, so the leaf before joins
        high, _ = locate(chars, max(start, stop))
        if regions and low <= regions[-1][1]:
            regions[-1] = (regions[-1][0], max(high, regions[-1][1]), [*regions[-1][2], (start, stop, new)])
        else:
            regions.append((low, high, [(start, stop, new)]))
    out, done, made = [], 0, []
    half = len(chars) // 2
    for low, high, changes in regions:
        begin = _before(chars, low)
        end = _before(chars, high) + int(chars[high])
        pieces, at = [], begin
        for start, stop, new in changes:
            pieces += [text[at:start], new]
            at = stop
        pieces.append(text[at:end])
        made.append(Region(low - half, high - half, "".join(pieces)))
        out += [text[done:begin], made[-1].text]
        done = end
    out.append(text[done:])
    return "".join(out), made


def pieces(region: Region) -> list[str]:
    """The leaves that a region becomes: itself, or its parts if it has grown."""
    if len(region.text) <= 2 * LEAF:
        return [region.text]
    cuts = [*leaves(region.text), len(region.text)]
    return [region.text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def renewed(chars: np.ndarray, tokens: np.ndarray, regions: list[tuple[Region, list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The tree with each region's leaves replaced by ones of the given characters and tokens.

    Regions of one leaf each are written into its first leaf, the others become empty and only the paths
    above change.  Where a region is several leaves, or half of all leaves are empty, the sums are made
    anew from the leaves, and neighbours that fit into one become one; nothing is encoded for that.
    """
    half = len(chars) // 2
    if all(len(c) == 1 for _, c, _ in regions):
        for r, c, t in regions:
            for tree, value in ((chars, c[0]), (tokens, t[0])):
                update(tree, half + r.low, value)
                for leaf in range(r.low + 1, r.high + 1):
                    update(tree, half + leaf, 0)
        if 4 * np.count_nonzero(chars[half:]) >= half:
            return chars, tokens
        regions = []
    found: list[tuple[list[int], list[int]]] = []
    at = 0
    for r, c, t in regions:
        found += [(chars[half + at : half + r.low].tolist(), tokens[half + at : half + r.low].tolist()), (c, t)]
        at = r.high + 1
    found.append((chars[half + at :].tolist(), tokens[half + at :].tolist()))
    new: list[list[int]] = []
    for c, t in ((c, t) for cs, ts in found for c, t in zip(cs, ts, strict=True) if c):
        if new and new[-1][0] + c <= LEAF:
            new[-1] = [new[-1][0] + c, new[-1][1] + t]
        else:
            new.append([c, t])
    leaf = np.array(new or [[0, 0]], np.int32)
    return build(leaf[:, 0], leaf[:, 1])


def _before(chars: np.ndarray, node: int) -> int:
    total = 0
    while node > 1:
        if node & 1:
            total += int(chars[node - 1])
        node >>= 1
    return total


def _count(texts: list[str], v: Vocabulary, lexicon: Lexicon | None) -> np.ndarray:
    return np.diff(encode_texts(texts, v, lexicon)[1])


def _tree_array(trees: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    cuts = np.cumsum([0, *[len(c) for c, _ in trees]]).astype(np.int32)
    fields = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.zeros(0, np.int32), *[t[k] for t in trees]]))) for k in (0, 1)]
    return pa.StructArray.from_arrays(fields, ["chars", "tokens"])


def count_trees(docs: DataFrame, encoder: Encoder, text: str = "text", tree: str = "tree", count: str = "n_tokens") -> DataFrame:
    """Add the segment tree of each text and its number of tokens; null counts as an empty text.

    Columns named like the results give way to them; repeated rows stay repeated.
    """

    def make(column: pa.Array) -> list[pa.Array]:
        v, lexicon = encoder.parts()
        texts = [t or "" for t in column.to_pylist()]
        cuts = [[*leaves(t), len(t)] for t in texts]
        tokens = _count([t[a:b] for t, c in zip(texts, cuts, strict=True) for a, b in zip(c[:-1], c[1:], strict=True)], v, lexicon)
        trees, at = [], 0
        for c in cuts:
            trees.append(build(np.diff(c), tokens[at : at + len(c) - 1]))
            at += len(c) - 1
        return [_tree_array(trees), pa.array([int(t[1]) for _, t in trees], pa.int64())]

    return with_text_columns(docs, text, make, T.StructType().add(tree, TREE).add(count, T.LongType()), docs.columns)


def apply_edits(docs: DataFrame, encoder: Encoder, text: str = "text", edits: str = "edits", tree: str = "tree", count: str = "n_tokens") -> DataFrame:
    """Apply each row's `edits` (array of start, stop, text) to its text, tree and count.

    Adds `n_encoded`, the characters that were encoded again.  Null edits leave the row as it is.  See
    `edited` for places beyond the text and overlaps.  A null text counts as empty and becomes empty; an
    empty table gives an empty one; columns named like the results give way to them.
    """

    def make(texts: pa.Array, changes: pa.Array, trees: pa.Array) -> list[pa.Array]:
        v, lexicon = encoder.parts()
        old = [(np.array(t["chars"], np.int32), np.array(t["tokens"], np.int32)) for t in trees.to_pylist()]
        results = [edited(t or "", c, e or []) for t, (c, _), e in zip(texts.to_pylist(), old, changes.to_pylist(), strict=True)]
        parts = [[pieces(r) for r in regions] for _, regions in results]
        counts = iter(_count([p for row in parts for own in row for p in own], v, lexicon).tolist())
        new, encoded = [], []
        for (chars, tokens), (_, regions), row in zip(old, results, parts, strict=True):
            known = [(r, [len(p) for p in own], [next(counts) for _ in own]) for r, own in zip(regions, row, strict=True)]
            new.append(renewed(chars, tokens, known) if known else (chars, tokens))
            encoded.append(sum(len(r.text) for r in regions))
        raw = [t.encode() for t, _ in results]
        data = np.frombuffer(b"".join(raw), np.uint8)
        return [strings(data, np.cumsum([0, *map(len, raw)])), _tree_array(new), pa.array([int(t[1]) for _, t in new], pa.int64()), pa.array(encoded, pa.int64())]

    made = T.StructType().add(text, T.StringType()).add(tree, TREE).add(count, T.LongType()).add("n_encoded", T.LongType())
    return with_text_columns(docs, text, make, made, without(docs, text, edits, tree, count), (edits, tree))
