"""Many literal phrases at once: one automaton over all of them, one scan of a text for each phrase found in it."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Folding(dict):
    """Characters as a case-insensitive pattern compares them: each to one character, so places stay."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        upper = c.upper() if len(c.upper()) == 1 else c
        lower = upper.lower() if len(upper.lower()) == 1 else upper
        self[code] = ord(lower)
        return self[code]


_FOLDING = _Folding()


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDING)


class _Gaps:
    """Deleted stretches of a text, by places in the whole text; touching ones are one."""

    def __init__(self, size: int):
        self.size, self.dead = size, bytearray(size)
        self.begin: dict[int, int] = {}
        self.end: dict[int, int] = {}

    def cut(self, a: int, b: int) -> None:
        """Delete what is left from a to b."""
        self.dead[a:b] = b"\1" * (b - a)
        a, b = self.begin.get(a, a), self.end.get(b, b)
        self.begin[b], self.end[a] = a, b

    def whole(self, a: int, b: int) -> bool:
        return self.dead.find(1, a, b) < 0

    def before(self, at: int, most: int) -> list[tuple[int, int]]:
        """The stretches that hold the last `most` characters left before the place."""
        found = []
        while most > 0 and at > 0:
            edge = self.dead.rfind(1, max(0, at - most), at) + 1
            a = edge or max(0, at - most)
            if a < at:
                found.append((a, at))
                most -= at - a
            at = self.begin[edge] if edge else 0
        return found[::-1]

    def after(self, at: int, most: int) -> list[tuple[int, int]]:
        """The stretches that hold the first `most` characters left from the place on."""
        found = []
        while most > 0 and at < self.size:
            edge = self.dead.find(1, at, at + most)
            b = min(self.size, at + most) if edge < 0 else edge
            if at < b:
                found.append((at, b))
                most -= b - at
            at = self.size if edge < 0 else self.end[edge]
        return found

    def left(self) -> list[tuple[int, int]]:
        return self.after(0, self.size)


class Phrases:
    """Phrases in list order; only the first of equal ones counts, since it leaves nothing for the others."""

    def __init__(self, phrases: tuple[str, ...]):
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        for rank, phrase in enumerate(phrases):
            key = folded(phrase)
            if key not in self.tree:
                self.tree.add_word(key, (rank, len(key)))
        self.longest = max((len(folded(p)) for p in phrases), default=0)
        self.tree.make_automaton()

    def removed(self, text: str) -> tuple[str, int]:
        """`text` after every phrase in turn was deleted from what the ones before left, and the number of deletions.

        The text is scanned once. A deletion can join a later phrase together, so what stands around it, as far as
        the longest phrase reaches, is scanned once more.
        """
        low = folded(text)
        places: dict[int, list[tuple[tuple[int, int], ...]]] = {}
        for end, (rank, size) in self.tree.iter(low):
            places.setdefault(rank, []).append(((end + 1 - size, end + 1),))
        if not places:
            return text, 0
        ranks, gaps, count = list(places), _Gaps(len(text)), 0
        heapq.heapify(ranks)
        while ranks:
            done = heapq.heappop(ranks)
            cuts, at = [], -1
            for place in sorted(set(places.pop(done))):
                if place[0][0] >= at and all(gaps.whole(a, b) for a, b in place):
                    cuts.append(place)
                    at = place[-1][1]
            for place in cuts:
                for a, b in place:
                    gaps.cut(a, b)
            count += len(cuts)
            for rank, place in self.joined(low, gaps, cuts, done):
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(ranks, rank)
                places[rank].append(place)
        return "".join(text[a:b] for a, b in gaps.left()), count

    def joined(self, low: str, gaps: _Gaps, cuts: list[tuple[tuple[int, int], ...]], done: int) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
        """Occurrences of later phrases across the cuts, as stretches of the whole text."""
        end = -1
        for place in cuts:
            if place[-1][1] <= end:  # in the same gap as the cut before
                continue
            end = gaps.dead.find(0, place[-1][1])
            if end < 0:
                return
            front = gaps.before(gaps.begin[end], self.longest - 1)
            around = front + gaps.after(end, self.longest - 1)
            border = sum(b - a for a, b in front)
            for last, (rank, size) in self.tree.iter("".join(low[a:b] for a, b in around)):
                if rank > done and last >= border > last + 1 - size:
                    yield rank, _part(around, last + 1 - size, last + 1)


def _part(stretches: list[tuple[int, int]], start: int, end: int) -> tuple[tuple[int, int], ...]:
    """The stretches that hold the characters from start to end of what all stretches hold."""
    found, at = [], 0
    for a, b in stretches:
        x, y = max(start, at), min(end, at + b - a)
        if x < y:
            found.append((a + x - at, a + y - at))
        at += b - a
    return tuple(found)


@functools.lru_cache(maxsize=4)
def _compiled(phrases: tuple[str, ...]) -> Phrases:
    return Phrases(phrases)


def remove_phrases(text: Column, phrases: tuple[str, ...]) -> Column:
    """A struct of the text without the phrases and the count; null for null."""

    @F.pandas_udf("text string, n bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _compiled(phrases)
        for values in batches:
            rows = [(None, None) if v is None else known.removed(v) for v in values]
            yield pd.DataFrame({"text": [r[0] for r in rows], "n": pd.array([r[1] for r in rows], dtype="Int64")})

    return run(text)
