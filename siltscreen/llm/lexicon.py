"""A minimal acyclic transducer: words to ordinals, by weights on shared arcs, and ordinals to ids."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

#: Bits of a code point in an arc's key.
CODE_BITS = 21
HEADER = 5


def compiled(chosen: Sequence[str], ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One int64 array: header, arcs, final states, and the ids of each word.

    `chosen` is sorted and has no word twice.  Words enter in order; whenever one leaves the path of
    the word before it, the states left behind are final and are replaced by an equal state that the
    automaton already has, so equal suffixes share their states.  An arc's weight is the number of
    words that come before those it leads to, so a word's weights add up to its place in the order.
    """
    # A state is [accepting, {code: state}, number of words, register id]; insertion order is code order.
    register: dict[tuple, list] = {}
    root: list = [False, {}, 0, -1]
    path: list[tuple[list, int]] = []
    last = ""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, code = path.pop()
            state = parent[1][code]
            key = (state[0], *((c, s[3]) for c, s in state[1].items()))
            same = register.get(key)
            if same is None:
                state[2] = state[0] + sum(s[2] for s in state[1].values())
                state[3] = len(register) + 1
                register[key] = state
            else:
                parent[1][code] = same

    for word in chosen:
        shared = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        settle(shared)
        state = path[-1][0][1][path[-1][1]] if path else root
        for letter in word[shared:]:
            state[1][ord(letter)] = new = [False, {}, 0, -1]
            path.append((state, ord(letter)))
            state = new
        state[0] = True
        last = word
    settle(0)
    root[3] = 0
    keys, targets, weights, final = [], [], [], np.zeros(len(register) + 1, np.int64)
    for state in (root, *register.values()):
        before = int(state[0])
        final[state[3]] = before
        for code, target in state[1].items():
            keys.append(state[3] << CODE_BITS | code)
            targets.append(target[3])
            weights.append(before)
            before += target[2]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    parts = [np.array(x, np.int64)[order] for x in (keys, targets, weights)]
    longest = max(map(len, chosen), default=0)
    header = np.array([len(keys), len(final), len(chosen), len(ids), longest], np.int64)
    return np.concatenate([header, *parts, final, bounds.astype(np.int64), ids.astype(np.int64)])


class Lexicon:
    def __init__(self, data: np.ndarray) -> None:
        arcs, states, n, n_ids, self.longest = (int(x) for x in data[:HEADER])
        cuts = np.cumsum([HEADER, arcs, arcs, arcs, states, n + 1, n_ids])
        self.keys, self.targets, self.weights, self.final, self.bounds, self.values = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def mapped(path: str) -> Lexicon:
        return Lexicon(np.memmap(path, np.int64, "r"))

    def find(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's place in the order, or -1: all words follow the automaton together, letter by letter."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        length = ends - starts
        live = np.flatnonzero(length <= self.longest)
        state, place = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for i in range(self.longest + 1):
            done = length[live] == i
            accepted = done & (self.final[state] == 1)
            out[live[accepted]] = place[accepted]
            live, state, place = live[~done], state[~done], place[~done]
            if not len(live):
                break
            keys = state << CODE_BITS | codes[starts[live] + i].astype(np.int64)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ok = self.keys[at] == keys
            live, at = live[ok], at[ok]
            state, place = self.targets[at], place[ok] + self.weights[at]
        return out

    def counts(self, places: np.ndarray) -> np.ndarray:
        return self.bounds[places + 1] - self.bounds[places]

    def ids(self, places: np.ndarray) -> np.ndarray:
        size = self.counts(places)
        ends = np.cumsum(size)
        at = np.repeat(self.bounds[places] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.values[at]
