"""The phrase automaton scans a text once, and what stands around deletions once more."""

import random
import string

from siltscreen.functions import phrases


class Counting:
    def __init__(self, tree):
        self.tree, self.scanned = tree, 0

    def iter(self, text):
        self.scanned += len(text)
        return self.tree.iter(text)


def test_a_text_with_many_phrases_is_not_scanned_once_for_each():
    words = [f"{a}{b} {b}{a}" for a in string.ascii_lowercase for b in string.ascii_lowercase if a < b]
    known = phrases.Phrases(tuple(words))
    known.tree = Counting(known.tree)
    text = " und ".join(words)
    assert known.removed(text) == (" und " * (len(words) - 1), len(words))
    assert known.tree.scanned < 5 * len(text)


def test_phrases_that_deletions_join_again_and_again():
    rng = random.Random(8)
    for _ in range(300):
        few = tuple({phrases.folded(p): p for p in ("".join(rng.choice("aAbÉ") for _ in range(rng.randint(1, 6))) for _ in range(20))}.values())
        text = "".join(rng.choice("abcé") for _ in range(60))
        want, count = text, 0
        for phrase in few:
            low, key = phrases.folded(want), phrases.folded(phrase)
            pieces, at = [], 0
            while (k := low.find(key, at)) >= 0:
                pieces.append(want[at:k])
                at, count = k + len(key), count + 1
            want = "".join(pieces) + want[at:]
        assert phrases.Phrases(few).removed(text) == (want, count)
