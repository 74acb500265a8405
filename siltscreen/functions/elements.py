"""Which elements every token of a page stands in: the open elements replayed in order.

Tree building depends on all tags before, so no window can express it.  This is the one Python step of
the HTML path: it sees tag names and flags of a page, never its text, and gives numbers a token.
Tags, flags, removal and rendering are Spark expressions on both sides of it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltscreen.functions import patterns as P

#: Set for every token that stands in an element.
ELEMENT = 1 << 30
#: Flags that are counted again where an element is opened anew: hidden, off screen, same colour.
HIDDEN, OFF_SCREEN, SAME_COLOR, NOSCRIPT, STRIPPED = 1, 2, 4, 8, 16
REMOVED = HIDDEN | OFF_SCREEN | SAME_COLOR | NOSCRIPT
#: Bits of one such count in `again`.
COUNT_BITS = 20

SCOPE = frozenset(P.SCOPE_TAGS)
SPECIAL = frozenset(P.SPECIAL_TAGS)
FORMATTING = frozenset(P.FORMATTING_TAGS)
MARKERS = frozenset(P.MARKER_TAGS)
CLOSES_P = frozenset(P.CLOSES_P)
HEADINGS = frozenset(P.HEADINGS)
ORDINARY_END = SPECIAL - {"p", "li", "dd", "dt"} - frozenset(P.TABLE_PARENTS) - HEADINGS
FOREIGN = frozenset(P.FOREIGN_TAGS)
TABLE_PARENTS = {name: frozenset(parents) for name, parents in P.TABLE_PARENTS.items()}
TABLE_CONTEXT = frozenset(["table", "tbody", "thead", "tfoot", "tr"])
BOXES = frozenset(["blockquote", "li"])
LISTS = frozenset(["ul", "ol"])
BLOCK_TAGS = frozenset(P.BLOCK_TAGS)
BLOCKS = BLOCK_TAGS - BOXES - LISTS
#: Marks of inline elements in `marks`: bold, emphasis, code, link.
MARK = {"b": "b", "strong": "b", "em": "e", "i": "e", "code": "c", "a": "a"}
LINK, PRE = 2048, 256


class Element:
    __slots__ = ("bits", "children", "copies", "heading", "marks", "name", "open", "own", "path", "place", "pos")

    def __init__(self, name: str, pos: int, own: int):
        self.name, self.pos, self.own = name, pos, own
        self.children, self.copies, self.open = 0, 0, True
        self.settle(None)

    def settle(self, around: Element | None) -> None:
        """Take over what holds around this element, and add what it is itself."""
        self.bits, self.path, self.marks, self.place, self.heading = self.own | ELEMENT, "", "", None, 0
        if around is not None:
            self.heading = around.heading
            self.bits, self.path, self.marks = self.own | ELEMENT | around.bits, around.path, around.marks
            self.place = around.place if around.name else around.pos
        if self.name in BOXES:
            self.path += f"{self.name[0]}{self.pos} "
        elif self.name in BLOCKS and not self.path.endswith("p "):
            self.path += "p "
        if self.name in MARK and (self.name != "a" or self.own & LINK) and not (self.name == "code" and self.bits & PRE):
            self.marks += f"{MARK[self.name]}{self.pos}.{self.copies} "
        if self.name in HEADINGS:
            self.heading = int(self.name[1])

    def copy(self) -> Element:
        made = Element(self.name, self.pos, self.own)
        made.copies = self.copies + 1
        return made


class Replay:
    """One page.  `tokens` are names with a mark before them: + start, / start that ends with "/>",
    = whole element, * void, - end, ! comment; "" is text, " " white space, "?" anything else.

    An end tag closes what stands above its element.  Formatting elements that only a start tag closed, with
    the paragraph or item around them, are opened anew where text goes on.  With `reopens` those that an end
    tag closed are as well, and a block that crosses the end of one moves out of it.
    """

    def __init__(self, tokens: list[str], flags: list[int], reopens: bool = False):
        n = len(tokens)
        self.reopens = reopens
        self.end, self.inside, self.again = [-1] * n, [0] * n, [0] * n
        self.nth, self.up, self.place = [-1] * n, [-1] * n, list(range(n))
        self.path, self.marks, self.last, self.heading = [""] * n, [""] * n, [0] * n, [0] * n
        self.stack: list[Element] = []
        self.latest: dict[int, int] = {}
        self.active: list[Element | None] = []
        self.where: dict[str, list[int]] = {}
        self.bounds: list[int] = [-1]
        self.foreign = any(token[1:] in FOREIGN for token in set(tokens))
        for i, token in enumerate(tokens):
            mark, name = token[:1], token[1:]
            if mark in ("+", "/", "=", "*"):
                self.start(i, name, flags[i], mark)
            elif mark == "-":
                self.finish(i, name)
            else:
                if mark == "" and self.active and self.active[-1] is not None and not self.active[-1].open:
                    self.reopen(i)
                top = self.stack[-1] if self.stack else None
                if top is not None and top.place is None and top.name not in TABLE_CONTEXT:
                    self.inside[i], self.path[i], self.marks[i], self.heading[i] = top.bits, top.path, top.marks, top.heading
                else:
                    self.stand(i, self.holder(mark == ""))
        for e in self.stack:
            self.end[e.pos] = max(self.end[e.pos], n - 1)
        self.run = self.runs(tokens)

    def runs(self, tokens: list[str]) -> list[int]:
        """Numbers of the stretches between the begins and ends of blocks, in order of `place`; a rule is one of its own."""
        order = range(len(tokens))
        if self.place != list(order):
            order = sorted(order, key=lambda i: (2 * i if self.place[i] == i else 2 * self.place[i] - 1, i))
        out, run = [0] * len(tokens), 0
        for i in order:
            token = tokens[i]
            block = token[1:] in BLOCK_TAGS and token[0] in "+/-*" and not self.inside[i] & (REMOVED | STRIPPED)
            rule = block and token == "*hr"
            run += 2 if rule else 1 if block else 0
            out[i] = run - rule
        return out

    # The stack

    def holder(self, moves: bool) -> Element | None:
        """What a token goes into: the current element, but around the table for what cannot stand in one."""
        top = self.stack[-1] if self.stack else None
        if not moves or top is None or top.name not in TABLE_CONTEXT or not self.where.get("table"):
            return top
        k = self.where["table"][-1]
        around = Element("", self.stack[k].pos, 0)
        around.bits = 0
        if k:
            below = self.stack[k - 1]
            around.bits, around.path, around.marks, around.heading = below.bits, below.path, below.marks, below.heading
        return around

    def stand(self, i: int, e: Element | None) -> None:
        if e is not None:
            self.inside[i], self.path[i], self.marks[i], self.heading[i] = e.bits, e.path, e.marks, e.heading
            if not e.name or e.place is not None:
                self.place[i] = e.pos if not e.name else e.place

    def push(self, i: int, e: Element, fosters: bool = False) -> Element:
        e.settle(self.holder(fosters))
        self.where.setdefault(e.name, []).append(len(self.stack))
        if e.name in SCOPE:
            self.bounds.append(len(self.stack))
        self.stack.append(e)
        e.open = True
        return e

    def pop(self, last: int) -> Element:
        e = self.stack.pop()
        self.where[e.name].pop()
        if e.name in SCOPE:
            self.bounds.pop()
        e.open = False
        self.end[e.pos] = max(self.end[e.pos], last)
        if e.name in MARKERS:
            while self.active and self.active.pop() is not None:
                pass
        return e

    def pop_to(self, k: int, last: int) -> None:
        while len(self.stack) > k:
            self.pop(last)

    def reach(self, name: str, *more: str) -> int:
        """Place of the nearest open element of this name in scope, or -1; `more` bound the scope as well."""
        found = self.where.get(name)
        if not found:
            return -1
        edge = self.bounds[-1]
        for m in more:
            if (other := self.where.get(m)) and other[-1] > edge:
                edge = other[-1]
        return found[-1] if found[-1] >= edge else -1

    # Start tags

    def start(self, i: int, name: str, own: int, mark: str) -> None:
        foreign = self.foreign and (name in FOREIGN or any(self.where.get(f) for f in FOREIGN))
        whole = mark in ("=", "*") or (mark == "/" and foreign)
        if not foreign:
            self.make_room(i, name)
        if self.reopens and name in TABLE_PARENTS and not self.where.get("table"):
            return self.stand(i, self.holder(False))
        fosters = name not in TABLE_PARENTS and name not in ("script", "style", "template")
        if fosters and name not in SPECIAL:
            self.reopen(i)
        if self.reopens and name == "a" and (old := self.formatting("a")):
            self.adopt(i - 1, "a")
            self.active = [e for e in self.active if e is not old]
            if old.open:
                self.remove(old)
        parent = self.holder(fosters)
        self.up[i] = parent.pos if parent is not None and parent.name else -1
        if parent is not None and not (own & (REMOVED | STRIPPED)):
            self.nth[i], parent.children = parent.children, parent.children + 1
            if parent.name == "li":
                # Whether a list is its item's last element is known when no other follows.
                self.last[self.latest.get(parent.pos, i)] = 0
                self.last[i] = 1
                self.latest[parent.pos] = i
        e = self.push(i, Element(name, i, own), fosters)
        self.stand(i, e)
        self.place[i] = i if e.place is None else e.place
        if whole:
            self.pop(i)
        elif name in FORMATTING:
            self.remember(e)
        elif name in MARKERS:
            self.active.append(None)

    def make_room(self, i: int, name: str) -> None:
        """Close what this start tag ends."""
        if name in ("li", "dd", "dt"):
            ends = ("li",) if name == "li" else ("dd", "dt")
            for k in range(len(self.stack) - 1, -1, -1) if any(self.where.get(e) for e in ends) else ():
                if self.stack[k].name in ends:
                    self.pop_to(k, i - 1)
                    break
                if self.stack[k].name in SPECIAL and self.stack[k].name not in ("address", "div", "p"):
                    break
        if name in CLOSES_P and (k := self.reach("p", "button")) >= 0:
            self.pop_to(k, i - 1)
        if name in TABLE_PARENTS and self.where.get("table"):
            while self.stack[-1].name not in TABLE_PARENTS[name]:
                self.pop(i - 1)
        top = self.stack[-1].name if self.stack else ""
        if (name in HEADINGS and top in HEADINGS) or (name in ("rt", "rp") and top in ("rt", "rp")) or (name == "body" and top == "head"):
            self.pop(i - 1)
        elif name == "button" and (k := self.reach("button")) >= 0:
            self.pop_to(k, i - 1)
        elif name in ("option", "optgroup"):
            if top == "option":
                self.pop(i - 1)
            if name == "optgroup" and self.stack and self.stack[-1].name == "optgroup":
                self.pop(i - 1)

    # Formatting elements

    def formatting(self, name: str) -> Element | None:
        for e in reversed(self.active):
            if e is None or e.name == name:
                return e
        return None

    def remember(self, e: Element) -> None:
        """At most three alike since the last marker."""
        alike = []
        for old in reversed(self.active):
            if old is None:
                break
            if old.name == e.name and old.own == e.own:
                alike.append(old)
        if len(alike) > 2:
            self.active.remove(alike[-1])
        self.active.append(e)

    def count_again(self, i: int, e: Element, bits: int) -> None:
        """A copy of an element is an element: it counts unless an earlier phase removes what it stands in."""
        gone = bits | e.own
        hits = (bool(e.own & HIDDEN), bool(e.own & OFF_SCREEN) and not gone & HIDDEN, bool(e.own & SAME_COLOR) and not gone & (HIDDEN | OFF_SCREEN))
        self.again[i] += sum(hit << (COUNT_BITS * k) for k, hit in enumerate(hits))

    def reopen(self, i: int) -> None:
        """Open anew the formatting elements that were closed by the end of an element around them."""
        if not self.active or self.active[-1] is None or self.active[-1].open:
            return
        k = len(self.active)
        while k and self.active[k - 1] is not None and not self.active[k - 1].open:
            k -= 1
        for k in range(k, len(self.active)):
            made = self.push(i, self.active[k].copy(), True)
            if self.reopens:
                self.count_again(i, made, made.bits & ~made.own)
            self.active[k] = made

    def remove(self, e: Element) -> None:
        self.stack.remove(e)
        e.open = False
        self.index()

    def index(self) -> None:
        self.where, self.bounds = {}, [-1]
        for k, e in enumerate(self.stack):
            self.where.setdefault(e.name, []).append(k)
            if e.name in SCOPE:
                self.bounds.append(k)

    # End tags

    def finish(self, i: int, name: str) -> None:
        self.stand(i, self.holder(False))
        if name in FORMATTING:
            return self.adopt(i, name) if self.reopens else self.end_formatting(i, name)
        if name == "p":
            k = self.reach("p", "button")
        elif name == "li":
            k = self.reach("li", "ol", "ul")
        elif name in HEADINGS:
            k = max(self.reach(h) for h in HEADINGS)
        elif name == "table" or name in TABLE_PARENTS:
            tables = self.where.get("table") or [0]
            k = (self.where.get(name) or [-1])[-1]
            k = k if k >= tables[-1] else -1
        elif name in ("body", "html"):
            return
        elif name in ORDINARY_END or name in MARKERS or name in ("dd", "dt") or not self.reopens:
            k = self.reach(name)
        else:
            return self.other_end(i, name)
        if k >= 0:
            pos = self.stack[k].pos
            self.close(k, i)
            if not self.reopens:
                self.forget(pos)

    def forget(self, pos: int) -> None:
        """Formatting elements that began after this place are not opened anew."""
        while self.active and self.active[-1] is not None and self.active[-1].pos >= pos:
            self.active.pop()

    def end_formatting(self, i: int, name: str) -> None:
        e = self.formatting(name)
        k = self.reach(name)
        if e is not None and e.open and k >= 0:
            self.close(k, i)
        if e is not None:
            self.forget(e.pos)

    def close(self, k: int, i: int) -> None:
        """Close the k-th open element with the end tag at i, which stands in it; what it holds ends before."""
        e = self.stack[k]
        self.pop_to(k + 1, i - 1)
        self.stand(i, e)
        self.pop(i)

    def other_end(self, i: int, name: str) -> None:
        k = (self.where.get(name) or [-1])[-1]
        if k >= 0 and not any(e.name in SPECIAL for e in self.stack[k + 1 :]):
            self.close(k, i)

    def adopt(self, i: int, name: str) -> None:
        """End a formatting element; blocks that it does not end move out and keep copies of it inside."""
        top = self.stack[-1] if self.stack else None
        if top is not None and top.name == name and top not in self.active:
            return self.close(len(self.stack) - 1, i)
        for _ in range(8):
            e = self.formatting(name)
            if e is None:
                return self.other_end(i, name)
            if not e.open:
                self.active.remove(e)
                return None
            k = self.stack.index(e)
            if k < self.bounds[-1]:
                return None
            block = next((j for j in range(k + 1, len(self.stack)) if self.stack[j].name in SPECIAL), None)
            if block is None:
                self.close(k, i)
                self.active.remove(e)
                return None
            self.move_out(i, e, k, block)
        return None

    def move_out(self, i: int, e: Element, k: int, block: int) -> None:
        """The block at `block` leaves the formatting element at k, with copies of formatting elements between them."""
        around = self.stack[k - 1] if k else None
        far = self.stack[block]
        between = [x for x in self.stack[k + 1 : block] if x in self.active][-3:]
        for x in self.stack[k:block]:
            x.open = False
            self.end[x.pos] = max(self.end[x.pos], far.pos - 1)
        copies = []
        for x in between:
            made = x.copy()
            made.settle(around)
            self.count_again(i, made, around.bits if around else 0)
            self.active[self.active.index(x)] = around = made
            copies.append(made)
        far.settle(around)
        self.inside[far.pos] = far.bits
        inner = e.copy()
        inner.settle(far)
        self.count_again(i, inner, far.bits)
        self.active[self.active.index(e)] = inner
        above = self.stack[block + 1 :]
        self.stack[k:] = [*copies, far, inner, *above]
        for x, below in zip(above, [inner, *above], strict=False):
            x.settle(below)
        self.index()


NUMBERS = {"end": "int", "inside": "int", "again": "bigint", "nth": "int", "up": "int", "place": "int", "last": "int", "run": "int", "heading": "int", "path": "string", "marks": "string"}


#: Tokens of the pages that are replayed before their numbers are handed on.
PART_TOKENS = 100_000


class _Strings:
    """The strings of many tokens, each kept once."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.codes = array("i")

    def extend(self, strings: list[str]) -> None:
        known = self.known
        self.codes.extend([known.setdefault(s, len(known)) for s in strings])

    def values(self) -> pa.Array:
        return pa.array(list(self.known), pa.string()).take(pa.array(self.codes, pa.int32()))


class _Numbers:
    def __init__(self, kind: str):
        self.kind, self.numbers = {"int": pa.int32(), "bigint": pa.int64()}[kind], array({"int": "i", "bigint": "q"}[kind])

    def extend(self, numbers: list[int]) -> None:
        self.numbers.extend(numbers)

    def values(self) -> pa.Array:
        return pa.array(self.numbers, self.kind)


def parts(names: pa.Array, flags: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Pages in turn, as many at a time as have PART_TOKENS tokens, or one."""
    start, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.list_value_length(names), 0).to_pylist()):
        if k > start and size + n > PART_TOKENS:
            yield names[start:k], flags[start:k]
            start, size = k, 0
        size += n
    yield names[start:], flags[start:]


def replayed(names: pa.Array, flags: pa.Array, reopens: bool) -> pa.Array:
    """The replay of every page as arrays, one entry a token; null for null.  A page's elements go before the next page."""
    found = {n: _Strings() if t == "string" else _Numbers(t) for n, t in NUMBERS.items()}
    words = names.flatten().dictionary_encode()
    known = words.dictionary.to_pylist()
    tokens, bits = words.indices.to_numpy(zero_copy_only=False), flags.flatten().to_numpy(zero_copy_only=False)
    ends, at = array("i", [0]), 0
    for n in pc.fill_null(pc.list_value_length(names), 0).to_pylist():
        page = Replay([known[k] for k in tokens[at : at + n].tolist()], bits[at : at + n].tolist(), reopens)
        for name, values in found.items():
            values.extend(getattr(page, name))
        at += n
        ends.append(at)
    nulls = names.is_null() if names.null_count else None
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.values(), mask=nulls) for values in found.values()]
    return pa.StructArray.from_arrays(lists, list(NUMBERS))


def _in_parts(batches: Iterator[tuple[pa.Array, pa.Array]], reopens: bool) -> Iterator[pa.Array]:
    for names, flags in batches:
        for part in parts(names, flags):
            yield replayed(*part, reopens)


_KINDS = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType()}
_RESULT = T.StructType([T.StructField(n, T.ArrayType(_KINDS[t])) for n, t in NUMBERS.items()])


@F.arrow_udf(_RESULT)
def replay(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return _in_parts(batches, False)


@F.arrow_udf(_RESULT)
def replay_reopening(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return _in_parts(batches, True)
