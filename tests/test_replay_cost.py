"""The replay of open elements holds one page at a time."""

import tracemalloc

import pyarrow as pa

from siltscreen.functions import elements


def test_pages_are_replayed_one_by_one():
    page = ["+div", "+p", "", "-p", "+b", "", "-b", "-div"] * 50
    names, flags = pa.array([page] * 500, pa.list_(pa.string())), pa.array([[0] * 400] * 500, pa.list_(pa.int32()))
    tracemalloc.start()
    elements.replayed(names, flags, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000 * 80  # bytes a token, whatever the pages are


def test_replay_in_parts(monkeypatch):
    pages = [["+p", "", "-p"], None, [], ["+b", "+p", " ", "-b"], ["?"], None]
    names = pa.array([["+p"], *pages], pa.list_(pa.string()))[1:]
    flags = pa.array([[0], *[None if p is None else [0] * len(p) for p in pages]], pa.list_(pa.int32()))[1:]
    whole = elements.replayed(names, flags, False).to_pylist()
    want = [None if p is None else elements.Replay(p, [0] * len(p)) for p in pages]
    assert whole == [{n: None if w is None else list(getattr(w, n)) for n in elements.NUMBERS} for w in want]
    monkeypatch.setattr(elements, "PART_TOKENS", 4)
    parts = list(elements._in_parts(iter([(names, flags)]), False))
    assert [len(p) for p in parts] == [3, 1, 2] and [r for p in parts for r in p.to_pylist()] == whole
    assert [len(p) for p in elements._in_parts(iter([(names[:0], flags[:0])]), False)] == [0]
