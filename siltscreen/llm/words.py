"""Word and character runs of whole text columns as arrays: boundaries, 64-bit hashes."""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import numpy as np

#: Fixed values of the hash: an odd base, its inverse modulo 2**64, and odd multipliers.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: Longer runs are hashed by blake2b: polynomial hashes modulo 2**64 have short-range collisions beyond it.
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(n, b, np.uint64) for b in (BASE, INVERSE))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def run_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of units[start:end] for every run; units are bytes or code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(1 << max(16, (len(units) - 1).bit_length()))
    total = np.zeros(len(units) + 1, np.uint64)
    # A part at a time: the temporary arrays stay small.
    for low in range(0, len(units), 1 << 18):
        part = slice(low, low + (1 << 18))
        np.cumsum(mixed(units[part].astype(np.uint64) + np.uint64(BASE)) * up[: len(units)][part], out=total[1:][part])
        total[1:][part] += total[low]
    out = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG):
        digest = hashlib.blake2b(units[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


class Words(NamedTuple):
    """Words of the rows of a column, in order."""

    hashes: np.ndarray
    rows: np.ndarray
    #: Where each row's words begin, and the end.
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x80:] = True
    return lower, inside


def lowered(data: np.ndarray) -> np.ndarray:
    return _tables()[0][data]


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of texts in UTF-8: runs of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII."""
    data = lowered(data)
    inside = _tables()[1][data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    here = np.append(inside, False)
    starts = np.flatnonzero(here & (~before | first))
    ends = np.flatnonzero(before & (~here | first))
    rows = np.searchsorted(offsets, starts, "right") - 1
    bounds = np.searchsorted(starts, offsets)
    return Words(run_hashes(data, starts, ends), rows, bounds, starts, ends)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n consecutive words from each word on, and each row's bounds among them.

    A row of fewer words, but not none, gives one shingle of all its words.
    """
    counts = np.diff(bounds)
    short = (counts > 0) & (counts < n)
    made = np.maximum(counts - n + 1, short)
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(made, out=out_bounds[1:])
    if not len(hashes):
        return np.zeros(0, np.uint64), out_bounds
    rows = np.repeat(np.arange(len(counts)), made)
    at = np.arange(out_bounds[-1]) - out_bounds[rows] + bounds[rows]
    size = np.minimum(counts, n)[rows]
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        live = k < size
        total = np.where(live, mixed(total * np.uint64(BASE) + hashes[np.minimum(at + k, len(hashes) - 1)]), total)
    return total, out_bounds
