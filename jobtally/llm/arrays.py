"""Whole batches of text as numpy arrays: words, their hashes, and grouped reductions, without a loop over characters."""

from __future__ import annotations

import functools
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# An odd multiplier of the polynomial hash, and the multipliers of the 64-bit finisher: fixed values.
BASE = 0x9E3779B97F4A7C15
FINISH = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


class Words(NamedTuple):
    """Words of a batch: bounds in the code array, and the row each belongs to."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the bounds of each; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, data = column.buffers()
    bounds = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and the bounds of each."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


@functools.cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter or a mark inside words."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@functools.cache
def not_white() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(WHITE)] = False
    return table


def runs(inside: np.ndarray, bounds: np.ndarray) -> Words:
    """Maximal runs of true values that don't cross a bound."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    here = np.zeros(n + 1, bool)
    here[:n] = inside
    start = np.flatnonzero(here & (~before | cut))
    end = np.flatnonzero(before & (~here | cut))
    return Words(start, end, np.searchsorted(bounds, start, side="right") - 1)


_TABLE: list[tuple[np.ndarray, np.ndarray]] = []
TABLE_MOST = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse. A worker keeps one table, of the longest slice so far, and none of a longer text."""
    if not _TABLE or len(_TABLE[0][0]) < n:
        made = _made_powers(n)
        if n > TABLE_MOST:
            return made
        _TABLE[:] = [made]
    return tuple(x[:n] for x in _TABLE[0])


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(n, BASE, np.uint64)
    steps[:1] = 1
    back = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    back[:1] = 1
    return np.cumprod(steps), np.cumprod(back)


class Hashes:
    """64-bit hashes of any spans of a code array, each in constant time from one running sum."""

    def __init__(self, codes: np.ndarray):
        power, self.back = _powers(len(codes) + 1)
        self.sum = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sum[end] - self.sum[start]) * self.back[start])


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit spread over all 64."""
    x = x ^ (x >> np.uint64(33))
    for f in FINISH:
        x = x * np.uint64(f)
        x ^= x >> np.uint64(33)
    return x


def counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every span, one span after another."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(total)
