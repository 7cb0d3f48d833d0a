"""Runs of windows that share a minimizer: the pieces in which repeated windows can be found.

A window is `width` consecutive symbols of one text. Its minimizer is the leftmost smallest hash
among its k-grams. Equal windows have equal minimizers at equal offsets, so a window can only
repeat where its minimizer repeats, and consecutive windows with the same minimizer travel as one
string of `width + windows - 1` symbols. Nothing is lost by it: every window is in exactly one run.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

POSITION_BITS = 20
#: Symbols hashed at once; positions inside a chunk fit POSITION_BITS.
CHUNK = 1 << 18
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Runs(NamedTuple):
    key: np.ndarray  # hash of the minimizer, 44 bits
    start: np.ndarray  # first window's first symbol, in the concatenated texts
    windows: np.ndarray  # number of windows
    anchor: np.ndarray  # place of the minimizer


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram, by doubling: two hashes of half the length make one."""
    parts, have, size = [], symbols.astype(np.uint64), 1
    offset, hashed, rest = 0, None, k
    while rest:
        if rest & 1:
            if hashed is None:
                hashed = have
            else:
                n = min(len(hashed), max(0, len(have) - offset))
                hashed = hashed[:n] * np.uint64(0x9E3779B97F4A7C15) + have[offset:offset + n]
            offset += size
        rest >>= 1
        if rest:
            factor = np.uint64((0xD6E8FEB86659FD93 * (2 * size + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
            have = have[:-size] * factor + have[size:] if len(have) > size else have[:0]
            have = have ^ (have >> np.uint64(29))
            size *= 2
    del parts
    return mix(hashed[:max(0, len(symbols) - k + 1)])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < width:
        values = np.minimum(values[:-(width - size)], values[width - size:])
    return values


def find_runs(symbols: np.ndarray, ends: np.ndarray, width: int, k: int) -> Runs:
    """Runs of the texts that end at `ends` in the concatenated `symbols`."""
    found = []
    step = (1 << POSITION_BITS) - width if len(symbols) > CHUNK else len(symbols)
    step = min(step, CHUNK)
    for begin in range(0, max(0, len(symbols) - width + 1), max(1, step)):
        part = symbols[begin:begin + step + width - 1]
        found.append(_chunk_runs(part, begin, ends, width, k))
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none.astype(np.uint64), none, none, none)
    return Runs(*(np.concatenate(x) for x in zip(*found)))


def _chunk_runs(part: np.ndarray, begin: int, ends: np.ndarray, width: int, k: int) -> Runs:
    grams = gram_hashes(part, k)
    place = np.arange(len(grams), dtype=np.uint64)
    packed = (grams >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS) | place
    least = sliding_min(packed, width - k + 1)
    n = len(least)
    valid = np.ones(n, bool)  # windows that cross the end of a text are none
    inner = ends[(ends > begin) & (ends < begin + len(part))] - begin
    for shift in range(1, width):
        crossing = inner - shift
        valid[crossing[(crossing >= 0) & (crossing < n)]] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    stop = np.flatnonzero(~valid)
    until = np.append(start[1:], n)
    if len(stop):
        after = np.searchsorted(stop, start)
        until = np.minimum(until, np.append(stop, n)[after])
    chosen = least[start]
    anchor = (chosen & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    return Runs(chosen >> np.uint64(POSITION_BITS), start + begin, until - start, anchor + begin)
