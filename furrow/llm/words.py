"""Words of many texts as 64-bit hashes, worked out for whole batches in numpy."""

from __future__ import annotations

import numpy as np

from furrow.llm.runs import mix

#: ASCII white space: \\x20 and \\x09-\\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers[size] = tuple(tables)
    return _powers[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words end among them.

    Words are runs of bytes other than ASCII white space. Equal words have equal hashes in every
    batch and on every machine; different words differ but for a chance of 2^-64 a pair.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    blank = _SPACE[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[0::2], edge[1::2]
    powers, inverse = _power_tables(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * powers[:len(data)])])
    hashes = (sums[stops] - sums[starts]) * inverse[starts]
    hashes = mix(hashes + (stops - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return hashes, np.searchsorted(stops, ends_at, side="left")
