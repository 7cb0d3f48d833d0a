"""Repeated byte strings, by a collection's Burrows-Wheeler transform built column by column.

The strings of a bucket form a collection. Round j inserts the suffixes of length j of all its
strings: the place of each follows from its last place by counting symbols in the transform so far,
and the common prefixes with its neighbours from those of the round before. The transform and the
prefix lengths are read and written front to back, once per round. Suffixes with a common prefix of
WIDTH bytes are equal windows; the one that stands first in the corpus stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.llm import blocks, repeats
from furrow.llm.runs import mix

WIDTH = 100
K = 24
#: Bytes of strings whose transform is built at once; strings of one minimizer stay together.
COLLECTION_BYTES = 1 << 18

_SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, " \
          "kept binary"
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                    ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])
_BYTE_HASHES = mix(np.arange(1, 257, dtype=np.uint64))


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    return _BYTE_HASHES[data], np.cumsum([len(t) for t in texts])


UNIT = repeats.Unit(_symbols, lambda text: text, bytes, WIDTH, K)


def _range_min(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima of values[begin:end], by a table of minima over powers of two."""
    size = end - begin
    level = np.frexp(size)[1] - 1
    out = np.zeros(len(begin), values.dtype)
    table, width = values, 1
    for j in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == j)
        out[own] = np.minimum(table[begin[own]], table[end[own] - width])
        if 2 * width <= len(values):
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def collection_order(content: list[bytes], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the strings in order, as places in the strings joined by one end symbol
    each, and the common prefix of each with the one before, up to `limit`."""
    m = len(content)
    text = np.frombuffer(b"\0" + b"\0".join(content) + b"\0", np.uint8).astype(np.uint16) + 1
    sizes = np.array([len(c) for c in content], np.int64)
    stops = np.cumsum(sizes + 1)  # place of each string's end symbol
    text[0] = 0
    text[stops] = 0
    place = stops.astype(np.int32)
    transform = text[place - 1]
    common = np.zeros(m, np.uint8)
    active = np.arange(m)[sizes > 0]
    for length in range(1, int(sizes.max(initial=0)) + 1):
        order = np.argsort(transform, kind="stable")
        ended = int(np.searchsorted(transform[order], 1)) if len(order) < 64 else \
            len(transform) - int(np.count_nonzero(transform))
        order = order[ended:]
        inserted = np.zeros(len(transform), bool)
        inserted[active] = True
        rank = np.flatnonzero(inserted[order])
        at = rank + m
        total = len(transform) + len(at)
        old = np.ones(total, bool)
        old[at] = False
        grown = []
        for values in (place, transform, common):
            bigger = np.empty(total, values.dtype)
            bigger[old] = values
            grown.append(bigger)
        source = order[rank]
        new_place = place[source] - 1
        _insert_common(grown[2], common, transform, order, rank, at, m, limit)
        place, transform, common = grown
        place[at] = new_place
        transform[at] = text[new_place - 1]
        active = at[transform[at] > 0]
        if not len(active):
            break
    return place.astype(np.int64) - 1, common


def _insert_common(grown, common, transform, order, rank, at, m, limit) -> None:
    """Common prefixes of the inserted suffixes and of their followers: one more than the least
    between the places from which both were extended; none if they begin differently."""
    for shift in (0, 1):  # (before, inserted), (inserted, follower)
        second = rank + shift
        inside = second < len(order)
        second = second[inside]
        first = second - 1
        fine = first >= 0
        p, q = order[np.maximum(first, 0)], order[second]
        fine &= transform[p] == transform[q]
        value = np.zeros(len(second), grown.dtype)
        picked = np.flatnonzero(fine)
        least = _range_min(common, p[picked] + 1, q[picked] + 1)
        value[picked] = np.minimum(least.astype(np.int16) + 1, limit)
        grown[second + m] = value


def later_windows(content: list[bytes], width: int) -> np.ndarray:
    """Places, in the strings joined by one symbol each, of windows that stand there earlier too."""
    place, common = collection_order(content, width)
    group = np.cumsum(common < width)
    alone = np.append(np.diff(group) != 0, True) & (common < width)
    place, group = place[~alone], group[~alone]
    order = np.lexsort((place, group))
    place, group = place[order], group[order]
    return np.sort(place[np.append(False, group[1:] == group[:-1])]) if len(place) else place


def solve(strings: repeats.Strings, width: int = WIDTH, k: int = K):
    """Repeated windows of a bucket's strings as (string, first window, count).

    A string whose content an earlier one has is a repeat as a whole. Strings of one minimizer can
    only share a window if they also share the half window before or behind the minimizer; the
    others stay out of the collection.
    """
    seen: dict[tuple, int] = {}
    distinct, again = [], []
    for i, item in enumerate(zip(strings.key.tolist(), strings.content)):
        if item in seen:
            again.append(i)
        else:
            seen[item] = i
            distinct.append(i)
    if again:
        repeated = np.array(again)
        yield repeated, np.zeros(len(again), np.int64), strings.windows[repeated].astype(np.int64)
    distinct = _that_share_halves(strings, distinct, (width - k) // 2, k)
    distinct.sort(key=lambda i: (strings.key[i], i))
    for part in _collections(strings, distinct):
        content = [strings.content[i] for i in part]
        starts = np.cumsum([0] + [len(c) + 1 for c in content])[:-1]
        string, first, count = repeats.later_spans(later_windows(content, width), starts)
        yield np.array(part, np.int64)[string], first, count


def _that_share_halves(strings: repeats.Strings, distinct: list[int], half: int,
                       k: int) -> list[int]:
    halves, counts = {}, Counter()
    for i in distinct:
        key, content, anchor = int(strings.key[i]), strings.content[i], int(strings.anchor[i])
        own = []
        if anchor >= half:
            own.append((key, 0, content[anchor - half:anchor + k]))
        if anchor + k + half <= len(content):
            own.append((key, 1, content[anchor:anchor + k + half]))
        halves[i] = own
        counts.update(own)
    return [i for i in distinct if any(counts[x] > 1 for x in halves[i])]


def _collections(strings: repeats.Strings, distinct: list[int]) -> Iterator[list[int]]:
    part, size, last = [], 0, None
    for i in distinct:
        if size >= COLLECTION_BYTES and strings.key[i] != last:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(strings.content[i])
        last = strings.key[i]
    if part:
        yield part


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   hot: int = repeats.HOT_NOTES) -> DataFrame:
    """Removes bytes covered by a string of WIDTH bytes that also starts earlier in the corpus.

    Texts count as UTF-8, matches never cross documents, a null text is empty. Earlier: smaller
    id, or same text and earlier start; rows of one id are ordered by text, rows without an id come
    last. Strings are judged on the input. Returns one row per input row: doc_id, n_bytes,
    n_removed, `spans` of removed bytes and `kept`, the remaining bytes. Other columns are left out.
    """
    return repeats.repeated_windows(docs, UNIT, solve, _finish, _SCHEMA, doc_id, text, hot)


def _finish(rows: Iterator[tuple]) -> blocks.Batches:
    def results():
        for doc_id, text, starts, counts, _ in rows:
            text = text or b""
            if not len(starts):
                yield doc_id, len(text), 0, [], text
                continue
            removed = repeats.covered(len(text), starts, counts, WIDTH)
            begin, end = repeats.spans_of(removed)
            yield (doc_id, len(text), int(removed.sum()),
                   [{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())],
                   np.frombuffer(text, np.uint8)[~removed].tobytes())

    return blocks.results(results(), _TYPES, 4096)
