"""Windows that stand earlier in the corpus, found through blocks and buckets.

Shared frame of the two substring operators; they differ in their symbols (bytes, words) and in the
structure that a bucket builds to compare strings (`solve`).

1. `ask` sends the minimizers of each block's runs to their buckets, `answer` returns those that
   stand in the corpus more than once.
2. Each block cuts its runs with such minimizers into strings. A string that stood in the block
   before is a repeat as a whole; the first of each goes to its minimizer's bucket, which compares
   the windows of all its strings and returns the repeated ones.
3. Each block marks and removes what repeated windows cover.

A minimizer that stands in more than `hot` notes would gather strings without end in one bucket.
Its windows are sent one by one to buckets of their own hashes instead, so that a bucket gets a
frequent window once per block, and windows of different content part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from furrow.llm import blocks
from furrow.llm.runs import Runs, find_runs

#: Notes of one minimizer (at most one per block) beyond which its windows part.
HOT_NOTES = 256
#: Bytes of texts whose runs are sought at once.
BATCH_BYTES = 1 << 18
#: Keys a task holds before it sends them.
HELD_KEYS = 4_000_000
_TYPES = {"q": np.int64, "Q": np.uint64, "i": np.int32, "B": np.uint8}


class Unit(NamedTuple):
    """What a window is made of."""

    symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]  # texts -> hashes, ends
    pieces: Callable[[bytes], object]  # a text, sliced by symbols ...
    content: Callable[[object], bytes]  # ... and a slice as bytes
    width: int
    k: int


class Strings(NamedTuple):
    """Strings of a bucket in the order in which they stand in the corpus."""

    key: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    content: list[bytes]


def pack(*arrays: np.ndarray) -> bytes:
    parts = []
    for a in arrays:
        parts += [struct.pack("<cq", a.dtype.char.replace("L", "Q").replace("l", "q").encode(), len(a)),
                  a.tobytes()]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        char, n = struct.unpack_from("<cq", data, at)
        kind = _TYPES[char.decode()]
        out.append(np.frombuffer(data, kind, n, at + 9))
        at += 9 + n * np.dtype(kind).itemsize
    return out


def repeated_windows(docs: DataFrame, unit: Unit, solve: Callable[[Strings], Iterator],
                     finish: Callable, schema: str, doc_id: str, text: str,
                     hot: int = HOT_NOTES, keep: Sequence[str] = ()) -> DataFrame:
    """`finish(rows)` per block; rows are (doc_id, text, starts, counts, kept) with the first and the
    number of the repeated windows of each document and its columns named by `keep`. `solve` yields
    (string, first, count)."""
    rows = blocks.texts(docs, doc_id, text)
    n = blocks.bucket_count(docs)

    def minimizers(batches):
        return blocks.notes(_minimizers(batches, unit, n))

    def repeated(batches):
        return blocks.answers(repeated_keys(batches, hot))

    def strings(batches):
        return blocks.notes(_strings(batches, unit, n))

    def compared(batches):
        return blocks.answers(_compared(batches, solve))

    def finished(batches):
        return finish(_marked(batches))

    known = blocks.answer(blocks.ask(rows, minimizers), repeated)
    notes = blocks.use(rows, known, strings, blocks.NOTES, ordered=True)
    found = blocks.answer(notes, compared)
    return blocks.use(blocks.texts(docs, doc_id, text, keep), found, finished, schema, ordered=True)


# --- step 1 --------------------------------------------------------------------------------------

def _runs(texts: list[bytes], unit: Unit) -> tuple[Runs, np.ndarray]:
    symbols, ends = unit.symbols(texts)
    return find_runs(symbols, ends, unit.width, unit.k), ends


def _minimizers(batches, unit: Unit, n: int) -> Iterator[tuple[int, int, bytes]]:
    held: dict[int, list[np.ndarray]] = {}
    size = 0
    for block, texts in _text_batches(batches):
        keys = _runs(texts, unit)[0].key
        held.setdefault(block, []).append(keys)
        size += len(keys)
        if size > HELD_KEYS:
            yield from keys_sent(held, n)
            held, size = {}, 0
    yield from keys_sent(held, n)


def _text_batches(batches) -> Iterator[tuple[int, list[bytes]]]:
    held: dict[int, list] = {}
    for block, _, _, text, _ in blocks.read(batches):
        own = held.setdefault(block, [0, []])
        own[0] += len(text or b"")
        own[1].append(text or b"")
        if own[0] >= BATCH_BYTES:
            yield block, own[1]
            del held[block]
    for block, own in held.items():
        yield block, own[1]


def keys_sent(held: dict[int, list[np.ndarray]], n: int) -> Iterator[tuple[int, int, bytes]]:
    """Notes of each block's distinct keys (63 bits); the lowest bit marks those that it has twice."""
    for block, parts in held.items():
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        marked = keys << np.uint64(1) | (counts > 1)
        bucket = (keys % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
        for part in np.split(order, at[1:]) if len(order) else []:
            yield int(bucket[part[0]]), block, marked[part].tobytes()


def repeated_keys(batches, hot: int) -> Iterator[tuple[int, bytes]]:
    """Answers the keys that stand more than once; the lowest bit marks those in over `hot` notes."""
    for _, own in groupby(blocks.read(batches), key=lambda row: row[0]):
        sent = [(block, np.frombuffer(blocks.unpack(body), np.uint64)) for _, block, body in own]
        marked = np.concatenate([x for _, x in sent])
        keys, counts = np.unique(marked >> np.uint64(1), return_counts=True)
        within = np.unique(marked[marked & np.uint64(1) == 1] >> np.uint64(1))
        twice = (counts > 1) | np.isin(keys, within, assume_unique=True)
        keys, counts = keys[twice], counts[twice]
        if not len(keys):
            continue
        for block, x in sent:
            x = x >> np.uint64(1)
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            hit = keys[at] == x
            if hit.any():
                yield block, (x[hit] << np.uint64(1) | (counts[at[hit]] > hot)).tobytes()


# --- step 2 --------------------------------------------------------------------------------------

def _strings(batches, unit: Unit, n: int) -> Iterator[tuple[int, int, bytes]]:
    for block, own in groupby(blocks.read(batches), key=lambda row: row[0]):
        answers, place, size, held = [], 0, 0, []
        keys = None
        first: set[bytes] = set()
        sent = _Sent(block, n)
        for _, kind, _, text, body in own:
            if kind == 0:
                answers.append(np.frombuffer(blocks.unpack(body), np.uint64))
                continue
            if keys is None:
                keys = known_keys(answers)
            held.append(text or b"")
            size += len(held[-1])
            if size >= BATCH_BYTES:
                _cut(held, place, keys, unit, first, sent)
                place, held, size = place + len(held), [], 0
        if held:
            _cut(held, place, known_keys(answers) if keys is None else keys, unit, first, sent)
        yield from sent.notes()


def known_keys(answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    marked = np.unique(np.concatenate(answers)) if answers else np.zeros(0, np.uint64)
    return marked >> np.uint64(1), (marked & np.uint64(1)).astype(bool)


class _Sent:
    """Strings of a block by bucket, and its own repeats."""

    def __init__(self, block: int, n: int):
        self.block, self.n = block, n
        self.rows: dict[int, list[tuple]] = {}
        self.again: list[tuple[int, int, int]] = []

    def add(self, key: int, row: tuple) -> None:
        self.rows.setdefault(key % self.n, []).append((key, *row))

    def notes(self) -> Iterator[tuple[int, int, bytes]]:
        for bucket, rows in self.rows.items():
            key, doc, start, windows, anchor, content = zip(*rows)
            yield bucket, self.block, pack(
                np.array(key, np.uint64), np.array(doc, np.int32), np.array(start, np.int64),
                np.array(windows, np.int32), np.array(anchor, np.int32),
                np.array([len(c) for c in content], np.int32),
                np.frombuffer(b"".join(content), np.uint8))
        if self.again:
            yield -1 - self.block, self.block, pack(*(np.array(x, np.int64) for x in zip(*self.again)))


def _cut(texts: list[bytes], place: int, keys: tuple[np.ndarray, np.ndarray], unit: Unit,
         first: set[bytes], sent: _Sent) -> None:
    known, hot = keys
    if not len(known):
        return
    runs, ends = _runs(texts, unit)
    at = np.minimum(np.searchsorted(known, runs.key), len(known) - 1)
    hit = np.flatnonzero(known[at] == runs.key)
    doc = np.searchsorted(ends, runs.start[hit], side="right")
    begin = np.append(0, ends[:-1])[doc]
    columns = (runs.key[hit], doc, runs.start[hit] - begin, runs.windows[hit],
               runs.anchor[hit] - runs.start[hit], hot[at[hit]])
    last, pieces = -1, None
    for key, d, start, windows, anchor, is_hot in zip(*(c.tolist() for c in columns)):
        if d != last:
            last, pieces = d, unit.pieces(texts[d])
        if not is_hot:
            spans = ((key, start, windows, anchor),)
        else:
            spans = ((None, start + j, 1, anchor - j) for j in range(windows))
        for own, s, w, a in spans:
            content = unit.content(pieces[s:s + w + unit.width - 1])
            if content in first:
                sent.again.append((place + d, s, w))
                continue
            first.add(content)
            if own is None:
                own = zlib.crc32(content) | zlib.adler32(content) << 32
            sent.add(own, (place + d, s, w, a, content))


def _compared(batches, solve: Callable) -> Iterator[tuple[int, bytes]]:
    for bucket, own in groupby(blocks.read(batches), key=lambda row: row[0]):
        if bucket < 0:
            for _, block, body in own:
                yield block, blocks.unpack(body)
            continue
        block_of, parts, contents = [], [], []
        for _, block, body in own:
            *columns, sizes, data = unpack(blocks.unpack(body))
            block_of.append(np.full(len(sizes), block))
            parts.append(columns)
            data, stops = data.tobytes(), np.cumsum(sizes).tolist()
            contents += [data[a:b] for a, b in zip([0, *stops], stops)]
        block_of = np.concatenate(block_of)
        key, doc, start, windows, anchor = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, doc, block_of))
        given = Strings(key[order], windows[order], anchor[order], [contents[i] for i in order])
        found = [np.concatenate(x) for x in zip(*solve(given))] or [np.zeros(0, np.int64)] * 3
        string, offset, count = found
        if not len(string):
            continue
        string = order[string]
        by = np.argsort(block_of[string], kind="stable")
        string, offset, count = string[by], offset[by], count[by]
        at = np.flatnonzero(np.append(True, np.diff(block_of[string]) != 0))
        for part in np.split(np.arange(len(string)), at[1:]):
            s = string[part]
            yield int(block_of[s[0]]), pack(doc[s].astype(np.int64), start[s] + offset[part],
                                            count[part].astype(np.int64))


def later_spans(later: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, count) from the sorted places `later` of repeated windows in
    concatenated strings that begin at `starts`."""
    string = np.searchsorted(starts, later, side="right") - 1
    new = np.flatnonzero(np.append(True, (np.diff(later) != 1) | (np.diff(string) != 0)))
    if not len(later):
        new = new[:0]
    count = np.diff(np.append(new, len(later)))
    return string[new], later[new] - starts[string[new]], count


# --- step 3 --------------------------------------------------------------------------------------

def _marked(batches) -> Iterator[tuple]:
    """(doc_id, text, starts, counts, kept columns) of each document."""
    for _, own in groupby(blocks.read(batches), key=lambda row: row[0]):
        spans, place, by = [], 0, None
        for _, kind, doc_id, text, body, *kept in own:
            if kind == 0:
                spans.append(unpack(blocks.unpack(body)))
                continue
            if by is None:
                by = _by_document(spans)
            doc, start, count = by
            a, b = np.searchsorted(doc, [place, place + 1])
            yield doc_id, text, start[a:b], count[a:b], kept
            place += 1


def _by_document(spans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not spans:
        none = np.zeros(0, np.int64)
        return none, none, none
    doc, start, count = (np.concatenate(x) for x in zip(*spans))
    order = np.argsort(doc, kind="stable")
    return doc[order], start[order], count[order]


def covered(n: int, starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Which of a text's `n` symbols the windows cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + counts + width - 1, n), -1)
    return np.cumsum(change[:n]) > 0


def spans_of(removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true values."""
    edge = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
