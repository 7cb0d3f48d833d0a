"""Repeated passages of words, by suffix trees over variable-length prefixes.

Every window of WIDTH words is a suffix of a string that a bucket holds. Prefixes grow word by word
until the suffixes that begin with one fit in memory together; each such group builds its subtree,
level by level, and the nodes at depth WIDTH with several leaves are the repeats. The leaf that
stands first in the corpus stays, the others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from furrow.llm import blocks, repeats
from furrow.llm.words import word_hashes

WIDTH = 20
K = 8
#: Suffixes whose subtrees are built together.
GROUP_SUFFIXES = 1 << 18

_SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<begin:long,end:long>>, " \
          "kept string, text string"
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                    ("spans", pa.list_(_SPAN)), ("kept", pa.string()), ("text", pa.string())])

UNIT = repeats.Unit(word_hashes, bytes.split, b" ".join, WIDTH, K)


def prefix_groups(symbols: np.ndarray, suffixes: np.ndarray, width: int,
                  most: int) -> Iterator[np.ndarray]:
    """Splits suffixes into groups of at most `most` by prefixes of varying length.

    Suffixes that share a window share all its prefixes, so they are never parted. A prefix is
    lengthened only while too many suffixes begin with it; small groups are taken together. A
    group that is still larger at full width holds one window and is given as it is.
    """
    waiting = [(suffixes, 0)]
    small, size = [], 0
    while waiting:
        group, depth = waiting.pop()
        if len(group) <= most or depth == width:
            if size + len(group) > most and small:
                yield np.concatenate(small)
                small, size = [], 0
            small.append(group)
            size += len(group)
            continue
        word = symbols[group + depth]
        order = np.argsort(word, kind="stable")
        cuts = np.flatnonzero(np.diff(word[order])) + 1
        parts = np.split(group[order], cuts)
        pile, height = [], 0
        for part in parts:  # neighbours that fit together stay one group
            if len(part) > most:
                waiting.append((part, depth + 1))
                continue
            if height + len(part) > most:
                waiting.append((np.concatenate(pile), width))
                pile, height = [], 0
            pile.append(part)
            height += len(part)
        if pile:
            waiting.append((np.concatenate(pile), width))
    if small:
        yield np.concatenate(small)


def repeated_leaves(symbols: np.ndarray, suffixes: np.ndarray, width: int) -> np.ndarray:
    """Suffixes whose first `width` symbols an earlier suffix has too.

    The tree is built level by level: a node of depth d splits by the symbol at d. Nodes with one
    leaf are dropped, what is left at depth `width` are the nodes of repeats.
    """
    leaf = np.sort(suffixes)
    node = np.zeros(len(leaf), np.int64)
    span = int(symbols.max(initial=0)) + 1
    for depth in range(width):
        if not len(leaf):
            break
        child = node * span + symbols[leaf + depth]
        order = np.argsort(child, kind="stable")
        sorted_child = child[order]
        new = np.append(True, sorted_child[1:] != sorted_child[:-1])
        alone = new & np.append(new[1:], True)
        keep = ~alone
        leaf, node = leaf[order][keep], np.cumsum(new)[keep] - 1
        node = np.unique(node, return_inverse=True)[1] if len(node) and depth % 4 == 3 else node
    if not len(leaf):
        return leaf
    order = np.lexsort((leaf, node))
    leaf, node = leaf[order], node[order]
    return leaf[np.append(False, node[1:] == node[:-1])]


def solve(strings: repeats.Strings, width: int = WIDTH, most: int = GROUP_SUFFIXES):
    """Repeated windows of a bucket's strings as (string, first window, count)."""
    hashes, ends = word_hashes(strings.content)
    symbols = np.unique(hashes, return_inverse=True)[1]
    starts = np.append(0, ends[:-1])
    windows = strings.windows.astype(np.int64)
    first = np.cumsum(windows) - windows
    suffixes = np.arange(windows.sum()) + np.repeat(starts - first, windows)
    for group in prefix_groups(symbols, suffixes, width, most):
        later = np.sort(repeated_leaves(symbols, group, width))
        yield repeats.later_spans(later, starts)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   hot: int = repeats.HOT_NOTES, keep: Sequence[str] = ()) -> DataFrame:
    """Removes words covered by a window of WIDTH words that also starts earlier in the corpus.

    Earlier: smaller id, or same text and earlier start; rows of one id are ordered by text, rows
    without an id come last. Windows are judged on the input. Returns one row per input row:
    doc_id, n_words, n_removed, `spans` of removed words, `kept` (kept words joined by one space),
    and `text`, the input without the removed words and the white space behind them; a text from
    which nothing is removed is unchanged. A null text has no words and stays null. Columns named by
    `keep` (atomic types) travel with their row and stand last, other columns are left out. Words are
    compared by 64-bit hashes.
    """
    kept = [docs.schema[c] for c in keep]
    types = pa.schema([*_TYPES, *((c.name, to_arrow_type(c.dataType)) for c in kept)])
    schema = ", ".join([_SCHEMA, *(f"`{c.name}` {c.dataType.simpleString()}" for c in kept)])
    return repeats.repeated_windows(docs, UNIT, solve, lambda rows: _finish(rows, types), schema,
                                    doc_id, text, hot, keep)


def _finish(rows: Iterator[tuple], types: pa.Schema) -> blocks.Batches:
    def results():
        for doc_id, text, starts, counts, own in rows:
            words = (text or b"").split()
            removed = repeats.covered(len(words), starts, counts, WIDTH)
            if not removed.any():
                kept = b" ".join(words)
                yield doc_id, len(words), 0, [], kept.decode(), None if text is None else text.decode(), *own
                continue
            begin, end = repeats.spans_of(removed)
            kept = b" ".join(w for w, r in zip(words, removed.tolist()) if not r)
            yield (doc_id, len(words), int(removed.sum()),
                   [{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())],
                   kept.decode(), _without(text, begin, end).decode(), *own)

    return blocks.results(results(), types, 8192)


def _without(text: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    """The text from which words [begin, end) go, each run up to the start of the next word."""
    data = np.frombuffer(text, np.uint8)
    blank = np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    starts = np.append(starts, len(data))
    keep = np.ones(len(data), bool)
    for a, b in zip(starts[begin].tolist(), starts[end].tolist()):
        keep[a:b] = False
    return data[keep].tobytes()
