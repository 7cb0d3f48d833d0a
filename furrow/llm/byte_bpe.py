"""Byte-level BPE by ranks: longest matches, taken back where neighbours do not fit.

A piece of text (a match of the vocabulary's pattern) is encoded from left to right. At each place
the longest token that fits is tried; a token may follow another only if the merges of both
together end in exactly these two (`Vocabulary.fits`, remembered per pair of ids). Where no token
fits, the last one is taken back and replaced by the next shorter token that starts like it, and the
place it ended at is never tried again. Every place is left at most once that way, so a piece
takes time in proportion to its length, and the result is that of the merges in order of rank.

The longest matches at all places of a piece come from one pass of an Aho-Corasick automaton over its
bytes, written as Latin-1 so that a byte is a character. Nothing is shuffled: documents are encoded
and decoded where they lie.
"""

from __future__ import annotations

import base64
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Remembered pieces, and remembered pairs of neighbours, of a worker; beyond as many it starts anew.
PIECES_KEPT = 400_000
PAIRS_KEPT = 500_000
#: Longer pieces are encoded each time.
LONGEST_KEPT = 64
#: Bytes of texts after which a task hands on its rows.
BATCH_BYTES = 4 << 20
_NEVER = 1 << 40

_LOADED: dict[int, Vocabulary] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids, of a file with a token in base64 and a rank per line."""
    with open(path, "rb") as file:
        pairs = (line.split() for line in file)
        return {base64.b64decode(token): int(rank) for token, rank in (p for p in pairs if p)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """Ids of the two tokens whose merge makes `token`; None if no merge of lower ranks does."""
    parts = [token[i:i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        best, at = own, -1
        for i, pair in enumerate(zip(parts, parts[1:])):
            rank = ranks.get(pair[0] + pair[1], own)
            if rank < best:
                best, at = rank, i
        if at < 0:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class Vocabulary:
    """Tokens with the automaton and the merges that encoding needs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = [len(t) for t in self.token]
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} of 256 single bytes")
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        reached = {rank for token, rank in ranks.items() if len(token) == 1}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            pair = last_merge(token, ranks) if len(token) > 1 else None
            if pair and pair[0] in reached and pair[1] in reached:
                reached.add(rank)
                self.parts[rank] = pair
                self.merged[pair] = rank
        # A token that no merge makes never stands in a result, so it takes no part in matching.
        self.automaton = ahocorasick.Automaton()
        for rank in reached:
            self.automaton.add_word(self.token[rank].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        by_bytes = {self.token[rank]: rank for rank in reached}
        for token, rank in by_bytes.items():
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in by_bytes:
                    self.shorter[rank] = by_bytes[token[:n]]
                    break
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, list[int]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes in a row end in exactly these two."""
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            found = self._pairs[key] = self._stay_apart(left, right)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        # At the border stand, one after another, the right ends of `left` and the left ends of
        # `right`, each until the merge that takes it into the next larger one. Two of them that are
        # there together merge if their own merge comes before that; of equal ranks the left goes first.
        ends, until = [], _NEVER
        while True:
            ends.append((left, until))
            if left not in self.parts:
                break
            until, left = left, self.parts[left][1]
        until = _NEVER
        while True:
            for end, end_until in ends:
                rank = self.merged.get((end, right))
                if rank is not None and rank < end_until and rank <= until:
                    return False
            if right not in self.parts:
                return True
            until, right = right, self.parts[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        longest = [0] * len(piece)
        length = self.length
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank  # ends rise, so the longest comes last
        closed = bytearray(len(piece) + 1)
        out: list[int] = []
        at, size = 0, len(piece)
        token = longest[0] if size else 0
        while at < size:
            while token is not None:
                end = at + length[token]
                if not closed[end] and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter.get(token)
            if token is None:
                closed[at] = 1
                token = out.pop()
                at -= length[token]
                continue
            out.append(token)
            at = end
            token = longest[at] if at < size else 0
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of all matches of the pattern, one after another."""
        known = self._pieces
        out: list[int] = []
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= LONGEST_KEPT:
                    if len(known) >= PIECES_KEPT:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _shared(frame: DataFrame, path: str, pattern: str):
    """The rank file (its size is fixed, about 1 MB) and the pattern for every worker."""
    return frame.sparkSession.sparkContext.broadcast(pickle.dumps((read_ranks(path), pattern)))


def _vocabulary(packed: bytes) -> Vocabulary:
    """One vocabulary per worker process."""
    key = zlib.crc32(packed)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(*pickle.loads(packed))
    return _LOADED[key]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Returns (doc_id, ids), one row per row; `ids` are little-endian unsigned 32-bit integers in a row.

    `arrays` turns them into a list column. A null text has the ids of an empty one: none. Repeated
    rows and rows without an id keep their own rows. Further columns are left out, whatever their
    names. Strings of special tokens are ordinary text.
    """
    shared = _shared(docs, path, pattern)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for ids, texts in _cut(batches):
            coded = [np.array(vocabulary.encode(t or ""), "<u4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(coded, pa.binary())],
                                             names=["doc_id", "ids"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"),
                       docs[text].cast("string").alias("text"))
    return rows.mapInArrow(step, "doc_id long, ids binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of the batches, in parts of about BATCH_BYTES of text."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)) + 1)
        begin = 0
        while begin < batch.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + BATCH_BYTES)))
            part = batch.slice(begin, end - begin)
            yield part.column(0), part.column(1).to_pylist()
            begin = end


def arrays(encoded: DataFrame) -> DataFrame:
    """The same rows with `ids` as array<long>."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return encoded.select("doc_id", "ids").mapInArrow(step, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds `decoded`, the bytes of the tokens of `ids` in a row; null or empty ids give no bytes."""
    shared = _shared(encoded, path, pattern)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _vocabulary(shared.value).token
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [b"".join(map(token.__getitem__, np.frombuffer(x or b"", "<u4").tolist()))
                         for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())],
                                                 names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(
        step, "doc_id long, ids binary, decoded binary")


def n_tokens(ids: Column) -> Column:
    return F.coalesce(F.octet_length(ids) / 4, F.lit(0)).cast("long")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
