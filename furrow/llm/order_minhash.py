"""Order MinHash: fingerprints of texts that are sensitive to edit distance.

A text's items are its k-mers of code points, each with its occurrence number. Every item has one
hash, whose leading bits deal it to one of `signatures` bins; the `kept` items of a bin with the
smallest hashes, in the order in which they stand in the text, hash to the bin's signature. Two
texts agree in a bin if they share its minimal items and their order, so the share of agreeing
bins falls with the edit distance, also where only the order changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.runs import gram_hashes, mix
from furrow.sources.stages import stage

K = 8
SIGNATURES = 64
KEPT = 2
#: Code points fingerprinted together; a longer text makes a batch of its own.
BATCH_CHARS = 1 << 16
EMPTY_BIN = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(texts: list[np.ndarray], k: int = K, signatures: int = SIGNATURES,
                 kept: int = KEPT) -> np.ndarray:
    """One row of `signatures` 32-bit values per text (arrays of code points).

    A text shorter than `k` has one item, the whole text. A bin without items is EMPTY_BIN; a bin
    with fewer than `kept` items hashes those it has. An empty text has empty bins only.
    """
    if signatures & (signatures - 1):
        raise ValueError("signatures must be a power of two")
    out = np.zeros((len(texts), signatures), np.uint32)
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_CHARS:
            _fill(out[begin:i], texts[begin:i], k, signatures, kept)
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        _fill(out[begin:], texts[begin:], k, signatures, kept)
    return out


def _fill(out: np.ndarray, texts: list[np.ndarray], k: int, signatures: int, kept: int) -> None:
    lengths = np.array([len(t) for t in texts], np.int64)
    owner, items = _items(texts, lengths, k)
    if not len(items):
        return
    number = _occurrences(owner, items)
    hashed = mix(items + (number.astype(np.uint64) + np.uint64(1)) * _STEP)
    bits = np.uint64(signatures.bit_length() - 1)
    bin_of = (hashed >> (np.uint64(64) - bits)).astype(np.int64) if bits else np.zeros(len(items), int)
    group = owner * signatures + bin_of
    rest = hashed << bits
    chosen = _least(group, rest, np.maximum(lengths - k + 1, 1), owner, signatures, kept, len(texts))
    group, hashed = group[chosen], hashed[chosen]  # by group, in text order
    new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    rank = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
    tuples = np.zeros((len(new), kept), np.uint64)
    tuples[np.repeat(np.arange(len(new)), np.diff(np.append(new, len(group)))), rank] = hashed
    signature = np.zeros(len(new), np.uint64)
    for j in range(kept):
        signature = mix(signature * _STEP + tuples[:, j] + np.uint64(j + 1))
    out.reshape(-1)[group[new]] = (signature >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _items(texts: list[np.ndarray], lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and k-mer hash of each item, in text order."""
    joined = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    grams = gram_hashes(mix(joined.astype(np.uint64) + np.uint64(1)), k)
    inside = np.arange(len(grams)) + k <= ends[owner[:len(grams)]]
    owner, items = owner[:len(grams)][inside], grams[inside]
    short = np.flatnonzero((lengths < k) & (lengths > 0))
    if len(short):
        whole = [gram_hashes(mix(texts[i].astype(np.uint64) + np.uint64(1)), len(texts[i]))[0]
                 for i in short]
        owner = np.concatenate([owner, short])
        items = np.concatenate([items, np.array(whole, np.uint64)])
    return owner, items


def _occurrences(owner: np.ndarray, items: np.ndarray) -> np.ndarray:
    """How often each item stood earlier in its own text."""
    n = len(items)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    key = mix(items + owner.astype(np.uint64) * _STEP)
    packed = np.sort((key >> bits) << bits | np.arange(n, dtype=np.uint64))
    place = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = (packed[1:] >> bits) == (packed[:-1] >> bits)
    number = np.zeros(n, np.int64)
    again = np.flatnonzero(same) + 1
    if not len(again):
        return number
    if (key[place[again]] != key[place[again - 1]]).any():  # different items with equal high bits
        place = np.argsort(key, kind="stable")
        same = key[place[1:]] == key[place[:-1]]
    first = np.flatnonzero(np.append(True, ~same))
    run = np.repeat(first, np.diff(np.append(first, n)))
    number[place] = np.arange(n) - run
    return number


def _least(group: np.ndarray, rest: np.ndarray, n_items: np.ndarray, owner: np.ndarray,
           signatures: int, kept: int, n_texts: int) -> np.ndarray:
    """Places of the `kept` smallest `rest` of each group, ordered by group and place.

    Items beyond a bound that leaves about 4 * kept + 12 a bin are set aside first; a text in
    which that leaves a bin short keeps all its items.
    """
    share = np.minimum(1.0, (4 * kept + 12) * signatures / n_items)
    bound = np.where(share >= 1, np.uint64(0xFFFFFFFFFFFFFFFF),
                     (np.minimum(share, 0.999) * 2.0 ** 64).astype(np.uint64))
    near = rest <= bound[owner]
    left = np.bincount(group[near], minlength=n_texts * signatures)
    short = ((left < kept).reshape(n_texts, signatures).any(axis=1)) & (share < 1)
    if short.any():
        near |= short[owner]
    at = np.flatnonzero(near)
    bits = np.uint64(max(1, int(n_texts * signatures - 1).bit_length()))
    order = np.argsort(group[at].astype(np.uint64) << (np.uint64(64) - bits) | rest[at] >> bits,
                       kind="stable")
    at = at[order]
    own = group[at]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    at = at[rank < kept]
    return at[np.lexsort((at, group[at]))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing bins among those that either has; 1 where both have none."""
    used = (a != EMPTY_BIN) | (b != EMPTY_BIN)
    n = used.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & used).sum(axis=1) / np.maximum(n, 1))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K,
                signatures: int = SIGNATURES, kept: int = KEPT) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row: bins in hexadecimal, eight digits each.

    A null text counts as empty; rows are neither merged nor dropped, ids may be null or repeat,
    and other columns are left out.
    """
    def step(batches):
        for batch in batches:
            found = [code_points(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in found], pa.int64()),
                 pa.array(_hex(fingerprints(found, k, signatures, kept)))],
                names=["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(step, "doc_id long, n_chars long, fingerprint string")


def _hex(prints: np.ndarray) -> list[str]:
    return [row.hex() for row in _bytes(prints)]


def _bytes(prints: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in prints.astype(">u4")]


# --- a text against its edited form and its neighbour --------------------------------------------

EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")
#: As written between steps: fingerprints as bytes.
_BYTES = EDITED.replace("fingerprint string", "fingerprint binary")
_ENDS = _BYTES + ", part int, place int, text string"
_TYPES = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()),
    ("place", pa.int32()), ("text", pa.string())])
#: Characters of texts whose fingerprints a task works out at once.
GROUP_CHARS = 1 << 20


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Compares each text with its edited form and with the next text; columns as in EDITED.

    Next is the following row by id (after the last: the first); rows of one id are ordered by
    text, rows without an id come first. The edited text has its last floor(n/2) code points
    replaced by the first floor(n/2) of the next text, or all if it has fewer. A null text counts
    as empty. A single row is its own next. An empty table gives no rows.

    Rows are dealt by ranges of ids. Each task compares its own neighbours and hands on its first
    and last text; these ends, two per task, are compared in a second, small step.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"),
                       F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = stage(ranged.mapInArrow(_compare, _ENDS), "neighbours")
    done = found.where("place is null").drop("part", "place", "text")
    ends = found.where("place is not null").select("part", "place", "doc_id", "text")
    last = ends.where("place = 1").select("part", "doc_id", "text")
    first = ends.where("place = 0").select("part", F.col("text").alias("next"))
    parts = first.select("part")
    after = parts.groupBy().agg(F.array_sort(F.collect_set("part")).alias("parts")).select(
        F.explode(F.arrays_zip("parts", F.expr(
            "concat(slice(parts, 2, size(parts)), slice(parts, 1, 1))").alias("next_part"))).alias("x")
    ).select(F.col("x.parts").alias("part"), F.col("x.next_part").alias("next_part"))
    joined = (last.join(after, "part")
              .join(first.withColumnRenamed("part", "next_part"), "next_part")
              .select("doc_id", "text", "next"))
    both = done.unionByName(joined.mapInArrow(_compare_ends, _BYTES))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of neighbours inside the partition, and its first and last text as ends."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, held, size = None, [], 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if last is None:
                yield _end(part, 0, row)
            last = row
            held.append(row)
            size += len(row[1])
            if size >= GROUP_CHARS and len(held) > 1:
                yield _rows(held)
                held, size = held[-1:], len(row[1])
    if len(held) > 1:
        yield _rows(held)
    if last is not None:
        yield _end(part, 1, last)


def _end(part: int, place: int, row: tuple) -> pa.RecordBatch:
    values = [row[0], None, None, None, None, None, None, part, place, row[1]]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES.types)],
                                      schema=_TYPES)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    n = len(held) - 1
    columns = _pairs([t for _, t in held], range(n), range(1, n + 1))
    blank = [pa.nulls(n, t) for t in _TYPES.types[7:]]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held[:-1]], pa.int64()), *columns,
                                       *blank], schema=_TYPES)


def _pairs(texts: list[str], own: range, following: range) -> list[pa.Array]:
    import hashlib

    points = [code_points(t) for t in texts]
    edited, sums = [], []
    for i, j in zip(own, following):
        cut = len(points[i]) // 2
        edited.append(np.concatenate([points[i][:len(points[i]) - cut], points[j][:cut]]))
        new = texts[i][:len(texts[i]) - cut] + texts[j][:cut]
        sums.append(hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
    plain, changed = fingerprints(points), fingerprints(edited)
    mine, theirs = plain[list(own)], plain[list(following)]
    return [pa.array([len(points[i]) for i in own], pa.int64()), pa.array(sums, pa.string()),
            pa.array(_bytes(mine), pa.binary()), pa.array(_bytes(changed), pa.binary()),
            pa.array(likeness(mine, changed), pa.float64()),
            pa.array(likeness(mine, theirs), pa.float64())]


def _compare_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in EDITED.split(", ")]
    for batch in batches:
        n = batch.num_rows
        texts = batch.column(1).to_pylist() + batch.column(2).to_pylist()
        columns = _pairs(texts, range(n), range(n, 2 * n))
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)
