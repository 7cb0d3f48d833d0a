"""Blocks of documents that ask buckets of keys, and get their answers back.

Documents belong to the block of their id (`id >> BLOCK_BITS`). Three steps, each a plain Spark
stage: `ask` runs over the documents where they lie and sends, for each block, its distinct keys to
the buckets that own them (packed, so that a frequent key is one entry per block and not one per
occurrence); `answer` sees all entries of a bucket; `use` reads each block's documents together
with its answers. Exchanges are by bucket and by block only, no text is grouped by content, and a
key that occurs in a third of all documents reaches its bucket once per block.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 12
#: Block of the documents without an id; it sorts after all others.
NO_ID = 1 << 52
ROWS = "block long, kind int, doc_id long, text string, body binary"
NOTES = "bucket long, block long, body binary"
#: Rows a task hands on at once; bytes after which it does so earlier.
BATCH_BYTES = 8 << 20
#: Bytes of texts that a task packs at once.
PACKED_BYTES = 4 << 20
_ROW_TYPES = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()),
                        ("text", pa.string()), ("body", pa.binary())])
_NOTE_TYPES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])

Batches = Iterator[pa.RecordBatch]


#: Bytes that Spark hands to a worker at once where batches are bounded.
HANDED_BYTES = 4 << 20
#: Bytes of a batch that a worker turns into Python values at once.
READ_BYTES = 1 << 20

_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: int = HANDED_BYTES) -> None:
    """From now on the session hands rows to workers in batches of about `size` bytes; a smaller limit
    is kept. For results that are written after the function which makes them has returned."""
    before = spark.conf.get(_BATCH_SETTING).rstrip("bB")
    if not before.isdigit() or int(before) > size:
        spark.conf.set(_BATCH_SETTING, str(size))


@contextmanager
def bounded_batches(spark: SparkSession, size: int = HANDED_BYTES) -> Iterator[None]:
    """Within it, what is written takes rows to workers in batches of about `size` bytes, however long
    texts are (Spark's own limit of 64 MB is buffered on both sides, for each worker). The session's
    setting is put back at the end; a smaller one is kept."""
    before = spark.conf.get(_BATCH_SETTING)
    bound_batches(spark, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def block_of(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id.cast("long"), BLOCK_BITS), F.lit(NO_ID))


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The documents as block rows of kind 1, columns named by `keep` behind them; others are left out."""
    return docs.select(block_of(docs[doc_id]).alias("block"), F.lit(1).alias("kind"),
                       docs[doc_id].cast("long").alias("doc_id"),
                       docs[text].cast("string").alias("text"),
                       F.lit(None).cast("binary").alias("body"),
                       *[docs[c].alias(f"keep{i}") for i, c in enumerate(keep)])


def packed(rows: DataFrame) -> DataFrame:
    """Block rows of kind 1 with many texts in each body: a third of what single texts take."""
    return rows.mapInArrow(_packed, ROWS)


def _packed(batches: Batches) -> Batches:
    def bodies():
        held: dict[int, list] = {}
        size = 0
        for block, _, doc_id, text, _ in read(batches):
            held.setdefault(block, []).append((doc_id, text or b""))
            size += len(text or b"") + 64
            if size >= PACKED_BYTES:
                yield from held.items()
                held, size = {}, 0
        yield from held.items()

    out = _Writer(_ROW_TYPES)
    squeeze = zstandard.ZstdCompressor(level=3)
    for block, pairs in bodies():
        body = squeeze.compress(pickle.dumps(pairs))
        yield from out.add((block, 1, None, None, body), len(body))
    yield from out.flush()


def unpacked(body: bytes) -> list[tuple[int | None, bytes]]:
    """(doc_id, text) of the documents in a packed body; null texts are empty."""
    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def bucket_count(docs: DataFrame) -> int:
    """One bucket per 2^BLOCK_BITS documents: buckets keep their size when the input grows."""
    return max(16, docs.count() >> (BLOCK_BITS - 1))


def ask(rows: DataFrame, step: Callable[[Batches], Batches]) -> DataFrame:
    return rows.mapInArrow(step, NOTES)


def answer(notes: DataFrame, step: Callable[[Batches], Batches]) -> DataFrame:
    """`step` gets notes sorted by bucket and block, and returns block rows of kind 0."""
    return (notes.repartition("bucket").sortWithinPartitions("bucket", "block")
            .mapInArrow(step, ROWS))


def use(rows: DataFrame, answers: DataFrame, step: Callable[[Batches], Batches],
        schema: str, ordered: bool = False) -> DataFrame:
    """`step` gets each block's answers first and then its documents (`ordered`: by id and text).
    Columns that only the documents have are null in answers."""
    order = ["block", "kind", "doc_id", "text"] if ordered else ["block", "kind"]
    return (rows.unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions(*order)
            .mapInArrow(step, schema))


def read(batches: Batches) -> Iterator[tuple]:
    """Rows of the batches; strings as UTF-8 bytes. About READ_BYTES of a batch are held as Python values."""
    for batch in batches:
        step = max(1, batch.num_rows * READ_BYTES // max(READ_BYTES, batch.nbytes))
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
        for i in range(0, batch.num_rows, step):
            yield from zip(*(c.slice(i, step).to_pylist() for c in columns))


class _Writer:
    """Gathers rows and gives them as batches of bounded size."""

    def __init__(self, types: pa.Schema):
        self.types, self.rows, self.bytes = types, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if self.bytes >= BATCH_BYTES or len(self.rows) >= 4096:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            arrays = [pa.array(c, t) for c, t in zip(zip(*self.rows), self.types.types)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.types)
            self.rows, self.bytes = [], 0


def notes(items: Iterator[tuple[int, int, bytes]]) -> Batches:
    """(bucket, block, body) as batches; bodies are compressed."""
    out = _Writer(_NOTE_TYPES)
    for bucket, block, body in items:
        packed = zlib.compress(body, 1)
        yield from out.add((bucket, block, packed), len(packed))
    yield from out.flush()


def answers(items: Iterator[tuple[int, bytes]]) -> Batches:
    """(block, body) as block rows of kind 0; bodies are compressed."""
    out = _Writer(_ROW_TYPES)
    for block, body in items:
        packed = zlib.compress(body, 1)
        yield from out.add((block, 0, None, None, packed), len(packed))
    yield from out.flush()


def results(items: Iterator[tuple], types: pa.Schema, size: int = 64) -> Batches:
    out = _Writer(types)
    for row in items:
        yield from out.add(row, size)
    yield from out.flush()


def unpack(body: bytes) -> bytes:
    return zlib.decompress(body)
