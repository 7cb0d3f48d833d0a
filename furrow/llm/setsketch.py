"""Near duplicates by SetSketch.

Each register of a set holds the exponentially spaced, truncated minimum of one hash over the set.
Registers of a union are the maxima of both, and two sets share a register about as often as their
Jaccard similarity says. Bands of registers propose pairs, the joint likelihood of both sketches
sorts out hopeless ones, and every link is confirmed on the full sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import blocks
from furrow.llm.repeats import keys_sent, known_keys, repeated_keys
from furrow.llm.runs import gram_hashes, mix
from furrow.llm.words import word_hashes
from furrow.sources.stages import stage, working_tables

Stage = Callable[[DataFrame, str], DataFrame]

SHINGLE = 5
SIMILARITY_PERCENT = 75
# A pair at the limit shares no band with a chance of (1 - 0.75^5)^64 = 3e-8; unrelated texts that have a
# tenth of their shingles in common share one with 6e-4, so candidates stay in proportion to the input.
BANDS, ROWS = 64, 5
#: Bands that link most copies before the others are looked at.
FIRST_BANDS = 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Pairs estimated below this similarity are not confirmed: 5 deviations below the limit.
LEAST_ESTIMATE = 0.629
#: Linked pairs differ in at most so many registers, but for a chance of about 1e-8.
MOST_DIFFERENT = 124
#: Words of 64 bits in the bitmap of a set; the bitmap bounds how much two sets can share.
BITMAP = [f"bits_{i}" for i in range(16)]
#: Bytes of texts whose words are hashed at once, and rows that a worker takes at once.
_BATCH_BYTES = 1 << 18
_ROWS_AT_ONCE = 512
#: Bits of the bitmap that finds rows by their ids: 8 MB at most, whatever the number of ids.
SLOTS = 1 << 26
#: Shingles of a block that a task holds before it sends them.
HELD_SHINGLES = 500_000
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)).astype(np.uint32)[:, None] | np.uint32(1)


# --- sets and sketches ---------------------------------------------------------------------------

def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; A-Z count as a-z.

    With fewer than `n` words the whole sequence is the one shingle; without words the set is empty.
    """
    out: list[np.ndarray] = []
    for part in _parts(texts):
        hashes, ends = word_hashes([t.lower() for t in part])
        grams = gram_hashes(hashes, n)
        begin = 0
        for end in ends:
            if end - begin >= n:
                out.append(np.unique(grams[begin:end - n + 1]))
            elif end > begin:
                out.append(gram_hashes(hashes[begin:end], int(end - begin)))
            else:
                out.append(np.zeros(0, np.uint64))
            begin = end
    return out


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= _BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def minima(items: np.ndarray) -> np.ndarray:
    """REGISTERS smallest 32-bit hashes of a set, one per hash function."""
    low, high = items.astype(np.uint32), (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(items), 1024):
        v = high[i:i + 1024] * _SEEDS
        v += low[i:i + 1024]
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        v *= np.uint32(0xC2B2AE35)
        np.minimum(out, v.min(axis=1), out=out)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Exponentially spaced values of minima: floor(1 - log_b(h)), h exponential with RATE."""
    uniform = (least.astype(np.float64) + 0.5) / 2.0 ** 32
    spaced = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    return np.clip(spaced, 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(sketches, BANDS) hashes of the bands of registers."""
    bands = sketches[:, :BANDS * ROWS].reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j] + np.uint64(1))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs with the largest joint likelihood, given the sets' sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    total = (size_a + size_b).astype(np.float64)
    u, v = size_a / total, size_b / total

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        rest = np.clip(1 - p - q, 1e-12, 1)
        return more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) \
            + same * np.log(rest)

    low, high = np.zeros(len(total)), np.minimum(u / v, v / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        left, right = high - golden * (high - low), low + golden * (high - low)
        up = likelihood(left) < likelihood(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def bitmap(items: np.ndarray) -> np.ndarray:
    """One bit per item, at its hash modulo the number of bits.

    A bit that only one of two sets has stands for at least one item that the other set lacks, so
    a set of n items shares at most n less the number of its own such bits. This holds at every
    size; beyond as many items as bits the bound says little.
    """
    bits = np.zeros(64 * len(BITMAP), bool)
    bits[items % np.uint64(len(bits))] = True
    return np.packbits(bits).view(np.int64)


# --- Spark ---------------------------------------------------------------------------------------

def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, registers) of every whole text; set_key is null without words."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(
        _sketch, "doc_id long, n_shingles long, set_key binary, registers binary")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = _ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    return (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        sets = shingle_sets(texts)
        least = np.array([minima(s) for s in sets], np.uint32).reshape(len(sets), REGISTERS)
        found = registers(least)
        keys = [_set_key(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in found], pa.binary())],
            names=["doc_id", "n_shingles", "set_key", "registers"])


def _set_key(items: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _band_rows(bands: int):
    """Of (id, label, registers): (band, id, label) of the first bands."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            data = b"".join(batch.column(2).to_pylist())
            keys = band_keys(np.frombuffer(data, np.uint16).reshape(batch.num_rows, REGISTERS))[:, :bands]
            own = [pa.array(np.repeat(np.asarray(batch.column(i)), bands)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *own], names=["band", "id", "label"])

    return step


def among(rows: DataFrame, ids: DataFrame, name: str = "id") -> DataFrame:
    """The rows whose `name`, a long, stands in the column of that name in `ids`, each row once.

    A bitmap of hashed ids, of a bounded size and hence broadcast, leaves out nearly all other rows
    where they lie; with more ids than it has bits it only leaves out less. The semi-join after it
    is exact, and what it shuffles is about as much as it returns. It compares the bitmap's page too:
    on columns of the rows alone the planner would move it below the bitmap, where it shuffles all rows."""
    slot = F.pmod(F.xxhash64(name), F.lit(SLOTS)) + 1
    pages = (ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")))
    placed = rows.withColumns({"row_page": F.bitmap_bucket_number(slot), "place": F.bitmap_bit_position(slot)})
    byte = F.expr("cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as long)")
    found = placed.join(F.broadcast(pages), F.col("row_page") == F.col("page")).where(
        F.getbit(byte, (F.col("place") % 8).cast("int")) == 1)
    exact = ids.select(name, F.bitmap_bucket_number(slot).alias("page"))
    return found.join(exact, [name, "page"], "left_semi").select(*rows.columns)


def ends(pairs: DataFrame) -> DataFrame:
    """(id) of both ends of pairs (a, b), each once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _sketched(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, r) of the ids: a set's size and registers."""
    return among(reps.select("id", "n", "registers"), ids).groupBy("id").agg(
        F.min("n").alias("n"), F.min("registers").alias("r"))


def _stars(reps: DataFrame, labels: DataFrame | None, bands: int, stage: Stage) -> DataFrame:
    """Each bucket's smallest id with its other members, weighed; a bucket whose members are all in one
    component already has nothing to add and is left out."""
    named = reps.select("id", F.col("id").alias("label"), "registers") if labels is None else \
        reps.join(labels.toDF("id", "known"), "id", "left").select(
            "id", F.coalesce("known", "id").alias("label"), "registers")
    rows = named.mapInArrow(_band_rows(bands), "band long, id long, label long")
    with working_tables() as own:
        heads = own(rows.groupBy("band").agg(F.min("id").alias("head"), F.min("label").alias("low"),
                                             F.max("label").alias("high"))
                    .where("low < high").select("band", "head"), "heads")
        pairs = own(among(rows.select("band", "id"), heads, "band").join(heads, "band").where("id != head")
                    .select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
        slim = own(_sketched(reps, own(ends(pairs), "ends")), "sketched")
        return stage(pairs.join(slim.toDF("b", "n_b", "r_b"), "b").join(slim.toDF("a", "n_a", "r_a"), "a")
                     .select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_weigh, WEIGHED), "stars")


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, n_a, n_b, r_a, r_b): differing registers and the estimated similarity."""
    for batch in _slices(batches):
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16)
                .reshape(batch.num_rows, REGISTERS) for i in (4, 5))
        found = estimate(a, b, np.asarray(batch.column(2)), np.asarray(batch.column(3)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array((a != b).sum(axis=1), pa.int32()),
             pa.array(found)], names=["a", "b", "different", "likely"])


WEIGHED = "a long, b long, different int, likely double"


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in _slices(batches, 256):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([squeeze.compress(t or b"") for t in texts], pa.binary())], names=["id", "body"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, body_a, body_b): sizes of the sets and of their intersection. Pairs come sorted by a, so
    its set is made once for those in a row."""
    unpack = zstandard.ZstdDecompressor()
    last, x = None, np.zeros(0, np.uint64)
    for part in _slices(batches, 256):
        sizes = []
        for body, other in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
            if body != last:
                last, x = body, shingle_sets([unpack.decompress(body)])[0]
            y = shingle_sets([unpack.decompress(other)])[0]
            sizes.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        columns = [pa.array(c, pa.int64()) for c in zip(*sizes)]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns],
                                         names=["a", "b", "n_a", "n_b", "common"])


def components(links: DataFrame, stage: Stage = stage) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) reaches.

    Each round takes the smallest label among neighbours, then the label of the label; rounds are
    written to the shared folder, which cuts the lineage.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(
            F.min("label").alias("m"))
        lower = stage(labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "lower")
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stage(lower.join(up, "label").select(
            "node", "old", F.col("next").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("old != label").isEmpty():
            return labels


def _measured(pairs: DataFrame, docs: DataFrame, stage: Stage) -> DataFrame:
    """(a, b, n_a, n_b, common) of pairs (a, b) of ids in `docs` (id, text), from their full sets."""
    # Packed texts are a third of their sets.
    texts = stage(among(docs, stage(ends(pairs), "ends")).select("id", "text")
                  .mapInArrow(_packed_texts, "id long, body binary"), "texts")
    joined = (pairs.join(texts.toDF("b", "body_b"), "b").join(texts.toDF("a", "body_a"), "a")
              .select("a", "b", "body_a", "body_b"))
    return joined.mapInArrow(_common, "a long, b long, n_a long, n_b long, common long")


def _verified(pairs: DataFrame, docs: DataFrame, stage: Stage) -> DataFrame:
    similar = F.col("common") * 100 >= SIMILARITY_PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common"))
    with working_tables() as own:
        return stage(_measured(pairs, docs, own).where(similar).select("a", "b"), "links")


def _crossing(stars: DataFrame, labels: DataFrame, source: DataFrame, reps: DataFrame,
              stage: Stage) -> DataFrame:
    """Pairs of members of one head that are in different components and could be linked, with
    their sizes and registers; a pair may come once per head."""
    members = (stars.select("a", "b", "different").join(labels.toDF("b", "label"), "b", "left")
               .join(labels.toDF("a", "head_label"), "a", "left")
               .select("a", "b", "different", F.coalesce("label", "b").alias("label"),
                       (F.coalesce("head_label", "a") == F.coalesce("label", "b")).alias("inner")))
    with working_tables() as own:
        members = own(members, "members")
        open_heads = members.where("not inner").select("a").distinct()
        left = members.join(open_heads, "a", "left_semi")
        sizes = own(shared_shingles(among(source, own(ends(left), "ends"))), "shared")
        # A link has three quarters of the union in common, so of either set too.
        able = own(left.join(sizes.where("4 * shared >= 3 * n").select(
            F.col("id").alias("b"), "shared", *BITMAP), "b"), "able")
        exact = _measured(able.select("a", "b"), source, own).withColumn(
            "far", 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")))
        slim = _sketched(reps, own(able.select(F.col("b").alias("id")).distinct(), "ends"))
        able = able.join(exact.select("a", "b", F.col("n_b").alias("n"), "common", "far"), ["a", "b"])
        able = stage(able.join(slim.select(F.col("id").alias("b"), "r"), "b"), "exact")
    outer = able.where("not inner").toDF(*[f"x_{c}" for c in able.columns])
    in_common = "least(common, x_common) + least(shared - common, x_shared - x_common)"
    lacked = " + ".join(f"bit_count({bits} & ~x_{bits})" for bits in BITMAP)
    x_lacked = " + ".join(f"bit_count(x_{bits} & ~{bits})" for bits in BITMAP)
    return (able.join(outer, [able.a == outer.x_a, able.label != outer.x_label])
            .where("inner or b < x_b")
            .where("abs(far - x_far) <= 0.25 + 1e-9")
            .where(F.abs(F.col("different") - F.col("x_different")) <= MOST_DIFFERENT)
            .where(f"7 * ({in_common}) >= 3 * (n + x_n)")
            .where("4 * least(n, x_n) >= 3 * greatest(n, x_n)")
            .where(f"7 * least(n - ({lacked}), x_n - ({x_lacked})) >= 3 * (n + x_n)")
            .select(F.least("b", "x_b").alias("a"), F.greatest("b", "x_b").alias("b"),
                    F.when(able.b < F.col("x_b"), able.n).otherwise(F.col("x_n")).alias("n_a"),
                    F.when(able.b < F.col("x_b"), F.col("x_n")).otherwise(able.n).alias("n_b"),
                    F.when(able.b < F.col("x_b"), able.r).otherwise(F.col("x_r")).alias("r_a"),
                    F.when(able.b < F.col("x_b"), F.col("x_r")).otherwise(able.r).alias("r_b")))


def shared_shingles(docs: DataFrame) -> DataFrame:
    """Of documents (id, text): (id, n, shared, the bitmap's words), how many shingles a set has,
    how many of them another of the sets has too, and its bitmap. Blocks ask buckets of shingles,
    each once."""
    rows = blocks.texts(docs, "id", "text")
    buckets = blocks.bucket_count(docs)

    def keys(text: bytes) -> np.ndarray:
        return shingle_sets([text])[0] >> np.uint64(1)

    def sent(batches):
        held: dict[int, list[np.ndarray]] = {}
        for block, _, _, text, _ in blocks.read(batches):
            held.setdefault(block, []).append(keys(text or b""))
            if sum(map(len, held[block])) > HELD_SHINGLES:
                yield from keys_sent({block: held.pop(block)}, buckets)
        yield from keys_sent(held, buckets)

    def counted(batches):
        for block, own in groupby(blocks.read(batches), key=lambda row: row[0]):
            answers, known = [], None
            for _, kind, doc_id, text, body in own:
                if kind == 0:
                    answers.append(np.frombuffer(blocks.unpack(body), np.uint64))
                    continue
                if known is None:
                    known = known_keys(answers)[0]
                mine = keys(text or b"")
                at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
                shared = int((known[at] == mine).sum()) if len(known) else 0
                yield doc_id, len(mine), shared, *bitmap(mine).tolist()

    columns = ["id", "n", "shared", *BITMAP]
    types = pa.schema([(name, pa.int64()) for name in columns])
    notes = blocks.ask(rows, lambda batches: blocks.notes(sent(batches)))
    found = blocks.answer(notes, lambda batches: blocks.answers(repeated_keys(batches, 1 << 62)))
    return blocks.use(rows, found, lambda batches: blocks.results(counted(batches), types),
                      ", ".join(f"{name} long" for name in columns))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    component_id is the smallest id reachable over links, kept says that it is the row's own.
    Texts without words (null, empty, blank) are linked with nothing. Rows of one id count as one
    document. Rows without an id are linked with nothing; their component is null, they are kept.
    Repeated rows are kept as rows. Other columns are left out.

    1. Equal sets become one class (an aggregation, however many copies); the class's smallest id
       stands for it from here on.
    2. Each bucket of a band compares its smallest id with its other members: as many pairs as
       members. This is done for a few bands first; of the others, only buckets whose members are
       still in different components are looked at. Confirmed links give a first set of components.
    3. Two members of one bucket are also linked if neither is linked with its smallest id. Those
       are sought among the members of the same smallest id that are still in different
       components; their distances to it, counted in registers, must differ by no more than a
       link allows (triangle inequality), which leaves out nearly all of the others.
    """
    with blocks.bounded_batches(docs.sparkSession), working_tables() as stage:
        return stage.kept(_components_of_rows(docs, doc_id, text, stage), "near-duplicates")


def _components_of_rows(docs: DataFrame, doc_id: str, text: str, stage: Stage) -> DataFrame:
    with working_tables() as own:
        sketches = own(sketch(docs, doc_id, text), "sketches")
        rows = stage(sketches.select("doc_id", "n_shingles", "set_key"), "rows")
        # Rows of one set_key have equal sizes and registers.
        reps = stage(sketches.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"),
            F.first("registers").alias("registers")), "classes")

    source = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    likely = F.col("likely") >= LEAST_ESTIMATE
    first = _stars(reps, None, FIRST_BANDS, stage).where(likely).select("a", "b")
    links = _verified(first, source, stage)
    labels = components(links, stage)
    stars = _stars(reps, labels, BANDS, stage)
    apart = stage(stars.where(likely).select("a", "b").join(labels.toDF("a", "label_a"), "a", "left")
                  .join(labels.toDF("b", "label_b"), "b", "left")
                  .where("coalesce(label_a, a) != coalesce(label_b, b)").select("a", "b"), "apart")
    links = links.union(_verified(apart, source, stage))
    labels = components(links, stage)
    crossing = _crossing(stars, labels, source, reps, stage)
    more = stage(crossing.mapInArrow(_weigh, WEIGHED).where(F.col("likely") >= LEAST_ESTIMATE)
                 .select("a", "b").distinct(), "crossing")
    further = _verified(more, source, stage)
    if not further.isEmpty():
        labels = components(links.union(further), stage)
    by_class = reps.select("set_key", "id").join(labels.toDF("id", "label"), "id", "left").select(
        "set_key", F.coalesce("label", "id").alias("component"))
    by_id = labels.toDF("doc_id", "own")
    found = rows.join(by_class, "set_key", "left").join(by_id, "doc_id", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(
        F.coalesce(F.least("component", "own"), "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
