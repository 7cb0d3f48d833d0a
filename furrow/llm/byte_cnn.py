"""Language identification by a small convolutional network over bytes.

Byte embeddings, filters of several widths, the maximum of each filter over a window, softmax. It
is trained in numpy on a bounded sample of labelled texts and applied to every fixed-length window
of every whole text; a text's probabilities are the means over its windows, by their bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDED = 6
PAD = 256
UNKNOWN = "und"
#: Bound of the training sample: labelled documents, and windows taken from each.
SAMPLE_DOCUMENTS = 3000
SAMPLE_WINDOWS = 2
EPOCHS = 14
#: Windows that go through the network at once.
BATCH = 128


class Model(NamedTuple):
    labels: list[str]
    embedding: np.ndarray  # (257, EMBEDDED); the padding's row is zero
    filters: np.ndarray  # (max(WIDTHS) * EMBEDDED, len(WIDTHS) * FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # (filters, labels)
    offset: np.ndarray


# --- the network ---------------------------------------------------------------------------------

def _mask() -> np.ndarray:
    """Filters of every width share one matrix; the narrower ones are zero at its end."""
    widest = max(WIDTHS)
    rows = np.repeat(np.arange(widest), EMBEDDED)[:, None]
    return (rows < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)


def _unfold(model: Model, windows: np.ndarray) -> np.ndarray:
    """(windows, places, widest * EMBEDDED) inputs of the filters."""
    widest = max(WIDTHS)
    padded = np.full((len(windows), windows.shape[1] + widest - 1), PAD, np.int16)
    padded[:, :windows.shape[1]] = windows
    embedded = np.ascontiguousarray(model.embedding[padded])
    n, length, d = embedded.shape
    a, b, c = embedded.strides
    view = np.lib.stride_tricks.as_strided(
        embedded, (n, length - widest + 1, widest * d), (a, b, c))
    return np.ascontiguousarray(view)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """(windows, labels) for windows of byte values, PAD behind a text's end."""
    out = np.empty((len(windows), len(model.labels)), np.float64)
    for i in range(0, len(windows), BATCH):
        inputs = _unfold(model, windows[i:i + BATCH])
        n, places, width = inputs.shape
        found = (inputs.reshape(n * places, width) @ model.filters).reshape(n, places, -1)
        pooled = np.maximum(found.max(axis=1) + model.bias, 0)
        out[i:i + BATCH] = _softmax(pooled @ model.weights + model.offset)
    return out


def fit(windows: np.ndarray, labels: list[str], seed: int = 1, epochs: int = EPOCHS) -> Model:
    """Adam on cross entropy, each label with equal total weight."""
    names = sorted(set(labels))
    target = np.array([names.index(x) for x in labels])
    share = np.bincount(target, minlength=len(names))
    weight = (len(target) / (len(names) * share))[target].astype(np.float32)
    rng = np.random.default_rng(seed)
    mask = _mask()
    params = [rng.normal(0, 0.5, (257, EMBEDDED)).astype(np.float32),
              (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
              np.zeros(mask.shape[1], np.float32),
              rng.normal(0, 0.2, (mask.shape[1], len(names))).astype(np.float32),
              np.zeros(len(names), np.float32)]
    params[0][PAD] = 0
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size = 0, 64
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 2e-4
        for i in range(0, len(order), size):
            pick = order[i:i + size]
            grads = _gradients(Model(names, *params), windows[pick], target[pick], weight[pick], mask)
            step += 1
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
            params[0][PAD] = 0
    return Model(names, *params)


def _gradients(model: Model, windows, target, weight, mask) -> list[np.ndarray]:
    inputs = _unfold(model, windows)
    n, places, width = inputs.shape
    found = (inputs.reshape(n * places, width) @ model.filters).reshape(n, places, -1)
    best = found.argmax(axis=1)
    pooled = np.take_along_axis(found, best[:, None, :], 1)[:, 0] + model.bias
    active = np.maximum(pooled, 0)
    error = _softmax(active @ model.weights + model.offset).astype(np.float32)
    error[np.arange(n), target] -= 1
    error *= weight[:, None] / n
    back = (error @ model.weights.T) * (pooled > 0)
    at = inputs[np.arange(n)[:, None], best]  # (n, filters, width): what each maximum saw
    filters = np.einsum("nf,nfw->wf", back, at) * mask
    seen = back[:, :, None] * model.filters.T[None]
    padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)), constant_values=PAD)
    bytes_at = padded[np.arange(n)[:, None, None], best[:, :, None] + np.arange(max(WIDTHS))]
    embedding = np.zeros_like(model.embedding)
    np.add.at(embedding, bytes_at.reshape(-1), seen.reshape(-1, EMBEDDED))
    return [embedding, filters, back.sum(axis=0), active.T @ error, error.sum(axis=0)]


# --- Spark ---------------------------------------------------------------------------------------

def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text's bytes; the last one is filled with PAD."""
    values = np.full(max(1, -(-len(data) // WINDOW)) * WINDOW, PAD, np.int16)
    values[:len(data)] = np.frombuffer(data, np.uint8)
    return values.reshape(-1, WINDOW)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang",
          seed: int = 1, documents: int = SAMPLE_DOCUMENTS, per_document: int = SAMPLE_WINDOWS,
          epochs: int = EPOCHS) -> Model | None:
    """Fits on `documents` labelled texts, chosen by a hash of the row, and `per_document`
    stretches of WINDOW characters of each, at places chosen by a hash. None without any.

    Rows with a null text or label, or without a letter, teach nothing. Rows that are equal in id,
    text and label are ties: whichever of them are chosen, the sample is the same. Partitions send
    only rows whose hash is below a bound that about `documents` rows of the table are below.
    """
    rows = docs.select(docs[doc_id].alias("i"), docs[text].cast("string").alias("t"),
                       docs[label].cast("string").alias("l"))
    rows = rows.where("l is not null and t rlike '\\\\p{L}'")
    places = F.expr(f"transform(sequence(1, {per_document}), k -> substring(t, cast(1 + "
                    f"pmod(xxhash64(i, k), greatest(1, length(t) - {WINDOW - 1})) as int), {WINDOW}))")
    hashed = rows.withColumn("h", F.xxhash64("i", "t", "l", F.lit(seed)))
    candidates = hashed.where(F.col("h") <= hash_bound(rows.count(), documents))
    chosen = (candidates.select("i", "l", "h", places.alias("w"))
              .orderBy("h", "i", "l", "w").limit(documents).collect())
    data = [(w.encode()[:WINDOW], row.l) for row in chosen for w in dict.fromkeys(row.w) if w]
    if not data:
        return None
    return fit(np.concatenate([windows_of(x) for x, _ in data]), [x for _, x in data], seed, epochs)


def hash_bound(rows: int, wanted: int) -> int:
    """A bound that at least `wanted` of `rows` 64-bit hashes are below, all if they are fewer; the
    number of rows below it is ten deviations more."""
    share = (wanted + 10 * wanted ** 0.5 + 50) / max(1, rows)
    return (1 << 63) - 1 if share >= 1 else int(share * (1 << 64)) - (1 << 63)


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id",
            text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, *keep) of every row, from all windows of its whole text.

    `score` is the probability of the predicted label. A null text, one without a letter and any
    text without a model are UNKNOWN with score 0. Rows are kept one by one; columns not
    named by `keep` are left out. The model is a few kilobytes and travels with the task.
    """
    def step(batches):
        for batch in batches:
            yield _predicted(batch, model, keep)

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"),
                       docs[text].cast("string").alias("t"),
                       F.coalesce(docs[text].cast("string").rlike(r"\p{L}"), F.lit(False)).alias("ok"),
                       *[docs[c].alias(f"keep{i}") for i, c in enumerate(keep)])
    found = StructType.fromDDL("doc_id long, lang_pred string, score double")
    return rows.mapInArrow(step, StructType(
        found.fields + [StructField(c, docs.schema[c].dataType) for c in keep]))


def _predicted(batch: pa.RecordBatch, model: Model | None, keep: Sequence[str] = ()) -> pa.RecordBatch:
    ids, texts, letters, *others = batch.columns
    n = batch.num_rows
    labels, scores = [UNKNOWN] * n, np.zeros(n)
    held, size = [], 0

    def settle():
        shares = probabilities(model, np.concatenate([w for _, w, _ in held]))
        at = 0
        for row, windows, length in held:
            weight = np.full(len(windows), WINDOW, np.float64)
            weight[-1] = length - WINDOW * (len(windows) - 1)
            mean = weight @ shares[at:at + len(windows)] / weight.sum()
            at += len(windows)
            labels[row], scores[row] = model.labels[int(mean.argmax())], round(float(mean.max()), 6)

    if model is not None:
        for row, (data, ok) in enumerate(zip(texts.cast(pa.binary()), letters.to_pylist())):
            if not ok:
                continue
            data = data.as_py()
            windows = windows_of(data)
            held.append((row, windows, len(data)))
            size += len(windows)
            if size >= 16 * BATCH:
                settle()
                held, size = [], 0
        if held:
            settle()
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(labels, pa.string()), pa.array(scores), *others],
        names=["doc_id", "lang_pred", "score", *keep])


def held_out(doc_id):
    """Documents that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def predict_held_out(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang")
    part = F.coalesce(held_out(rows["doc_id"]), F.lit(False))
    model = train(rows.where(~part))
    found = predict(rows, model)
    return found.select("doc_id", F.coalesce(held_out(found["doc_id"]), F.lit(False)).alias("held_out"),
                        "lang_pred", "score")
