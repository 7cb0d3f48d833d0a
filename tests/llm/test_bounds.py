"""Bounds of what workers and the driver are handed, refused vocabularies, and plain versions of models."""

import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from furrow.llm import blocks, byte_cnn, queries, setsketch, weak_rules, word_bpe

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


# --- batches -------------------------------------------------------------------------------------

def test_batches_are_bounded_and_the_setting_is_put_back(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    frame = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 20000) AS t")
    before = spark.conf.get(SETTING)
    with blocks.bounded_batches(spark, 1 << 20):
        found = [r.n for r in frame.mapInArrow(sizes, "n long").collect()]
        with blocks.bounded_batches(spark, 1 << 26):  # the smaller limit holds
            assert int(spark.conf.get(SETTING).rstrip("bB")) == 1 << 20
    assert max(found) < 2 << 20 and sum(found) >= 400 * 20000
    with pytest.raises(KeyError):
        with blocks.bounded_batches(spark, 1 << 20):
            raise KeyError
    assert spark.conf.get(SETTING) == before


def test_results_written_later_are_handed_over_in_small_batches(spark):
    before = spark.conf.get(SETTING)
    rows = [(i, f"some words of text {i}", i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mix_position long")
    try:
        spark.conf.set(SETTING, "64MB")
        encoded = corpus_pipeline.encode(spark, docs, "")
        assert int(spark.conf.get(SETTING)) == blocks.HANDED_BYTES
        assert encoded.count() == 3
        spark.conf.set(SETTING, "1000")  # the smaller limit holds
        blocks.bound_batches(spark)
        assert spark.conf.get(SETTING) == "1000"
    finally:
        spark.conf.set(SETTING, before)


def test_rows_of_other_ids_are_left_out_before_they_are_shuffled(spark):
    """Too many ids to broadcast: the bitmap stands below the exchange of the rows, not above it."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {key: spark.conf.get(key, None) for key in keys}
    ids = spark.createDataFrame([(3,), (3,), (500,), (None,), (-7,)], "id long")
    rows = spark.range(1000).union(spark.range(3, 4)).selectExpr("nullif(id, 9) AS id", "id * 2 AS v")
    try:
        for key in keys:
            spark.conf.set(key, "-1")
        found = setsketch.among(rows, ids)
        text = found._jdf.queryExecution().toString()
        text = text[text.index("Physical Plan"):]
        assert text.index("SortMergeJoin") < text.index("BroadcastHashJoin")
        assert found.columns == ["id", "v"]
        assert sorted(map(tuple, found.collect())) == [(3, 6), (3, 6), (500, 1000)]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_batch_is_read_piece_by_piece():
    texts = [None if i % 7 == 0 else "ä" * (i * 997 % 20_000) for i in range(1500)] + ["x" * (3 << 20), "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["n", "t"])
    empty = batch.slice(0, 0)
    want = [(i, None if t is None else t.encode()) for i, t in enumerate(texts)]
    assert list(blocks.read(iter([empty, batch, empty]))) == want
    rows = blocks.read(iter([batch]))
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        assert tracemalloc.get_traced_memory()[1] < 10 << 20 < batch.nbytes
    finally:
        tracemalloc.stop()


# --- the training sample -------------------------------------------------------------------------

@pytest.mark.parametrize("rows", [0, 1, 3000, 3700, 10_000, 2_000_000])
def test_the_bound_lets_enough_rows_through(rows):
    hashes = np.random.default_rng(3).integers(-1 << 63, (1 << 63) - 1, rows, dtype=np.int64, endpoint=True)
    passed = int((hashes <= byte_cnn.hash_bound(rows, 3000)).sum())
    assert min(rows, 3000) <= passed <= 3000 + 20 * 3000 ** 0.5


def test_repeated_ids_do_not_change_the_model(spark):
    rows = [(7, f"text number {i} " * 5, "en" if i % 2 else "de") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [byte_cnn.train(frame.repartition(n), documents=20, epochs=1) for n in (1, 5)]
    assert models[0].labels == models[1].labels
    assert all(np.array_equal(a, b) for a, b in zip(models[0][1:], models[1][1:]))


def test_probabilities_by_hand():
    rng = np.random.default_rng(6)
    windows = np.concatenate([byte_cnn.windows_of(rng.bytes(n)) for n in (1, 40, 256, 300)])
    model = byte_cnn.fit(windows, ["a", "b", "c", "a", "b"], epochs=2)
    widest, got = max(byte_cnn.WIDTHS), byte_cnn.probabilities(model, windows)
    for window, found in zip(windows, got):
        padded = [*window.tolist(), *[byte_cnn.PAD] * (widest - 1)]
        pooled = []
        for f in range(model.filters.shape[1]):
            width = byte_cnn.WIDTHS[f // byte_cnn.FILTERS]
            kernel = model.filters[:, f].reshape(widest, byte_cnn.EMBEDDED)
            assert not kernel[width:].any()
            best = max(sum(float(model.embedding[padded[p + j]] @ kernel[j]) for j in range(width))
                       for p in range(len(window)))
            pooled.append(max(0.0, best + float(model.bias[f])))
        logits = np.array(pooled) @ model.weights + model.offset
        e = np.exp(logits - logits.max())
        assert np.allclose(found, e / e.sum(), atol=1e-4)


# --- rules ---------------------------------------------------------------------------------------

def test_estimates_equal_plain_expectation_maximisation():
    rng = np.random.default_rng(8)
    patterns = np.unique(rng.integers(0, 3, (40, 5)), axis=0)
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    right, good = [weak_rules.START_ACCURACY] * 5, weak_rules.START_GOOD
    posterior = []
    for _ in range(weak_rules.ROUNDS):
        posterior = []
        for row in patterns:
            p, q = good, 1 - good
            for vote, a in zip(row, right):
                if vote == weak_rules.GOOD:
                    p, q = p * a, q * (1 - a)
                elif vote == weak_rules.BAD:
                    p, q = p * (1 - a), q * a
            posterior.append(p / (p + q))
        for r in range(5):
            hits = votes = 0.0
            for row, n, p in zip(patterns, counts, posterior):
                if row[r] != weak_rules.ABSTAIN:
                    votes += n
                    hits += n * (p if row[r] == weak_rules.GOOD else 1 - p)
            share = (hits + weak_rules.PRIOR_VOTES * weak_rules.START_ACCURACY) / (votes + weak_rules.PRIOR_VOTES)
            right[r] = min(max(share, weak_rules.LEAST_ACCURACY), 1 - 1e-4)
        good = min(max((sum(n * p for n, p in zip(counts, posterior)) + weak_rules.START_GOOD)
                       / (counts.sum() + 1), 1e-3), 1 - 1e-3)
    assert np.allclose(weak_rules.estimate(patterns, counts), posterior, atol=1e-6)


# --- vocabularies --------------------------------------------------------------------------------

def _changed(**changes):
    with open(queries.vocabulary_path(), encoding="utf-8") as file:
        return json.dumps(json.load(file) | changes)


def test_the_given_vocabulary_is_taken():
    word_bpe.check_by_words(_changed())
    word_bpe.check_joined_by_blanks(_changed())


@pytest.mark.parametrize("changes", [
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
    {"pre_tokenizer": None},
    {"normalizer": {"type": "Prepend", "prepend": "x"}},
    {"added_tokens": [{"id": 49406, "content": "two words", "single_word": False, "lstrip": False,
                       "rstrip": False, "normalized": False, "special": True}]},
    {"added_tokens": [{"id": 49406, "content": "<x>", "single_word": False, "lstrip": True,
                       "rstrip": False, "normalized": False, "special": True}]},
])
def test_vocabularies_that_look_beyond_words_are_refused(changes):
    with pytest.raises(ValueError):
        word_bpe.check_by_words(_changed(**changes))


def test_vocabularies_with_a_decoder_are_refused():
    with pytest.raises(ValueError):
        word_bpe.check_joined_by_blanks(_changed(decoder={"type": "ByteLevel", "add_prefix_space": True,
                                                          "trim_offsets": True, "use_regex": True}))
