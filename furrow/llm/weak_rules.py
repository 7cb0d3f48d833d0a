"""Quality by weak supervision: rules vote or abstain, and EM weighs their votes.

The accuracies of the rules and the share of good documents are estimated from the counts of all
vote patterns of the corpus; a document is kept by its posterior probability of being good.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.runs import gram_hashes, mix
from furrow.sources.stages import stage

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Words in which votes are looked for that only running text has, one list a language.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "ein"),
    "fr": ("le", "la", "les", "et", "des", "un", "une", "que"),
    "es": ("el", "los", "las", "de", "que", "y", "en", "para"),
}
GOOD, BAD, ABSTAIN = 2, 1, 0
ROUNDS = 200
#: Where EM starts: rules are right in this share of their votes, documents good in that.
START_ACCURACY, START_GOOD = 0.8, 0.8
PRIOR_VOTES = 10
#: No rule counts as worse than a coin: what a rule calls a defect never speaks for a text.
LEAST_ACCURACY = 0.5

FEATURES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, n_lines long, n_distinct long, n_function long, n_capital long")


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts over each whole text. A null text has no words and zeros; rows are kept one by one,
    also without an id, and other columns are left out."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(_features, FEATURES)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FEATURES.split(", ")]
    function = {w.encode() for w in chain(*FUNCTION_WORDS.values())}
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = [_counts(t.as_py() or b"", function) for t in texts]
        columns = [pa.array(c, pa.int64()) for c in zip(*found)]
        if columns:
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)


def _counts(data: bytes, function: set[bytes]) -> tuple[int, ...]:
    words = data.split()
    blank = sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    letters = len(data.decode()) - blank
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = set(words)
    lower = [w.lower() for w in words]
    return (len(words), letters, sum(data.count(s) for s in (SYMBOLS[i:i + 1] for i in range(8))),
            len(lines) - len(set(lines)), repeated_words(words, distinct), len(lines),
            len(distinct), sum(map(function.__contains__, lower)),
            sum(map(bytes.isupper, words)))


def repeated_words(words: list[bytes], distinct: set[bytes]) -> int:
    """Words inside windows of REPEAT_WINDOW words that stand in the text twice or more."""
    n = len(words)
    if n <= REPEAT_WINDOW:
        return 0
    number = {w: i for i, w in enumerate(distinct)}
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, n)
    windows = gram_hashes(mix(ids + np.uint64(1)), REPEAT_WINDOW)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, windows), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == windows)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + REPEAT_WINDOW, -1)
    return int((np.cumsum(change[:n]) > 0).sum())


def _vote(bad: Column, good: Column | None = None) -> Column:
    """BAD where `bad` holds, else GOOD where `good` holds, else ABSTAIN; null holds nowhere."""
    vote = F.when(bad, BAD)
    if good is not None:
        vote = vote.when(good, GOOD)
    return vote.otherwise(ABSTAIN)


def votes() -> list[tuple[str, Column]]:
    """Each rule's vote from the counts. Rules that know a defect vote BAD or abstain; those that
    know running text also vote GOOD. Ratios of texts without words are null: abstain."""
    words = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    lines = F.nullif(F.col("n_lines"), F.lit(0)).cast("double")
    letters = F.nullif(F.col("word_chars"), F.lit(0)).cast("double")
    function, symbols = F.col("n_function") / words, F.col("n_symbols") / letters
    length = F.col("word_chars") / words
    return [
        ("short", _vote(F.col("n_words") < 20)),
        ("word_length", _vote((length < 2.5) | (length > 11))),
        ("symbols", _vote(symbols > 0.05, symbols < 0.01)),
        ("dup_lines", _vote(F.col("n_dup_lines") / lines > 0.3)),
        ("repeats", _vote(F.col("n_repeat_words") / words > 0.3)),
        ("function_words", _vote(function < 0.04, function >= 0.1)),
        ("capitals", _vote(F.col("n_capital") / words > 0.4)),
        ("variety", _vote(F.col("n_distinct") / words < 0.15)),
    ]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior probability of GOOD of each vote pattern, by expectation-maximisation.

    `patterns` is (patterns, rules) of votes, `counts` their documents. A rule is right in a share
    of its votes that EM estimates (its accuracy); abstaining says nothing. PRIOR_VOTES made-up
    votes of START_ACCURACY smooth each accuracy, so a rule without votes keeps its start.
    """
    signs = np.select([patterns == GOOD, patterns == BAD], [1.0, -1.0], 0.0)
    cast = counts @ np.abs(signs)
    accuracy = np.full(patterns.shape[1], START_ACCURACY)
    good, posterior = START_GOOD, np.full(len(patterns), START_GOOD)
    for _ in range(rounds):
        odds = np.log(good / (1 - good)) + signs @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved = np.abs(new - posterior).max(initial=0)
        posterior = new
        right = np.where(signs > 0, posterior[:, None], np.where(signs < 0, 1 - posterior[:, None], 0))
        accuracy = (counts @ right + PRIOR_VOTES * START_ACCURACY) / (cast + PRIOR_VOTES)
        accuracy = np.clip(accuracy, LEAST_ACCURACY, 1 - 1e-4)
        good = np.clip((counts @ posterior + START_GOOD) / (counts.sum() + 1), 1e-3, 1 - 1e-3)
        if moved < 1e-9:
            break
    return posterior


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """The counts of each row, its votes, `posterior`, `base_failed` and `kept`.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated windows. kept: not
    base_failed and posterior >= threshold. Only the counts of vote patterns (at most 3 to the
    number of rules, however large the corpus) reach the driver. An empty table gives no rows.
    """
    rules = votes()
    pattern = F.concat(*[vote.cast("string") for _, vote in rules])
    counted = stage(features(docs, doc_id, text).withColumn("votes", pattern), "quality")
    found = sorted((r.votes, r["count"]) for r in counted.groupBy("votes").count().collect())
    names = [p for p, _ in found]
    if names:
        posterior = estimate(np.array([[int(v) for v in p] for p in names]),
                             np.array([c for _, c in found], np.float64))
    else:
        names, posterior = ["0" * len(rules)], [START_GOOD]
    spark = docs.sparkSession
    table = spark.createDataFrame([(p, float(round(x, 9))) for p, x in zip(names, posterior)],
                                  "votes string, posterior double")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (counted.join(F.broadcast(table), "votes")  # at most 3^rules rows of 30 bytes
            .withColumn("base_failed", base)
            .withColumn("kept", ~base & (F.col("posterior") >= threshold)))


def report(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "posterior", "votes")
