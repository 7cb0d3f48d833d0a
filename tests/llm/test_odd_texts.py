"""Odd rows: licence rules on texts that once stopped the JVM, rows found by their ids, working tables."""

import time

import pytest

from furrow.llm import license_rules, setsketch
from furrow.sources import stages

MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0"


@pytest.mark.parametrize("blank", [" ", "\n", "\t \n", "\r\n"])
def test_long_white_space_is_passed_in_one_go(spark, blank):
    long = blank * (1_000_000 // len(blank))
    texts = [f"1){long}x {MIT}", f"{long}a", f"a.{long}b", f"{MIT}{long}{MIT}", f"({long}1. {MIT}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: (r.n_sentences, r.licenses) for r in license_rules.scan(rows).collect()}
    assert time.time() - began < 60
    assert found[3] == (2, "MIT") and 1 not in found and 2 not in found


def test_each_row_is_judged_by_itself(spark):
    rows = [(None, MIT), (None, APACHE), (None, MIT), (5, MIT), (5, APACHE), (5, MIT), (6, None), (7, ""), (8, "none")]
    single = [license_rules.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect() for _, t in rows[:2]]
    (mit,), (apache,) = ([tuple(r)[1:] for r in x] for x in single)
    got = license_rules.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, str(r))
    assert sorted(map(tuple, got), key=key) == sorted(
        [(i, *x) for i, x in zip([None, None, None, 5, 5, 5], [mit, apache, mit] * 2)], key=key)


@pytest.mark.parametrize("wanted", [[], [3], [-7, 3, 3, 2 ** 62, None], list(range(-500, 500))])
def test_rows_found_by_bitmap(spark, wanted):
    """As a plain semi-join: no row missed, none too many, whatever the ids are."""
    have = [(i, f"t{i}") for i in [None, *range(-300, 300), 2 ** 62, -2 ** 63, 3]]
    rows = spark.createDataFrame(have, "id long, text string")
    ids = spark.createDataFrame([(i,) for i in wanted], "id long")
    found = sorted(tuple(r) for r in setsketch.among(rows, ids).collect())
    assert found == sorted(row for row in have if row[0] is not None and row[0] in wanted)


def test_working_tables_of_near_duplicates_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "stage_root", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 2}") for i in range(8)], "doc_id long, text string")
    assert {r.doc_id for r in setsketch.near_duplicates(docs).where("kept").collect()} == {0, 1}
    assert [p.name.rsplit("-", 1)[0] for p in (tmp_path / "furrow").iterdir()] == ["near-duplicates"]
