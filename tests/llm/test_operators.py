"""Operators of the llm subpackage against brute force, round trips and held-out labels."""

import base64
import collections
import contextlib
import hashlib
import io

import numpy as np
import pytest

import corpus_pipeline
from furrow.llm import (byte_cnn, column_bwt, license_rules, mixing, order_minhash, queries, setsketch,
                        suffix_trees, warc, weak_rules, word_bpe)

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, block long, kind int, "
          "body binary, bucket long, label string, id long, a long, b long, n long, t string, "
          "mix_slot int, votes string, registers binary, i long, part int, place int, path string")
EXTRA = (7, 7, b"x", 7, "x", 7, 7, 7, 7, "x", 7, "x", b"x", 7, 7, 7, "x")

WORDS = [f"w{i:03d}" for i in range(400)]
PASSAGE = " ".join(WORDS[100:160])


def _text(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, 400, n))


def _rows():
    base = _text(1, 200)
    near = base.replace(base.split()[50], "changed", 1)
    texts = {
        1: base, 2: near, 3: base, 4: None, 5: "", 6: "  \n\t ", 7: "one two three", 8: "ONE two Three",
        9: f"{_text(9)} {PASSAGE} {_text(10)}", 10: f"{_text(11)}\n{PASSAGE}\n{_text(12)}",
        11: "aaaa " * 150, 12: "é" * 400, 13: "x" * 300_000, 14: f"{PASSAGE} {PASSAGE}",
        15: "Released under the MIT License.\nAll rights reserved. Tail", 16: "½ 12 !! -- \x00  ",
        17: "<|endoftext|> it's Ἀθήνα ΣΑΣ 中文 oḱ don't", 4096: base, 9000: _text(20, 30),
    }
    rows = [(k, v, "en" if k % 3 else None, "s1" if k % 2 else None, 3) for k, v in texts.items()]
    rows += [rows[8], rows[8], (None, base, "de", "s2", None), (None, None, None, None, None)]
    return [(*r, *EXTRA) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def _ordered(frame):
    """(id, text) in the order of the corpus: by id and text, without an id last."""
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


# --- WARC ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("least", [0, 10])
def test_archives_round_trip(spark, least):
    rows = [(1, "http://a/1", "<p>x</p>" * 20), (2, None, "<p>x</p>" * 20), (3, "http://a\r\nb", None),
            (4, "u", ""), (5, "u", "ä" * 100_000), (None, "u", "<p>x</p>" * 20), (7, "u", "tiny"),
            (8, "u", "tiny"), (8, "u", "tiny")]
    pages = spark.createDataFrame(rows * 1, "page_id long, url string, html string")
    read = warc.page_records(warc.read_archives(warc.write_archives(pages, least_revisit=least)))
    firsts = {}
    for i, _, html in rows:
        if i is not None:
            firsts[html or ""] = min(firsts.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = firsts[html or ""]
        again = first != i and len(data) >= least
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if again else "response", first if again else None, None))
    assert sorted(map(tuple, read.collect()), key=str) == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_broken_archives_are_told(spark, documents):
    pages = documents.selectExpr("doc_id page_id", "'u' url", "text html")
    [(path, data)] = warc.write_archives(pages.coalesce(1)).collect()
    data = bytes(data)
    assert warc.leading_dictionary(data)[0] is not None
    whole = warc.read_archives(spark.createDataFrame([(path, data)], "path string, content binary"))
    assert whole.where("error is null").count() == 200
    start = warc.leading_dictionary(data)[1]
    first = warc.frame_end(data, start)
    flipped = data[:first - 6] + bytes([data[first - 6] ^ 255]) + data[first - 5:]
    broken = [("cut", data[:-5]), ("flipped", flipped), ("noise", b"no archive at all"), ("empty", None)]
    read = warc.read_archives(spark.createDataFrame(broken, "path string, content binary"))
    bad = {r.path: r.n for r in read.where("error is not null").groupBy("path").count()
           .toDF("path", "n").collect()}
    assert bad == {"cut": 1, "flipped": 1, "noise": 1}
    assert read.where("path = 'cut' and error is null").count() == 199


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Dote"),
                                    (b"Content-Length: 2", b"Content-Length: 3"), (b"\r\nab", b"\r\nabc")])
def test_record_faults(change):
    record = warc._record(1, "u", b"ab", None, "2024-01-01T00:00:00Z")
    warc.parse_record(record)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(*change))


# --- licences ------------------------------------------------------------------------------------

def test_licence_rules(docs, none):
    got = {r.doc_id: (r.licenses, r.unmatched) for r in license_rules.scan(docs).collect()}
    assert got == {15: ("MIT,proprietary", None)}
    assert license_rules.scan(none).count() == 0


def test_specific_rules_come_first(spark):
    mit = ["MitGrant", "MitNotice", "MitNoWarranty", "MitNoLiability"]
    known = {v: k for k, v in license_rules.SENTENCES.items()}
    whole = ".\n".join(known[x].capitalize() for x in mit) + "."
    parted = f"{known['BsdGrant'].capitalize()}. Other words. {known['BsdSource'].capitalize()}."
    rows = [(1, whole), (2, parted)]
    got = {r.doc_id: (r.licenses, r.unmatched)
           for r in license_rules.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", None), 2: (None, "BsdGrant,BsdSource")}


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2 = """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


@pytest.mark.parametrize("shape", [
    lambda x: x,
    lambda x: " ".join(x.split()),
    lambda x: "# " + x.replace("\n", "\n# "),
    lambda x: "/*\n * " + x.replace("\n", "\n * ") + "\n */\nint main() {}",
    lambda x: "// " + x.replace("\n", "\r\n// "),
    lambda x: x.replace("1. ", "a) ").replace("2. ", "(b) ").replace("3. ", "* "),
])
def test_standard_headers(spark, shape):
    texts = {"GPL-3.0-or-later": GPL.format(":", ",", 3), "GPL-2.0-or-later": GPL.format(";", ";", 2),
             "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE}
    rows = [(i, shape(x)) for i, x in enumerate(texts.values())]
    got = license_rules.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licenses, r.unmatched) for r in got} == {
        i: (x, "ApacheSee" if x == "Apache-2.0" else None) for i, x in enumerate(texts)}


# --- Order MinHash -------------------------------------------------------------------------------

def _plain_fingerprint(text, k=order_minhash.K, m=order_minhash.SIGNATURES, kept=order_minhash.KEPT):
    from furrow.llm.runs import gram_hashes, mix
    points = order_minhash.code_points(text)
    if not len(points):
        return [0] * m
    k = min(k, len(points))
    grams = gram_hashes(mix(points.astype(np.uint64) + np.uint64(1)), k).tolist()
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for place, g in enumerate(grams):
        h = int(mix(np.array([(g + (seen[g] + 1) * 0x9E3779B97F4A7C15) & (2 ** 64 - 1)], np.uint64))[0])
        seen[g] += 1
        bins[h >> (64 - (m.bit_length() - 1))].append((h, place))
    out = [0] * m
    for b, items in bins.items():
        chosen = sorted(sorted(items)[:kept], key=lambda x: x[1])
        value = 0
        for j in range(kept):
            h = chosen[j][0] if j < len(chosen) else 0
            value = int(mix(np.array([(value * 0x9E3779B97F4A7C15 + h + j + 1) & (2 ** 64 - 1)],
                                     np.uint64))[0])
        out[b] = (value >> 32) | 1
    return out


def test_fingerprints_by_brute_force():
    texts = ["", "a", "abc", "ab" * 100, "x" * 5000, _text(1, 300), _text(2, 40), "é中" * 30]
    got = order_minhash.fingerprints([order_minhash.code_points(t) for t in texts])
    assert got.tolist() == [_plain_fingerprint(t) for t in texts]


def test_order_counts():
    words = _text(3, 300).split()
    a, b = " ".join(words), " ".join(words[150:] + words[:150])
    c = " ".join(words[:-3] + ["new"] * 3)
    prints = order_minhash.fingerprints([order_minhash.code_points(t) for t in (a, a, b, c)])
    same, moved, edited = (order_minhash.likeness(prints[:1], prints[i:i + 1])[0] for i in (1, 2, 3))
    assert same == 1 and moved < 0.7 < edited


def test_neighbours(docs, none):
    rows = sorted(((r[0], r[1] or "") for r in _rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 2
        edited = text[:len(text) - cut] + following[:cut]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = order_minhash.edited_neighbours(docs.repartition(5)).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == sorted(want, key=str)
    assert order_minhash.edited_neighbours(docs.where("doc_id = 1")).first().near_next == 1
    assert order_minhash.edited_neighbours(none).count() == 0
    assert order_minhash.fingerprint(docs).count() == docs.count()


# --- repeated passages ---------------------------------------------------------------------------

def _covered(rows, split, width):
    first, out = set(), []
    for doc_id, text in rows:
        symbols = split(text)
        mark = np.zeros(len(symbols), bool)
        for p in range(len(symbols) - width + 1):
            window = symbols[p:p + width] if isinstance(symbols, bytes) else tuple(symbols[p:p + width])
            if window in first:
                mark[p:p + width] = True
            first.add(window)
        out.append((doc_id, symbols, mark))
    return out


@pytest.mark.parametrize("hot", [256, 0])
@pytest.mark.parametrize("source", ["docs", "documents"])
def test_byte_repeats(request, source, hot):
    frame = request.getfixturevalue(source)
    want = [(i, len(s), int(m.sum()), bytes(c for c, r in zip(s, m) if not r))
            for i, s, m in _covered(_ordered(frame), lambda t: (t or "").encode(), 100)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept))
           for r in column_bwt.remove_repeats(frame, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("hot", [256, 0])
@pytest.mark.parametrize("source", ["docs", "documents"])
def test_word_repeats(request, source, hot):
    frame = request.getfixturevalue(source)
    want = [(i, len(s), int(m.sum()), b" ".join(c for c, r in zip(s, m) if not r).decode())
            for i, s, m in _covered(_ordered(frame), lambda t: (t or "").encode().split(), 20)]
    rows = suffix_trees.remove_repeats(frame, hot=hot).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all((r.text or "").encode().split() == r.kept.encode().split() for r in rows)


def test_word_repeats_keep_columns_with_their_rows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(2, f"{passage} two", "é", None, 2.5), (1, passage, None, 7, 1.5), (None, None, "x", 8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, `n chars` long, weight double")
    got = suffix_trees.remove_repeats(frame, keep=["source", "n chars", "weight"])
    assert got.columns[-3:] == ["source", "n chars", "weight"]
    assert {(r.doc_id, r.n_removed, *r[-3:]) for r in got.collect()} == {
        (1, 0, None, 7, 1.5), (2, 30, "é", None, 2.5), (None, 0, "x", 8, None)}


def test_repeats_of_nothing(none):
    assert column_bwt.remove_repeats(none).count() == suffix_trees.remove_repeats(none).count() == 0


def test_collection_transform_sorts_suffixes():
    content = [b"banana", b"anana", b"", b"nab\x00\xff", b"banana"]
    place, common = column_bwt.collection_order(content, 100)
    joined = [(s, i) for i, s in enumerate(content)]
    start = np.cumsum([0] + [len(c) + 1 for c in content])
    suffixes = sorted((s[j:], i, int(start[i] + j)) for s, i in joined for j in range(len(s) + 1))
    text = {int(start[i] + j): s[j:] for s, i in joined for j in range(len(s) + 1)}
    assert [text[p] for p in place.tolist()] == [s for s, _, _ in suffixes]
    for before, after, n in zip(place, place[1:], common[1:].tolist()):
        x, y = text[int(before)], text[int(after)]
        assert n == next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_prefix_groups_keep_windows_together():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, 3000)
    suffixes = np.arange(2980)
    groups = list(suffix_trees.prefix_groups(symbols, suffixes, 20, 200))
    assert sorted(np.concatenate(groups)) == suffixes.tolist()
    home = {}
    for g, group in enumerate(groups):
        for p in group.tolist():
            assert home.setdefault(tuple(symbols[p:p + 20]), g) == g
    assert max(map(len, groups)) <= 200


# --- language, quality ---------------------------------------------------------------------------

def test_language_of_held_out_documents(spark, docs, none):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = byte_cnn.predict_held_out(frame).join(frame.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    model = byte_cnn.train(frame, documents=100, epochs=1)
    rows = byte_cnn.predict(docs, model).collect()
    assert len(rows) == docs.count()
    unknown = {r.doc_id for r in rows if r.lang_pred == byte_cnn.UNKNOWN}
    assert {4, 5, 6, 16} == unknown - {None} and all(0 <= r.score <= 1 for r in rows)
    assert byte_cnn.train(none) is None and byte_cnn.predict(none, model).count() == 0
    assert {r.lang_pred for r in byte_cnn.predict(docs, None).collect()} == {byte_cnn.UNKNOWN}


def test_gradients():
    rng = np.random.default_rng(2)
    windows = np.stack([byte_cnn.windows_of(rng.bytes(200))[0] for _ in range(4)])
    labels = ["a", "b", "a", "b"]
    model = byte_cnn.fit(windows, labels, epochs=1)
    target, weight = np.array([0, 1, 0, 1]), np.ones(4, np.float32)

    def loss(filters):
        p = byte_cnn.probabilities(model._replace(filters=filters), windows)
        return -np.log(p[np.arange(4), target]).mean()

    grads = byte_cnn._gradients(model, windows, target, weight, byte_cnn._mask())
    for at in [(0, 0), (3, 5), (7, 20)]:
        step = np.zeros_like(model.filters)
        step[at] = 1e-3
        slope = (loss(model.filters + step) - loss(model.filters - step)) / 2e-3
        assert abs(slope - grads[1][at]) < 2e-2


def _plain_counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    mark = [False] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            mark[i:i + 8] = [True] * 8
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), sum(mark))


@pytest.mark.parametrize("source", ["docs", "documents"])
def test_quality_counts(request, source):
    frame = request.getfixturevalue(source)
    rows = weak_rules.judge(frame).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]
    want = [(i, *_plain_counts(t)) for i, t in _ordered(frame)]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_quality_of_labelled_documents(spark, none):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = weak_rules.judge(frame).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert weak_rules.judge(none).count() == 0


# --- BPE -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("source", ["docs", "documents"])
def test_bpe_equals_the_library(request, source):
    from tokenizers import Tokenizer
    frame, path = request.getfixturevalue(source), queries.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for doc_id, text in _ordered(frame):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    got = [tuple(r) for r in word_bpe.decode(word_bpe.encode(frame, path), path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert word_bpe.encode(frame.where("false"), path).count() == 0


# --- mixing --------------------------------------------------------------------------------------

@pytest.mark.parametrize("weights", [None, {"s1": 3.0, "": 1.0}, {}])
def test_mixing_follows_weights(spark, docs, none, weights):
    many = docs.crossJoin(spark.range(40).select("id").toDF("copy")).drop("mix_slot")
    rows = mixing.mix(many, weights, block_rows=4, period=10).collect()
    assert len(rows) == many.count() == len({r.mix_position for r in rows})
    shares = {r.source: r for r in mixing.quotas(many, weights, block_rows=4, period=10).collect()}
    slots = {r.mix_slot: (r.source or "", r.mix_block) for r in rows}
    assert sorted(slots) == list(range(sum(s.blocks for s in shares.values())))
    begin, period = 0, 0
    while begin < len(slots):
        quota = {k: min(s.quota, max(0, s.blocks - period * s.quota)) for k, s in shares.items()}
        length, done = sum(quota.values()), collections.Counter()
        for t in range(length):  # earliest deadline first among released blocks, by hand
            free = [(-(-(done[k] + 1) * length // q), k) for k, q in quota.items()
                    if done[k] < q and done[k] * length // q <= t]
            want = min(free)[1]
            assert slots[begin + t] == (want, period * shares[want].quota + done[want])
            done[want] += 1
            assert all(abs(done[k] - q * (t + 1) / length) < 1 for k, q in quota.items())
        begin, period = begin + length, period + 1
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("blocks, weights", [
    ({"a": 1336, "b": 2664}, {"a": 0.334, "b": 0.666}),
    ({"a": 900, "b": 900, "c": 3}, {"a": 0.5, "b": 0.499, "c": 0.001}),
    ({f"s{i:03d}": 4 + i % 5 for i in range(130)}, {f"s{i:03d}": 1 + i % 7 for i in range(130)}),
    ({"a": 40, "b": 30, "unnamed": 5}, {"a": 1, "b": 2}),
])
def test_mixing_stays_within_a_block_of_given_weights(spark, blocks, weights):
    rows = [(i, k) for k, n in blocks.items() for i in range(n)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=1)
    order = [r.source for r in mixed.orderBy("mix_slot").collect()]
    assert collections.Counter(order) == blocks
    done, base, begin = collections.Counter(), collections.Counter(), 0
    for t, name in enumerate(order, 1):
        last = {k for k in blocks if base[k] < blocks[k]}
        weight = {k: weights.get(k, 0) for k in last}
        if not any(weight.values()):
            weight = dict.fromkeys(last, 1)
        done[name] += 1
        for k in last:
            target = base[k] + weight[k] / sum(weight.values()) * (t - begin)
            assert abs(done[k] - target) < 1 + 1e-6
        if done[name] == blocks[name]:
            base, begin = done.copy(), t


def test_reported_weights_are_the_targets(spark):
    rows = [(i, "a" if i < 9000 else "b" if i < 9100 else "c") for i in range(9101)]
    got = {r.source: r.target_weight for r in mixing.report(
        spark.createDataFrame(rows, "doc_id long, source string")).select("source", "target_weight")
        .distinct().collect()}
    roots = {"a": 9000 ** 0.5, "b": 10, "c": 1}
    assert got == {k: pytest.approx(v / sum(roots.values()), abs=1e-8) for k, v in roots.items()}


# --- near duplicates -----------------------------------------------------------------------------

def _components(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets.append(frozenset(grams))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if rows[i][0] == rows[j][0] or both and 100 * both >= 75 * len(sets[i] | sets[j]):
                    label[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = rows[find(i)][0] if doc_id is not None else None
        out.append((doc_id, len(sets[i]), component, doc_id is None or component == doc_id))
    return out


@pytest.mark.parametrize("source", ["docs", "documents"])
def test_near_duplicates(request, source):
    frame = request.getfixturevalue(source)
    got = [tuple(r) for r in setsketch.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == sorted(_components(_ordered(frame)), key=str)
    assert setsketch.near_duplicates(frame.where("false")).count() == 0


def test_chains_between_members_of_one_bucket(spark):
    """Edits accumulate, so that most members are linked with each other and not with the first."""
    rng = np.random.default_rng(5)
    words, rows = _text(40, 150).split(), []
    for i in range(60):
        if i % 3 == 0 and i:
            words[int(rng.integers(150))] = f"n{i}"
        copy = list(words)
        copy[int(rng.integers(150))] = f"own{i}"
        rows.append((int(i), " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(frame).collect()}
    assert got == {r[0]: r[2] for r in _components(rows)}


def test_bitmaps_never_hide_common_items():
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    for size in (0, 1, 40, 900, 5000):
        a, b = (np.unique(rng.permutation(pool)[:size]) for _ in range(2))
        x, y = setsketch.bitmap(a), setsketch.bitmap(b)
        most = min(len(a) - int(np.bitwise_count((x & ~y).view(np.uint64)).sum()),
                   len(b) - int(np.bitwise_count((y & ~x).view(np.uint64)).sum()))
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
        assert len(x) == len(setsketch.BITMAP)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2 ** 63, 3000).astype(np.uint64)
    a, b = np.unique(x[:2400]), np.unique(x[600:])
    ra, rb = (setsketch.registers(setsketch.minima(s)) for s in (a, b))
    union = setsketch.registers(setsketch.minima(np.union1d(a, b)))
    assert (setsketch.merge(ra, rb) == union).all()
    guess = setsketch.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(guess - 0.6) < 0.12


# --- pipeline ------------------------------------------------------------------------------------

def test_pipeline(spark, documents):
    frame = documents
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in frame.select("doc_id").collect()}
        frame = step(spark, frame, SF_DIR).persist()
        assert frame.columns == corpus_pipeline.COLUMNS
        assert {r.doc_id for r in frame.select("doc_id").collect()} <= before
    left = {r.doc_id: r.text for r in frame.collect()}
    kept = {r[0] for r in _components(_ordered(documents)) if r[3]}
    assert set(left) <= kept and len(left) >= 0.95 * len(kept)
    ids = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert set(ids) == set(left) and all(n > 0 for n in ids.values())


def test_pipeline_sends_no_text_after_passages_are_cut(spark, documents):
    frame = documents.selectExpr("*", "doc_id AS row_key", "CAST(NULL AS LONG) AS mix_position")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        corpus_pipeline.cut_repeated_passages(spark, frame, SF_DIR).explain()
    assert "Join" not in text.getvalue()
    assert "Exchange" not in text.getvalue().split("MapInArrow")[0]


def test_pipeline_of_nothing_and_odd_rows(spark, docs, none):
    for frame in (docs, none):
        for _, step in corpus_pipeline.STAGES:
            frame = step(spark, frame, SF_DIR).persist()
            frame.count()


def test_pipeline_returns_the_mixed_order(spark, documents):
    frame = documents
    for _, step in corpus_pipeline.STAGES[:3]:
        frame = step(spark, frame, SF_DIR).persist()
    want = {r.doc_id: r.mix_position for r in mixing.mix(frame).select("doc_id", "mix_position").collect()}
    got = {r.doc_id: r.mix_position for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == want and sorted(want, key=want.get) != sorted(want)
    with pytest.raises(Exception, match="no mix_position"):
        corpus_pipeline.encode(spark, frame, SF_DIR).collect()


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, documents):
    texts = [r for r in documents.orderBy("doc_id").limit(90).collect()]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(len(texts))]
    frame = spark.createDataFrame(
        [(k, r.text, r.lang, r.source, r.n_chars) for k, r in zip(ids, texts)],
        "doc_id long, text string, lang string, source string, n_chars long")
    known = byte_cnn.predict(frame, byte_cnn.train(frame), keep=["text"]).where("lang_pred != 'und'")
    want = collections.Counter((r.doc_id, r.text) for r in known.collect())
    frame = corpus_pipeline.identify_languages(spark, frame, SF_DIR).persist()
    rows = frame.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == want
    assert len({r.row_key for r in rows}) == len(rows) > 60 and sum(r.row_key == 7 for r in rows) == 1
    kept = {r[0] for r in _components(sorted((r.row_key, r.text) for r in rows)) if r[3]}
    frame = corpus_pipeline.drop_near_duplicates(spark, frame, SF_DIR).persist()
    assert sorted(r.row_key for r in frame.collect()) == sorted(kept)
    for _, step in corpus_pipeline.STAGES[2:4]:
        frame = step(spark, frame, SF_DIR).persist()
    left = collections.Counter(r.doc_id for r in frame.collect())
    assert left[None] > 10 and left[7] > 10
    done = corpus_pipeline.encode(spark, frame, SF_DIR).collect()
    assert collections.Counter(r.doc_id for r in done) == left
