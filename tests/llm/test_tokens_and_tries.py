"""Token links, burst tries and byte-level BPE against brute force and the tokenizer libraries."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from furrow.llm import burst_trie, byte_bpe, queries, token_links

SF_DIR = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
A_FILE, B_FILE = map(public_tokenizers.path, queries.ALIGNED_FILES)
#: Columns of the tests' tables beside those an operator reads, with names that operators use inside.
EXTRA = ("ids long, decoded string, bundle long, body binary, block long, kind int, a_id long, most long, "
         "path string, cuts string, key string, n long, first long, members string, container long, id long")
EXTRA_ROW = (7, "x", 7, b"x", 7, 7, 7, 7, "x", "x", "x", 7, 7, "x", 7, 7)

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, "  \n\t "), (5, "x" * 100_000),
    (6, "<|endoftext|> it's Ἀθήνα 中文 \U0001F600 oḱ don't"), (7, "½ 12 !! -- \x00 � ﬁ"),
    (7, "½ 12 !! -- \x00 � ﬁ"), (7, "another text of the same id"), (None, "no id"), (None, None), (None, "no id"),
    (8, "▁ the piece's own mark"), (9, " leading and trailing  "), (10, "a b c　d\x85e\x1cf"),
    (11, "".join(random.Random(1).choice("abcdefgh \n") for _ in range(20_000))), (12, "The quick brown fox."),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *EXTRA_ROW) for r in TEXTS], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def _plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def _texts(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


# --- byte-level BPE ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS),
                             special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.mark.parametrize("seed", range(3))
def test_pieces_as_the_merges_make_them(library, vocabulary, seed):
    rng = random.Random(seed)
    tokens = [t for t in vocabulary.token if t]
    letters = [b"abeinrst", b" \n.,-=*", bytes(range(256))][seed]
    for _ in range(4000):
        piece = bytes(rng.choice(letters) for _ in range(rng.randint(1, 25)))
        assert vocabulary.encode_piece(piece) == library._core_bpe.encode_single_piece(piece)
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5)))
        assert vocabulary.encode_piece(piece) == library._core_bpe.encode_single_piece(piece)


def test_fitting_neighbours_are_those_that_merges_leave_alone(library, vocabulary):
    rng = random.Random(5)
    tokens = [t for t in vocabulary.token if t]
    for _ in range(5000):
        left, right = rng.choice(tokens), rng.choice(tokens[:2000])
        want = library._core_bpe.encode_single_piece(left + right)
        pair = [vocabulary.token.index(left), vocabulary.token.index(right)] if rng.random() < 0.02 else None
        ids = library.encode_single_token(left), library.encode_single_token(right)
        assert pair is None or pair == list(ids)
        assert vocabulary.fits(*ids) == (want == list(ids))


def test_tokens_no_merge_makes_never_stand_in_a_result():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257, b"abc": 258}
    own = byte_bpe.Vocabulary(ranks, r"(?s:.+)")
    assert own.encode("xyzabcab") == [120, 121, 122, 258, 256]


def test_memory_limits_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES_KEPT", 3)
    monkeypatch.setattr(byte_bpe, "PAIRS_KEPT", 3)
    own = byte_bpe.Vocabulary(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    text = " ".join(t or "" for _, t in TEXTS if not t or len(t) < 1000)
    assert own.encode(text) == library.encode_ordinary(text)


def test_byte_bpe_as_the_library(odd, documents, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BATCH_BYTES", 1000)
    for frame in (odd, documents):
        encoded = byte_bpe.encode(frame, RANKS, public_tokenizers.PATTERN)
        got = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
        want = [(i, library.encode_ordinary(t or "")) for i, t in _texts(frame)]
        assert _plain((r.doc_id, r.ids) for r in byte_bpe.arrays(encoded).collect()) == _plain(want)
        assert _plain((r.doc_id, bytes(r.decoded)) for r in got.collect()) == _plain(
            (i, (t or "").encode()) for i, t in _texts(frame))
        digests = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(library.decode_bytes(x)).hexdigest()) for i, x in want]
        assert _plain(byte_bpe.digests(got).collect()) == _plain(digests)


def test_byte_bpe_of_nothing(spark, odd):
    none = odd.limit(0)
    encoded = byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN)
    assert byte_bpe.digests(byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)).count() == 0


# --- token links ---------------------------------------------------------------------------------

def _dense(m):
    out = np.zeros((len(m.start) - 1, m.width), np.int64)
    row, column, value = token_links.entries(m)
    np.add.at(out, (row, column), value)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_products_of_sparse_rows(seed):
    rng = np.random.default_rng(seed)
    total = int(rng.integers(1, 60))

    def sizes():
        cuts = np.sort(rng.choice(np.arange(1, total), int(rng.integers(0, total)), replace=False)) if total > 1 else []
        return np.diff(np.concatenate([[0], cuts, [total]])).astype(np.int64)

    a, b = token_links.incidence(sizes()), token_links.incidence(sizes())
    assert (_dense(token_links.product(a, token_links.transposed(b))) == _dense(a) @ _dense(b).T).all()
    # Rows out of order and columns met more than once.
    group_a, group_b = rng.integers(0, 4, 9), rng.integers(0, 4, 7)
    g, h = token_links.membership(group_a, 4), token_links.membership(group_b, 4)
    assert (_dense(token_links.product(g, token_links.transposed(h))) == _dense(g) @ _dense(h).T).all()
    both = token_links.product(token_links.transposed(g), g)
    assert (_dense(both) == _dense(g).T @ _dense(g)).all()
    row, _, _ = token_links.group_links(group_a, group_b, 4)
    assert (np.bincount(row, minlength=9) == token_links.group_link_count(group_a, group_b, 4)).all()


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_links_of_groups_come_in_parts(most):
    rng = np.random.default_rng(most)
    group_a, group_b = np.sort(rng.integers(0, 4, 30)), np.sort(rng.integers(0, 4, 20))
    whole = list(zip(*(x.tolist() for x in token_links.group_links(group_a, group_b, 4))))
    parts = list(token_links.group_link_parts(group_a, group_b, 4, most))
    assert [e for part in parts for e in zip(*(x.tolist() for x in part))] == whole
    assert all(len(row) <= max(most, 20) for row, _, _ in parts)


def _spans(sizes):
    ends = np.cumsum(sizes)
    return list(zip((ends - sizes).tolist(), ends.tolist()))


def _aligned(rows, pair):
    """Per document: ids of both, links as places and shared bytes, groups; plain loops."""
    out = []
    for doc_id, text in rows:
        own = (" " + (text or "")).encode()
        a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pair.b.encode(text or "")
        if not text or any(b"".join(table[i] for i in ids) != own for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes))):
            a, b = [], []
        x, y = _spans(pair.a_size[a]), _spans(pair.b_size[b])
        links, j = [], 0
        for i, (s, e) in enumerate(x):
            while j < len(y) and y[j][1] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][0] < e:
                links.append((i, k, min(e, y[k][1]) - max(s, y[k][0])))
                k += 1
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in x} & {e for _, e in y}):
            first = i, j
            while i < len(x) and x[i][1] <= end:
                i += 1
            while j < len(y) and y[j][1] <= end:
                j += 1
            groups.append((a[first[0]:i], b[first[1]:j]))
        out.append((doc_id, a, b, links, groups))
    return out


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_alignment_against_plain_loops(odd, documents, monkeypatch, size):
    monkeypatch.setattr(token_links, "BUNDLE_BYTES", 4 * size)
    monkeypatch.setattr(token_links, "ALIGNED_BYTES", size)
    with open(A_FILE, "rb") as a, open(B_FILE, "rb") as b:
        pair = token_links.Pair(a.read(), b.read())
    for frame in (odd, documents):
        found = _aligned(_texts(frame), pair)
        counts = collections.Counter()
        for _, a, b, links, _ in found:
            counts.update({(a[i], b[j]) for i, j, _ in links})
        most = collections.Counter()
        for (x, _), n in counts.items():
            most[x] = max(most[x], n)
        want = []
        for doc_id, a, b, links, groups in found:
            pairs = [(a[i], b[j]) for i, j, _ in links]
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            want.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in pairs),
                         sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if a else "",
                         sum(len(x) * len(y) for x, y in groups)))
        got = token_links.digests(token_links.align(frame, A_FILE, B_FILE))
        assert _plain(got.collect()) == _plain(want)
        rows = token_links.links(frame, A_FILE, B_FILE).collect()
        assert _plain(rows) == _plain((d, i, j, a[i], b[j], s) for d, a, b, links, _ in found for i, j, s in links)


def test_alignment_of_nothing(odd):
    assert token_links.digests(token_links.align(odd.limit(0), A_FILE, B_FILE)).count() == 0
    assert token_links.links(odd.limit(0), A_FILE, B_FILE).count() == 0


# --- burst tries ---------------------------------------------------------------------------------

def _id(turn):
    role, text = turn
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def _trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, _id((role or "", text or "")), (role or "", text or "")))
    turns = {c: [t[-1] for t in sorted(x)] for c, x in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(m) - 1) * (len(path[-1][1].encode()) if path else 0)
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()]


def _conversations():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "é", "ab", "a much longer text"]))
            for c in range(200) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 420) for t in range(12)]  # many copies, one long chain
    rows += [(c, t, "user", f"same {t}" if t < 9 else f"{c}") for c in range(420, 450) for t in range(10)]
    rows += [(-7, 0, "a", "bc"), (-3, 0, "ab", "c"), (500, None, "x", "first"), (500, 0, "x", "second"),
             (500, 0, "x", "tie"), (500, 0, "x", "tie"), (None, 1, "x", "no id"), (10**15, 0, None, None),
             (600, 0, "u", "long " * 100_000)]
    rows += [(700, t, "u", f"{t}") for t in range(120)]  # one conversation of many turns
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 300, 5000, 1 << 20])
def test_trie_against_plain_dictionaries(spark, limit):
    rows = _conversations() if limit > 1 else [r for r in _conversations() if r[0] != 700]
    frame = spark.createDataFrame([(*r, *EXTRA_ROW) for r in rows],
                                  f"conv_id long, turn long, role string, text string, {EXTRA}")
    assert _plain(burst_trie.nodes(frame, limit).collect()) == _plain(_trie(rows))


def test_members_in_many_entries(spark, monkeypatch):
    monkeypatch.setattr(burst_trie, "PACKED_MEMBERS", 3)
    monkeypatch.setattr(burst_trie, "BLOCK_BITS", 1)
    rows = _conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    entries = burst_trie.rebuilt(burst_trie.turn_ids(frame))
    assert entries.agg({"n": "max"}).first()[0] <= 10
    assert _plain(burst_trie.trie(entries, 2000).collect()) == _plain(_trie(rows))


def test_shared_turns_burst_in_one_round(spark):
    """120 equal conversations of 12 turns, and 30 that part after 9: two rounds, not twelve."""
    rows = [(c, t, "u", f"same {t}" if t < 9 or c < 120 else f"{c}") for c in range(150) for t in range(12)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    _, heads = burst_trie.burst(burst_trie.rebuilt(burst_trie.turn_ids(frame)), 400)
    assert {(r.low, r.high) for r in heads.collect()} >= {(0, 9)}
    assert heads.count() < 12


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert burst_trie.nodes(none).count() == 0
    assert burst_trie.nodes(spark.createDataFrame([(None, 1, "a", "b")], none.schema)).count() == 0


# --- registered queries --------------------------------------------------------------------------

def test_registered_queries(spark, documents, library):
    with open(A_FILE, "rb") as a, open(B_FILE, "rb") as b:
        pair = token_links.Pair(a.read(), b.read())
    rows = _texts(documents)
    got = queries.op11_token_links(spark, SF_DIR)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert _plain((r.doc_id, r.n_a, r.n_links) for r in got.collect()) == _plain(
        (d, len(a), len(links)) for d, a, _, links, _ in _aligned(rows, pair))
    talks = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert _plain(queries.op12_burst_trie(spark, SF_DIR).collect()) == _plain(_trie([tuple(r) for r in talks.collect()]))
    got = queries.op13_byte_bpe(spark, SF_DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert _plain((r.doc_id, r.n_tokens) for r in got.collect()) == _plain(
        (i, len(library.encode_ordinary(t or ""))) for i, t in rows)
