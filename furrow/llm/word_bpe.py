"""BPE encoding and decoding through a table of distinct words.

Words are the pieces between ASCII white space. Where the vocabulary's pre-tokenizer drops white
space, a text's ids are its words' ids in a row, so each distinct word is encoded once, by the
bucket that owns it, and its ids are joined back to every place where the word stands.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from furrow.llm import blocks

#: Distinct words a task holds before it sends them to their buckets.
HELD_WORDS = 600_000
#: Documents whose texts a task decodes at once.
DECODED_AT_ONCE = 256
#: Words given to the tokenizer at once.
ENCODED_AT_ONCE = 4096

_LOADED: dict[int, object] = {}


def _tokenizer(vocabulary: str):
    """One tokenizer per worker process and vocabulary."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED.clear()
        _LOADED[key] = tokenizer
    return _LOADED[key]


def _vocabulary(docs: DataFrame, path: str):
    """The vocabulary file (its size is fixed, about 3 MB) for every worker."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    check_by_words(text)
    return docs.sparkSession.sparkContext.broadcast(text)


#: ASCII white space, at which words part, and words that pre-tokenizers treat differently.
BLANKS = " \t\n\v\f\r"
PROBES = ("word", "It's", "x1,y2", "(3.50)", "Ä-ß", "\u4e2d\u6587", "<|endoftext|>", "e\u0301", "'", "--")
#: Parts of a normalizer that look at one word at most.
_WORDWISE = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}


def check_by_words(vocabulary: str) -> None:
    """Raises ValueError unless a text's ids are the ids of its words in a row, for any text.

    Added tokens may not contain white space or take it in, nothing may be put around a text, the
    normalizer may change words or white space but not across them, and the pre-tokenizer has to
    part and drop white space; the last is tried on every pair of PROBES around every blank."""
    from tokenizers import Tokenizer

    made = json.loads(vocabulary)
    for token in made.get("added_tokens") or []:
        if token["lstrip"] or token["rstrip"] or token["single_word"] or token["content"].split() != [token["content"]]:
            raise ValueError(f"added token {token['content']!r} reaches beyond a word")
    if made.get("post_processor") is not None:
        raise ValueError("the post-processor sees whole texts")
    normalizer = made.get("normalizer") or {"type": "Sequence", "normalizers": []}
    for part in normalizer.get("normalizers", [normalizer]):
        blanks_only = part["type"] == "Replace" and part["pattern"] == {"Regex": r"\s+"} and not part["content"].strip()
        if part["type"] not in _WORDWISE and not blanks_only:
            raise ValueError(f"the normalizer {part['type']} may change words by what stands around them")
    tokenizer = Tokenizer.from_str(vocabulary)

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    alone = {word: ids(word) for word in PROBES}
    texts = [(a + blank + b, alone[a] + alone[b]) for a in PROBES for b in PROBES for blank in BLANKS]
    texts += [(blank + a + blank * 2, alone[a]) for a in PROBES for blank in BLANKS]
    for text, want in texts:
        if ids(text) != want:
            raise ValueError(f"the pre-tokenizer keeps white space or joins words: {text!r}")


def check_joined_by_blanks(vocabulary: str) -> None:
    """Raises ValueError unless the vocabulary has no decoder: then pieces are joined by blanks."""
    if json.loads(vocabulary).get("decoder") is not None:
        raise ValueError("the vocabulary has a decoder of its own")


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns (doc_id, ids array<int>), one row per document; ValueError for a vocabulary that does
    not encode words one by one.

    A null text has the ids of an empty one: none. Repeated rows and documents without an id keep
    their own rows. Further columns are left out, whatever their names. Special tokens' strings
    in a text become their ids, as the library does it.
    """
    rows = blocks.texts(docs, doc_id, text)
    buckets = blocks.bucket_count(docs)
    vocabulary = _vocabulary(docs, path)

    def ask(batches):
        return blocks.notes(_distinct(batches, buckets))

    def answer(batches):
        return blocks.answers(_encoded(batches, _tokenizer(vocabulary.value)))

    notes = blocks.ask(rows, ask)
    return blocks.use(blocks.packed(rows), blocks.answer(notes, answer), _join_back,
                      "doc_id long, ids array<int>")


def _distinct(batches: blocks.Batches, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    held: dict[int, set[bytes]] = {}
    size = 0
    for block, _, _, text, _ in blocks.read(batches):
        words = held.setdefault(block, set())
        before = len(words)
        words.update((text or b"").split())
        size += len(words) - before
        if size > HELD_WORDS:
            yield from _sent(held, buckets)
            held, size = {}, 0
    yield from _sent(held, buckets)


def _sent(held: dict[int, set[bytes]], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    for block, words in held.items():
        own: dict[int, list[bytes]] = {}
        for word in words:
            own.setdefault(zlib.crc32(word) % buckets, []).append(word)
        for bucket, part in own.items():
            part.sort()
            yield bucket, block, b"\n".join(part)


def _encoded(batches: blocks.Batches, tokenizer) -> Iterator[tuple[int, bytes]]:
    """Answers each note by its words and their ids; a word is encoded once in its bucket."""
    for _, own in groupby(blocks.read(batches), key=lambda row: row[0]):
        known: dict[bytes, bytes] = {}
        for _, block, body in own:
            words = blocks.unpack(body).split(b"\n")
            new = [w for w in words if w not in known]
            for i in range(0, len(new), ENCODED_AT_ONCE):
                part = new[i:i + ENCODED_AT_ONCE]
                found = tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)
                known.update((w, b" ".join(b"%d" % x for x in e.ids)) for w, e in zip(part, found))
            yield block, b"\n".join(w + b"\t" + known[w] for w in words)


def _join_back(batches: blocks.Batches) -> blocks.Batches:
    types = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    for _, own in groupby(blocks.read(batches), key=lambda row: row[0]):
        place: dict[bytes, int] = {}
        ids_text: list[bytes] = []
        table = None
        doc_ids, ids, size = [], [], 0
        for _, kind, _, _, body in own:
            if kind == 0:
                for line in blocks.unpack(body).split(b"\n"):
                    word, _, found = line.partition(b"\t")
                    if word not in place:
                        place[word] = len(ids_text)
                        ids_text.append(found)
                continue
            if table is None:
                count = np.array([x.count(b" ") + 1 if x else 0 for x in ids_text], np.int64)
                flat = np.array(b" ".join(x for x in ids_text if x).split(), np.int32)
                table = np.cumsum(count) - count, count, flat
            for one, text in blocks.unpacked(body):
                found = _ids(text, place, *table)
                doc_ids.append(one)
                ids.append(found)
                size += len(found)
                if size > blocks.BATCH_BYTES // 4 or len(ids) >= 4096:
                    yield _id_batch(doc_ids, ids, types)
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield _id_batch(doc_ids, ids, types)


def _ids(text: bytes, place: dict[bytes, int], first, count, flat) -> np.ndarray:
    words = text.split()
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    number = count[at]
    ends = np.cumsum(number)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first[at] - ends + number, number)]


def _id_batch(doc_ids: list, ids: list[np.ndarray], types: pa.Schema) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], schema=types)


def decode(encoded: DataFrame, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """Adds `decoded`, the text of `ids`: each id is joined with its piece, in order.

    The id-to-piece table is the vocabulary, of fixed size, and goes to every worker; a vocabulary
    with a decoder is a ValueError. A null or
    empty list gives an empty text. Columns of `encoded` other than doc_id, ids and `keep` are left out.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        vocabulary = file.read()
    check_joined_by_blanks(vocabulary)
    tokenizer = Tokenizer.from_str(vocabulary)
    table = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def pieces(batches):
        piece = shared.value
        for batch in (whole.slice(i, DECODED_AT_ONCE) for whole in batches
                      for i in range(0, whole.num_rows, DECODED_AT_ONCE)):
            lists = batch.column(1)
            values = np.asarray(lists.values)
            ends = np.asarray(lists.offsets)
            texts = [" ".join(map(piece.__getitem__, values[a:b].tolist()))
                     for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, *batch.columns[2:], pa.array(texts, pa.string())],
                names=[*batch.schema.names, "decoded"])

    some = encoded.select(F.col("doc_id").cast("long"),
                          F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), *keep)
    return some.mapInArrow(pieces, StructType([*some.schema.fields, StructField("decoded", StringType())]))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
