"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then a frame per record."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0xEC30A437
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 16 << 10
#: Bytes of an archive's first payloads from which its dictionary is made.
SAMPLE_BYTES = 512 << 10
RECORDS = ("path string, offset long, warc_type string, record_id string, target_uri string, "
           "date string, refers_to string, payload_digest string, payload_bytes long, "
           "payload binary, error string")
_RECORD_TYPES = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()),
    ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
    ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("payload", pa.binary()), ("error", pa.string())])


# --- writing -------------------------------------------------------------------------------------

def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                   html: str = "html", least_revisit: int = 0,
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives (path string, content binary) with one record per row of `pages`.

    Payload: the html in UTF-8, empty if null. Of equal payloads with `least_revisit` bytes or more
    the one with the smallest id is a response, the others revisit it; rows that repeat the
    smallest id are responses too, as are payloads that only rows without an id have. A null url
    gives no target. Other columns are left out. An empty table gives no archive.
    """
    rows = pages.select(pages[page_id].cast("long").alias("id"),
                        pages[url].cast("string").alias("url"),
                        F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    first = rows.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    again = first.where("n > 1").drop("n")
    long_enough = F.octet_length("html") >= least_revisit
    linked = rows.join(again, "sha", "left").select(
        "id", "url", "html",
        F.when(long_enough & ~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("first"))

    def pack(batches):
        return _archives(batches, date)

    return linked.mapInArrow(pack, "path string, content binary")


def _archives(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    held, size, first_id = [], 0, None
    for batch in batches:
        for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
            payload = html.encode()
            held.append((page_id, url, payload, first))
            size += len(payload) + 512
            if size >= ARCHIVE_BYTES:
                yield _archive(held, date)
                held, size = [], 0
    if held:
        yield _archive(held, date)


def _archive(pages: list[tuple], date: str) -> pa.RecordBatch:
    records = [_record(*page, date) for page in pages]
    dictionary = _dictionary(records)
    head = b""
    if dictionary is not None:
        packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
        head = struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed
    writer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    content = head + b"".join(writer.compress(r) for r in records)
    name = f"pages-{hashlib.sha1(content).hexdigest()[:20]}.warc.zst"
    return pa.RecordBatch.from_arrays(
        [pa.array([name], pa.string()), pa.array([content], pa.binary())],
        names=["path", "content"])


def _dictionary(records: list[bytes]):
    """Trained from the first records; none where they are too few or too alike to train from."""
    samples, size = [], 0
    for record in records:
        samples.append(record[:DICTIONARY_BYTES])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3, k=64, d=8)
    except zstandard.ZstdError:
        return None


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def _record(page_id: int | None, url: str | None, payload: bytes, first: int | None,
            date: str) -> bytes:
    kind = "response" if first is None else "revisit"
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + b"\r\n\r\n")
    block = http + payload if first is None else http
    headers = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
               f"WARC-Payload-Digest: sha1:{_digest(payload)}",
               "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        headers.append(f"WARC-Target-URI: {_one_line(url)}")
    if first is not None:
        headers += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(["WARC/1.1", *headers]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# --- reading -------------------------------------------------------------------------------------

def load_archives(spark, path: str) -> DataFrame:
    """Archive files under `path` as (path, content), read by Spark."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per frame of the archives (path string, content binary); columns as in RECORDS.

    `error` is null for a sound record, else it says what is wrong with the frame, the headers, a
    length or the digest; such rows are kept. After a frame whose end cannot be found the rest of
    its archive is one row with an error. A revisit has no payload; its payload_bytes is the
    length that the HTTP header states. A null or empty content gives no row.
    """
    return archives.select("path", "content").mapInArrow(_read, RECORDS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns)):
            for row in _records(content or b""):
                rows.append((path, *row))
                size += 512 + len(row[-2] or b"")
                if size > 8 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), _RECORD_TYPES.types)]
    return pa.RecordBatch.from_arrays(arrays, schema=_RECORD_TYPES)


def _records(data: bytes) -> Iterator[tuple]:
    at, dictionary = 0, None
    try:
        dictionary, at = leading_dictionary(data)
    except (ValueError, zstandard.ZstdError) as fault:
        yield _bad(0, f"dictionary: {fault}")
        return
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        try:
            end = frame_end(data, at)
        except ValueError as fault:
            yield _bad(at, f"frame: {fault}")
            return
        if end is None:  # a later skippable frame holds no record
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        try:
            yield (at, *parse_record(_inflate(reader, data[at:end])))
        except (ValueError, zstandard.ZstdError) as fault:
            yield _bad(at, str(fault))
        at = end


def _bad(at: int, fault: str) -> tuple:
    return at, None, None, None, None, None, None, None, None, fault


def _inflate(reader, frame: bytes) -> bytes:
    if zstandard.frame_content_size(frame) >= 0:
        return reader.decompress(frame)
    return reader.decompressobj().decompress(frame)


def leading_dictionary(data: bytes):
    """The dictionary of the skippable frame at the start, and the place behind it."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    raw = data[8:8 + size]
    if len(raw) < size or size < 4:
        raise ValueError("skippable frame is cut short")
    if struct.unpack_from("<I", raw)[0] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if len(raw) < 4 or struct.unpack_from("<I", raw)[0] != DICTIONARY_MAGIC:
        raise ValueError("no Zstandard dictionary in the skippable frame")
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT), 8 + size


def frame_end(data: bytes, at: int) -> int | None:
    """End of the frame at `at`, by its block headers; None for a skippable frame."""
    if len(data) - at < 8:
        raise ValueError("cut short")
    magic = struct.unpack_from("<I", data, at)[0]
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        if at + 8 + struct.unpack_from("<I", data, at + 4)[0] > len(data):
            raise ValueError("cut short")
        return None
    if magic != FRAME_MAGIC:
        raise ValueError("no Zstandard frame")
    checksum = data[at + 4] & 4
    try:
        place = at + zstandard.frame_header_size(data[at:at + 18])
    except zstandard.ZstdError as fault:
        raise ValueError(str(fault)) from fault
    last = False
    while not last:
        if place + 3 > len(data):
            raise ValueError("cut short")
        header = int.from_bytes(data[place:place + 3], "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        place += 3 + (1 if kind == 1 else size)  # kind 1 repeats one byte
    place += 4 if checksum else 0
    if place > len(data):
        raise ValueError("cut short")
    return place


def parse_record(record: bytes) -> tuple:
    """Fields of RECORDS behind offset; raises ValueError where the record breaks the format."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in VERSIONS:
        raise ValueError("no WARC header")
    headers = _headers(lines[1:])
    missing = [name for name in MANDATORY if name not in headers]
    if missing:
        raise ValueError("header missing: " + ", ".join(missing))
    if not headers["content-length"].isdecimal():
        raise ValueError("content-length is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {max(0, len(rest) - 4)} bytes, content-length {length}")
    kind = headers["warc-type"]
    payload, size = rest[:length], length
    digest = headers.get("warc-payload-digest")
    if headers.get("content-type", "").startswith("application/http"):
        http, found, payload = payload.partition(b"\r\n\r\n")
        if not found:
            raise ValueError("no HTTP header")
        stated = _headers(http.split(b"\r\n")[1:]).get("content-length")
        size = int(stated) if stated and stated.isdecimal() else len(payload)
        if kind != "revisit" and size != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes, HTTP content-length {size}")
    if kind == "revisit":
        if "warc-refers-to" not in headers:
            raise ValueError("revisit refers to nothing")
        payload = None
    elif digest and digest.startswith("sha1:") and digest[5:] != _digest(payload):
        raise ValueError("payload digest differs")
    return (kind, headers["warc-record-id"], headers.get("warc-target-uri"), headers["warc-date"],
            headers.get("warc-refers-to"), digest, size, payload, None)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, found, value = line.partition(b":")
        if not found:
            raise ValueError("header without a colon")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error) of read records."""
    number = r"^<urn:page:(-?\d+)>$"

    def page(name: str):
        return F.regexp_extract(name, number, 1).try_cast("long")

    return records.select(
        page("record_id").alias("page_id"), "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"), "error")
