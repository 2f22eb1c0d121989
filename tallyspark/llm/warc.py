"""WARC archives: written with an index, read back by byte ranges that the index names.

Writing: each task appends records to an archive of its own, every record a gzip member, and gives back a row per record
with archive, offset, length, URL and digest. Those rows, written as a table, are the index, and the only way into the archives:
a task that ran twice leaves an archive that no row names. The index comes first whatever is read later.

Of records with equal payloads one is a response; the others are revisits, which keep the payload's length and digest in
their headers and name the response by its record id. Equality is decided on SHA-256; the response of each payload is found by a partial
aggregate, written before the join so that a common payload's rows can be split.

Reading: index rows are ranged over tasks by archive and offset, sorted, and neighbouring ranges are read as one, up to ``MAX_READ``
bytes and over gaps of up to ``MAX_GAP``. A record that is longer is read alone. Every response is checked against its digest.

Cases: null html is an empty payload; a null URL has no target header and reads back null; control characters, white space
and non-ASCII of a URL are percent-encoded in the header; a null page_id is the smallest and reads back null; equal rows are records of their own, both responses
if theirs is the largest page_id. Extra columns are left out. An empty table gives an empty index and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, shared_dir, staged

MAX_READ, MAX_GAP = 8 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, page_id long, record_type string, url string, digest string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_BIAS = 1 << 63
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, salt: bytes) -> str:
    """URN of a custom (version 8) UUID: the page id in 64 bits, one bit for null, the rest from the hash of ``salt``."""
    p = 0 if page_id is None else page_id + _BIAS
    rest = int.from_bytes(hashlib.sha256(salt).digest()[:8], "big") >> 7
    n = p >> 16 << 80 | 8 << 76 | (p >> 4 & 0xFFF) << 64 | 2 << 62 | (p & 15) << 58 | (page_id is None) << 57 | rest
    return f"urn:uuid:{uuid.UUID(int=n)}"


def page_of(urn: str) -> int | None:
    """The page id in a record id."""
    n = uuid.UUID(urn).int
    return None if n >> 57 & 1 else (n >> 80 << 16 | (n >> 64 & 0xFFF) << 4 | n >> 58 & 15) - _BIAS


def _header_url(url: str) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._\"<>\\^`{|}")


def write_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers: int | None, date: str = DATE) -> tuple[bytes, str, str]:
    """A record's bytes (not compressed), its id and its payload digest."""
    digest = payload_digest(payload)
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = record_id(page_id, (url or "").encode())
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{own}>\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_url(url)}\r\n")
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{record_id(refers, b'')}>\r\n")
    else:
        body += payload
    head.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n")
    return "".join(head).encode() + body + b"\r\n\r\n", own, digest


def read_record(raw: bytes) -> tuple[int | None, str | None, str, int | None, int, str, bytes | None]:
    """The row of ``RECORDS`` in a record's bytes; a response whose payload isn't what its digest says is an error."""
    top = raw.index(b"\r\n\r\n") + 4
    head = {k.lower(): v.decode() for k, v in _FIELD.findall(raw[raw.index(b"\r\n") + 2 : top - 2])}
    block = raw[top : top + int(head[b"content-length"])]
    cut = block.index(b"\r\n\r\n") + 4
    http = {k.lower(): v for k, v in _FIELD.findall(block[block.index(b"\r\n") + 2 : cut - 2])}
    size, digest = int(http[b"content-length"]), head[b"warc-payload-digest"].removeprefix("sha1:")
    page, url, kind = page_of(head[b"warc-record-id"][1:-1]), head.get(b"warc-target-uri"), head[b"warc-type"]
    if kind == "revisit":
        return page, url, kind, page_of(head[b"warc-refers-to"][1:-1]), size, digest, None
    payload = block[cut:]
    if len(payload) != size or payload_digest(payload) != digest:
        raise ValueError(f"record of page {page}: payload differs from its digest")
    return page, url, kind, None, size, digest, payload


def _with_types(pages: DataFrame, least: int) -> DataFrame:
    """Pages as ``page_id``, ``url``, ``payload``, ``record_type`` and ``refers_to``."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    large = F.octet_length("payload") >= least
    held = rows.filter(large).groupBy("key").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(staged(held, "holders").hint("shuffle_hash"), "key", "left")
    again = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return rows.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("holder")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = DATE, level: int = 6) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as archives under ``folder``; the index of their records.

    ``folder`` is a URI that executors share, by default a new one in the session's shared folder. Payloads of fewer than ``least``
    bytes are all responses.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            for page, url, payload, kind, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "record_type", "refers_to")), strict=True):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rsplit("/", 1)[0])
                    out = store.open_output_stream(path, compression=None)
                raw, own, digest = write_record(page, url, payload, kind, refers, date)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = member.compress(raw) + member.flush()
                out.write(packed)
                rows.append((name, at, len(packed), own, page, kind, url, digest))
                at += len(packed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
        if out is not None:
            out.close()

    index = staged(_with_types(pages, least).mapInArrow(frugal(run), INDEX), "warc-index")
    index._folder = folder
    return index


_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_TYPES = [pa.int64() if c.endswith("long") else pa.string() for c in INDEX.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in RECORDS.split(", ")]


def coalesced(ranges: Iterator[tuple[str, int, int]], most: int = MAX_READ, gap: int = MAX_GAP) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Reads that cover sorted ranges (archive, offset, length): archive, begin, end and the ranges inside, from the begin."""
    held: tuple[str, int, int, list[tuple[int, int]]] | None = None
    for archive, at, n in ranges:
        if held and held[0] == archive and at <= held[2] + gap and max(at + n, held[2]) - held[1] <= most:
            held[3].append((at - held[1], n))
            held = (archive, held[1], max(held[2], at + n), held[3])
            continue
        if held:
            yield held
        held = (archive, at, at + n, [(0, n)])
    if held:
        yield held


def read_records(selected: DataFrame, payloads: bool = True, most: int = MAX_READ, gap: int = MAX_GAP) -> DataFrame:
    """The records of ``selected`` index rows (``archive``, ``offset``, ``length``), as ``RECORDS``; no payload column unless asked for."""
    names = [c.split()[0] for c in RECORDS.split(", ")][: None if payloads else -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
        name, source = "", None
        for archive, begin, end, inside in coalesced(ranges, most, gap):
            if archive != name:
                store, path = fs.FileSystem.from_uri(archive)
                name, source = archive, store.open_input_file(path)
            block = source.read_at(end - begin, begin)
            rows, size = [], 0
            for at, n in inside:
                rows.append(read_record(zlib.decompress(block[at : at + n], 31))[: len(names)])
                size += rows[-1][4]
                if size > most:  # what is compressed may be much larger here
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=False)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=False)], names=names)

    sorted_ranges = selected.select("archive", "offset", "length").repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return sorted_ranges.mapInArrow(frugal(run), RECORDS if payloads else RECORDS.rsplit(", ", 1)[0])


def index_archives(archives: DataFrame) -> DataFrame:
    """The index of archives that came without one (``archive``: URIs of files with a gzip member a record); one task reads a file from end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("archive").to_pylist():
                for rows in _members(name):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return archives.select("archive").distinct().mapInArrow(frugal(run), INDEX)


def _members(name: str, step: int = 1 << 20, rows_a_batch: int = 1000) -> Iterator[list[tuple]]:
    """Index rows of a file, a list at a time; holds one record."""
    store, path = fs.FileSystem.from_uri(name)
    rows, begin, taken = [], 0, 0
    with store.open_input_stream(path, compression=None) as source:
        rest = source.read(step)
        while rest:
            member, parts = zlib.decompressobj(31), []
            while rest and not member.eof:
                parts.append(member.decompress(rest))
                taken += len(rest) - len(member.unused_data)
                rest = member.unused_data if member.eof else source.read(step)
            if not member.eof:
                raise ValueError(f"{name}: record at {begin} is cut off")
            raw = b"".join(parts)
            page, url, kind, _, _, digest, _ = read_record(raw)
            own = raw[raw.index(b"WARC-Record-ID: <") + 17 :].split(b">", 1)[0].decode()
            rows.append((name, begin, taken - begin, own, page, kind, url, digest))
            begin = taken
            rest = rest or source.read(step)
            if len(rows) == rows_a_batch:
                yield rows
                rows = []
    if rows:
        yield rows


def removed(index: DataFrame) -> None:
    """Delete the archives of an index that nothing will read any more."""
    store, path = fs.FileSystem.from_uri(index._folder)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)
