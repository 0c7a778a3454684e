"""WARC archives: a writer with one gzip member per record and a sequential reader.

The reader inflates member by member with an incremental zlib object over fixed-size reads, takes the header up to
the blank line and then exactly Content-Length bytes, and verifies block and payload digests. Archives go to the
shared folder under names no other attempt uses; only those that a successful task reports are read, so that a lost
executor leaves at most unread files.

Defined cases: a null html is an empty payload; a null url becomes a URN of the page; a null page_id is carried
through (a payload whose ids are all null is a response); rows that repeat an id are records of their own, each
judged by its own payload; no pages give no archives and no rows; columns beside page_id, url and html take no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graintide.session import fresh_path, shuffle_partitions, small_batches, staged

CHUNK = 1 << 16
ROLL_BYTES = 64 << 20
#: Revisit rows up to which they are broadcast (48 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:graintide:page:"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_stream(path)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """The uncompressed record: a response with its payload, or a revisit that has the HTTP header alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = " ".join((url or f"{PAGE_URN}{page_id}").split())
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{PAGE_URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        head += [("WARC-Refers-To", f"<{PAGE_URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated content of each gzip member, one at a time."""
    pending, inflate, parts = b"", zlib.decompressobj(31), []
    while True:
        if not pending:
            pending = stream.read(CHUNK)
            if not pending:
                break
        parts.append(inflate.decompress(pending))
        pending = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive ends within a gzip member")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block, framed by Content-Length."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        raise ValueError("not a WARC record")
    lines = raw[:end].decode("utf-8").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(head["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't frame the block")
    return head, block


def _page_of(value: str) -> int | None:
    digits = value.strip("<>").removeprefix(PAGE_URN)
    return int(digits) if digits else None


def read_record(raw: bytes) -> dict:
    """What a record says, with its digests verified."""
    head, block = parse_record(raw)
    if head["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise ValueError(f"block digest differs in {head['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.lower().split(b": ", 1) for line in http.split(b"\r\n")[1:])
    revisit = head["warc-type"] == "revisit"
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (digest != sha1_base32(payload) or int(fields[b"content-length"]) != len(payload)):
        raise ValueError(f"payload digest differs in {head['warc-record-id']}")
    return {
        "page_id": _page_of(head["warc-record-id"]), "url": head["warc-target-uri"], "record_type": head["warc-type"],
        "refers_to": _page_of(head["warc-refers-to"]) if revisit else None, "payload_bytes": int(fields[b"content-length"]),
        "payload_digest": digest, "payload": None if revisit else payload,
    }


def payload():
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def payload_digest():
    """SHA-256 of the payload as 32 bytes."""
    return F.unhex(F.sha2(payload(), 256))


def find_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Distinct (page_id, digest, refers_to) of pages whose payload of at least min_bytes a page with a smaller id has too."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), payload_digest().alias("digest"), F.octet_length(payload()).alias("size")).where(F.col("size") >= min_bytes)
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return rows.select("page_id", "digest").join(groups, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write every page as a record; returns (archive, records) of the archives written."""
    spark = pages.sparkSession
    small_batches(spark, 256)
    revisits = staged(find_revisits(pages, min_bytes), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", payload_digest().alias("digest"))
    side = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits.hint("merge")
    rows = rows.join(side, ["page_id", "digest"], "left").select("page_id", F.col("url").cast("string").alias("url"), "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, size, n = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    uri, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(uri, "w")
                member = gzip_member(make_record(page_id, url, (html or "").encode("utf-8"), refers_to), level)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["archive", "records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["archive", "records"])

    return staged(rows.mapInArrow(write, "archive string, records long"), "archives")


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives, read from front to back; a damaged record fails the job."""
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")] + ["payload"] * with_payload
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def flush(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                with _open(uri, "r") as stream:
                    for raw in members(stream):
                        rows.append(read_record(raw))
                        size += len(raw) if with_payload else 200
                        if size >= 4 << 20:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    n = shuffle_partitions(archives.sparkSession)
    schema = READ_SCHEMA + ", payload binary" * with_payload
    return archives.select("archive").repartition(n, "archive").mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), with_payload)
