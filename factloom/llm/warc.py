"""WARC records in ZIP packages, written and range-read without extraction.

A package holds two stored members: ``archive/data.warc`` with the records and
``indexes/index.cdx`` with a line per record (offset, length, page id).  The
reader finds the end record, follows a ZIP64 locator where there is one, parses
the central directory, and then reads byte ranges only: the index, and each
record by its offset.

Packages go to the folder that all executors share, through the filesystem that
its URI names.  A task writes under a name of its own and reports it; a lost
task's leftovers are never listed, so retries are safe.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, scratch_path, stored

DATA, INDEX = "archive/data.warc", "indexes/index.cdx"
#: Payloads from this size on are written once; payload bytes after which a task starts another package.
LEAST_REVISIT, PACKAGE_BYTES = 1000, 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Signatures and fixed parts of the ZIP format (APPNOTE 4.3, fixed values).
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# Reading packages


def directory(file, size: int) -> list[Member]:
    """The central directory's members, by reading the end of the package and the directory."""
    tail_at = max(0, size - (22 + 65535))
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, begin = struct.unpack_from("<HLL", tail, at + 10)
    locator_at = tail_at + at - 20
    locator = file.read_at(20, locator_at) if locator_at >= 0 else b""
    if locator[:4] == LOCATOR64 and (count == 0xFFFF or 0xFFFFFFFF in (length, begin)):
        end64 = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, begin = struct.unpack_from("<QQQ", end64, 32)
    entries = file.read_at(length, begin)
    members, at = [], 0
    for _ in range(count):
        if entries[at : at + 4] != CENTRAL:
            raise ValueError("central directory entry expected")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<LLHHH", entries, at + 20)
        header = struct.unpack_from("<L", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = entries[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: only those that overflow, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + n
        members.append(Member(name, method, full, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is not stored, so its parts can't be read by range")
    head = file.read_at(30, member.header)
    if head[:4] != LOCAL:
        raise ValueError("local header expected")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def record_ranges(file, size: int) -> Iterator[tuple[int, int]]:
    """(position, length) of each record in a package, from its index."""
    members = {m.name: m for m in directory(file, size)}
    base = data_start(file, members[DATA])
    index = members[INDEX]
    at, end, rest = data_start(file, index), data_start(file, index) + index.size, b""
    while at < end:  # the index is read piecewise
        piece = file.read_at(min(1 << 20, end - at), at)
        at += len(piece)
        *lines, rest = (rest + piece).split(b"\n")
        for line in lines:
            offset, length, _ = line.split(b" ", 2)
            yield base + int(offset), int(length)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, lower-cased names, and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("WARC record expected")
    headers = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    return headers, rest[: int(headers["content-length"])]


# Writing packages


def make_record(page_id: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    said = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{original}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(said).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_packages(rows: Iterable[tuple], folder: str, package_bytes: int) -> Iterator[tuple[str, int, int]]:
    """Packages of (page_id, url, payload, original, revisit) rows in ``folder``; yields path, records, bytes of data."""
    fs, base = filesystem(folder)
    rows = iter(rows)
    row = next(rows, None)
    while row is not None:
        path = f"{base}/{uuid.uuid4().hex}.wacz"
        index, at = [], 0
        with fs.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            with package.open(DATA, "w", force_zip64=True) as data:
                while row is not None and at < package_bytes:
                    record = make_record(*row)
                    data.write(record)
                    index.append(f"{at} {len(record)} {'-' if row[0] is None else row[0]}\n")
                    at += len(record)
                    row = next(rows, None)
            package.writestr(INDEX, "".join(index))
        yield path, len(index), at


def archive(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages``; returns the manifest: path, records, bytes.

    Rows meet their group's decision in a join on the payload's digest; it is a
    left join with one row a digest on the right, which Spark can split when a
    payload is very frequent.
    """
    spark = pages.sparkSession
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    large = F.octet_length(html) >= least
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.when(large, F.sha2(html, 256)).alias("sha"))
    groups = rows.where(F.col("sha").isNotNull()).groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    decided = rows.join(stored(groups, "payload-groups"), "sha", "left").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"), "original", revisit.alias("revisit"))

    def write(batches):
        def each():
            for b in batches:
                yield from zip(*(b[k] for k in ("page_id", "url", "payload", "original", "revisit")), strict=True)

        for path, records, size in write_packages(each(), folder, package_bytes):
            yield {"path": [path], "records": [records], "bytes": [size]}

    return stored(mapped(decided, write, "path string, records long, bytes long"), "warc-manifest")


def read_archive(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the packages listed: page_id, url, payload (null in revisits), payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and size are taken from the payload read and must agree
    with its headers.
    """

    def read(batches):
        fs, _ = filesystem(folder)
        for b in batches:
            for path in b["path"]:
                out = {k: [] for k in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                held = 0
                with fs.open_input_file(path) as file:
                    for at, length in record_ranges(file, file.size()):
                        headers, block = parse_record(file.read_at(length, at))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length:")[2])
                        digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                        revisit = headers["warc-type"] == "revisit"
                        if not revisit and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{path} at {at}: payload and headers differ")
                        own, refers = (headers.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to"))
                        for k, v in (("page_id", int(own) if own else None), ("url", headers["warc-target-uri"]), ("payload", None if revisit else payload), ("payload_bytes", size), ("payload_digest", digest), ("record_type", headers["warc-type"]), ("refers_to", int(refers) if refers else None)):
                            out[k].append(v)
                        held += length
                        if held > 8 << 20:
                            yield out
                            out, held = {k: [] for k in out}, 0
                yield out

    packages = max(1, min(manifest.count(), 20_000))
    return mapped(manifest.select("path").repartition(packages), read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the pages and reads the packages back: one row per row of ``pages``.

    Equal payloads of at least ``least`` bytes are stored once, with the largest
    page_id; the others revisit it.  Null html is an empty payload; smaller ones
    are all responses.  Rows that repeat the largest page_id are responses each;
    a null page_id revisits its group's largest, or is a response where the
    group has only nulls.  A null url is written empty.  No pages, no rows.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    return read_archive(spark, archive(pages, folder, least, package_bytes), folder)


ORACLE_SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
kept AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS original FROM rows)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM kept
"""
