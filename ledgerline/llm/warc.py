"""WARC records in ZIP-packaged archives: written by tasks, read back by ranges without extraction.

An archive is a ZIP file with two stored (uncompressed) members, archive/data.warc and indexes/index.cdxj. The reader
parses the end record, the ZIP64 locator and end record where there are any, and the central directory with its ZIP64
extra fields; it finds each stored member's data behind its local header, reads the index (a line of JSON for each record,
with offset and length inside the data member), and then only the bytes of records, in runs of neighbours.
"""

from __future__ import annotations

import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import utf8
from .files import file_size, read_range, write_once
from .shared import fresh_path, only, written

DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
#: Payloads from so many bytes on are stored once.
REVISIT_BYTES = 1000
#: An archive is closed after so many bytes of records (its index is a small part of that and is read as a whole); records
#: are fetched in runs of neighbours of about RUN_BYTES.
ARCHIVE_BYTES, RUN_BYTES = 64 << 20, 4 << 20
#: Up to so many payloads that occur twice or more (about 15 MB) their table goes to every task; beyond, pages are shuffled.
BROADCAST_COPIES = 200_000
#: Fixed values of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


@dataclass(frozen=True)
class Member:
    name: str
    offset: int  # of its data
    size: int
    stored: bool


def _central_directory(path: str) -> tuple[bytes, int]:
    size = file_size(path)
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    tail = read_range(path, tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError(f"{path} is no ZIP archive")
    count, length, offset = struct.unpack_from("<10xHII", tail, end)
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64:
        at = struct.unpack_from("<8xQ", tail, end - 20)[0]
        count, length, offset = struct.unpack_from("<32xQQQ", read_range(path, at, 56), 0)
    return read_range(path, offset, length), count


def zip_members(path: str) -> list[Member]:
    """The members in the central directory, where each one's data begins, without reading the data."""
    directory, count = _central_directory(path)
    out, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError(f"{path}: bad central directory")
        method, packed, full, n, e, c, header = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + n].decode()
        extra = directory[at + 46 + n : at + 46 + n + e]
        #: ZIP64: eight bytes for each of these that is full of ones, in this order.
        while len(extra) >= 4:
            tag, length = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + length :]
        local = read_range(path, header, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"{path}: bad local header of {name}")
        n_local, e_local = struct.unpack_from("<26xHH", local)
        out.append(Member(name, header + 30 + n_local + e_local, packed, method == 0))
        at += 46 + n + e + c
    return out


def record_bytes(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit of the response of refers_to without it."""
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + b"\r\n\r\n"
    body += payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c if c.isprintable() and not c.isspace() else f"%{ord(c):02X}" for c in url or "urn:none"),
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload): the WARC headers, names lowered, and what follows the HTTP header of the content."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def _packed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        index: list[str] = []
        total = 0

        def close() -> pa.RecordBatch:
            def write(out) -> None:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                    for name, parts in ((DATA, records), (INDEX, ["\n".join(index).encode()])):
                        with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
                            for p in parts:
                                member.write(p)

            path = write_once(folder, ".wacz", write)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64())], names=["path", "records"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "url", "digest", "size", "revisit")]
            for page, url, digest, size, refers, html in zip(*columns, utf8(batch, "html"), strict=True):
                record = record_bytes(page, url, html or b"", size, digest, refers)
                index.append(json.dumps({"id": page, "offset": total, "length": len(record), "digest": digest}))
                records.append(record)
                total += len(record)
                if total >= ARCHIVE_BYTES:
                    yield close()
                    records, index, total = [], [], 0
        if index:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each page into archives in folder; (path, records) of each archive.

    Of records with equal payloads (null: empty) of REVISIT_BYTES or more, the one with the largest id is the response and
    the others are revisits without a payload; rows that repeat the largest id are responses too. Null ids never are what
    a revisit refers to, unless all are null: then each is a response. The table of archives is written before it is read, so no archive is written twice.
    """
    payload = F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8")
    df = pages.select(pages[id].cast("long").alias("id"), pages[url].alias("url"), pages[html].alias("html"),
                      F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    largest = df.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("id").alias("largest"), F.count("*").alias("c"))
    largest = written(largest.filter("c > 1").select(F.col("digest").alias("d"), F.col("size").alias("s"), "largest"), "warc-copies")
    df = df.join(F.broadcast(largest) if largest.count() <= BROADCAST_COPIES else largest, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisit = F.when(~F.col("id").eqNullSafe(F.col("largest")), F.col("largest"))
    html_ = F.when(revisit.isNull(), F.col("html"))
    df = df.select("id", "url", html_.alias("html"), "digest", "size", revisit.alias("revisit"))
    return written(df.mapInArrow(_packed(folder), "path string, records long"), "archives")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each archive: runs of neighbouring records, each of at most RUN_BYTES or one record."""
    for batch in batches:
        for path in batch["path"]:
            members = {m.name: m for m in zip_members(path)}
            data, index = members[DATA], members[INDEX]
            if not (data.stored and index.stored):
                raise ValueError(f"{path}: members must be stored")
            entries = [json.loads(x) for x in read_range(path, index.offset, index.size).decode().split("\n") if x]
            out, lengths, start = [], [], 0
            for e in entries:
                if lengths and e["offset"] + e["length"] - start > RUN_BYTES:
                    out.append((path, data.offset + start, lengths))
                    lengths, start = [], e["offset"]
                lengths.append(e["length"])
            if lengths:
                out.append((path, data.offset + start, lengths))
            yield pd.DataFrame(out, columns=["path", "start", "lengths"])


RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths")), strict=True):
            data, rows, at = read_range(path, start, sum(lengths)), [], 0
            for n in lengths:
                headers, payload = parse_record(data[at : at + n])
                page, refers = headers["warc-page-id"], headers.get("warc-refers-to")
                rows.append((
                    int(page) if page else None, headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"),
                    int(headers["warc-payload-length"]), int(refers[len("<urn:page:") : -1]) if refers else None,
                    headers["warc-target-uri"], payload,
                ))
                at += n
            columns = zip(*rows, strict=True) if rows else [()] * len(RECORD)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORD, strict=True)], schema=RECORD)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (path): page_id, record_type, payload_digest, payload_bytes, refers_to, url, payload.

    Archives are spread over tasks for their directories and indexes, then runs of records for their bytes.
    """
    tasks = max(1, archives.sparkSession.sparkContext.defaultParallelism * 4)
    runs = archives.select("path").repartition(tasks).mapInPandas(_runs, "path string, start long, lengths array<long>")
    return runs.repartition(tasks).mapInArrow(
        _records, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, payload binary")


def warc_report(pages: DataFrame) -> DataFrame:
    """Writes all pages into archives, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, checked.

    checked: the bytes of a response read back have its digest and length. Null ids, URLs and payloads are written as such
    (an empty payload is a response of 0 bytes). Extra columns are dropped; an empty table gives no rows.
    """
    pages = only(pages, "page_id", "url", "html")
    records = read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc")))
    whole = (F.sha1("payload") == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    checked = F.when(F.col("record_type") == "response", whole).otherwise(F.octet_length("payload") == 0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", checked.alias("checked"))
