"""WARC records in ZIP-packaged archives.

Each archive is a ZIP file whose members are stored, not compressed:
``archive/data.warc.gz`` (one gzip member for each record) and
``indexes/index.cdx`` (offset and length of each record). The reader finds the
end-of-directory record, its ZIP64 counterpart and the central directory,
locates the members, reads the index, and then reads records by byte ranges;
nothing is extracted.

An archive is written under a name of its own try and becomes part of the
collection only by its row in the manifest table, so tries that are lost or
repeated leave no trace in what is read.

Of records with equal payloads of at least ``revisit_from`` bytes the one with
the smallest page_id is a response, the others are revisits of it.

Defined results: a null payload is empty; rows with a null page_id, and rows
with the smallest page_id of their payload, are responses, also if repeated;
a null url has no target header; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A new archive is begun beyond so many bytes; so many bytes of records are one reading task.
ARCHIVE_BYTES, RANGE_BYTES = 128 << 20, 4 << 20
REVISIT_FROM = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the ZIP format: signatures and sizes of its records.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit has the payload's length and digest but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, payload and what the headers say of it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if len(urn) > len("<urn:page:>") else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None}


def members(read_at, size: int) -> dict[str, tuple[int, int]]:
    """Name to (offset of its bytes, length) of a ZIP file's stored members. read_at(offset, length) gives bytes."""
    tail = read_at(max(0, size - 65_557), min(size, 65_557))
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of the central directory")
    count, length, offset = struct.unpack_from("<H2L", tail, end + 10)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, offset):
        if tail[end - 20 : end - 16] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack_from("<Q", tail, end - 20 + 8)
        wide = read_at(at, 56)
        if wide[:4] != END64:
            raise ValueError("no ZIP64 end of the central directory")
        count, length, offset = struct.unpack_from("<3Q", wide, 32)
    directory, found, at = read_at(offset, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("bad entry in the central directory")
        method, packed, full, name_len, extra_len, note_len = struct.unpack_from("<10xH8x2L3H", directory, at)
        (start,) = struct.unpack_from("<L", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_len].decode()
        extra, k = directory[at + 46 + name_len : at + 46 + name_len + extra_len], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, k)
            if kind == 1:  # ZIP64: the values that do not fit above, in this order
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                start = values.pop(0) if start == 0xFFFFFFFF else start
            k += 4 + n
        if method:
            raise ValueError(f"{name} is not stored")
        local = read_at(start, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        found[name] = (start + 30 + sum(struct.unpack_from("<2H", local, 26)), packed)
        at += 46 + name_len + extra_len + note_len
    return found


def _open(path: str):
    """The file's size and a function that reads ranges of it."""
    fs, inner = pafs.FileSystem.from_uri(path)
    f = fs.open_input_file(inner)
    return f.size(), lambda offset, length: f.read_at(length, offset), f


class _Archive:
    """One archive while it is written."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, inner = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self.sink = fs.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.lines, self.size = [], 0

    def add(self, page_id, url, payload, refers_to) -> None:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = squeeze.compress(record(page_id, url, payload, refers_to)) + squeeze.flush()
        self.data.write(packed)
        self.lines.append(json.dumps({"page": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()
        self.sink.close()
        return self.path, len(self.lines), self.size


def revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """pages with refers_to: the smallest page_id of those with the same payload, else null."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("key"))
    keys = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "key")
    firsts = keys.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    later = keys.join(firsts, "key").where(F.col("page_id") > F.col("first")).select("page_id", "key", "first").distinct()
    return rows.join(later, ["page_id", "key"], "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_FROM) -> DataFrame:
    """Writes a record for each row of pages; returns the manifest: path, records and bytes of each archive."""
    common.tune(pages.sparkSession)

    def run(batches):
        archive, done = None, []
        for b in batches:
            for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive is None:
                    archive = _Archive(folder)
                archive.add(page_id, url, body.encode(), refers_to)
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        for path, n, size in done:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return common.stored(revisits(pages, least).mapInArrow(common.trimmed(run), "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the manifest's archives, read by ranges of about RANGE_BYTES."""
    common.tune(manifest.sparkSession)
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if payloads else "")
    names = [f.split()[0] for f in fields.split(", ")]

    def ranges(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                size, read_at, f = _open(path)
                found = members(read_at, size)
                data, _ = found[DATA]
                first, lengths = None, []
                rows = []
                for line in read_at(*found[INDEX]).decode().splitlines():
                    entry = json.loads(line)
                    if first is None:
                        first = entry["offset"]
                    lengths.append(entry["length"])
                    if entry["offset"] + entry["length"] - first >= RANGE_BYTES:
                        rows.append((path, data + first, lengths))
                        first, lengths = None, []
                if lengths:
                    rows.append((path, data + first, lengths))
                f.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["path", "start", "lengths"])

    def records(batches):
        for b in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, read_at, f = _open(path)
                block, at, out = read_at(start, sum(lengths)), 0, []
                f.close()
                for n in lengths:
                    out.append(parse_record(zlib.decompress(block[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k == "payload" else pa.string() if k in ("payload_digest", "record_type", "url") else pa.int64()) for k in names], names=names)

    tasks = manifest.select("path").mapInArrow(ranges, "path string, start long, lengths array<long>")
    return tasks.repartition(common.shuffle_parts(manifest.sparkSession)).mapInArrow(records, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(common.read_table(spark, sf_dir, "pages"), common.scratch(spark, "warc"))
    return read_archives(manifest)
