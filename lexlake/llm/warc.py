"""WARC records in ZIP packages, written and read by ranges.

A package is a ZIP file with a stored member ``archive/records.warc.gz`` (every record a gzip member of its own) and a
stored member ``indexes/index.cdxj`` with the place of every record. A reader needs the ZIP's directory at the
file's end, the index, and the ranges of the records that it wants; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.storage import BROADCAST_ROWS, materialize, scratch_path

RECORDS, INDEX = "archive/records.warc.gz", "indexes/index.cdxj"
#: A package is closed beyond so many bytes of records.
PACKAGE_BYTES = 64 << 20
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
#: Bytes of neighbouring records that are fetched at once.
RANGE_BYTES = 4 << 20
#: Bytes of archives that a task reads back.
READ_BYTES = 4 << 20
_URN = "urn:lexlake:page:"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- ZIP directories ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def _zip64(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
    """Sizes and place from the ZIP64 extra field: it holds those that are all ones in the entry, in this order."""
    p = 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, p)
        if kind == 1:
            q, out = p + 4, []
            for value in (size, packed, header):
                if value == 0xFFFFFFFF:
                    (value,) = struct.unpack_from("<Q", extra, q)
                    q += 8
                out.append(value)
            return out[0], out[1], out[2]
        p += 4 + n
    return size, packed, header


def directory(source) -> list[Member]:
    """The members of a ZIP file, from its central directory; source: size() and read_at(n, offset)."""
    size = source.size()
    n = min(size, 22 + 0xFFFF)
    tail = source.read_at(n, size - n)
    p = tail.rfind(b"PK\x05\x06")
    while p >= 0 and (p + 22 > n or p + 22 + struct.unpack_from("<H", tail, p + 20)[0] > n):
        p = tail.rfind(b"PK\x05\x06", 0, p)
    if p < 0:
        raise ValueError("no end of a central directory: not a ZIP file, or cut short")
    _, _, _, count, length, start, _ = struct.unpack_from("<HHHHIIH", tail, p + 4)
    end = size - n + p
    if end >= 20 and (locator := source.read_at(20, end - 20))[:4] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", locator, 8)
        record = source.read_at(56, at)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator leads nowhere")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    data, out, p = source.read_at(length, start), [], 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory breaks off")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, p + 20)
        (header,) = struct.unpack_from("<I", data, p + 42)
        name = data[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, header = _zip64(data[p + 46 + n_name : p + 46 + n_name + n_extra], full, packed, header)
        out.append(Member(name, method, full, packed, header))
        p += 46 + n_name + n_extra + n_note
    return out


def stored_at(source, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed in the ZIP; only stored members can be read by range")
    head = source.read_at(30, member.header)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


# -- records -----------------------------------------------------------------------------------------------------


def _urn(page_id: int | None) -> str:
    return f"<{_URN}{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    number = (urn or "")[1 + len(_URN) : -1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. refers_to: the page whose response this one revisits; payload then is left out."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8").split("\r\n")[1:])}


def parse_record(packed: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (None for a revisit) of one record."""
    data = gzip.decompress(packed)
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    length = int(_fields(http)["content-length"])
    if not revisit and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload is not what its digest says")
    return {
        "page_id": _page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": _page_of(fields.get("warc-refers-to")), "payload": None if revisit else body,
    }


class PackageWriter:
    """Writes one package as records come."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.out, self.member = out, self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, packed: bytes, page_id: int | None, url: str | None) -> None:
        self.index.append(json.dumps({"page_id": page_id, "url": url, "offset": self.at, "length": len(packed)}))
        self.at += self.member.write(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.out.close()


# -- Spark -------------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to (null for a response).

    Of equal payloads of REVISIT_BYTES or more the largest key responds; its other rows revisit it. Digests that
    occur once need no partner, so only the others are joined back: broadcast while they are few, else by a shuffle
    join that adaptive execution splits at hot digests. Payloads themselves are shuffled only in that second case.
    """
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.withColumn("payload_bytes", F.octet_length(text).cast("long")).withColumn("payload_digest", F.sha1(text))
    many = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy(F.col("payload_digest").alias("__digest")).agg(F.max(key).alias("__response"), F.count(F.lit(1)).alias("__n"))
    many = materialize(many.filter("__n > 1").drop("__n"), "payloads")
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    joined = rows.join(many, (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") >= REVISIT_BYTES), "left")
    return joined.withColumn("refers_to", F.when(~F.col("__response").eqNullSafe(F.col(key)), F.col("__response"))).drop("__digest", "__response")


def write_packages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row to packages in the shared folder; returns the manifest (root, path, n_records).

    Null html has an empty payload, a null url no target, a null key no number. A task's packages bear names
    of their own, and the manifest, stored once, lists those of tasks that succeeded.
    """
    root = scratch_path(pages.sparkSession, "warc")
    rows = with_revisits(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")))
    rows = rows.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html"))).select("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to")
    schema = T.StructType([T.StructField("root", T.StringType()), T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        writer, path, done = None, "", []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.wacz"
                    writer = PackageWriter(store.open_output_stream(path))
                writer.add(record(row[0], row[1], (row[2] or "").encode(), *row[3:]), row[0], row[1])
                if writer.at > PACKAGE_BYTES:
                    writer.close()
                    done.append((path, len(writer.index)))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((path, len(writer.index)))
        yield pa.RecordBatch.from_pydict({"root": [root] * len(done), "path": [x for x, _ in done], "n_records": [n for _, n in done]}, schema=pa.schema([("root", pa.string()), ("path", pa.string()), ("n_records", pa.int64())]))

    return materialize(rows.mapInArrow(write, schema), "warc-manifest")


def list_records(packages: DataFrame) -> DataFrame:
    """(root, path, at, length) of every record of the packages (root, path), from their directories and indexes."""
    schema = T.StructType([T.StructField("root", T.StringType()), T.StructField("path", T.StringType()), T.StructField("at", T.LongType()), T.StructField("length", T.LongType())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, path in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(root)
                with store.open_input_file(path) as source:
                    members = {m.name: m for m in directory(source)}
                    records, index = stored_at(source, members[RECORDS]), members[INDEX]
                    lines = source.read_at(index.size, stored_at(source, index)).decode("utf-8").split("\n")
                rows = [(root, path, records + x["offset"], x["length"]) for x in map(json.loads, filter(None, lines))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=schema.names)

    return packages.select("root", "path").mapInArrow(listed, schema)


def read_records(places: DataFrame, payload: bool = False) -> DataFrame:
    """Records at (root, path, at, length): page_id, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Neighbouring places are fetched in one range of about RANGE_BYTES. A payload whose digest differs is an error.
    """
    fields = [("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType())]
    fields += [("payload", T.BinaryType())] * payload
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            while rows:
                root, path, first, _ = rows[0]
                n = next((k for k, x in enumerate(rows) if x[1] != path or x[2] + x[3] - first > max(RANGE_BYTES, rows[0][3])), len(rows))
                store, _ = fs.FileSystem.from_uri(root)
                with store.open_input_file(path) as source:
                    data = source.read_at(rows[n - 1][2] + rows[n - 1][3] - first, first)
                found = [parse_record(data[at - first : at - first + length]) for _, _, at, length in rows[:n]]
                yield pa.RecordBatch.from_arrays([pa.array([x[f] for x in found], arrow[t]) for f, t in fields], names=schema.names)
                rows = rows[n:]

    return places.select("root", "path", "at", "length").mapInArrow(read, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to packages and read every record back, in as many tasks as the archives' bytes ask for.

    Rows stay as they are, repeated ones too (each is a record of its own; of repeated keys with equal payloads all
    are responses). Null html is an empty payload, a null url no target, a null key no number; an empty table gives no
    records. Other columns, whatever their names, are not read.
    """
    manifest = write_packages(pages)
    places = materialize(list_records(manifest.repartition(max(1, min(manifest.count(), 10_000)), "path")), "warc-places")
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // READ_BYTES))
    near = F.floor(F.col("at") / RANGE_BYTES)
    return read_records(places.repartition(tasks, "path", near).sortWithinPartitions("path", "at"))
