"""WARC records inside ZIP packages: a writer, and a reader that never unpacks.

An archive holds three stored (uncompressed) members: ``archive/data.warc.gz`` with one
gzip member per record, ``indexes/index.cdxj`` with one line per record (its offset and length in
the first), and ``datapackage.json``. The reader parses the end record and the
central directory, with their ZIP64 forms, finds the stored members' data behind their
local headers, reads the index, and then fetches records by byte ranges. Archives
are written by tasks, one each, into the folder that the cluster shares, under a name
that depends on the partition only; a repeated task replaces its archive as a whole. Index
ranges, not archives, are what reading tasks get, so a large archive is read by many.

Equal payloads: the smallest id of each digest is found by partial aggregation, and
joined to the rows whose digest occurs more than once.

Nulls and edge cases: a null html is an empty payload and a null url an absent header. A row
without an id is a revisit if a row with an id has its payload, else a response. Rows that
repeat the smallest id of a payload are all responses. An empty table writes no
archive and reads none. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, shared_dir, written

LEAST = 100
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RANGE_BYTES, RANGE_RECORDS = 4 << 20, 4096


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; Hadoop writes local ones with a single slash."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


# Records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record. A revisit holds the digest and the length of its payload, not the payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's id, url, type, what it refers to, payload (None for a revisit), payload length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: int(x[10:-1]) if len(x or "") > 11 else None
    out = {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To"))}
    if out["type"] == "revisit":
        return out | {"payload": None, "payload_bytes": length, "payload_digest": digest}
    if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {out['page_id']}: its payload is damaged")
    return out | {"payload": payload, "payload_bytes": length, "payload_digest": digest}


# ZIP packages, read by ranges


def directory(read_at, size: int) -> dict[str, tuple[int, int, int]]:
    """Members by name: (offset of the local header, stored size, method), from the central directory or its ZIP64 form.

    ``read_at(offset, n)`` gives bytes of the archive.
    """
    tail_at = max(0, size - 65557)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack("<H2I", tail[at + 10 : at + 20])
    locator = at - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", tail[locator + 8 : locator + 16])
        record64 = read_at(end64, 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("damaged ZIP64 end record")
        entries, length, start = struct.unpack("<Q", record64[32:40])[0], *struct.unpack("<2Q", record64[40:56])
    raw, at, found = read_at(start, length), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, plain = (*struct.unpack("<H", raw[at + 10 : at + 12]), *struct.unpack("<2I", raw[at + 20 : at + 28]))
        n_name, n_extra, n_note = struct.unpack("<3H", raw[at + 28 : at + 34])
        (offset,) = struct.unpack("<I", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra, e = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack("<2H", extra[e : e + 4])
            if kind == 1:  # holds, in this order, only the fields that are all ones above
                wide, w = extra[e + 4 : e + 4 + n], 0
                if plain == 0xFFFFFFFF:
                    w += 8
                if packed == 0xFFFFFFFF:
                    packed, w = struct.unpack("<Q", wide[w : w + 8])[0], w + 8
                if offset == 0xFFFFFFFF:
                    offset = struct.unpack("<Q", wide[w : w + 8])[0]
            e += 4 + n
        found[name] = (offset, packed, method)
        at += 46 + n_name + n_extra + n_note
    return found


def member_data(read_at, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes begin in the archive, and how many there are."""
    offset, size, method = entry
    if method:
        raise ValueError("the member is not stored")
    local = read_at(offset, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    n_name, n_extra = struct.unpack("<2H", local[26:30])
    return offset + 30 + n_name + n_extra, size


# Spark


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, root = place(folder)
    context = TaskContext.get()
    name = f"{root}/part-{context.partitionId():06d}.zip"
    draft, lines, at, n = f"{name}.{context.taskAttemptId()}", [], 0, 0
    out = zip_ = member = None
    for batch in batches:
        for k in range(len(batch)):  # one row's page at a time, not a batch's
            row = {field: column[k].as_py() for field, column in zip(batch.schema.names, batch.columns, strict=True)}
            if out is None:
                out = system.open_output_stream(draft)
                zip_ = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                member = zip_.open(zipfile.ZipInfo(DATA, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
            packer = zlib.compressobj(4, zlib.DEFLATED, 31)
            packed = packer.compress(record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["digest"])) + packer.flush()
            member.write(packed)
            lines.append(f"{'' if row['page_id'] is None else row['page_id']} {json.dumps({'offset': at, 'length': len(packed), 'digest': row['digest']})}\n")
            at, n = at + len(packed), n + 1
    if out is not None:
        member.close()
        zip_.writestr(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "".join(lines))
        zip_.writestr(zipfile.ZipInfo("datapackage.json", (1980, 1, 1, 0, 0, 0)), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        zip_.close()
        out.close()
        system.move(draft, name)
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name.rpartition('/')[2]}", "n_records": n}])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page as a record; one archive per partition. Returns (path, n_records) of the archives, all written."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = large.where("n > 1").select(F.col("digest").alias("d"), "first")
    joined = rows.join(first, rows["digest"] == first["d"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    ordered = joined.select("page_id", "url", "payload", "digest", "refers_to").sortWithinPartitions("page_id", "digest", "url")
    system, root = place(folder)
    system.create_dir(root, recursive=True)
    return written(ordered.mapInArrow(lambda b: _write(b, folder), "path string, n_records long"), "archives")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each archive's index, byte ranges of about RANGE_BYTES: where they begin, and the records' lengths."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = place(path)
            with system.open_input_file(name) as f:
                read_at = lambda at, n, f=f: f.read_at(n, at)
                members = directory(read_at, f.size())
                start, _ = member_data(read_at, members[DATA])
                at, size = member_data(read_at, members[INDEX])
                entries = [json.loads(x.split(" ", 1)[1]) for x in read_at(at, size).decode().splitlines()]
            rows, lengths, begin = [], [], 0
            for k, e in enumerate(entries):
                if not lengths:
                    begin = start + e["offset"]
                lengths.append(e["length"])
                if k + 1 == len(entries) or sum(lengths) >= RANGE_BYTES or len(lengths) >= RANGE_RECORDS:
                    rows.append({"path": path, "begin": begin, "lengths": lengths})
                    lengths = []
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("begin", pa.int64()), ("lengths", pa.list_(pa.int64()))]))


def _records(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, name = place(row["path"])
            with system.open_input_file(name) as f:
                raw, at, out = f.read_at(sum(row["lengths"]), row["begin"]), 0, []
            for n in row["lengths"]:
                r = parse(zlib.decompress(raw[at : at + n], 31))
                at += n
                out.append({"page_id": r["page_id"], "payload_bytes": r["payload_bytes"], "payload_digest": r["payload_digest"], "record_type": r["type"], "refers_to": r["refers_to"], "url": r["url"], **({"payload": r["payload"]} if with_payload else {})})
            kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds + [("payload", pa.binary())] * with_payload))


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (column ``path``), read in ranges."""
    ranges = archives.select("path").mapInArrow(_ranges, "path string, begin long, lengths array<long>")
    spread = ranges.repartition(parts(archives, 64))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return spread.mapInArrow(lambda b: _records(b, with_payload), schema + ", payload binary" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read all records back."""
    folder = f"{shared_dir(pages.sparkSession)}/chunkwell/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder))
