"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package holds a stored member of gzipped WARC records and a stored index of
their places. The reader looks for the end record, follows the ZIP64 locator
if there is one, parses the central directory and reads only what it needs.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvanite.llm.shared import shared_folder, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
MANIFEST = "path string, size long, n_records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload and the record's type; of equal payloads of `least_bytes` or more the largest page_id is the response."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    owners = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    out = rows.join(owners, ["digest", "size"], "left")
    again = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return out.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size", F.when(again, F.col("owner")).alias("refers_to"))


def record(row: dict) -> bytes:
    """One WARC record; a revisit has no payload but names its response."""
    revisit = row["refers_to"] is not None
    body = b"" if revisit else row["payload"]
    url = " ".join((row["url"] or "").split())
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{row['page_id']}>", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{row['digest']}", f"X-Payload-Length: {row['size']}", f"Content-Length: {len(body)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def write_packages(records: DataFrame, folder: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Manifest (path, size, n_records) of the packages; each attempt writes names of its own, only finished ones are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        rows = (r for batch in batches for r in (dict(zip(batch.schema.names, x)) for x in zip(*(c.to_pylist() for c in batch.columns))))
        row = next(rows, None)
        while row is not None:
            path, at, index = f"{root}/{uuid.uuid4().hex}.wacz", 0, []
            with system.open_output_stream(path) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                    while row is not None and at < max_bytes:
                        body = record(row)
                        member.write(body)
                        index.append(json.dumps({"id": row["page_id"], "at": at, "length": len(body)}))
                        at += len(body)
                        row = next(rows, None)
                with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                    member.write("\n".join(index).encode())
            yield pa.record_batch([pa.array([path]), pa.array([system.get_file_info(path).size]), pa.array([len(index)])], names=["path", "size", "n_records"])

    return records.mapInArrow(run, MANIFEST)


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (start of the data, stored size, compression) from the central directory; `read(at, length)` gives bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<10xHII", tail, end)
    locator = end - 20
    if locator >= 0 and tail[locator:locator + 4] == b"PK\x06\x07":
        (far,) = struct.unpack_from("<8xQ", tail, locator)
        far_record = read(far, 56)
        if far_record[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end record")
        count, length, at = struct.unpack_from("<32xQQQ", far_record)
    directory, out, pos = read(at, length), {}, 0
    for _ in range(count):
        if directory[pos:pos + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_note, start = struct.unpack_from("<10xH8xIIHHH8xI", directory, pos)
        name = directory[pos + 46:pos + 46 + n_name].decode("utf-8", "replace")
        extra = directory[pos + 46 + n_name:pos + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # ZIP64: only the fields that overflowed, in this order
                wide = iter(struct.unpack_from(f"<{min(n, 24) // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                start = next(wide) if start == 0xFFFFFFFF else start
            extra = extra[4 + n:]
        a, b = struct.unpack("<26xHH", read(start, 30))
        out[name] = (start + 30 + a + b, packed, method)
        pos += 46 + n_name + n_extra + n_note
    return out


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one gzipped record."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[:int(fields["content-length"])]


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, by range reads of the stored members.

    A stored payload that does not have its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        number = lambda urn: None if urn is None or urn == "<urn:page:None>" else int(urn[10:-1])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as f:
                    read = lambda at, n: f.read_at(n, at)  # noqa: E731, B023
                    found = members(read, f.size())
                    (data, _, stored), (index, length, also) = found[DATA], found[INDEX]
                    if stored or also:
                        raise ValueError("members must be stored")
                    rows = []
                    for line in read(index, length).split(b"\n"):
                        entry = json.loads(line)
                        fields, body = parse_record(read(data + entry["at"], entry["length"]))
                        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                        size = len(body) if kind == "response" else int(fields["x-payload-length"])
                        rows.append((number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to"))))
                names, kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return manifest.select("path").mapInArrow(run, READ)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write every row of `pages` (page_id, url, html) as a record, then read all packages back.

    Null html is an empty payload. Null ids stay null; they never own a
    payload. Repeated rows of the largest id are all responses. An empty table
    writes no package.
    """
    folder = f"{shared_folder(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}" if not folder.startswith("file:") else folder.replace("file:", "file://", 1)
    manifest = staged(write_packages(plan_records(pages), folder), "manifest")
    # One package is one line: the lines are dealt out, not the records.
    return read_packages(manifest.repartition(max(1, min(manifest.count(), 10_000)), "path"), folder)
