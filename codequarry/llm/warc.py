"""WARC records in ZIP packages: written by tasks, read back by range without extraction.

A package holds stored (uncompressed) members: archive/data.warc.gz, one gzip member for each WARC record, and indexes/index.tsv, a line for each record with
its offset and length inside the archive member. A reader looks at the end of the file for the end-of-central-directory record, follows its ZIP64
counterpart where the plain one is saturated, lists the central directory and takes the member's data offset from its local header. A record is then one
range read at (data offset + record offset); nothing is unpacked to disk.

Packages are written under a name of their own for each attempt, in a folder that all executors share, and are listed in a manifest
table that is written after them: files of failed or repeated attempts are in no manifest and are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.tables import slices
from codequarry.storage import keep, shared_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
#: payloads of fewer bytes are always written in full
LEAST_SHARED = 100
#: a package is closed when its archive member has so many bytes
PACKAGE_BYTES = 64 << 20
#: index rows of one reading task
READ_ROWS = 2000
_READ = "id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"
#: neighbouring records are read together up to so many bytes
READ_BYTES = 4 << 20


class _Out:
    """What zipfile needs of a file that is only written forward, in a shared store."""

    def __init__(self, path: str):
        self.store, self.at = fs.FileSystem.from_uri(path)
        self.store.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.stream = self.store.open_output_stream(self.at)
        self.size = 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()

    def close(self) -> None:
        self.stream.close()


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 response or revisit record. A revisit has the HTTP head, with the full payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields with lower-case names, HTTP head, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("a WARC record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


class Package:
    """A ZIP package open for range reads."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(at)
        self.members = self._directory()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """name -> (local header offset, size, method), from the central directory."""
        end = self.file.size()
        tail_at = max(0, end - 65_557)
        tail = self.read(tail_at, end - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end-of-central-directory record")
        count, size, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
        if count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = self.read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record64 = self.read(struct.unpack("<Q", locator[8:16])[0], 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end-of-central-directory record")
            count, size, offset = struct.unpack("<QQQ", record64[32:56])
        directory, members, at = self.read(offset, size), {}, 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
            packed, full = struct.unpack("<II", directory[at + 20 : at + 28])
            n, m, k = struct.unpack("<HHH", directory[at + 28 : at + 34])
            local = struct.unpack("<I", directory[at + 42 : at + 46])[0]
            name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, x = directory[at + 46 + n : at + 46 + n + m], 0
            while x + 4 <= len(extra):
                tag, width = struct.unpack("<HH", extra[x : x + 4])
                if tag == 1:  # ZIP64: only the saturated values, in this order
                    wide = list(struct.unpack(f"<{width // 8}Q", extra[x + 4 : x + 4 + width // 8 * 8]))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    local = wide.pop(0) if local == 0xFFFFFFFF else local
                x += 4 + width
            members[name] = (local, packed, method)
            at += 46 + n + m + k
        return members

    def stored(self, name: str) -> tuple[int, int]:
        """(data offset, size) of a stored member."""
        local, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n, m = struct.unpack("<HH", head[26:30])
        return local + 30 + n + m, size

    def close(self) -> None:
        self.file.close()


def roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """pages(id, url, payload binary, digest, refers_to): refers_to is null for a response, else the smallest id of the equal payloads.

    Null html is the empty payload. Rows with a null id refer to the smallest id of their payload and are responses where there is none. Of repeated rows with
    the smallest id, all are responses.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col("url").alias("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # only digests that repeat have a first page; none of the others takes part in a join on a payload
    shared = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    shared = keep(shared.select("digest", "first"), "shared")
    return rows.join(shared, "digest", "left").select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_packages(rows: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write rows(id, url, payload, digest, refers_to) as packages; the manifest (path, records, bytes), kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the package that is being written

        def close() -> pa.RecordBatch:
            path, out, package, member, index, size = held
            held.clear()
            member.close()
            with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
                f.write("".join(index).encode())
            package.close()
            out.close()
            return pa.record_batch([pa.array([path]), pa.array([len(index)], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in slices(batches, "payload", 2 << 20):
            for row in batch.to_pylist():
                if not held:
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    out = _Out(path)
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    held[:] = [path, out, package, package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True), [], 0]
                data = gzip.compress(record(row["id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["refers_to"] is not None), 4, mtime=0)
                held[3].write(data)
                held[4].append(f"{held[5]}\t{len(data)}\n")
                held[5] += len(data)
                if held[5] >= package_bytes:
                    yield close()
        if held:
            yield close()

    return keep(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


def read_index(manifest: DataFrame, records: int = READ_ROWS) -> DataFrame:
    """(path, first, last) for each run of at most `records` index lines of the manifest's packages."""
    runs = F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1, F.lit(records).cast("bigint"))
    return manifest.where("records > 0").select("path", F.explode(runs).alias("first"), "records").select("path", "first", F.least(F.col("first") + records, "records").alias("last"))


def read_records(manifest: DataFrame) -> DataFrame:
    """A row for each record of the manifest's packages: id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to.

    Each response's digest is computed again from what was read and must equal the one in its head; an empty manifest gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                package = Package(part["path"])
                start, _ = package.stored(ARCHIVE)
                index_at, index_size = package.stored(INDEX)
                lines = package.read(index_at, index_size).decode().splitlines()[part["first"] : part["last"]]
                places = [tuple(map(int, line.split("\t"))) for line in lines]
                at = 0
                while at < len(places):
                    upto = at + 1
                    while upto < len(places) and places[upto][0] + places[upto][1] - places[at][0] <= READ_BYTES:
                        upto += 1
                    data = package.read(start + places[at][0], places[upto - 1][0] + places[upto - 1][1] - places[at][0])
                    yield _rows_of([zlib.decompress(data[o - places[at][0] : o - places[at][0] + n], 31) for o, n in places[at:upto]])
                    at = upto
                package.close()

    tasks = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("records") / READ_ROWS)), F.lit(1)).alias("n")).first()["n"]
    return read_index(manifest).repartition(int(tasks)).mapInArrow(run, _READ)


def _rows_of(records: list[bytes]) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(7)]
    for data in records:
        fields, http, payload = parse_record(data)
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}
        digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload does not have the digest of its record")
        row = (int(fields["page-id"]) if fields["page-id"] else None, fields["warc-target-uri"], kind, payload if kind == "response" else None, int(head["content-length"]), digest, int(fields["refers-to-page-id"]) if kind == "revisit" else None)
        for column, value in zip(columns, row):
            column.append(value)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _READ.split(", ")])


def archive(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for each row of pages into packages in the shared folder; their manifest.

    Clashing extra columns are ignored; an empty table writes no package.
    """
    folder = f"{shared_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:]
    return write_packages(roles(pages, id_col, html_col), folder, package_bytes)
