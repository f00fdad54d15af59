import hashlib
import io
import zipfile

from codequarry.llm import warc


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    long = "é" * 60
    rows = [(3, "http://a/3", long), (1, None, long), (2, "http://a/2\r\nX: y", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 99), (9, "u", "x" * 99), (10, "u", "x" * 100), (11, "u", "x" * 100), (None, "u", long), (None, "u", "only null" * 20), (12, "u", "\r\n\r\n" * 40), (10, "u", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    for size in (1, 1 << 20):
        manifest = warc.archive(pages, package_bytes=size)
        found = warc.read_records(manifest).collect()
        assert sorted([(r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found], key=str) == expected(rows)
        assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in found if r["record_type"] == "response")
        assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    assert warc.read_records(warc.archive(pages.where("false"))).collect() == []


def test_index_runs_cover_every_record(spark):
    manifest = spark.createDataFrame([("p", 5, 1), ("q", 0, 0), ("r", 4, 1)], "path string, records bigint, bytes bigint")
    assert sorted(tuple(r) for r in warc.read_index(manifest, 2).collect()) == [("p", 0, 2), ("p", 2, 4), ("p", 4, 5), ("r", 0, 2), ("r", 2, 4)]


def zip64(path, members):
    """A package whose central directory has every size and offset in ZIP64 fields only."""
    import struct

    out, central = io.BytesIO(), io.BytesIO()
    for name, data in members:
        at, crc = out.tell(), zipfile.crc32(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out.write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name + extra + data)
        wide = struct.pack("<HHB", 0x7777, 1, 0) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide)
    start, size = out.tell(), central.tell()
    out.write(central.getvalue())
    end = out.tell()
    out.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), size, start))
    out.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
    out.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end")
    path.write_bytes(out.getvalue())


def test_directories(tmp_path):
    members = [(b"archive/data.warc.gz", b"A" * 70_000), (b"indexes/index.tsv", b"0\t7\n")]
    zip64(tmp_path / "wide.zip", members)
    with zipfile.ZipFile(tmp_path / "plain.zip", "w") as z:
        for name, data in members:
            z.writestr(name.decode(), data)
    for name in ("wide.zip", "plain.zip"):
        package = warc.Package(f"file://{tmp_path}/{name}")
        for member, data in members:
            at, size = package.stored(member.decode())
            assert package.read(at, size) == data
