"""Byte ranges of files and directories of archives, against plain reading and the standard library."""

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from strandline.sources import ranges, texts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rnd = tmp_path_factory.mktemp("files"), random.Random(3)
    (root / "deep" / "er").mkdir(parents=True)
    for name, n in (("a.bin", 0), ("b.bin", 1), ("deep/c.raw", 70_000), ("deep/er/d.raw", 1 << 20), ("deep/er/é.txt", 333)):
        (root / name).write_bytes(rnd.randbytes(n))
    return root


@pytest.mark.parametrize("size", [0, 1000, 65_536])
def test_digests_of_ranges(spark, folder, size):
    got = {(r["path"], r["start"]): (r["length"], r["stop"], r["sha256"]) for r in ranges.file_ranges(spark, str(folder), size).collect()}
    want = {}
    for p in folder.rglob("*.*"):
        if p.is_file():
            data = p.read_bytes()
            for a in range(0, max(len(data), 1), size or max(len(data), 1)):
                part = data[a : a + size] if size else data
                want[str(p), a] = (len(data), a + len(part), hashlib.sha256(part).hexdigest())
    assert got == want
    assert {r["path"] for r in ranges.file_ranges(spark, f"file://{folder}", 0).collect()} == {f"file://{p}" for p, _ in want}


def test_large_files_are_the_work_of_several_tasks(folder):
    reader = ranges.RangeReader({"root": str(folder), "rangebytes": "100000"})
    whole = [p for w in reader.partitions() for p in w.parts]
    assert len(reader.partitions()) == 1 and sum(p.stop - p.start for p in whole) == (1 << 20) + 70_334
    assert len(ranges.packed(whole, 150_000)) > 8 and [p for w in ranges.packed(whole, 150_000) for p in w.parts] == whole


def test_filters_take_files_away_before_they_are_read(spark, folder, monkeypatch):
    found = ranges.file_ranges(spark, str(folder), 0)
    assert {r["path"].rsplit("/", 1)[1] for r in found.where(F.col("path").endswith(".raw") & (F.col("length") > 70_000)).collect()} == {"d.raw"}
    reader = ranges.RangeReader({"root": str(folder)})
    left = list(reader.pushFilters([ranges.StringEndsWith(("path",), ".raw"), ranges.GreaterThan(("length",), 70_000), ranges.EqualTo(("sha256",), "x")]))
    assert [type(f) for f in left] == [ranges.EqualTo] and [p.rsplit("/", 1)[1] for p, _ in reader.files()] == ["d.raw"]


def zipped(members, comment=b"a comment", **more):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", **more) as z:
        for name, content in members:
            z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED if len(content) % 2 else zipfile.ZIP_STORED)
        z.comment = comment
    return data.getvalue()


def members_of(data):
    try:
        return [(m.path, m.method, m.crc32, m.compressed, m.size, m.offset) for m in ranges.directory(io.BytesIO(data), len(data))]
    except ranges.BadArchive as why:
        return str(why)


def by_library(data):
    return [(i.filename, i.compress_type, i.CRC, i.compress_size, i.file_size, i.header_offset) for i in zipfile.ZipFile(io.BytesIO(data)).infolist()]


def test_directories_equal_the_library(monkeypatch):
    rnd = random.Random(4)
    content = [(f"folder/{k}é.csv" if k % 3 else f"{k}.raw", rnd.randbytes(rnd.randint(0, 3000))) for k in range(200)] + [("folder/", b"")]
    data = zipped(content)
    for size in (1 << 20, 50, 1):
        monkeypatch.setattr(ranges, "BUFFER", size)
        assert members_of(data) == by_library(data)
    assert members_of(b"something before " * 9 + data) == by_library(b"something before " * 9 + data)
    assert members_of(zipped([])) == []
    # a comment that looks like an end, which the library doesn't take
    assert members_of(zipped(content, b"a comment with PK\x05\x06 in it" + b"x" * 30)) == by_library(data)


def test_large_archives_have_wide_fields():
    many = zipped([(f"{k}", b"") for k in range(66_000)])
    assert members_of(many) == by_library(many) and len(members_of(many)) == 66_000
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z, z.open("x", "w", force_zip64=True) as f:
        f.write(b"abc" * 100)
    assert members_of(data.getvalue()) == by_library(data.getvalue())
    # sizes and offset all in the extra field
    wide = ranges._wide(ranges.struct.pack("<2H3Q", 1, 24, 5 << 32, 6 << 32, 7 << 32), [0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF])
    assert wide == [5 << 32, 6 << 32, 7 << 32] and ranges._wide(b"", [1, 2, 3]) == [1, 2, 3]


def test_archives_that_lie(spark, tmp_path):
    rnd = random.Random(5)
    data = zipped([(f"{k}.raw", rnd.randbytes(2000 + k)) for k in range(20)])
    end = data.rfind(b"PK\x05\x06")
    first = data.find(b"PK\x01\x02")
    put = lambda at, x: data[:at] + x + data[at + len(x) :]
    cases = {
        "whole": data, "cut": data[:-1], "half": data[: len(data) // 2], "empty": b"", "count": put(end + 8, b"\x13\0\x13\0"), "signature": put(first, b"XX"), "offset": put(first + 42, b"\xff\xff\xff\x0f"), "size": put(end + 12, b"\xff\xff\xff\x0f"),
        "begin": put(end + 16, b"\xff\xff\xff\x0f"), "body": put(100, bytes([data[100] ^ 1])), "header": put(0, b"XX"), "crc": put(first + 16, bytes([data[first + 16] ^ 1])), "plain": put(first + 24, b"\x01\0\0\0"),
    }
    for name, x in cases.items():
        (tmp_path / f"{name}.zip").write_bytes(x)
    (tmp_path / "other.txt").write_bytes(data)
    index = ranges.archive_index(spark, str(tmp_path))
    got = {}
    for r in index.collect():
        got.setdefault(r["archive"].rsplit("/", 1)[1][:-4], []).append(r["status"])
    good = ["OK"] * 20
    assert {k: v for k, v in got.items() if k in ("whole", "body", "header", "crc", "plain")} == dict.fromkeys(("whole", "body", "header", "crc", "plain"), good)
    assert got["cut"] == got["half"] == got["empty"] == ["NO_END_RECORD"] and got["count"] == [*good, "COUNT_DIFFERS"] and got["signature"] == ["BAD_DIRECTORY"]
    assert got["offset"] == ["OUTSIDE_THE_FILE"] and got["size"] == ["BAD_DIRECTORY"] and got["begin"] == ["OUTSIDE_THE_FILE"] and "other" not in got
    states = {}
    for r in ranges.archive_contents(index, str(tmp_path)).collect():
        states.setdefault(r["archive"].rsplit("/", 1)[1][:-4], {})[r["member"]] = (r["state"], r["sha256"])
    library = zipfile.ZipFile(io.BytesIO(data))
    assert states["whole"] == {n: ("VERIFIED", hashlib.sha256(library.read(n)).hexdigest()) for n in library.namelist()}
    odd = {k: {s for s, _ in v.values()} - {"VERIFIED"} for k, v in states.items() if k != "whole"}
    assert odd["header"] == {"NO_LOCAL_HEADER"} and odd["crc"] == {"CRC_DIFFERS"} and odd["plain"] == {"SIZE_DIFFERS"} and odd["body"] <= {"CRC_DIFFERS", "DAMAGED", "SIZE_DIFFERS", "TRUNCATED"} and odd["body"]
    # an index joins what was listed elsewhere
    listed = spark.createDataFrame([(n, len(library.read(n)), hashlib.sha256(library.read(n)).hexdigest()) for n in library.namelist()] + [("gone.raw", 1, "0")], "path string, length long, sha256 string")
    found = ranges.archive_contents(index.where(F.col("archive").endswith("whole.zip")), str(tmp_path)).select(F.col("member").alias("path"), F.col("size").alias("length"), "sha256")
    assert {r["status"]: r["count"] for r in texts.verify_members(listed, found).groupBy("status").count().collect()} == {"VERIFIED": 20, "UNAVAILABLE": 1}
