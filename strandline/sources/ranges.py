"""Data sources that read parts of files in tasks: digests of byte ranges, and the directories of ZIP archives.

Both read with bounded buffers what Python can open: local and shared folders, and the stores that pyarrow knows by their
scheme. Files are listed once; small ones are packed into tasks, large ones cut into ranges, and filters on paths and lengths
take away files before any is opened.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .files import ship

#: Bytes that a task reads at once, and about how many bytes one task has to read.
BUFFER, TASK_BYTES = 1 << 20, 64 << 20


@dataclass(frozen=True)
class Part:
    path: str
    length: int
    start: int
    stop: int


@dataclass
class Work(InputPartition):
    parts: tuple[Part, ...]


def _opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """A file system, the root's path in it, and what stands before paths outside of it."""
    if "://" in root or root.startswith("file:"):
        prefix = root[: root.index("://") + 3] if "://" in root else "file:"
        system, path = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
        return system, path, prefix if prefix in ("file:", "file://") else ""
    return fs.LocalFileSystem(), root, ""


def packed(parts: list[Part], most: int = TASK_BYTES) -> list[Work]:
    """Parts in order, together while they have at most that many bytes."""
    out: list[list[Part]] = []
    size = most + 1
    for part in parts:
        n = part.stop - part.start
        if size + n > most:
            out.append([])
            size = 0
        out[-1].append(part)
        size += n
    return [Work(tuple(x)) for x in out]


class _Reader(DataSourceReader):
    """Lists files below options root, pruned by filters on path and length."""

    TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a}

    def __init__(self, options: dict[str, str], path: str = "path", length: str = "length"):
        self.root, self.options, self.columns, self.filters = options["root"], dict(options), {path: "path", length: "length"}, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in self.TESTS and len(f.attribute) == 1 and f.attribute[0] in self.columns and f.value is not None:
                self.filters.append((type(f), self.columns[f.attribute[0]], f.value))
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        system, root, prefix = _opened(self.root)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        named = sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File)
        return [(p, n) for p, n in named if all(self.TESTS[kind]({"path": p, "length": n}[c], v) for kind, c, v in self.filters)]

    def stream(self, path: str):
        system, _, prefix = _opened(self.root)
        return system.open_input_file(path.removeprefix(prefix))


class RangeReader(_Reader):
    def partitions(self) -> list[Work]:
        most = int(self.options.get("rangebytes", 0))
        parts = []
        for path, length in self.files():
            step = most or max(length, 1)
            parts += [Part(path, length, a, min(a + step, length)) for a in range(0, max(length, 1), step)]
        return packed(parts)

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in partition.parts:
            digest, at = hashlib.sha256(), part.start
            with self.stream(part.path) as f:
                f.seek(part.start)
                while at < part.stop and (data := f.read(min(BUFFER, part.stop - at))):
                    digest.update(data)
                    at += len(data)
            if at < part.stop:
                raise OSError(f"{part.path} became shorter while it was read")
            rows.append((part.path, part.length, part.start, part.stop, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "length", "start", "stop", "sha256"])


class FileRanges(DataSource):
    """path, length, start, stop, sha256 of every byte range of files below `root`; of whole files if rangeBytes is 0."""

    @classmethod
    def name(cls) -> str:
        return "strandline_ranges"

    def schema(self) -> str:
        return "path string, length long, start long, stop long, sha256 string"

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(self.options)


# Signatures and layouts of records of ZIP files.
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_END_LAYOUT, _END64_LAYOUT, _LOCATOR_LAYOUT, _ENTRY_LAYOUT, _LOCAL_LAYOUT = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")

OK, NO_END, BAD_DIRECTORY, COUNT_DIFFERS, OUTSIDE = "OK", "NO_END_RECORD", "BAD_DIRECTORY", "COUNT_DIFFERS", "OUTSIDE_THE_FILE"


def write_file(path: str, content: bytes) -> None:
    """Write a file whole, in place of one that is there; its folder is made."""
    system, at, _ = _opened(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(content)
    system.move(part, at)  # a task that is run again replaces it


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a file for each row (path below the folder, content), each whole in one task; gives path and bytes."""
    ship(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                write_file(f"{folder}/{name}", content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64())], ["path", "bytes"])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "path string, bytes long")


def zipped(members: Iterable[tuple[str, bytes]]) -> bytes:
    """A ZIP archive of these members."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


class BadArchive(Exception):
    pass


@dataclass(frozen=True)
class Member:
    path: str
    method: int
    crc32: int
    compressed: int
    size: int
    offset: int


def _ending(f, length: int) -> tuple[int, int, int, int]:
    """Entries, place and size of the directory, and how far the archive is shifted by what precedes it."""
    tail_at = max(0, length - (1 << 16) - _END_LAYOUT.size)
    f.seek(tail_at)
    tail = f.read(length - tail_at)
    at = len(tail) - _END_LAYOUT.size
    while (at := tail.rfind(_END, 0, at + 4)) >= 0:
        if at + _END_LAYOUT.size <= len(tail):
            _, disk, first, here, entries, size, offset, comment = _END_LAYOUT.unpack_from(tail, at)
            if at + _END_LAYOUT.size + comment == len(tail):
                break  # the comment reaches the end of the file
        at -= 1
        if at < 0:
            break
    if at < 0:
        raise BadArchive(NO_END)
    stop = tail_at + at
    if (entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF) and at >= _LOCATOR_LAYOUT.size and tail[at - _LOCATOR_LAYOUT.size : at - _LOCATOR_LAYOUT.size + 4] == _LOCATOR64:
        stop -= _LOCATOR_LAYOUT.size + _END64_LAYOUT.size
        if stop < 0:
            raise BadArchive(BAD_DIRECTORY)
        f.seek(stop)
        data = f.read(_END64_LAYOUT.size)
        if len(data) < _END64_LAYOUT.size or data[:4] != _END64:
            raise BadArchive(BAD_DIRECTORY)
        _, _, _, _, disk, first, here, entries, size, offset = _END64_LAYOUT.unpack(data)
    if disk or first or here != entries or size > stop:
        raise BadArchive(BAD_DIRECTORY)
    shift = stop - size - offset
    if shift < 0:
        raise BadArchive(OUTSIDE)
    return entries, stop - size, size, shift


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Values of which those that are all ones stand in the ZIP64 field of extra, in order."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<2H", extra, at)
        if tag == 1:
            data, k = extra[at + 4 : at + 4 + n], 0
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    if k + 8 > len(data):
                        raise BadArchive(BAD_DIRECTORY)
                    values[i] = struct.unpack_from("<Q", data, k)[0]
                    k += 8
        at += 4 + n
    return values


def directory(f, length: int) -> Iterator[Member]:
    """Members of the archive that is open as f, read from its directory a buffer at a time; BadArchive where it lies."""
    entries, at, size, shift = _ending(f, length)
    f.seek(at)
    held, left, seen = b"", size, 0
    while left or held:
        while left and (len(held) < _ENTRY_LAYOUT.size or len(held) < _ENTRY_LAYOUT.size + sum(struct.unpack_from("<3H", held, 28))):
            data = f.read(min(BUFFER, left))
            if not data:
                raise BadArchive(BAD_DIRECTORY)
            held, left = held + data, left - len(data)
        if len(held) < _ENTRY_LAYOUT.size or held[:4] != _ENTRY:
            raise BadArchive(BAD_DIRECTORY)
        _, _, _, flags, method, _, _, crc, compressed, plain, names, extras, comments, _, _, _, offset = _ENTRY_LAYOUT.unpack_from(held)
        end = _ENTRY_LAYOUT.size + names + extras + comments
        if len(held) < end:
            raise BadArchive(BAD_DIRECTORY)
        name = held[_ENTRY_LAYOUT.size : _ENTRY_LAYOUT.size + names]
        plain, compressed, offset = _wide(held[_ENTRY_LAYOUT.size + names : end - comments], [plain, compressed, offset])
        if offset + shift + _LOCAL_LAYOUT.size + compressed > at:
            raise BadArchive(OUTSIDE)
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437", "replace"), method, crc, compressed, plain, offset + shift)
        held, seen = held[end:], seen + 1
    if seen != entries:
        raise BadArchive(COUNT_DIFFERS)


def measured(f, member: Member) -> tuple[str, str | None]:
    """State and SHA-256 of a member's content, unpacked a buffer at a time: VERIFIED, or what is wrong with it."""
    f.seek(member.offset)
    head = f.read(_LOCAL_LAYOUT.size)
    if len(head) < _LOCAL_LAYOUT.size or head[:4] != _LOCAL:
        return "NO_LOCAL_HEADER", None
    if member.method not in (0, 8):
        return "METHOD_UNKNOWN", None
    f.seek(member.offset + _LOCAL_LAYOUT.size + sum(_LOCAL_LAYOUT.unpack(head)[-2:]))
    unpack = zlib.decompressobj(-15) if member.method == 8 else None
    digest, crc, size, left = hashlib.sha256(), 0, 0, member.compressed
    try:
        while left:
            data = f.read(min(BUFFER, left))
            if not data:
                return "TRUNCATED", None
            left -= len(data)
            while data:
                out = unpack.decompress(data, BUFFER) if unpack else data
                data = unpack.unconsumed_tail if unpack else b""
                digest.update(out)
                crc, size = zlib.crc32(out, crc), size + len(out)
                if size > member.size:
                    return "SIZE_DIFFERS", None
    except zlib.error:
        return "DAMAGED", None
    if unpack and not unpack.eof:
        return "TRUNCATED", None
    return ("SIZE_DIFFERS" if size != member.size else "CRC_DIFFERS" if crc != member.crc32 else "VERIFIED"), digest.hexdigest()


class ArchiveReader(_Reader):
    COLUMNS = (("archive", pa.string()), ("archive_length", pa.int64()), ("member", pa.string()), ("method", pa.int32()), ("crc32", pa.int64()), ("compressed", pa.int64()), ("size", pa.int64()), ("offset", pa.int64()), ("status", pa.string()))

    def __init__(self, options: dict[str, str]):
        super().__init__(options, "archive", "archive_length")

    def partitions(self) -> list[Work]:
        # what is read of an archive is its directory, of which the length isn't known: about one in a thousand bytes
        return packed([Part(p, n, 0, BUFFER + n // 1000) for p, n in self.files()])

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            rows: list[tuple] = []
            with self.stream(part.path) as f:
                try:
                    for m in directory(f, part.length):
                        rows.append((part.path, part.length, m.path, m.method, m.crc32, m.compressed, m.size, m.offset, OK))
                        if len(rows) == 10_000:
                            yield self._batch(rows)
                            rows = []
                except BadArchive as why:
                    rows.append((part.path, part.length, *[None] * 6, str(why)))
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(self.COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, self.COLUMNS, strict=True)], [n for n, _ in self.COLUMNS])


class Archives(DataSource):
    """A row for each member of the ZIP archives below `root`, and one with a status for an archive whose directory is
    damaged or lies, after the members that precede the fault."""

    @classmethod
    def name(cls) -> str:
        return "strandline_archives"

    def schema(self) -> str:
        return "archive string, archive_length long, member string, method int, crc32 long, compressed long, size long, offset long, status string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def _source(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def file_ranges(spark: SparkSession, root: str, range_bytes: int = TASK_BYTES) -> DataFrame:
    """path, length, start, stop, sha256 of each range of files below root, however long a file is; with 0, of whole files.

    A file without bytes has one empty range."""
    return _source(spark, FileRanges, root=root, rangeBytes=range_bytes)


def archive_index(spark: SparkSession, root: str) -> DataFrame:
    """archive, archive_length, member, method, crc32, compressed, size, offset, status of the ZIP archives below root."""
    return _source(spark, Archives, root=root).where(F.lower("archive").endswith(".zip"))


def archive_contents(index: DataFrame, root: str) -> DataFrame:
    """The members of an index with state and sha256 of their content: VERIFIED, or what is wrong with it. Each is read where
    it lies in its archive, so the members of a large one are the work of many tasks. Folders are left out."""
    members = index.where("status = 'OK' AND NOT endswith(member, '/')").select("archive", "archive_length", "member", "method", "crc32", "compressed", "size", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ArchiveReader({"root": root})
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                with reader.stream(r["archive"]) as f:
                    found.append(measured(f, Member(r["member"], r["method"], r["crc32"], r["compressed"], r["size"], r["offset"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in found], pa.string()), pa.array([h for _, h in found], pa.string())], [*batch.schema.names, "state", "sha256"])

    schema = StructType(members.schema.fields + StructType.fromDDL("state string, sha256 string").fields)
    return members.repartition("archive", "offset").mapInArrow(read, schema)
