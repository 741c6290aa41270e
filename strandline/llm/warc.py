"""WARC archives: write pages as records, read archives back, put segmented records together again.

A response is an HTTP message with chunked transfer framing. Blocks over SEGMENT_BYTES are split into a first record
and continuations, which name the first one's id and count up from 2; the last one states the whole length. Of equal
payloads of at least REVISIT_BYTES one is a response, and the others are revisits that hold HTTP headers only.

Archives are gzip files of Spark's text writer, whose line separator is the blank line that ends a record. They are read
as they are by Spark's text reader, which is told to leave them compressed, so that a read that fails fails its task; they are
unpacked where they are parsed, so that damage shows. There they are cut where a record seems to begin, and a record's pieces are put
together again by its stated length: a task holds one record at a time, however large the archive, and what can't be read
becomes a row with a status.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, shuffles_go

SEGMENT_BYTES, CHUNK_BYTES, REVISIT_BYTES = 16 << 10, 4 << 10, 1000
_END = b"\r\n\r\n"
#: Where an archive is cut: the end of a record and the beginning of the next one.
_CUT = b"\r\n\r\nWARC/1."
#: About how many bytes of records a task hands on at once.
_BATCH = 1 << 20
#: Bytes that are unpacked at once.
_UNPACKED = 1 << 18
#: Reader options by which gzip files come as they are; some builds of the Hadoop client move the names.
_AS_IT_IS = {f"{place}io.{name}": value for place in ("", "org.apache.hadoop.shaded.") for name, value in (("compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec"), ("compress.passthrough.extension", ".gz"))}
_FIELDS = "file string, record_id string, record_type string, page_id long, url string, refers_to long, digest string, http_bytes long, segment long, origin_id string, total long, block binary, status string"
OK, NO_HEADER_END, NO_LENGTH, NO_TYPE, TRUNCATED, SEGMENT_MISSING, BROKEN_CHUNKS, NO_HTTP_HEADER = "OK", "NO_HEADER_END", "NO_LENGTH", "NO_TYPE", "TRUNCATED", "SEGMENT_MISSING", "BROKEN_CHUNKS", "NO_HTTP_HEADER"
WRONG_DIGEST, DAMAGED_FILE = "WRONG_DIGEST", "DAMAGED_FILE"


def _pieces(data: bytes, size: int) -> list[bytes]:
    """Runs of at most that many bytes, none of which parts a character."""
    out, i = [], 0
    while i < len(data):
        j = min(i + size, len(data))
        while j < len(data) and data[j] & 0xC0 == 0x80 and j > i + 1:
            j -= 1
        out.append(data[i:j])
        i = j
    return out


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in _pieces(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of chunked framing (extensions and trailers are skipped), or None if it is broken."""
    out, i = [], 0
    while True:
        j = body.find(b"\r\n", i)
        size = body[i:j].split(b";")[0].strip() if j >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        i = j + 2
        if body[i + n : i + n + 2] != b"\r\n":
            return None
        out.append(body[i : i + n])
        i += n + 2


def _record(kind: str, record_id: str, block: bytes, **fields) -> str:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(["WARC/1.1", *head, "", block.decode()])


def _identity(page_id, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}"


def _records(batches: Iterator[pa.RecordBatch], segment_bytes: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Columns page, url, payload, refers; a row for each record."""
    for batch in batches:
        out, size = [], 0
        for row in range(batch.num_rows):
            page, url, text, refers = (c[row].as_py() for c in batch.columns)
            if size > _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                out, size = [], 0
            size += len(text)
            payload = text.encode()
            sha = hashlib.sha1(payload)
            me = _identity(page, sha.hexdigest())
            about = {"WARC_Target_URI": " ".join(url.split()) if url is not None else None, "WARC_Payload_Digest": "sha1:" + base64.b32encode(sha.digest()).decode(), "X_Page": page}
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            if refers is not None:
                out.append(_record("revisit", me, http + b"Content-Length: %d\r\n\r\n" % len(payload), **about, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<{_identity(refers, sha.hexdigest())}>", X_Refers_To_Page=refers, Content_Type="application/http; msgtype=response"))
                continue
            block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
            parts = _pieces(block, segment_bytes)
            out.append(_record("response", me, parts[0], **about, WARC_Segment_Number=1 if len(parts) > 1 else None, Content_Type="application/http; msgtype=response"))
            for k, part in enumerate(parts[1:], 2):
                out.append(_record("continuation", f"{me}:{k}", part, WARC_Segment_Origin_ID=f"<{me}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=len(block) if k == len(parts) else None))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES, records_per_file: int = 4000) -> None:
    """Write a record (with its continuations) for every row of pages into the folder `path`.

    Null html is an empty payload, a null url leaves out that header. Payloads count as equal if length, SHA-1 and a
    64-bit hash are; of equal ones of revisit_bytes or more, the largest id is the response. Rows with a null id are
    always responses, and repeated rows with the largest id all are. Other columns are ignored.
    """
    ship(pages.sparkSession)
    p = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    same = [F.octet_length("payload").alias("bytes"), F.sha1(F.col("payload").cast("binary")).alias("sha"), F.xxhash64("payload").alias("hash")]
    p = p.select("*", *same)
    copies = p.where((F.col("bytes") >= revisit_bytes) & F.col("page").isNotNull()).groupBy("bytes", "sha", "hash").agg(F.max("page").alias("kept"), F.count("*").alias("c")).where("c > 1").drop("c")
    # one row for each repeated payload: Spark broadcasts it if it is small. Else the hash's other form has both sides
    # shuffled for the join, so that Spark can split the rows of a frequent payload
    copies = copies.select("bytes", "sha", F.bitwise_not("hash").alias("other"), "kept")
    p = p.withColumn("other", F.bitwise_not("hash")).join(copies, ["bytes", "sha", "other"], "left").select("page", "url", "payload", F.when(F.col("page") != F.col("kept"), F.col("kept")).alias("refers"))
    records = p.mapInArrow(partial(_records, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes), "value string")
    with shuffles_go(pages.sparkSession):
        records.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's head, lower-case; the first of several with a name counts."""
    fields: dict[str, str] = {}
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    return fields


class Damaged(Exception):
    """A file ends before its last member does, or holds bytes that aren't of one."""


def unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What the members of a gzip file hold, in pieces of a bounded size; Damaged at the first byte that is wrong.

    The reader of lines doesn't tell whether a file ends with a line feed; if one is missing to the last member, it does.
    A file that doesn't begin as gzip files do, but as an archive does, is handed on as it is."""
    member, first, every = None, True, _with_end(chunks)
    for last, chunk in every:
        if first and chunk[:5] == b"WARC/":
            yield chunk
            yield from (c for _, c in every)
            return
        first = first and not chunk
        data = chunk
        while data:
            if member is None:
                data = data.lstrip(b"\0")  # members may be padded
                if not data:
                    break
                member = zlib.decompressobj(31)
            try:
                out = member.decompress(data, _UNPACKED)
                while out:
                    yield out
                    data = member.unconsumed_tail
                    out = member.decompress(data, _UNPACKED) if not member.eof else b""
            except zlib.error as e:
                raise Damaged(str(e)) from e
            data = member.unused_data
            if member.eof:
                member = None
        if last and member is not None:
            try:
                member.decompress(b"\n")
            except zlib.error as e:
                raise Damaged(str(e)) from e
            if not member.eof:
                raise Damaged("the file ends within a member")


def _with_end(chunks: Iterator[bytes]) -> Iterator[tuple[bool, bytes]]:
    """The chunks, and whether each is the last."""
    before = None
    for chunk in chunks:
        if before is not None:
            yield False, before
        before = chunk
    if before is not None:
        yield True, before


def pieces_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """A stream cut at _CUT; what precedes damage is a piece, too, before Damaged is raised."""
    held, tail, keep, damage = [], b"", len(_CUT) - 1, None
    try:
        for chunk in chunks:
            *whole, rest = (tail + chunk).split(_CUT)
            for piece in whole:
                yield b"".join([*held, piece])
                held = []
            held.append(rest[:-keep])
            tail = rest[-keep:]
    except Damaged as e:
        damage = e
    yield b"".join([*held, tail])
    if damage:
        raise damage


def assemble(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes | None, str]]:
    """Fields, block and status of each record, from pieces (file, bytes) of archives that were cut at _CUT.

    A block that holds what looks like another record is several pieces; they are joined while they lack the stated
    length. What stands before the first record of a file is skipped."""
    file, todo = None, iter(pieces)
    now = next(todo, None)
    while now is not None:
        name, piece = now
        first, file = name != file, name
        now = next(todo, None)
        if first:
            at = piece.find(b"WARC/1.")
            if at < 0:
                continue
            piece = piece[at + len(b"WARC/1.") :]
        head, gap, block = piece.partition(_END)
        fields = _fields(head)
        length = fields.get("content-length", "")
        if not length.isascii() or not length.isdigit() or len(length) > 18:
            yield fields, None, NO_LENGTH if gap or "content-length" in fields else NO_HEADER_END
            continue
        n, parts = int(length), [block]
        if not gap:
            # the block may begin with what looks like a record, so that the cut took the end of the head with it
            if n < len(_CUT) - len(_END) or now is None or now[0] != file:
                yield fields, None, NO_HEADER_END
                continue
            head, _, block = (piece + _CUT + now[1]).partition(_END)
            parts, now = [block], next(todo, None)
        size = sum(map(len, parts))
        while size < n and now is not None and now[0] == file:
            parts += [_CUT, now[1]]
            size += len(_CUT) + len(now[1])
            now = next(todo, None)
        whole = b"".join(parts)[:n]
        if len(whole) < n:
            yield fields, None, TRUNCATED
        elif "warc-type" not in fields:
            yield fields, None, NO_TYPE
        else:
            yield fields, whole, OK


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def _digest(text: str | None) -> str | None:
    """Hexadecimal form of a SHA-1 in base 32; null for another algorithm or form."""
    try:
        return base64.b32decode(text[5:]).hex() if text and text.startswith("sha1:") else None
    except ValueError:
        return None


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """File and bytes, from columns file, line: a file's lines follow each other, parted by line feeds."""
    before = None
    for batch in batches:
        for name, lines in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), itemgetter(0)):
            data = b"\n".join(line for _, line in lines)
            yield name, b"\n" + data if name == before else data
            before = name


def _records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict[str, str], bytes | None, str]]:
    """File, fields, block and status of each record, and of each damaged file after those that precede the damage."""
    for name, chunks in groupby(_chunks(batches), itemgetter(0)):
        damage: list[Damaged] = []

        def pieces(name=name, chunks=chunks, damage=damage) -> Iterator[tuple[str, bytes]]:
            try:
                for piece in pieces_of(unpacked(c for _, c in chunks)):
                    yield name, piece
            except Damaged as e:
                damage.append(e)

        for fields, block, status in assemble(pieces()):
            yield name, fields, block, status
        if damage:
            yield name, {}, None, DAMAGED_FILE


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of _FIELDS from columns file, line; requests, infos and the like are left out."""
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    rows: list[list] = [[] for _ in names]
    size = 0
    for name, f, block, status in _records_of(batches):
        kind = f.get("warc-type")
        if status == OK and kind not in ("response", "revisit", "continuation"):
            continue
        http = next((_number(x.split(b":")[1].decode(errors="replace").strip()) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")), None) if kind == "revisit" and block else None
        me = f.get("warc-record-id", "").strip("<>") or None
        page = f.get("x-page", "")
        page = -n if page[:1] == "-" and (n := _number(page[1:])) is not None else _number(page)
        refers = f.get("x-refers-to-page", "")
        refers = -n if refers[:1] == "-" and (n := _number(refers[1:])) is not None else _number(refers)
        segment = _number(f.get("warc-segment-number"))
        if kind == "continuation" and segment is None:
            block, status = None, SEGMENT_MISSING
        origin = f.get("warc-segment-origin-id", "").strip("<>") or me
        for column, value in zip(rows, (name, me, kind, page, f.get("warc-target-uri"), refers, _digest(f.get("warc-payload-digest")), http, segment if status == OK else None, origin, _number(f.get("warc-segment-total-length")), block, status), strict=True):
            column.append(value)
        size += len(block or b"") + 500
        if size > _BATCH:
            yield _batch(names, rows)
            rows, size = [[] for _ in names], 0
    yield _batch(names, rows)


def _batch(names: list[str], rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, a block and a status, become the payload of its HTTP message and the status."""
    columns = ("record_type", "digest", "block", "status")
    for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
        out, states = [], []
        for kind, digest, block, status in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            payload = None
            if status == OK:
                head, gap, body = block.partition(_END)
                payload = None if not gap else dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                status = NO_HTTP_HEADER if not gap else BROKEN_CHUNKS if payload is None else OK
                if status == OK and kind == "response" and digest and hashlib.sha1(payload).hexdigest() != digest:
                    payload, status = None, WRONG_DIGEST
            out.append(payload)
            states.append(status)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.binary()), pa.array(states, pa.string())], [*batch.schema.names[:-2], "payload", "status"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """file, record_id, record_type, page_id, url, refers_to, digest, http_bytes, payload, status of each response and
    revisit, and of what can't be read.

    Segments are grouped by the id of their first record and put in order. A revisit's payload is empty; http_bytes is
    the length that its HTTP headers state. Repeated records give repeated rows. The payload is null where the status
    isn't OK: NO_HEADER_END, NO_LENGTH (none, or no number), NO_TYPE, TRUNCATED (the archive ends before the stated
    length), SEGMENT_MISSING (one is, or the whole length isn't the stated one; also continuations whose first record
    is missing), NO_HTTP_HEADER, BROKEN_CHUNKS, WRONG_DIGEST (of a response that states its SHA-1); such rows have the fields that
    could be read. A gzip file that is cut off or damaged has a row DAMAGED_FILE, with its name, after the records that precede the
    damage, the last of which may be TRUNCATED; what follows the damage can't be read. A file that can't be read at all fails the job,
    whatever the session says of corrupt files. Empty archives have no rows.

    Archives end in .gz (Spark doesn't split those) and are parsed once, into a table in the shared folder.
    """
    ship(spark)
    lines = spark.read.options(**_AS_IT_IS).option("lineSep", "\n").option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").option("pathGlobFilter", "*.gz").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    records = cut(lines.mapInArrow(_parsed, _FIELDS))
    kept = ["file", "record_id", "record_type", "page_id", "url", "refers_to", "digest", "http_bytes"]
    whole = records.where("segment is null").select(*kept, "block", "status")
    # a group is one record, so it is no larger than a page
    groups = records.where("segment is not null").groupBy("origin_id").agg(F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"), F.collect_list(F.when(F.col("segment") == 1, F.struct(*kept))).alias("first"))
    block = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    in_order = F.forall(F.transform("s", lambda x, i: x["segment"] == i + 1), lambda ok: ok)
    lost = F.struct(*(F.col("origin_id").alias(c) if c == "record_id" else F.lit(None).cast(records.schema[c].dataType).alias(c) for c in kept))
    joined = groups.select(F.when(F.size("first") > 0, F.col("first")).otherwise(F.array(lost)).alias("first"), (F.coalesce(in_order & (F.octet_length(block) == F.col("total")), F.lit(False))).alias("good"), block.alias("block"))
    joined = joined.select(F.explode("first").alias("f"), "good", "block").select("f.*", F.when(F.col("good"), F.col("block")).alias("block"), F.when(F.col("good"), OK).otherwise(SEGMENT_MISSING).alias("status"))
    return whole.union(joined).mapInArrow(_payloads, "file string, record_id string, record_type string, page_id long, url string, refers_to long, digest string, http_bytes long, payload binary, status string")


def archive_report(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; of responses the payload itself is measured, and is
    null where it couldn't be read."""
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "page_id",
        F.when(revisit, F.col("http_bytes")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
