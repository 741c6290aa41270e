"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text's words, one space apart: h = (h << 1) + G[byte], kept to 16 bits, so it
depends on the last 16 bytes. A text is cut before a word where the hash of what precedes it is the least among the
RADIUS words on either side; where that leaves more than MOST_WORDS, as in runs of one word, it is cut after so many.
Cuts depend on nearby text only, so an insertion shifts a chunk or two, and equal passages fall into equal chunks but
for their ends. Chunks are compared by a 128-bit digest of their words.

Every occurrence of a chunk but the first (by document id, then place) is a repeat. Repeats that follow each other in
a document make a run, and runs of at least `least_run` words are removed: a passage of over 50 words that occurred
before goes, but for part of a chunk at either end; short lines that many documents share stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import cut, free, join_summary, ship
from .textbytes import SPACED, Words, buffers, constants, mix, runs

RADIUS, MOST_WORDS, LEAST_RUN = 3, 24, 20
_GEAR = np.random.default_rng(31337).integers(0, 1 << 16, 256, dtype=np.uint16)
_GAP = 16


def gear(words: Words) -> np.ndarray:
    """The rolling hash after the last byte of each word; windows of 1, 2, 4, 8, 16 bytes by doubling."""
    f = words.folded
    keep = f != 0
    after = np.zeros_like(keep)
    after[1:] = keep[:-1]  # one space after each word
    after[words.off[words.off < len(f)]] = False
    keep |= after
    text = np.repeat(np.arange(len(words.off) - 1), np.diff(words.off))
    place = np.cumsum(keep) - 1 + _GAP * text  # texts don't reach into each other
    h = np.zeros(int(place[-1]) + 1 if len(place) else 0, np.uint16)
    h[place[keep]] = _GEAR[f[keep]]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h[place[words.ends - 1]]


def chunk_starts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each chunk, and offsets of chunks by text."""
    n, never = len(words.hashes), np.int32(1 << 16)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words.of), np.int64)
    # RADIUS places that are never least go between texts
    text = np.repeat(np.arange(len(words.of) - 1), np.diff(words.of))
    place = np.arange(n) + RADIUS * (text + 1)
    before = np.full(int(place[-1]) + 1 + RADIUS, never)
    before[place[1:]] = gear(words)[:-1]
    before[place[words.of[:-1][np.diff(words.of) > 0]]] = never
    here = before[place]
    least = here < never
    for k in range(1, RADIUS + 1):
        least &= (here < before[place - k]) & (here <= before[place + k])
    out, at = [], [0]
    places = np.flatnonzero(least)
    for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist(), strict=True):
        if b > a:
            out.append(a)
            last = a
            for p in [*places[np.searchsorted(places, a) : np.searchsorted(places, b)].tolist(), b]:
                while p - last > MOST_WORDS:
                    last += MOST_WORDS
                    out.append(last)
                if p < b:
                    out.append(p)
                    last = p
        at.append(len(out))
    return np.array(out, np.int64), np.array(at, np.int64)


def _digests(words: Words, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit halves of each chunk's digest, and its words."""
    text_end = np.repeat(words.of[1:], np.diff(at))
    ends = np.append(starts[1:], 0) if len(starts) else starts
    last = at[1:][np.diff(at) > 0] - 1
    ends[last] = text_end[last]
    n = ends - starts
    place = np.arange(len(words.hashes)) - np.repeat(starts, n)
    out = [mix(np.add.reduceat(mix(words.hashes ^ salt[0]) * salt[1:][place], starts) ^ n.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64) for salt in (constants(41, MOST_WORDS + 1), constants(42, MOST_WORDS + 1))]
    return out[0], out[1], n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of columns id, digest, text: its place k, its words n, the bytes from its first word to the next
    chunk's (or the end of the text), its digest, and whether the text has had it before."""
    for batch in batches:
        data, off = buffers(batch.column(2))
        for i, j in runs(off):
            words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], SPACED)
            starts, at = chunk_starts(words)
            d1, d2, n = _digests(words, starts, at)
            each = np.diff(at)
            text = np.repeat(np.arange(j - i), each)
            begin = words.starts[starts] - (off[i:j] - off[i])[text] if len(starts) else starts
            stop = np.append(begin[1:], 0) if len(starts) else starts
            last = at[1:][each > 0] - 1
            stop[last] = np.diff(off[i : j + 1])[text[last]]
            again = np.ones(len(starts), bool)
            again[np.unique(np.stack([text.astype(np.uint64), d1, d2]), axis=1, return_index=True)[1]] = False
            which = pa.array(text + i)
            small = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), small(np.arange(len(starts)) - np.repeat(at[:-1], each)), small(n), pa.array(begin), pa.array(stop), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(again)], ["id", "digest", "k", "n", "begin", "stop", "d1", "d2", "again"])


def _cleaned(batches: Iterator[pa.RecordBatch], text_col: str, least_run: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeats (structs of k, n, begin, stop, in order) of least_run words are taken out of the text."""
    for batch in batches:
        row, repeats = batch.column(0), batch.column(1).to_pylist()
        texts = pc.struct_field(row, text_col)
        gone, kept = [], texts.to_pylist()
        for t, chunks in enumerate(repeats):
            spans: list[list[int]] = []
            for c in chunks or ():
                if spans and spans[-1][3] == c["k"]:
                    spans[-1] = [spans[-1][0], c["stop"], spans[-1][2] + c["n"], c["k"] + 1]
                else:
                    spans.append([c["begin"], c["stop"], c["n"], c["k"] + 1])
            spans = [x for x in spans if x[2] >= least_run]
            gone.append([{"start": x[0], "stop": x[1]} for x in spans])
            if spans:
                data, pieces, last = kept[t].encode(), [], 0
                for x in spans:
                    pieces.append(data[last : x[0]])
                    last = x[1]
                kept[t] = b"".join([*pieces, data[last:]]).decode()
        yield pa.RecordBatch.from_arrays([row, pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string())], ["row", "removed", "kept_text"])


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """row (struct of the columns of docs), removed (byte spans), kept_text for every row of docs.

    Texts are cut into chunks once; the table of chunks lies in the shared folder. Null texts stay null and have no
    chunks; empty texts and texts without words have none either. Rows with a null id are left as they are. Rows of
    one id count as one occurrence, so none is removed on account of another, and what each of them has is removed by
    its own text. Of equal chunks the one with the least id stays, then the first in its text. A text that consists of
    earlier passages only becomes empty. A very long text is one row's work, in proportion to it. Without documents
    there are no rows; other columns stay in row.
    """
    ship(docs.sparkSession)
    digest = lambda text: F.xxhash64(text, F.octet_length(text))  # noqa: E731  tells texts of one id apart
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    chunks = cut(texts.select("id", digest(F.col("text")).alias("digest"), "text").mapInArrow(_chunks, "id long, digest long, k int, n int, begin long, stop long, d1 long, d2 long, again boolean"))
    first = cut(chunks.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
    repeats = join_summary(chunks, first, "d1", "d2").where("id <> first or again")
    # a group is what one document repeats, so it is no larger than its text
    spans = F.sort_array(F.collect_set(F.struct("k", "n", "begin", "stop"))).alias("repeats")
    marked = cut(repeats.groupBy("id", "digest").agg(spans, F.sum("n").alias("words")).where(F.col("words") >= least_run).select("id", "digest", "repeats"))
    free(chunks, first)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("id", F.col("row")[id_col].cast("long")).withColumn("digest", digest(F.col("row")[text_col].cast("string")))
    joined = rows.join(marked, ["id", "digest"], "left").select("row", "repeats")
    span = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
    schema = StructType([rows.schema["row"], StructField("removed", span), StructField("kept_text", StringType())])
    return joined.mapInArrow(partial(_cleaned, text_col=text_col, least_run=least_run), schema)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, n_removed (spans), removed_bytes, removed, kept_text, changed of every row of docs."""
    found = find_repeats(docs.select(*dict.fromkeys([id_col, text_col])), id_col, text_col, **settings)
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select(F.col("row")[id_col].alias("doc_id"), F.size("removed").cast("long").alias("n_removed"), size.alias("removed_bytes"), "removed", "kept_text", (F.size("removed") > 0).alias("changed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **settings) -> DataFrame:
    """docs with repeated passages taken out of their texts; rows left without any word go, others keep their columns.

    length_col, if named, is brought up to date with the text's characters.
    """
    found = find_repeats(docs, id_col, text_col, **settings)
    emptied = (F.size("removed") > 0) & ~F.col("kept_text").rlike("[^ \\t\\n\\x0B\\f\\r]")
    out = found.where(~emptied)
    new = {text_col: F.col("kept_text")}
    if length_col:
        new[length_col] = F.when(F.size("removed") > 0, F.length("kept_text")).otherwise(F.col("row")[length_col]).cast(docs.schema[length_col].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
