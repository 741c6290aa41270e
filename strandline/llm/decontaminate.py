"""Benchmark decontamination with suffix arrays over the training text.

Each run of documents is a shard. Its suffix array is sorted by prefix doubling until all suffixes that differ are
apart. Every suffix of the benchmark is looked up: two binary searches give the suffixes of the shard that begin with
the same two words, a third one among those gives its place and so the longest verbatim match, and from windows on two
more give the range of suffixes that share the whole window. Lengths of common prefixes come from hashes of word
sequences, again by binary search.

A range stands for all places of a window at once, so repeated words cost no pairs: hits are counted over ranges, and
the longest matches are listed from their left ends, which only those have that no longer match holds.

Documents meet the benchmark where they lie: nothing of the corpus is shuffled. A benchmark of more than BLOCK_BYTES
is taken in blocks; what one block finds is written before the next one is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import cut, ship
from .textbytes import ALNUM, Prefixes, Words, buffers, mix, reduced, runs

#: Text of the benchmark that is broadcast at once.
BLOCK_BYTES = 32 << 20
_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
_MATCHES = ArrayType(StructType([StructField("item_id", StringType()), StructField("item_start", LongType()), StructField("start", LongType()), StructField("length", LongType())]))


class Sequence:
    """Words of some texts, with hashes of all their subsequences."""

    def __init__(self, hashes: np.ndarray, of: np.ndarray):
        self.hashes, self.of = hashes, of
        self.text = np.repeat(np.arange(len(of) - 1), np.diff(of))
        self.left = of[1:][self.text] - np.arange(len(hashes)) if len(hashes) else np.zeros(0, np.int64)
        self.prefixes = Prefixes(reduced(mix(hashes)), True)

    def hash(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.prefixes.hash(at, at + n)


def common(a: Sequence, i: np.ndarray, b: Sequence, j: np.ndarray) -> np.ndarray:
    """Words that the suffixes at i and j have in common at their beginnings."""
    low, high = np.zeros(len(i), np.int64), np.minimum(a.left[i], b.left[j])
    while (open_ := low < high).any():
        k = np.flatnonzero(open_)
        n = (low[k] + high[k] + 1) >> 1
        same = a.hash(i[k], n) == b.hash(j[k], n)
        low[k[same]], high[k[~same]] = n[same], n[~same] - 1
    return low


class SuffixArray:
    """Places of a shard's suffixes in order; a suffix ends with its text, and equal ones go by their place."""

    def __init__(self, words: Sequence):
        self.words, h = words, words.hashes
        self.first, rank = np.unique(h, return_inverse=True)
        last = words.left == 1
        then = np.zeros(len(h), np.int64)
        then[:-1] = rank[1:] + 1
        then[last] = 0
        key = rank * (len(self.first) + 1) + then
        order = np.argsort(key, kind="stable")
        self.two = key[order]  # keys of the first two words, in order
        rank = np.empty(len(h), np.int64)  # where the suffixes begin that agree so far
        step, new = 2, np.append(True, self.two[1:] != self.two[:-1])
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        while len(tied) and step <= len(h):
            i = order[tied]
            then = np.where(words.left[i] > step, rank[np.minimum(i + step, len(h) - 1)] + 1, 0)
            by = np.lexsort([then, rank[i]])
            i, then, group = i[by], then[by], rank[i[by]]
            order[tied] = i
            new = np.append(True, (group[1:] != group[:-1]) | (then[1:] != then[:-1]))
            parted = np.append(True, group[1:] != group[:-1])
            if (new == parted).all():
                break  # what is left are equal suffixes
            rank[i] = np.maximum.accumulate(np.where(new, tied, 0))
            tied = tied[~(new & np.append(new[1:], True))]
            step *= 2
        self.order = order

    def begin(self, words: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """For suffixes of other texts, the range of those that share the first two words (or the only one)."""
        if not len(self.first):
            none = np.zeros(len(words.hashes), np.int64)
            return none, none
        at = np.minimum(np.searchsorted(self.first, words.hashes), len(self.first) - 1)
        known, base = self.first[at] == words.hashes, len(self.first) + 1
        following = np.append(at[1:], 0) + 1
        one = words.left == 1
        possible = known & (one | np.append(known[1:], False))
        low = np.searchsorted(self.two, np.where(one, at * base, at * base + following), side="left")
        high = np.searchsorted(self.two, np.where(one, (at + 1) * base - 1, at * base + following), side="right")
        return np.where(possible, low, 0), np.where(possible, high, 0)

    def bound(self, words: Sequence, p: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray | None = None, after: bool = False) -> np.ndarray:
        """Where in the range a suffix belongs; with least, where those that share so many words begin (or end: after)."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            middle = (low[k] + high[k]) >> 1
            i, q = self.order[middle], p[k]
            n = common(self.words, i, words, q)
            mine, theirs = n < self.words.left[i], n < words.left[q]
            less = theirs & (~mine | (self.words.hashes[np.minimum(i + n, len(self.words.hashes) - 1)] < words.hashes[np.minimum(q + n, len(words.hashes) - 1)]))
            if least is not None:
                enough = n >= least[k]
                less = np.where(enough, after, less)
            low[k[less]], high[k[~less]] = middle[less] + 1, middle[~less]
        return low

    def ranges(self, words: Sequence, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of other texts whose longest match has `least` words or more, and the range that shares so many."""
        low, high = self.begin(words)
        p = np.flatnonzero((low < high) & (least <= words.left))
        low, high = low[p], high[p]
        at = self.bound(words, p, low, high)
        longest = np.zeros(len(p), np.int64)
        for side in (at - 1, at):
            k = np.flatnonzero((side >= low) & (side < high))
            longest[k] = np.maximum(longest[k], common(self.words, self.order[side[k]], words, p[k]))
        k = longest >= least[p]
        p, low, high, at = p[k], low[k], high[k], at[k]
        return p, self.bound(words, p, low, at, least[p]), self.bound(words, p, at, high, least[p], True)


def _left_ends(words: Sequence, i: np.ndarray, other: Sequence, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of places that share a window, those that no match to the left reaches: what comes before differs."""
    before = lambda w, at: np.where(w.left[np.maximum(at - 1, 0)] == w.left[at] + 1, w.hashes[np.maximum(at - 1, 0)], np.uint64(0)) if len(at) else np.zeros(0, np.uint64)
    start = lambda w, at: (at == 0) | (w.text[np.maximum(at - 1, 0)] != w.text[at])
    a, b, first_a, first_b = before(words, i), before(other, p), start(words, i), start(other, p)
    kinds, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    of_a, of_b = np.where(first_a, -1, of[: len(a)]), np.where(first_b, -2, of[len(a) :])
    out_i, out_p = [], []
    for kind in np.unique(of_b):
        mine = np.flatnonzero(of_b == kind)
        others = np.flatnonzero(of_a != kind)
        out_i.append(np.tile(i[others], len(mine)))
        out_p.append(np.repeat(p[mine], len(others)))
    return np.concatenate(out_i or [i[:0]]), np.concatenate(out_p or [p[:0]])


def _windows(words: Sequence, bench: Sequence, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each window that some text has: its places in the texts (in order), its places in the items, and its words."""
    if not len(words.hashes) or not len(bench.hashes):
        return
    array = SuffixArray(words)
    p, low, high = array.ranges(bench, least)
    if not len(p):
        return
    # equal windows have one range; within a width, ranges of different windows don't overlap
    _, window = np.unique(np.stack([low, high, least[p]]), axis=1, return_inverse=True)
    by = np.argsort(window.reshape(-1), kind="stable")
    for same in np.split(by, np.flatnonzero(np.diff(window.reshape(-1)[by])) + 1):
        yield np.sort(array.order[low[same[0]] : high[same[0]]]), p[same], int(least[p[same[0]]])


#: Pairs of a document and an item that a task gathers before it drops those that it has twice.
_GATHERED = 1 << 20


def _leaked_items(batches: Iterator[pa.RecordBatch], width: int, text: str, block: Broadcast) -> Iterator[pa.RecordBatch]:
    """As _leaks, without the matches: of each document the items that it has windows of, and where it is hit."""
    ids = pa.array(block.value["ids"], pa.string())
    bench = Sequence(block.value["hashes"], block.value["of"])
    least = np.minimum(np.diff(bench.of), width)[bench.text] if len(bench.hashes) else np.zeros(0, np.int64)
    lists = lambda count, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), values)
    for batch in batches:
        row, earlier, spans = batch.columns
        data, off = buffers(pc.struct_field(row, text))
        for i, j in runs(off):
            raw = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
            words = Sequence(raw.hashes, raw.of)
            marks, pairs, n = np.zeros(len(words.hashes) + 1, np.int64), [np.zeros(0, np.int64)], 0
            for places, at, size in _windows(words, bench, least):
                np.add.at(marks, places, 1)
                np.add.at(marks, places + size, -1)
                docs, items = np.unique(words.text[places]), np.unique(bench.text[at])
                pairs.append((docs[:, None] * len(ids) + items).reshape(-1))
                n += len(pairs[-1])
                if n > _GATHERED:
                    pairs = [np.unique(np.concatenate(pairs))]
                    n = len(pairs[0]) if len(pairs[0]) < _GATHERED // 2 else 0
            found = np.unique(np.concatenate(pairs))
            here = lists(np.bincount(found // max(len(ids), 1), minlength=j - i), ids.take(pa.array(found % max(len(ids), 1))))
            before, hit = earlier.slice(i, j - i), spans.slice(i, j - i)
            if (k := pc.list_value_length(before).to_numpy(zero_copy_only=False)).any():
                here = pa.array([a + b for a, b in zip(before.to_pylist(), here.to_pylist(), strict=True)], pa.list_(pa.string()))
            if (k := pc.list_value_length(hit).to_numpy(zero_copy_only=False)).any():
                flat = hit.flatten()
                start = pc.struct_field(flat, "start").to_numpy() + np.repeat(words.of[:-1], k)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + pc.struct_field(flat, "length").to_numpy(), -1)
            inside = np.cumsum(marks[:-1]) > 0
            # a run of words that are hit ends with its text
            first = np.zeros(len(inside) + 1, bool)
            first[words.of[:-1]] = True
            begins = np.flatnonzero(inside & (first[:-1] | ~np.append(False, inside[:-1])))
            ends = np.flatnonzero(inside & (np.append(first[1:-1], True) | ~np.append(inside[1:], False))) + 1 if len(inside) else begins
            doc = words.text[begins]
            where = lists(np.bincount(doc, minlength=j - i), pa.StructArray.from_arrays([pa.array(begins - words.of[doc]), pa.array(ends - begins)], ["start", "length"]))
            total = np.concatenate([[0], np.cumsum(inside)])
            yield pa.RecordBatch.from_arrays([row.slice(i, j - i), here, where, pa.array(np.diff(words.of)), pa.array(total[words.of[1:]] - total[words.of[:-1]])], ["row", "items", "spans", "n_words", "n_hit"])


def _leaks(batches: Iterator[pa.RecordBatch], width: int, text: str, block: Broadcast) -> Iterator[pa.RecordBatch]:
    ids = block.value["ids"]
    bench = Sequence(block.value["hashes"], block.value["of"])
    least = np.minimum(np.diff(bench.of), width)[bench.text] if len(bench.hashes) else np.zeros(0, np.int64)
    for batch in batches:
        row, earlier = batch.column(0), batch.column(1)
        data, off = buffers(pc.struct_field(row, text))
        for i, j in runs(off):
            raw = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
            words = Sequence(raw.hashes, raw.of)
            marks, found = np.zeros(len(words.hashes) + 1, np.int64), [np.zeros((2, 0), np.int64)]
            for places, p, n in _windows(words, bench, least):
                np.add.at(marks, places, 1)
                np.add.at(marks, places + n, -1)
                found.append(np.stack(_left_ends(words, places, bench, p)))
            at, q = np.concatenate(found, 1)
            # an item shorter than the width is a window of its own size: it may lie in a longer match of its diagonal
            length = common(words, at, bench, q)
            doc = words.text[at]
            by = np.lexsort([q, at, doc])
            at, q, length, doc = at[by], q[by], length[by], doc[by]
            count = np.bincount(doc, minlength=j - i)
            item = bench.text[q]
            here = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array([ids[k] for k in item.tolist()], pa.string()), pa.array(q - bench.of[item]), pa.array(at - words.of[doc]), pa.array(length)], fields=list(_MATCH)),
            )
            before = earlier.slice(i, j - i)
            if (n := pc.list_value_length(before).to_numpy(zero_copy_only=False)).any():
                flat = before.flatten()
                start = pc.struct_field(flat, "start").to_numpy() + np.repeat(words.of[:-1], n)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + pc.struct_field(flat, "length").to_numpy(), -1)
                here = pa.array([a + b for a, b in zip(before.to_pylist(), here.to_pylist(), strict=True)], pa.list_(_MATCH))
            hit = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
            yield pa.RecordBatch.from_arrays([row.slice(i, j - i), here, pa.array(np.diff(words.of)), pa.array(hit[words.of[1:]] - hit[words.of[:-1]])], ["row", "matches", "n_words", "n_hit"])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Broadcast]:
    """Blocks of about so many bytes; repeated items are one. A single item may be larger than a block."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        words = Words(*buffers(pa.array([r["t"] for r in rows], pa.string())), ALNUM)
        yield spark.sparkContext.broadcast({"hashes": words.hashes, "of": words.of, "ids": [r["i"] for r in rows]})


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (struct of the columns of docs), matches, n_words, n_hit for every row of docs.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A window is `width`
    consecutive words of an item, or all of a shorter item. matches are the verbatim matches of a window or more that
    can't be made longer at either end (item_id, item_start, start, length in words); n_hit counts the document's words
    inside any of them.

    Null and empty texts have no words; so do null items, which never match. An item with a null id marks words, and
    its matches have a null item_id. Repeated rows are handled one by one, repeated items (id and text) are one. A very
    long text is a shard of its own, with memory in proportion to its words, however they repeat. Ties don't arise.
    Without items nothing matches; without documents there are no rows. Other columns, whatever their names, stay
    inside row.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.array().cast(_MATCHES).alias("matches"))
    schema = StructType([rows.schema["row"], StructField("matches", _MATCHES), StructField("n_words", LongType()), StructField("n_hit", LongType())])
    last = None
    for block in _blocks(benchmark, item_col, item_text, block_bytes):
        if last:
            rows = cut(rows)  # so that no task holds two blocks
            last.unpersist()
        rows = rows.select("row", "matches").mapInArrow(partial(_leaks, width=width, text=text_col, block=block), schema)
        last = block
    return rows


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (struct of the columns of docs), items, n_words, n_hit for every row of docs: as find_leaks, but for the matches only the
    ids of the items that have any, each once (items that share an id too), in no order. A phrase that many items and many documents have makes a pair
    of each document and item, not of all their places. Odd rows are handled as there."""
    ship(docs.sparkSession)
    spans = "array<struct<start: long, length: long>>"
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.array().cast("array<string>").alias("items"), F.array().cast(spans).alias("spans"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL(f"items array<string>, spans {spans}, n_words long, n_hit long").fields])
    last = None
    for block in _blocks(benchmark, item_col, item_text, block_bytes):
        if last:
            rows = cut(rows)  # so that no task holds two blocks
            last.unpersist()
        rows = rows.select("row", "items", "spans").mapInArrow(partial(_leaked_items, width=width, text=text_col, block=block), schema)
        last = block
    return rows.select("row", F.array_distinct("items").alias("items"), "n_words", "n_hit")


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs; see find_items."""
    found = find_items(docs.select(*dict.fromkeys([id_col, settings.get("text_col", "text")])), benchmark, **settings)
    items = F.array_sort(F.filter("items", lambda x: x.isNotNull()))
    out = found.select(F.col("row")[id_col].alias("doc_id"), "n_words", "n_hit", items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs that share no window with the benchmark."""
    return find_items(docs, benchmark, **settings).where("n_hit = 0").select("row.*")
