"""Near-duplicate documents by SimHash, found by signatures with one bit left out.

A fingerprint of 64 bits is cut into distance // 2 + 1 segments, so that of two fingerprints no more than `distance`
bits apart one segment differs by a bit at most. Each segment gives one signature for each of its bits: the segment
without that bit. Two segments that differ in a bit agree in the signature without it, and equal ones in all, so
an equality join of signatures has every pair that is close enough; pairs are then held to their whole fingerprints.

- Texts with equal fingerprints are one node from the start, whatever their number.
- Signatures are counted before they are joined; those that only one node has go.
- A signature of up to SMALL nodes compares its nodes in place, and only links leave it. Nodes of a larger one are keyed
  again by what is left of the whole fingerprint without `distance` bits: that has at most 2**distance nodes, all of which
  are linked, so there is nothing to compare and no group to hold. A node has C(64, distance) such keys at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, join_summary, ship
from .components import connected_components

BITS, SEED = 64, 42
#: Signatures of up to so many nodes compare them in place.
SMALL = 64
#: Nodes whose signatures one task makes, unless that gives more than TASKS tasks.
NODES, TASKS = 16_384, 50_000
#: A text is hashed in blocks of about so many bytes.
BLOCK_BYTES = 1 << 18
_SPACE = b" \t\n\v\f\r"


def _blocks(data: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of data, in blocks of about that many bytes; a word is in one block."""
    i, n = 0, len(data)
    while i < n:
        j = min(i + size, n)
        while j < n and data[j] not in _SPACE:
            j += 1
        yield data[i:j].split()
        i = j


def fingerprint(text: str | None, width: int = 3, block_bytes: int = BLOCK_BYTES) -> int:
    """Each bit is 1 if it is in over half the XXH64 hashes of the shingles, repeats included; 0 without words."""
    ones, n, before = np.zeros(BITS, np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    for words in _blocks(text.encode().lower() if text else b"", block_bytes):  # bytes.lower() folds A-Z alone
        words = before + words
        h = [hashed(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]
        before = words[max(0, len(words) - width + 1) :]
        if h:
            ones += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n += len(h)
    if not n and before:
        return hashed(b" ".join(before), SEED)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    at = [BITS * k // (distance // 2 + 1) for k in range(distance // 2 + 2)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(distance: int) -> list[int]:
    """What each signature keeps of a fingerprint."""
    return [_signed(((1 << bits) - 1 << first) & ~(1 << first + i)) for first, bits in segments(distance) for i in range(bits)]


def _deletions(distance: int) -> list[int]:
    """What is kept of a fingerprint without `distance` of its bits, for each choice of them."""
    return [_signed(((1 << BITS) - 1) & ~sum(1 << b for b in gone)) for gone in combinations(range(BITS), distance)]


def _keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """fp, k, value: what the k-th mask keeps of each fingerprint."""
    kept = F.transform(F.lit(np.array(masks, np.int64)), lambda m: F.col("fp").bitwiseAND(m))
    return nodes.select("fp", F.posexplode(kept).alias("k", "value"))


def _shared(nodes: DataFrame, distance: int) -> DataFrame:
    """fp, key, c: signatures of nodes and how many nodes have them, where it is more than one.

    A signature is hashed to one number; should two meet in it, that adds pairs to be compared."""
    keyed = _keyed(nodes, _masks(distance)).select("fp", F.xxhash64("k", "value").alias("key"))
    return join_summary(keyed, keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key", grown=True)


def _close(x: Column, y: Column, distance: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= distance


def links(nodes: DataFrame, distance: int = 2, small: int = SMALL) -> DataFrame:
    """a, b: pairs of the fingerprints of nodes (fp, distinct) by which all that are at most that far apart hang together.

    Every such pair is listed, but for those whose every signature is larger than `small`: of these, each group of fingerprints that are equal
    without `distance` bits has one lead, with which the others are paired. Pairs may be repeated."""
    nodes = nodes.repartition(min(TASKS, 1 + nodes.count() // NODES))
    met = cut(_shared(nodes, distance))
    groups = met.where(F.col("c") <= small).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("g"))
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(F.filter(F.slice("g", i + 2, F.lit(small)), lambda y: _close(x, y, distance)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    found = groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    crowded = met.where(F.col("c") > small).select("fp").distinct()
    again = _keyed(crowded, _deletions(distance))
    leads = again.groupBy("k", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_set("fp").alias("g")).where("a <> z")
    return found.union(leads.select("a", F.explode("g").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, small: int = SMALL) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number), fingerprint (16 hexadecimal digits), component_id of every row of docs.

    Words are runs of non-space characters, with A-Z lower-cased; shingles of `width` words, repeats included, are
    joined by a space; fewer words are one shingle. Documents are linked if their fingerprints differ in at most
    `distance` bits; component_id is the least id that links reach.

    Null and empty texts, and those without words, have fingerprint 0 and are linked like any other. Rows with a null id
    are returned with a null component and link nothing. Repeated rows are copies of each other. An id that occurs with
    several texts has a row for each, which links on its own account. A very long text is one row's work, hashed in
    blocks. A bit that half the hashes have is 0. Other columns are ignored. No rows in, no rows out.
    """
    if not 1 <= distance <= 3:
        raise ValueError("distance must be 1, 2 or 3: a crowded fingerprint has as many keys as there are choices of so many bits")
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = cut(texts.mapInArrow(partial(_fingerprints, width=width), "id long, fp long"))
    nodes = cut(seen.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    groups = connected_components(links(nodes.select("fp"), distance, small), "a", "b")
    grouped = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("g"))
    least = grouped.groupBy("g").agg(F.min("id").alias("least"))
    named = cut(join_summary(grouped, least, "g", grown=True).select("fp", "least"))
    free(nodes)
    # what rows meet here has one row for each fingerprint, so a frequent one is safe
    out = join_summary(seen, named, "fp", how="left", grown=True)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("id").alias("doc_id"), "fp", digits.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("least")).alias("component_id"))
