"""Near-duplicate documents by MinHash with tensored banding.

Two collections of half keys are computed for a text, each key from a few MinHash values. A table key joins one half
key of either collection, so halves * halves tables cost only 2 * halves * rows MinHash values: at 14 and 4, 196 tables
of 8 rows from 112 values instead of 1568. Two sets of similarity s share no table with a chance of at most
2 * (1 - s**rows)**halves: 0.001 at s = 0.8, falling fast above; sets that have little in common hardly ever share one.

Pairs that share a table are candidates. They are compared on their full shingle sets, and accepted links are closed
into components.

- Texts with equal sets are one node from the start, whatever their number; a node is known by its set's digest.
- A half key that only one node has can't be part of a shared table; it goes before tables are formed.
- A table of up to SMALL nodes lists its pairs. In larger ones, candidates are found by a condition that every similar
  pair meets: with shingles in order, those that fewest nodes have first, the smaller set has one of its first few
  (index) that is among the first few of the larger one (probe). Texts with the same boilerplate differ in rare
  shingles, fill these places with them and never meet, so a table of texts that aren't similar costs no pairs. Each
  pair found has to share a table, too, so both ways give the same candidates but for those that can't be similar.
- Where many nodes do meet, each is first compared with a few leads, which leaves most in one component. Nodes that still
  meet some of another component are then compared, those outside the largest one with all, in blocks of about BLOCK
  by BLOCK nodes that any task can take; a block is a product of matrices, and only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, join_summary, ship
from .components import connected_components
from .textbytes import SPACED, Words, buffers, constants, mix, runs, shingles

#: Tables of up to so many nodes list their pairs; pairs of larger ones are found by rare shingles. LEADS: how many nodes
#: each is compared with at first; what that leaves apart is compared in any case. BLOCK: nodes on either side of a block.
SMALL, LEADS, BLOCK = 16, 8, 512
#: Columns of the incidence matrices that blocks multiply at once.
COLUMNS = 4096


def _digests(u: np.ndarray, at: np.ndarray) -> pa.Array:
    """16 bytes for each set, null for an empty one."""
    some = np.flatnonzero(np.diff(at))
    s = np.zeros((len(at) - 1, 2), np.uint64)
    if len(some):
        salt, begin = constants(21, 1)[0], at[:-1][some]
        s[some, 0], s[some, 1] = np.add.reduceat(mix(u), begin), np.add.reduceat(mix(u ^ salt), begin)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(s), [None, pa.py_buffer(s.astype(">u8").tobytes())])
    return pa.array([x if n else None for x, n in zip(fixed.to_pylist(), np.diff(at).tolist(), strict=True)], pa.binary())


def _signatures(batches: Iterator[pa.RecordBatch], width: int, halves: int, rows: int) -> Iterator[pa.RecordBatch]:
    values = 2 * halves * rows
    add, times, join = constants(25, values), constants(22, values), constants(23, rows)
    tag = constants(24, 2 * halves)
    for batch in batches:
        data, off = buffers(batch.column(1))
        for i, j in runs(off):
            u, at = shingles(Words(data[off[i] : off[j]], off[i : j + 1] - off[i], SPACED), width)
            some = np.flatnonzero(np.diff(at))
            k = np.zeros((j - i, 2 * halves), np.uint64)
            if len(some):
                begin, v = at[:-1][some], np.empty_like(u)
                for half in range(2 * halves):
                    key = np.full(len(some), tag[half])
                    for r in range(rows):
                        x = half * rows + r
                        np.bitwise_xor(u, add[x], out=v)
                        np.multiply(v, times[x], out=v)
                        key += np.minimum.reduceat(v, begin) * join[r]
                    # the lowest bit names the collection
                    k[some, half] = mix(key) << np.uint64(1) | np.uint64(half >= halves)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, 2 * halves, dtype=np.int32)), pa.array(k.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), _digests(u, at), lists], ["id", "n", "node", "halves"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(0))
        for i, j in runs(off):
            u, at = shingles(Words(data[off[i] : off[j]], off[i : j + 1] - off[i], SPACED), width)
            yield pa.RecordBatch.from_arrays([_digests(u, at), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(u.view(np.int64)))], ["node", "shingles"])


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _side(halves: Column, k: int) -> Column:
    return F.filter(halves, lambda x: x.bitwiseAND(F.lit(1)) == k)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a table and whose whole sets are similar enough. sets: node, halves, shingles."""
    one, two = (sets.select(F.col("node").alias(p), F.col("halves").alias(f"h{p}"), F.col("shingles").alias(f"s{p}")) for p in "ab")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    table = F.arrays_overlap(_side(F.col("ha"), 0), _side(F.col("hb"), 0)) & F.arrays_overlap(_side(F.col("ha"), 1), _side(F.col("hb"), 1))
    return pairs.join(one, "a").join(two, "b").where(table & (both * 100 >= (F.size("sa") + F.size("sb") - both) * percent)).select("a", "b")


def _block(block: pa.Table, percent: int) -> pa.Table:
    """Links between the outside nodes and the others of a block: pairs that share a table and are similar enough, one for
    each two components."""
    block = block.combine_chunks()
    outside, node, g = block["outside"].to_numpy(), block["node"].to_pylist(), block["g"].to_pylist()
    lists, halves = (block[c].chunk(0) if block[c].num_chunks else pa.array([], pa.list_(pa.int64())) for c in ("shingles", "halves"))
    n = lists.value_lengths().to_numpy()
    row, (value, column) = np.repeat(np.arange(len(n)), n), np.unique(lists.flatten().to_numpy(), return_inverse=True)
    met = (np.bincount(column, outside[row], len(value)) > 0) & (np.bincount(column, ~outside[row], len(value)) > 0)
    keep = met[column]
    row, column = row[keep], (np.cumsum(met) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, others = np.flatnonzero(outside), np.flatnonzero(~outside)
    both = np.zeros((len(out), len(others)), np.float32)
    for first in range(0, int(met.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(n), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        both += part[out] @ part[others].T
    x, y = np.nonzero(both * 100 >= percent * (n[out][:, None] + n[others][None, :] - both))
    tables = [({h for h in v if not h & 1}, {h for h in v if h & 1}) for v in halves.to_pylist()]
    found = {}
    for i, j in zip(out[x].tolist(), others[y].tolist(), strict=True):
        pair = (g[i], g[j])
        if g[i] != g[j] and pair not in found and tables[i][0] & tables[j][0] and tables[i][1] & tables[j][1]:
            found[pair] = (node[i], node[j])
    return pa.table({"a": pa.array([a for a, _ in found.values()], pa.binary()), "b": pa.array([b for _, b in found.values()], pa.binary())})


def _crowds(large: DataFrame) -> DataFrame:
    """node, crowd of the nodes of tables (key, node) that hang together: pairs that share a table are in one crowd.

    Of a node's tables, the least of their least nodes stands for it, and each of the others is tied to that one, so a
    large group has few more links than nodes."""
    least = large.groupBy("key").agg(F.min("node").alias("lead"))
    seen = join_summary(large, least, "key").groupBy("node").agg(F.min("lead").alias("m"), F.collect_set("lead").alias("leads"))
    ties = seen.select("node", "m").union(seen.select(F.explode("leads"), "m")).distinct()
    groups = connected_components(ties, "node", "m")
    return large.select("node").distinct().join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("crowd"))


def _places(sets: DataFrame, percent: int) -> DataFrame:
    """crowd, shingle, node, n, index of the shingles by which nodes of a crowd can find each other.

    sets: crowd, node, shingles. Shingles go by how many nodes of the crowd have them, then by their hash. Of two sets
    as similar as percent, of sizes a <= b, the first shingle they share is among the first a - ceil(2t / (1 + t) a) + 1
    of the smaller (index) and the first b - ceil(t b) + 1 of the larger; those that one node has alone take up
    places and make no rows."""
    each = sets.select("crowd", "node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    shared = each.groupBy("crowd", "shingle").agg(F.count("*").alias("c")).where("c > 1")
    mine = join_summary(each, shared, "crowd", "shingle", grown=True).groupBy("crowd", "node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("s"))
    up = lambda num, den: F.ceil(F.col("n") * num / den - F.lit(1e-9)).cast("long")
    mine = mine.withColumn("alone", F.col("n") - F.size("s")).withColumn("probe", F.col("n") - up(percent, 100) + 1).withColumn("index", F.col("n") - up(2 * percent, 100 + percent) + 1)
    taken = F.slice("s", F.lit(1), F.greatest(F.lit(0), F.col("probe") - F.col("alone")).cast("int"))
    return mine.select("crowd", "node", "n", (F.col("index") - F.col("alone")).alias("k"), F.posexplode(taken).alias("i", "x")).select("crowd", "node", "n", F.col("x.shingle").alias("shingle"), (F.col("i") < F.col("k")).alias("index"))


def _by_rare_shingles(large: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """links, and those between nodes of the large tables; see the module's text."""
    at = ["crowd", "shingle"]
    places = cut(_places(sets.join(_crowds(large), "node").select("crowd", "node", "shingles"), percent))
    # some nodes of each place, as a hash deals them out
    leads = places.groupBy(*at, F.pmod(F.xxhash64("node"), F.lit(LEADS)).alias("k")).agg(F.min(F.struct("node", "n", "index")).alias("l")).groupBy(*at).agg(F.collect_list("l").alias("l"))
    met = (F.col("node") != F.col("l.node")) & (F.col("index") | F.col("l.index")) & _sizes_allow(F.col("n"), F.col("l.n"), percent)
    # a group is what one node has, no more than its shingles times LEADS
    stars = join_summary(places, leads, *at).withColumn("l", F.explode("l")).where(met).groupBy("node").agg(F.collect_set("l.node").alias("l"))
    stars = stars.select(F.explode(F.slice(F.sort_array(F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, LEADS)).alias("l"), F.col("node").alias("b")).select(F.col("l.x").alias("a"), "b")
    starred = cut(links.union(_similar(stars, sets, percent)))
    labelled = places.join(connected_components(starred, "a", "b"), "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")
    mixed = labelled.groupBy(*at).agg((F.min("g") != F.max("g")).alias("mixed")).where("mixed").drop("mixed")
    left = cut(join_summary(labelled, mixed, *at).select("crowd", "node", "g").distinct())
    free(places)
    sizes = left.groupBy("crowd", "g").agg(F.count("*").alias("c")).groupBy("crowd").agg(F.max_by("g", F.struct("c", "g")).alias("largest"), F.sum("c").alias("all"), F.max("c").alias("most"))
    if left.isEmpty():
        return starred
    x = join_summary(left, sizes, "crowd").join(sets, "node")
    rows, columns = (F.ceil(c / BLOCK).cast("int") for c in (F.col("all") - F.col("most"), F.col("all")))
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    kept = ("node", "g", "halves", "shingles")
    one = x.where(F.col("g") != F.col("largest")).select("crowd", place(rows).alias("i"), F.explode(every(columns)).alias("j"), F.lit(True).alias("outside"), *kept)
    two = x.select("crowd", F.explode(every(rows)).alias("i"), place(columns).alias("j"), F.lit(False).alias("outside"), *kept)
    return starred.union(one.union(two).groupBy("crowd", "i", "j").applyInArrow(lambda block: _block(block, percent), "a binary, b binary"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, halves: int = 14, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Words are runs of non-space characters, with A-Z lower-cased; a document's set holds its distinct shingles of
    `width` words, or its whole sequence of words if there are fewer. Documents are linked if 100 * intersection >=
    percent * union; component_id is the least id that links reach.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows with a null id
    are returned with a null component and kept. Repeated rows are copies of each other: all carry the same component,
    and those with the least id are kept. An id that occurs with several texts has a row for each, which links on its
    own account, and a text that is linked to any of them gets an id no larger than that one. A very long text is one
    row's work, with memory in proportion to it. Ties of ids don't arise; other columns are ignored. No rows in, no
    rows out.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = cut(texts.mapInArrow(partial(_signatures, width=width, halves=halves, rows=rows), "id long, n long, node binary, halves array<long>"))
    nodes = cut(seen.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("halves").alias("halves")))

    half = nodes.select("node", "n", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    kept = join_summary(half, shared, "half", grown=True).groupBy("node", "n").agg(F.collect_list("half").alias("halves"))
    keyed = kept.select("node", "n", F.explode(F.flatten(F.transform(_side(F.col("halves"), 0), lambda x: F.transform(_side(F.col("halves"), 1), lambda y: F.xxhash64(x, y))))).alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    tables = cut(join_summary(keyed, full, "key", grown=True).select("key", "node", "n", "c"))

    # the sets of nodes that share a table; an id may have other texts, too
    wanted = nodes.join(tables.select("node").distinct(), "node", "left_semi")
    found = texts.join(wanted.select("id"), "id", "left_semi").select("text").mapInArrow(partial(_sets, width=width), "node binary, shingles array<long>").dropDuplicates(["node"])
    sets = cut(found.join(wanted.select("node", "halves"), "node"))

    few = tables.where(F.col("c") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("g")).select("g").distinct()
    few = few.select("g", F.posexplode("g").alias("i", "x")).select("x", F.explode(F.slice("g", F.col("i") + 2, F.lit(SMALL))).alias("y"))
    pairs = few.where(_sizes_allow(F.col("x.n"), F.col("y.n"), percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    links = cut(_similar(pairs.distinct(), sets, percent))
    large = tables.where(F.col("c") > SMALL)
    if not large.isEmpty():
        links = _by_rare_shingles(large, sets, links, percent)
    groups = connected_components(links, "a", "b")
    free(tables, sets)

    grouped = nodes.join(groups, "node", "left").select("node", "id", F.coalesce("component", "node").alias("g"))
    least = grouped.groupBy("g").agg(F.min("id").alias("least"))
    named = cut(join_summary(grouped, least, "g").select("node", "least"))
    free(nodes)
    # what texts meet here has one row for each set, so a frequent set is safe
    out = join_summary(seen.where("node is not null").select("id", "n", "node"), named, "node", how="left").select("id", "n", "least").unionByName(seen.where("node is null").select("id", "n", F.col("id").alias("least")))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.least("least", "id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs without near-duplicates: of each component the document with the least id stays; all columns are kept.

    Rows with a null id stay; so do repeated rows of the document that stays. Of an id with several texts all rows stay
    or go together: they go if any of them belongs to a group with a smaller id.
    """
    gone = near_duplicates(docs, id_col, text_col, **settings).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    return kept
