"""The trie of all prefixes of conversations, merged from the small tries of families.

Conversations with equal base ids are a family, and each is rebuilt: it begins with the first turns of the base
conversation and goes on with its own. Families are put together by their ids alone, their rows in order, and read as a
stream: of the base conversation its first few turns are held, of the family its trie. A node is known by a digest of its
turns, made from its parent's digest, so equal prefixes of different families meet by it; texts stay in the family.
Only nodes of families, each with the members it has there, are shuffled to be merged.

Sums over subtrees need no walk down the merged trie. Each node is owned by its least member, and a conversation owns
the end of its path, from some depth on. What a conversation adds to the words of distinct nodes below any node of
its path is what it owns, so if `shared` is the count of words on its path above that, the saved words of a node v are a sum over
members alone: that of max(0, shared - words above v). Leaves are counted the same way, each by the conversation that owns it.
That sum is made in the families again, and merged by node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_summary, ship

#: Conversations of a family, and how many turns of the base one at most begin another.
FAMILY, MOST_BEGUN = 20, 3
#: A family's trie is handed on when it has so many nodes; what follows begins another one, and both are merged.
NODES = 20_000
#: Ids that agree but for so many bits are one part of a list of ends.
ENDS_BITS = 10
ROOT = hashlib.sha256(b"").digest()[:16]
_FIELDS = "base long, node binary, parent binary, depth long, words long, above long, members array<long>, ends array<long>"


def begun(conv_id: int) -> int:
    """How many turns of the base conversation begin this one."""
    return zlib.crc32(str(conv_id).encode()) % (MOST_BEGUN + 1)


def child(parent: bytes, role: str, text: bytes) -> bytes:
    """Digest of a prefix that has one turn more."""
    r = role.encode()
    return hashlib.sha256(parent + len(r).to_bytes(8, "big") + r + text).digest()[:16]


class Family:
    """Trie of the conversations of one base id: node -> (parent, depth, words, words above, members, members that end here)."""

    def __init__(self, base: int):
        self.base, self.opening = base, []
        self.nodes: dict[bytes, tuple[bytes | None, int, int, int, list[int], list[int]]] = {}

    def begin(self, conv_id: int) -> None:
        self.at, self.above, self.conv = ROOT, 0, conv_id
        self._member(None, 0, 0)
        self.skip = begun(conv_id)
        for role, text in self.opening[: self.skip]:
            self.turn(role, text)
        self.seen = 0

    def _member(self, parent: bytes | None, depth: int, words: int) -> None:
        self.last = (parent, depth, words, self.above)
        self.nodes.setdefault(self.at, (*self.last, [], []))[4].append(self.conv)

    def turn(self, role: str, text: bytes) -> None:
        parent, self.at = self.at, child(self.at, role, text)
        words = len(text.split())  # of bytes: at \x20 and \x09-\x0D
        self._member(parent, self.last[1] + 1, words)
        self.above += words

    def own(self, role: str, text: bytes) -> None:
        """The next of the conversation's own turns, those of the base conversation first."""
        if self.conv == self.base and len(self.opening) < MOST_BEGUN:
            self.opening.append((role, text))
            if self.seen < self.skip:  # of the base conversation these are the same
                self.turn(role, text)
        if self.seen >= self.skip:
            self.turn(role, text)
        self.seen += 1

    def end(self) -> None:
        # if the trie has been handed on since its last turn, the node is there once more
        self.nodes.setdefault(self.at, (*self.last, [], []))[5].append(self.conv)

    def rows(self) -> list[tuple]:
        out = [(self.base, node, *x) for node, x in self.nodes.items()]
        self.nodes = {}
        return out


def _tries(batches: Iterator[pa.RecordBatch], nodes: int) -> Iterator[pa.RecordBatch]:
    """Columns base, conv, role, text, a family's rows together, the base conversation first, turns in order."""
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    out: list[tuple] = []
    family, conv = None, None

    def batch() -> pa.RecordBatch:
        nonlocal out
        columns, out = list(zip(*out, strict=True)) or [[]] * len(names), []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for rows in batches:
        for base, c, role, text in zip(*(x.to_pylist() for x in rows.columns), strict=True):
            if family is None or base != family.base:
                if family is not None:
                    family.end()
                    out += family.rows()
                family, conv = Family(base), None
            if c != conv:
                if conv is not None:
                    family.end()
                family.begin(c)
                conv = c
            family.own(role, text.encode())
            if len(family.nodes) >= nodes:
                out += family.rows()
            if len(out) >= nodes:
                yield batch()
    if family is not None:
        family.end()
        out += family.rows()
    yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns node, ids (text of some ids): a row for each node, whose rows are together and in order."""
    node, digest = None, None
    for rows in batches:
        done: list[tuple[bytes, str]] = []
        for key, ids in zip(*(x.to_pylist() for x in rows.columns), strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield _ends_batch(done)
    yield _ends_batch([] if node is None else [(node, digest.hexdigest())])


def _ends_batch(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])


def _end_digests(families: DataFrame) -> DataFrame:
    """node, ends_sha256 of nodes at which conversations end. Ids are joined in parts of a bounded size, wherever their rows
    lie; a node's parts are then hashed one after the other, none of them held."""
    ends = families.select("node", F.explode("ends").alias("conv")).withColumn("part", F.shiftright("conv", ENDS_BITS))
    parts = ends.groupBy("node", "part").agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return parts.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(_digests, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family_nodes: int = NODES) -> DataFrame:
    """node, parent (digests), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of
    every distinct prefix of rebuilt conversations, the root of depth 0 included.

    Turns go by turn_col, null first; of equal ones by role, then text. Null role or text is empty, an empty turn is
    a turn. Conversation c is rebuilt from the first h turns of conversation c - c % 20, h = crc32(c as text) % 4, and its
    own turns after its first h, either of which may be none. A row without conversation id is part of none and is left
    out; repeated rows are turns of their own; other columns are ignored. Without rows there are no nodes. Prefixes are
    equal if 128 bits of SHA-256 are. A conversation is read by one task, as a stream: it holds one text and at most family_nodes nodes.
    """
    ship(conversations.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).where("conv is not null")
    turns = turns.withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    in_order = turns.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "role", "text")
    families = cut(in_order.select("base", "conv", "role", "text").mapInArrow(partial(_tries, nodes=family_nodes), _FIELDS))

    merged = families.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("above").alias("above"), F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members")).cast("long").alias("n_convs"))
    nodes = cut(merged)
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    counted = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))

    # for each conversation the words above what it owns, and whether it owns a leaf
    owned = counted.groupBy(F.col("conv_id").alias("conv")).agg(F.min("above").alias("above"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    ended = families.select("node", "base", F.explode("ends").alias("conv"))
    last = join_summary(ended, nodes.select("node", (F.col("above") + F.col("words")).alias("whole")), "node")
    facts = last.join(owned, "conv", "left").groupBy("base").agg(F.collect_list(F.struct("conv", F.coalesce("above", "whole").alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))).alias("facts"))
    mine = F.filter("facts", lambda x: F.array_contains("members", x["conv"]))
    zero = F.lit(0).cast("long")
    # a family has few conversations, so its list of facts is small
    parts = join_summary(families.where(F.size("members") > 0).select("base", "node", "above", "members"), facts, "base").select(
        "node",
        F.aggregate(mine, zero, lambda a, x: a + F.greatest(zero, x["shared"] - F.col("above"))).alias("saved"),
        F.aggregate(mine, zero, lambda a, x: a + x["leaf"]).alias("leaves"),
    )
    sums = parts.groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = join_summary(counted, parents, "parent", how="left").join(sums, "node").join(_end_digests(families), "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def trie_report(conversations: DataFrame) -> DataFrame:
    """The nodes of prefix_trie without their digests."""
    return prefix_trie(conversations).drop("node", "parent")
