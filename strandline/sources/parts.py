"""Verification of stored files by parts: footers of Parquet files, and a tree of digests that tells which files changed.

Files lie in the leaves of the tree by the first digits of a digest of their path; a leaf's digest is that of its files' paths,
lengths and digests in order, an inner node's that of its children. Two trees are compared from the root down, along nodes that
differ. Against a tree that is trusted, one file can be held by hashing it alone: the digests of the others are those that the
tree was made of.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from .ranges import BUFFER, Part, Work, _Reader, _source, file_ranges, packed


class FooterReader(_Reader):
    COLUMNS = (("path", pa.string()), ("length", pa.int64()), ("row_group", pa.int32()), ("rows", pa.int64()), ("column", pa.string()), ("codec", pa.string()), ("dictionary", pa.bool_()), ("nulls", pa.int64()), ("least", pa.string()), ("most", pa.string()), ("status", pa.string()))

    def partitions(self) -> list[Work]:
        # a footer is read, not the file
        return packed([Part(p, n, 0, BUFFER) for p, n in self.files() if p.endswith(".parquet")])

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            rows: list[tuple] = []
            with self.stream(part.path) as f:
                try:
                    meta = pq.read_metadata(f)
                except pa.ArrowInvalid:
                    rows.append((part.path, part.length, *[None] * 8, "NO_FOOTER"))
                else:
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        for c in range(group.num_columns):
                            column = group.column(c)
                            s = column.statistics if column.is_stats_set else None
                            bounds = (str(s.min), str(s.max)) if s and s.has_min_max else (None, None)
                            rows.append((part.path, part.length, g, group.num_rows, column.path_in_schema, column.compression, column.has_dictionary_page or any("DICT" in e for e in column.encodings), s.null_count if s and s.has_null_count else None, *bounds, "OK"))
            columns = zip(*rows, strict=True) if rows else [[]] * len(self.COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, self.COLUMNS, strict=True)], [n for n, _ in self.COLUMNS])


class Footers(DataSource):
    """A row for each column of each row group of the Parquet files below `root`; NO_FOOTER for a file that has none."""

    @classmethod
    def name(cls) -> str:
        return "strandline_footers"

    def schema(self) -> str:
        return "path string, length long, row_group int, rows long, column string, codec string, dictionary boolean, nulls long, least string, most string, status string"

    def reader(self, schema: StructType) -> FooterReader:
        return FooterReader(self.options)


def footers(spark: SparkSession, root: str) -> DataFrame:
    """path, length, row_group, rows, column, codec, dictionary, nulls, least, most (bounds as text), status; footers only are read."""
    return _source(spark, Footers, root=root)


def layout_violations(found: DataFrame, rows_per_group: int, codec: str = "ZSTD", sort_key: str | None = None, kind: str = "string") -> DataFrame:
    """rule, path, row_group of footers that aren't as tables are stored: NO_FOOTER, GROUP_TOO_LARGE, GROUP_TOO_SMALL (another
    than the file's last), CODEC, DICTIONARY, KEY_OVERLAPS (a group begins before the one before ends, by the sort key, read
    as `kind`; groups without bounds are left out)."""
    groups = found.where("status = 'OK'").groupBy("path", "row_group").agg(F.max("rows").alias("rows"), F.bool_or(F.col("codec") != codec).alias("other"), F.bool_or("dictionary").alias("dictionary"))
    last = F.max("row_group").over(Window.partitionBy("path"))
    rules = {"GROUP_TOO_LARGE": F.col("rows") > rows_per_group, "GROUP_TOO_SMALL": (F.col("rows") < rows_per_group) & (F.col("row_group") < last), "CODEC": F.col("other"), "DICTIONARY": F.col("dictionary")}
    named = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    out = groups.select(named.alias("r"), "path", "row_group").select(F.explode("r").alias("rule"), "path", "row_group")
    out = out.union(found.where("status <> 'OK'").select(F.col("status").alias("rule"), "path", "row_group"))
    if sort_key is not None:
        keys = found.where((F.col("column") == sort_key) & F.col("least").isNotNull())
        before = F.max(F.col("most").cast(kind)).over(Window.partitionBy("path").orderBy("row_group").rowsBetween(Window.unboundedPreceding, -1))
        out = out.union(keys.withColumn("__m", before).where(F.col("__m") > F.col("least").cast(kind)).select(F.lit("KEY_OVERLAPS").alias("rule"), "path", "row_group"))
    return out


def digest_tree(files: DataFrame, depth: int = 2) -> DataFrame:
    """level, node (its first digits), sha256, n_files of the tree over files (path, length, sha256), level 0 being the root.

    A leaf holds the files whose path's digest begins with `depth` hexadecimal digits: choose it so that these are a few
    hundred. Without files there are no nodes."""
    line = F.concat_ws(":", F.octet_length("path"), "path", "length", "sha256")
    leaves = files.select(F.substring(F.sha2("path", 256), 1, depth).alias("node"), line.alias("line"))
    nodes = leaves.groupBy("node").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("sha256"), F.count("*").alias("n_files"))
    out = nodes.select(F.lit(depth).alias("level"), "node", "sha256", "n_files")
    for level in range(depth - 1, -1, -1):
        nodes = nodes.select(F.substring("node", 1, level).alias("up"), F.concat_ws(":", "node", "sha256").alias("line"), "n_files")
        nodes = nodes.groupBy("up").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("sha256"), F.sum("n_files").alias("n_files")).withColumnRenamed("up", "node")
        out = out.union(nodes.select(F.lit(level).alias("level"), "node", "sha256", "n_files"))
    return out


def differing_leaves(a: DataFrame, b: DataFrame, depth: int = 2) -> DataFrame:
    """The nodes of the deepest level at which two trees differ, found from the root down: below equal nodes nothing is read."""
    at = None
    for level in range(depth + 1):
        x, y = (t.where(F.col("level") == level).select("node", F.col("sha256").alias(c)) for t, c in ((a, "__a"), (b, "__b")))
        if at is not None:
            x, y = (t.join(at, F.substring("node", 1, level - 1) == F.col("__up"), "left_semi") for t in (x, y))
        at = x.join(y, "node", "full").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(F.col("node").alias("__up"))
    return at.withColumnRenamed("__up", "node")


def changed_files(listed: DataFrame, found: DataFrame, depth: int = 2) -> DataFrame:
    """path, state (CHANGED, MISSING, UNLISTED) of files (path, length, sha256) that aren't as listed: trees of both are compared, and only
    files in leaves that differ."""
    leaf = F.substring(F.sha2("path", 256), 1, depth)
    wrong = differing_leaves(digest_tree(listed, depth), digest_tree(found, depth), depth).withColumnRenamed("node", "__leaf")
    x, y = (t.select("path", F.struct("length", "sha256").alias(c), leaf.alias("__leaf")).join(wrong, "__leaf", "left_semi") for t, c in ((listed, "__a"), (found, "__b")))
    both = x.select("path", "__a").join(y.select("path", "__b"), "path", "full").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return both.select("path", F.when(F.col("__b").isNull(), "MISSING").when(F.col("__a").isNull(), "UNLISTED").otherwise("CHANGED").alias("state"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), length, sha256 of the files below root."""
    below = F.expr("substring(path, length(root) + 2)")
    return file_ranges(spark, root, 0).withColumn("root", F.lit(root.rstrip("/"))).select(below.alias("path"), "length", "sha256")


def held_against(spark: SparkSession, root: str, listed: DataFrame, tree: DataFrame, paths: list[str], depth: int = 2) -> DataFrame:
    """path, state (OK, CHANGED, MISSING, UNLISTED, LISTING_DIFFERS) of a few files, for which just these are hashed: the
    listing's digests of all others have to give the tree."""
    full = f"{root.rstrip('/')}/"
    hashed = file_ranges(spark, root, 0).where(F.col("path").isin([full + p for p in paths])).select(F.substring("path", len(full) + 1, 1 << 20).alias("path"), F.col("length").alias("l"), F.col("sha256").alias("h"))
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    agrees = differing_leaves(tree, digest_tree(listed, depth), depth).isEmpty()
    x = asked.join(listed, "path", "left").join(hashed, "path", "left")
    state = F.when(F.lit(not agrees), "LISTING_DIFFERS").when(F.col("sha256").isNull(), "UNLISTED").when(F.col("h").isNull(), "MISSING").when((F.col("h") == F.col("sha256")) & (F.col("l") == F.col("length")), "OK").otherwise("CHANGED")
    return x.select("path", state.alias("state"))
