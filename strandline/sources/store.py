"""Immutable snapshots: sorted Parquet tables, a manifest with digests, a pointer to the current one, and replay.

Everything is written and read by Spark, so a store may lie wherever Spark can write. A snapshot is a folder under
snapshots/. Its id is reserved first, by a file that must not exist, so that of two publishers of one id one is refused. It counts
as published once a row of the log names it: rows are numbered, each number being reserved the same way, and Spark puts
a log file in place whole or not at all. A crash leaves the snapshot before as the current one, and a folder that nothing
names; `abandon` gives its id free.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sequences import row_digest, sequence_hash
from ..schemas import SORT_KEYS, fingerprint
from .files import create_new, delete

_LOG = "name string, number long, note string"


def canonical_json(value) -> str:
    """Sorted keys, two spaces, no NaN, a line end."""
    return json.dumps(value, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a folder of one file."""
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def _append(spark: SparkSession, path: str, name: str, note: str) -> None:
    """Add a row with the next number. Writers that meet get different ones: a number is a file that one of them made."""
    number = 1 + (_log(spark, path).agg(F.max("number")).first()[0] or 0)
    while not create_new(spark, f"{path}_numbers/{number:012d}"):
        number += 1
    spark.createDataFrame([(name, number, note)], _LOG).coalesce(1).write.mode("append").json(path)


def _log(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, number, note) of a log in order; none if it doesn't exist yet."""
    try:
        return spark.read.schema(_LOG).json(path).orderBy("number")
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def semantic_hash(df: DataFrame) -> str:
    """Digest of a table's schema and rows (as a multiset) that no order or partitioning changes.

    The four quarters of the rows' digests are added up, exactly, in one aggregate with partial sums, and the sums and
    the count are hashed: one row comes to the driver, whatever the size (up to 10**18 rows)."""
    quarter = lambda k: F.conv(F.substring("h", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = df.select(row_digest(df).alias("h")).agg(F.count("*").alias("n"), *(F.sum(quarter(k)).cast("string").alias(f"s{k}") for k in range(4))).first()
    return hashlib.sha256(f"multiset-2\n{fingerprint(_plain(df.schema))}\n{':'.join(str(x) for x in sums)}\n".encode()).hexdigest()


def _plain(schema: StructType) -> StructType:
    """Names and types only: a reader makes every column nullable."""
    return StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))


def write_table(df: DataFrame, path: str, sort_keys: list[str], partition_by: list[str] | None = None, rows_per_group: int = 65_536) -> None:
    """Parquet in canonical order: range-partitioned and sorted by the keys, zstd, no dictionary, bounded row groups."""
    x = df.repartitionByRange(*(F.col(k).asc_nulls_last() for k in sort_keys)).sortWithinPartitions(*(F.col(k).asc_nulls_last() for k in [*(partition_by or []), *sort_keys]))
    w = x.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.row.count.limit", rows_per_group)
    (w.partitionBy(*partition_by) if partition_by else w).mode("overwrite").parquet(path)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], provenance: dict, snapshot_id: str, sort_keys: dict[str, list[str]] = SORT_KEYS) -> dict:
    """Reserve the id, write, measure what was written, then name it in the log; returns the manifest. An id that is
    reserved, by a snapshot that was published or one that is being written, is refused."""
    place = f"{root}/snapshots/{snapshot_id}"
    if not create_new(spark, f"{root}/reserved/{snapshot_id}"):
        raise FileExistsError(f"snapshot {snapshot_id} is there already")
    manifest: dict = {"snapshot_id": snapshot_id, "tables": {}, "provenance_sha256": hashlib.sha256(canonical_json(provenance).encode()).hexdigest()}
    for name, df in tables.items():
        write_table(df, f"{place}/{name}", sort_keys.get(name) or df.columns[:1])
        manifest["tables"][name] = _claims(spark.read.parquet(f"{place}/{name}"), sort_keys.get(name) or df.columns[:1])
    for name, document in (("provenance", provenance), ("manifest", manifest)):
        spark.createDataFrame([(canonical_json(document).removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/{name}.json")
    _append(spark, f"{root}/published", snapshot_id, "")
    return manifest


def abandon(spark: SparkSession, root: str, snapshot_id: str) -> None:
    """Delete what a crash left of a snapshot that wasn't published, and give its id free."""
    if not _log(spark, f"{root}/published").where(F.col("name") == snapshot_id).isEmpty():
        raise FileExistsError(f"snapshot {snapshot_id} was published")
    delete(spark, f"{root}/snapshots/{snapshot_id}")
    delete(spark, f"{root}/reserved/{snapshot_id}")


def _claims(df: DataFrame, order: list[str]) -> dict:
    return {"rows": df.count(), "schema": fingerprint(_plain(df.schema)), "semantic_sha256": semantic_hash(df), "sort_keys": order, "sequence_sha256": sequence_hash(df, order)}


def publish_bundle(spark: SparkSession, root: str, recording: str, tables: dict[str, DataFrame], sort_keys: dict[str, list[str]]) -> dict:
    """A recording's tables under bundles/<recording>, ended by one row of the log, SUCCESS with the tables' digests or,
    if writing or comparing with the source fails, FAILURE with the reason. A recording that has one is refused."""
    log, claims = f"{root}/bundles_ended", {}
    if not _log(spark, log).where(F.col("name") == recording).isEmpty():
        raise FileExistsError(f"{recording} has ended already")
    try:
        for name, df in tables.items():
            path = f"{root}/bundles/{recording}/{name}"
            write_table(df, path, sort_keys.get(name) or df.columns[:1])
            stored = spark.read.parquet(path)
            claims[name] = {"rows": stored.count(), "semantic_sha256": semantic_hash(stored)}
            if claims[name]["semantic_sha256"] != semantic_hash(df):
                raise ValueError(f"{name} was not stored as it is")
    except Exception as why:
        _append(spark, log, recording, json.dumps({"state": "FAILURE", "reason": type(why).__name__}))
        raise
    _append(spark, log, recording, json.dumps({"state": "SUCCESS", "tables": claims}, sort_keys=True))
    return claims


def ended(spark: SparkSession, root: str) -> DataFrame:
    """recording_id, state, reason of every bundle that has ended."""
    note = F.from_json("note", "state string, reason string")
    return _log(spark, f"{root}/bundles_ended").select(F.col("name").alias("recording_id"), note.alias("x")).select("recording_id", "x.state", "x.reason")


def ended_tables(spark: SparkSession, root: str) -> DataFrame:
    """recording_id, state, reason, table, rows, semantic_sha256 of every table of the bundles that have ended; one row, without a
    table, of a bundle that failed."""
    note = F.from_json("note", "state string, reason string, tables map<string, struct<rows: long, semantic_sha256: string>>")
    x = _log(spark, f"{root}/bundles_ended").select(F.col("name").alias("recording_id"), note.alias("x")).select("recording_id", "x.state", "x.reason", F.explode_outer("x.tables").alias("table", "t"))
    return x.select("recording_id", "state", "reason", "table", "t.rows", "t.semantic_sha256")


def unfinished(spark: SparkSession, root: str, recordings: DataFrame) -> DataFrame:
    """Recordings that haven't ended: what a run that goes on has to do."""
    return recordings.join(ended(spark, root), "recording_id", "left_anti")


def verify(spark: SparkSession, path: str) -> dict:
    """The manifest of a snapshot folder; raises where rows, schema, digests or provenance are not as it says."""
    manifest = json.loads(read_text(spark, f"{path}/manifest.json"))
    if hashlib.sha256(read_text(spark, f"{path}/provenance.json").encode()).hexdigest() != manifest["provenance_sha256"]:
        raise ValueError("provenance is not what the manifest says")
    for name, claim in manifest["tables"].items():
        found = _claims(spark.read.parquet(f"{path}/{name}"), claim["sort_keys"])
        if found != claim:
            raise ValueError(f"{name} is not what the manifest says: {[k for k in claim if found[k] != claim[k]]}")
    return manifest


class Snapshot:
    """The current snapshot of a store, or a named one."""

    def __init__(self, spark: SparkSession, root: str, snapshot_id: str | None = None, check: bool = True):
        last = _log(spark, f"{root}/published").orderBy(F.desc("number"))
        row = (last.where(F.col("name") == snapshot_id) if snapshot_id else last).first()
        if row is None:
            raise FileNotFoundError(f"no snapshot {snapshot_id or ''} in {root}")
        self.spark, self.id = spark, row["name"]
        self.path = f"{root}/snapshots/{self.id}"
        self.manifest = verify(spark, self.path) if check else json.loads(read_text(spark, f"{self.path}/manifest.json"))

    def table(self, name: str) -> DataFrame:
        """A lazy scan; filters and columns reach the Parquet reader."""
        if name not in self.manifest["tables"]:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def window_ids(self) -> DataFrame:
        return self.table("window_index").select("window_id").orderBy("window_id")


def replay(windows: DataFrame, rows: DataFrame, keys: list[str], start: str, stop: str, ordinal: str = "canonical_ordinal", bucket: int = 65_536) -> DataFrame:
    """window_id and the rows of its stop-exclusive ordinal range, for all windows at once.

    Windows and rows meet in blocks of ordinals, an equi-join that no long stream turns into one task's work."""
    w = windows.where(F.col(start) < F.col(stop)).select("window_id", *keys, F.col(start).alias("__a"), F.col(stop).alias("__z"))
    w = w.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__a") / bucket), F.floor((F.col("__z") - 1) / bucket))))
    x = rows.withColumn("__b", F.floor(F.col(ordinal) / bucket)).join(w, [*keys, "__b"])
    return x.where((F.col(ordinal) >= F.col("__a")) & (F.col(ordinal) < F.col("__z"))).drop("__a", "__z", "__b")


def nearest_context(windows: DataFrame, alignment: DataFrame, keys: list[str]) -> DataFrame:
    """window_id, ordinal of samples that are nearest to a window's frames but outside its own sample range."""
    x = replay(windows, alignment, keys, "frame_start_ordinal", "frame_stop_ordinal", "frame_canonical_ordinal")
    x = x.join(windows.select("window_id", F.col("imu_start_ordinal").alias("__a"), F.col("imu_stop_ordinal").alias("__z")), "window_id")
    return x.where("imu_nearest_ordinal is not null and (imu_nearest_ordinal < __a or imu_nearest_ordinal >= __z)").select("window_id", F.col("imu_nearest_ordinal").alias("ordinal")).distinct()


def place(keys: list[Column], block: Column) -> Column:
    """The number by which rows of a stream's block of ordinals are laid out."""
    return F.xxhash64(*keys, block.cast("long"))


def lay_out(rows: DataFrame, path: str, name: str, keys: list[str], ordinal: str = "canonical_ordinal", block: int = 65_536, buckets: int = 64) -> DataFrame:
    """Store rows as a table of that name under path, bucketed by `place` and sorted by it and the ordinal in each bucket: a
    join by place needs no exchange of it, and a filter on one place reads one bucket's files."""
    x = rows.withColumn("block", F.floor(F.col(ordinal) / block)).withColumn("place", place([F.col(k) for k in keys], F.col("block")))
    x.repartition(buckets, "place").write.format("parquet").option("path", path).bucketBy(buckets, "place").sortBy("place", ordinal).saveAsTable(name)
    return rows.sparkSession.table(name)


def lay_out_windows(windows: DataFrame, path: str, name: str, keys: list[str], start: str, stop: str, block: int = 65_536, buckets: int = 64) -> DataFrame:
    """Store windows (window_id, keys, start, stop) alike, with a row for each block of ordinals that their range touches."""
    w = windows.where(F.col(start) < F.col(stop)).select("window_id", *(F.col(k).alias(f"of_{k}") for k in keys), F.col(start).alias("range_start"), F.col(stop).alias("range_stop"))
    w = w.withColumn("of_block", F.explode(F.sequence(F.floor(F.col("range_start") / block), F.floor((F.col("range_stop") - 1) / block))))
    w = w.withColumn("place", place([F.col(f"of_{k}") for k in keys], F.col("of_block")))
    w.repartition(buckets, "place").write.format("parquet").option("path", path).bucketBy(buckets, "place").sortBy("place").saveAsTable(name)
    return windows.sparkSession.table(name)


def replay_laid_out(windows: DataFrame, rows: DataFrame, keys: list[str], ordinal: str = "canonical_ordinal") -> DataFrame:
    """As replay, of tables that were laid out with the same blocks and buckets: both sides are read where they lie.

    Two blocks that have one place are told apart by their keys."""
    x = windows.join(rows.hint("merge"), "place")
    for c in [*keys, "block"]:
        x = x.where(F.col(c).between(F.col(f"of_{c}"), F.col(f"of_{c}")))  # not an equality, which would join the join's keys
    x = x.where((F.col(ordinal) >= F.col("range_start")) & (F.col(ordinal) < F.col("range_stop")))
    return x.drop("range_start", "range_stop", "block", "of_block", "place", *(f"of_{k}" for k in keys))
