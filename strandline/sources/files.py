"""What Spark's reader and writer can't do with files, by Hadoop's file system: create one that isn't there, delete, scratch
folders; and this package for the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application: operators that work on Arrow batches need it there.

    Spark's own limit of a batch is 64 MB, of which a worker holds several; rows may be megabytes, so batches are of 8 MB where
    the session has no other limit."""
    if spark.conf.get(BATCH) in ("67108864b", "67108864", "64MB"):  # not where a user has set it
        spark.conf.set(BATCH, "8m")
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._strandline_shipped = True


def _system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; in local mode a temporary one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    named = tempfile.mkdtemp(prefix="strandline-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _system(spark, path)
    files.deleteOnExit(at)
    return path


def create_new(spark: SparkSession, path: str) -> bool:
    """Make an empty file; false if there is one. Of several that try, one succeeds where the file system can decide that."""
    files, at = _system(spark, path)
    return bool(files.createNewFile(at))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, at = _system(spark, path)
    files.delete(at, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of a query when it ends; else they lie on the executors' disks until the driver's
    next collection of garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles_of(spark: SparkSession, n: int):
    """Within, shuffles that Spark deals out by itself have n partitions, none of which it joins to a larger one."""
    return _set(spark, {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"})


def methods_compile(spark: SparkSession):
    """Within, Spark makes no methods of more than 8,000 bytes, which Java would interpret: plans with many columns of long
    expressions take half the time by smaller ones."""
    return _set(spark, {"spark.sql.codegen.hugeMethodLimit": "8000"})


def kept(df: DataFrame, name: str, n: int) -> DataFrame:
    """df, made now in shuffles of n partitions, written to the shared folder and read from there.

    Spark's own number is the session's, whatever the input; a plan of many steps would need it given at each."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with shuffles_go(spark), shuffles_of(spark, n):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
