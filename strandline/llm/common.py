"""What the operators share: reading tables, cutting lineage, shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, and keep Arrow batches of long texts small."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._strandline_shipped = True
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64MB"), "8m")):
        if spark.conf.get(key) in usual:  # not where a user has set it
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. In local mode a temporary one will do; on a
    cluster that names none this is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="strandline-")
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends if free hasn't taken it before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return path


def _files(spark: SparkSession, path: str) -> tuple:
    """Spark's file system for a path: what PySpark's own interface can't do is to delete."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def free(*tables: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete what cut wrote for these tables, or these paths; nothing may read them any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_strandline_path", None)
        if path:
            files, at = _files(spark or t.sparkSession, path)
            files.delete(at, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of a query when it ends: what is cut isn't run again, and would else lie on
    the executors' disks until the driver's next collection of garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, write it to the shared folder, which outlives executors, and go on from there."""
    path = scratch(df.sparkSession, "cut")
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def join_summary(rows: DataFrame, summary: DataFrame, *keys: str, how: str = "inner", grown: bool = False) -> DataFrame:
    """rows joined to a summary of them that has one row for each value of the keys.

    The summary lies where its aggregate left it, by key, and Spark splits skewed joins only if both sides are shuffled
    for them. So the keys take another form on either side, and a frequent value's rows can go to many tasks.

    grown: rows are far more, or larger, than Spark's size of them says (it doesn't count what an explode adds, nor what
    files compress), so that it might broadcast what the driver can't hold; then both sides are shuffled in any case."""
    other = [c for c in summary.columns if c not in keys]
    form = F.struct(*keys)
    right = summary.select(form.alias("__w"), *other)
    return rows.withColumn("__w", form).join(right.hint("merge") if grown else right, "__w", how).drop("__w")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
