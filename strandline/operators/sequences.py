"""A hash of rows in order that any number of tasks can make.

A row's digest gives four numbers, a 2 x 2 matrix modulo a prime, and a sequence of rows is the product of theirs: products can
be put together from parts, as they are associative, and change if two rows change places, as they don't commute.
Rows are sorted into range partitions, each partition multiplies its rows, and the products meet in the order of the
partitions. However rows are dealt out, the product is that of one pass over all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..sources.files import ship

PRIME = (1 << 61) - 1
IDENTITY = (1, 0, 0, 1)
Matrix = tuple[int, int, int, int]


def exact_text(c: Column, kind) -> Column:
    """Text of a value that keeps -0.0 apart from 0.0 and has one form for NaN."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when((c == 0) & c.cast("string").startswith("-"), "-0").otherwise(c.cast("string"))
    return c.cast("string") if kind.simpleString() in ("string", "long", "bigint", "int", "boolean", "smallint", "date", "timestamp", "timestamp_ntz") else F.to_json(F.struct(c))


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's values (of those columns), each tagged as null or with its length."""
    parts = []
    for f in df.schema:
        if columns is None or f.name in columns:
            text = exact_text(F.col(f"`{f.name}`"), f.dataType)
            parts.append(F.coalesce(F.concat(F.lit("V"), F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("N")))
    return F.sha2(F.concat(F.lit(""), *parts), 256)


def product(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2]) % PRIME, (a[0] * b[1] + a[1] * b[3]) % PRIME, (a[2] * b[0] + a[3] * b[2]) % PRIME, (a[2] * b[1] + a[3] * b[3]) % PRIME


def matrices(digests: list[bytes]) -> list[list[int]]:
    """The matrix of each digest of 32 bytes: its quarters, modulo the prime."""
    return (np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4) % np.uint64(PRIME)).tolist()


def text_of(n: int, m: Matrix) -> str:
    return hashlib.sha256(":".join(map(str, (n, *m))).encode()).hexdigest()


def serial_hash(digests: list[bytes]) -> str:
    """The hash of rows whose digests are given in order, by one pass."""
    m = IDENTITY
    for x in matrices(digests):
        m = product(m, x)
    return text_of(len(digests), m)


def _folded(batches: Iterator[pa.RecordBatch], by: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns by, part, digest in order: a row (by, part, n, m) for each group's run of rows in this task."""
    key, part, n, m, out = None, 0, 0, IDENTITY, []

    def done() -> None:
        if n:
            out.append((*key, part, n, *map(str, m)))

    for batch in batches:
        groups = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
        for k, p, x in zip(groups, batch.column("part").to_pylist(), matrices(batch.column("digest").to_pylist()) if batch.num_rows else [], strict=True):
            if k != key or p != part:
                done()
                key, part, n, m = k, p, 0, IDENTITY
            n, m = n + 1, product(m, x)
    done()
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)


def sequence_hashes(df: DataFrame, order: list[str], by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """by, n_rows, sequence_sha256 of the rows of each group in order; without `by`, of all rows (none if there are none).

    Values of `columns` (all but `by` by default) are hashed, with the place of a row, which isn't stated otherwise. Nulls come
    first; rows that `order` doesn't tell apart go by their digest, so the result is the same in any case. A large group
    is the work of many tasks, each of which hands on one row for it; those meet in one.
    """
    ship(df.sparkSession)
    by = by or []
    digest = F.unhex(row_digest(df, columns if columns is not None else [c for c in df.columns if c not in by]))
    renamed = [f"__o{i}" for i in range(len(order))]
    x = df.select(*by, *(F.col(c).alias(n) for c, n in zip(order, renamed, strict=True)), digest.alias("digest"))
    keys = [F.col(c).asc_nulls_first() for c in [*by, *renamed, "digest"]]
    x = x.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*by, F.spark_partition_id().alias("part"), "digest")
    kinds = StructType([x.schema[c] for c in by] + StructType.fromDDL("part int, n long, a string, b string, c string, d string").fields)
    schema = to_arrow_schema(kinds)
    parts = x.mapInArrow(lambda batches: _folded(batches, by, schema), kinds)

    def joined(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group[c].to_pylist() for c in ("part", "n", "a", "b", "c", "d")), strict=True))
        m = IDENTITY
        for _, _, *x in rows:
            m = product(m, tuple(map(int, x)))
        n = sum(r[1] for r in rows)
        return group.select(by).slice(0, 1).append_column("n_rows", pa.array([n], pa.int64())).append_column("sequence_sha256", pa.array([text_of(n, m)]))

    out = StructType(kinds.fields[: len(by)] + StructType.fromDDL("n_rows long, sequence_sha256 string").fields)
    return parts.groupBy(*by).applyInArrow(joined, out) if by else parts.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(joined, out)


def sequence_hash(df: DataFrame, order: list[str]) -> str:
    """As sequence_hashes, of all rows, as text; that of no rows where there are none."""
    row = sequence_hashes(df, order).first()
    return row["sequence_sha256"] if row else text_of(0, IDENTITY)
