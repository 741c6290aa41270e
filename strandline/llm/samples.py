"""Bounded samples of labelled or unlabelled texts, for fitting on the driver."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold


def training_labels(labels: DataFrame, id_col: str, label_col: str, modulus: int, held_out: int) -> DataFrame:
    """id, y: labels of rows outside the held-out fold; null ids and labels go, and of several labels of an id the largest stays."""
    kept = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, modulus) != held_out))
    return kept.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))


def first_by_hash(ids: DataFrame, most: int, *by: Column) -> DataFrame:
    """At most that many rows of (id, ...), the first ones by a hash of the id: a sample that any cluster repeats."""
    return ids.orderBy(*by, F.xxhash64("id"), "id").limit(most)


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, most_chars: int, piece: int = 250) -> pa.Table:
    """Columns of chosen (a bounded table with id) and pieces of the texts of those documents, in order of id.

    A text of at most most_chars characters is one piece, a longer one gives that many characters in pieces spread
    evenly over all of it. chosen is broadcast, which its bound allows. Of repeated rows of an id one stays.
    """
    piece = min(piece, most_chars)
    text, n = F.col("text"), most_chars // piece
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, (1 + F.floor(i * (F.length(text) - piece) / max(n - 1, 1))).cast("int"), F.lit(piece)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    found = texts.join(F.broadcast(chosen), "id").withColumn("pieces", F.when(F.length("text") <= most_chars, F.array("text")).otherwise(spread)).drop("text")
    return found.dropDuplicates(["id"]).toArrow().sort_by("id")


def features_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, make: Callable, columns: str) -> pa.Table:
    """Columns of chosen (a bounded table with id) and what `make`, a function for mapInArrow, makes of the texts.

    make gets batches of a struct of chosen's columns and the text, and returns that struct, as `row`, and `columns`.
    Whole texts stay where they are; of each, no more comes to the driver than its distinct features. chosen is
    broadcast, which its bound allows. Of repeated rows of an id one stays.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    rows = texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select(F.struct(*chosen.columns).alias("row"), "text")
    schema = StructType([rows.schema["row"]] + StructType.fromDDL(columns).fields)
    return rows.mapInArrow(make, schema).select("row.*", *(f.name for f in schema.fields[1:])).toArrow().sort_by("id")
