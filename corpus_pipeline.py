"""A training corpus from documents: five stages, each of which works on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import chunks, decontaminate, language, near_dedup, pieces
from strandline.llm.common import scratch, table

#: Stages with learned or hashed parts that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter go.

    Null and empty texts go, null ids and languages don't matter; repeated rows stay or go together; other columns stay as they
    are. Without a labelled document nothing is identified and all go; without documents there are none."""
    return language.with_language(docs)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the least id.

    Null and empty texts are in no group and stay, as do rows with a null id; all rows of the id that stays are kept, however
    often they repeat, and of an id with several texts all rows stay or go. Other columns stay as they are."""
    return near_dedup.first_of_each_group(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occurred before.

    Of equal passages the one with the least id stays, then the first in its text; repeated rows and rows of one id take nothing from
    each other, nor do rows with a null id. Documents of which nothing is left go; null and empty texts stay. n_chars, if it is
    there, is brought up to date; other columns stay as they are."""
    return chunks.without_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with the benchmark (or all words of a shorter item).

    Null and empty texts, and null items, share nothing and stay; repeated rows stay or go together; other columns stay as they are."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and the text that they decode to.

    Null and empty texts have the end id only; ids may be null or repeat, a row for each. Without documents there are no rows."""
    # workers go on to other stages with what they remember, so they keep less here
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), remember=12_000_000)
    return found.selectExpr("row.doc_id AS doc_id", "row.lang AS lang", "row.source AS source", "size(ids) AS n_tokens", "ids", "decoded")


STAGES = [
    ("language", identified),
    ("near_dedup", first_copies),
    ("substring_dedup", without_repeats),
    ("decontamination", without_leaks),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{name}")
        docs = spark.read.parquet(path)
    return docs
