"""One query for each operator of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chunks, decontaminate, html_text, language, near_dedup, pieces, prefix_trie, quality, rules, simhash, toxicity, warc, whitening
from .common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


# Each query takes whole tables, with nulls, empty and very long texts, repeated rows and ids, ties, empty tables and columns
# of any name handled as the docstring of the operator that it calls says; its rows are that operator's.


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: score of every text, from toxicity.score_toxicity."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its group of near-duplicates by shingles of four words, from near_dedup.near_duplicates."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: words inside windows of benchmark items, from decontaminate.find_leaks."""
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: digests of ids and decoded text, from pieces.encoding_report."""
    return pieces.encoding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: spans that repeat earlier passages and the text without them, from chunks.find_repeats."""
    return chunks.repeat_report(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page: its main text, from html_text.extract."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its language, from language.identify."""
    return language.identify(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: score of every text, from quality.score_quality."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: statistics and the verdict of learned rules, from rules.apply_rules."""
    return rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page: its record, written by warc.write_archive and read back by warc.read_archive."""
    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.archive_report(warc.read_archive(spark, path))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a vector and component, from whitening.whiten."""
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a node of the trie of rebuilt conversations, from prefix_trie.prefix_trie."""
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its SimHash and group of near-duplicates, from simhash.near_duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def queries() -> dict[str, Query]:
    every = (op1_toxicity, op2_near_dedup, op3_decontaminate, op4_sentencepiece, op5_chunk_dedup, op6_html_text, op7_language, op8_quality, op9_rules, op10_warc, op11_whitening, op12_prefix_trie, op13_simhash)
    return {f.__name__: f for f in every}


_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP3 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       coalesce(it.s, sha256('')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, strlen(h) AS n, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM g
"""

_OP12 = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, c - c % 20 AS base, list(x ORDER BY i) AS l FROM t GROUP BY c),
-- CRC-32 of the decimal id, bit by bit
h AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
         lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h
  FROM own),
whole AS (
  SELECT o.c, list_concat(coalesce(b.l, []), []) AS opening, o.l AS l, h.h FROM own o JOIN h USING (c) LEFT JOIN own b ON b.c = o.base),
rebuilt AS (SELECT c, list_concat(list_slice(opening, 1, h), list_slice(l, h + 1, len(l))) AS s FROM whole),
member AS (SELECT c, len(s) AS n, d, list_slice(s, 1, d) AS p FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT p, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends,
         CASE WHEN any_value(d) = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(p[any_value(d)].t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) END AS words
  FROM member GROUP BY p),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
below AS (
  SELECT list_slice(p, 1, k) AS p, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_node) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       below.n_leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN below USING (p) LEFT JOIN full_node up ON f.d > 0 AND up.p = list_slice(f.p, 1, f.d - 1)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": _OP2, "op3_decontaminate": _OP3, "op10_warc": _OP10, "op12_prefix_trie": _OP12}
