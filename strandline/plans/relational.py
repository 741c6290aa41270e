"""Queries over the other tables: orders are streams of line items, conversations and documents are line-oriented sources."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, IntegerType, StringType, StructField, StructType

from ..functions import exact
from ..operators import clock, contracts, detections, frames, reconcile, timeseries, validate, windows
from ..schemas import fingerprint
from ..sources import files, store
from ..streaming import streams
from .frames_sensors import FRAME_SENSOR_INDEX, KEY, events, table


def cosine_angular_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widest angle within groups of vectors with one label and id // 50."""
    x = table(spark, sf_dir, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 50))
    return windows.widest_angles(x, ["label", "block"], "embedding", "vec_id").select("label", "block", F.round("angle", 4).alias("angle"))


COSINE_ANGULAR_RANGE = """
WITH e AS (SELECT vec_id, label, vec_id // 50 AS block, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.label, a.block, round(2 * acos(least(1.0, min(abs(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)))))), 4) AS angle
FROM e a JOIN e b ON a.label = b.label AND a.block = b.block AND a.vec_id < b.vec_id GROUP BY a.label, a.block
"""


def cosine_angular_range_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widest angle over all pairs of vectors with one label."""
    return windows.widest_angles(table(spark, sf_dir, "embeddings"), ["label"], "embedding", "vec_id").select("label", F.round("angle", 4).alias("angle"))


COSINE_ANGULAR_RANGE_BY_LABEL = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.label, round(2 * acos(least(1.0, min(abs(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)))))), 4) AS angle
FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label
"""

# Four epochs of a clock: the second follows the first, the third comes after a reset, the fourth isn't valid.
_CLOCK = [(0, "e0", "c0", 0, 0, 3000, 1704067200000000000, 1704672000000000000, 1704067200000000000, 1000, 1001, 1000), (0, "e1", "c0", 1, 3000, 6000, 1704672000000000000, 1705276800000000000, 1704672000000000000, 605404800001000, 999, 1000), (0, "e2", "c1", 2, 6000, 9000, 1705276800000000000, 1705881600000000000, 1705276800000000000, 1209600000005000, 3, 7), (0, "e3", "c2", 3, 9000, 12000, 1705881600000000000, 1709251200000000000, 1705881600000000000, 1814400000005000, 1, 1)]
_CLOCK_DDL = "stream_id long, clock_epoch_id string, continuity_component_id string, acquisition_ordinal int, source_start_ordinal long, source_stop_ordinal long, native_start_ns long, native_end_ns long, native_anchor_ns long, canonical_anchor_ns long, scale_numerator long, scale_denominator long"


def _clock(spark: SparkSession) -> DataFrame:
    x = spark.createDataFrame(_CLOCK, _CLOCK_DDL).withColumn("recording_id", F.lit("r"))
    return x.withColumn("mapping_status", F.when(F.col("clock_epoch_id") == "e3", "UNRESOLVED").otherwise("VALID"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def rational_clock_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.lit("r").alias("recording_id"), F.lit(0).cast("long").alias("stream_id"), "event_id", F.col("time").alias("native_ns"))
    return clock.map_times(e, _clock(spark), "native_ns").select("event_id", "canonical_time_ns", "map_status")


RATIONAL_CLOCK_MAP = f"""
WITH m(stream_id, e, c, a, ss, se, ns, ne, na, ca, n, d) AS (VALUES {_values(_CLOCK)}),
x AS (SELECT event_id, m.e, (epoch_us(ts) * 1000 - na)::HUGEINT * n AS p, d::HUGEINT AS d, ca FROM events LEFT JOIN m ON epoch_us(ts) * 1000 >= ns AND epoch_us(ts) * 1000 < ne),
q AS (SELECT *, abs(p) // d AS q, abs(p) % d AS r FROM x)
SELECT event_id, CASE WHEN e <> 'e3' THEN (ca + sign(p) * (q + CASE WHEN 2 * r > d OR (2 * r = d AND q % 2 = 1) THEN 1 ELSE 0 END))::BIGINT END AS canonical_time_ns,
  CASE WHEN e IS NULL THEN 'NO_SEGMENT' WHEN e = 'e3' THEN 'UNUSABLE' ELSE 'MAPPED' END AS map_status
FROM q
"""


def clock_map_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map above, with a fault for each nation key: repeated epochs, overlaps, reused components, wrong drift."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    x = _clock(spark).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")))
    x = x.join(n, "k").withColumn("stream_id", F.col("k"))
    at = lambda k, e: (F.col("k") == k) & (F.col("clock_epoch_id") == e)
    x = x.withColumn("drift_ppm_derived", exact.drift_ppm(F.col("scale_numerator"), F.col("scale_denominator")) + F.when(at(1, "e2"), 5.0).otherwise(0.0))
    x = x.withColumn("source_start_ordinal", F.col("source_start_ordinal") - F.when(at(2, "e2"), 10).otherwise(0)).withColumn("continuity_component_id", F.when(at(3, "e3"), "c0").otherwise(F.col("continuity_component_id")))
    x = x.withColumn("residual_p50_ms", F.lit(2.0)).withColumn("residual_p95_ms", F.when(at(4, "e1"), 1.0).otherwise(3.0)).withColumn("clock_epoch_id", F.when(at(4, "e3"), "e0").otherwise(F.col("clock_epoch_id")))
    return clock.violations(x).select("rule", "stream_id", "clock_epoch_id")


CLOCK_MAP_VIOLATIONS = """
SELECT * FROM (VALUES ('DRIFT_NOT_DERIVED', 1, 'e2'), ('SOURCE_OVERLAP', 2, 'e2'), ('COMPONENT_REUSED', 3, 'e0'), ('COMPONENT_REUSED', 3, 'e1'), ('COMPONENT_REUSED', 3, 'e3'), ('RESIDUALS_REVERSED', 4, 'e1'), ('EPOCH_REPEATED', 4, 'e0'), ('EPOCH_REPEATED', 4, 'e0')) v(rule, stream_id, clock_epoch_id)
WHERE stream_id IN (SELECT n_nationkey FROM nation)
"""


def _lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (exact.nanoseconds(F.col("l_shipdate")) / 86_400_000_000_000).cast("long").alias("pts"), *more)


def _ordered(df: DataFrame) -> DataFrame:
    """Line items of an order have a decode order of their own: number, part, supplier, price."""
    return timeseries.ordinals(timeseries.laid(df, ["l_orderkey"]), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "decode_ordinal")


def frame_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _ordered(_lines(spark, sf_dir)).withColumn("pts", F.when(F.col("l_partkey") % 17 != 0, F.col("pts")))
    return frames.classify(x, ["l_orderkey"], gap=30).select("l_orderkey", "decode_ordinal", "same_pts_rank", "presentation_ordinal", "gap_before", "quality_bits", "pts_status")


_ORDERED_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, epoch_us(l_shipdate) // 86400000000 AS day, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS decode_ordinal FROM lineitem
"""
FRAME_CLASSIFY = f"""
WITH x AS (SELECT *, CASE WHEN l_partkey % 17 <> 0 THEN day END AS pts FROM ({_ORDERED_SQL})),
y AS (
  SELECT l_orderkey, decode_ordinal, pts, CASE WHEN pts IS NOT NULL THEN row_number() OVER (PARTITION BY l_orderkey, pts ORDER BY decode_ordinal) - 1 END AS same_pts_rank,
    CASE WHEN pts IS NOT NULL THEN row_number() OVER (PARTITION BY l_orderkey ORDER BY pts NULLS LAST, decode_ordinal) - 1 END AS presentation_ordinal,
    CASE WHEN pts IS NOT NULL THEN pts - lag(pts) OVER (PARTITION BY l_orderkey ORDER BY pts NULLS LAST, decode_ordinal) END AS gap_before,
    pts IS NOT NULL AND count(*) OVER (PARTITION BY l_orderkey, pts) > 1 AS twice,
    coalesce(pts < last_value(pts IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY decode_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS back FROM x)
SELECT l_orderkey, decode_ordinal, same_pts_rank, presentation_ordinal, gap_before,
  (CASE WHEN pts IS NULL THEN 1 ELSE 0 END + CASE WHEN twice THEN 4 ELSE 0 END + CASE WHEN back THEN 2 ELSE 0 END + CASE WHEN gap_before > 30 THEN 8 ELSE 0 END)::BIGINT AS quality_bits,
  CASE WHEN pts IS NULL THEN 'MISSING' WHEN twice THEN 'DUPLICATE' WHEN back THEN 'NON_MONOTONIC' WHEN gap_before > 30 THEN 'DISCONTINUITY' ELSE 'VALID' END AS pts_status
FROM y
"""


def primary_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "P", "REJECTED_INPUT").when(F.col("o_orderstatus") == "O", "NO_DETECTION").otherwise("SUCCESS").alias("status"))
    d = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return frames.primary_selection(o, d, ["k"], "l_linenumber", "status")


PRIMARY_SELECTION = """
WITH d AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS one FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
r AS (SELECT o_orderkey AS k, one, CASE WHEN o_orderstatus = 'P' THEN 'INFERENCE_STATUS_REJECTED_INPUT' WHEN coalesce(n, 0) = 0 THEN 'NO_DETECTIONS' WHEN n > 1 THEN 'MULTIPLE_DETECTIONS' ELSE 'SINGLE_DETECTION' END AS selection_reason FROM orders LEFT JOIN d ON o_orderkey = k)
SELECT k, CASE WHEN selection_reason = 'SINGLE_DETECTION' THEN 'SELECTED' ELSE 'ABSTAINED' END AS selection_status, selection_reason, CASE WHEN selection_reason = 'SINGLE_DETECTION' THEN one END AS selected FROM r
"""


def detection_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _ordered(_lines(spark, sf_dir).drop("pts")).withColumn("digest", F.sha2(F.concat_ws(":", "l_partkey", "l_suppkey", "decode_ordinal"), 256)).drop("l_linenumber", "l_partkey", "l_suppkey")
    return frames.detection_rank(x, ["l_orderkey"], "l_extendedprice", "digest").select("l_orderkey", "decode_ordinal", "rank", "same_payload_rank")


DETECTION_RANK = f"""
SELECT l_orderkey, decode_ordinal, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, sha256(l_partkey || ':' || l_suppkey || ':' || decode_ordinal)) - 1 AS rank, 0::BIGINT AS same_payload_rank FROM ({_ORDERED_SQL})
"""


def trim_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents without those that a cut of id % 14 + 1 frames removes after the first line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_number", "line"))
    kind = F.element_at(F.array(*map(F.lit, ("csv", "mot", "raw"))), (F.col("doc_id") % 3 + 1).cast("int"))
    kept = reconcile.trim(d, ["doc_id"], ["line_number"], exact.removed_rows(kind, F.col("doc_id") % 14 + 1), 1)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("line_number").alias("places"), F.sum(F.length("line")).alias("chars"))


TRIM_OVERLAY = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
c AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN doc_id % 14 + 1 WHEN 1 THEN (doc_id % 14 + 1) * 5 // 3 ELSE (doc_id % 14 + 1) * 25 // 3 END AS removed FROM l)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(n)::BIGINT AS places, sum(length(line))::BIGINT AS chars FROM c WHERE n < 1 OR n >= 1 + removed GROUP BY doc_id
"""

_LAYOUT = ["1", "2", "3", "4", "5"]


def sensor_group_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order in groups of five (in every fourth order, six) by part, labelled by line number; for some suppliers the label is null or empty."""
    x = timeseries.ordinals(_lines(spark, sf_dir), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], "o")
    label = F.when(F.col("l_suppkey") % 13 == 1, F.lit("")).when(F.col("l_suppkey") % 13 != 0, F.least("l_linenumber", F.lit(6)).cast("string"))
    group = F.when(F.col("l_orderkey") % 4 == 0, F.floor(F.col("o") / 6)).otherwise(F.floor(F.col("o") / 5))
    return reconcile.sensor_groups(x.withColumn("label", label).withColumn("g", group), ["l_orderkey", "g"], "o", "label", _LAYOUT).groupBy("status").agg(F.count("*").alias("n"))


SENSOR_GROUP_CLASSIFY = """
WITH x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS o, CASE l_suppkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE least(l_linenumber, 6)::VARCHAR END AS label FROM lineitem),
g AS (SELECT l_orderkey, o // (CASE WHEN l_orderkey % 4 = 0 THEN 6 ELSE 5 END) AS g, list(label ORDER BY o) AS l, count(*) AS n, bool_or(label IS NULL OR label = '') AS holes, bool_or(label = '6') AS odd, count(DISTINCT label) AS u FROM x GROUP BY 1, 2)
SELECT CASE WHEN n <> 5 THEN 'INCOMPLETE' WHEN holes THEN 'MALFORMED' WHEN odd THEN 'UNKNOWN_SENSOR' WHEN u < n THEN 'DUPLICATE_SENSOR' WHEN l <> ['1', '2', '3', '4', '5'] THEN 'MALFORMED' ELSE 'COMPLETE' END AS status, count(*)::BIGINT AS n FROM g GROUP BY 1
"""


def fk_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items against parts and suppliers, customers and suppliers against nations."""
    found = None
    for link, parent, pk, child, ck in _LINKS:
        x = reconcile.foreign_keys(table(spark, sf_dir, parent), table(spark, sf_dir, child), pk, ck).withColumn("link", F.lit(link))
        found = x if found is None else found.unionByName(x)
    return found


_LINKS = [("item_part", "part", "p_partkey", "lineitem", "l_partkey"), ("item_supplier", "supplier", "s_suppkey", "lineitem", "l_suppkey"), ("customer_nation", "nation", "n_nationkey", "customer", "c_nationkey"), ("supplier_nation", "nation", "n_nationkey", "supplier", "s_nationkey")]


def _fk(link: str, parent: str, pk: str, child: str, ck: str) -> str:
    return f"SELECT '{link}' AS link, (SELECT count(*) FROM {parent})::BIGINT AS parents, (SELECT count(*) FROM {child})::BIGINT AS children, (SELECT count(*) FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{ck}))::BIGINT AS orphans, (SELECT count(*) FROM {parent} p WHERE NOT EXISTS (SELECT 1 FROM {child} c WHERE p.{pk} = c.{ck}))::BIGINT AS childless, (SELECT count(*) FROM (SELECT {pk} FROM {parent} GROUP BY 1 HAVING count(*) > 1))::BIGINT AS repeated"


FK_RECONCILIATION = " UNION ALL ".join(_fk(*x) for x in _LINKS)


def fk_reconciliation_of_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items against orders, orders against customers."""
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    a = reconcile.foreign_keys(o, l, "o_orderkey", "l_orderkey").withColumn("link", F.lit("lineitem"))
    return a.unionByName(reconcile.foreign_keys(c, o, "c_custkey", "o_custkey").withColumn("link", F.lit("orders")))


FK_RECONCILIATION_OF_ALL_ORDERS = _fk("lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey") + " UNION ALL " + _fk("orders", "customer", "c_custkey", "orders", "o_custkey")


def set_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.key_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


SET_RECONCILIATION = """
SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels))::BIGINT AS in_both, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels))::BIGINT AS only_a, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))::BIGINT AS only_b
"""


def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that don't have exactly one line item with number 1."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return reconcile.one_to_one(o.select(F.col("o_orderkey").alias("k")), l.select(F.col("l_orderkey").alias("k")), ["k"])


ONE_TO_ONE = """
WITH a AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0)::BIGINT AS n_a, coalesce(b.n, 0)::BIGINT AS n_b FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1
"""


def window_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "nation")
    return x.select("n_nationkey", windows.window_id("hop-1", [F.col("n_name"), F.lit("véo")], [F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long") * -1_000_000_000_000]).alias("window_id"))


WINDOW_ID_HASH = """
WITH p AS (SELECT n_nationkey, n_name AS a, 'véo' AS b, n_nationkey::VARCHAR AS c, (n_regionkey::BIGINT * -1000000000000)::VARCHAR AS d FROM nation),
h AS (SELECT n_nationkey, hex('hop-1'::BLOB) || '00' || '53' || printf('%016X', strlen(a)) || hex(encode(a)) || '53' || printf('%016X', strlen(b)) || hex(encode(b)) || '49' || printf('%016X', strlen(c)) || hex(encode(c)) || '49' || printf('%016X', strlen(d)) || hex(encode(d)) AS x FROM p)
SELECT n_nationkey, substr(sha256(unhex(x)), 1, 24) AS window_id FROM h
"""


def removed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 14 + 1).cast("long").alias("c"), F.explode(F.array(*map(F.lit, ("csv", "mot", "raw", "mp4")))).alias("kind")).distinct()
    return x.select("c", "kind", exact.removed_rows(F.col("kind"), F.col("c")).alias("removed"))


REMOVED_ROWS = "SELECT DISTINCT (n_nationkey % 14 + 1)::BIGINT AS c, kind, CASE kind WHEN 'csv' THEN n_nationkey % 14 + 1 WHEN 'mot' THEN (n_nationkey % 14 + 1) * 5 // 3 WHEN 'raw' THEN (n_nationkey % 14 + 1) * 25 // 3 END::BIGINT AS removed FROM nation, (VALUES ('csv'), ('mot'), ('raw'), ('mp4')) k(kind)"


def exact_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("long") * 7).alias("n"), (F.col("p_partkey") % 64 + 1).alias("d"))
    return x.select("p_partkey", exact.decimal_6(F.col("n"), F.col("d")).alias("ratio"), exact.divide_half_even(-F.col("n"), F.col("d")).cast("long").alias("even"), exact.rescale_half_up(F.col("n"), F.lit(0), F.lit(1), F.col("d"), 100).alias("half_up"))


EXACT_RATIOS = """
WITH x AS (SELECT p_partkey, p_size::HUGEINT * 7 AS n, (p_partkey % 64 + 1)::HUGEINT AS d FROM part),
y AS (SELECT *, n * 1000000 // d AS q, n * 1000000 % d AS r, n // d AS a, n % d AS b FROM x),
z AS (SELECT *, q + CASE WHEN 2 * r > d OR (2 * r = d AND q % 2 = 1) THEN 1 ELSE 0 END AS m FROM y)
SELECT p_partkey, (m // 1000000)::VARCHAR || '.' || lpad((m % 1000000)::VARCHAR, 6, '0') AS ratio, (-(a + CASE WHEN 2 * b > d OR (2 * b = d AND a % 2 = 1) THEN 1 ELSE 0 END))::BIGINT AS "even", ((2 * n * 100 + d) // (2 * d))::BIGINT AS half_up FROM z
"""


def geometry_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 640).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), (F.col("p_partkey") % 4 * 90).alias("turn"))
    m = p.withColumn("m", frames.display_transform(F.lit(640), F.lit(480), F.col("turn"))).withColumn("there", frames.map_point(F.col("x"), F.col("y"), F.col("m")))
    m = m.withColumn("again", frames.map_point(F.col("there.x"), F.col("there.y"), frames.invert(F.col("m"))))
    return m.select("p_partkey", F.round("there.x", 6).alias("x"), F.round("there.y", 6).alias("y"), ((F.abs(F.col("again.x") - F.col("x")) + F.abs(F.col("again.y") - F.col("y"))) < 1e-9).alias("inverts"))


GEOMETRY_ROTATE = """
WITH p AS (SELECT p_partkey, (p_partkey % 640)::DOUBLE AS x, p_size::DOUBLE AS y, p_partkey % 4 AS t FROM part)
SELECT p_partkey, CASE t WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 639 - x ELSE 479 - y END AS x, CASE t WHEN 0 THEN y WHEN 1 THEN 639 - x WHEN 2 THEN 479 - y ELSE x END AS y, true AS inverts FROM p
"""


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken stream rules over events with seeded faults, counted by rule."""
    e = timeseries.ordinals(events(spark, sf_dir), KEY, ["time", "event_id"], bucket=timeseries.DAY).withColumn("canonical_time_ns", F.col("time"))
    twin = F.col("event_id") % 1000 < 2
    e = e.withColumn("source_ordinal", F.col("event_id")).withColumn("index", F.when(twin, F.floor(F.col("event_id") / 2) + 10**9).otherwise(F.col("event_id")))
    e = e.withColumn("canonical_ordinal", F.col("canonical_ordinal") + F.when(F.col("event_id") % 500 == 7, 1).otherwise(0)).withColumn("quality_bits", F.when(F.col("event_id") % 400 == 3, 4).when(F.col("event_id") % 700 == 5, 8192).otherwise(0).cast("long")).withColumn("clock_epoch_id", F.lit("e"))
    return validate.stream_rows(e, KEY, "time", "index").groupBy("rule").agg(F.count("*").alias("n"))


QUALITY_REPORT = """
WITH e AS (SELECT *, CASE WHEN event_id % 1000 < 2 THEN event_id // 2 + 1000000000 ELSE event_id END AS i FROM events),
r AS (SELECT 'ORDINAL_NOT_DENSE' AS rule, count(*) AS n FROM e WHERE event_id % 500 = 7 UNION ALL SELECT 'FLAGGED_NOT_DUPLICATE', count(*) FROM e WHERE event_id % 400 = 3
  UNION ALL SELECT 'UNKNOWN_BITS', count(*) FROM e WHERE event_id % 700 = 5 AND event_id % 400 <> 3 UNION ALL SELECT 'INDEX_REPEATED', count(*) FROM (SELECT count(*) OVER (PARTITION BY user_id, i) AS c FROM e) WHERE c > 1
  UNION ALL SELECT 'NATIVE_TIME_REVERSED', count(*) FROM (SELECT ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM e) WHERE back)
SELECT rule, n::BIGINT AS n FROM r WHERE n > 0
"""


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = timeseries.held_runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "text"], "role")
    return reconcile.ratio_summary(x.where("n_rows > 0"), "n_runs", "n_rows", ["conv_id"])


_TURNS = "SELECT conv_id, count(*)::BIGINT AS n_rows, sum(c)::BIGINT AS n_runs FROM (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER q AND row_number() OVER q > 1 THEN 0 ELSE 1 END AS c FROM conversations WINDOW q AS (PARTITION BY conv_id ORDER BY turn, text)) GROUP BY conv_id"
CONVERSATION_TURNS = f"""
WITH h AS ({_TURNS}), r AS (SELECT *, row_number() OVER (ORDER BY n_runs::DOUBLE / n_rows, conv_id) - 1 AS r FROM h),
p AS (SELECT 'min' AS pick, 0 AS at UNION ALL SELECT 'median_low', (SELECT (count(*) - 1) // 2 FROM h) UNION ALL SELECT 'median_high', (SELECT count(*) // 2 FROM h) UNION ALL SELECT 'max', (SELECT count(*) - 1 FROM h))
SELECT pick, conv_id, n_runs, n_rows, printf('%.6f', n_runs::DOUBLE / n_rows) AS ratio FROM p JOIN r ON r.r = p.at
"""


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = frame_classify(spark, sf_dir)
    return reconcile.status_counts(x, missing=F.col("pts_status") == "MISSING", duplicate=F.col("quality_bits").bitwiseAND(F.lit(4)) != 0, reversed=F.col("quality_bits").bitwiseAND(F.lit(2)) != 0, valid=F.col("pts_status") == "VALID")


STATUS_COUNTS = f"SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (pts_status = 'MISSING')::BIGINT AS missing, count(*) FILTER (quality_bits & 4 <> 0)::BIGINT AS duplicate, count(*) FILTER (quality_bits & 2 <> 0)::BIGINT AS reversed, count(*) FILTER (pts_status = 'VALID')::BIGINT AS valid FROM ({FRAME_CLASSIFY})"


def replay_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_custkey", "o_orderpriority"), 256).alias("d"))
    again = o.where("o_orderkey % 50 <> 3").withColumn("d", F.when(F.col("o_orderkey") % 100 == 7, "x").otherwise(F.col("d")))
    return reconcile.replay_comparison(o, again, ["o_orderkey"], "d").groupBy("outcome").agg(F.count("*").alias("n"))


REPLAY_COMPARISON = "SELECT CASE WHEN o_orderkey % 50 = 3 THEN 'ONLY_A' WHEN o_orderkey % 100 = 7 THEN 'DIFFERENT' ELSE 'EQUAL' END AS outcome, count(*)::BIGINT AS n FROM orders GROUP BY 1"


def table_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return reconcile.differing(n, n.withColumn("n_regionkey", F.when(F.col("n_nationkey") == 3, 9).otherwise(F.col("n_regionkey"))))


TABLE_EQUALITY = "SELECT n_nationkey, n_name, n_regionkey, 'a' AS side FROM nation WHERE n_nationkey = 3 AND n_regionkey <> 9 UNION ALL SELECT n_nationkey, n_name, 9, 'b' FROM nation WHERE n_nationkey = 3 AND n_regionkey <> 9"


def table_semantic_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of two tables, and that a shuffled copy has the same."""
    out = []
    for t in ("nation", "region"):
        df = table(spark, sf_dir, t)
        a, b = store.semantic_hash(df), store.semantic_hash(df.repartition(5, df.columns[0]))
        out.append((t, a, a == b))
    return spark.createDataFrame(out, "name string, semantic_sha256 string, stable boolean")


def _semantic_sql(name: str, columns: dict[str, AtomicType]) -> str:
    """The digest of a table's rows as a multiset: sums of the quarters of their digests, the count, and its schema."""
    row = " || ".join(f"coalesce('V' || strlen({c}::VARCHAR) || ':' || {c}, 'N')" for c in columns)
    sums = " || ':' || ".join(f"sum(('0x' || substr(h, {16 * k + 1}, 16))::HUGEINT)" for k in range(4))
    head = f"multiset-2\n{fingerprint(StructType([StructField(c, t) for c, t in columns.items()]))}\n"
    return f"SELECT '{name}' AS name, sha256('{head}' || count(*) || ':' || {sums} || chr(10)) AS semantic_sha256, true AS stable FROM (SELECT sha256({row}) AS h FROM {name})"


TABLE_SEMANTIC_HASH = _semantic_sql("nation", {"n_nationkey": IntegerType(), "n_name": StringType(), "n_regionkey": IntegerType()}) + " UNION ALL " + _semantic_sql("region", {"r_regionkey": IntegerType(), "r_name": StringType()})


def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables published as a snapshot and read back by its pointer, counted."""
    root = files.scratch(spark, "store")
    store.publish(spark, root, {t: table(spark, sf_dir, t) for t in ("nation", "region")}, {"source": "test tables"}, "first", {"nation": ["n_nationkey"], "region": ["r_regionkey"]})
    snapshot = store.Snapshot(spark, root)
    return snapshot.table("nation").join(snapshot.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


SNAPSHOT_STORE = "SELECT r_name, count(*)::BIGINT AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


def sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hop windows of events as a stream: all that is there, closed by the watermark or not."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = streams.hop_counts(stream.withColumn("at", F.col("ts").cast("timestamp")), "at", ["event_type"], "4 days", "1 day", "1 hour")
    return streams.totals_once(counts, files.scratch(spark, "hops")).groupBy("event_type").agg(F.count("*").alias("n_windows"), F.sum("n").alias("n_rows"))


SLIDING_STREAM = """
WITH w AS (SELECT event_type, ts, unnest(range(epoch_us(ts) // 86400000000 - 3, epoch_us(ts) // 86400000000 + 1)) AS k FROM events)
SELECT event_type, count(DISTINCT k)::BIGINT AS n_windows, count(*)::BIGINT AS n_rows FROM w GROUP BY event_type
"""

def display_matrix_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices written as 16.16 integers: right angles, and a skew for every fifth nation."""
    a = F.col("n_nationkey") % 4
    word = lambda c: F.unhex(F.when(c == 0, "00000000").when(c > 0, "00000100").otherwise("0000FFFF"))
    cos, sin = F.when(a == 0, 1).when(a == 2, -1).otherwise(0), F.when(a == 1, 1).when(a == 3, -1).otherwise(0)
    skew = F.when(F.col("n_nationkey") % 5 == 0, 1).otherwise(0)
    zero = F.lit(0)
    m = F.concat(*map(word, (cos, -sin, zero, sin + skew, cos, zero, zero, zero, F.lit(1))))
    return table(spark, sf_dir, "nation").select("n_nationkey", detections.rotation_degrees(m).alias("degrees"))


DISPLAY_MATRIX_ROTATION = "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 AND n_nationkey % 4 <> 1 THEN NULL ELSE n_nationkey % 4 * 90 END AS degrees FROM nation"


def canonical_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an order's line items as normalised points (quantity / 50, discount * 10), valid if not returned."""
    x = table(spark, sf_dir, "lineitem").withColumn("p", F.struct(F.col("l_quantity").alias("q"), F.struct((F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y")).alias("p"), (F.col("l_returnflag") != "R").alias("v")))
    g = x.groupBy("l_orderkey").agg(F.collect_list("p").alias("g"))
    g = g.select("l_orderkey", F.transform("g", lambda e: e["p"]).alias("points"), F.transform("g", lambda e: e["v"]).alias("valid"), F.lit("NORMALIZED").alias("space"), F.lit(641).alias("width"), F.lit(481).alias("height"), F.lit(None).cast("array<double>").alias("matrix"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("box"))
    b = detections.canonical(g)
    ok = F.forall(F.arrays_zip("points", "display_points"), lambda z: detections.reconciles(z["points"]["x"], z["display_points"]["x"], F.lit(641)))
    return b.select("l_orderkey", *(F.round(F.col(f"display_box.{k}").cast("double"), 3).alias(k) for k in ("x0", "y0", "x1", "y1")), ok.alias("reconciles"))


CANONICAL_BOXES = """
SELECT l_orderkey, round(min(CASE WHEN l_returnflag <> 'R' THEN (l_quantity / 50 * 640)::FLOAT END)::DOUBLE, 3) AS x0, round(min(CASE WHEN l_returnflag <> 'R' THEN (l_discount * 10 * 480)::FLOAT END)::DOUBLE, 3) AS y0,
  round(max(CASE WHEN l_returnflag <> 'R' THEN (l_quantity / 50 * 640)::FLOAT END)::DOUBLE, 3) AS x1, round(max(CASE WHEN l_returnflag <> 'R' THEN (l_discount * 10 * 480)::FLOAT END)::DOUBLE, 3) AS y1, true AS reconciles
FROM lineitem GROUP BY l_orderkey
"""


def frame_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames with results, line items as detections and derived selections, with seeded faults, counted by rule."""
    key = ["frame_id"]
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"))
    d = timeseries.ordinals(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "rank").select(F.col("l_orderkey").alias("frame_id"), "rank", F.concat_ws("-", "l_orderkey", "rank").alias("detection_id"))
    n = d.groupBy(*key).agg(F.count("*").alias("n"))
    r = f.join(n, key, "left").select("frame_id", F.coalesce("n", F.lit(0)).alias("detection_count"), F.lit("SUCCESS").alias("inference_status"))
    s = frames.primary_selection(r, d, key, "detection_id", "inference_status").withColumnRenamed("selected", "selected_detection_id")
    r = r.where("frame_id % 40 <> 1").withColumn("detection_count", F.col("detection_count") + F.when(F.col("frame_id") % 30 == 2, 1).otherwise(0))
    d = d.where("frame_id % 100 <> 3 or rank <> 0")
    return contracts.frame_contract(f, r, d, s, key).groupBy("rule").agg(F.count("*").alias("n"))


FRAME_CONTRACT = """
WITH n AS (SELECT o_orderkey AS k, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders), m AS (SELECT k, n, CASE WHEN k % 100 = 3 THEN greatest(n - 1, 0) ELSE n END AS left_, n + CASE WHEN k % 30 = 2 THEN 1 ELSE 0 END AS said FROM n),
x AS (SELECT 'RESULT_NOT_ONE_TO_ONE' AS rule, count(*) AS n FROM m WHERE k % 40 = 1
  UNION ALL SELECT 'DETECTION_COUNT', count(*) FROM m WHERE k % 40 <> 1 AND said <> left_ UNION ALL SELECT 'RANK_NOT_DENSE', count(*) FROM m WHERE left_ > 0 AND left_ < n
  UNION ALL SELECT 'SELECTION_NOT_DERIVED', count(*) FROM m WHERE k % 40 = 1 OR (left_ <> n AND (left_ = 1 OR n = 1 OR left_ = 0)))
SELECT rule, n::BIGINT AS n FROM x WHERE n > 0
"""


def interval_split_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's whole span cut at each signup."""
    e = events(spark, sf_dir)
    spans = e.groupBy("user_id").agg(F.min("time").alias("start"), F.max("time").alias("end"))
    return contracts.split_at(spans, e.where("event_type = 'signup'").select("user_id", F.col("time").alias("at")), KEY)


INTERVAL_SPLIT_AT = """
WITH e AS (SELECT user_id, epoch_us(ts) * 1000 AS t, event_type FROM events), s AS (SELECT user_id, min(t) AS a, max(t) AS z FROM e GROUP BY user_id),
p AS (SELECT user_id, a AS t FROM s WHERE a < z UNION SELECT e.user_id, t FROM e JOIN s ON s.user_id = e.user_id WHERE event_type = 'signup' AND t > a AND t < z)
SELECT p.user_id, t AS "start", coalesce(lead(t) OVER (PARTITION BY p.user_id ORDER BY t), z) AS "end" FROM p JOIN s ON s.user_id = p.user_id
"""


def nearest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .frames_sensors import frame_sensor_index

    s = timeseries.ordinals(events(spark, sf_dir).where("event_type <> 'view'"), KEY, ["time", "event_id"], "ordinal", timeseries.DAY).select("user_id", "ordinal", F.when(F.col("event_type") == "error", 8).when(F.col("event_type") == "signup", 64).otherwise(0).cast("long").alias("quality_bits"))
    return contracts.nearest_quality(frame_sensor_index(spark, sf_dir), s, KEY, KEY)


NEAREST_QUALITY = f"""
WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS o, CASE event_type WHEN 'error' THEN 8 WHEN 'signup' THEN 64 ELSE 0 END AS b FROM events WHERE event_type <> 'view')
SELECT f.user_id, coalesce(bit_or(b), 0)::BIGINT AS quality_bits FROM ({FRAME_SENSOR_INDEX}) f LEFT JOIN s ON s.user_id = f.user_id AND s.o = f.nearest_ordinal GROUP BY f.user_id
"""


def trim_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select(exact.removed_rows(F.lit("raw"), F.col("p_size") % 14 + 1).alias("removed"))
    return contracts.trim_defects(x, "removed")


TRIM_DEFECTS = "SELECT (p_size % 14 + 1) * 25 // 3 AS removed, count(*)::BIGINT AS n, (p_size % 14 + 1) * 25 // 3 % 5 <> 0 AS mid_cycle FROM part GROUP BY 1, 3"


def modality_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that don't have exactly one turn of each of two roles."""
    return reconcile.modality_partition(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["user", "assistant"])


MODALITY_PARTITION = """
SELECT conv_id, count(*) FILTER (role = 'user')::BIGINT AS n_user, count(*) FILTER (role = 'assistant')::BIGINT AS n_assistant, count(*) FILTER (role NOT IN ('user', 'assistant') OR role IS NULL)::BIGINT AS n_other
FROM conversations GROUP BY conv_id HAVING n_user <> 1 OR n_assistant <> 1 OR n_other > 0
"""


def choice_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("v"))
    rows = o.where("o_orderkey % 9 <> 2").withColumn("v", F.when(F.col("o_orderkey") % 7 == 1, 9).otherwise(F.col("v")))
    over = o.where("o_orderkey % 14 = 1").withColumn("v", F.lit(9).cast("long"))
    return contracts.choice_conflicts(o.where("o_orderkey % 11 <> 3"), rows, over, ["o_orderkey"], "v").groupBy("outcome").agg(F.count("*").alias("n"))


CHOICE_CONFLICTS = """
SELECT CASE WHEN o_orderkey % 9 = 2 THEN 'PLOT_ONLY' WHEN o_orderkey % 11 = 3 THEN 'ROW_ONLY' WHEN o_orderkey % 7 <> 1 THEN 'AGREES' WHEN o_orderkey % 14 = 1 THEN 'OVERRIDDEN' ELSE 'CONFLICT' END AS outcome, count(*)::BIGINT AS n
FROM orders WHERE NOT (o_orderkey % 9 = 2 AND o_orderkey % 11 = 3) GROUP BY 1
"""

FUNCTIONS = [
    cosine_angular_range,
    cosine_angular_range_by_label,
    rational_clock_map,
    clock_map_violations,
    frame_classify,
    primary_selection,
    detection_rank,
    trim_overlay,
    sensor_group_classify,
    fk_reconciliation,
    fk_reconciliation_of_all_orders,
    set_reconciliation,
    one_to_one,
    window_id_hash,
    removed_rows,
    exact_ratios,
    geometry_rotate,
    quality_report,
    conversation_turns,
    status_counts,
    replay_comparison,
    table_equality,
    table_semantic_hash,
    snapshot_store,
    sliding_stream,
    display_matrix_rotation,
    canonical_boxes,
    frame_contract,
    interval_split_at,
    nearest_quality,
    trim_defects,
    modality_partition,
    choice_conflicts,
]
