"""Queries over what is stored: hashes of rows in order, footers, archives, documents, replay; and streams with state."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, estimators, rotations, sequences, timeseries
from ..operators.timeseries import DAY
from ..sources import files, parts, ranges, store, texts
from ..sources.files import ship
from ..streaming import streams
from .frames_sensors import KEY, events, hop_windows, table, windowed


def ordered_table_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the orders of each status, by date and key."""
    x = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"))
    return sequences.sequence_hashes(x, ["day", "o_orderkey"], ["o_orderstatus"])


ORDERED_TABLE_HASH = """
WITH x AS (SELECT o_orderstatus, o_orderkey, o_custkey, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders),
d AS (SELECT o_orderstatus, day, o_orderkey, sha256('V' || strlen(o_orderkey::VARCHAR) || ':' || o_orderkey || 'V' || strlen(o_custkey::VARCHAR) || ':' || o_custkey || 'V10:' || strftime(day, '%Y-%m-%d') || coalesce('V' || strlen(priority) || ':' || priority, 'N')) AS h FROM x),
m AS (SELECT o_orderstatus, day, o_orderkey, list_transform([1, 17, 33, 49], lambda i: ('0x' || substr(h, i, 16))::HUGEINT % 2305843009213693951) AS m FROM d),
l AS (SELECT o_orderstatus, count(*) AS n, list(m ORDER BY day, o_orderkey) AS l FROM m GROUP BY 1),
p AS (SELECT o_orderstatus, n, list_reduce(list_prepend([1, 0, 0, 1]::HUGEINT[], l), lambda a, b: [
  (a[1] * b[1] + a[2] * b[3]) % 2305843009213693951, (a[1] * b[2] + a[2] * b[4]) % 2305843009213693951, (a[3] * b[1] + a[4] * b[3]) % 2305843009213693951, (a[3] * b[2] + a[4] * b[4]) % 2305843009213693951]) AS p FROM l)
SELECT o_orderstatus, n::BIGINT AS n_rows, sha256(n || ':' || p[1] || ':' || p[2] || ':' || p[3] || ':' || p[4]) AS sequence_sha256 FROM p
"""



def _after(folder: str) -> Column:
    return F.regexp_extract("path", rf"{re.escape(folder.split('/')[-1])}/(.*)$", 1)


def file_range_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of up to 200 lines, and digests of their ranges of 1,000 bytes."""
    folder, key = files.scratch(spark, "ranges"), F.col("c_custkey")
    line = F.concat_ws(",", key, "c_name", "c_nationkey")
    x = table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 200").alias("g")).agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.concat(line, F.lit("\n")).alias("line")))).alias("l"))
    ranges.write_files(x.select(F.concat("g", F.lit(".csv")).alias("path"), F.array_join(F.transform("l", lambda v: v["line"]), "").alias("content")), folder).write.format("noop").mode("overwrite").save()
    return ranges.file_ranges(spark, folder, 1000).select(_after(folder).alias("file"), "length", "start", "stop", "sha256")


FILE_RANGE_DIGESTS = """
WITH f AS (SELECT (c_custkey // 200) || '.csv' AS file, string_agg(c_custkey || ',' || c_name || ',' || c_nationkey || chr(10), '' ORDER BY c_custkey, c_name, c_nationkey) AS t FROM customer GROUP BY c_custkey // 200),
r AS (SELECT file, t, unnest(range(0, length(t), 1000)) AS a FROM f)
SELECT file, length(t)::BIGINT AS length, a AS start, least(a + 1000, length(t))::BIGINT AS stop, sha256(substr(t, a + 1, 1000)) AS sha256 FROM r
"""


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of such files, with numbers that go through a file however it is read."""
    folder, key = files.scratch(spark, "lines"), F.col("s_suppkey")
    end = F.when(key % 3 == 0, "\r\n").otherwise("\n")
    x = table(spark, sf_dir, "supplier").groupBy(F.expr("s_suppkey div 50").alias("g")).agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.concat("s_name", end).alias("line")))).alias("l"))
    ranges.write_files(x.select(F.concat("g", F.lit(".txt")).alias("path"), F.array_join(F.transform("l", lambda v: v["line"]), "").alias("content")), folder).write.format("noop").mode("overwrite").save()
    return texts.lines(spark, folder).select(_after(folder).alias("file"), "line_number", "line")


NUMBERED_LINES = "SELECT (s_suppkey // 50) || '.txt' AS file, row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) - 1 AS line_number, s_name AS line FROM supplier"


def archive_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as members of archives of up to 300, every ninth archive cut off in the middle; each member is read where it lies."""
    ship(spark)
    folder = files.scratch(spark, "archives")
    x = table(spark, sf_dir, "part").select(F.expr("p_partkey div 300").alias("g"), F.col("p_partkey").alias("k"), F.concat_ws("/", "p_brand", F.col("p_partkey")).alias("member"), F.repeat("p_name", 20).alias("content"))

    def archive(group: pa.Table) -> pa.Table:
        g = group["g"][0].as_py()
        rows = sorted(zip(group["k"].to_pylist(), group["member"].to_pylist(), group["content"].to_pylist(), strict=True))
        data = ranges.zipped((m, c.encode()) for _, m, c in rows)
        ranges.write_file(f"{folder}/{g}.zip", data[: len(data) // 2] if g % 9 == 4 else data)
        return pa.table({"g": [g]})

    x.groupBy("g").applyInArrow(archive, "g long").write.format("noop").mode("overwrite").save()
    index = ranges.archive_index(spark, folder).withColumnRenamed("archive", "path").withColumn("archive", _after(folder))
    broken = index.where("status <> 'OK'").select("archive", F.lit(None).cast("string").alias("member"), F.lit(None).cast("long").alias("size"), F.col("status").alias("state"), F.lit(None).cast("string").alias("sha256"))
    found = ranges.archive_contents(ranges.archive_index(spark, folder), folder).withColumn("path", F.col("archive"))
    return found.select(_after(folder).alias("archive"), "member", "size", "state", "sha256").union(broken)


ARCHIVE_CONTENTS = """
SELECT (p_partkey // 300) || '.zip' AS archive, p_brand || '/' || p_partkey AS member, 20 * strlen(p_name) AS size, 'VERIFIED' AS state, sha256(repeat(p_name, 20)) AS sha256 FROM part WHERE p_partkey // 300 % 9 <> 4
UNION ALL SELECT DISTINCT (p_partkey // 300) || '.zip', NULL, NULL, 'NO_END_RECORD', NULL FROM part WHERE p_partkey // 300 % 9 = 4
"""


def stored_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each status stored in order; what footers say of rows, bounds and nulls, and how many rules are broken."""
    root, found = files.scratch(spark, "groups"), None
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus")
    for status in ("F", "O", "P"):
        store.write_table(x.where(F.col("o_orderstatus") == status), f"{root}/{status}", ["o_orderkey"], rows_per_group=1000)
        f = parts.footers(spark, f"{root}/{status}")
        wrong = parts.layout_violations(f, 1000, sort_key="o_orderkey", kind="long").agg(F.count("*").alias("n_violations"))
        of = lambda column, value: F.when(F.col("column") == column, value)
        y = f.agg(F.sum(of("o_orderkey", F.col("rows"))).alias("n_rows"), F.min(of("o_orderkey", F.col("least").cast("long"))).alias("least"), F.max(of("o_orderkey", F.col("most").cast("long"))).alias("most"), F.sum(of("o_custkey", F.col("nulls"))).alias("n_nulls"))
        y = y.join(wrong).select(F.lit(status).alias("status"), "*")  # a row each
        found = y if found is None else found.union(y)
    return found


STORED_ROW_GROUPS = "SELECT o_orderstatus AS status, count(*)::BIGINT AS n_rows, min(o_orderkey)::BIGINT AS least, max(o_orderkey)::BIGINT AS most, count(*) FILTER (o_custkey % 9 = 0)::BIGINT AS n_nulls, 0::BIGINT AS n_violations FROM orders GROUP BY 1"


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of up to 50 lines; then some are changed, some gone, some new, and trees of digests tell which."""
    before, after, key = files.scratch(spark, "before"), files.scratch(spark, "after"), F.col("c_custkey")
    g = F.expr("c_custkey div 50")
    x = table(spark, sf_dir, "customer").groupBy(g.alias("g")).agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.concat_ws(",", key, "c_name").alias("line")))).alias("l"))
    x = x.select("g", F.concat(F.lit("part/"), F.col("g"), F.lit(".csv")).alias("path"), F.array_join(F.transform("l", lambda v: v["line"]), "\n").alias("content"))
    ranges.write_files(x.where("g % 7 <> 5"), before).write.format("noop").mode("overwrite").save()
    later = x.where("g % 11 <> 3").withColumn("content", F.when(F.col("g") % 5 == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    ranges.write_files(later, after).write.format("noop").mode("overwrite").save()
    return parts.changed_files(parts.listing(spark, before), parts.listing(spark, after))


CHANGED_FILES = """
WITH g AS (SELECT DISTINCT c_custkey // 50 AS g FROM customer), s AS (SELECT g, g % 7 <> 5 AS old, g % 11 <> 3 AS new, g % 5 = 2 AS other FROM g)
SELECT 'part/' || g || '.csv' AS path, CASE WHEN NOT new THEN 'MISSING' WHEN NOT old THEN 'UNLISTED' ELSE 'CHANGED' END AS state FROM s WHERE (old AND NOT new) OR (new AND NOT old) OR (old AND new AND other)
"""


def document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order; some repeat a key, name no number, or don't end where they should."""
    k = F.col("o_orderkey")
    line = F.concat(F.lit('{"id": '), k, F.lit(', "by": {"name": "'), "o_orderstatus", F.lit('", "'), F.when(k % 13 == 5, "name").otherwise("at"), F.lit('": ['), F.when(k % 17 == 3, "NaN").otherwise("1.5"), F.lit("]}"))
    text = F.concat(line, F.when(k % 19 == 7, ', "id": 2').otherwise(""), F.when(k % 23 == 11, "").otherwise("}"), F.when(k % 29 == 1, " x").otherwise(""))
    found = documents.checked(table(spark, sf_dir, "orders").select(k.alias("k"), text.alias("text")), "text")
    return found.select("k", F.array_join(F.transform("problems", lambda p: F.regexp_replace(p, " at [0-9]+$", "")), "|").alias("problems"))


DOCUMENT_PROBLEMS = """
SELECT o_orderkey AS k, array_to_string(list_filter([CASE WHEN o_orderkey % 13 = 5 THEN 'REPEATED_KEY at $.by.name' END, CASE WHEN o_orderkey % 17 = 3 THEN 'NOT_FINITE at $.by.' || CASE WHEN o_orderkey % 13 = 5 THEN 'name' ELSE 'at' END || '[0]' END, CASE WHEN o_orderkey % 19 = 7 THEN 'REPEATED_KEY at $.id' END,
  CASE WHEN o_orderkey % 23 = 11 THEN 'SYNTAX' WHEN o_orderkey % 29 = 1 THEN 'TRAILING_TEXT' END], lambda p: p IS NOT NULL), '|') AS problems FROM orders
"""


def _in_batches(spark: SparkSession, rows: DataFrame, batch: Column, n: int, folder: str, most: int = 1_000_000) -> DataFrame:
    """rows as a stream that comes in n batches, one after the other: each as many files, of about `most` rows (all but the last batch are of like size). Rows are made and stored once, by many tasks."""
    rows.withColumn("__batch", batch).write.partitionBy("__batch").parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")
    each = stored.groupBy("__batch").count().agg(F.max("count")).first()[0] or 0  # one number
    size = max(1, -(-each // most))
    for k in range(n):
        some = stored.where(F.col("__batch") == k).select(*rows.columns)
        (some.coalesce(1) if size == 1 else some.repartition(size)).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", size).parquet(f"{folder}/in")


def epochs_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock epochs of users' events that come in four batches, neighbours in different ones; a last row moves the watermark
    past all of them."""
    e = timeseries.ordinals(events(spark, sf_dir), KEY, ["time", "event_id"], "source_ordinal", DAY)
    x = e.select(F.col("user_id").alias("stream_id"), "source_ordinal", (F.col("time") - F.when(F.col("event_id") % 9 == 4, 30 * DAY).otherwise(0)).alias("native_ns"), F.timestamp_micros(F.expr("time div 1000")).alias("at"))
    end = e.agg(F.timestamp_micros(F.expr("(max(time) + 400L * 86400000000000L) div 1000"))).first()[0]
    x = x.union(spark.createDataFrame([(-1, 0, 0, end)], x.schema))
    batch = F.when(F.col("stream_id") == -1, 4).otherwise(F.pmod(F.xxhash64("stream_id", "source_ordinal"), F.lit(4)))
    folder = files.scratch(spark, "epochs")
    found = streams.run_once(streams.clock_epochs_in_any_order(_in_batches(spark, x, batch, 5, folder), "at", "365 days"), folder)
    return found.where("stream_id <> -1")


EPOCHS_OUT_OF_ORDER = """
WITH e AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS source_ordinal, epoch_us(ts) * 1000 - CASE WHEN event_id % 9 = 4 THEN 2592000000000000 ELSE 0 END AS native_ns FROM events)
SELECT stream_id, source_ordinal, native_ns, sum(back) OVER (PARTITION BY stream_id ORDER BY source_ordinal)::BIGINT AS epoch FROM (SELECT *, CASE WHEN native_ns < lag(native_ns) OVER (PARTITION BY stream_id ORDER BY source_ordinal) THEN 1 ELSE 0 END AS back FROM e)
"""


def windows_and_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in five batches, by id: counts of hop windows, and late rows counted by the day they are of."""
    folder = files.scratch(spark, "late")
    x = events(spark, sf_dir).select("event_type", "time", "event_id")
    stream = _in_batches(spark, x, F.col("event_id") % 5, 5, folder)
    streams.windows_and_ledger(stream, folder, "time", ["event_type"], 4 * DAY, DAY, 10 * DAY)
    counted = streams.counted_windows(spark, folder, "event_type string", 4 * DAY, 10 * DAY).select(F.lit("window").alias("kind"), "event_type", "start", "n", "closed")
    late = streams.ledger(spark, folder, "event_type string, time long, event_id long").groupBy("event_type", (F.floor(F.col("time") / DAY) * DAY).alias("start")).agg(F.count("*").alias("n"))
    return counted.union(late.select(F.lit("late"), "event_type", "start", "n", F.lit(None).cast("boolean")))


WINDOWS_AND_LATE_ROWS = """
WITH e AS (SELECT event_type, epoch_us(ts) * 1000 AS t, event_id % 5 AS b FROM events), m AS (SELECT b, max(t) AS t FROM e GROUP BY b),
n AS (SELECT e.*, (SELECT max(m.t) FROM m WHERE m.b < e.b) AS newest FROM e), l AS (SELECT *, coalesce(t < newest - 864000000000000, false) AS late FROM n),
w AS (SELECT event_type, unnest(range((t - 345600000000000) // 86400000000000 + 1, t // 86400000000000 + 1)) * 86400000000000 AS start FROM l WHERE NOT late)
SELECT 'window' AS kind, event_type, start, count(*)::BIGINT AS n, start + 345600000000000 <= (SELECT max(t) FROM e) - 864000000000000 AS closed FROM w GROUP BY event_type, start
UNION ALL SELECT 'late', event_type, t // 86400000000000 * 86400000000000, count(*)::BIGINT, NULL FROM l WHERE late GROUP BY 2, 3
"""


def laid_out_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of hop windows from tables that were laid out by stream and block, counted and summed."""
    windows = hop_windows(spark, sf_dir).where("imu_n > 0").select(F.concat_ws("-", "user_id", "segment", "k").alias("window_id"), "user_id", "imu_start_ordinal", "imu_stop_ordinal")
    windows = windowed(windows, spark, sf_dir)
    samples = timeseries.ordinals(events(spark, sf_dir).where("event_type <> 'view'"), KEY, ["time", "event_id"], bucket=DAY).select("user_id", "canonical_ordinal", "event_id")
    name = files.scratch(spark, "laid").rsplit("-", 1)[1]
    x = store.lay_out(samples, files.scratch(spark, "rows"), f"rows_{name}", KEY, block=16, buckets=8)
    w = store.lay_out_windows(windows, files.scratch(spark, "ranges"), f"windows_{name}", KEY, "imu_start_ordinal", "imu_stop_ordinal", block=16, buckets=8)
    return store.replay_laid_out(w, x, KEY).groupBy("window_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


LAID_OUT_REPLAY = """
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) * 1000 AS t FROM events), seg AS (SELECT user_id, min(t) AS s, max(t) + 1000 AS e FROM e GROUP BY user_id),
w AS (SELECT user_id, k, s + k * 86400000000000 AS ws FROM (SELECT *, unnest(range(0, (e - s - 345600000000000) // 86400000000000 + 1)) AS k FROM seg WHERE e - s >= 345600000000000))
SELECT w.user_id || '-0-' || k AS window_id, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS total FROM w JOIN e ON e.user_id = w.user_id AND event_type <> 'view' AND t >= ws AND t < ws + 345600000000000 GROUP BY 1
"""


class Drift:
    """A toy estimator: the change of a value since the frame before of its stream, which it keeps in mind."""

    provenance = estimators.Provenance("drift-1", "0" * 64, "1" * 64, "plain")

    def __init__(self):
        self.before = None

    def prepare(self, frame):
        if frame["value"] is None:
            raise estimators.Rejected("no value")
        if frame["event_id"] % 31 == 7:
            raise ValueError("unreadable")
        return frame["value"], frame["event_id"]

    def infer(self, prepared):
        value, number = prepared
        if number % 37 == 5:
            raise RuntimeError("lost")
        before, self.before = self.before, value
        found = () if before is None else (estimators.Detection((value - before,), 0.5),)
        return estimators.Estimate(found, 2.0 if number % 41 == 3 else 1.0)


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift over the events of each user, some of which it rejects, fails at, or misjudges."""
    found = estimators.estimated(events(spark, sf_dir), Drift, KEY, ["time", "event_id"], ["user_id", "event_id"])
    return found.select("user_id", "event_id", "n_detections", F.round(F.get(F.get("detections", F.lit(0))["values"], F.lit(0)), 6).alias("drift"), "tracking_quality", "status", "reason", "model_id")


ESTIMATES = """
WITH e AS (SELECT user_id, event_id, value, ts, CASE WHEN value IS NULL THEN 'REJECTED_INPUT' WHEN event_id % 31 = 7 THEN 'PREPROCESSING_FAILURE' WHEN event_id % 37 = 5 THEN 'INFERENCE_FAILURE' WHEN event_id % 41 = 3 THEN 'INVALID_OUTPUT' ELSE 'SUCCESS' END AS status FROM events),
s AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e WHERE status IN ('SUCCESS', 'INVALID_OUTPUT'))
SELECT e.user_id, e.event_id, CASE WHEN e.status = 'SUCCESS' AND p IS NOT NULL THEN 1 ELSE 0 END AS n_detections, CASE WHEN e.status = 'SUCCESS' THEN round(s.value - p, 6) END AS drift, CASE WHEN e.status = 'SUCCESS' THEN 1.0::DOUBLE END AS tracking_quality, e.status,
  CASE e.status WHEN 'REJECTED_INPUT' THEN 'no value' WHEN 'PREPROCESSING_FAILURE' THEN 'ValueError: unreadable' WHEN 'INFERENCE_FAILURE' THEN 'RuntimeError: lost' WHEN 'INVALID_OUTPUT' THEN 'ValueError: a score outside 0 to 1, or a value that isn''t finite' END AS reason, 'drift-1' AS model_id
FROM e LEFT JOIN s USING (user_id, event_id)
"""

def widest_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest rotation between any two events of a type, of which there are few, so groups are large."""
    a, b = F.col("value") / 40, F.col("user_id") % 97 / 97.0
    q = F.array(F.cos(a), F.sin(a) * F.cos(b), F.sin(a) * F.sin(b), F.lit(0.0))
    x = events(spark, sf_dir).where("value is not null").select("event_type", q.alias("q"))
    return rotations.rotation_ranges(x, ["event_type"], "q").select("event_type", F.round("angle", 5).alias("angle"))


WIDEST_ROTATIONS = """
WITH e AS (SELECT event_type AS t, cos(value / 40) AS w, sin(value / 40) * cos(user_id % 97 / 97.0) AS x, sin(value / 40) * sin(user_id % 97 / 97.0) AS y FROM events WHERE value IS NOT NULL)
SELECT a.t AS event_type, round(2 * acos(least(1.0, min(abs(a.w * b.w + a.x * b.x + a.y * b.y) / sqrt(a.w * a.w + a.x * a.x + a.y * a.y) / sqrt(b.w * b.w + b.x * b.x + b.y * b.y)))), 5) AS angle FROM e a JOIN e b ON a.t = b.t GROUP BY a.t
"""

FUNCTIONS = [
    widest_rotations,
    laid_out_replay,
    estimates,
    epochs_out_of_order,
    windows_and_late_rows,
    stored_row_groups,
    changed_files,
    document_problems,
    ordered_table_hash,
    file_range_digests,
    numbered_lines,
    archive_contents,
]
