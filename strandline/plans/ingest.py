"""Queries over text sources, inventories, ids and checks; lines and paths are made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ..functions import ids
from ..operators import audits, clock, contracts, detections, documents, frames, reconcile, timeseries, validate
from ..operators.timeseries import DAY
from ..schemas import closed
from ..sources import files, ranges, store, texts
from ..streaming import streams
from .frames_sensors import ALIGNMENT_STATUS, HOP_WINDOW_INDEX, HOP_WINDOW_REJECTIONS, KEY, POLICY, _paired, _segments, aligned_events, events, hop_windows, table, windowed
from .frames_sensors import _frames as owned_views
from .frames_sensors import _samples as other_events
from .relational import _CLOCK, _clock, _ordered, _lines, _ORDERED_SQL, _semantic_sql, _values


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def _cases(of: Column, options: list[Column]) -> Column:
    """options[of mod their number]."""
    out = F.when(of % len(options) == 0, options[0])
    for k, o in enumerate(options[1:], 1):
        out = out.when(of % len(options) == k, o)
    return out


def _log_lines(spark: SparkSession, sf_dir: str, faults: bool) -> DataFrame:
    """A sensor log for each user: events in order, as quaternions about one axis; times in half hours of the hour."""
    e = timeseries.ordinals(events(spark, sf_dir), KEY, ["time", "event_id"], "o", DAY)
    angle, i = F.col("value") / 40, F.col("event_id")
    w = F.when(i % 37 == 0, F.lit("2.5")).otherwise(F.coalesce(F.format_string("%.9f", F.cos(angle)), F.lit("")))
    x = F.coalesce(F.format_string("%.9f", F.sin(angle)), F.lit(""))
    hour = F.expr("time div 3600000000000") - (F.when(i % 45 == 11, 1000).otherwise(0) if faults else 0)
    t = F.concat(hour.cast("string"), F.lit(".5"))
    tag = F.lit("QUAT")
    if faults:
        t, tag = F.when(i % 90 == 7, "x").otherwise(t), F.when(i % 70 == 5, "QUAX").otherwise(tag)
    line = F.concat_ws(",", tag, w, x, F.lit("0"), F.lit("0"), *([F.when(i % 50 != 3, t)] if faults else [t]))
    rows = e.select(F.col("user_id").alias("path"), (F.col("o") + 1).alias("line_number"), line.alias("line"), (F.col("user_id") % 13 + 1).alias("activity"))
    head = F.when(F.col("path") % 11 == 0, "QUAT,w").otherwise("QUAT,w,x,y,z,timestamp") if faults else F.lit("QUAT,w,x,y,z,timestamp")
    return rows.union(rows.select("path", "activity").distinct().select("path", F.lit(0).cast("long"), head, "activity"))


def sensor_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.sensor_log(_log_lines(spark, sf_dir, False)).select("path", "sensor_label", "source_epoch_kind", "sample_index", "source_ordinal", "source_line_number", "source_timestamp_token", F.round("qw", 6).alias("qw"), "source_quality_bits")


_LOG_SQL = """
WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) // 3600000000 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS o FROM events),
"""
SENSOR_LOG_ROWS = _LOG_SQL + """
r AS (SELECT *, (CASE WHEN user_id % 13 < 4 THEN ['qsHIPS', 'qsRUL', 'qsRLL', 'qsLUL', 'qsLLL'] ELSE ['qsBACK', 'qsRUA', 'qsRLA', 'qsLUA', 'qsLLA'] END)[o % 5 + 1] AS label, CASE WHEN o < 5 THEN 'NPOSE_CALIBRATION' ELSE 'DYNAMIC_OBSERVATION' END AS kind FROM e),
d AS (SELECT *, coalesce(h = lag(h) OVER q, false) OR coalesce(h = lead(h) OVER q, false) AS dup, value IS NOT NULL AND event_id % 37 <> 0 AS ok FROM r WINDOW q AS (PARTITION BY user_id, label, kind ORDER BY o))
SELECT user_id AS path, label AS sensor_label, kind AS source_epoch_kind, (o // 5)::BIGINT AS sample_index, o AS source_ordinal, (o + 2)::BIGINT AS source_line_number, h || '.5' AS source_timestamp_token, CASE WHEN ok THEN round(printf('%.9f', cos(value / 40))::DOUBLE, 6) END AS qw,
  (CASE WHEN dup THEN 4 ELSE 0 END + CASE WHEN ok THEN 0 ELSE 2048 END)::BIGINT AS source_quality_bits
FROM d
"""


def sensor_log_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(texts.sensor_log_violations(_log_lines(spark, sf_dir, True)), "rule")


SENSOR_LOG_FAULTS = _LOG_SQL + """
f AS (SELECT *, CASE WHEN event_id % 50 <> 3 AND event_id % 90 <> 7 THEN h - CASE WHEN event_id % 45 = 11 THEN 1000 ELSE 0 END END AS t FROM e),
c AS (SELECT user_id, count(DISTINCT t) AS times, max(t) AS m FROM f WHERE o < 5 GROUP BY user_id),
r AS (SELECT 'FIELDS' AS rule, count(*) AS n FROM f WHERE event_id % 50 = 3 UNION ALL SELECT 'TAG', count(*) FROM f WHERE event_id % 70 = 5 UNION ALL SELECT 'TIMESTAMP', count(*) FROM f WHERE t IS NULL
  UNION ALL SELECT 'TIME_REVERSED', count(*) FROM (SELECT lag(t) OVER (PARTITION BY user_id, o % 5 ORDER BY o) > t AS back FROM f) WHERE back
  UNION ALL SELECT 'BEFORE_CALIBRATION', count(*) FROM f JOIN c USING (user_id) WHERE o >= 5 AND t <= m UNION ALL SELECT 'CALIBRATION_TIMES', count(*) FROM c WHERE times <> 1
  UNION ALL SELECT 'CYCLE_INCOMPLETE', count(*) FROM (SELECT user_id FROM f GROUP BY user_id HAVING count(*) % 5 <> 0) UNION ALL SELECT 'HEADER', count(DISTINCT user_id) FROM f WHERE user_id % 11 = 0)
SELECT rule, n::BIGINT AS n FROM r WHERE n > 0
"""


def _pose_lines(spark: SparkSession, sf_dir: str, faults: bool) -> DataFrame:
    v = F.transform(F.concat("embedding", F.slice("embedding", 1, 38)), lambda x: x.cast("string"))
    i = F.col("vec_id")
    v = F.when(i % 10 == 0, F.concat(F.array(*[F.lit("0")] * 3), F.slice(v, 4, 99))).otherwise(v)
    if faults:
        odd = {3: "1", 5: " 1.0", 7: "abc", 9: "NaN"}
        first = F.when(i % 20 == 5, odd[5]).when(i % 20 == 7, odd[7]).when(i % 20 == 9, odd[9]).otherwise(F.get(v, F.lit(0)))
        v = F.concat(F.array(first), F.slice(v, 2, 101), F.when(i % 20 == 3, F.array(F.lit(odd[3]))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "embeddings").select(i.alias("path"), F.lit(1).alias("line_number"), F.array_join(v, ",").alias("line"))


def pose_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = texts.pose_table(_pose_lines(spark, sf_dir, False))
    total = F.aggregate("positions_mm", F.lit(0.0), lambda a, v: a + v)
    return x.select("path", "source_row_ordinal", F.size("positions_mm").cast("long").alias("n_values"), F.round(total, 3).alias("total"), F.size(F.filter("zero_triplet_mask", lambda z: z)).cast("long").alias("n_zero"))


POSE_ROWS = """
WITH v AS (SELECT vec_id, list_transform(list_concat(embedding, embedding[1:38]), lambda x: x::VARCHAR::DOUBLE) AS p FROM embeddings), w AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_concat([0.0, 0.0, 0.0], p[4:]) ELSE p END AS p FROM v)
SELECT vec_id AS path, 0::BIGINT AS source_row_ordinal, len(p)::BIGINT AS n_values, round(list_sum(p), 3) AS total, len(list_filter(range(0, 34), lambda k: p[3 * k + 1] = 0 AND p[3 * k + 2] = 0 AND p[3 * k + 3] = 0))::BIGINT AS n_zero FROM w
"""


def pose_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(texts.pose_violations(_pose_lines(spark, sf_dir, True)), "rule")


POSE_FAULTS = "SELECT CASE vec_id % 20 WHEN 3 THEN 'VALUES' WHEN 5 THEN 'WHITE_SPACE' WHEN 7 THEN 'NO_NUMBER' ELSE 'NOT_FINITE' END AS rule, count(*)::BIGINT AS n FROM embeddings WHERE vec_id % 20 IN (3, 5, 7, 9) GROUP BY 1"


def time_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    token = _cases(F.col("p_partkey"), [F.concat(k, F.lit("."), z), k, F.concat(F.lit("-"), k), F.concat(k, F.lit("."), F.lpad(z, 10, "0")), F.concat(k, F.lit(".")), F.concat(F.lit("0"), k, F.lit(".5"))])
    return table(spark, sf_dir, "part").select("p_partkey", texts.time_key(token).cast("string").alias("key"))


TIME_KEYS = """
WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey || '.' || p_size WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN '-' || p_partkey WHEN 3 THEN p_partkey || '.' || lpad(p_size::VARCHAR, 10, '0') WHEN 4 THEN p_partkey || '.' ELSE '0' || p_partkey || '.5' END AS t FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(t, '\\d+(\\.\\d{1,9})?') THEN (string_split(t, '.')[1]::HUGEINT * 1000000000 + rpad(coalesce(string_split(t, '.')[2], ''), 9, '0')::HUGEINT)::VARCHAR END AS key FROM t
"""

_TWO = lambda c: F.lpad(c.cast("string"), 2, "0")


def _recording(k: Column, trial: Column) -> Column:
    return F.concat(F.lit("S"), _TWO(k % 60 + 1), F.lit("_A"), _TWO(k % 13 + 1), F.lit("_T"), _TWO(trial))


_RECORDING_SQL = "'S' || lpad((k % 60 + 1)::VARCHAR, 2, '0') || '_A' || lpad((k % 13 + 1)::VARCHAR, 2, '0') || '_T' || lpad((k % 4 + 1)::VARCHAR, 2, '0')"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each part: the slots and companions of recordings, some elsewhere, some unknown."""
    k = F.col("p_partkey")
    rec = _recording(k, k % 4 + 1)
    under = lambda *parts: F.concat(F.substring(rec, 1, 3), F.lit("/"), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    options = [under(rec, ".csv"), under(rec, ".raw"), under(rec, "_pose.mp4"), under(rec, "_Npose.csv"), under("ik_", rec, ".mot"), under("ik_", rec, "_orientationErrors.sto"), under(rec, ".sto"), F.concat(F.lit("S99/"), rec, F.lit(".csv")), F.lit("x/y/z.txt"), F.lit("notes/readme.csv"), under(rec, "_A.csv")]
    wide = F.concat(F.lit("S"), (100 + k % 60).cast("string"), F.lit("_A"), (k % 13 + 1).cast("string"), F.lit("_T1"))
    options += [under(rec, ".mot"), under(rec, "_Npose.mp4.out"), under(F.lower(rec), ".csv"), F.concat(F.substring_index(wide, "_", 1), F.lit("/"), wide, F.lit(".raw")), under(rec, "_POSE.mp4"), under(rec, ".CSV")]
    # exploded, so that Spark makes a path once however often it is looked at
    return table(spark, sf_dir, "part").select(k.alias("k"), F.explode(F.array(_cases(k, options))).alias("path"))


_KNOWN = {"notes/readme.csv": ("S01_A01_T01", "RELEASE_NOTE")}


def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.file_classes(_paths(spark, sf_dir), _KNOWN).select("k", "path", "recording", "class", "reason")


_FILES_SQL = f"""
WITH p AS (SELECT p_partkey AS k FROM part), q AS (SELECT k, {_RECORDING_SQL} AS usual FROM p), r AS (SELECT k, CASE WHEN k % 17 = 14 THEN 'S' || (100 + k % 60) || '_A' || (k % 13 + 1) || '_T1' ELSE usual END AS rec FROM q),
m AS (SELECT *, rec IN ('S48_A01_T01', 'S48_A02_T02', 'S48_A03_T02', 'S48_A04_T01', 'S48_A05_T02', 'S48_A06_T02', 'S48_A07_T02', 'S48_A08_T01', 'S48_A09_T01', 'S48_A10_T02', 'S48_A11_T02', 'S48_A12_T02', 'S48_A13_T02') AS plain FROM r),
f AS (
  SELECT k, CASE k % 17 WHEN 8 THEN 'x/y/z.txt' WHEN 9 THEN 'notes/readme.csv' WHEN 7 THEN 'S99/' || rec || '.csv' ELSE string_split(rec, '_')[1] || '/' || CASE WHEN k % 17 IN (4, 5) THEN 'ik_' ELSE '' END || CASE WHEN k % 17 = 13 THEN lower(rec) ELSE rec END
      || CASE k % 17 WHEN 0 THEN '.csv' WHEN 1 THEN '.raw' WHEN 2 THEN '_pose.mp4' WHEN 3 THEN '_Npose.csv' WHEN 4 THEN '.mot' WHEN 5 THEN '_orientationErrors.sto' WHEN 6 THEN '.sto' WHEN 11 THEN '.mot' WHEN 12 THEN '_Npose.mp4.out' WHEN 13 THEN '.csv' WHEN 14 THEN '.raw' WHEN 15 THEN '_POSE.mp4' WHEN 16 THEN '.CSV' ELSE '_A.csv' END END AS path,
    CASE WHEN k % 17 = 9 THEN 'S01_A01_T01' WHEN k % 17 IN (8, 10, 16) OR (k % 17 = 11 AND NOT plain) THEN NULL ELSE rec END AS recording,
    CASE k % 17 WHEN 0 THEN 'POSE' WHEN 13 THEN 'POSE' WHEN 1 THEN 'RAW' WHEN 14 THEN 'RAW' WHEN 2 THEN 'VIDEO' WHEN 15 THEN 'VIDEO' WHEN 7 THEN 'MISPLACED' WHEN 8 THEN 'UNEXPECTED' WHEN 9 THEN 'KNOWN' WHEN 10 THEN 'UNEXPECTED' WHEN 16 THEN 'UNEXPECTED' WHEN 11 THEN CASE WHEN plain THEN 'COMPANION' ELSE 'UNEXPECTED' END ELSE 'COMPANION' END AS class,
    CASE k % 17 WHEN 3 THEN 'NPOSE_CALIBRATION' WHEN 4 THEN 'INVERSE_KINEMATICS' WHEN 5 THEN 'ORIENTATION_ERRORS' WHEN 6 THEN 'MERGED_STORAGE' WHEN 9 THEN 'RELEASE_NOTE' WHEN 11 THEN CASE WHEN plain THEN 'PLAIN_KINEMATICS' END WHEN 12 THEN 'FULL_SIZE_OUTPUT' END AS reason FROM m)
"""
FILE_CLASSES = _FILES_SQL + "SELECT k, path, recording, class, reason FROM f"


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each recording, and the ledger of what is left out, counted by reason."""
    return texts.recordings(texts.file_classes(_paths(spark, sf_dir), _KNOWN))


RECORDINGS = _FILES_SQL + """
SELECT recording, min(path) FILTER (class = 'VIDEO') AS video_path, min(path) FILTER (class = 'POSE') AS pose_path, min(path) FILTER (class = 'RAW') AS raw_path,
  count(*) FILTER (class = 'VIDEO') > 0 AND count(*) FILTER (class = 'POSE') > 0 AND count(*) FILTER (class = 'RAW') > 0 AS complete, count(*) FILTER (class = 'VIDEO') > 1 OR count(*) FILTER (class = 'POSE') > 1 OR count(*) FILTER (class = 'RAW') > 1 AS ambiguous
FROM f WHERE class IN ('VIDEO', 'POSE', 'RAW') GROUP BY recording
"""


def recording_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that a second look finds other files of, and how many."""
    return _counted(texts.strays(texts.file_classes(_paths(spark, sf_dir), _KNOWN)), "recording", "class")


RECORDING_STRAYS = _FILES_SQL + ", g AS (SELECT f.*, m.rec FROM f JOIN m USING (k)) SELECT rec AS recording, class, count(*)::BIGINT AS n FROM g WHERE class IN ('UNEXPECTED', 'MISPLACED') AND k % 17 <> 8 GROUP BY ALL"


def exclusion_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = texts.file_classes(_paths(spark, sf_dir), _KNOWN).withColumn("sha256", F.sha2("path", 256))
    return _counted(texts.exclusions(x.drop("reason"), F.when(F.col("class") == "KNOWN", "KNOWN").when(F.col("class") == "COMPANION", "COMPANION")), "path", "reason", "sha256")


EXCLUSION_LEDGER = _FILES_SQL + "SELECT path, class AS reason, sha256(path) AS sha256, count(*)::BIGINT AS n FROM f WHERE class IN ('KNOWN', 'COMPANION') GROUP BY ALL"


def modality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = texts.file_classes(_paths(spark, sf_dir), _KNOWN).withColumn("extension", F.regexp_extract("path", r"\.([^.]+)$", 1))
    return texts.pair_modalities(x, {"mp4": "video", "csv": "pose", "raw": "quaternion"})


MODALITY_PAIRS = _FILES_SQL + """
, g AS (SELECT recording, min(path) FILTER (path LIKE '%.mp4') AS video, min(path) FILTER (path LIKE '%.csv') AS pose, min(path) FILTER (path LIKE '%.raw') AS quaternion, count(*) AS c FROM f WHERE recording IS NOT NULL GROUP BY recording)
SELECT recording, video, pose, quaternion, video IS NOT NULL AND pose IS NOT NULL AND quaternion IS NOT NULL AS inventory_complete, (c - (video IS NOT NULL)::INT - (pose IS NOT NULL)::INT - (quaternion IS NOT NULL)::INT)::BIGINT AS n_extra FROM g
"""


def _instruction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rec, kind = _recording(k, k % 99 + 1), _cases(k, [F.lit(x) for x in ("csv", "mot", "raw", "mp4")])
    subject = F.when(k % 41 == 0, "X1").otherwise(F.substring(rec, 1, 3))
    file = F.concat(F.lit("D:\\data\\"), F.when(kind == "mot", "ik_").otherwise(""), subject, F.substring(rec, 4, 8), F.when(k % 29 == 0, "b").otherwise(""), F.lit("."), kind)
    fields = [subject, F.substring(rec, 5, 3), F.substring(rec, 9, 3), file, F.when(k % 43 == 0, "avi").otherwise(kind), (k % 16).cast("string"), F.when(k % 37 == 0, "x").otherwise("1.25"), F.when(k % 31 != 0, "0.5")]
    return table(spark, sf_dir, "orders").select(F.lit("info").alias("path"), k.alias("line_number"), F.concat_ws(",", *fields).alias("line"), k.alias("k"))


def instruction_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trim instruction for each order; some break a rule."""
    return _counted(texts.instructions(_instruction_lines(spark, sf_dir)), "type", "problem")


_INSTRUCTIONS_SQL = """
WITH i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 41 = 0 THEN 'X1' ELSE 'S' || lpad((o_orderkey % 60 + 1)::VARCHAR, 2, '0') END || '_A' || lpad((o_orderkey % 13 + 1)::VARCHAR, 2, '0') || '_T' || lpad((o_orderkey % 99 + 1)::VARCHAR, 2, '0') AS rec,
  CASE WHEN o_orderkey % 43 = 0 THEN 'avi' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'mot' WHEN 2 THEN 'raw' ELSE 'mp4' END END AS type FROM orders WHERE o_orderkey > 0),
p AS (
  SELECT *, CASE WHEN k % 31 = 0 THEN 'WIDTH' WHEN k % 41 = 0 OR k % 43 = 0 THEN 'IDENTITY' WHEN k % 29 = 0 THEN 'FILE' WHEN k % 37 = 0 THEN 'NUMBERS' WHEN k % 16 NOT BETWEEN 1 AND 14 THEN 'RANGE' WHEN count(*) OVER (PARTITION BY rec, type) > 1 THEN 'REPEATED' END AS problem FROM i)
"""
INSTRUCTION_PROBLEMS = _INSTRUCTIONS_SQL + "SELECT type, problem, count(*)::BIGINT AS n FROM p GROUP BY ALL"


def cuts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions without a problem, a recording a row; kinds are made to meet in one trial."""
    x = texts.instructions(_instruction_lines(spark, sf_dir)).where("problem is null").withColumn("trial", F.lit("all"))
    return texts.by_kind(x)


CUTS_BY_KIND = _INSTRUCTIONS_SQL + """
, g AS (SELECT string_split(rec, '_')[1] AS subject, string_split(rec, '_')[2] AS activity, 'all' AS trial, max((k % 16)::INT) FILTER (type = 'csv') AS csv, max((k % 16)::INT) FILTER (type = 'mot') AS mot, max((k % 16)::INT) FILTER (type = 'mp4') AS mp4, max((k % 16)::INT) FILTER (type = 'raw') AS raw FROM p WHERE problem IS NULL GROUP BY ALL)
SELECT *, len(list_distinct(list_filter([csv, mot, mp4, raw], lambda c: c IS NOT NULL))) <= 1 AS agree FROM g
"""


def plot_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plot's text for each part; some are cut on both sides, too far, of another activity, or stated twice."""
    k = F.col("p_partkey")
    rec = F.concat(F.lit("S"), _TWO(k % 99 + 1), F.lit("_A"), _TWO(k % 13 + 1), F.lit("_T"), _TWO(F.expr("p_partkey div 1287 % 99 + 1")))
    imu, vid = F.when(k % 50 == 0, 1).when(k % 3 == 0, k % 20).otherwise(0), F.when(k % 50 == 0, 1).when(k % 3 == 1, k % 17).otherwise(0)
    one = F.concat(F.lit("<!-- "), rec, F.lit(".mot (Angle: knee) -->\n<g/>\n<!-- SHIFTED, RMSE: 1."), _TWO(k % 100), F.lit("  (cut imu:"), imu.cast("string"), F.lit(", cut vid:"), vid.cast("string"), F.lit(") -->\n"))
    text = F.concat(F.lit("<svg>"), one, F.when(k % 31 == 0, one).otherwise(""), F.lit("<!-- SHIFTED, RMSE: 9.99 --></svg>"))
    activity = F.when(k % 23 == 0, "A99").otherwise(F.concat(F.lit("A"), _TWO(k % 13 + 1)))
    x = texts.choices(table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), activity.alias("activity")), "activity")
    return x.select("p_partkey", "recording", "rmse", "imu_cut", "video_cut", "direction", "problem")


PLOT_CHOICES = """
WITH p AS (SELECT p_partkey AS k, 'S' || lpad((p_partkey % 99 + 1)::VARCHAR, 2, '0') || '_A' || lpad((p_partkey % 13 + 1)::VARCHAR, 2, '0') || '_T' || lpad((p_partkey // 1287 % 99 + 1)::VARCHAR, 2, '0') AS recording, unnest(range(0, CASE WHEN p_partkey % 31 = 0 THEN 2 ELSE 1 END)) AS c FROM part),
q AS (SELECT *, '1.' || lpad((k % 100)::VARCHAR, 2, '0') AS rmse, (CASE WHEN k % 50 = 0 THEN 1 WHEN k % 3 = 0 THEN k % 20 ELSE 0 END)::INT AS imu_cut, (CASE WHEN k % 50 = 0 THEN 1 WHEN k % 3 = 1 THEN k % 17 ELSE 0 END)::INT AS video_cut FROM p)
SELECT k AS p_partkey, recording, rmse, imu_cut, video_cut, CASE WHEN imu_cut > 0 THEN 'IMU' WHEN video_cut > 0 THEN 'VIDEO' ELSE 'ZERO' END AS direction,
  CASE WHEN imu_cut > 0 AND video_cut > 0 THEN 'BOTH_CUT' WHEN greatest(imu_cut, video_cut) > 14 THEN 'RANGE' WHEN k % 23 = 0 THEN 'ACTIVITY' WHEN count(*) OVER (PARTITION BY recording) > 1 THEN 'REPEATED' END AS problem FROM q
"""


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as listed files, found under names in other case and form; some missing, some changed."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("k"), F.concat(F.lit("./Café/"), k.cast("string"), F.lit(".RAW")).alias("path"), k.alias("length"), F.sha2(k.cast("string"), 256).alias("sha256"))
    found = s.where("k % 5 <> 2").select(F.concat(F.lit("cafe\u0301/"), k_ := F.col("k").cast("string"), F.lit(".raw")).alias("path"), F.when(F.col("k") % 5 == 3, F.col("length") + 1).otherwise(F.col("length")).alias("length"), F.when(F.col("k") % 5 == 4, "0").otherwise(F.sha2(k_, 256)).alias("sha256"))
    return texts.verify_members(s, found).select("k", "status")


ARCHIVE_MEMBERS = "SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 2 THEN 'UNAVAILABLE' WHEN 3 THEN 'MISMATCH' WHEN 4 THEN 'MISMATCH' ELSE 'VERIFIED' END AS status FROM supplier"


def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = k.cast("string")
    path = _cases(k, [F.concat(F.lit("a/"), t), F.concat(F.lit("/a/"), t), F.concat(F.lit("a/../"), t), F.concat(F.lit("a\\"), t), F.concat(F.lit("a//"), t), F.lit("Same/x"), F.lit("same/X"), F.concat(F.lit("c:"), t)])
    return _counted(texts.path_problems(table(spark, sf_dir, "orders").select(path.alias("path"))), "problem")


UNSAFE_PATHS = """
WITH p AS (SELECT o_orderkey % 8 AS c FROM orders),
r AS (SELECT 'ABSOLUTE' AS problem, count(*) AS n FROM p WHERE c IN (1, 7) UNION ALL SELECT 'ESCAPES', count(*) FROM p WHERE c = 2 UNION ALL SELECT 'BACKSLASH', count(*) FROM p WHERE c = 3 UNION ALL SELECT 'EMPTY_PART', count(*) FROM p WHERE c = 4
  UNION ALL SELECT 'COLLIDES', CASE WHEN count(*) FILTER (c = 5) > 0 AND count(*) FILTER (c = 6) > 0 THEN count(*) FILTER (c IN (5, 6)) ELSE 0 END FROM p)
SELECT problem, n::BIGINT AS n FROM r WHERE n > 0
"""


def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance times: right ones, and ones without Z, with an offset, of a day that isn't there, with white space."""
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = _cases(k, [F.concat(d, F.lit("T12:34:56Z")), F.concat(d, F.lit("T23:59:59.123456Z")), F.concat(d, F.lit("T12:34:56")), F.concat(d, F.lit("T12:34:56+00:00")), F.lit("2023-02-29T00:00:00Z"), F.concat(d, F.lit(" 12:34:56Z")), F.concat(d, F.lit("T24:00:00Z")), F.concat(d, F.lit("T12:61:00Z"))])
    at = texts.utc_time(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", at.isNotNull().alias("valid"), F.unix_seconds(at).alias("seconds"))


UTC_TIMES = "SELECT o_orderkey, o_orderkey % 8 < 2 AS valid, CASE o_orderkey % 8 WHEN 0 THEN epoch(o_orderdate)::BIGINT + 45296 WHEN 1 THEN epoch(o_orderdate)::BIGINT + 86399 END AS seconds FROM orders"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of suppliers for each nation, written as a JSON document and read back under its closed schema."""
    path = files.scratch(spark, "catalogue")
    x = table(spark, sf_dir, "supplier").groupBy("s_nationkey", F.expr("s_suppkey div 100").alias("g")).agg(F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))).alias("parts"))
    name = F.concat_ws("-", "s_nationkey", "g")
    ranges.write_files(x.select(F.concat(name, F.lit(".json")).alias("path"), F.to_json(F.struct(name.alias("name"), "parts")).alias("content")), path).write.format("noop").mode("overwrite").save()
    x = texts.catalog(spark, path, "name string, parts array<struct<key: int, name: string>>").select("name", F.explode("parts").alias("p"))
    return x.select(F.col("name").alias("catalogue"), F.col("p.key").cast("long").alias("key"), F.col("p.name").alias("part"))


CATALOGUE = "SELECT s_nationkey || '-' || s_suppkey // 100 AS catalogue, s_suppkey::BIGINT AS key, s_name AS part FROM supplier"


def bundle_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of each status of orders, as far as it can be stored: those of one status can't be read. What ended, with the
    rows and digests of what was stored, and the recordings that are left for the next run."""
    root = files.scratch(spark, "bundles")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        rows = o.where(F.col("o_orderstatus") == status)
        if status == "P":
            rows = rows.withColumn("o_custkey", F.when(F.col("o_custkey") >= 0, F.raise_error(F.lit("unreadable")).cast("long")).otherwise(F.col("o_custkey")))
        try:
            store.publish_bundle(spark, root, f"status-{status}", {"orders": rows}, {"orders": ["o_orderkey"]})
        except Exception as why:  # what failed is in the ledger
            if "unreadable" not in str(why):
                raise
    every = o.select(F.concat(F.lit("status-"), "o_orderstatus").alias("recording_id")).union(o.select(F.concat(F.lit("customer-"), F.col("o_custkey") % 3))).distinct()
    left = store.unfinished(spark, root, every).select("recording_id", F.lit("UNFINISHED").alias("state"), F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("string").alias("semantic_sha256"))
    return store.ended_tables(spark, root).select("recording_id", "state", F.col("rows").alias("n_rows"), "semantic_sha256").union(left)


_ORDERS = {"o_orderkey": LongType(), "o_custkey": LongType(), "o_orderstatus": StringType()}
BUNDLE_LEDGER = "WITH " + ", ".join(f"orders_{s} AS (SELECT * FROM orders WHERE o_orderstatus = '{s}')" for s in "FO") + "".join(
    f" SELECT 'status-{s}' AS recording_id, 'SUCCESS' AS state, (SELECT count(*) FROM orders_{s})::BIGINT AS n_rows, semantic_sha256 FROM ({_semantic_sql(f'orders_{s}', _ORDERS)}) UNION ALL" for s in "FO"
) + " SELECT DISTINCT 'status-P', 'FAILURE', NULL, NULL FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT DISTINCT 'customer-' || o_custkey % 3, 'UNFINISHED', NULL, NULL FROM orders"


def snapshot_window_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = files.scratch(spark, "windows")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("window_id"), "n_regionkey")
    store.publish(spark, root, {"window_index": n}, {"source": "nations"}, "one", {"window_index": ["n_regionkey"]})
    store.publish(spark, root, {"window_index": n.where("n_regionkey <> 2")}, {"source": "nations"}, "two", {"window_index": ["n_regionkey"]})
    return store.Snapshot(spark, root).window_ids()


SNAPSHOT_WINDOW_IDS = "SELECT n_name AS window_id FROM nation WHERE n_regionkey <> 2"


def closed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views in the closed schema of frames."""
    x = timeseries.ordinals(events(spark, sf_dir).where("event_type = 'view'"), KEY, ["time", "event_id"], bucket=DAY)
    x = frames.rates(x.withColumn("canonical_time_ns", F.col("time")), KEY, "canonical_time_ns", ["canonical_ordinal"], bucket=validate.ORDINALS)
    made = {"recording_id": F.lit("r"), "video_stream_id": F.col("user_id"), "clock_epoch_id": F.lit("e"), "frame_index": 1000 + 2 * F.col("canonical_ordinal"), "source_ordinal": F.col("event_id"), "video_pts_native_ns": F.col("time"), "decode_status": F.lit("OK"), "width": F.lit(640), "height": F.lit(480), "quality_bits": F.lit(0)}
    x = x.select(*(c.alias(n) for n, c in made.items()), "canonical_ordinal", "canonical_time_ns", F.round("effective_fps", 9).alias("effective_fps"), "gap_before_ms")
    return closed(x, "frame_index")


CLOSED_FRAMES = """
WITH v AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS t, row_number() OVER q - 1 AS o, lag(epoch_us(ts) * 1000) OVER q AS p, lead(epoch_us(ts) * 1000) OVER q AS n FROM events WHERE event_type = 'view' WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT 'r' AS recording_id, user_id::VARCHAR AS video_stream_id, 'e' AS clock_epoch_id, 1000 + 2 * o AS frame_index, event_id AS source_ordinal, o AS canonical_ordinal, t AS video_pts_native_ns, t AS canonical_time_ns, 'OK' AS decode_status, 640 AS width, 480 AS height,
  round(1e9 / nullif(coalesce(n - t, t - p), 0), 9) AS effective_fps, (t - p) / 1e6 AS gap_before_ms, 0::BIGINT AS quality_bits FROM v
"""


def given_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given boxes of line items in coded pixels of a frame turned by 90 degrees, normalised, or displayed."""
    q = F.col("l_quantity")
    x = _ordered(_lines(spark, sf_dir).join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").distinct(), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]))
    coded = F.col("l_linenumber") % 3 == 0
    scale = F.when(F.col("l_linenumber") % 3 == 1, F.lit(0.01)).otherwise(F.lit(1.0))
    box = F.struct((q * scale).cast("double").alias("x0"), ((q + 1) * scale).cast("double").alias("y0"), ((q + 5) * scale).cast("double").alias("x1"), ((q + 9) * scale).cast("double").alias("y1"))
    x = x.select("l_orderkey", "decode_ordinal", F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).alias("points"), F.array(F.lit(True)).alias("valid"), F.when(coded, "CODED").when(F.col("l_linenumber") % 3 == 1, "NORMALIZED").otherwise("DISPLAY").alias("space"), F.lit(101).alias("width"), F.lit(201).alias("height"), frames.display_transform(F.lit(101), F.lit(201), F.lit(90)).alias("matrix"), box.alias("box"))
    return detections.canonical(x).select("l_orderkey", "decode_ordinal", *(F.round(F.col(f"display_box.{c}").cast("double"), 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


GIVEN_BOXES = f"""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS q FROM lineitem),
o AS ({_ORDERED_SQL}), x AS (SELECT o.l_orderkey, decode_ordinal, l_linenumber % 3 AS c, q FROM o JOIN l USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice))
SELECT l_orderkey, decode_ordinal, round((CASE c WHEN 0 THEN q + 1 WHEN 1 THEN q * 0.01 * 100 ELSE q END)::DOUBLE, 3) AS x0, round((CASE c WHEN 0 THEN 100 - (q + 5) WHEN 1 THEN (q + 1) * 0.01 * 200 ELSE q + 1 END)::DOUBLE, 3) AS y0,
  round((CASE c WHEN 0 THEN q + 9 WHEN 1 THEN (q + 5) * 0.01 * 100 ELSE q + 5 END)::DOUBLE, 3) AS x1, round((CASE c WHEN 0 THEN 100 - q WHEN 1 THEN (q + 9) * 0.01 * 200 ELSE q + 9 END)::DOUBLE, 3) AS y1 FROM x
"""


def authority_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = _cases(F.col("n_nationkey"), [F.lit("RAW_SHARED"), F.lit("RAW_MAPPED"), F.lit("SOURCE_DERIVED"), F.lit("NONE"), F.lit(None).cast("string")])
    return table(spark, sf_dir, "nation").select("n_nationkey", contracts.eligible(tier).alias("eligible"))


AUTHORITY_TIERS = "SELECT n_nationkey, n_nationkey % 5 < 3 AS eligible FROM nation"


def materialized_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored times that the clock map doesn't give, by epoch."""
    e = events(spark, sf_dir).select(F.lit("r").alias("recording_id"), F.lit(0).cast("long").alias("stream_id"), "event_id", F.col("time").alias("native_ns"))
    x = clock.map_times(e, _clock(spark), "native_ns")
    epoch = F.lit(None).cast("string")
    for r in _CLOCK:
        epoch = F.when((F.col("native_ns") >= r[6]) & (F.col("native_ns") < r[7]), r[1]).otherwise(epoch)
    x = x.withColumn("clock_epoch_id", epoch).withColumn("canonical_time_ns", F.col("canonical_time_ns") + F.when(F.col("event_id") % 100 == 9, 1).otherwise(0)).drop("map_status")
    return _counted(clock.materialized_violations(x, _clock(spark), "native_ns", "clock_epoch_id"), "clock_epoch_id", "map_status")


MATERIALIZED_TIMES = f"""
WITH m(stream_id, e, c, a, ss, se, ns, ne, na, ca, n, d) AS (VALUES {_values(_CLOCK)})
SELECT e AS clock_epoch_id, 'MAPPED' AS map_status, count(*)::BIGINT AS n FROM events JOIN m ON epoch_us(ts) * 1000 >= ns AND epoch_us(ts) * 1000 < ne WHERE event_id % 100 = 9 AND e <> 'e3' GROUP BY e
"""


def clock_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity runs of the clock map for each nation; the second epoch's residual is too large for one of them, and
    source ordinals jump in another, which doesn't matter."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    x = _clock(spark).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24)).cast("array<long>"))).join(n, "k").withColumn("stream_id", F.col("k"))
    x = x.withColumn("residual_p95_ms", F.when((F.col("k") == 1) & (F.col("clock_epoch_id") == "e1"), 50.0).otherwise(3.0)).withColumn("source_start_ordinal", F.col("source_start_ordinal") + F.when((F.col("k") == 2) & (F.col("clock_epoch_id") == "e1"), 7).otherwise(0))
    usable = (F.col("mapping_status") == "VALID") & (F.col("residual_p95_ms") <= 10)
    return timeseries.clock_runs(clock.with_bounds(x), ["stream_id"], usable).select("stream_id", "run_id", "start", "end")


CLOCK_CONTINUITY = """
SELECT n_nationkey::BIGINT AS stream_id, run_id, "start", "end" FROM nation, (VALUES ('c0:e0', 1000::BIGINT, 1209600000001000::BIGINT), ('c1:e2', 1209600000005000::BIGINT, 1468800000005000::BIGINT)) r(run_id, "start", "end") WHERE n_nationkey <> 1
UNION ALL SELECT n_nationkey::BIGINT, run_id, "start", "end" FROM nation, (VALUES ('c0:e0', 1000::BIGINT, 605404800001000::BIGINT), ('c1:e2', 1209600000005000::BIGINT, 1468800000005000::BIGINT)) r(run_id, "start", "end") WHERE n_nationkey = 1
"""


def keypoint_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_returnflag") != "R").alias("flags"))
    return x.select("l_orderkey", F.round(frames.valid_fraction(F.when(F.col("l_orderkey") % 9 != 0, F.col("flags"))), 9).alias("fraction"))


KEYPOINT_FRACTIONS = "SELECT l_orderkey, CASE WHEN l_orderkey % 9 = 0 THEN 0.0 ELSE round(avg((l_returnflag <> 'R')::INT), 9) END AS fraction FROM lineitem GROUP BY l_orderkey"


def uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.when(F.col("l_suppkey") % 4 != 0, F.col("l_returnflag")))
    return reconcile.uniform(x, ["l_orderkey"], ["l_returnflag", "l_linestatus"])


UNIFORMITY = """
WITH x AS (SELECT l_orderkey, CASE WHEN l_suppkey % 4 <> 0 THEN l_returnflag ELSE '-' END AS f, l_linestatus AS s FROM lineitem)
SELECT l_orderkey, 'l_returnflag' AS "column" FROM x GROUP BY 1 HAVING count(DISTINCT f) > 1 UNION ALL SELECT l_orderkey, 'l_linestatus' FROM x GROUP BY 1 HAVING count(DISTINCT s) > 1
"""


def payload_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.concat_ws(":", F.col("l_partkey") % 3, F.col("l_suppkey") % 2)
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", payload.cast("binary").alias("payload"))
    return detections.payload_rank(x, ["l_orderkey"], "payload").select("l_orderkey", F.col("payload").cast("string").alias("payload"), "rank", "same_payload_rank")


PAYLOAD_RANKS = """
WITH x AS (SELECT l_orderkey, (l_partkey % 3) || ':' || (l_suppkey % 2) AS payload FROM lineitem)
SELECT l_orderkey, payload, rank, rank - min(rank) OVER (PARTITION BY l_orderkey, payload) AS same_payload_rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY payload) - 1 AS rank FROM x)
"""


def frame_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _ordered(_lines(spark, sf_dir)).withColumn("pts", F.when(F.col("l_partkey") % 17 != 0, F.col("pts")))
    x = frames.classify(x, ["l_orderkey"], gap=30)
    made = ids.frame_id("frame-1", F.sha2(F.col("l_orderkey").cast("string"), 256), F.lit(0), F.col("pts"), F.col("same_pts_rank"), F.col("decode_ordinal"))
    return x.select("l_orderkey", "decode_ordinal", made.alias("i")).select("l_orderkey", "decode_ordinal", "i.*")


FRAME_IDS = f"""
WITH x AS (SELECT *, CASE WHEN l_partkey % 17 <> 0 THEN day END AS pts FROM ({_ORDERED_SQL})), y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, pts ORDER BY decode_ordinal) - 1 AS r, sha256(l_orderkey::VARCHAR) AS s FROM x)
SELECT l_orderkey, decode_ordinal, CASE WHEN pts IS NULL THEN 'MISSING_PTS_DECODE_ORDINAL' ELSE 'SOURCE_PTS_SAME_PTS_RANK' END AS identity_basis,
  sha256(CASE WHEN pts IS NULL THEN '{{"decode_ordinal":' || decode_ordinal || ',"domain":"frame-1","identity_basis":"MISSING_PTS_DECODE_ORDINAL","source_video_sha256":"' || s || '","stream_index":0}}'
    ELSE '{{"domain":"frame-1","identity_basis":"SOURCE_PTS_SAME_PTS_RANK","pts":' || pts || ',"same_pts_rank":' || r || ',"source_video_sha256":"' || s || '","stream_index":0}}' END) AS frame_id FROM y
"""


def detection_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as landmarks of a frame each label is; -0.0 and 0.0 are one, and equal payloads differ by their rank."""
    v = F.col("embedding").cast("array<double>")
    flip = F.when(F.col("vec_id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0))
    frame, model = F.sha2(F.col("label").cast("string"), 256), F.sha2(F.lit("model"), 256)
    x = table(spark, sf_dir, "embeddings").withColumn("g", F.expr("vec_id div 2")).withColumn("xy", F.array(flip, F.lit(1.5)))
    payload = ids.detection_payload("detection-1", frame, model, F.when(F.col("g") % 2 == 0, "Left"), F.slice(v, 1, 4), F.col("xy"), F.lit(None).cast("array<double>"), F.lit(None).cast("double"), F.lit(0.5), F.lit(None).cast("array<double>"), F.array(F.lit(True), F.lit(False)))
    x = x.select("vec_id", "label", payload.alias("payload"))
    x = detections.payload_rank(x, ["label"], "payload")
    return x.select("label", "rank", ids.detection_id(F.col("payload"), F.col("same_payload_rank")).alias("detection_id"))


def unsorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(validate.unsorted(events(spark, sf_dir).select("event_type", "event_id", "value"), ["event_type"], ["value"], "event_id").select("rule"), "rule")


UNSORTED_ROWS = "SELECT 'UNSORTED' AS rule, count(*)::BIGINT AS n FROM (SELECT value AS v, lag(value) OVER q AS p, row_number() OVER q AS r FROM events WINDOW q AS (PARTITION BY event_type ORDER BY event_id)) WHERE r > 1 AND (p > v OR (p IS NULL AND v IS NOT NULL)) HAVING count(*) > 0"


def stream_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and samples as rows of one stream, told apart by kind."""
    v, s = _paired(events(spark, sf_dir))
    return v.select("user_id", "time", "ordinal", F.lit("frame").alias("kind")).unionByName(s.select("user_id", "time", "ordinal", F.lit("sample").alias("kind")))


STREAM_UNION = """
SELECT user_id, epoch_us(ts) * 1000 AS time, row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts, event_id) - 1 AS ordinal, CASE WHEN event_type = 'view' THEN 'frame' ELSE 'sample' END AS kind FROM events
"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    return files.scratch(spark, "stream")


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = streams.totals_once(streams.gap_sessions(_stream(spark, sf_dir), "at", ["event_type"], "2 hours", "1 hour"), _folder(spark))
    return x.select("event_type", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


SESSION_STREAM = """
WITH d AS (SELECT event_type, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER q < 7200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW q AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM d)
SELECT event_type, min(t) AS "start", max(t) + 7200000000 AS "end", count(*)::BIGINT AS n FROM s GROUP BY event_type, s
"""


def epoch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events by id; a time that runs back opens an epoch."""
    s = _stream(spark, sf_dir).select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("source_ordinal"), F.unix_micros("at").alias("native_ns"))
    return streams.run_once(streams.clock_epochs(s), _folder(spark))


EPOCH_STREAM = """
WITH d AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) < lag(epoch_us(ts)) OVER q THEN 1 ELSE 0 END AS back FROM events WINDOW q AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS stream_id, event_id AS source_ordinal, t AS native_ns, sum(back) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM d
"""


def repeat_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = streams.run_once(streams.without_repeats(_stream(spark, sf_dir), "at", ["user_id", "event_type"], "3650 days"), _folder(spark))
    return x.select("user_id", "event_type")


REPEAT_STREAM = "SELECT DISTINCT user_id, event_type FROM events"


def imu_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, value = F.col("event_id"), F.coalesce("value", F.lit(0.0))
    e = timeseries.ordinals(events(spark, sf_dir), KEY, ["time", "event_id"], bucket=DAY)
    kind = F.when(i % 97 == 0, "NOTHING").when(F.col("user_id") % 2 == 0, "QUATERNION").otherwise("ACCEL")
    accel, turned = F.col("user_id") % 2 == 1, F.col("user_id") % 2 == 0
    made = {"ax": F.when(accel & (i % 31 != 0), value), "ay": F.when(accel, F.when(i % 41 == 0, float("nan")).otherwise(0.0)), "az": F.when(accel, 0.0), "gx": F.when(i % 43 == 0, 1.0), "gy": F.lit(None).cast("double"), "gz": F.lit(None).cast("double"), "qw": F.when(turned, F.when(i % 37 == 0, 2.0).otherwise(1.0)), "qx": F.when(turned, 0.0), "qy": F.when(turned & (i % 29 != 0), 0.0), "qz": F.when(turned, 0.0)}
    x = e.select("user_id", "canonical_ordinal", kind.alias("payload_kind"), F.when(i % 2 == 0, 2048).otherwise(0).cast("long").alias("validity_bits"), *(c.alias(n) for n, c in made.items()))
    return _counted(validate.imu_rows(x, KEY), "rule")


IMU_FAULTS = """
WITH e AS (SELECT event_id AS i, user_id % 2 = 0 AS q, event_id % 97 <> 0 AS known, user_id AS u, event_id % 2 = 0 AS flag FROM events),
r AS (SELECT 'KIND_UNKNOWN' AS rule, count(*) AS n FROM e WHERE NOT known UNION ALL SELECT 'MISSING_NOT_FLAGGED', count(*) FROM e WHERE known AND NOT flag AND ((NOT q AND i % 31 = 0) OR (q AND i % 29 = 0)) UNION ALL SELECT 'CHANNEL_FORBIDDEN', count(*) FROM e WHERE known AND i % 43 = 0
  UNION ALL SELECT 'NOT_UNIT', count(*) FROM e WHERE known AND q AND i % 37 = 0 AND i % 29 <> 0 UNION ALL SELECT 'NOT_FINITE', count(*) FROM e WHERE known AND NOT q AND i % 41 = 0
  UNION ALL SELECT 'SEVERAL_KINDS', count(*) FROM (SELECT u FROM e GROUP BY u HAVING count(DISTINCT known) > 1))
SELECT rule, n::BIGINT AS n FROM r WHERE n > 0
"""


def frame_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with derived rates and gaps, some of them changed, some sizes and statuses wrong."""
    i, n = F.col("event_id"), ["user_id"]
    x = timeseries.ordinals(events(spark, sf_dir).where("event_type = 'view'"), n, ["time", "event_id"], bucket=DAY).withColumn("canonical_time_ns", F.col("time")).withColumn("clock_epoch_id", F.lit("e"))
    x = frames.rates(x, n, "canonical_time_ns", ["canonical_ordinal"], "clock_epoch_id", bucket=validate.ORDINALS)
    x = x.withColumn("effective_fps", F.when(i % 30 == 1, 1e6).otherwise(F.col("effective_fps"))).withColumn("gap_before_ms", F.when(i % 40 == 3, -5.0).otherwise(F.col("gap_before_ms"))).withColumn("width", F.when(i % 50 == 7, 0).otherwise(640)).withColumn("height", F.lit(480))
    x = x.withColumn("decode_status", F.when(i % 60 == 9, "DECODE_FAILURE").when(i % 60 == 11, "LATE").when(i % 60 == 13, "MISSING_TIMESTAMP").otherwise("OK")).withColumn("quality_bits", F.when(i % 60 == 13, 1).when(i % 120 == 9, 16).otherwise(0).cast("long"))
    return _counted(validate.frame_rows(x, n), "rule")


FRAME_FAULTS = """
WITH v AS (SELECT event_id AS i, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER q AS p, lead(epoch_us(ts)) OVER q AS n FROM events WHERE event_type = 'view' WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT 'FPS_NOT_DERIVED' AS rule, count(*) AS n FROM v WHERE i % 30 = 1 UNION ALL SELECT 'GAP_NOT_DERIVED', count(*) FROM v WHERE i % 40 = 3 UNION ALL SELECT 'VALUE_NOT_FINITE', count(*) FROM v WHERE i % 40 = 3 UNION ALL SELECT 'SIZE_NOT_POSITIVE', count(*) FROM v WHERE i % 50 = 7
  UNION ALL SELECT 'STATUS_UNKNOWN', count(*) FROM v WHERE i % 60 = 11 UNION ALL SELECT 'DECODE_FAILURE_AGAINST_BIT', count(*) FROM v WHERE i % 120 = 69)
SELECT rule, n::BIGINT AS n FROM r WHERE n > 0
"""


def cv_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An estimate for each part's frame, with seeded faults."""
    k = F.col("canonical_ordinal")
    f = table(spark, sf_dir, "part").select(F.lit("s").alias("stream"), F.col("p_partkey").alias("canonical_ordinal")).select("stream", k, (2 * k).alias("frame_index"), (3 * k).alias("canonical_time_ns"), F.when(k % 50 == 1, 32).otherwise(0).cast("long").alias("quality_bits"))
    floats = lambda n, v: F.array_repeat(v.cast("float"), n)
    cv = f.where(k % 70 != 3).select(
        "stream", k, (F.col("frame_index") + F.when(k % 60 == 5, 1).otherwise(0)).alias("frame_index"), "canonical_time_ns", floats(63, F.when(k % 80 == 7, float("nan")).otherwise(1.0)).alias("keypoints"),
        F.array_repeat(k % 25 != 1, 21).alias("keypoint_validity"), F.when(k % 90 != 9, F.when(k % 110 == 11, floats(2, F.lit(1.0))).otherwise(floats(3, F.lit(1.0)))).alias("motion_vector"), floats(4, F.lit(0.5)).alias("palm_orientation"),
        F.when(k % 120 == 13, 0.0).otherwise(1.0).cast("float").alias("hand_scale"), F.lit(2.0).cast("float").alias("estimated_frequency_hz"), F.lit(0.9).cast("float").alias("tracking_quality"), F.when(k == 1, "v2").otherwise("v1").alias("estimator_version"),
    )
    cv = cv.union(cv.where(k % 130 == 15))
    return _counted(validate.cv_rows(cv, f, ["stream"]), "rule")


CV_FAULTS = """
WITH p AS (SELECT p_partkey AS k FROM part), c AS (SELECT k FROM p WHERE k % 70 <> 3), d AS (SELECT k FROM c UNION ALL SELECT k FROM c WHERE k % 130 = 15),
r AS (SELECT 'NO_ESTIMATE' AS rule, count(*) AS n FROM p WHERE k % 70 = 3 UNION ALL SELECT 'ESTIMATE_REPEATED', count(*) FROM c WHERE k % 130 = 15 UNION ALL SELECT 'FRAME_DISAGREES', count(*) FROM d WHERE k % 60 = 5 UNION ALL SELECT 'NOT_FINITE', count(*) FROM d WHERE k % 80 = 7
  UNION ALL SELECT 'WRONG_LENGTH', count(*) FROM d WHERE k % 110 = 11 AND k % 90 <> 9 UNION ALL SELECT 'OUT_OF_RANGE', count(*) FROM d WHERE k % 120 = 13 UNION ALL SELECT 'UNUSABLE_NOT_FLAGGED', count(*) FROM d WHERE k % 25 = 1 AND k % 50 <> 1 UNION ALL SELECT 'MISSING_NOT_FLAGGED', count(*) FROM d WHERE k % 90 = 9 AND k % 50 <> 1
  UNION ALL SELECT 'SEVERAL_ESTIMATORS', CASE WHEN count(DISTINCT k = 1) > 1 THEN 1 ELSE 0 END FROM d)
SELECT rule, n::BIGINT AS n FROM r WHERE n > 0
"""


def segment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity segments of users, with gaps, overlaps, clock runs that end early and users without any clock."""
    u = F.col("user_id")
    e = events(spark, sf_dir).groupBy("user_id").agg(F.min("time").alias("a"), (F.max("time") + 1000).alias("z")).withColumn("m", F.expr("(a + z) div 2")).where("a < m and m < z")
    late = F.when(u % 5 == 1, 1).when(u % 5 == 2, -1).otherwise(0)
    parts = F.array(F.struct(F.lit(0).alias("segment"), F.col("a").alias("start"), F.col("m").alias("end")), F.struct(F.lit(1).alias("segment"), (F.col("m") + late).alias("start"), (F.col("z") + F.when(u % 7 == 3, 9).otherwise(0)).alias("end")))
    s = e.select("user_id", F.explode(parts).alias("p")).select("user_id", "p.*", (u % 4 != 0).alias("accepted"), F.when(u % 8 == 0, 128).otherwise(0).cast("long").alias("quality_bits"))
    runs = e.select("user_id", F.explode(F.array(F.lit("video"), F.lit("imu"))).alias("stream"), (F.col("a") - 10).alias("start"), F.when((u % 6 == 1) & (F.col("stream") == "imu"), F.col("m") + 5).otherwise(F.col("z") + 20).alias("end"))
    intervals = e.where(u % 4 != 0).select("user_id", F.col("a").alias("start"), F.col("z").alias("end"))
    return _counted(contracts.segment_violations(s, e.select("user_id", F.col("a").alias("from"), F.col("z").alias("to")), intervals, runs, KEY), "rule")


SEGMENT_FAULTS = """
WITH e AS (SELECT user_id AS u, epoch_us(min(ts)) * 1000 AS a, epoch_us(max(ts)) * 1000 + 1000 AS z FROM events GROUP BY 1), x AS (SELECT *, (a + z) // 2 AS m FROM e), d AS (SELECT * FROM x WHERE a < m AND m < z),
r AS (SELECT 'GAP' AS rule, count(*) AS n FROM d WHERE u % 5 = 1 UNION ALL SELECT 'OVERLAP', count(*) FROM d WHERE u % 5 = 2 UNION ALL SELECT 'END_OF_DOMAIN', count(*) FROM d WHERE u % 7 = 3
  UNION ALL SELECT 'OUTSIDE_A_CLOCK_RUN', count(*) FROM d WHERE u % 4 <> 0 AND u % 6 = 1 UNION ALL SELECT 'NO_CLOCK_BUT_NOT_REJECTED', 2 * count(*) FROM d WHERE u % 4 = 0 AND u % 8 <> 0)
SELECT rule, n::BIGINT AS n FROM r WHERE n > 0
"""


def alignment_regenerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored alignment, in which some ranges are changed and some frames are missing, against the streams."""
    stored = aligned_events(spark, sf_dir).where("frame % 60 <> 5").withColumn("start_ordinal", F.col("start_ordinal") + F.when(F.col("frame") % 50 == 3, 1).otherwise(0))
    e = events(spark, sf_dir)
    whole = e.groupBy("user_id").agg(F.min("time").alias("a"), F.max("time").alias("z"))
    middle = F.expr("(a + z) div 2")
    intervals = whole.select("user_id", F.col("a").alias("start"), middle.alias("end")).union(whole.select("user_id", middle, F.col("z") + DAY + 1)).where("user_id % 7 <> 0")
    x = contracts.alignment_differences(stored, owned_views(e.where("event_type = 'view'")), other_events(e), intervals, KEY, min_coverage=0.5)
    return x.select("side", "user_id", "frame", "start_ordinal", "alignment_status")


ALIGNMENT_REGENERATED = f"""
WITH s AS ({ALIGNMENT_STATUS})
SELECT 'a' AS side, user_id, frame, start_ordinal + 1 AS start_ordinal, alignment_status FROM s WHERE frame % 60 <> 5 AND frame % 50 = 3
UNION ALL SELECT 'b', user_id, frame, start_ordinal, alignment_status FROM s WHERE frame % 60 = 5 OR frame % 50 = 3
"""


def windows_regenerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored window index and ledger, in which some counts and reasons are changed, against the streams."""
    columns = ["user_id", "segment", "k", "video_n", "imu_n", "quality_bits"]
    x = windowed(hop_windows(spark, sf_dir).select(*columns, "reason_bits", "reason_codes"), spark, sf_dir)
    ledger = x.where("reason_codes <> ''").withColumn("reason_bits", F.col("reason_bits") + F.when((F.col("user_id") % 20 == 3) & (F.col("k") == 0), 1024).otherwise(0))
    valid = x.where("reason_codes = ''").withColumn("video_n", F.col("video_n") + F.when(F.col("k") % 10 == 4, 1).otherwise(0))
    e = events(spark, sf_dir)
    found = contracts.window_differences(valid, ledger, columns, *_paired(e), _segments(e), KEY, POLICY)
    return windowed(_counted(found, "table", "side"), spark, sf_dir)


WINDOWS_REGENERATED = f"""
WITH v AS ({HOP_WINDOW_INDEX}), l AS ({HOP_WINDOW_REJECTIONS}), s AS (SELECT 'a' AS side UNION ALL SELECT 'b'),
r AS (SELECT 'index' AS "table", side, count(*) AS n FROM v, s WHERE k % 10 = 4 GROUP BY ALL UNION ALL SELECT 'ledger', side, count(*) FROM l, s WHERE user_id % 20 = 3 AND k = 0 GROUP BY ALL)
SELECT "table", side, n::BIGINT AS n FROM r WHERE n > 0
"""


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames, line items as detections; some frames, results and selections are missing, repeated or strays."""
    x = frames.classify(_ordered(_lines(spark, sf_dir)), ["l_orderkey"], gap=30).where("decode_ordinal = 0")
    f = x.where("l_orderkey % 50 <> 7").select(F.col("l_orderkey").alias("frame_id"), "pts", "pts_status", "quality_bits")
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("detection_id"))
    n = d.groupBy("frame_id").agg(F.count("*").alias("detection_count"))
    status = F.when(F.col("frame_id") % 30 == 1, "INFERENCE_FAILURE").when(F.col("frame_id") % 30 == 2, "REJECTED_INPUT").otherwise("SUCCESS")
    r = n.where("frame_id % 40 <> 3").withColumn("inference_status", status)
    r = r.union(r.where("frame_id % 90 = 5"))
    one = F.col("detection_count") == 1
    s = n.select("frame_id", F.when(one, "SELECTED").otherwise("ABSTAINED").alias("selection_status"), F.when(one, F.concat_ws("-", "frame_id", F.lit(1))).alias("selected_detection_id"))
    return contracts.run_counters(f, r, d, s)


RUN_COUNTERS = f"""
WITH o AS ({_ORDERED_SQL}), k AS (SELECT l_orderkey AS id, count(*) AS c FROM lineitem GROUP BY 1),
st AS (SELECT l_orderkey AS id, min(day) FILTER (decode_ordinal = 0) AS d0, count(*) FILTER (day = (SELECT day FROM o p WHERE p.l_orderkey = o.l_orderkey AND p.decode_ordinal = 0)) > 1 AS twice FROM o GROUP BY 1),
g AS (SELECT id, twice, (SELECT max(day) FROM o WHERE o.l_orderkey = st.id AND day < d0) AS before, d0 FROM st WHERE id % 50 <> 7),
f AS (SELECT *, coalesce(d0 - before > 30, false) AS jump FROM g),
r AS (SELECT id, c, CASE id % 30 WHEN 1 THEN 'INFERENCE_FAILURE' WHEN 2 THEN 'REJECTED_INPUT' ELSE 'SUCCESS' END AS s FROM k WHERE id % 40 <> 3), rr AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE id % 90 = 5),
d AS (SELECT l_orderkey AS id, l_orderkey || '-' || l_linenumber AS did FROM lineitem), x AS (SELECT id, id || '-1' AS did FROM k WHERE c = 1),
bad AS (SELECT count(*) AS n FROM x WHERE did NOT IN (SELECT did FROM d))
SELECT (SELECT count(*) FROM f)::BIGINT AS decoded_frames, (SELECT count(*) FROM f)::BIGINT AS frames_with_source_pts, (SELECT count(*) FROM f WHERE NOT twice AND NOT jump)::BIGINT AS valid_pts_frames, 0::BIGINT AS missing_pts_frames, (SELECT count(*) FROM f WHERE twice)::BIGINT AS duplicate_pts_frames, 0::BIGINT AS nonmonotonic_pts_frames,
  (SELECT count(*) FROM f WHERE jump)::BIGINT AS discontinuity_pts_frames, 0::BIGINT AS decoded_corrupt_frames, (SELECT count(*) FROM rr)::BIGINT AS cv_frame_results, 0::BIGINT AS zero_detection_frames, (SELECT count(*) FROM rr WHERE c = 1)::BIGINT AS one_detection_frames, (SELECT count(*) FROM rr WHERE c > 1)::BIGINT AS multiple_detection_frames,
  0::BIGINT AS decode_failures, 0::BIGINT AS preprocessing_failures, (SELECT count(*) FROM rr WHERE s = 'INFERENCE_FAILURE')::BIGINT AS inference_failures, (SELECT count(*) FROM rr WHERE s = 'REJECTED_INPUT')::BIGINT AS rejected_input_failures, (SELECT count(*) FROM rr WHERE s <> 'SUCCESS')::BIGINT AS cv_failures,
  (SELECT count(*) FROM k)::BIGINT AS selection_rows, (SELECT count(*) FROM x)::BIGINT AS selected_frames, (SELECT count(*) FROM k WHERE c <> 1)::BIGINT AS abstained_frames, (SELECT count(*) FROM f WHERE id % 40 = 3)::BIGINT AS missing_frame_results, (SELECT count(*) FROM r WHERE id % 90 = 5)::BIGINT AS duplicate_frame_results, 0::BIGINT AS duplicate_frame_ids,
  (SELECT count(*) FROM d WHERE id % 50 = 7)::BIGINT AS orphan_detections, (SELECT count(*) FROM d)::BIGINT AS total_detections, (SELECT count(*) - count(DISTINCT did) FROM d)::BIGINT AS duplicate_detection_ids, (SELECT n FROM bad)::BIGINT AS invalid_selected_detection_ids,
  ((SELECT n FROM bad) + (SELECT count(*) FROM k WHERE id % 50 = 7))::BIGINT AS invalid_selection_references, ((SELECT n FROM bad) + (SELECT count(*) FROM k WHERE id % 50 = 7) + (SELECT count(*) FROM d WHERE id % 50 = 7))::BIGINT AS foreign_key_violations
"""


def poll_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll groups of raw logs against rows at the nominal rate: a customer's orders stand for rows of three kinds."""
    kind = _cases(F.col("o_orderkey"), [F.lit("RAW"), F.lit("STO"), F.lit("RAW"), F.lit("MOT"), F.lit("RAW")])
    return contracts.poll_groups(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recording"), kind.alias("kind")), "recording", "kind")


_POLL = """
WITH c AS (SELECT o_custkey AS recording, count(*) FILTER (o_orderkey % 5 IN (0, 2, 4)) AS raw, count(*) FILTER (o_orderkey % 5 = 1) AS sto, count(*) FILTER (o_orderkey % 5 = 3) AS mot FROM orders GROUP BY 1),
p AS (
  SELECT recording, greatest(0, CASE WHEN raw >= 5 THEN (raw - 5) // 5 ELSE 0 END)::BIGINT AS raw_groups, greatest(0, sto - 1)::BIGINT AS ticks,
    CASE WHEN sto <> mot THEN 'STO_AND_MOT_DIFFER' WHEN sto < 2 OR raw < 5 THEN 'NOTHING_DYNAMIC' WHEN (raw - 5) // 5 = sto - 1 THEN 'EQUAL' ELSE 'NOT_ONE_TO_ONE' END AS status FROM c)
"""
POLL_GROUPS = _POLL + "SELECT recording, raw_groups, ticks, status FROM p"


def poll_group_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.ratio_summary(poll_groups(spark, sf_dir), "raw_groups", "ticks", ["recording"])


POLL_GROUP_RATIOS = _POLL + """
, h AS (SELECT * FROM p WHERE ticks > 0), r AS (SELECT *, row_number() OVER (ORDER BY raw_groups::DOUBLE / ticks, recording) - 1 AS r FROM h),
a AS (SELECT 'min' AS pick, 0 AS at UNION ALL SELECT 'median_low', (SELECT (count(*) - 1) // 2 FROM h) UNION ALL SELECT 'median_high', (SELECT count(*) // 2 FROM h) UNION ALL SELECT 'max', (SELECT count(*) - 1 FROM h))
SELECT pick, recording, raw_groups, ticks, printf('%.6f', raw_groups::DOUBLE / ticks) AS ratio FROM a JOIN r ON r.r = a.at
"""


def provenance_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of the canonical JSON of each supplier's document, and what a closed shape finds wrong with it."""
    key = F.col("s_suppkey")
    body = lambda *more: F.to_json(F.struct(F.col("s_name").alias("name"), key.alias("key"), *more))
    raw = F.when(key % 4 == 1, body(F.lit("é").alias("note"))).when(key % 4 == 3, body(F.lit("x").alias("note"))).when(key % 4 == 2, F.to_json(F.struct(F.col("s_name").alias("key")))).otherwise(body(F.lit(1).alias("extra")))
    shape = {"name": str, "key": int, "note?": {"é"}}
    found = documents.checked(table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw")), "raw", shape)
    return found.select("s_suppkey", F.col("canonical_sha256").alias("sha256"), F.array_join("wrong", "|").alias("wrong"))


PROVENANCE_DIGESTS = """
WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS c, s_name AS n, '{' || chr(10) AS a, chr(10) || '}' || chr(10) AS z FROM supplier)
SELECT s_suppkey, sha256(a || CASE c WHEN 2 THEN '  "key": "' || n || '"' ELSE CASE c WHEN 0 THEN '  "extra": 1,' || chr(10) ELSE '' END || '  "key": ' || s_suppkey || ',' || chr(10) || '  "name": "' || n || '"' || CASE c WHEN 1 THEN ',' || chr(10) || '  "note": "é"' WHEN 3 THEN ',' || chr(10) || '  "note": "x"' ELSE '' END END || z) AS sha256,
  CASE c WHEN 0 THEN '$.extra is unknown' WHEN 1 THEN '' WHEN 3 THEN '$.note is none of [''é'']' ELSE '$.name is missing|$.key is no int' END AS wrong FROM s
"""


def _release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of logs (users) and poses (vectors); some calibrate at time zero, some have rows of nothing but zeros."""
    logs = texts.sensor_log(_log_lines(spark, sf_dir, False))
    logs = logs.withColumn("source_timestamp_token", F.when((F.col("path") % 5 == 0) & (F.col("source_epoch_kind") == "NPOSE_CALIBRATION"), "0.000").otherwise(F.col("source_timestamp_token")))
    poses = texts.pose_table(_pose_lines(spark, sf_dir, False))
    poses = poses.withColumn("zero_triplet_mask", F.when(F.col("path") % 40 == 0, F.transform("zero_triplet_mask", lambda z: F.lit(True))).otherwise(F.col("zero_triplet_mask")))
    return audits.recording_evidence(logs, poses)


def release_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.release_aggregates(_release(spark, sf_dir))


_RELEASE_SQL = _LOG_SQL + """
l AS (SELECT user_id AS rec, count(*) AS n, count(*) FILTER (o >= 5) AS dyn, count(*) FILTER (value IS NULL OR event_id % 37 = 0) AS bad, CASE WHEN user_id % 5 = 0 THEN 'ZERO' ELSE 'NONZERO' END AS npose FROM e GROUP BY user_id),
p AS (SELECT vec_id AS rec, count(*) AS n, count(*) FILTER (vec_id % 40 = 0) AS fully, count(*) FILTER (vec_id % 10 = 0) AS any_zero FROM embeddings GROUP BY vec_id),
x AS (SELECT coalesce(l.rec, p.rec) AS recording, l.n AS raw, dyn, bad, npose, p.n AS pose, fully, any_zero FROM l FULL JOIN p ON l.rec = p.rec)
"""
RELEASE_AGGREGATES = _RELEASE_SQL + """
SELECT unnest(['pairs', 'raw_rows', 'raw_dynamic_rows', 'invalid_quaternions', 'pose_rows', 'fully_zero_rows', 'any_zero_rows', 'npose_zero_recordings', 'npose_nonzero_recordings', 'invalid_quaternion_recordings', 'fully_zero_recordings']) AS measure,
  unnest([count(*) FILTER (raw IS NOT NULL AND pose IS NOT NULL), sum(raw), sum(dyn), sum(bad), sum(pose), sum(fully), sum(any_zero), count(*) FILTER (npose = 'ZERO'), count(*) FILTER (npose = 'NONZERO'), count(*) FILTER (bad > 0), count(*) FILTER (fully > 0)]::BIGINT[]) AS value FROM x
"""


def affected_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.affected_recordings(_release(spark, sf_dir))


AFFECTED_RECORDINGS = _RELEASE_SQL + """
SELECT 'INVALID_QUATERNION' AS kind, recording FROM x WHERE bad > 0 UNION ALL SELECT 'NONZERO_NPOSE', recording FROM x WHERE npose = 'NONZERO' UNION ALL SELECT 'FULLY_ZERO_POSE', recording FROM x WHERE fully > 0 UNION ALL SELECT 'UNPAIRED', recording FROM x WHERE raw IS NULL OR pose IS NULL
"""


def instruction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.instruction_summary(texts.instructions(_instruction_lines(spark, sf_dir))).select("type", "n", "n_recordings")


INSTRUCTION_SUMMARY = _INSTRUCTIONS_SQL + """
, g AS (SELECT rec, unnest(list_filter([type, 'all', CASE WHEN type <> 'mp4' THEN 'others' END], lambda t: t IS NOT NULL)) AS type FROM p WHERE problem IS NULL)
SELECT type, count(*)::BIGINT AS n, count(DISTINCT rec)::BIGINT AS n_recordings FROM g GROUP BY type
"""


def mapping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings: a direction each, and instructions of some kinds."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    chosen = o.select(k.alias("recording"), _cases(k, [F.lit("IMU"), F.lit("VIDEO"), F.lit("ZERO")]).alias("direction"))
    cut = lambda n: F.when(k % n != 0, 1)
    return audits.mapping_summary(chosen, o.select(k.alias("recording"), cut(2).alias("csv"), cut(5).alias("mot"), cut(7).alias("mp4"), cut(11).alias("raw")))


MAPPING_SUMMARY = """
SELECT CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 'AMBIGUOUS' WHEN o_orderkey % 3 = 0 THEN 'IMU' WHEN o_orderkey % 3 = 1 THEN 'VIDEO' ELSE 'ZERO' END AS classification, count(*)::BIGINT AS n FROM orders GROUP BY 1
"""

FUNCTIONS = [
    release_aggregates,
    affected_recordings,
    instruction_summary,
    mapping_summary,
    sensor_log_rows,
    sensor_log_faults,
    pose_rows,
    pose_faults,
    time_keys,
    file_classes,
    recordings,
    exclusion_ledger,
    recording_strays,
    modality_pairs,
    instruction_problems,
    cuts_by_kind,
    plot_choices,
    archive_members,
    unsafe_paths,
    utc_times,
    catalogue,
    bundle_ledger,
    snapshot_window_ids,
    closed_frames,
    given_boxes,
    authority_tiers,
    materialized_times,
    clock_continuity,
    keypoint_fractions,
    uniformity,
    payload_ranks,
    frame_ids,
    detection_ids,
    unsorted_rows,
    stream_union,
    session_stream,
    epoch_stream,
    repeat_stream,
    imu_faults,
    frame_faults,
    cv_faults,
    segment_faults,
    alignment_regenerated,
    windows_regenerated,
    run_counters,
    poll_groups,
    poll_group_ratios,
    provenance_digests,
]
