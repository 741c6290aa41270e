"""Queries over events: some types are frames, the others samples, a user is a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import nanoseconds, rounded
from ..operators import align, reconcile, rotations, timeseries, windows
from ..operators.timeseries import DAY
from ..schemas import BITS
from ..sources import files

KEY = ["user_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, time, event_id, event_type, value."""
    return table(spark, sf_dir, "events").select("user_id", nanoseconds(F.col("ts")).alias("time"), "event_id", "event_type", "value")


def _frames(e: DataFrame) -> DataFrame:
    """Views; the last one of a user owns one day."""
    f = timeseries.owned_intervals(e.where("event_type = 'view'"), KEY, "time", ["time", "event_id"], F.col("time") + DAY, "end", DAY)
    return f.select("user_id", F.col("event_id").alias("frame"), "time", "end")


def _samples(e: DataFrame) -> DataFrame:
    return timeseries.ordinals(e.where("event_type <> 'view'"), KEY, ["time", "event_id"], "ordinal", DAY).select("user_id", "time", "ordinal")


def frame_sensor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return align.frame_sensor_index(_frames(e), _samples(e), KEY)


FRAME_SENSOR_INDEX = """
WITH e AS (SELECT user_id, epoch_us(ts) * 1000 AS t, event_id, event_type FROM events),
f AS (SELECT user_id, event_id AS frame, t AS "time", coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t + 86400000000000) AS "end" FROM e WHERE event_type = 'view'),
s AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS o FROM e WHERE event_type <> 'view'),
near AS (
  SELECT f.user_id, f.frame, s.o, s.t - f."time" AS d, row_number() OVER (PARTITION BY f.user_id, f.frame ORDER BY abs(s.t - f."time"), s.t, s.o) AS r
  FROM f JOIN s ON f.user_id = s.user_id)
SELECT f.user_id, f.frame, f."time", f."end",
  (SELECT count(*) FROM s WHERE s.user_id = f.user_id AND s.t < f."time")::BIGINT AS start_ordinal,
  (SELECT count(*) FROM s WHERE s.user_id = f.user_id AND s.t < f."end")::BIGINT AS stop_ordinal,
  n.o::BIGINT AS nearest_ordinal, n.d::BIGINT AS nearest_delta,
  (SELECT count(*) FROM s WHERE s.user_id = f.user_id AND s.t >= f."time" AND s.t < f."end")::BIGINT AS n_samples
FROM f LEFT JOIN near n ON n.user_id = f.user_id AND n.frame = f.frame AND n.r = 1
"""


def owned_interval_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.frames import rates

    x = rates(events(spark, sf_dir), KEY, "time", ["time", "event_id"], bucket=DAY)
    return x.select("user_id", "event_id", rounded(F.col("effective_fps") * 1e6, 4).alias("micro_fps"), rounded(F.col("gap_before_ms"), 3).alias("gap_before_ms"))


OWNED_INTERVAL_FPS = """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS t FROM events),
d AS (SELECT *, lead(t) OVER w - t AS f, t - lag(t) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, round(1e9 / nullif(coalesce(f, b), 0) * 1e6, 4) AS micro_fps, round(b / 1e6, 3) AS gap_before_ms FROM d
"""


def canonical_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.ordinals(events(spark, sf_dir), KEY, ["time", "event_id"], bucket=DAY).select("user_id", "event_id", "canonical_ordinal")


CANONICAL_ORDINALS = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS canonical_ordinal FROM events"


def cadence_median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.median_period(events(spark, sf_dir), KEY, "time", DAY).select("user_id", "period", "gap_limit")


CADENCE_MEDIAN_GAP = """
WITH d AS (SELECT user_id, epoch_us(ts) * 1000 - lag(epoch_us(ts) * 1000) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events),
m AS (SELECT user_id, median(CASE WHEN d > 0 THEN d END) AS period FROM d GROUP BY user_id)
SELECT user_id, period, greatest(1, round_even(period * 2.5, 0)::BIGINT) AS gap_limit FROM m
"""


def _islands(e: DataFrame, gap: int = DAY) -> DataFrame:
    """Runs of a user's events that are at most a day apart, as intervals up to just after the last one."""
    return timeseries.islands(e, KEY, "time", ["time", "event_id"], F.lit(gap), DAY).groupBy("user_id", "island").agg(F.min("time").alias("start"), (F.max("time") + 1000).alias("end"), F.count("*").alias("n"))


def continuity_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(events(spark, sf_dir))


_ISLANDS_SQL = """
SELECT user_id, island, min(t) AS "start", max(t) + 1000 AS "end", count(*)::BIGINT AS n FROM (
  SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS island FROM (
    SELECT user_id, event_id, epoch_us(ts) * 1000 AS t, CASE WHEN epoch_us(ts) * 1000 - lag(epoch_us(ts) * 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000000 THEN 1 ELSE 0 END AS g
    FROM events {where})) GROUP BY user_id, island
"""
CONTINUITY_ISLANDS = _ISLANDS_SQL.format(where="")


def interval_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    part = lambda kind: _islands(e.where(F.col("event_type") == kind), 3 * DAY).select("user_id", F.col("island").alias(f"{kind}_island"), "start", "end")
    return timeseries.intersect_intervals(part("view"), part("click"), KEY)


INTERVAL_INTERSECTION = f"""
WITH v AS ({_ISLANDS_SQL.format(where="WHERE event_type = 'view'").replace("86400000000000", "259200000000000")}),
c AS ({_ISLANDS_SQL.format(where="WHERE event_type = 'click'").replace("86400000000000", "259200000000000")})
SELECT v.user_id, v.island AS view_island, c.island AS click_island, greatest(v."start", c."start") AS "start", least(v."end", c."end") AS "end"
FROM v JOIN c ON v.user_id = c.user_id AND v."start" < c."end" AND c."start" < v."end"
"""


def interval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.split_intervals(_islands(events(spark, sf_dir)).select("user_id", "island", "start", "end"), DAY)


INTERVAL_SPLIT = f"""
WITH i AS ({CONTINUITY_ISLANDS}),
d AS (SELECT *, unnest(range("start" // 86400000000000, ("end" - 1) // 86400000000000 + 1)) AS c FROM i)
SELECT user_id, island, (c - "start" // 86400000000000)::BIGINT AS piece, greatest("start", c * 86400000000000)::BIGINT AS "start", least("end", (c + 1) * 86400000000000)::BIGINT AS "end" FROM d
"""

WINDOW, HOP = 4 * DAY, DAY
POLICY = windows.Policy(WINDOW, HOP, video_coverage=0.5, imu_coverage=0.5, video_max_gap=3 * DAY, imu_max_gap=2 * DAY, deviation=50.0, observable_cap=12.0, low_hz=1e-5, high_hz=1e-7)


def _segments(e: DataFrame) -> DataFrame:
    """One segment a user: from its first event to just after its last; every tenth user's is rejected."""
    s = e.groupBy("user_id").agg(F.min("time").alias("start"), (F.max("time") + 1000).alias("end"))
    return s.select("user_id", F.lit(0).alias("segment"), "start", "end", (F.col("user_id") % 10 != 0).alias("accepted"))


def _paired(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    bits = lambda kind, bit: F.when(F.col("event_type") == kind, bit).otherwise(0).cast("long").alias("quality_bits")
    v = timeseries.owned_ordinals(e.where("event_type = 'view'"), KEY, "time", ["time", "event_id"], F.col("time") + 1000, "end")
    s = timeseries.ordinals(e.where("event_type <> 'view'"), KEY, ["time", "event_id"], "ordinal", DAY)
    return v.select("user_id", "time", "end", "ordinal", bits("none", 0)), s.select("user_id", "time", "ordinal", bits("error", BITS["FREQUENCY_UNSUPPORTED"]))


def hop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of the two queries below."""
    e = events(spark, sf_dir)
    v, s = _paired(e)
    return windows.candidates(v, s, _segments(e), KEY, POLICY)


def windowed(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """df, which is made of hop windows of events, made now in as many partitions as those need: an event is in WINDOW / HOP windows."""
    return files.kept(df, "windows", timeseries.parts(table(spark, sf_dir, "events"), WINDOW // HOP))


_IDS = ["user_id", "segment", "k", "window_start", "window_end"]


def hop_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = hop_windows(spark, sf_dir).where("reason_codes = ''")
    x = x.select(*_IDS, *(F.col(f"{p}_{c}").cast("long").alias(f"{p}_{c}") for p in ("video", "imu") for c in ("n", "start_ordinal", "stop_ordinal")), rounded(F.col("video_coverage"), 6).alias("video_coverage"), rounded(F.col("imu_coverage"), 6).alias("imu_coverage"), rounded(F.col("video_deviation"), 6).alias("video_deviation"), rounded(F.col("imu_deviation"), 6).alias("imu_deviation"), "video_regular", "imu_regular", "quality_bits")
    return windowed(x, spark, sf_dir)


def hop_window_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(hop_windows(spark, sf_dir).where("reason_codes <> ''").select(*_IDS, "reason_bits", "reason_codes"), spark, sf_dir)


#: Segments for the gates: two of a user, so that neighbours may lie outside; some with bits of their own.
GATES = windows.Policy(WINDOW, HOP, video_coverage=0.2, imu_coverage=0.4, deviation=3.0, low_hz=1e-5, high_hz=1e-6, tracking=0.01, keypoints=0.05, motion_range=8.0, motion_channels=2, accel_range=20.0, gyro_range=4.0, quaternion_range=1.5, imu_channels=5)


def _halves(e: DataFrame) -> DataFrame:
    whole = e.groupBy("user_id").agg(F.min("time").alias("a"), (F.max("time") + 1000).alias("z")).withColumn("m", F.expr("(a + z) div 2"))
    parts = F.array(F.struct(F.lit(0).alias("segment"), F.col("a").alias("start"), F.col("m").alias("end")), F.struct(F.lit(1).alias("segment"), F.col("m").alias("start"), F.col("z").alias("end")))
    return whole.select("user_id", F.explode(parts).alias("p")).select("user_id", "p.*", (F.col("user_id") % 10 != 0).alias("accepted"), F.when(F.col("user_id") % 23 == 0, BITS["SYNC_RESIDUAL_EXCEEDED"]).otherwise(0).cast("long").alias("quality_bits"))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates with alignment, tracking and sensor signals."""
    e = events(spark, sf_dir)
    v, s = _paired(e)
    numbered = lambda x: timeseries.ordinals(x, KEY, ["time", "event_id"], "ordinal", DAY)
    views, others = numbered(e.where("event_type = 'view'")), numbered(e.where("event_type <> 'view'"))
    status = aligned_events(spark, sf_dir).select("user_id", F.col("frame").alias("event_id"), "alignment_status", "nearest_ordinal")
    alignment = views.select("user_id", "event_id", "ordinal").join(status, ["user_id", "event_id"]).drop("event_id")
    value = F.coalesce("value", F.lit(0.0))
    cv = views.select("user_id", "ordinal", (F.col("value") / 100).alias("tracking_quality"), (F.col("event_id") % 10 / 10.0).alias("keypoint_fraction"), F.array(value, -value, F.lit(None).cast("double")).alias("motion"))
    turn = value / 40
    imu = others.select("user_id", "ordinal", F.lit("ACCEL_GYRO_QUATERNION").alias("payload_kind"), value.alias("ax"), F.lit(0.0).alias("ay"), (2 * value).alias("az"), F.pmod(value, F.lit(7.0)).alias("gx"), (-value).alias("gy"), F.lit(None).cast("double").alias("gz"), rotations.turned(turn).alias("q"))
    return windows.candidates(v, s, _halves(e), KEY, GATES, alignment, cv, imu)


def hop_window_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = gated(spark, sf_dir)
    x = x.select(*_IDS, rounded(F.col("video_deviation"), 6).alias("video_deviation"), rounded(F.col("imu_deviation"), 6).alias("imu_deviation"), "video_regular", "imu_regular", "cv_tracking_valid", "cv_motion_range_gate_passed", "imu_signal_range_gate_passed", "tremor_band_supported", "valid_for_frequency", "reason_bits", "reason_codes", "quality_bits")
    return windowed(x, spark, sf_dir)


# Windows by correlated subqueries and self-joins by ordinal, so the two have no plan in common.
_WINDOWS_SQL = """
WITH e AS (SELECT user_id, event_id, event_type, coalesce(value, 0) AS value, value AS raw, epoch_us(ts) * 1000 AS t FROM events),
seg AS ({segments}),
w AS (SELECT user_id, segment, s, e, accepted, sb, k, s + k * 86400000000000 AS ws, s + k * 86400000000000 + 345600000000000 AS we
      FROM (SELECT *, unnest(range(0, (e - s - 345600000000000) // 86400000000000 + 1)) AS k FROM seg WHERE e - s >= 345600000000000)),
v AS (SELECT user_id, event_id, t, value, raw, row_number() OVER q - 1 AS o, coalesce(lead(t) OVER q, t + 1000) AS x FROM e WHERE event_type = 'view' WINDOW q AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT user_id, event_id, t, value, row_number() OVER q - 1 AS o, lag(t) OVER q AS p, CASE WHEN event_type = 'error' THEN 512 ELSE 0 END AS b FROM e WHERE event_type <> 'view' WINDOW q AS (PARTITION BY user_id ORDER BY t, event_id)),
vp AS (SELECT v.user_id, segment, median(CASE WHEN x > t THEN x - t END) AS p FROM v JOIN seg ON seg.user_id = v.user_id AND t >= s AND t < e AND x <= e GROUP BY ALL),
ip AS (SELECT i.user_id, segment, median(CASE WHEN t > i.p AND i.p >= s THEN t - i.p END) AS p FROM i JOIN seg ON seg.user_id = i.user_id AND t >= s AND t < e GROUP BY ALL),
va AS (
  SELECT w.user_id, w.segment, w.k, any_value(ws) AS ws, any_value(we) AS we, any_value(vp.p) AS p, count(*) AS n, min(o) AS a, max(o) + 1 AS z, min(t) AS lo, max(x) AS last, max(x - t) AS most,
    max(CASE WHEN x > t THEN abs(x - t - vp.p) / vp.p END) AS off, count(*) > count(DISTINCT t) AS dup
  FROM w JOIN v ON v.user_id = w.user_id AND t >= ws AND t < we AND x <= we JOIN vp ON vp.user_id = w.user_id AND vp.segment = w.segment GROUP BY w.user_id, w.segment, w.k),
vm AS (
  SELECT va.*, b.t AS pt, f.t AS nt, f.x AS nx, greatest(1, p * 1e-6) AS tol, coalesce({video_gap}, greatest(1, round_even(p * 2.5, 0))) AS lim
  FROM va LEFT JOIN v b ON b.user_id = va.user_id AND b.o = a - 1 LEFT JOIN v f ON f.user_id = va.user_id AND f.o = z),
vr AS (SELECT *, coalesce(lo - ws >= p - tol, false) AS l, coalesce(we - last >= p - tol AND NOT coalesce(nt < we AND nx > we AND nx - nt > lim + tol, false), false) AS r FROM vm),
vg AS (
  SELECT *, (l AND (pt IS NULL OR lo - pt > p + tol)) OR r AS edge, greatest(most, CASE WHEN l THEN coalesce(lo - pt, lo - ws) END, CASE WHEN r THEN we - last END) AS worst,
    greatest(off, CASE WHEN l THEN CASE WHEN pt IS NULL THEN (lo - ws) / p ELSE abs(lo - pt - p) / p END END, CASE WHEN r THEN (we - last) / p END) AS dev FROM vr),
ia AS (
  SELECT w.user_id, w.segment, w.k, any_value(s) AS s, any_value(e) AS e, any_value(ws) AS ws, any_value(we) AS we, any_value(ip.p) AS p, count(*) AS n, min(o) AS a, max(o) + 1 AS z, min(t) AS lo, max(t) AS last,
    max(CASE WHEN i.p >= ws THEN t - i.p END) AS most, max(CASE WHEN i.p >= ws AND t > i.p THEN abs(t - i.p - ip.p) / ip.p END) AS off, bit_or(b) AS b, count(*) > count(DISTINCT t) AS dup
  FROM w JOIN i ON i.user_id = w.user_id AND t >= ws AND t < we JOIN ip ON ip.user_id = w.user_id AND ip.segment = w.segment GROUP BY w.user_id, w.segment, w.k),
im AS (
  SELECT ia.*, y.t AS pt, f.t AS nt, coalesce(y.t >= s, false) AS pin, coalesce(f.t < e, false) AS nin, greatest(1, ia.p * 1e-6) AS tol, coalesce({imu_gap}, greatest(1, round_even(ia.p * 2.5, 0))) AS lim
  FROM ia LEFT JOIN i y ON y.user_id = ia.user_id AND y.o = a - 1 LEFT JOIN i f ON f.user_id = ia.user_id AND f.o = z),
ir AS (
  SELECT *, coalesce(CASE WHEN pin THEN lo - p >= ws - tol ELSE lo - ws >= p - tol END, false) AS l, coalesce(CASE WHEN nin THEN last + p < we - tol ELSE we - last > p + tol END, false) AS r FROM im),
ig AS (
  SELECT *, coalesce(l AND (pt IS NULL OR lo - pt > p + tol), false) OR coalesce(r AND (nt IS NULL OR nt - last > p + tol), false) AS edge,
    greatest(most, CASE WHEN l THEN coalesce(lo - pt, lo - ws) END, CASE WHEN r THEN coalesce(nt - last, we - last) END) AS worst,
    greatest(off, CASE WHEN l THEN CASE WHEN pt IS NULL THEN (lo - ws) / p WHEN lo > pt OR NOT pin THEN abs(lo - pt - p) / p END END, CASE WHEN r THEN CASE WHEN nt IS NULL THEN (we - last - p) / p WHEN nt > last OR NOT nin THEN abs(nt - last - p) / p END END) AS dev FROM ir),
c AS (
  SELECT w.user_id, w.segment, w.k, w.ws AS window_start, w.we AS window_end, w.accepted,
    coalesce(vg.n, 0) AS video_n, coalesce(vg.a, 0) AS video_start_ordinal, coalesce(vg.z, 0) AS video_stop_ordinal, coalesce(ig.n, 0) AS imu_n, coalesce(ig.a, 0) AS imu_start_ordinal, coalesce(ig.z, 0) AS imu_stop_ordinal,
    CASE WHEN vg.p > 0 THEN least(1.0, vg.n / (345600000000000 / vg.p)) ELSE 0 END AS video_coverage, CASE WHEN ig.p > 0 THEN least(1.0, ig.n / (345600000000000 / ig.p)) ELSE 0 END AS imu_coverage,
    coalesce(vg.edge OR vg.worst > vg.lim, false) OR coalesce(ig.edge OR ig.worst > ig.lim, false) AS gap, coalesce(vg.dup, false) OR coalesce(ig.dup, false) AS dup, vg.dev AS video_deviation, ig.dev AS imu_deviation,
    coalesce(NOT vg.edge AND vg.dev <= {deviation}, false) AS video_regular, coalesce(NOT ig.edge AND ig.dev <= {deviation}, false) AS imu_regular, coalesce(ig.b, 0) | w.sb | {near} AS b, {misaligned} AS misaligned
  FROM w LEFT JOIN vg ON vg.user_id = w.user_id AND vg.segment = w.segment AND vg.k = w.k LEFT JOIN ig ON ig.user_id = w.user_id AND ig.segment = w.segment AND ig.k = w.k {joins}),
f AS (
  SELECT *, video_coverage < {video_coverage} OR imu_coverage < {imu_coverage} AS short, b | CASE WHEN video_n = 0 OR imu_n = 0 OR video_coverage < {video_coverage} OR imu_coverage < {imu_coverage} OR misaligned THEN 256 ELSE 0 END | CASE WHEN dup THEN 4 ELSE 0 END | CASE WHEN gap OR b & 8 <> 0 THEN 8 ELSE 0 END AS bits FROM c),
g AS (
  SELECT *, list_filter([CASE WHEN dup THEN 'DUPLICATE_TIMESTAMP' END, CASE WHEN bits & 3583 <> 0 THEN 'FATAL_QUALITY_BIT' END, CASE WHEN short THEN 'INSUFFICIENT_COVERAGE' END, CASE WHEN misaligned THEN 'INVALID_ALIGNMENT' END, CASE WHEN imu_n = 0 THEN 'NO_IMU' END, CASE WHEN video_n = 0 THEN 'NO_VIDEO' END,
      CASE WHEN NOT accepted THEN 'REJECTED_CONTINUITY_SEGMENT' END, CASE WHEN bits & 8 <> 0 THEN 'STREAM_GAP' END], lambda r: r IS NOT NULL) AS reasons,
    video_regular AND imu_regular AND {high} < least(12.0, 0.4 * video_n / 345600.0) AND {high} < 0.5 * imu_n / 345600.0 AND 1e-5 * 345600.0 >= 3 AND bits & 512 = 0 AS allowed FROM f)
"""
_WHOLE = "SELECT user_id, 0 AS segment, min(t) AS s, max(t) + 1000 AS e, user_id % 10 <> 0 AS accepted, 0 AS sb FROM e GROUP BY user_id"
_PLAIN = dict(segments=_WHOLE, video_gap="259200000000000", imu_gap="172800000000000", deviation="50", near="0", misaligned="false", joins="", video_coverage="0.5", imu_coverage="0.5", high="1e-7")
HOP_WINDOW_INDEX = _WINDOWS_SQL.format(**_PLAIN) + """
SELECT user_id, segment, k, window_start, window_end, video_n, video_start_ordinal, video_stop_ordinal, imu_n, imu_start_ordinal, imu_stop_ordinal, round(video_coverage, 6) AS video_coverage, round(imu_coverage, 6) AS imu_coverage,
  round(video_deviation, 6) AS video_deviation, round(imu_deviation, 6) AS imu_deviation, video_regular, imu_regular, (CASE WHEN allowed THEN bits ELSE bits | 512 END)::BIGINT AS quality_bits
FROM g WHERE len(reasons) = 0
"""
HOP_WINDOW_REJECTIONS = _WINDOWS_SQL.format(**_PLAIN) + """
SELECT user_id, segment, k, window_start, window_end, bits::BIGINT AS reason_bits, array_to_string(reasons, '|') AS reason_codes FROM g WHERE len(reasons) > 0
"""


def aligned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views against the other events; a user's time falls into two intervals, and every seventh user has none."""
    e = events(spark, sf_dir)
    whole = e.groupBy("user_id").agg(F.min("time").alias("a"), F.max("time").alias("z"))
    middle = F.expr("(a + z) div 2")
    intervals = whole.select("user_id", F.col("a").alias("start"), middle.alias("end")).union(whole.select("user_id", middle, F.col("z") + DAY + 1))
    return align.aligned(_frames(e.where("event_type = 'view'")), _samples(e), intervals.where("user_id % 7 <> 0"), KEY, 0.5)


def alignment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_events(spark, sf_dir).select("user_id", "frame", "start_ordinal", "stop_ordinal", "nearest_ordinal", "nearest_delta", rounded(F.col("coverage"), 6).alias("coverage"), "alignment_status")


ALIGNMENT_STATUS = """
WITH e AS (SELECT user_id, epoch_us(ts) * 1000 AS t, event_id, event_type FROM events),
f AS (SELECT user_id, event_id AS frame, t, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t + 86400000000000) AS x FROM e WHERE event_type = 'view'),
s AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS o FROM e WHERE event_type <> 'view'),
b AS (SELECT user_id, min(t) AS a, max(t) AS z, (min(t) + max(t)) // 2 AS m FROM e GROUP BY user_id),
iv AS (SELECT user_id, a AS l, m AS h FROM b WHERE user_id % 7 <> 0 UNION ALL SELECT user_id, m, z + 86400000000001 FROM b WHERE user_id % 7 <> 0),
own AS (SELECT f.*, (SELECT l FROM iv WHERE iv.user_id = f.user_id AND iv.l <= f.t AND f.x <= iv.h) AS l, (SELECT h FROM iv WHERE iv.user_id = f.user_id AND iv.l <= f.t AND f.x <= iv.h) AS h,
  EXISTS (SELECT 1 FROM iv WHERE iv.user_id = f.user_id AND iv.l < f.x AND f.t < iv.h) AS hit, (SELECT count(*) FROM s WHERE s.user_id = f.user_id AND s.t >= f.t AND s.t < f.x) AS n,
  (SELECT count(DISTINCT t) FROM s WHERE s.user_id = f.user_id AND s.t >= f.t AND s.t < f.x) AS u, (SELECT count(*) FROM s WHERE s.user_id = f.user_id AND s.t < f.t) AS lo FROM f),
d AS (SELECT iv.user_id, iv.l, s.t, s.t - lag(s.t) OVER (PARTITION BY iv.user_id, iv.l ORDER BY s.t, s.o) AS d FROM iv JOIN s ON s.user_id = iv.user_id AND s.t >= iv.l AND s.t < iv.h),
p AS (SELECT user_id, l, median(CASE WHEN d > 0 THEN d END) AS p FROM d GROUP BY user_id, l),
near AS (SELECT own.user_id, own.frame, s.o, s.t, s.t - own.t AS nd, row_number() OVER (PARTITION BY own.user_id, own.frame ORDER BY abs(s.t - own.t), s.t, s.o) AS r FROM own JOIN s ON s.user_id = own.user_id AND s.t >= own.l AND s.t < own.h),
m AS (
  SELECT own.*, p.p, greatest(1, round_even(p.p * 2.5, 0)::BIGINT) AS lim, near.o AS near_o, near.nd,
    u < n OR (SELECT count(*) FROM s WHERE s.user_id = own.user_id AND s.t = near.t) > 1 AS dup,
    greatest((SELECT max(d.d) FROM d WHERE d.user_id = own.user_id AND d.l = own.l AND d.t >= own.t AND d.t < own.x), (SELECT max_by(d.d, -d.t) FROM d WHERE d.user_id = own.user_id AND d.l = own.l AND d.t >= own.x AND d.d > 0)) AS most
  FROM own LEFT JOIN p ON p.user_id = own.user_id AND p.l = own.l LEFT JOIN near ON near.user_id = own.user_id AND near.frame = own.frame AND near.r = 1),
q AS (SELECT *, CASE WHEN p > 0 THEN least(1.0, n / greatest(1.0, floor((x - t) / p + 1e-9))) ELSE 0.0 END AS coverage FROM m),
al AS (
  SELECT user_id, frame, CASE WHEN user_id % 7 <> 0 THEN lo ELSE 0 END::BIGINT AS start_ordinal, CASE WHEN user_id % 7 <> 0 THEN lo + n ELSE 0 END::BIGINT AS stop_ordinal, near_o::BIGINT AS nearest_ordinal, nd::BIGINT AS nearest_delta, round(coverage, 6) AS coverage,
    CASE WHEN l IS NULL AND hit THEN 'CONTINUITY_BOUNDARY' WHEN l IS NULL THEN 'OUTSIDE_CONTINUITY' WHEN n = 0 THEN 'NO_IMU' WHEN p IS NULL THEN 'CADENCE_UNKNOWN' WHEN dup THEN 'DUPLICATE_TIMESTAMP'
      WHEN coalesce(most > lim, false) OR coverage < 0.5 THEN 'GAP' ELSE 'OK' END AS alignment_status
  FROM q)
SELECT * FROM al
"""
_GATED = dict(
    segments="SELECT user_id, unnest([0, 1]) AS segment, unnest([min(t), (min(t) + max(t) + 1000) // 2]) AS s, unnest([(min(t) + max(t) + 1000) // 2, max(t) + 1000]) AS e, user_id % 10 <> 0 AS accepted, CASE WHEN user_id % 23 = 0 THEN 1024 ELSE 0 END AS sb FROM e GROUP BY user_id",
    video_gap="NULL", imu_gap="NULL", deviation="3", near="coalesce(nb, 0)", misaligned="coalesce(mis, false)", joins="LEFT JOIN va2 ON va2.user_id = w.user_id AND va2.segment = w.segment AND va2.k = w.k", video_coverage="0.2", imu_coverage="0.4", high="1e-6",
)
_GATES_SQL = _WINDOWS_SQL.format(**_GATED).replace(
    "c AS (\n",
    f"""al AS ({ALIGNMENT_STATUS}),
va2 AS (
  SELECT w.user_id, w.segment, w.k, bit_or(i.b) AS nb, bool_or(alignment_status IN ('CONTINUITY_BOUNDARY', 'OUTSIDE_CONTINUITY')) AS mis, bool_and(coalesce(v.raw / 100 >= 0.01, false) AND v.event_id % 10 / 10.0 >= 0.05) AS track,
    CASE WHEN count(*) >= 2 AND max(v.value) - min(v.value) >= 8 THEN 2 ELSE 0 END AS moving
  FROM w JOIN v ON v.user_id = w.user_id AND v.t >= ws AND v.t < we AND v.x <= we JOIN al ON al.user_id = v.user_id AND al.frame = v.event_id LEFT JOIN i ON i.user_id = v.user_id AND i.o = al.nearest_ordinal GROUP BY ALL),
wi AS (SELECT w.user_id, w.segment, w.k, i.o, i.value FROM w JOIN i ON i.user_id = w.user_id AND i.t >= ws AND i.t < we),
sig AS (
  SELECT wi.user_id, wi.segment, wi.k, CASE WHEN count(*) >= 2 THEN (max(value) - min(value) >= 20)::INT + (2 * max(value) - 2 * min(value) >= 20)::INT + (max(value % 7) - min(value % 7) >= 4)::INT + (max(value) - min(value) >= 4)::INT ELSE 0 END AS varying FROM wi GROUP BY ALL),
ang AS (SELECT a.user_id, a.segment, a.k, 2 * acos(least(1.0, min(abs(cos(a.value / 40) * cos(b.value / 40) + sin(a.value / 40) * sin(b.value / 40))))) AS angle FROM wi a JOIN wi b ON a.user_id = b.user_id AND a.segment = b.segment AND a.k = b.k AND a.o < b.o GROUP BY ALL),
c AS (\n""",
)
HOP_WINDOW_GATES = _GATES_SQL + """
SELECT g.user_id, g.segment, g.k, window_start, window_end, round(video_deviation, 6) AS video_deviation, round(imu_deviation, 6) AS imu_deviation, video_regular, imu_regular, coalesce(track, false) AS cv_tracking_valid, coalesce(moving, 0) >= 2 AS cv_motion_range_gate_passed,
  coalesce(varying, 0) + CASE WHEN coalesce(angle, 0) >= 1.5 THEN 1 ELSE 0 END >= 5 AS imu_signal_range_gate_passed, allowed AS tremor_band_supported,
  allowed AND coalesce(track, false) AND coalesce(moving, 0) >= 2 AND coalesce(varying, 0) + CASE WHEN coalesce(angle, 0) >= 1.5 THEN 1 ELSE 0 END >= 5 AS valid_for_frequency, bits::BIGINT AS reason_bits, array_to_string(reasons, '|') AS reason_codes,
  (CASE WHEN allowed AND coalesce(track, false) AND coalesce(moving, 0) >= 2 AND coalesce(varying, 0) + CASE WHEN coalesce(angle, 0) >= 1.5 THEN 1 ELSE 0 END >= 5 THEN bits ELSE bits | 512 END)::BIGINT AS quality_bits
FROM g LEFT JOIN va2 USING (user_id, segment, k) LEFT JOIN sig USING (user_id, segment, k) LEFT JOIN ang USING (user_id, segment, k)
"""


def window_quality_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    bit = F.when(F.col("event_type") == "error", BITS["STREAM_GAP"]).when(F.col("event_type") == "signup", BITS["CLOCK_RESET"]).otherwise(0).cast("long")
    x = timeseries.to_windows(e.withColumn("bits", bit).withColumn("segment", F.lit(0)), _segments(e), ["user_id", "segment"], "time", WINDOW, HOP)
    return x.groupBy("user_id", "k").agg(F.bit_or("bits").alias("quality_bits"), F.count("*").alias("n"))


_GRID = """
WITH e AS (SELECT *, epoch_us(ts) * 1000 AS t FROM events), seg AS (SELECT user_id, min(t) AS s, max(t) + 1000 AS e FROM e GROUP BY user_id),
w AS (SELECT user_id, k, s + k * 86400000000000 AS ws FROM (SELECT *, unnest(range(0, (e - s - 345600000000000) // 86400000000000 + 1)) AS k FROM seg WHERE e - s >= 345600000000000))
"""
WINDOW_QUALITY_OR = _GRID + """
SELECT w.user_id, w.k, bit_or(CASE event_type WHEN 'error' THEN 8 WHEN 'signup' THEN 64 ELSE 0 END)::BIGINT AS quality_bits, count(*)::BIGINT AS n
FROM w JOIN e ON e.user_id = w.user_id AND e.t >= ws AND e.t < ws + 345600000000000 GROUP BY w.user_id, w.k
"""


def window_range_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    x = timeseries.to_windows(e.withColumn("segment", F.lit(0)), _segments(e), ["user_id", "segment"], "time", WINDOW, HOP)
    return windows.signal_ranges(x, ["user_id", "k"], {"value": F.col("value"), "whole": F.floor("value").cast("double")}, 40.0)


WINDOW_RANGE_GATE = _GRID + """
SELECT w.user_id, w.k, (CASE WHEN count(value) >= 2 AND max(value) - min(value) >= 40 THEN 1 ELSE 0 END + CASE WHEN count(value) >= 2 AND max(floor(value)) - min(floor(value)) >= 40 THEN 1 ELSE 0 END)::INTEGER AS varying
FROM w JOIN e ON e.user_id = w.user_id AND e.t >= ws AND e.t < ws + 345600000000000 GROUP BY w.user_id, w.k
"""


def held_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.held_runs(events(spark, sf_dir), KEY, ["time", "event_id"], "event_type", DAY)


_HELD = """
SELECT user_id, count(*)::BIGINT AS n_rows, sum(c)::BIGINT AS n_runs, min_by(event_type, (ts, event_id)) AS first_value, max_by(event_type, (ts, event_id)) AS last_value, (count(*) - sum(c))::BIGINT AS n_held
FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER q AND row_number() OVER q > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id
"""
HELD_RUNS = _HELD


def held_fraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.ratio_summary(held_runs(spark, sf_dir), "n_held", "n_rows", ["user_id"])


HELD_FRACTION_SUMMARY = f"""
WITH h AS ({_HELD}), r AS (SELECT *, row_number() OVER (ORDER BY n_held::DOUBLE / n_rows, user_id) - 1 AS r, count(*) OVER () AS c FROM h),
p AS (SELECT 'min' AS pick, 0 AS at UNION ALL SELECT 'median_low', (SELECT (count(*) - 1) // 2 FROM h) UNION ALL SELECT 'median_high', (SELECT count(*) // 2 FROM h) UNION ALL SELECT 'max', (SELECT count(*) - 1 FROM h))
SELECT pick, user_id, n_held, n_rows, printf('%.6f', n_held::DOUBLE / n_rows) AS ratio FROM p JOIN r ON r.r = p.at
"""


def window_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.store import replay

    e = timeseries.ordinals(events(spark, sf_dir), KEY, ["time", "event_id"], bucket=DAY)
    w = e.groupBy("user_id").agg(F.max("canonical_ordinal").alias("m")).select(F.concat(F.lit("w"), "user_id").alias("window_id"), "user_id", F.floor(F.col("m") / 4).alias("a"), F.floor(F.col("m") / 2).alias("z"))
    return replay(w, e.select("user_id", "event_id", "canonical_ordinal"), KEY, "a", "z", bucket=16)


WINDOW_REPLAY = """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS canonical_ordinal FROM events),
w AS (SELECT user_id, max(canonical_ordinal) // 4 AS a, max(canonical_ordinal) // 2 AS z FROM e GROUP BY user_id)
SELECT 'w' || w.user_id AS window_id, e.user_id, e.event_id, e.canonical_ordinal FROM w JOIN e ON e.user_id = w.user_id AND canonical_ordinal >= a AND canonical_ordinal < z
"""


def nearest_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user's middle half of frames, nearest samples outside the samples that those frames own."""
    from ..sources import store

    x = timeseries.ordinals(frame_sensor_index(spark, sf_dir), KEY, ["time", "frame"], "frame_canonical_ordinal", DAY).withColumnRenamed("nearest_ordinal", "imu_nearest_ordinal")
    w = x.groupBy("user_id").agg(F.floor(F.count("*") / 4).alias("frame_start_ordinal"), F.floor(3 * F.count("*") / 4).alias("frame_stop_ordinal"))
    own = x.join(w, KEY).where("frame_canonical_ordinal >= frame_start_ordinal and frame_canonical_ordinal < frame_stop_ordinal")
    own = own.groupBy("user_id", "frame_start_ordinal", "frame_stop_ordinal").agg(F.min("start_ordinal").alias("imu_start_ordinal"), F.max("stop_ordinal").alias("imu_stop_ordinal"))
    return store.nearest_context(own.withColumn("window_id", F.col("user_id").cast("string")), x, KEY)


NEAREST_CONTEXT = f"""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "time", frame) - 1 AS o FROM ({FRAME_SENSOR_INDEX})),
w AS (SELECT user_id, count(*) // 4 AS a, 3 * count(*) // 4 AS z FROM x GROUP BY user_id),
r AS (SELECT x.user_id, min(start_ordinal) AS lo, max(stop_ordinal) AS hi FROM x JOIN w ON w.user_id = x.user_id AND o >= a AND o < z GROUP BY x.user_id)
SELECT DISTINCT x.user_id::VARCHAR AS window_id, nearest_ordinal AS ordinal FROM x JOIN w ON w.user_id = x.user_id AND o >= a AND o < z JOIN r ON r.user_id = x.user_id WHERE nearest_ordinal < lo OR nearest_ordinal >= hi
"""
