"""Hop windows over paired streams: coverage, cadence, gaps, gates, and a ledger of every rejected candidate.

Rows are aggregated once, in panes as wide as the greatest common divisor of window and hop; a window merges the states
of its panes. So no row is copied to the windows that hold it, however many those are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BITS, FATAL_BITS
from ..sources.files import ship
from .rotations import widest_angle, widest_angles_of
from .timeseries import bucketed_neighbours, hop_windows, medians


@dataclass(frozen=True)
class Policy:
    window: int
    hop: int
    name: str = "default"
    video_coverage: float = 0.9
    imu_coverage: float = 0.9
    video_max_gap: int | None = None
    imu_max_gap: int | None = None
    deviation: float = 0.2
    observable_factor: float = 0.4
    observable_cap: float = 12.0
    low_hz: float = 3.0
    high_hz: float = 10.0
    cycles: float = 3.0
    tracking: float = 0.1
    keypoints: float = 0.5
    motion_range: float | None = None
    motion_channels: int = 1
    accel_range: float | None = None
    gyro_range: float | None = None
    quaternion_range: float | None = None
    imu_channels: int = 1


def placed(rows: DataFrame, segments: DataFrame, keys: list[str], policy: Policy) -> DataFrame:
    """rows (keys, kind, time, end, ordinal, ...) in the segments that hold them: with segment, seg_start, seg_end, and
    prev and next (structs of time and end; of the whole stream) and whether those lie in the segment.

    Rows with an end (frames) own [time, end) and are in a segment if that holds all of it. Segments meet rows by the
    bucket of time in which rows were ordered, so a long stream stays the work of many tasks."""
    stream = [*keys, "kind"]
    x = bucketed_neighbours(rows, stream, ["time", "ordinal"], ["time", "end"], policy.window)
    cell = F.explode(F.sequence(F.floor(F.col("start") / policy.window), F.floor((F.col("end") - 1) / policy.window)))
    s = segments.where("start < end").select(*keys, F.explode(F.array(F.lit("v"), F.lit("i"))).alias("kind"), cell.alias("__b"), "segment", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))
    within = lambda at, end: (F.col(at) >= F.col("seg_start")) & (F.col(at) < F.col("seg_end")) & (F.col(end).isNull() | (F.col(end) <= F.col("seg_end")))
    x = x.join(s, [*stream, "__b"]).where(within("time", "end")).drop("__b")
    near = lambda row: F.coalesce(within(f"{row}.time", f"{row}.end"), F.lit(False))
    return x.withColumn("prev_in", near("prev_row")).withColumn("next_in", near("next_row")).withColumnRenamed("prev_row", "prev").withColumnRenamed("next_row", "next")


@dataclass(frozen=True)
class Summary:
    """An aggregate that is made in two steps: states of panes, by name, each with how states of a window are merged, and what
    follows from the merged ones."""

    states: dict[str, tuple[Column, Callable[[Column], Column]]]
    result: Callable[[dict[str, Column]], Column]


def once(column: Column, merge: Callable[[Column], Column]) -> Summary:
    """An aggregate that merges by the same function, or another one of a column, and is its own result."""
    return Summary({"": (column, merge)}, lambda m: m[""])


def pane_states(rows: DataFrame, by: list[str], policy: Policy, more: dict[str, Summary]) -> DataFrame:
    """States of placed rows by (by, seg_start, seg_end, p, e): rows whose time is in pane p of their segment and whose end is in
    pane e - 1 at most; a sample's e is p + 1. Panes are as wide as the greatest common divisor of window and hop.

    A row's step from the one before it in the segment counts in every window with the row if both lie in one pane.
    That of a pane's first row, of which there is one, is kept apart (border), with the time of the row before."""
    width = math.gcd(policy.window, policy.hop)
    pane = lambda t: F.floor((t - F.col("seg_start")) / width)
    frame = F.col("kind") == "v"
    x = rows.withColumn("p", pane(F.col("time"))).withColumn("e", F.when(F.col("end").isNull(), pane(F.col("time")) + 1).otherwise(-F.floor((F.col("seg_start") - F.col("end")) / width)))
    inside = F.col("prev_in") & (pane(F.col("prev.time")) == F.col("p"))
    since = F.when(inside, F.col("time") - F.col("prev.time"))
    span = F.when(frame, F.col("end") - F.col("time")).otherwise(since)
    place = [F.col("time").alias("t"), F.col("ordinal").alias("o")]
    border = F.when(F.col("prev_in") & ~inside, F.struct(F.col("prev.time").alias("t"), (F.col("time") - F.col("prev.time")).alias("d")))
    return x.groupBy(*by, "seg_start", "seg_end", "p", "e").agg(
        F.count("*").alias("n"), F.min("ordinal").alias("start_ordinal"), (F.max("ordinal") + 1).alias("stop_ordinal"), F.min("time").alias("lo"), F.max(F.coalesce("end", "time")).alias("last"),
        F.min(F.struct(*place, F.col("prev.time").alias("p"), F.col("prev_in").alias("inside"))).alias("a"), F.max(F.struct(*place, F.col("next.time").alias("n"), F.col("next.end").alias("e"), F.col("next_in").alias("inside"))).alias("z"),
        F.coalesce(F.bool_or(since == 0), F.lit(False)).alias("duplicate"), F.max(span).alias("most"), F.max(F.when(span > 0, span)).alias("widest"), F.min(F.when(span > 0, span)).alias("least"), F.max(border).alias("border"),
        F.coalesce(F.bit_or("quality_bits"), F.lit(0)).alias("quality_bits"), *(c.alias(f"{n}{s}") for n, m in more.items() for s, (c, _) in m.states.items()),
    )


def merged_windows(panes: DataFrame, by: list[str], policy: Policy, more: dict[str, Summary]) -> DataFrame:
    """by, k, ws, we and merged states of every window that has rows: the panes p, e with its beginning at or before p and its
    end at or after e."""
    width = math.gcd(policy.window, policy.hop)
    size, step = policy.window // width, policy.hop // width
    first = F.greatest(F.lit(0).cast("long"), -F.floor((F.lit(size) - F.col("e")) / step))
    last = F.least(F.floor(F.col("p") / step), F.floor((F.col("seg_end") - F.col("seg_start") - policy.window) / policy.hop))
    x = panes.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    x = x.withColumn("ws", F.col("seg_start") + F.col("k") * policy.hop).withColumn("we", F.col("ws") + policy.window)
    step_in = F.when((F.col("kind") != "v") & (F.col("border.t") >= F.col("ws")), F.col("border.d"))
    m = x.groupBy(*by, "k", "ws", "we").agg(
        F.sum("n").alias("n"), F.min("start_ordinal").alias("start_ordinal"), F.max("stop_ordinal").alias("stop_ordinal"), F.min("lo").alias("lo"), F.max("last").alias("last"), F.min("a").alias("a"), F.max("z").alias("z"), F.bool_or("duplicate").alias("duplicate"),
        F.max(F.greatest("most", step_in)).alias("most"), F.max(F.greatest("widest", step_in)).alias("widest"), F.min(F.least("least", step_in)).alias("least"), F.bit_or("quality_bits").alias("quality_bits"),
        *(merge(F.col(f"{n}{s}")).alias(f"{n}{s}") for n, a in more.items() for s, (_, merge) in a.states.items()),
    )
    states = {f"{n}{s}" for n, a in more.items() for s in a.states}
    return m.select(*(c for c in m.columns if c not in states), *(a.result({s: F.col(f"{n}{s}") for s in a.states}).alias(n) for n, a in more.items()))


def range_metrics(rows: DataFrame, segments: DataFrame, keys: list[str], policy: Policy, more: dict[str, Summary] | None = None) -> DataFrame:
    """A row for each window and kind that has rows: n, start_ordinal, stop_ordinal, coverage, duplicate, gap, regular,
    deviation, quality_bits, and the aggregates of `more`.

    rows: keys, kind (v: frames, which own [time, end); i: samples, whose end is null), time, end, ordinal,
    quality_bits. The period of a segment is the median of what its frames own, or of its samples' steps. At a border
    of a window, the neighbours tell whether a row that ought to be there is missing: the one inside the segment if
    there is one, else the one outside it; a frame that straddles the end for longer than the gap limit excuses it.
    """
    at, inside, more = [*keys, "segment", "kind"], placed(rows, segments, keys, policy), more or {}
    frame = F.col("kind") == "v"
    step = F.when(frame, F.col("end") - F.col("time")).when(F.col("prev_in"), F.col("time") - F.col("prev.time"))
    period = medians(inside.select(*at, step.alias("step")), at, "step", "period")
    a = merged_windows(pane_states(inside, at, policy, more), at, policy, more).join(period, at, "left")
    p, tol = F.col("period"), F.greatest(F.lit(1.0), F.col("period") * 1e-6)
    given = F.when(frame, F.lit(policy.video_max_gap).cast("double")).otherwise(F.lit(policy.imu_max_gap).cast("double"))
    limit = F.coalesce(given, F.greatest(F.lit(1.0), F.rint(p * 2.5)))
    off = lambda d: F.abs(d - p) / p
    early, late, before, after = F.col("lo") - F.col("ws"), F.col("we") - F.col("last"), F.col("lo") - F.col("a.p"), F.col("z.n") - F.col("last")
    straddled = F.coalesce((F.col("z.n") < F.col("we")) & (F.col("z.e") > F.col("we")) & (F.col("z.e") - F.col("z.n") > limit + tol), F.lit(False))
    # what each border adds: whether it was looked at, the difference to the neighbour, what stands for a missing one,
    # and the deviation that goes with that
    looked_l = F.when(frame | ~F.col("a.inside"), early >= p - tol).otherwise(F.col("lo") - p >= F.col("ws") - tol)
    looked_r = F.when(frame, (late >= p - tol) & ~straddled).when(F.col("z.inside"), F.col("last") + p < F.col("we") - tol).otherwise(late > p + tol)
    step_l, step_r = before, F.when(~frame, after)
    over = lambda looked, d: looked & (d.isNull() | (d > p + tol))
    edge = F.coalesce(over(looked_l, step_l), F.lit(False)) | F.coalesce(over(looked_r, step_r), F.lit(False))
    off_l = F.when(looked_l, F.when(step_l > 0, off(step_l)).when(step_l.isNull(), early / p).when(~F.col("a.inside") | frame, off(step_l)))
    off_r = F.when(looked_r, F.when(step_r > 0, off(step_r)).when(step_r.isNull(), F.when(frame, late / p).otherwise((late - p) / p)).when(~F.col("z.inside"), off(step_r)))
    deviation = F.greatest(off(F.col("widest")), off(F.col("least")), off_l, off_r)
    worst = F.greatest("most", F.when(looked_l, F.coalesce(step_l, early)), F.when(looked_r, F.coalesce(step_r, late)))
    return a.select(
        *at, "k", "n", "start_ordinal", "stop_ordinal", "duplicate", "quality_bits", *(more or {}),
        F.when(p.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("n") / (policy.window / p))).alias("coverage"),
        (edge | F.coalesce(worst > limit, F.lit(False))).alias("gap"), deviation.alias("deviation"), F.coalesce(~edge & (deviation <= policy.deviation), F.lit(False)).alias("regular"),
    )


def _finite(column: Column) -> Column:
    return F.when(column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")), column)


def _varies(column: Column, least: float) -> Column:
    """At least two finite values, whose range reaches `least`."""
    finite = _finite(column)
    return ((F.count(finite) >= 2) & (F.max(finite) - F.min(finite) >= least)).cast("int")


def varying(channels: dict[str, tuple[Column, float]]) -> Summary:
    """How many channels have at least two finite values whose range reaches their limit."""
    states: dict[str, tuple[Column, Callable[[Column], Column]]] = {}
    for name, (column, _) in channels.items():
        states |= {f"_{name}_n": (F.count(_finite(column)), F.sum), f"_{name}_lo": (F.min(_finite(column)), F.min), f"_{name}_hi": (F.max(_finite(column)), F.max)}
    return Summary(states, lambda m: sum((F.coalesce((m[f"_{c}_n"] >= 2) & (m[f"_{c}_hi"] - m[f"_{c}_lo"] >= least), F.lit(False)).cast("int") for c, (_, least) in channels.items()), F.lit(0)))


def signal_ranges(rows: DataFrame, by: list[str], channels: dict[str, Column], least: float) -> DataFrame:
    """by, varying: how many channels have a range of at least `least` in the group."""
    return rows.groupBy(*by).agg(F.coalesce(sum((_varies(c, least) for c in channels.values()), F.lit(0)), F.lit(0)).alias("varying"))


def angular_range(rows: DataFrame, by: list[str], vector: str, ordinal: str, tolerance: float = 1e-3) -> DataFrame:
    """by, angle: greatest rotation, 2 acos |u . v|, between a group's unit quaternions (q and -q are one); 0 if a group
    has fewer than two or one that isn't finite. Others whose norm is off 1 by more than the tolerance are an error.

    A group is one task's work, by branch and bound; for groups of any size there is widest_angles."""
    ship(rows.sparkSession)
    x = rows.select(*by, F.col(ordinal).alias("__o"), F.transform(F.coalesce(F.col(vector), F.array()), lambda v: v.cast("double")).alias("__v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*by).schema)

    def widest(group: pa.Table) -> pa.Table:
        lists, angle = group["__v"].combine_chunks(), 0.0
        if group.num_rows > 1 and set(lists.value_lengths().to_pylist()) == {4}:
            angle = widest_angle(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4), tolerance)
        return group.select(by).slice(0, 1).append_column("angle", pa.array([angle]))

    return x.groupBy(*by).applyInArrow(widest, f"{kinds}, angle double")


def widest_angles(rows: DataFrame, by: list[str], vector: str, ordinal: str, block: int = 4096) -> DataFrame:
    """by, angle: as angular_range, for groups of any size, which are cut into blocks of about `block` vectors; each pair
    of blocks is one product of two matrices, so a large group is the work of many tasks.

    Ordinals are whole numbers. Pairs are of different ordinals and of vectors of one length; groups with fewer than
    two ordinals have no row.
    """
    x = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, ordinal])).select(*by, F.col(ordinal).cast("long").alias("__o"), F.col(vector).cast("array<double>").alias("__v"))
    groups = x.groupBy(*by).agg(F.min("__o").alias("__a"), F.max("__o").alias("__b")).where("__a < __b").select(*by)
    # equal rows have one ordinal and so are no pair; without them a hash of the row deals out evenly
    x = x.where(F.col("__v").isNotNull() & ~F.exists("__v", lambda v: v.isNull())).distinct().withColumn("__n", F.size("__v"))
    of = [*by, "__n"]
    large = x.groupBy(*of).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks")).where("__blocks > 1")
    x = x.join(F.broadcast(large), of, "left")  # no more rows than there are blocks
    x = x.withColumn("__blocks", F.coalesce("__blocks", F.lit(1))).withColumn("__i", F.pmod(F.xxhash64("__o", "__v"), F.col("__blocks")).cast("int"))
    fields = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    named = lambda cs: ", ".join(f"`{c}` {fields[c]}" for c in cs)
    packed, paired = [*of, "__blocks", "__i"], [*of, "__p", "__q"]

    def pack(table: pa.Table) -> pa.Table:
        n = table["__n"][0].as_py()
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["__v"].chunks]).reshape(table.num_rows, n)
        with np.errstate(all="ignore"):
            v = v / np.sqrt((v * v).sum(1, keepdims=True))
        o = table["__o"].to_numpy().astype(np.int64)
        return table.select(packed).slice(0, 1).append_column("__os", pa.array([o.tobytes()], pa.binary())).append_column("__us", pa.array([v.tobytes()], pa.binary()))

    def least(table: pa.Table) -> pa.Table:
        os = [np.frombuffer(o, np.int64) for o in table["__os"].to_pylist()]
        us = [np.frombuffer(u, np.float64).reshape(len(o), table["__n"][0].as_py()) for u, o in zip(table["__us"].to_pylist(), os, strict=True)]
        found = np.inf
        if len(os) == 2 or table["__p"][0].as_py() == table["__q"][0].as_py():
            with np.errstate(all="ignore"):
                shared = len(np.intersect1d(os[0], os[-1])) > 0
                for k in range(0, len(os[0]), 512):
                    d = np.abs(us[0][k : k + 512] @ us[-1].T)
                    if shared:
                        d[os[0][k : k + 512, None] == os[-1]] = np.inf
                    found = np.minimum(found, d.min())  # nan stays
        return table.select(by).slice(0, 1).append_column("__d", pa.array([found])).slice(0, 0 if found == np.inf else 1)

    blocks = x.groupBy(*packed).applyInArrow(pack, f"{named(packed[:-2])}, __blocks int, __i int, __os binary, __us binary")
    each = blocks.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).select(*of, F.least("__i", "__j").alias("__p"), F.greatest("__i", "__j").alias("__q"), "__os", "__us")
    pairs = each.groupBy(*paired).applyInArrow(least, f"{named(by)}, __d double")
    angle = F.when(F.bool_or(F.isnan("__d")), 0.0).otherwise(2 * F.acos(F.least(F.lit(1.0), F.min("__d"))))
    return groups.join(pairs.groupBy(*by).agg(angle.alias("angle")), by, "left")


def window_id(domain: str, texts: list[Column], numbers: list[Column]) -> Column:
    """First 24 hex digits of the SHA-256 of a domain and tagged, length-prefixed values (S: UTF-8, I: decimal text)."""
    part = lambda tag, c: F.concat(F.lit(tag).cast("binary"), F.unhex(F.lpad(F.hex(F.octet_length(c)), 16, "0")), c.cast("binary"))
    parts = [part("S", c) for c in texts] + [part("I", c.cast("string")) for c in numbers]
    return F.substring(F.sha2(F.concat(F.lit(domain).cast("binary"), F.unhex(F.lit("00")), *parts), 256), 1, 24)


#: Channels of a sample, by what its payload kind is made of.
_CHANNELS = {"ACCEL": ("ax", "ay", "az"), "GYRO": ("gx", "gy", "gz"), "QUATERNION": ("q",)}
_METRICS = ("n", "start_ordinal", "stop_ordinal", "coverage", "duplicate", "gap", "regular", "deviation", "quality_bits")


def candidates(frames: DataFrame, samples: DataFrame, segments: DataFrame, keys: list[str], policy: Policy, alignment: DataFrame | None = None, cv: DataFrame | None = None, imu: DataFrame | None = None) -> DataFrame:
    """Every candidate window with its metrics, gates, reasons (sorted, joined by |; empty if valid) and reason_bits.

    frames: keys, time, end, ordinal, quality_bits; samples: keys, time, ordinal, quality_bits. segments: keys,
    segment, start, end, accepted and, if they have some, quality_bits. alignment: keys, ordinal (of the frame),
    alignment_status, nearest_ordinal; cv: keys, ordinal, tracking_quality, keypoint_fraction, motion (array); imu:
    keys, ordinal, payload_kind, and of ax ... gz, q (array of 4) what that kind has. Of the policy's ranges just those
    of channels that the kind has must be set; anything else is an error. Where a table isn't given, its gates pass.

    reason_bits are those of the segment, of the window's frames and samples, of the samples nearest to its frames,
    and what the reasons add. A fatal bit among them, also an added one, is a reason of its own.
    """
    at, false = [*keys, "segment", "k"], F.lit(False)
    v, i, more = frames.select(*keys, "time", "end", "ordinal", "quality_bits"), samples.select(*keys, "time", "ordinal", "quality_bits"), {}
    if alignment is not None:
        near = samples.select(*keys, F.col("ordinal").alias("nearest_ordinal"), F.col("quality_bits").alias("near_bits"))
        states = alignment.select(*keys, "ordinal", "alignment_status", "nearest_ordinal").join(near, [*keys, "nearest_ordinal"], "left")
        v = v.join(states.select(*keys, "ordinal", "alignment_status", "near_bits"), [*keys, "ordinal"], "left")
        more |= {"near_bits": once(F.bit_or("near_bits"), F.bit_or), "misaligned": once(F.bool_or(F.col("alignment_status").isin("CONTINUITY_BOUNDARY", "OUTSIDE_CONTINUITY")), F.bool_or)}
    if cv is not None:
        motion = [F.get("motion", F.lit(c)).cast("double").alias(f"motion{c}") for c in range(3)]
        v = v.join(cv.select(*keys, "ordinal", "tracking_quality", "keypoint_fraction", *motion), [*keys, "ordinal"], "left")
        good = F.col("tracking_quality").isNotNull() & ~F.isnan("tracking_quality") & (F.col("tracking_quality") >= policy.tracking) & (F.col("keypoint_fraction") >= policy.keypoints)
        moving = {f"motion{c}": (F.col(f"motion{c}"), policy.motion_range) for c in range(3)} if policy.motion_range is not None else {}
        more |= {"tracked": once(F.every(F.coalesce(good, false) | (F.col("kind") != "v")), F.every), "moving": varying(moving) if moving else Summary({}, lambda m: F.lit(policy.motion_channels))}
    ranges = {"ACCEL": policy.accel_range, "GYRO": policy.gyro_range, "QUATERNION": policy.quaternion_range}
    if imu is not None:
        channels = [c for k, cs in _CHANNELS.items() if k != "QUATERNION" and ranges[k] is not None for c in cs]
        turns = policy.quaternion_range is not None
        i = i.join(imu.select(*keys, "ordinal", "payload_kind", *channels, *(["q"] if turns else [])), [*keys, "ordinal"], "left")
        parts = F.split("payload_kind", "_")
        wrong = [F.array_contains(parts, k) != F.lit(r is not None) for k, r in ranges.items()]
        more |= {"varying": varying({c: (F.col(c), ranges["ACCEL"] if c[0] == "a" else ranges["GYRO"]) for c in channels}), "unfit": once(F.bool_or(F.coalesce(wrong[0] | wrong[1] | wrong[2], false)), F.bool_or)}
        if turns:
            more["turned"] = Summary({"": (F.collect_list(F.transform("q", lambda v: v.cast("double"))), lambda c: F.flatten(F.collect_list(c)))}, lambda m: m[""])
    rows = v.withColumn("kind", F.lit("v")).unionByName(i.withColumn("kind", F.lit("i")).withColumn("end", F.lit(None).cast("long")), allowMissingColumns=True)
    found = range_metrics(rows, segments, keys, policy, more)
    if "turned" in more:  # a window's vectors, of which its sensor's rate bounds the number
        ship(samples.sparkSession)
        found = found.withColumn("varying", F.col("varying") + (widest_angles_of(F.col("turned")) >= policy.quaternion_range).cast("int")).drop("turned")
        del more["turned"]

    values = [*_METRICS, *more]
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("m"))).alias(kind)
    bits = F.col("quality_bits") if "quality_bits" in segments.columns else F.lit(0)
    grid = hop_windows(segments, policy.window, policy.hop).select(*at, F.struct("accepted", "window_start", "window_end", bits.cast("long").alias("bits")).alias("g"))
    found = found.select(*at, "kind", F.struct(*values).alias("m"))
    both = found.unionByName(grid, allowMissingColumns=True).groupBy(*at).agg(of("v"), of("i"), F.max("g").alias("g"))
    fill = {"n": 0, "start_ordinal": 0, "stop_ordinal": 0, "coverage": 0.0, "duplicate": False, "gap": False, "regular": False, "quality_bits": 0}
    named = [(F.coalesce(F.col(f"{k}.{m}"), F.lit(fill[m])) if m in fill else F.col(f"{k}.{m}")).alias(f"{p}_{m}") for k, p in (("v", "video"), ("i", "imu")) for m in _METRICS]
    get = lambda k, c, other: F.coalesce(F.col(f"{k}.{c}"), F.lit(other)) if c in more else F.lit(other)
    signal = F.when(get("i", "unfit", False), F.raise_error(F.lit("ranges are set for other channels than the samples have")).cast("boolean")).otherwise(get("i", "varying", 0) >= policy.imu_channels) if imu is not None else F.lit(True)
    x = both.select(
        *at, "g.accepted", "g.window_start", "g.window_end", *named, F.col("g.bits").alias("segment_bits"), get("v", "near_bits", 0).alias("near_bits"), get("v", "misaligned", False).alias("misaligned"),
        (get("v", "tracked", False) if cv is not None else F.lit(True)).alias("cv_tracking_valid"), (get("v", "moving", 0) >= policy.motion_channels if cv is not None else F.lit(True)).alias("cv_motion_range_gate_passed"), signal.alias("imu_signal_range_gate_passed"),
    )
    seconds = policy.window / 1e9
    x = x.withColumn("effective_video_fps", F.col("video_n") / seconds).withColumn("effective_imu_hz", F.col("imu_n") / seconds)
    half = lambda rate, regular: F.when(F.col(regular), 0.5 * F.col(rate))
    x = x.withColumn("video_rate_based_nyquist_hz", half("effective_video_fps", "video_regular")).withColumn("imu_rate_based_nyquist_hz", half("effective_imu_hz", "imu_regular"))
    x = x.withColumn("video_observable_max_hz", F.when(F.col("video_regular"), F.least(F.lit(policy.observable_cap), policy.observable_factor * F.col("effective_video_fps"))).otherwise(0.0))
    x = x.withColumn("imu_observable_max_hz", F.coalesce("imu_rate_based_nyquist_hz", F.lit(0.0)))

    base = F.col("segment_bits").bitwiseOR(F.col("video_quality_bits")).bitwiseOR(F.col("imu_quality_bits")).bitwiseOR(F.col("near_bits"))
    partial, has = BITS["PARTIAL_COVERAGE"], lambda c, bit: c.bitwiseAND(F.lit(bit)) != 0
    short = (F.col("video_coverage") < policy.video_coverage) | (F.col("imu_coverage") < policy.imu_coverage)
    reasons = {
        "REJECTED_CONTINUITY_SEGMENT": (~F.col("accepted"), 0),
        "NO_VIDEO": (F.col("video_n") == 0, partial),
        "NO_IMU": (F.col("imu_n") == 0, partial),
        "DUPLICATE_TIMESTAMP": (F.col("video_duplicate") | F.col("imu_duplicate"), BITS["DUPLICATE"]),
        "STREAM_GAP": (F.col("video_gap") | F.col("imu_gap") | has(base, BITS["STREAM_GAP"]), BITS["STREAM_GAP"]),
        "INSUFFICIENT_COVERAGE": (short, partial),
        "INVALID_ALIGNMENT": (F.col("misaligned"), partial),
    }
    total = base
    for condition, bit in reasons.values():
        total = total.bitwiseOR(F.when(condition, bit).otherwise(0))
    x = x.withColumn("reason_bits", total.cast("long"))
    reasons["FATAL_QUALITY_BIT"] = (has(F.col("reason_bits"), FATAL_BITS), 0)
    names = F.filter(F.array(*(F.when(c, F.lit(r)) for r, (c, _) in reasons.items())), lambda r: r.isNotNull())
    x = x.withColumn("reason_codes", F.array_join(F.array_sort(names), "|"))
    band = F.col("video_regular") & F.col("imu_regular") & (F.lit(policy.high_hz) < F.col("video_observable_max_hz")) & (F.lit(policy.high_hz) < F.col("imu_observable_max_hz")) & F.lit(policy.low_hz * seconds >= policy.cycles) & ~has(F.col("reason_bits"), BITS["FREQUENCY_UNSUPPORTED"])
    x = x.withColumn("tremor_band_supported", band)
    x = x.withColumn("frequency_estimation_allowed", F.col("tremor_band_supported") & F.col("cv_tracking_valid") & F.col("cv_motion_range_gate_passed"))
    x = x.withColumn("valid_for_frequency", F.col("frequency_estimation_allowed") & F.col("imu_signal_range_gate_passed"))
    quality = F.when(F.col("valid_for_frequency"), F.col("reason_bits")).otherwise(F.col("reason_bits").bitwiseOR(F.lit(BITS["FREQUENCY_UNSUPPORTED"])))
    return x.withColumn("quality_bits", quality.cast("long")).drop("segment_bits", "near_bits")


def window_index(*inputs, **more) -> tuple[DataFrame, DataFrame]:
    """(valid windows, ledger of rejected ones) of candidates; see there for the inputs."""
    x = candidates(*inputs, **more)
    return x.where("reason_codes = ''"), x.where("reason_codes <> ''")
