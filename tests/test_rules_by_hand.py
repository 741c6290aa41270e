"""Rules of streams on rows made by hand, and against the same rules written with lists."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from strandline.operators import align, frames, reconcile, timeseries, validate
from strandline.schemas import BITS


def statuses(spark, v, i, intervals, limit=None, least=0.8):
    """v: (time, end) in order; i: times in order; intervals: (start, end)."""
    fv = spark.createDataFrame([("a", n, *x) for n, x in enumerate(v)], "s string, frame long, time long, end long")
    fi = spark.createDataFrame([("a", t, n) for n, t in enumerate(i)], "s string, time long, ordinal long")
    fs = spark.createDataFrame([("a", *x) for x in intervals], "s string, start long, end long")
    got = align.aligned(fv, fi, fs, ["s"], least, limit, bucket=7).collect()
    return {r["frame"]: (r["alignment_status"], r["start_ordinal"], r["stop_ordinal"], r["nearest_ordinal"], r["nearest_delta"], round(r["coverage"], 9)) for r in got}


def by_lists(v, i, intervals, limit, least):
    out = {}
    for n, (start, end) in enumerate(v):
        owner = next(((a, b) for a, b in intervals if a <= start and end <= b), None)
        mine = [k for k, t in enumerate(i) if start <= t < end]
        lo = sum(t < start for t in i) if intervals else 0
        near = delta = period = None
        cover, widest, twice = 0.0, 0, len({i[k] for k in mine}) < len(mine)
        if owner:
            theirs = [k for k, t in enumerate(i) if owner[0] <= t < owner[1]]
            steps = [i[b] - i[a] for a, b in zip(theirs, theirs[1:]) if i[b] > i[a]]
            period = median(steps) if steps else None
            if theirs:
                near = min(theirs, key=lambda k: (abs(i[k] - start), i[k], k))
                delta = i[near] - start
                twice |= i.count(i[near]) > 1
            if period:
                cover = min(1.0, len(mine) / max(1, int((end - start) / period + 1e-9)))
            if mine:
                around = ([mine[0] - 1] if mine[0] - 1 in theirs else []) + mine + ([mine[-1] + 1] if mine[-1] + 1 in theirs else [])
                widest = max([i[b] - i[a] for a, b in zip(around, around[1:])], default=0)
        most = limit if limit is not None else max(1, round(period * 2.5)) if period else None
        if owner is None:
            status = "CONTINUITY_BOUNDARY" if any(start < b and a < end for a, b in intervals) else "OUTSIDE_CONTINUITY"
        else:
            status = "NO_IMU" if not mine else "CADENCE_UNKNOWN" if period is None else "DUPLICATE_TIMESTAMP" if twice else "GAP" if widest > most or cover < least else "OK"
        out[n] = (status, lo, lo + len(mine) if intervals else 0, near, delta, round(cover, 9))
    return out


def test_alignment_by_hand(spark):
    v, i = [(0, 10), (10, 20), (20, 40)], [0, 1, 22, 23, 24, 25]
    got = statuses(spark, v, i, [(0, 40)], 5, 0.0)
    assert [got[k][0] for k in range(3)] == ["GAP", "NO_IMU", "GAP"]  # out of the first, none, into the third
    got = statuses(spark, v, i, [(0, 20), (20, 40)], 5, 0.0)
    assert [got[k][0] for k in range(3)] == ["OK", "NO_IMU", "OK"]  # spacings across a border don't count


@pytest.mark.parametrize("seed", range(5))
def test_alignment_by_lists(spark, seed):
    rnd = random.Random(seed)
    t = sorted(rnd.sample(range(400), 40))
    v = list(zip(t, [*t[1:], 410]))
    i = sorted(rnd.choices(range(420), k=60) + [x for x in range(100, 200, 3)] + t[:5])
    intervals = [[(0, 150), (150, 260), (300, 420)], [(0, 420)], [], [(0, 90), (120, 125), (125, 420)], [(200, 201), (201, 415)]][seed]
    for limit, least in ((None, 0.8), (12, 0.2)):
        assert statuses(spark, v, i, intervals, limit, least) == by_lists(v, i, intervals, limit, least)


def test_rates_take_the_first_difference_there_is(spark):
    # stream a: an equal time, then a new epoch; stream b: one frame
    rows = [("a", 0, 0, "e"), ("a", 1, 10, "e"), ("a", 2, 10, "e"), ("a", 3, 30, "f"), ("a", 4, 35, "f"), ("b", 0, 7, "e")]
    x = spark.createDataFrame([(s, o, t * 1_000_000, e) for s, o, t, e in rows], "s string, o long, t long, e string")
    for bucket in (None, 2):
        got = {(r["s"], r["o"]): (r["effective_fps"], r["gap_before_ms"]) for r in frames.rates(x, ["s"], "t", ["o"], "e", F.lit(40_000_000), bucket).collect()}
        assert got == {("a", 0): (100.0, None), ("a", 1): (None, 10.0), ("a", 2): (None, 0.0), ("a", 3): (200.0, 20.0), ("a", 4): (200.0, 5.0), ("b", 0): (1e9 / 33_000_000, None)}
    last = {(r["s"], r["o"]): r["effective_fps"] for r in frames.rates(x, ["s"], "t", ["o"], "e").collect()}
    assert last["a", 4] == 200.0 and last["b", 0] is None


def test_frame_statuses_and_bits(spark):
    good = [("a", 0, 0, "e", "OK", 0), ("a", 1, 10_000_000, "e", "MISSING_TIMESTAMP", BITS["MISSING_TIMESTAMP"]), ("a", 2, 20_000_000, "e", "DECODE_FAILURE", BITS["DECODE_FAILURE"])]
    x = spark.createDataFrame(good, "s string, canonical_ordinal long, canonical_time_ns long, clock_epoch_id string, decode_status string, quality_bits long")
    x = frames.rates(x, ["s"], "canonical_time_ns", ["canonical_ordinal"], "clock_epoch_id").withColumn("width", F.lit(1)).withColumn("height", F.lit(1))
    assert validate.frame_rows(x, ["s"]).collect() == []
    close = x.withColumn("gap_before_ms", F.col("gap_before_ms") + 5e-7)  # within the absolute tolerance
    assert validate.frame_rows(close, ["s"]).collect() == []
    bad = x.withColumn("decode_status", F.lit("DECODE_FAILURE"))
    assert sorted((r["rule"], r["key"]) for r in validate.frame_rows(bad, ["s"]).collect()) == [("DECODE_FAILURE_AGAINST_BIT", "a/0"), ("DECODE_FAILURE_AGAINST_BIT", "a/1"), ("MISSING_TIMESTAMP_AGAINST_BIT", "a/1")]
    bad = x.withColumn("effective_fps", F.when(F.col("canonical_ordinal") > 0, F.lit(float("nan")))).withColumn("decode_status", F.lit("LATE"))
    assert {r["rule"] for r in validate.frame_rows(bad, ["s"]).collect()} == {"FPS_NOT_DERIVED", "VALUE_NOT_FINITE", "STATUS_UNKNOWN", "DECODE_FAILURE_AGAINST_BIT", "MISSING_TIMESTAMP_AGAINST_BIT"}


def test_selection(spark):
    r = spark.createDataFrame([(0, "SUCCESS"), (1, "SUCCESS"), (2, "NO_DETECTION"), (3, "INFERENCE_FAILURE"), (4, "SUCCESS"), (5, "LOST"), (6, "NO_DETECTION")], "f long, inference_status string")
    d = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z"), (6, "w")], "f long, d string")
    got = {x["f"]: (x["selection_status"], x["selection_reason"], x["selected"]) for x in frames.primary_selection(r, d, ["f"], "d", "inference_status").collect()}
    assert got == {0: ("SELECTED", "SINGLE_DETECTION", "x"), 1: ("ABSTAINED", "MULTIPLE_DETECTIONS", None), 2: ("ABSTAINED", "NO_DETECTIONS", None), 3: ("ABSTAINED", "INFERENCE_STATUS_INFERENCE_FAILURE", None), 4: ("ABSTAINED", "NO_DETECTIONS", None), 5: ("ABSTAINED", "INFERENCE_STATUS_LOST", None), 6: ("SELECTED", "SINGLE_DETECTION", "w")}
    assert sorted(tuple(x) for x in frames.selection_violations(r, d, ["f"]).collect()) == [("DETECTIONS_OF_A_FAILURE", "6"), ("STATUS_UNKNOWN", "5"), ("SUCCESS_WITHOUT_DETECTION", "4")]


def test_clock_runs(spark):
    # (epoch, component, acquired, canonical start, end, usable): native times and source ordinals play no part
    rows = [("e0", "c", 0, 0, 10, True), ("e1", "c", 1, 10, 20, True), ("e2", "c", 2, 20, 30, False), ("e3", "c", 3, 30, 40, True), ("e4", "d", 4, 40, 50, True), ("e5", "d", 5, 51, 60, True), ("e6", "d", 6, 60, 60, None)]
    x = spark.createDataFrame([("s", *r) for r in rows], "s string, clock_epoch_id string, continuity_component_id string, acquisition_ordinal int, canonical_start_ns long, canonical_end_ns long, ok boolean")
    got = sorted((r["start"], r["end"], r["run_id"]) for r in timeseries.clock_runs(x, ["s"], F.col("ok")).collect())
    assert got == [(0, 20, "c:e0"), (30, 40, "c:e3"), (40, 50, "d:e4"), (51, 60, "d:e5")]


def test_ratio_picks_with_ties(spark):
    rows = [(k, n, d) for k, (n, d) in enumerate([(1, 2), (2, 4), (0, 3), (5, 1), (1, 2), (9, 3), (3, 0), (1, 10**6), (7, 7)])]
    got = {r["pick"]: (r["k"], r["ratio"]) for r in reconcile.ratio_summary(spark.createDataFrame(rows, "k int, n long, d long"), "n", "d", ["k"]).collect()}
    assert got == {"min": (2, "0.000000"), "median_low": (1, "0.500000"), "median_high": (4, "0.500000"), "max": (3, "5.000000")}
