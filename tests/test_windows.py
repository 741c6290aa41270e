import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import frames, windows
from strandline.schemas import BITS

S = 1_000_000_000
POLICY = windows.Policy(4 * S, 4 * S)


def build(spark, drop_samples=(), drop_frames=(), accepted=True, bits=0, policy=POLICY, seconds=8, **more):
    t = [i * S // 30 for i in range(30 * seconds)]
    kept = [x for x in t if x not in drop_frames]
    v = spark.createDataFrame([("a", x, y, o, 0) for o, (x, y) in enumerate(zip(kept, [*kept[1:], seconds * S], strict=True))], "s string, time long, end long, ordinal long, quality_bits long")
    times = [i * S // 100 for i in range(100 * seconds) if i not in drop_samples]
    i = spark.createDataFrame([("a", x, o, bits if o == 7 else 0) for o, x in enumerate(times)], "s string, time long, ordinal long, quality_bits long")
    seg = spark.createDataFrame([("a", 0, 0, seconds * S, accepted)], "s string, segment int, start long, end long, accepted boolean")
    return {r["k"]: r for r in windows.candidates(v, i, seg, ["s"], policy, **more).collect()}


def gaps(found):
    return ["STREAM_GAP" in found[k]["reason_codes"].split("|") for k in sorted(found)]


@pytest.mark.parametrize(
    ("samples", "missing", "want"),
    [((), (), [False, False]), ((399,), (), [True, False]), ((400,), (), [False, True]), ((), (120,), [True, True]), ((), (120, 121, 122), [False, True]), ((200,), (), [False, False])],
)
def test_missing_rows_at_a_border(spark, samples, missing, want):
    found = build(spark, samples, [i * S // 30 for i in missing])
    assert gaps(found) == want
    if samples == (200,):
        assert not found[0]["imu_regular"] and not found[0]["tremor_band_supported"] and found[1]["imu_regular"]


def test_whole_window(spark):
    r = build(spark, seconds=4)[0]
    assert (r["video_start_ordinal"], r["video_stop_ordinal"], r["imu_start_ordinal"], r["imu_stop_ordinal"]) == (0, 120, 0, 400)
    assert (r["effective_video_fps"], r["effective_imu_hz"], r["video_observable_max_hz"], r["imu_observable_max_hz"]) == (30.0, 100.0, 12.0, 50.0)
    assert r["valid_for_frequency"] and r["quality_bits"] == 0 and r["reason_codes"] == ""


def test_a_segment_shorter_than_a_window(spark):
    assert build(spark, seconds=3) == {}


def test_equality_with_the_limit_is_not_support(spark):
    r = build(spark, seconds=4, policy=windows.Policy(4 * S, 4 * S, high_hz=12.0))[0]
    assert not r["tremor_band_supported"] and r["reason_codes"] == ""


def test_an_unsupported_frequency_does_not_reject(spark):
    r = build(spark, seconds=4, bits=BITS["FREQUENCY_UNSUPPORTED"])[0]
    assert r["reason_codes"] == "" and not r["valid_for_frequency"] and r["quality_bits"] == BITS["FREQUENCY_UNSUPPORTED"]
    r = build(spark, seconds=4, bits=BITS["CLOCK_RESET"])[0]
    assert r["reason_codes"] == "FATAL_QUALITY_BIT" and r["reason_bits"] == BITS["CLOCK_RESET"]


def test_a_rejected_segment(spark):
    r = build(spark, seconds=4, accepted=False)[0]
    assert (r["reason_codes"], r["reason_bits"]) == ("REJECTED_CONTINUITY_SEGMENT", 0)


def test_index_and_ledger_share_all_candidates(spark):
    seg = spark.createDataFrame([("a", 0, 0, 8 * S, True)], "s string, segment int, start long, end long, accepted boolean")
    none = spark.createDataFrame([], "s string, time long, end long, ordinal long, quality_bits long")
    valid, ledger = windows.window_index(none, none.drop("end"), seg, ["s"], POLICY)
    assert valid.count() == 0 and {(r["reason_codes"], r["reason_bits"]) for r in ledger.collect()} == {("FATAL_QUALITY_BIT|INSUFFICIENT_COVERAGE|NO_IMU|NO_VIDEO", BITS["PARTIAL_COVERAGE"])}


def test_quaternion_signs_are_one_rotation(spark):
    q = [1.0, 0.0, 0.0, 0.0]
    x = spark.createDataFrame([(0, i, [v * (-1) ** i for v in q]) for i in range(4)] + [(1, 0, q), (1, 1, [0.0, 1.0, 0.0, 0.0])], "g int, i int, q array<double>")
    got = {r["g"]: r["angle"] for r in windows.angular_range(x, ["g"], "q", "i").collect()}
    assert got[0] == 0.0 and abs(got[1] - 3.141592653589793) < 1e-12


def test_quaternions_that_are_none(spark):
    one, two, nan = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [float("nan"), 0.0, 0.0, 0.0]
    x = spark.createDataFrame([(0, 0, one), (0, 1, two), (0, 2, nan), (1, 0, one), (2, 0, None), (2, 1, one), (3, 0, one), (3, 1, [float("inf"), 1.0, 0.0, 0.0])], "g int, i int, q array<double>")
    assert {r["g"]: r["angle"] for r in windows.angular_range(x, ["g"], "q", "i").collect()} == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0}
    for bad in ([2.0, 0.0, 0.0, 0.0], [0.0] * 4):
        with pytest.raises(Exception, match="norm 1"):
            windows.angular_range(spark.createDataFrame([(0, 0, one), (0, 1, bad)], "g int, i int, q array<double>"), ["g"], "q", "i").collect()


def near(d, p):
    return abs(d - p) / p


def naive(v, i, seg, p):
    """Window by window, with lists: v (time, end, bits), i (time, bits), both in order; seg (start, end, accepted, bits)."""
    start, stop, accepted, own_bits = seg
    inside_v = [r for r in v if start <= r[0] < stop and r[1] <= stop]
    inside_i = [r for r in i if start <= r[0] < stop]
    middle = lambda d: float(np.median(d)) if d else None
    pv = middle([e - t for t, e, _ in inside_v if e > t])
    pi = middle([b[0] - a[0] for a, b in zip(inside_i, inside_i[1:]) if b[0] > a[0]])
    out, k = {}, 0
    while start + k * p.hop + p.window <= stop:
        ws = start + k * p.hop
        we = ws + p.window
        mine = [r for r in inside_v if r[0] >= ws and r[0] < we and r[1] <= we]
        got = {"video": (0, 0.0, False, False, None, False, 0), "imu": (0, 0.0, False, False, None, False, 0)}
        if mine:
            gap, devs, edge = [e - t for t, e, _ in mine], [near(e - t, pv) for t, e, _ in mine if pv and e > t], False
            limit = p.video_max_gap if p.video_max_gap is not None else (max(1, round(pv * 2.5)) if pv else None)
            if pv:
                tol, at = max(1.0, pv * 1e-6), v.index(mine[0])
                if mine[0][0] - ws >= pv - tol:
                    d = mine[0][0] - v[at - 1][0] if at else None
                    edge = d is None or d > pv + tol
                    gap.append(mine[0][0] - ws if d is None else d)
                    devs.append((mine[0][0] - ws) / pv if d is None else near(d, pv))
                after = v[v.index(mine[-1]) + 1 :][:1]
                long = bool(after) and after[0][0] < we < after[0][1] and after[0][1] - after[0][0] > limit + tol
                if we - mine[-1][1] >= pv - tol and not long:
                    edge = True
                    gap.append(we - mine[-1][1])
                    devs.append((we - mine[-1][1]) / pv)
            dev = max(devs) if devs else None
            got["video"] = (len(mine), min(1.0, len(mine) / (p.window / pv)) if pv else 0.0, any(a[0] == b[0] for a, b in zip(mine, mine[1:])), edge or (limit is not None and max(gap) > limit), dev, dev is not None and not edge and dev <= p.deviation, int(np.bitwise_or.reduce([r[2] for r in mine])))
        mine = [n for n, r in enumerate(i) if start <= r[0] < stop and ws <= r[0] < we]
        if mine:
            a, z, t = mine[0], mine[-1], [r[0] for r in i]
            steps = [t[n] - t[n - 1] for n in mine[1:]]
            gap, devs, edge = list(steps), [near(d, pi) for d in steps if pi and d > 0], False
            limit = p.imu_max_gap if p.imu_max_gap is not None else (max(1, round(pi * 2.5)) if pi else None)
            if pi:
                tol = max(1.0, pi * 1e-6)
                if a and t[a - 1] >= start:
                    if t[a] - pi >= ws - tol:
                        d = t[a] - t[a - 1]
                        gap.append(d)
                        devs += [near(d, pi)] if d > 0 else []
                        edge |= d > pi + tol
                elif t[a] - ws >= pi - tol:
                    d = t[a] - t[a - 1] if a else None
                    edge |= d is None or d > pi + tol
                    gap.append(t[a] - ws if d is None else d)
                    devs.append((t[a] - ws) / pi if d is None else near(d, pi))
                if z + 1 < len(t) and t[z + 1] < stop:
                    if t[z] + pi < we - tol:
                        d = t[z + 1] - t[z]
                        gap.append(d)
                        devs += [near(d, pi)] if d > 0 else []
                        edge |= d > pi + tol
                elif we - t[z] > pi + tol:
                    d = t[z + 1] - t[z] if z + 1 < len(t) else None
                    edge |= d is None or d > pi + tol
                    gap.append(we - t[z] if d is None else d)
                    devs.append((we - t[z] - pi) / pi if d is None else near(d, pi))
            dev = max(devs) if devs else None
            got["imu"] = (len(mine), min(1.0, len(mine) / (p.window / pi)) if pi else 0.0, 0 in steps, edge or (limit is not None and bool(gap) and max(gap) > limit), dev, dev is not None and not edge and dev <= p.deviation, int(np.bitwise_or.reduce([i[n][1] for n in mine])))
        a, b = got["video"], got["imu"]
        bits, why = own_bits | a[6] | b[6], set()
        for name, holds, bit in (("NO_VIDEO", not a[0], 256), ("NO_IMU", not b[0], 256), ("DUPLICATE_TIMESTAMP", a[2] or b[2], 4), ("STREAM_GAP", a[3] or b[3] or bits & 8, 8), ("INSUFFICIENT_COVERAGE", a[1] < p.video_coverage or b[1] < p.imu_coverage, 256), ("REJECTED_CONTINUITY_SEGMENT", not accepted, 0)):
            if holds:
                why.add(name)
                bits |= bit
        if bits & ~512:
            why.add("FATAL_QUALITY_BIT")
        out[k] = (*(None if x is None else round(x, 9) if isinstance(x, float) else x for side in (a, b) for x in side[:6]), "|".join(sorted(why)), bits)
        k += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_windows_by_lists(spark, seed):
    """Streams with holes, repeats, jitter and long frames, cut into segments that begin and end between rows."""
    rnd = np.random.default_rng(seed)
    policy = windows.Policy(400, 150, deviation=1.5, video_coverage=0.5, imu_coverage=0.5, video_max_gap=90 if seed % 2 else None, imu_max_gap=None if seed % 2 else 60)
    ends = lambda n, step: np.cumsum(rnd.choice([step] * 6 + [step + 1, step - 1, 3 * step, 6 * step], n))
    tv = ends(90, 33).tolist()
    ti = sorted([*ends(320, 10).tolist(), 500, 500, 501])
    ti = [t for t in ti if not 900 < t < 1100]
    v = [(a, b, int(rnd.choice([0] * 30 + [512, 64]))) for a, b in zip(tv, [*tv[1:], tv[-1] + 33])]
    i = [(t, int(rnd.choice([0] * 60 + [512, 8]))) for t in ti]
    cuts = [15, 700, 1500, 1530, 2900, 9000]
    segs = [(a, b, n != 3, 1024 if n == 1 else 0) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    fv = spark.createDataFrame([("a", t, e, o, b) for o, (t, e, b) in enumerate(v)], "s string, time long, end long, ordinal long, quality_bits long")
    fi = spark.createDataFrame([("a", t, o, b) for o, (t, b) in enumerate(i)], "s string, time long, ordinal long, quality_bits long")
    fs = spark.createDataFrame([("a", n, *x) for n, x in enumerate(segs)], "s string, segment int, start long, end long, accepted boolean, quality_bits long")
    got = {}
    for r in windows.candidates(fv, fi, fs, ["s"], policy).collect():
        sides = (r[f"{p}_{c}"] for p in ("video", "imu") for c in ("n", "coverage", "duplicate", "gap", "deviation", "regular"))
        got[r["segment"], r["k"]] = (*(round(x, 9) if isinstance(x, float) else x for x in sides), r["reason_codes"], r["reason_bits"])
    want = {(n, k): x for n, seg in enumerate(segs) for k, x in naive(v, i, seg, policy).items()}
    assert len(want) > 30 and got == want


def test_signals_of_another_kind_are_an_error(spark):
    imu = lambda kind: spark.createDataFrame([("a", o, kind, float(o), 0.0, 0.0) for o in range(400)], "s string, ordinal long, payload_kind string, ax double, ay double, az double")
    policy = windows.Policy(4 * S, 4 * S, accel_range=1.0)
    assert build(spark, seconds=4, policy=policy, imu=imu("ACCEL"))[0]["imu_signal_range_gate_passed"]
    for kind in ("GYRO", "ACCEL_GYRO"):
        with pytest.raises(Exception, match="other channels"):
            build(spark, seconds=4, policy=policy, imu=imu(kind))


def test_gates_see_the_windows_own_frames(spark):
    """Tracking, alignment and the quality of nearest samples count for frames that a window owns whole, and no others."""
    cv = spark.createDataFrame([("a", o, 0.0 if o == 119 else 0.9, 1.0, [float(o)]) for o in range(240)], "s string, ordinal long, tracking_quality double, keypoint_fraction double, motion array<double>")
    al = spark.createDataFrame([("a", o, "CONTINUITY_BOUNDARY" if o == 200 else "OK", 3) for o in range(240)], "s string, ordinal long, alignment_status string, nearest_ordinal long")
    found = build(spark, policy=windows.Policy(4 * S, 4 * S, motion_range=1.0), cv=cv, alignment=al)
    assert [found[k]["cv_tracking_valid"] for k in (0, 1)] == [False, True] and found[0]["cv_motion_range_gate_passed"]
    assert [found[k]["reason_codes"] for k in (0, 1)] == ["", "FATAL_QUALITY_BIT|INVALID_ALIGNMENT"]
    al = al.withColumn("nearest_ordinal", F.lit(7))
    assert build(spark, bits=BITS["CLOCK_RESET"], alignment=al)[1]["reason_bits"] == BITS["CLOCK_RESET"] | BITS["PARTIAL_COVERAGE"]


def test_widest_angle_over_all_pairs(spark):
    v = np.random.default_rng(5).normal(size=(300, 8))
    rows = [(int(i >= 290), i % 280 if i < 290 else i, x.tolist()) for i, x in enumerate(v)]  # ten ordinals stand for two vectors
    rows += [rows[0]] * 50 + [(2, 0, [1.0, 0.0]), (3, 0, [1.0, 0.0]), (3, 1, [-2.0, 0.0]), (4, 0, [1.0, 0.0]), (4, 1, [float("nan"), 1.0]), (5, 0, [1.0]), (5, 1, [0.0, 1.0]), (None, 0, [1.0]), (None, 1, [1.0])]
    x = spark.createDataFrame(rows, "g int, i int, q array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {g: 2 * np.arccos(min(abs(u[a] @ u[b]) for a in range(300) for b in range(a) if rows[a][0] == rows[b][0] == g and rows[a][1] != rows[b][1])) for g in (0, 1)}
    for block in (4096, 40):
        got = {r["g"]: r["angle"] for r in windows.widest_angles(x, ["g"], "q", "i", block).collect()}
        assert all(abs(got[g] - want[g]) < 1e-9 for g in want)
        assert got.keys() == {0, 1, 3, 4, 5} and (got[3], got[4], got[5]) == (0.0, 0.0, None)


def test_pts_statuses(spark):
    x = spark.createDataFrame([(0, i, p) for i, p in enumerate([0, 10, 10, 5, None, 5000])], "s int, decode_ordinal long, pts long")
    got = {r["decode_ordinal"]: r for r in frames.classify(x, ["s"], gap=1000).collect()}
    assert [got[i]["pts_status"] for i in range(6)] == ["VALID", "DUPLICATE", "DUPLICATE", "NON_MONOTONIC", "MISSING", "DISCONTINUITY"]
    assert [got[i]["presentation_ordinal"] for i in range(6)] == [0, 2, 3, 1, None, 4] and [got[i]["same_pts_rank"] for i in (1, 2)] == [0, 1]


def test_matrices(spark):
    x = spark.range(1).select(F.array(*map(F.lit, (2.0, 0.0, 1.0, 0.0, 3.0, 2.0, 0.0, 0.0, 1.0))).alias("a"), F.array(*map(F.lit, (0.0, 1.0, 0.0, -1.0, 0.0, 9.0, 0.0, 0.0, 1.0))).alias("b"), F.array(*[F.lit(0.0)] * 9).alias("z"))
    r = x.select(frames.map_point(F.lit(1.0), F.lit(1.0), frames.compose(F.col("a"), F.col("b"))).alias("p"), frames.compose(F.col("a"), frames.invert(F.col("a"))).alias("i"), frames.invert(F.col("z")).alias("n"), frames.map_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.col("b")).alias("box")).first()
    assert (r["p"]["x"], r["p"]["y"]) == (5.0, 6.0) and r["n"] is None
    assert [round(v, 9) for v in r["i"]] == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert tuple(r["box"]) == (0.0, 8.0, 1.0, 9.0)
