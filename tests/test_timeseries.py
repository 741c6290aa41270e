from fractions import Fraction

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import exact
from strandline.operators import align, clock, timeseries
from strandline.plans import bundles, frames_sensors, ingest, relational
from strandline.sources import files

K = ["s"]


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def index(spark, frames, samples, bucket=7):
    f = frame(spark, [("a", i, t, e) for i, (t, e) in enumerate(frames)], "s string, frame long, time long, end long")
    x = frame(spark, [("a", t, o) for o, t in enumerate(samples)], "s string, time long, ordinal long")
    return {r["frame"]: r for r in align.frame_sensor_index(f, x, K, bucket).collect()}


def test_a_sample_at_the_end_belongs_to_the_next(spark):
    r = index(spark, [(0, 10), (10, 20)], [0, 10, 20])
    assert [(r[i]["start_ordinal"], r[i]["stop_ordinal"]) for i in (0, 1)] == [(0, 1), (1, 2)]


def test_nearest_ties_go_to_the_earlier_and_lower(spark):
    r = index(spark, [(10, 11)], [5, 15])[0]
    assert (r["nearest_ordinal"], r["nearest_delta"]) == (0, -5)
    r = index(spark, [(10, 11)], [5, 5, 15])[0]
    assert (r["nearest_ordinal"], r["nearest_delta"]) == (0, -5)


@pytest.mark.parametrize("bucket", [1, 3, 10, 1000])
def test_index_equals_brute_force_whatever_the_bucket(spark, bucket):
    import random

    rnd = random.Random(bucket)
    samples = sorted(rnd.randint(-50, 200) for _ in range(60))
    times = sorted({rnd.randint(-60, 220) for _ in range(40)})
    frames = list(zip(times, [*times[1:], 230], strict=True))
    got = index(spark, frames, samples, bucket)
    for i, (a, b) in enumerate(frames):
        lo, hi = sum(t < a for t in samples), sum(t < b for t in samples)
        near = min(range(len(samples)), key=lambda o: (abs(samples[o] - a), samples[o], o))
        assert (got[i]["start_ordinal"], got[i]["stop_ordinal"], got[i]["nearest_ordinal"], got[i]["nearest_delta"]) == (lo, hi, near, samples[near] - a)


def test_no_samples(spark):
    r = index(spark, [(0, 5)], [])[0]
    assert (r["n_samples"], r["nearest_ordinal"]) == (0, None)


def test_half_even_and_half_up(spark):
    x = frame(spark, [(5, 2), (7, 2), (-5, 2), (1, 3), (-2, 3)], "p long, d long")
    got = [r[0] for r in x.select(exact.divide_half_even(F.col("p"), F.col("d")).cast("long")).collect()]
    assert got == [2, 4, -2, 0, -1]
    x = frame(spark, [(5, 0, 1, 2), (3, 9, 1, 2)], "a long, f long, n long, d long")
    assert [r[0] for r in x.select(exact.rescale_half_up(*map(F.col, "afnd"), 1)).collect()] == [3, None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(10**18), 10**18), st.integers(1, 10**9), st.integers(1, 10**9)), min_size=1, max_size=30))
def test_rescale_is_exact(spark, cases):
    x = frame(spark, [(i, *c) for i, c in enumerate(cases)], "i long, v long, n long, d long").where("abs(v) < 9e17")
    y = x.select("i", "v", "n", "d", exact.divide_half_even(F.col("v").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"), F.col("d")).alias("q"))
    for r in y.collect():
        assert int(r["q"]) == round(Fraction(r["v"] * r["n"], r["d"]))


def test_intervals(spark):
    a = frame(spark, [("a", 0, 10), ("a", 12, 30)], "s string, start long, end long")
    b = frame(spark, [("a", 5, 13), ("a", 20, 21), ("a", 30, 40)], "s string, start long, end long")
    got = sorted((r["start"], r["end"]) for r in timeseries.intersect_intervals(a, b, K, 4).collect())
    assert got == [(5, 10), (12, 13), (20, 21)]
    got = sorted((r["piece"], r["start"], r["end"]) for r in timeseries.split_intervals(a.where("start = 12"), 10).collect())
    assert got == [(0, 12, 20), (1, 20, 30)]
    got = [(r["k"], r["window_start"]) for r in timeseries.hop_windows(a, 10, 4).orderBy("window_start").collect()]
    assert got == [(0, 0), (0, 12), (1, 16), (2, 20)]
    assert timeseries.hop_windows(a, 100, 4).count() == 0


def test_continuity_statuses(spark):
    f = frame(spark, [("a", 0, 8, 12), ("a", 1, 2, 4), ("a", 2, 50, 60), ("b", 3, 0, 5)], "s string, frame long, time long, end long")
    x = frame(spark, [("a", t, o) for o, t in enumerate([1, 3, 9, 11, 52])] + [("b", 1, 0)], "s string, time long, ordinal long")
    i = frame(spark, [("a", 0, 10), ("a", 10, 20)], "s string, start long, end long")
    got = {r["frame"]: r for r in align.aligned(f, x, i, K, bucket=5).collect()}
    assert (got[0]["alignment_status"], got[0]["nearest_ordinal"]) == ("CONTINUITY_BOUNDARY", None)
    assert got[1]["alignment_status"] == "OK" and got[2]["alignment_status"] == "OUTSIDE_CONTINUITY"
    assert (got[3]["alignment_status"], got[3]["start_ordinal"], got[3]["stop_ordinal"], got[3]["coverage"]) == ("OUTSIDE_CONTINUITY", 0, 0, 0.0)


CLOCK = "recording_id string, stream_id string, clock_epoch_id string, continuity_component_id string, acquisition_ordinal int, source_start_ordinal long, source_stop_ordinal long, native_start_ns long, native_end_ns long, native_anchor_ns long, canonical_anchor_ns long, scale_numerator long, scale_denominator long, mapping_status string"


def test_clock_reset_needs_the_epoch(spark):
    m = frame(spark, [("r", "s", "e0", "c0", 0, 0, 10, 0, 100, 0, 1000, 1, 1, "VALID"), ("r", "s", "e1", "c1", 1, 10, 20, 50, 150, 50, 2000, 3, 2, "VALID"), ("r", "s", "e2", "c2", 2, 20, 30, 200, 300, 200, 3000, 1, 1, "REJECTED")], CLOCK)
    x = frame(spark, [("r", "s", 10, "e0"), ("r", "s", 60, "e1"), ("r", "s", 149, "e1"), ("r", "s", 160, "e1"), ("r", "s", 210, "e2")], "recording_id string, stream_id string, t long, e string")
    got = {r["t"]: (r["map_status"], r["canonical_time_ns"]) for r in clock.map_times(x, m, "t", bucket=40).collect()}
    assert got == {10: ("MAPPED", 1010), 60: ("AMBIGUOUS", None), 149: ("MAPPED", 2148), 160: ("NO_SEGMENT", None), 210: ("UNUSABLE", None)}
    got = {r["t"]: (r["map_status"], r["canonical_time_ns"]) for r in clock.map_times(x, m, "t", epoch="e").collect()}
    assert got[60] == ("MAPPED", 2015) and got[160] == ("NO_SEGMENT", None)
    with pytest.raises(Exception, match="clock map"):
        clock.raise_on_failure(clock.map_times(x, m, "t")).collect()
    runs = timeseries.clock_runs(clock.with_bounds(m), ["recording_id", "stream_id"], F.col("mapping_status") == "VALID").orderBy("start").collect()
    assert [(r["run_id"], r["start"], r["end"]) for r in runs] == [("c0:e0", 1000, 1100), ("c1:e1", 2000, 2150)]


def test_held_runs_and_islands(spark):
    x = frame(spark, [("a", 0, "x"), ("a", 1, "x"), ("a", 5, None), ("a", 6, None), ("a", 9, "x")], "s string, t long, v string")
    r = timeseries.held_runs(x, K, ["t"], "v").first()
    assert (r["n_rows"], r["n_runs"], r["n_held"], r["first_value"], r["last_value"]) == (5, 3, 2, "x", "x")
    assert [r["island"] for r in timeseries.islands(x, K, "t", ["t"], F.lit(2)).orderBy("t").collect()] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("bucket", [None, 1, 5, 10**6])
def test_hot_streams_may_be_cut_into_buckets(spark, bucket):
    import random
    from statistics import median

    rnd = random.Random(9)
    rows = [(s, rnd.randint(0, 60), i, rnd.choice("xy")) for i, s in enumerate("aaaaaaaaab" * 8)] + [("c", 3, 99, None)]
    x = frame(spark, rows, "s string, t long, i long, v string")
    of = {s: sorted((t, i, v) for k, t, i, v in rows if k == s) for s in "abc"}
    got = {(r["s"], r["i"]): r["canonical_ordinal"] for r in timeseries.ordinals(x, K, ["t", "i"], bucket=bucket).collect()}
    assert got == {(s, i): n for s in of for n, (_, i, _) in enumerate(of[s])}
    got = {(r["s"], r["i"]): r["e"] for r in timeseries.owned_intervals(x, K, "t", ["t", "i"], F.lit(77), "e", bucket).collect()}
    assert got == {(s, i): of[s][n + 1][0] if n + 1 < len(of[s]) else 77 for s in of for n, (_, i, _) in enumerate(of[s])}
    got = {r["s"]: r["period"] for r in timeseries.median_period(x, K, "t", bucket).collect()}
    steps = {s: [b[0] - a[0] for a, b in zip(of[s], of[s][1:], strict=False) if b[0] > a[0]] for s in of}
    assert got == {s: median(d) if d else None for s, d in steps.items()}
    got = {r["s"]: (r["n_rows"], r["n_runs"], r["first_value"], r["last_value"]) for r in timeseries.held_runs(x, K, ["t", "i"], "v", bucket).collect()}
    assert got == {s: (len(o), 1 + sum(a[2] != b[2] for a, b in zip(o, o[1:], strict=False)), o[0][2], o[-1][2]) for s, o in of.items()}
    got = {(r["s"], r["i"]): r["island"] for r in timeseries.islands(x, K, "t", ["t", "i"], F.lit(2), bucket).collect()}
    for s, o in of.items():
        n = 0
        for k, (t, i, _) in enumerate(o):
            n += k > 0 and t - o[k - 1][0] > 2
            assert got[s, i] == n


def test_medians_are_exact(spark):
    import random
    from statistics import median

    rnd = random.Random(3)
    rows = [(k, rnd.choice([rnd.randint(-5, 50), rnd.randint(10**9, 10**9 + 10**7), 33_333_333])) for k in range(6) for _ in range(rnd.randint(1, 400))] + [(9, -1), (10, None), (11, 2**40)]
    got = {r["k"]: r["m"] for r in timeseries.medians(frame(spark, rows, "k int, v long"), ["k"], "v", "m", every=True).collect()}
    for k in {k for k, _ in rows}:
        v = [x for j, x in rows if j == k and x is not None and x > 0]
        assert got[k] == (median(v) if v else None)


def test_times_in_longs_and_in_decimals_are_one(spark):
    rows = [(a, f, n, d) for a in (0, 1, -1, 7, 10**6 + 1, 10**15, 2**62, -(2**62), None) for f in (0, 3, 10**6) for n, d in ((1, 1), (1001, 30_000), (86_400, 1), (2**31 - 1, 7), (1, 2), (None, 1)) if not (a and abs(a) > 10**15 and n and n > 1)]
    rows = [(a, f, n, d) for a, f, n, d in rows if a is None or n is None or abs(a - f) * n * 10**9 < d * 2**62]
    df = spark.createDataFrame(rows, "a long, f long, n int, d int")
    got = [r[0] for r in df.coalesce(1).select(exact.rescale_half_up(*map(F.col, "afnd"))).collect()]
    want = [None if a is None or n is None or a < f else (2 * (a - f) * n * 10**9 + d) // (2 * d) for a, f, n, d in rows]
    assert got == want
    plan = spark.range(1).select(exact.rescale_half_up(*(F.col("id") for _ in "afnd")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "div" in plan


def test_rounded_is_sqls_round_of_doubles(spark):
    values = [813942014043.00004, 1554680530822.0002, 1e300, -813942014043.00004, 0.5, -0.5, 2.5e-7, 1.2345675, -1.2345675, 0.285, 3.0, 0.0, None, 9007199254.740993, float("inf")]
    x = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r["r"] for r in x.select(exact.rounded(F.col("v"), 6).alias("r")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in values]
    assert found == want


@pytest.mark.parametrize("query", [relational.detection_rank, bundles.finalization_audits])
def test_tasks_grow_with_rows(spark, monkeypatch, query):
    rows = lambda: sorted(map(str, query(spark, "/root/testdata/sf0.001").collect()))
    usual = rows()
    monkeypatch.setattr(timeseries, "ROWS", 500)
    assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 12  # 6,000 line items
    assert rows() == usual


@pytest.mark.parametrize("query", [frames_sensors.hop_window_index, ingest.windows_regenerated])
def test_tasks_of_windows_grow_with_rows(spark, monkeypatch, query):
    rows = lambda df: sorted(map(str, df.collect()))
    usual, partitions, keys = rows(query(spark, "/root/testdata/sf0.001")), [], ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    kept = files.kept

    def counted(df, name, n):
        out = kept(df, name, n)
        partitions.append((n, len(out.inputFiles()), out.count()))
        return out

    monkeypatch.setattr(files, "kept", counted)
    monkeypatch.setattr(timeseries, "ROWS", 500)
    assert rows(query(spark, "/root/testdata/sf0.001")) == usual
    # 1,000 events, each in four windows; a file for each partition that has a row
    assert partitions and all(n == 8 and (some > 4 or count < 100) for n, some, count in partitions)
    assert [spark.conf.get(k) for k in keys] == before
