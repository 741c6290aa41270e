"""Windows merged from panes against every row of every window; the widest rotation against all pairs."""

import math
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.operators import rotations, windows


def unit(x):
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def all_pairs(q):
    least = 1.0
    for k in range(len(q) - 1):
        least = min(least, float(np.abs(q[k + 1 :] @ q[k]).min()))
    return least


def sets(n):
    rng = np.random.default_rng(n)
    t = np.linspace(0, 1, n)
    return {
        "uniform": unit(rng.normal(size=(n, 4))),
        "cluster": unit(np.array([1, 0, 0, 0]) + 0.05 * rng.normal(size=(n, 4))),
        "two": unit(np.concatenate([np.array([1, 0, 0, 0]) + 0.02 * rng.normal(size=(n // 2, 4)), np.array([0.7, 0.7, 0, 0]) + 0.1 * rng.normal(size=(n - n // 2, 4))])) * rng.choice([-1, 1], (n, 1)),
        "same": np.tile([[0.0, 1.0, 0.0, 0.0]], (n, 1)),
        "circle": np.stack([np.cos(t), np.sin(t), 0 * t, 0 * t], 1),
        "walk": unit(np.cumsum(rng.normal(size=(n, 4)), 0) + 50),
        "signs": np.tile([[0.5, -0.5, 0.5, 0.5]], (n, 1)) * rng.choice([-1, 1], (n, 1)),
    }


@pytest.mark.parametrize("n", [2, 3, 700, 1500])
@pytest.mark.parametrize("leaf", [4, 64])
def test_least_product_is_that_of_all_pairs(monkeypatch, n, leaf):
    monkeypatch.setattr(rotations, "LEAF", leaf)
    monkeypatch.setattr(rotations, "SMALL", 2)
    for name, q in sets(n).items():
        assert abs(rotations.least_product(q) - all_pairs(q)) < 1e-15, name


def test_large_groups_take_seconds():
    for q in (sets(100_000)[k] for k in ("cluster", "two", "walk")):
        began = time.time()
        rotations.least_product(q)
        assert time.time() - began < 8
    assert rotations.widest_angle(np.array([[1.0, 0, 0, 0]])) == rotations.widest_angle(np.array([[1.0, 0, 0, 0], [np.nan, 0, 0, 0]])) == 0.0
    with pytest.raises(ValueError, match="norm"):
        rotations.widest_angle(np.array([[1.0, 0, 0, 0], [2.0, 0, 0, 0]]))


@pytest.mark.parametrize("small", [2, 512])
def test_the_widest_angle_is_that_of_plain_arithmetic_to_the_last_bit(monkeypatch, small):
    # pairs exactly at a limit of 1.5, which rounding alone puts on either side of it
    monkeypatch.setattr(rotations, "SMALL", small)
    monkeypatch.setattr(rotations, "LEAF", 2)
    rnd = random.Random(5)
    for n in [2, 3, 5, 9, 40] * 60:
        low = rnd.randrange(10_000)
        turns = [v / 100 / 40 for v in [low, low + 3000, *(rnd.randrange(low, low + 3000) for _ in range(n - 2))]]
        rnd.shuffle(turns)
        q = [(math.cos(t), math.sin(t)) for t in turns]
        want = 2 * math.acos(min(1.0, min(abs(a[0] * b[0] + a[1] * b[1]) for k, a in enumerate(q) for b in q[:k])))
        assert rotations.widest_angle(np.array([[*v, 0.0, 0.0] for v in q])) == want


def test_turned_quaternions_are_those_of_the_c_library(spark):
    turns = [k / 100 / 40 for k in range(20_000)]
    df = spark.createDataFrame([(t,) for t in turns], "t double")
    got = {r["t"]: r["q"] for r in df.select("t", rotations.turned(F.col("t")).alias("q")).collect()}
    assert got == {t: [math.cos(t), math.sin(t), 0.0, 0.0] for t in turns}


def test_angles_of_arrays(spark):
    q = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0]]
    rows = [(1, q[:2]), (2, [q[0], q[2]]), (3, q[:1]), (4, None), (5, []), (6, [[1.0, 0.0], [0.0, 1.0]])]
    got = {r["k"]: r["a"] for r in spark.createDataFrame(rows, "k int, q array<array<double>>").select("k", rotations.widest_angles_of(F.col("q")).alias("a")).collect()}
    assert got == {1: pytest.approx(np.pi), 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}


def row_by_row(rows, segment, policy):
    """Of each window and kind: n, ordinals, lo, last, first and last row's neighbours, steps, by looking at every row."""
    start, end = segment
    out = {}
    for kind in "vi":
        mine = sorted((t, o, e, b) for k, t, e, o, b in rows if k == kind)
        in_segment = lambda r: start <= r[0] < end and (r[2] is None or r[2] <= end)
        for k in range((end - start - policy.window) // policy.hop + 1 if end - start >= policy.window else 0):
            ws = start + k * policy.hop
            we = ws + policy.window
            at = [n for n, r in enumerate(mine) if in_segment(r) and ws <= r[0] < we + (r[2] is not None) and (r[2] is None or r[2] <= we)]
            if not at:
                continue
            since = [mine[n][0] - mine[n - 1][0] for n in at if n and in_segment(mine[n - 1]) and mine[n - 1][0] >= ws]
            spans = [mine[n][2] - mine[n][0] for n in at] if kind == "v" else since
            plus = [s for s in spans if s > 0]
            bits = 0
            for n in at:
                bits |= mine[n][3]
            got = [mine[n] for n in at]
            out[kind, k] = (len(at), min(r[1] for r in got), max(r[1] for r in got) + 1, got[0][0], max(r[2] if r[2] is not None else r[0] for r in got), mine[at[0] - 1][0] if at[0] else None, mine[at[-1] + 1][0] if at[-1] + 1 < len(mine) else None, 0 in since, max(spans, default=None), max(plus, default=None), min(plus, default=None), bits, sum(r[1] for r in got))
    return out


@pytest.mark.parametrize(("window", "hop"), [(12, 4), (10, 4), (7, 3), (5, 5), (6, 9)])
def test_windows_of_panes_equal_windows_of_rows(spark, window, hop):
    rnd = random.Random(window * 10 + hop)
    rows = []
    t = o = 0
    while t < 90:
        length = rnd.choice([0, 1, 1, 2, 3, 9])
        rows.append(("v", t, t + length, o, 1 << rnd.randrange(6)))
        t, o = t + max(length, rnd.choice([0, 1, 5])), o + 1
    t = 0
    for o in range(60):
        rows.append(("i", t, None, o, 1 << rnd.randrange(6)))
        t += rnd.choice([0, 1, 1, 2, 2, 8])
    policy, segments = windows.Policy(window, hop), [(3, 41), (41, 88), (88, 90)]
    given = spark.createDataFrame([(1, *r) for r in rows], "u int, kind string, time long, end long, ordinal long, quality_bits long")
    cut = spark.createDataFrame([(1, n, *s) for n, s in enumerate(segments)], "u int, segment int, start long, end long")
    total = {"total": windows.once(F.sum("ordinal"), F.sum)}
    by = ["u", "segment", "kind"]
    panes = windows.pane_states(windows.placed(given, cut, ["u"], policy), by, policy, total)
    got = {}
    for r in windows.merged_windows(panes, by, policy, total).collect():
        got[r["segment"], r["kind"], r["k"]] = (r["n"], r["start_ordinal"], r["stop_ordinal"], r["lo"], r["last"], r["a"]["p"], r["z"]["n"], r["duplicate"], r["most"], r["widest"], r["least"], r["quality_bits"], r["total"])
    want = {(n, *key): v for n, s in enumerate(segments) for key, v in row_by_row(rows, s, policy).items()}
    assert got == want


def test_states_do_not_grow_with_the_overlap_of_windows(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("u"), F.lit("i").alias("kind"), F.col("id").alias("time"), F.lit(None).cast("long").alias("end"), F.col("id").alias("ordinal"), F.lit(0).cast("long").alias("quality_bits"))
    cut = spark.createDataFrame([(1, 0, 0, 20_000)], "u int, segment int, start long, end long")
    counts = {}
    for window in (1000, 4000):
        policy = windows.Policy(window, 500)
        counts[window] = windows.pane_states(windows.placed(rows, cut, ["u"], policy), ["u", "segment", "kind"], policy, {}).count()
    assert counts == {1000: 40, 4000: 40}


@pytest.mark.parametrize("chunk", [50, 1 << 15])
def test_rotations_of_groups_of_any_size(spark, chunk):
    groups = {**sets(700), "few": np.array([[1.0, 0, 0, 0]]), "pair": np.array([[1.0, 0, 0, 0], [0.6, 0.8, 0, 0]])}
    rows = [(g, v.tolist()) for g, q in groups.items() for v in q] + [("few", None), (None, [1.0, 0.0, 0.0, 0.0]), (None, [0.0, 0.0, 0.0, -1.0]), ("nan", [float("nan")] * 4), ("nan", [1.0, 0.0, 0.0, 0.0]), ("short", [1.0]), ("short", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, q array<double>").repartition(5)
    got = {r["g"]: r["angle"] for r in rotations.rotation_ranges(df, ["g"], "q", chunk=chunk).collect()}
    want = {g: 2 * np.arccos(min(1.0, all_pairs(q))) for g, q in groups.items() if g != "few"} | {"few": 0.0, None: np.pi, "nan": 0.0, "short": 0.0}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-7 for g in want)
    with pytest.raises(Exception, match="norm 1"):
        rotations.rotation_ranges(spark.createDataFrame([("a", [2.0, 0.0, 0.0, 0.0]), ("a", [1.0, 0.0, 0.0, 0.0])], df.schema), ["g"], "q").collect()
    assert rotations.rotation_ranges(df.limit(0), ["g"], "q").count() == 0


def test_least_between_is_that_of_all_pairs():
    for n, m in ((3, 800), (800, 70), (900, 1500)):
        for (a, p), (b, q) in zip(sets(n).items(), list(sets(m).items())[::-1]):
            assert abs(rotations.least_between(p, q) - float(np.abs(p @ q.T).min())) < 1e-15, (a, b)


@pytest.mark.parametrize("n", [100, 380, 1000, 3000])
def test_a_large_chunk_meets_a_small_one_in_bounded_memory(n):
    p, q = unit(np.random.default_rng(n).normal(size=(1 << 15, 4))), unit(np.random.default_rng(n + 1).normal(size=(n, 4)))
    tracemalloc.start()
    try:
        least = rotations.least_between(p, q)
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()
    assert abs(least - min(float(np.abs(p @ v).min()) for v in q)) < 1e-15


def test_workers_get_large_rows_a_few_at_a_time(spark):
    rotations.rotation_ranges(spark.range(0).select("id", F.array(F.lit(1.0)).alias("q")), ["id"], "q")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("v"))
    assert max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) < 12e6
