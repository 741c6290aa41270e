"""The contract of bundles: no rule is broken by sound tables, each by its fault, and timing as it is counted by hand."""

import random
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.operators import bundles
from strandline.operators import frames as frames_
from strandline.plans import bundles as made

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sound(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("bundle"), {}
    for name, t in made.sound(spark, SF).items():
        t.write.parquet(f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def broken(tables):
    found = {}
    for r in bundles.bundle_violations(*(tables[n] for n in ("frames", "results", "detections", "selections", "manifest")), made.DOMAIN).collect():
        found.setdefault(r["rule"], set()).add(r["key"])
    return found


def test_sound_tables_break_no_rule(sound):
    assert broken(sound) == {}


def test_each_fault_breaks_its_rule(spark, sound):
    sizes = {r["recording_id"]: r["n"] for r in sound["frames"].groupBy("recording_id").agg(F.count("*").alias("n")).collect()}
    long = iter(sorted(k for k, n in sizes.items() if n >= 3))
    rows = {r["recording_id"]: r for r in sound["frames"].where("decode_ordinal = 0").collect()}
    ready = iter(sorted(k for k, r in rows.items() if r["cv_input_sha256"] is not None and r["pts"] is not None and sizes[k] < 3))
    other = iter(sorted(k for k, r in rows.items() if r["cv_input_sha256"] is None and sizes[k] < 3))
    number = F.lit(7).cast("long")
    plain = {  # rule: (recording, column, value), in its first frame
        "TIME_BASE": (next(long), "time_base_den", F.lit(0)), "SAME_PTS_RANK": (next(ready), "same_pts_rank", number), "PRESENTATION_ORDER": (next(ready), "presentation_ordinal", number), "RELATIVE_PTS": (next(ready), "relative_pts_ns", number), "GAP_BEFORE": (next(ready), "gap_before_ns", number),
        "TIMING_BITS": (next(ready), "quality_bits", F.col("quality_bits").bitwiseXOR(F.lit(2))), "DURATION_NOT_DERIVED": (next(k for k in sorted(sizes) if rows[k]["duration_pts"] is not None), "duration_ns", number), "CV_INPUT_INVALID": (next(ready), "cv_input_pixel_format", F.lit("rgb24")),
        "CV_NOT_INVERSE": (next(ready), "cv_to_source", F.array(*(F.lit(float(v)) for v in (1, 0, 5, 0, 1, 0, 0, 0, 1)))), "ORDINALS_NOT_DENSE": (next(long), "decode_ordinal", F.lit(99).cast("long")), "FRAME_ID_REPEATED": (twice := next(long), "frame_id", F.lit(None)),
    }
    frames = sound["frames"]
    second = frames.where(f"recording_id = {twice} and decode_ordinal = 1").first()["frame_id"]
    for rule, (k, column, value) in plain.items():
        value = F.lit(second) if rule == "FRAME_ID_REPEATED" else value
        frames = frames.withColumn(column, F.when((F.col("recording_id") == k) & (F.col("decode_ordinal") == 0), value).otherwise(F.col(column)))
    bases, gone, nowhere, twin, stray, alone = next(long), next(long), next(long), next(ready), next(ready), next(ready)
    frames = frames.withColumn("time_base_num", F.when((F.col("recording_id") == bases) & (F.col("decode_ordinal") == 1), 7).otherwise(F.col("time_base_num"))).where(F.col("recording_id") != gone)
    early = next(other)
    results = sound["results"].withColumn("inference_status", F.when((F.col("recording_id") == early) & (F.col("decode_ordinal") == 0), "NO_DETECTION").otherwise(F.col("inference_status")))
    results = results.union(results.where((F.col("recording_id") == twin) & (F.col("decode_ordinal") == 0)))
    extra = sound["detections"].limit(1).withColumn("recording_id", F.lit(stray)).withColumn("frame_id", F.lit("nobody's"))
    tables = {"frames": frames, "results": results, "detections": sound["detections"].union(extra.select(*sound["detections"].columns)), "selections": sound["selections"].where((F.col("recording_id") != alone) | (F.col("decode_ordinal") != 0)), "manifest": sound["manifest"].where(F.col("recording_id") != nowhere)}
    found = {rule: {int(key.split("/")[0]) for key in keys} for rule, keys in broken(tables).items()}
    want = {rule: k for rule, (k, _, _) in plain.items()} | {"TIME_BASES_DIFFER": bases, "NO_FRAMES": gone, "NO_MANIFEST": nowhere, "RESULT_NOT_ONE_TO_ONE": twin, "DETECTION_WITHOUT_FRAME": stray, "SELECTION_NOT_ONE_TO_ONE": alone, "STATUS_AGAINST_INPUT": early}
    for rule, k in want.items():
        assert k in found.get(rule, set()), rule
    assert set().union(*found.values()) <= set(want.values())


def test_timing_is_as_counted_by_hand(spark):
    """Times as fractions of seconds, flags by looking at every pair of neighbours."""
    num, den, limit = 1001, 30_000, 100_000_000
    streams = {1: [0, 1, 2, 2, 3, 9, 8, None, 10], 2: [5, 5, 5], 3: [None, None], 4: [0, 4], 5: [7, 3, 11, 3]}
    rows, want = [], {}
    half_up = lambda x: (x.numerator * 2 + x.denominator) // (2 * x.denominator)
    for rec, times in streams.items():
        shown = sorted((t, k) for k, t in enumerate(times) if t is not None)
        for k, t in enumerate(times):
            if t is None:
                want[rec, k] = (0, None, None, None, 1, "MISSING")
            else:
                place = shown.index((t, k))
                at = lambda v: Fraction(v * num, den) * 10**9
                gap = half_up(at(t) - at(shown[place - 1][0])) if place else None
                before = [x for x in times[:k] if x is not None]
                back, twice, jump = bool(before) and t < before[-1], times.count(t) > 1, gap is not None and gap > limit
                status = "DUPLICATE" if twice else "NON_MONOTONIC" if back else "DISCONTINUITY" if jump else "VALID"
                want[rec, k] = (times[:k].count(t), place, half_up(at(t) - at(shown[0][0])), gap, 4 * twice + 2 * back + 8 * jump, status)
            rows.append((rec, f"{rec}-{k}", k, t, num, den, *want[rec, k]))
    schema = "recording_id long, frame_id string, decode_ordinal long, pts long, time_base_num int, time_base_den int, same_pts_rank long, presentation_ordinal long, relative_pts_ns long, gap_before_ns long, quality_bits long, pts_status string"
    frames = spark.createDataFrame(rows, schema)
    manifest = spark.createDataFrame([(k, limit) for k in streams], "recording_id long, discontinuity_threshold_ns long")
    assert bundles.timing_rules(frames, manifest).collect() == []
    wrong = frames.withColumn("gap_before_ns", F.col("gap_before_ns") + F.when(F.col("decode_ordinal") == 4, 1).otherwise(0)).withColumn("pts_status", F.when(F.col("recording_id") == 2, "VALID").otherwise(F.col("pts_status")))
    assert sorted((r["rule"], r["key"]) for r in bundles.timing_rules(wrong, manifest).collect()) == [("GAP_BEFORE", "1/4"), *(("PTS_STATUS", f"2/{k}") for k in range(3))]


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_frames_are_classified_alike_in_buckets(spark, monkeypatch, bucket):
    rnd = random.Random(bucket)
    monkeypatch.setattr(frames_, "ORDINALS", 5)
    rows = [(s, o, None if rnd.random() < 0.1 else rnd.choice([o, o, o + 1, 2 * o - 20, 40]), "x") for s in (*range(4), None) for o in range(40)] + [(9, 0, None, "x"), (10, 0, -3, "x")]
    df = spark.createDataFrame(rows, "s long, decode_ordinal long, pts long, gap string").repartition(5)
    some = df.where("s is not null")
    whole = frames_.classify(some, ["s"], gap=3)
    cut = frames_.classify(some, ["s"], gap=3, bucket=bucket).select(*whole.columns)
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    plan = frames_.classify(some, ["s"], gap=3, bucket=bucket)._jdf.queryExecution().optimizedPlan().toString()
    assert "__b" in plan and frames_.classify(some.limit(0), ["s"], bucket=bucket).count() == 0


def test_parts_count_what_the_whole_does_and_leave_counts_only(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("bundle-*"))
    counts = lambda **limits: {r["rule"]: r["n"] for r in made.bundle_rules(spark, SF, **limits).collect()}
    assert counts(most=1500) == counts()
    found = set(shared.glob("bundle-*")) - before
    assert len(found) == 2 and {p.name for f in found for p in f.iterdir()} == {"found"}
    assert sorted(len(list((f / "found").glob("of=*"))) for f in found) == [1, 4]


def test_a_stream_in_buckets_is_read_twice_for_each_order(spark):
    some = spark.createDataFrame([(1, k, 10 * k) for k in range(20)], "s long, decode_ordinal long, pts long")
    plan = frames_.classify(some, ["s"], gap=3, bucket=50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2  # decode order and presentation order


def test_conditions_of_rules_are_compiled(spark, sound, capsys):
    """What an explode holds is interpreted, row by row; so the rules are a column before it."""
    bundles.frame_rules(sound["frames"], sound["manifest"], made.DOMAIN).explain()
    plan = capsys.readouterr().out
    assert plan.count("Generate explode(split(__rules") == 2 and "explode(filter" not in plan


def test_arrays_that_are_close(spark):
    nan, one = float("nan"), [1.0, 0.0]
    rows = [(one, one), ([1.0, 1e-12], one), ([1.0, 1e-6], one), ([nan, 0.0], one), ([1.0, None], one), ([1.0], one), (None, one), (one, None)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.coalesce(1).select(bundles._close(F.col("a"), F.col("b"), 1e-9)).collect()] == [True, True, False, False, False, False, False, False]
