"""Streams whose rows come in any order and any batches, late rows, estimators by stream, replay without exchanges."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.plans import stored
from strandline.operators import estimators
from strandline.sources import store
from strandline.streaming import streams


def in_files(spark, rows, schema, parts, folder):
    """A file for each part, in that order."""
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(f"{folder}/{k}")
    spark.createDataFrame([], schema).write.parquet(f"{folder}/empty")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


@pytest.mark.parametrize("seed", [1, 2])
def test_epochs_do_not_depend_on_order_and_batches(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows, want = [], {}
    for s in range(4):
        t, epoch, last = 0, 0, None
        for o in range(25):
            t = 0 if rnd.random() < 0.15 else t + rnd.choice([0, 1, 5])
            epoch += last is not None and t < last
            last = t
            rows.append((s, 2 * o, t, 1000 + 10 * o + s))
            want[s, 2 * o] = (t, epoch)
    rows.append((9, 0, 0, 10_000))  # moves the watermark past the rest
    order = sorted(range(len(rows) - 1), key=lambda i: rows[i][3] + rnd.uniform(0, 90))  # up to 90 seconds out of order
    cuts = sorted(rnd.sample(range(1, len(order)), 3))
    parts = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)])] + [[len(rows) - 1]]
    stream = in_files(spark, rows, "stream_id long, source_ordinal long, native_ns long, second long", parts, tmp_path / "in")
    found = streams.clock_epochs_in_any_order(stream.withColumn("at", F.timestamp_seconds("second")), "at", "100 seconds")
    got = streams.run_once(found, str(tmp_path / "out")).where("stream_id <> 9").collect()
    assert {(r["stream_id"], r["source_ordinal"]): (r["native_ns"], r["epoch"]) for r in got} == want and len(got) == len(want)


def test_each_row_is_in_windows_or_in_the_ledger(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randrange(1000), k) for k in range(300)]
    parts = [range(0, 100), range(100, 120), [], range(120, 300)]
    window, hop, delay = 40, 10, 300
    schema = "k string, t long, id long"
    stream = in_files(spark, rows, schema, parts, tmp_path / "in")
    folder = str(tmp_path / "out")
    streams.windows_and_ledger(stream, folder, "t", ["k"], window, hop, delay)
    newest, windows, late = None, {}, set()
    for part in parts:
        for i in part:
            k, t, n = rows[i]
            if newest is not None and t < newest - delay:
                late.add((n, newest))
            else:
                for w in range((t - window) // hop + 1, t // hop + 1):
                    windows[k, w * hop] = windows.get((k, w * hop), 0) + 1
        newest = max([rows[i][1] for i in part] + ([newest] if newest is not None else []), default=None)
    counted = streams.counted_windows(spark, folder, "k string", window, delay)
    check = lambda: ({(r["k"], r["start"]): r["n"] for r in counted.collect()}, {(r["id"], r["newest"]) for r in streams.ledger(spark, folder, schema).collect()})
    assert check() == (windows, late) and len(late) > 30
    assert all(r["closed"] == (r["start"] + window <= newest - delay) for r in counted.collect())
    # nothing new: nothing changes; a batch that is run again takes its own place
    streams.windows_and_ledger(stream, folder, "t", ["k"], window, hop, delay)
    again = str(tmp_path / "again")
    streams.windows_and_ledger(in_files(spark, rows, schema, parts, tmp_path / "in2"), again, "t", ["k"], window, hop, delay)
    assert check() == (windows, late)
    assert {(r["id"], r["newest"]) for r in streams.ledger(spark, again, schema).collect()} == late


def test_estimators_by_stream(spark):
    class Counting:
        """Counts the frames of its stream; made anew for each. Defined here, so that it goes to the workers by value."""

        provenance = estimators.Provenance("m", "w", "p", "e")

        def __init__(self):
            self.n = 0

        def prepare(self, frame):
            if frame["v"] == 1:
                raise estimators.Rejected("one")
            if frame["v"] == 2:
                raise KeyError("two")
            return frame["v"]

        def infer(self, v):
            self.n += 1
            if v == 3:
                raise ZeroDivisionError
            bad = {4: estimators.Estimate((estimators.Detection((float("nan"),)),)), 5: estimators.Estimate((), -0.1), 6: estimators.Estimate((estimators.Detection((1.0,), 1.5),))}
            return bad.get(v, estimators.Estimate((estimators.Detection((float(self.n), 2.0), 0.25), estimators.Detection(()))))

    rows = [(s, o, (o * 7 + s) % 9, "x") for s in range(5) for o in range(30)] + [(None, 0, 8, "x")]
    df = spark.createDataFrame(rows, "s long, o long, v long, status string").repartition(6)
    got = {(r["s"], r["o"]): r for r in estimators.estimated(df, Counting, ["s"], ["o"], ["s", "o"]).collect()}
    assert len(got) == len(rows)
    status = {1: "REJECTED_INPUT", 2: "PREPROCESSING_FAILURE", 3: "INFERENCE_FAILURE", 4: "INVALID_OUTPUT", 5: "INVALID_OUTPUT", 6: "INVALID_OUTPUT"}
    for s in (*range(5), None):
        n = 0
        for _, o, v, _ in sorted(r for r in rows if r[0] == s):
            r = got[s, o]
            n += v not in (1, 2)
            assert r["status"] == status.get(v, "SUCCESS") and (r["model_id"], r["environment_id"]) == ("m", "e")
            assert [(d["values"], d["score"]) for d in r["detections"]] == ([([float(n), 2.0], 0.25), ([], None)] if v not in status else []) and r["n_detections"] == len(r["detections"])
    assert got[0, 4]["reason"] == "one" and {r["reason"] for r in got.values() if r["status"] == "PREPROCESSING_FAILURE"} == {"KeyError: 'two'"}


def test_replay_of_laid_out_tables_needs_no_exchange(spark, tmp_path):
    rnd = random.Random(5)
    rows = spark.createDataFrame([(s, o, s * 1000 + o) for s in range(3) for o in range(200)], "s long, canonical_ordinal long, v long")
    ranges = [(f"w{k}", rnd.randrange(4), a := rnd.randrange(210), a + rnd.choice([0, 1, 7, 90])) for k in range(60)]
    windows = spark.createDataFrame(ranges, "window_id string, s long, a long, z long")
    x = store.lay_out(rows, f"{tmp_path}/rows", "laid_rows", ["s"], block=32, buckets=4)
    w = store.lay_out_windows(windows, f"{tmp_path}/windows", "laid_windows", ["s"], "a", "z", block=32, buckets=4)
    found = store.replay_laid_out(w, x, ["s"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    want = sorted((n, s * 1000 + o) for n, s, a, z in ranges if s < 3 for o in range(a, min(z, 200)))
    assert sorted((r["window_id"], r["v"]) for r in found.collect()) == want
    assert sorted((r["window_id"], r["v"]) for r in store.replay(windows, rows, ["s"], "a", "z", bucket=32).collect()) == want
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan says what is read
    one = x.where(F.col("place") == store.place([F.lit(1).cast("long")], F.lit(2)))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in one


def test_a_batch_of_a_stream_is_written_by_as_many_tasks_as_it_needs(spark, tmp_path):
    rows = spark.range(90).withColumn("v", F.col("id") * 2)
    stored._in_batches(spark, rows, F.col("id") % 3, 3, str(tmp_path), most=10)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == 9
    assert [sorted({r["id"] % 3 for p in files[k : k + 3] for r in spark.read.parquet(str(p)).collect()}) for k in (0, 3, 6)] == [[0], [1], [2]]
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 90
