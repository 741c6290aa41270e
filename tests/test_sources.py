import pytest
from pyspark.sql import functions as F

from strandline.functions import exact
from strandline.operators import reconcile, validate
from strandline.schemas import schema, tables
from strandline.sources import store, texts
from strandline.streaming import streams


def log(tmp_path, rows):
    p = tmp_path / "S1_A01_T01.raw"
    p.write_bytes(("\r\n".join(["QUAT,w,x,y,z,timestamp", *rows]) + "\r\n").encode())
    return str(p)


def test_sensor_log(spark, tmp_path):
    cycle = lambda t, q="1,0,0,0": [f"QUAT,{q},{t}"] * 5
    bad = ["QUAT,1.169,-0.2629,0.1374,1.1418,3.5", *cycle("3.5")[1:]]
    p = log(tmp_path, cycle("1.0") + cycle("2.0") + cycle("2.00") + bad)
    lines = texts.lines(spark, p).withColumn("activity", F.lit(1))
    got = [r for r in texts.sensor_log(lines).orderBy("source_ordinal").collect() if r["sensor_label"] == "qsHIPS"]
    assert [r["source_ordinal"] for r in got] == [0, 5, 10, 15] and [r["sample_index"] for r in got] == [0, 1, 2, 3]
    assert [r["source_quality_bits"] for r in got] == [0, 4, 4, 2048] and got[3]["qw"] is None
    assert texts.sensor_log_violations(lines).count() == 0
    p = log(tmp_path, [*cycle("2.0"), *cycle("1.0"), "QUAT,1,0,0,0,x"])
    found = {r["rule"] for r in texts.sensor_log_violations(texts.lines(spark, p)).collect()}
    assert {"TIMESTAMP", "CYCLE_INCOMPLETE", "TIME_REVERSED", "BEFORE_CALIBRATION"} <= found


def test_pose_table(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",".join(["h"] * 102) + "\n" + ",".join(["0"] * 6 + ["1.5"] * 96) + "\n")
    r = texts.pose_table(texts.lines(spark, str(tmp_path / "p.csv"))).first()
    assert len(r["positions_mm"]) == 102 and r["zero_triplet_mask"] == [True, True, *[False] * 32]


def test_trims_and_groups(spark):
    cuts = spark.range(1, 15).select(*(exact.removed_rows(F.lit(k), F.col("id")).alias(k) for k in ("csv", "mot", "raw"))).collect()
    assert [r["mot"] for r in cuts] == [1, 3, 5, 6, 8, 10, 11, 13, 15, 16, 18, 20, 21, 23]
    assert [r["raw"] for r in cuts] == [8, 16, 25, 33, 41, 50, 58, 66, 75, 83, 91, 100, 108, 116] and [r["csv"] for r in cuts] == list(range(1, 15))
    x = spark.createDataFrame([("f", i) for i in range(5)], "f string, n int")
    assert [r["n"] for r in reconcile.trim(x, ["f"], ["n"], F.lit(2), 1).orderBy("n").collect()] == [0, 3, 4]
    cases = {"ab": "INCOMPLETE", "abcdd": "DUPLICATE_SENSOR", "abcdx": "UNKNOWN_SENSOR", "abced": "MALFORMED", "abcde": "COMPLETE", "abcd?": "MALFORMED", "abcd_": "MALFORMED", "abcdee": "INCOMPLETE"}
    rows = [(g, i, {"?": None, "_": ""}.get(c, c)) for g in cases for i, c in enumerate(g)]
    got = reconcile.sensor_groups(spark.createDataFrame(rows, "g string, o int, l string"), ["g"], "o", "l", list("abcde")).collect()
    assert {r["g"]: r["status"] for r in got} == cases


def test_instructions_and_inventory(spark, tmp_path):
    lines = ["S01,A01,T01,D:\\x\\S01_A01_T01.csv,csv,3,1.5,1.0", "S01,A01,T01,S01_A01_T01.raw,raw,15,1,1", "S01,A01,T02,ik_S01_A01_T02.mot,mot,2,1,1", "S01,A01,T02,ik_S01_A01_T02.mot,mot,4,1,1", "S01,A14,T02,S01_A14_T02.csv,csv,4,1,1", "S01,A01,T03,S01_A01_T03.csv, csv,4,1,1", "S01,A01,T03,S01_A01_T03.csv,csv,4,1", "S01,A01,T04,x.csv,csv,4,1,1", "S01,A01,T05,S01_A01_T05.csv,csv,x,1,1"]
    (tmp_path / "i.csv").write_bytes("\r\n".join(["Subject,Activity,Trial,File,Type,CutFrames,OrigRmse,TheoRmse", *lines, ""]).encode())
    got = texts.instructions(texts.lines(spark, str(tmp_path / "i.csv"))).orderBy("line_number").collect()
    assert [r["problem"] for r in got] == [None, "RANGE", "REPEATED", "REPEATED", "IDENTITY", "IDENTITY", "WIDTH", "FILE", "NUMBERS"] and got[0]["cut_frames"] == 3
    for n in ("S1_A1_T1.mp4", "S1_A1_T1.csv", "S2_A1_T1.csv", "x.txt"):
        (tmp_path / n).write_text(n)
    files = texts.inventory(spark, str(tmp_path))
    got = {r["recording"]: r for r in texts.pair_modalities(files, {"mp4": "video", "csv": "pose"}).collect()}
    assert got["S1_A1_T1"]["inventory_complete"] and not got["S2_A1_T1"]["inventory_complete"]
    listed = files.select("path", "length", F.when(F.col("recording") == "S2_A1_T1", "0").otherwise(F.col("sha256")).alias("sha256"))
    assert {r["status"] for r in texts.verify_members(listed, files.where("extension <> 'txt'")).collect()} == {"VERIFIED", "MISMATCH", "UNAVAILABLE"}


def test_utc_times(spark):
    cases = {"2024-02-29T23:59:59Z": 1709251199, "2024-02-29T23:59:59.5Z": 1709251199, "2023-02-29T00:00:00Z": None, "2024-02-29T23:59:60Z": None, "2024-02-29T24:00:00Z": None, "2024-02-29t00:00:00Z": None, "2024-02-29T00:00:00+00:00": None, "2024-02-29T00:00:00": None, " 2024-02-29T00:00:00Z": None, "2024-02-29T00:00:00Z\n": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.unix_seconds(texts.utc_time(F.col("t"))).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == cases


def test_snapshots(spark, tmp_path):
    root, a = str(tmp_path), spark.createDataFrame([(2, -0.0), (1, 0.0), (3, None)], "k int, v double")
    store.publish(spark, root, {"t": a}, {"by": "test"}, "one", {"t": ["k"]})
    assert [r["k"] for r in store.Snapshot(spark, root).table("t").orderBy("k").collect()] == [1, 2, 3]
    with pytest.raises(FileExistsError):
        store.publish(spark, root, {"t": a}, {}, "one", {"t": ["k"]})
    store.publish(spark, root, {"t": a.where("k > 1")}, {}, "two", {"t": ["k"]})
    assert store.Snapshot(spark, root).id == "two"
    a.limit(1).write.mode("append").parquet(f"{root}/snapshots/two/t")
    with pytest.raises(ValueError, match="t is not what"):
        store.Snapshot(spark, root)
    assert store.semantic_hash(a) != store.semantic_hash(a.withColumn("v", F.abs("v"))) and store.semantic_hash(a) == store.semantic_hash(a.orderBy("v"))
    assert store.semantic_hash(a) != store.semantic_hash(a.union(a))


def test_schemas():
    assert [len(schema(t)) for t in tables()] == [14, 13, 20, 17, 14, 10, 35]


def test_imu_and_frame_rules(spark):
    row = lambda o, **v: {"recording_id": "r", "stream_id": "s", "canonical_ordinal": o, "payload_kind": "ACCEL", "validity_bits": 0, **dict.fromkeys("ax ay az gx gy gz qw qx qy qz".split()), **v}
    ok = {"ax": 1.0, "ay": 1.0, "az": 1.0}
    ddl = "recording_id string, stream_id string, canonical_ordinal long, payload_kind string, validity_bits long, " + ", ".join(f"{c} double" for c in "ax ay az gx gy gz qw qx qy qz".split())
    x = spark.createDataFrame([row(0, **ok), row(1, ax=1.0), row(2, **ok, gx=1.0), row(3, ax=float("nan"), ay=1.0, az=1.0), row(4, validity_bits=2048)], ddl)
    got = sorted((r["rule"], r["key"][-1]) for r in validate.imu_rows(x, ["recording_id", "stream_id"]).collect())
    assert got == [("CHANNEL_FORBIDDEN", "2"), ("MISSING_NOT_FLAGGED", "1"), ("NOT_FINITE", "3")]
    i = spark.createDataFrame([("a", 0, 5), ("a", 6, 8), ("a", 7, 9)], "s string, start long, end long")
    d = spark.createDataFrame([("a", 0, 10)], "s string, from long, to long")
    assert sorted(r["rule"] for r in validate.partition_of(i, ["s"], d).collect()) == ["END_OF_DOMAIN", "GAP", "OVERLAP"]
    with pytest.raises(ValueError, match="GAP at"):
        validate.assert_valid(validate.partition_of(i, ["s"], d).where("rule = 'GAP'"))
    o = spark.createDataFrame([("a", 0, 1), ("a", 1, None), ("a", 2, 3)], "s string, p int, v int")
    assert [r["key"] for r in validate.unsorted(o, ["s"], ["v"], "p").collect()] == ["a/2"]


def test_clock_epochs_as_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 9, 2, 4, 1])] + [(2, 0, 7)], "stream_id long, source_ordinal long, native_ns long").coalesce(1).write.parquet(src)
    s = spark.readStream.schema("stream_id long, source_ordinal long, native_ns long").parquet(src)
    got = streams.run_once(streams.clock_epochs(s), str(tmp_path / "cp")).orderBy("stream_id", "source_ordinal").collect()
    assert [r["epoch"] for r in got] == [0, 0, 1, 1, 2, 0]


def test_streams_of_events(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m) as at, 'a' as k, m as id from values (0),(1),(1),(30) v(m)").coalesce(1).write.parquet(src)
    s = spark.readStream.schema("at timestamp, k string, id int").parquet(src)
    got = streams.totals_once(streams.gap_sessions(s, "at", ["k"], "10 minutes", "1 hour"), str(tmp_path / "c1")).orderBy("start").collect()
    assert [r["n"] for r in got] == [3, 1]
    assert streams.run_once(streams.without_repeats(s, "at", ["id"], "1 hour"), str(tmp_path / "c2")).count() == 3


def test_rows_that_come_late(spark, tmp_path):
    src, ddl = str(tmp_path / "in"), "s long, t long"
    for n, rows in enumerate([[(1, 100), (2, 5)], [(1, 95), (1, 89), (2, 300), (2, 1)], [(1, 500), (2, 291), (2, 289)]]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{src}/{n}")
    s = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    got = sorted(tuple(r) for r in streams.run_once(streams.late_rows(s, "t", ["s"], 10), str(tmp_path / "c")).collect())
    assert got == [(1, 89, 100), (2, 289, 300)]


def test_paths_and_catalogues(spark, tmp_path):
    paths = ["a/b", "A/b", "/x", "c/../d", "e\\f", "g//h", "ok.txt", "café", "café"]
    got = sorted((r["path"], r["problem"]) for r in texts.path_problems(spark.createDataFrame([(p,) for p in paths], "path string")).collect())
    assert got == sorted([("a/b", "COLLIDES"), ("A/b", "COLLIDES"), ("/x", "ABSOLUTE"), ("c/../d", "ESCAPES"), ("e\\f", "BACKSLASH"), ("g//h", "EMPTY_PART"), ("café", "COLLIDES"), ("café", "COLLIDES")])
    (tmp_path / "c.json").write_text('{"id": "x", "parts": [{"n": 1}]}')
    assert texts.catalog(spark, str(tmp_path / "c.json"), "id string, parts array<struct<n:int>>").first()["parts"][0]["n"] == 1
    with pytest.raises(Exception, match="(?i)malformed|parse|cannot"):
        texts.catalog(spark, str(tmp_path / "c.json"), "id int").collect()


def test_instructions_by_kind(spark):
    rows = [("s", "a", "1", k, c) for k, c in (("csv", 3), ("raw", 3), ("mot", 4))] + [("s", "a", "2", "csv", 5)]
    got = {r["trial"]: r for r in texts.by_kind(spark.createDataFrame(rows, "subject string, activity string, trial string, type string, cut_frames int")).collect()}
    assert (got["1"]["csv"], got["1"]["mot"], got["1"]["mp4"], got["1"]["agree"]) == (3, 4, None, False) and got["2"]["agree"]


def test_bundles(spark, tmp_path):
    root, a = str(tmp_path), spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    store.publish_bundle(spark, root, "r1", {"t": a}, {"t": ["k"]})
    with pytest.raises(FileExistsError):
        store.publish_bundle(spark, root, "r1", {"t": a}, {})
    with pytest.raises(Exception, match="boom"):
        store.publish_bundle(spark, root, "r2", {"t": a.withColumn("v", F.raise_error(F.lit("boom")).cast("string"))}, {"t": ["k"]})
    with pytest.raises(FileExistsError):
        store.publish_bundle(spark, root, "r2", {"t": a}, {})
    assert sorted((r["recording_id"], r["state"]) for r in store.ended(spark, root).collect()) == [("r1", "SUCCESS"), ("r2", "FAILURE")]
    left = store.unfinished(spark, root, spark.createDataFrame([("r1",), ("r2",), ("r3",)], "recording_id string"))
    assert [r["recording_id"] for r in left.collect()] == ["r3"]


def test_classes_of_names(spark):
    cases = {
        "S01/S01_A01_T01.csv": ("POSE", "S01_A01_T01"), "S01/s01_a01_t01.raw": ("RAW", "S01_A01_T01"), "S01/S01_A01_T01_POSE.mp4": ("VIDEO", "S01_A01_T01"), "S1/S1_A7_T300.csv": ("POSE", "S1_A7_T300"), "S01/S01_A01_T01.CSV": ("UNEXPECTED", None), "S01/S01_A01_T01_nPose.csv": ("COMPANION", "S01_A01_T01"),
        "S48/S48_A02_T02.mot": ("COMPANION", "S48_A02_T02"), "S48/S48_A02_T01.mot": ("UNEXPECTED", None), "S48/s48_A02_T02.mot": ("UNEXPECTED", None), "S01/ik_S01_A01_T01.mot": ("COMPANION", "S01_A01_T01"), "S01/IK_S01_A01_T01.mot": ("UNEXPECTED", None), "S01/S01_A01_T01.mp4.out": ("COMPANION", "S01_A01_T01"),
        "S01/S01_A01_T01_Npose.mp4.out": ("COMPANION", "S01_A01_T01"), "S02/S01_A01_T01.sto": ("MISPLACED", "S01_A01_T01"), "S01/x/S01_A01_T01.csv": ("MISPLACED", "S01_A01_T01"), "S01/S01_A01_T01b.csv": ("UNEXPECTED", None), "S01/readme.txt": ("UNEXPECTED", None), "S01/S01_A01_T01_orientationErrors.sto": ("UNEXPECTED", None),
    }
    classified = texts.file_classes(spark.createDataFrame([(p,) for p in cases], "path string"))
    assert {r["path"]: (r["class"], r["recording"]) for r in classified.collect()} == cases
    odd = {(r["path"], r["recording"]) for r in texts.strays(classified).collect()}
    assert odd == {(p, p.split("/")[-1].upper().removeprefix("IK_").split(".")[0].split("B.")[0].rstrip("B").removesuffix("_ORIENTATIONERRORS")) for p, (c, _) in cases.items() if c in ("UNEXPECTED", "MISPLACED") and "readme" not in p}
