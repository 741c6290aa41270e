import struct

import pytest
from pyspark.sql import functions as F

from strandline.operators import contracts, detections


def test_right_angles(spark):
    one = 1 << 16
    cases = {0: (one, 0, 0, 0, one, 0), 90: (0, -one, 0, one, 0, 0), 180: (-one, 0, 0, 0, -one, 0), 270: (0, one, 0, -one, 0, 0), None: (-one, 0, 0, 0, one, 0)}
    rows = [(k, bytearray(struct.pack("<9i", *v, 0, 0, 1 << 30))) for k, v in cases.items()] + [(None, bytearray(b"x"))]
    got = spark.createDataFrame(rows, "k int, m binary").select("k", detections.rotation_degrees(F.col("m")).alias("d")).collect()
    assert all(r["k"] == r["d"] for r in got)


def test_tolerance_of_float32(spark):
    import numpy as np

    n = np.float32(0.3217)
    exact = np.float32(float(n) * 1919)
    x = spark.createDataFrame([(float(n), float(exact)), (float(n), float(np.nextafter(exact, np.float32(1e9)) + np.float32(0.01)))], "n float, d float")
    assert [r[0] for r in x.select(detections.reconciles(F.col("n"), F.col("d"), F.lit(1920))).collect()] == [True, False]


def test_payload_ranks_are_by_unsigned_bytes(spark):
    x = spark.createDataFrame([(0, bytearray(b)) for b in (b"\xff", b"\x01", b"\x01", b"\x7f")], "f int, p binary")
    got = sorted((bytes(r["p"]), r["rank"], r["same_payload_rank"]) for r in detections.payload_rank(x, ["f"], "p").collect())
    assert got == [(b"\x01", 0, 0), (b"\x01", 1, 1), (b"\x7f", 2, 0), (b"\xff", 3, 0)]


def test_boxes(spark):
    x = spark.sql("select array(named_struct('x', 0.5D, 'y', 0.25D), null) as points, array(true, true) as valid, 'NORMALIZED' as space, 101 as width, 201 as height, cast(null as array<double>) as matrix, cast(null as struct<x0:double,y0:double,x1:double,y1:double>) as box")
    r = detections.canonical(x).first()
    assert tuple(r["display_box"]) == (50.0, 50.0, 50.0, 50.0) and r["display_points"][1] is None
    r = detections.canonical(x.withColumn("valid", F.array(F.lit(False), F.lit(False)))).first()
    assert r["display_box"] is None


def test_documents():
    good = {"recording_id": "r", "sources": [{"path": "p", "sha256": "0", "bytes": 1}], "license": {"name": "x", "redistribution": "ALLOWED"}, "streams": [{"stream_id": "s", "kind": "IMU", "authority": "NONE"}], "alignment": []}
    assert contracts.check_document(good, contracts.PROVENANCE) == []
    bad = {**good, "extra": 1, "sources": [{"path": 1, "sha256": "0", "bytes": True}], "streams": [{"stream_id": "s", "kind": "X", "authority": "NONE"}]}
    del bad["license"]
    assert contracts.check_document(bad, contracts.PROVENANCE) == ["$.extra is unknown", "$.sources[0].path is no str", "$.sources[0].bytes is no int", "$.license is missing", "$.streams[0].kind is none of ['IMU', 'VIDEO']"]


def test_ordinal_tables_have_no_clock(spark):
    df = spark.range(1)
    assert contracts.forbid_clock_columns(df) is df
    with pytest.raises(ValueError, match="canonical_time_ns"):
        contracts.forbid_clock_columns(df.withColumn("canonical_time_ns", F.lit(0)))
    assert [r[0] for r in spark.createDataFrame([("RAW_SHARED",), ("NONE",), (None,)], "t string").select(contracts.eligible(F.col("t"))).collect()] == [True, False, False]


def test_cuts_inside_intervals(spark):
    i = spark.createDataFrame([("a", 0, 10, "x"), ("a", 20, 30, "y"), ("b", 0, 5, "z")], "s string, start long, end long, n string")
    p = spark.createDataFrame([("a", 0), ("a", 4), ("a", 7), ("a", 30), ("a", 22)], "s string, at long")
    got = sorted((r["n"], r["start"], r["end"]) for r in contracts.split_at(i, p, ["s"], 3).collect())
    assert got == [("x", 0, 4), ("x", 4, 7), ("x", 7, 10), ("y", 20, 22), ("y", 22, 30), ("z", 0, 5)]
