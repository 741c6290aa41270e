"""Audits of recordings and runs, evidence against evidence, ids of detections: by hand and by brute force."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandline.functions import exact, ids
from strandline.operators import audits, sequences


def test_audits_count_every_row(spark):
    rnd = random.Random(4)
    frames = [(r, f, rnd.choice([None, 5]), rnd.choice(["VALID", "MISSING"]), rnd.randrange(32)) for r in range(6) for f in range(8) for _ in range(rnd.choice([0, 1, 1, 1, 2])) if r != 4]
    results = [(r, f, rnd.choice(["SUCCESS", "NO_DETECTION", "INFERENCE_FAILURE", "PREPROCESS_FAILURE", "DECODE_FAILURE", "REJECTED_INPUT"]), rnd.randrange(3), rnd.choice("mmmx")) for r in range(7) for f in range(9) for _ in range(rnd.choice([0, 1, 1, 1, 2]))]
    detections = [(r, f, f"{r}-{rnd.randrange(30)}", rnd.choice("mmmx")) for r in range(6) for f in range(9) for _ in range(rnd.choice([0, 0, 1, 2]))]
    manifest = [(r, "m") for r in range(6)] + [(9, "m")]
    make = spark.createDataFrame
    found = audits.finalization_audit(
        make(frames, "recording_id long, frame_id long, pts long, pts_status string, quality_bits long"), make(results, "recording_id long, frame_id long, inference_status string, detection_count long, model_manifest_sha256 string"),
        make(detections, "recording_id long, frame_id long, detection_id string, model_manifest_sha256 string"), make(manifest, "recording_id long, model_manifest_sha256 string"),
    )
    got = {r["recording_id"]: r.asDict() for r in found.collect()}
    assert set(got) == {*range(7), 9}
    for rec, g in got.items():
        f, r, d = ([x for x in rows if x[0] == rec] for rows in (frames, results, detections))
        fs, rs = {x[1] for x in f}, {x[1] for x in r}
        count = lambda s: sum(x[2] == s for x in r)
        model = "m" if rec in dict(manifest) else None
        want = {
            "decoded_frames": len(f), "frames_with_source_pts": sum(x[2] is not None for x in f), "valid_pts_frames": sum(x[3] == "VALID" for x in f), "missing_pts_frames": sum(x[4] & 1 for x in f), "nonmonotonic_pts_frames": sum(x[4] >> 1 & 1 for x in f), "duplicate_pts_frames": sum(x[4] >> 2 & 1 for x in f),
            "discontinuity_pts_frames": sum(x[4] >> 3 & 1 for x in f), "decoded_corrupt_frames": sum(x[4] >> 4 & 1 for x in f), "duplicate_frame_ids": len(f) - len(fs), "cv_frame_results": len(r), "frames_with_detection": sum(x[3] > 0 for x in r), "frames_without_detection": sum(x[3] == 0 for x in r), "multiple_detection_frames": sum(x[3] > 1 for x in r),
            "inference_failures": count("INFERENCE_FAILURE"), "preprocessing_failures": count("PREPROCESS_FAILURE"), "decode_failures": count("DECODE_FAILURE"), "rejected_input_failures": count("REJECTED_INPUT"), "missing_frame_results": len(fs - rs), "orphan_frame_results": len(rs - fs), "duplicate_frame_results": len(r) - len(rs),
            "detection_rows": len(d), "orphan_detections": sum(x[1] not in fs for x in d), "duplicate_detection_ids": len(d) - len({x[2] for x in d}), "model_hash_mismatches": sum(x[4] != model for x in r) + sum(x[3] != model for x in d),
            "detection_count_mismatches": sum(sum(x[3] for x in r if x[1] == k) != sum(x[1] == k for x in d) * sum(x[1] == k for x in r) for k in rs), "opened": bool(f),
            "inference_status_counts": "{" + ",".join(f'"{s}":{count(s)}' for s in sorted({x[2] for x in r})) + "}",
        }
        assert {k: g[k] for k in want} == want
        assert g["verdict"] == ("NO_MANIFEST" if model is None else "NOT_OPENED" if not f else "FAIL" if any(g[k] for k in audits._FATAL) else "PASS")
    total = audits.run_totals(found).first()
    assert (total["videos_expected"], total["videos_opened"], total["videos_failed"], total["verdict"]) == (7, 5, sum(g["verdict"] not in ("PASS", "NO_MANIFEST") for g in got.values()), "FAIL")
    assert all(total[k] == sum(g[k] for g in got.values()) for k in audits._COUNTS)
    assert audits.run_totals(found.limit(0)).first()["verdict"] == "FAIL"


def test_evidence_against_evidence(spark):
    rows = [(k, s, 100 + k, "h" if k != 3 else None, k * s, f"t{s}") for k in range(8) for s in range(5)]
    columns = "rec long, s long, n long, sha string, held long, first string"
    args = ("rec", "s", ["n", "sha"], ["held", "first"], 5)
    change = {(1, 2): {"held": -1}, (2, 0): {"n": 0}, (2, 4): {"n": 0, "first": None}, (3, 1): {"sha": None}, (5, 3): {"s": 9}}
    names = [c.split()[0] for c in columns.split(", ")]
    prior = [tuple(change.get((r[0], r[1]), {}).get(c, v) for c, v in zip(names, r)) for r in rows if r[0] != 4 and (r[0], r[1]) != (6, 0)] + [(10, s, 1, "h", 1, "t") for s in range(5)]
    a, b = spark.createDataFrame(rows, columns), spark.createDataFrame(prior, columns)
    got = sorted((r["rec"], r["s"], r["outcome"], r["fields"]) for r in audits.evidence_differences(a, b, *args).na.fill(-1, ["s"]).collect())
    assert got == [(1, 2, "STREAM", ["held"]), (2, -1, "RECORD", ["n"]), (2, 4, "STREAM", ["first"]), (4, -1, "ONLY_CURRENT", []), (5, 3, "LABELS", []), (5, 9, "LABELS", []), (6, -1, "TOPOLOGY", []), (10, -1, "ONLY_PRIOR", [])]
    whole = audits.reconciled_digest(a, b, *args).first()
    digests = [hashlib.sha256("".join("N" if v is None else f"V{len(str(v))}:{v}" for v in (k, 100 + k, None if k == 3 else "h")).encode()).digest() for k in (0, 3, 7)]
    assert (whole["n_rows"], whole["n_differing"], whole["sequence_sha256"]) == (3, 6, sequences.serial_hash(digests))


def test_primary_detections(spark):
    d = [(1, "a", 0, True, 0.9), (1, "b", 1, False, 0.5), (2, "c", 0, False, 0.9), (2, "d", 1, None, 0.5), (3, "e", 0, True, 0.9), (3, "f", 1, True, 0.5), (4, "g", 0, False, 0.9), (4, "h", 1, True, 0.5), (5, "i", 1, True, 0.9), (6, "j", 0, True, 0.5), (6, "k", 1, False, 0.5), (7, "l", 0, True, 0.1), (8, "l", 0, True, 0.1)]
    r = [(1, 2, "a"), (2, 2, None), (3, 2, "e"), (4, 2, "h"), (5, 2, "i"), (6, 2, "k"), (7, 1, "l"), (8, 1, "l"), (9, 0, None)]
    found = audits.primary_rules(spark.createDataFrame(r, "f long, detection_count long, selected_detection_id string"), spark.createDataFrame(d, "f long, detection_id string, detection_rank long, selected_for_primary_track boolean, selection_score double"), ["f"])
    assert sorted((x["rule"], x["key"]) for x in found.collect()) == [("DETECTION_COUNT", "5"), ("DETECTION_ID_REPEATED", "l"), ("NO_PRIMARY", "2"), ("PRIMARY_NOT_BEST", "4"), ("RANK_NOT_DENSE", "5"), ("SELECTED_NOT_PRIMARY", "6"), ("SEVERAL_PRIMARY", "3")]


def literal_id(domain, frame, model, hand, box, xy, z, hand_score, score, scores, valid, rank):
    """The bytes of a detection and its rank, part by part."""
    part = lambda b: len(b).to_bytes(8, "big") + b
    floats = lambda v: b"".join(struct.pack("<f", x + 0.0 if x else 0.0) for x in v)
    maybe = lambda b: b"\0" if b is None else b"\1" + b
    some = lambda v: None if v is None else floats(v)
    parts = [frame.encode(), model.encode(), (hand or "").encode(), floats(box), floats(xy), maybe(some(z)), maybe(some(None if hand_score is None else [hand_score])), maybe(some(None if score is None else [score])), maybe(some(scores)), bytes(valid)]
    payload = domain.encode() + b"\0" + b"".join(map(part, parts))
    return hashlib.sha256(payload + part(rank.to_bytes(8, "big"))).hexdigest()


def test_ids_of_detections_byte_by_byte(spark):
    rows = [
        ("f1", "m", "Left", [0.0, 1.5, -0.0, 3.25], [0.1, -0.0], None, None, 0.5, None, [True, False], 0), ("f1", "m", None, [0.1] * 4, [1e-40, 7.0], [0.25, -1.0], 0.75, None, [0.5, 1.0], [], 3), ("é", "", "Ré", [], [], [], 0.0, -0.0, [], [True], 2**40),
    ]
    df = spark.createDataFrame(rows, "frame string, model string, hand string, box array<double>, xy array<double>, z array<double>, hs double, s double, ls array<double>, valid array<boolean>, rank long")
    c = {n: F.col(n) for n in df.columns}
    payload = ids.detection_payload("detection-1", c["frame"], c["model"], c["hand"], c["box"], c["xy"], c["z"], c["hs"], c["s"], c["ls"], c["valid"])
    got = [r[0] for r in df.select(ids.detection_id(payload, c["rank"])).collect()]
    assert got == [literal_id("detection-1", *r) for r in rows]


@pytest.mark.parametrize("cut", [0, 1, 3, 14, 3 * 10**17 + 1])
def test_removed_rows_are_whole_divisions(spark, cut):
    got = spark.createDataFrame([(k, cut) for k in ("csv", "mot", "raw", "mp4")], "k string, c long").select("k", exact.removed_rows(F.col("k"), F.col("c")).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {"csv": cut, "mot": cut * 5 // 3, "raw": cut * 25 // 3, "mp4": None}


def test_aggregates_of_a_release(spark):
    logs = [("a", "NPOSE_CALIBRATION", "0.00", 0), ("a", "DYNAMIC_OBSERVATION", "5", 2048), ("b", "NPOSE_CALIBRATION", "0", 0), ("b", "NPOSE_CALIBRATION", "0.5", 0), ("c", "DYNAMIC_OBSERVATION", "1", 4), ("d", "NPOSE_CALIBRATION", None, 0)]
    poses = [("a", [True, False]), ("a", [True, True]), ("b", [False, False]), ("e", [False, True])]
    made = audits.recording_evidence(spark.createDataFrame(logs, "path string, source_epoch_kind string, source_timestamp_token string, source_quality_bits long"), spark.createDataFrame(poses, "path string, zero_triplet_mask array<boolean>"))
    assert {r["recording"]: r["npose"] for r in made.collect()} == {"a": "ZERO", "b": "NONZERO", "c": None, "d": "NONZERO", "e": None}
    assert {r["measure"]: r["value"] for r in audits.release_aggregates(made).collect()} == {
        "pairs": 2, "raw_rows": 6, "raw_dynamic_rows": 2, "invalid_quaternions": 1, "pose_rows": 4, "fully_zero_rows": 1, "any_zero_rows": 3, "npose_zero_recordings": 1, "npose_nonzero_recordings": 2, "invalid_quaternion_recordings": 1, "fully_zero_recordings": 1,
    }
    assert sorted(map(tuple, audits.affected_recordings(made).collect())) == [("FULLY_ZERO_POSE", "a"), ("INVALID_QUATERNION", "a"), ("NONZERO_NPOSE", "b"), ("NONZERO_NPOSE", "d"), ("UNPAIRED", "c"), ("UNPAIRED", "d"), ("UNPAIRED", "e")]
    assert {r["value"] for r in audits.release_aggregates(made.limit(0)).collect()} == {0}


def test_summaries_of_instructions_and_mappings(spark):
    rows = [("csv", "r1", 1, 3, "x", None), ("mp4", "r1", 2, 4, "y", None), ("raw", "r2", 3, 5, "z", None), ("csv", "r3", 4, 5, "w", "RANGE")]
    make = lambda rows: spark.createDataFrame(rows, "type string, recording_id string, line_number long, cut_frames int, row_sha256 string, problem string")
    got = {r["type"]: (r["n"], r["n_recordings"], r["sequence_sha256"]) for r in audits.instruction_summary(make(rows)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"csv": (1, 1), "mp4": (1, 1), "raw": (1, 1), "all": (3, 2), "others": (2, 2)}
    digest = lambda v: hashlib.sha256("".join(f"V{len(str(x))}:{x}" for x in v).encode()).digest()
    # columns are hashed in the table's order: group aside, type, recording, line, cut, digest
    assert got["others"][2] == sequences.serial_hash([digest(("csv", "r1", 1, 3, "x")), digest(("raw", "r2", 3, 5, "z"))])
    chosen = spark.createDataFrame([("r1", "VIDEO"), ("r2", "VIDEO"), ("r3", "IMU"), ("r4", "ZERO")], "recording string, direction string")
    kinds = spark.createDataFrame([("r1", 1, 1, 1, 1), ("r2", 1, None, 1, 1), ("r3", 1, 1, 1, 1)], "recording string, csv int, mot int, mp4 int, raw int")
    assert {r["classification"]: r["n"] for r in audits.mapping_summary(chosen, kinds).collect()} == {"AMBIGUOUS": 1, "VIDEO": 1, "IMU": 1, "ZERO": 1}
