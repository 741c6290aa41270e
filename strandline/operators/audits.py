"""Audits: what recordings and runs count of themselves, and evidence of raw streams against evidence taken before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BITS
from .sequences import sequence_hashes
from .timeseries import laid

_COUNTS = (
    "decoded_frames", "frames_with_source_pts", "valid_pts_frames", "missing_pts_frames", "duplicate_pts_frames", "nonmonotonic_pts_frames", "discontinuity_pts_frames", "decoded_corrupt_frames", "duplicate_frame_ids", "cv_frame_results", "frames_with_detection", "frames_without_detection", "multiple_detection_frames",
    "inference_failures", "preprocessing_failures", "decode_failures", "rejected_input_failures", "missing_frame_results", "orphan_frame_results", "duplicate_frame_results", "detection_rows", "orphan_detections", "duplicate_detection_ids", "detection_count_mismatches", "model_hash_mismatches",
)
#: Counters of which any makes a recording fail.
_FATAL = ("duplicate_frame_ids", "missing_frame_results", "orphan_frame_results", "duplicate_frame_results", "orphan_detections", "duplicate_detection_ids", "detection_count_mismatches", "model_hash_mismatches")


def finalization_audit(frames: DataFrame, results: DataFrame, detections: DataFrame, manifest: DataFrame, partitions: int | None = None) -> DataFrame:
    """recording_id, the counters of _COUNTS, inference_status_counts (canonical JSON), opened and verdict of each recording of the manifest, and of
    any other that has rows (verdict NO_MANIFEST).

    frames: recording_id, frame_id, pts, pts_status, quality_bits; results: recording_id, frame_id, inference_status,
    detection_count, model_manifest_sha256; detections: recording_id, frame_id, detection_id, model_manifest_sha256.
    Ids are counted on all sides before these meet, so a frequent one is one row. verdict: NOT_OPENED (no frames), FAIL (a counter
    of _FATAL), PASS.

    partitions: in how many parts recordings are counted, each by one task; without, rows are counted where they lie and meet in as many as Spark's own setting says."""
    lay = lambda t: t if partitions is None else laid(t, ["recording_id"], partitions)
    frames, results, detections, manifest = map(lay, (frames, results, detections, manifest))
    k, sides = ["recording_id", "frame_id"], {"f": frames, "r": results, "d": detections}
    model = manifest.select("recording_id", F.col("model_manifest_sha256").alias("__m"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    bit = lambda n: F.count_if(F.col("quality_bits").bitwiseAND(F.lit(BITS[n])) != 0)
    status = lambda s: F.count_if(F.col("inference_status") == s)
    a = frames.groupBy("recording_id").agg(
        F.count("*").alias("decoded_frames"), F.count("pts").alias("frames_with_source_pts"), F.count_if(F.col("pts_status") == "VALID").alias("valid_pts_frames"), bit("MISSING_TIMESTAMP").alias("missing_pts_frames"), bit("DUPLICATE").alias("duplicate_pts_frames"),
        bit("NON_MONOTONIC").alias("nonmonotonic_pts_frames"), bit("STREAM_GAP").alias("discontinuity_pts_frames"), bit("DECODE_FAILURE").alias("decoded_corrupt_frames"),
    )
    counts = results.groupBy("recording_id", "inference_status").agg(F.count("*").alias("n")).groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("inference_status", "n"))).alias("s"))
    text = F.array_join(F.transform("s", lambda v: F.concat(F.lit('"'), F.coalesce(v["inference_status"], F.lit("")), F.lit('":'), v["n"].cast("string"))), ",")
    counts = counts.select("recording_id", F.concat(F.lit("{"), text, F.lit("}")).alias("inference_status_counts"))
    b = results.join(model, "recording_id", "left").groupBy("recording_id").agg(
        F.count("*").alias("cv_frame_results"), F.count_if(F.col("detection_count") > 0).alias("frames_with_detection"), F.count_if(F.col("detection_count") == 0).alias("frames_without_detection"), F.count_if(F.col("detection_count") > 1).alias("multiple_detection_frames"),
        status("INFERENCE_FAILURE").alias("inference_failures"), status("PREPROCESS_FAILURE").alias("preprocessing_failures"), status("DECODE_FAILURE").alias("decode_failures"), status("REJECTED_INPUT").alias("rejected_input_failures"), F.count_if(~F.col("model_manifest_sha256").eqNullSafe(F.col("__m"))).alias("__models_r"),
    )
    each = reduce(DataFrame.unionByName, (t.groupBy(*k).agg(F.count("*").alias("n"), (F.sum("detection_count") if s == "r" else F.lit(0)).cast("long").alias("stated")).withColumn("side", F.lit(s)) for s, t in sides.items()))
    each = lay(each).groupBy(*k).agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in sides), F.max("stated").alias("stated"))
    c = each.groupBy("recording_id").agg(
        total(F.greatest(F.col("f") - 1, F.lit(0))).alias("duplicate_frame_ids"), total(((F.col("f") > 0) & (F.col("r") == 0)).cast("int")).alias("missing_frame_results"), total(((F.col("f") == 0) & (F.col("r") > 0)).cast("int")).alias("orphan_frame_results"), total(F.greatest(F.col("r") - 1, F.lit(0))).alias("duplicate_frame_results"),
        total(F.when(F.col("f") == 0, F.col("d")).otherwise(0)).alias("orphan_detections"), total(((F.col("r") > 0) & ~F.col("stated").eqNullSafe(F.col("d") * F.col("r"))).cast("int")).alias("detection_count_mismatches"),
    )
    d = detections.join(model, "recording_id", "left").groupBy("recording_id", "detection_id").agg(F.count("*").alias("n"), F.count_if(~F.col("model_manifest_sha256").eqNullSafe(F.col("__m"))).alias("other"))
    d = d.groupBy("recording_id").agg(F.sum("n").alias("detection_rows"), F.sum(F.col("n") - 1).alias("duplicate_detection_ids"), F.sum("other").alias("__models_d"))
    known = manifest.select("recording_id", F.lit(True).alias("__known"))
    x = reduce(lambda p, q: p.join(q, "recording_id", "full"), (known, a, b, c, d, counts))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long")
    x = x.withColumn("model_hash_mismatches", zero("__models_r") + zero("__models_d"))
    x = x.select("recording_id", *(zero(n).alias(n) for n in _COUNTS), F.coalesce("inference_status_counts", F.lit("{}")).alias("inference_status_counts"), "__known")
    wrong = reduce(lambda p, q: p | q, (F.col(n) > 0 for n in _FATAL))
    verdict = F.when(F.col("__known").isNull(), "NO_MANIFEST").when(F.col("decoded_frames") == 0, "NOT_OPENED").when(wrong, "FAIL").otherwise("PASS")
    return x.withColumn("opened", F.col("decoded_frames") > 0).withColumn("verdict", verdict).drop("__known")


def run_totals(audits: DataFrame) -> DataFrame:
    """One row: the counters of all recordings of a run added up, videos_expected, videos_opened, videos_failed, and the run's verdict."""
    expected = F.col("verdict") != "NO_MANIFEST"
    return audits.agg(
        F.count_if(expected).alias("videos_expected"), F.count_if(expected & F.col("opened")).alias("videos_opened"), F.count_if(expected & (F.col("verdict") != "PASS")).alias("videos_failed"),
        *(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in _COUNTS), F.when((F.count("*") > 0) & F.every(F.col("verdict") == "PASS"), "PASS").otherwise("FAIL").alias("verdict"),
    )


def evidence_differences(current: DataFrame, prior: DataFrame, key: str, stream: str, record: list[str], statistics: list[str], streams: int) -> DataFrame:
    """key, stream, outcome, fields of what two audits of raw recordings say differently: rows of key, stream, the columns of
    `record` (of the whole recording, repeated on each of its streams) and of `statistics`.

    outcome, one a recording or stream: ONLY_CURRENT, ONLY_PRIOR (a recording that one audit lacks), TOPOLOGY (not so many
    streams in either), LABELS (a stream that one lacks), RECORD, STREAM, for which fields names what differs. Null is a value."""
    named = lambda df, side: df.select(F.col(key), F.col(stream), *(F.col(c).alias(f"{side}_{c}") for c in [*record, *statistics]), F.lit(True).alias(side))
    x = named(current, "a").join(named(prior, "b"), [key, stream], "full")
    whole = x.groupBy(key).agg(F.count_if(F.col("a")).alias("__na"), F.count_if(F.col("b")).alias("__nb"))
    outcome = F.when(F.col("__nb") == 0, "ONLY_CURRENT").when(F.col("__na") == 0, "ONLY_PRIOR").when((F.col("__na") != streams) | (F.col("__nb") != streams), "TOPOLOGY")
    none = F.array().cast("array<string>")
    out = whole.select(key, F.lit(None).cast(current.schema[stream].dataType).alias(stream), outcome.alias("outcome"), none.alias("fields")).where("outcome is not null")
    sound = x.join(whole.where(outcome.isNull()).select(key), key)
    differs = lambda columns: F.filter(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    out = out.union(sound.where("a is null or b is null").select(key, stream, F.lit("LABELS"), none))
    both = sound.where("a and b")
    of_record = both.select(key, F.explode(differs(record)).alias("f")).groupBy(key).agg(F.sort_array(F.collect_set("f")).alias("fields"))
    out = out.union(of_record.select(key, F.lit(None).cast(current.schema[stream].dataType), F.lit("RECORD"), "fields"))
    return out.union(both.select(key, stream, F.lit("STREAM"), differs(statistics).alias("fields")).where(F.size("fields") > 0))


def reconciled_digest(current: DataFrame, prior: DataFrame, key: str, stream: str, record: list[str], statistics: list[str], streams: int) -> DataFrame:
    """One row: n_recordings and the digest of the recordings (key and record columns, in order) on which both audits agree
    in all, and n_differing, the count of the others."""
    wrong = evidence_differences(current, prior, key, stream, record, statistics, streams).select(key).distinct()
    rows = current.select(key, *record).distinct().join(wrong, key, "left_anti")
    n = wrong.agg(F.count("*").alias("n_differing"))
    return sequence_hashes(rows, [key]).join(n)  # a row each


def primary_rules(results: DataFrame, detections: DataFrame, frame: list[str], rank: str = "detection_rank", primary: str = "selected_for_primary_track", score: str = "selection_score") -> DataFrame:
    """rule, key of detections that don't hang together with their frame's result: DETECTION_ID_REPEATED, RANK_NOT_DENSE, DETECTION_COUNT, SEVERAL_PRIMARY,
    NO_PRIMARY (detections, but none is chosen), SELECTED_NOT_PRIMARY (the result names another one), PRIMARY_NOT_BEST (one with
    a better score, or the same score and a lower rank, isn't chosen)."""
    name = lambda *c: F.concat_ws("/", *c).cast("string").alias("key")
    repeated = detections.groupBy("detection_id").agg(F.count("*").alias("n")).where("n > 1")
    out = repeated.select(F.lit("DETECTION_ID_REPEATED").alias("rule"), name("detection_id"))
    chosen = F.coalesce(F.col(primary), F.lit(False))
    order = F.struct(F.col(score), -F.col(rank))
    d = detections.groupBy(*frame).agg(F.count("*").alias("n"), F.min(rank).alias("a"), F.max(rank).alias("z"), F.count_distinct(rank).alias("u"), F.count_if(chosen).alias("c"), F.max(F.when(chosen, F.col("detection_id"))).alias("one"), F.max(order).alias("best"), F.max(F.when(chosen, order)).alias("mine"))
    x = results.select(*frame, "detection_count", "selected_detection_id").join(d, frame, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rules = {
        "RANK_NOT_DENSE": (F.col("n") > 0) & ((F.col("a") != 0) | (F.col("z") != F.col("n") - 1) | (F.col("u") != F.col("n"))), "DETECTION_COUNT": ~F.col("detection_count").eqNullSafe(F.col("n")), "SEVERAL_PRIMARY": F.col("c") > 1, "NO_PRIMARY": (F.col("n") > 0) & (F.col("c") == 0),
        "SELECTED_NOT_PRIMARY": (F.coalesce("c", F.lit(0)) < 2) & ~F.col("selected_detection_id").eqNullSafe(F.col("one")), "PRIMARY_NOT_BEST": (F.col("c") == 1) & (F.col("mine") != F.col("best")),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return out.union(x.select(F.explode(found).alias("rule"), name(*frame)))


def recording_evidence(logs: DataFrame, poses: DataFrame) -> DataFrame:
    """recording, raw_rows, raw_dynamic_rows, invalid_quaternions, npose (ZERO if every calibration row's time is exactly zero, else
    NONZERO; null without such rows), pose_rows, fully_zero_rows, any_zero_rows of each recording that has rows of either kind (null
    counts where it has none). logs and poses: rows of texts.sensor_log and texts.pose_table, whose path is the recording."""
    calibration = F.col("source_epoch_kind") == "NPOSE_CALIBRATION"
    zero = F.coalesce(F.col("source_timestamp_token").rlike(r"^0+(\.0*)?$"), F.lit(False))
    a = logs.groupBy(F.col("path").alias("recording")).agg(
        F.count("*").alias("raw_rows"), F.count_if(~calibration).alias("raw_dynamic_rows"), F.count_if(F.col("source_quality_bits").bitwiseAND(F.lit(BITS["INVALID_IMU_PAYLOAD"])) != 0).alias("invalid_quaternions"),
        F.when(F.count_if(calibration) == 0, None).when(F.every(zero | ~calibration), "ZERO").otherwise("NONZERO").alias("npose"),
    )
    b = poses.groupBy(F.col("path").alias("recording")).agg(F.count("*").alias("pose_rows"), F.count_if(F.forall("zero_triplet_mask", lambda z: z)).alias("fully_zero_rows"), F.count_if(F.exists("zero_triplet_mask", lambda z: z)).alias("any_zero_rows"))
    return a.join(b, "recording", "full")


def release_aggregates(evidence: DataFrame) -> DataFrame:
    """measure, value: what a release counts over the evidence of its recordings; a pair has rows of both kinds."""
    pair = F.col("raw_rows").isNotNull() & F.col("pose_rows").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = evidence.agg(
        F.count_if(pair).alias("pairs"), *(total(c).alias(c) for c in ("raw_rows", "raw_dynamic_rows", "invalid_quaternions", "pose_rows", "fully_zero_rows", "any_zero_rows")), F.count_if(F.col("npose") == "ZERO").alias("npose_zero_recordings"),
        F.count_if(F.col("npose") == "NONZERO").alias("npose_nonzero_recordings"), F.count_if(F.col("invalid_quaternions") > 0).alias("invalid_quaternion_recordings"), F.count_if(F.col("fully_zero_rows") > 0).alias("fully_zero_recordings"),
    )
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("value")) for c in one.columns))).alias("m")).select("m.*")


def affected_recordings(evidence: DataFrame) -> DataFrame:
    """kind, recording of what a release has to name: INVALID_QUATERNION, NONZERO_NPOSE, FULLY_ZERO_POSE, UNPAIRED."""
    rules = {"INVALID_QUATERNION": F.col("invalid_quaternions") > 0, "NONZERO_NPOSE": F.col("npose") == "NONZERO", "FULLY_ZERO_POSE": F.col("fully_zero_rows") > 0, "UNPAIRED": F.col("raw_rows").isNull() | F.col("pose_rows").isNull()}
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return evidence.select(F.explode(found).alias("kind"), "recording")


def instruction_summary(instructions: DataFrame, apart: str = "mp4") -> DataFrame:
    """type, n, n_recordings, sequence_sha256 of trim instructions without a problem: a row for each type, one for all (type `all`), and
    one for all but `apart` (`others`). The hash is of their line numbers, recordings, cuts and row digests, in the order of lines."""
    x = instructions.where("problem is null").select("type", "recording_id", "line_number", "cut_frames", "row_sha256")
    groups = F.array(F.col("type"), F.lit("all"), F.when(F.col("type") != apart, "others"))
    y = x.select(F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("group"), "*")
    counts = y.groupBy("group").agg(F.count_distinct("recording_id").alias("n_recordings"))
    hashed = sequence_hashes(y, ["line_number"], ["group"], ["line_number", "recording_id", "type", "cut_frames", "row_sha256"])
    return hashed.join(counts, "group").select(F.col("group").alias("type"), F.col("n_rows").alias("n"), "n_recordings", "sequence_sha256")


def mapping_summary(choices: DataFrame, by_kind: DataFrame, kinds: tuple[str, ...] = ("csv", "mot", "mp4", "raw")) -> DataFrame:
    """classification, n of the recordings that plots choose: their direction, or AMBIGUOUS where the video is the one that is cut and
    instructions cut every kind. choices: recording, direction, one row each; by_kind: recording, a column for each kind."""
    every = F.lit(True)
    for k in kinds:
        every &= F.col(k).isNotNull()
    x = choices.join(by_kind.where(every).select("recording", F.lit(True).alias("__every")), "recording", "left")
    kind = F.when((F.col("direction") == "VIDEO") & F.col("__every"), "AMBIGUOUS").otherwise(F.col("direction"))
    return x.groupBy(kind.alias("classification")).agg(F.count("*").alias("n"))
