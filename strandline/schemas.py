"""Closed schemas of the store's tables, their canonical order, and the quality bits."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

# Quality flags.
BITS = {
    "MISSING_TIMESTAMP": 1,
    "NON_MONOTONIC": 2,
    "DUPLICATE": 4,
    "STREAM_GAP": 8,
    "DECODE_FAILURE": 16,
    "INVALID_CV": 32,
    "CLOCK_RESET": 64,
    "UNRESOLVED_CLOCK_MAP": 128,
    "PARTIAL_COVERAGE": 256,
    "FREQUENCY_UNSUPPORTED": 512,
    "SYNC_RESIDUAL_EXCEEDED": 1024,
    "INVALID_IMU_PAYLOAD": 2048,
}
KNOWN_BITS = sum(BITS.values())
FATAL_BITS = KNOWN_BITS & ~BITS["FREQUENCY_UNSUPPORTED"]
# Statuses of decoded frames and of inference on a frame.
DECODE_STATUSES = ("OK", "DECODE_FAILURE", "MISSING_TIMESTAMP")
INFERENCE_STATUSES = ("SUCCESS", "NO_DETECTION", "DECODE_FAILURE", "PREPROCESS_FAILURE", "INFERENCE_FAILURE", "REJECTED_INPUT")
ELIGIBLE_TIERS = ("RAW_SHARED", "RAW_MAPPED", "SOURCE_DERIVED")

# Columns of the stored tables, `!` where null is not allowed.
_COLUMNS = {
    "frame_index": "recording_id! string, video_stream_id! string, clock_epoch_id! string, frame_index! long, source_ordinal! long, canonical_ordinal! long, video_pts_native_ns! long, canonical_time_ns! long, decode_status! string, width! int, height! int, effective_fps double, gap_before_ms double, quality_bits! long",
    "cv_estimates": "recording_id! string, video_stream_id! string, frame_index! long, canonical_ordinal! long, canonical_time_ns! long, keypoints array<float>, keypoint_validity array<boolean>, motion_vector array<float>, palm_orientation array<float>, hand_scale float, estimated_frequency_hz float, tracking_quality float, estimator_version! string",
    "imu_samples": "recording_id! string, stream_id! string, clock_epoch_id! string, sample_index! long, source_ordinal! long, canonical_ordinal! long, sensor_time_native_ns! long, canonical_time_ns! long, payload_kind! string, ax double, ay double, az double, gx double, gy double, gz double, qw double, qx double, qy double, qz double, validity_bits! long",
    "clock_map": "recording_id! string, stream_id! string, clock_epoch_id! string, continuity_component_id! string, acquisition_ordinal! int, source_start_ordinal! long, source_stop_ordinal! long, native_start_ns! long, native_end_ns! long, native_anchor_ns! long, canonical_anchor_ns! long, scale_numerator! long, scale_denominator! long, drift_ppm_derived! double, residual_p50_ms double, residual_p95_ms double, mapping_status! string",
    "frame_imu_index": "recording_id! string, video_stream_id! string, imu_stream_id! string, frame_index! long, frame_canonical_ordinal! long, frame_time_ns! long, frame_interval_end_ns! long, imu_start_ordinal! long, imu_stop_ordinal! long, imu_nearest_ordinal long, nearest_delta_ns long, imu_sample_count! int, imu_coverage_fraction! double, alignment_status! string",
    "window_rejections": "candidate_window_id! string, recording_id! string, video_stream_id! string, imu_stream_id! string, continuity_segment_id! string, window_policy_id! string, start_time_ns! long, end_time_ns! long, reason_bits! long, reason_codes! string",
    "window_index": "window_id! string, recording_id! string, video_stream_id! string, imu_stream_id! string, continuity_segment_id! string, window_policy_id! string, cv_estimator_version! string, start_time_ns! long, end_time_ns! long, frame_start_ordinal! long, frame_stop_ordinal! long, imu_start_ordinal! long, imu_stop_ordinal! long, frame_count! int, imu_sample_count! int, effective_video_fps! double, effective_imu_hz! double, video_coverage! double, imu_coverage! double, video_cadence_regular! boolean, imu_cadence_regular! boolean, video_max_cadence_deviation_fraction double, imu_max_cadence_deviation_fraction double, video_rate_based_nyquist_hz double, imu_rate_based_nyquist_hz double, video_observable_max_hz! double, imu_observable_max_hz! double, tremor_band_supported! boolean, cv_tracking_valid! boolean, cv_motion_range_gate_passed! boolean, imu_signal_range_gate_passed! boolean, frequency_estimation_allowed! boolean, quality_bits! long, valid_for_frequency! boolean, split_group_id! string",
}

SORT_KEYS = {
    "frame_index": ["recording_id", "video_stream_id", "canonical_ordinal"],
    "cv_estimates": ["recording_id", "video_stream_id", "canonical_ordinal"],
    "imu_samples": ["recording_id", "stream_id", "canonical_ordinal"],
    "clock_map": ["recording_id", "stream_id", "acquisition_ordinal"],
    "frame_imu_index": ["recording_id", "video_stream_id", "imu_stream_id", "frame_canonical_ordinal"],
    "window_index": ["recording_id", "video_stream_id", "imu_stream_id", "start_time_ns", "window_id"],
    "window_rejections": ["recording_id", "video_stream_id", "imu_stream_id", "start_time_ns", "candidate_window_id"],
}
#: Lengths of array columns, which Spark's types don't hold.
LENGTHS = {"keypoints": 63, "keypoint_validity": 21, "motion_vector": 3, "palm_orientation": 4}


def _schema(columns: str) -> StructType:
    out = StructType()
    for c in columns.split(", "):
        name, kind = c.split(" ")
        out.add(StructField(name.rstrip("!"), _parse_datatype_string(kind), not name.endswith("!")))
    return out


def schema(table: str) -> StructType:
    return _schema(_COLUMNS[table])


def closed(df: DataFrame, table: str) -> DataFrame:
    """df with just the table's columns, in order and of its types; a column that is missing or can't be cast is an error,
    as is a null where none is allowed."""
    want = schema(table)
    if unknown := sorted(set(df.columns) - set(want.names)):
        raise ValueError(f"{table} has no columns {unknown}")
    out = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want))
    return out.select(*((F.col(f.name) if f.nullable else F.coalesce(f.name, F.raise_error(F.lit(f"{table}.{f.name} is null")).cast(f.dataType))).alias(f.name) for f in want))


def tables() -> list[str]:
    return list(_COLUMNS)


def fingerprint(of: StructType) -> str:
    """SHA-256 of the schema's canonical JSON."""
    return hashlib.sha256(json.dumps(of.jsonValue(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
