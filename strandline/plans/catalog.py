"""The registered queries and their SQL counterparts: a function and a constant of its name in capitals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bundles, frames_sensors, ingest, relational, stored

_FUNCTIONS = [
    frames_sensors.frame_sensor_index,
    frames_sensors.owned_interval_fps,
    frames_sensors.canonical_ordinals,
    frames_sensors.cadence_median_gap,
    frames_sensors.continuity_islands,
    frames_sensors.interval_intersection,
    frames_sensors.interval_split,
    frames_sensors.hop_window_index,
    frames_sensors.hop_window_rejections,
    frames_sensors.hop_window_gates,
    frames_sensors.alignment_status,
    frames_sensors.window_quality_or,
    frames_sensors.window_range_gate,
    frames_sensors.held_runs,
    frames_sensors.held_fraction_summary,
    frames_sensors.window_replay,
    frames_sensors.nearest_context,
    *relational.FUNCTIONS,
    *ingest.FUNCTIONS,
    *stored.FUNCTIONS,
    *bundles.FUNCTIONS,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    found = vars(frames_sensors) | vars(relational) | vars(ingest) | vars(stored) | vars(bundles)
    return {f.__name__: found[f.__name__.upper()] for f in _FUNCTIONS if f.__name__.upper() in found}
