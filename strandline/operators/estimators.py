"""Estimators over frames, as a table function: a stream is a partition, and each has an estimator of its own.

An estimator gets the frames of one stream in order and may keep what it learns from them (tracking); it states where it comes
from. What it raises for a frame is that frame's status, not the job's end: the next frame is given to it all the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row, StructType

from ..sources.files import ship

SUCCESS, REJECTED_INPUT, PREPROCESSING_FAILURE, INFERENCE_FAILURE, INVALID_OUTPUT = "SUCCESS", "REJECTED_INPUT", "PREPROCESSING_FAILURE", "INFERENCE_FAILURE", "INVALID_OUTPUT"


@dataclass(frozen=True)
class Provenance:
    """What stands beside every result: which model, with which weights and preprocessing, ran in which environment."""

    model_id: str
    weights_sha256: str
    preprocessing_sha256: str
    environment_id: str


@dataclass(frozen=True)
class Detection:
    """Values (points, boxes, scores) that an estimator found; scores may be missing, other values must be finite."""

    values: tuple[float, ...]
    score: float | None = None


@dataclass(frozen=True)
class Estimate:
    detections: tuple[Detection, ...] = ()
    tracking_quality: float | None = None


class Rejected(Exception):
    """An estimator's word for a frame that it doesn't take."""


class Estimator(Protocol):
    provenance: Provenance

    def prepare(self, frame: Row) -> Any: ...

    def infer(self, prepared: Any) -> Estimate: ...


_RESULT = "n_detections int, detections array<struct<values: array<double>, score: double>>, tracking_quality double, status string, reason string, model_id string, weights_sha256 string, preprocessing_sha256 string, environment_id string"


def _checked(found: Estimate) -> None:
    scores = [d.score for d in found.detections if d.score is not None] + ([found.tracking_quality] if found.tracking_quality is not None else [])
    if any(not 0 <= s <= 1 for s in scores) or any(not math.isfinite(v) for d in found.detections for v in d.values):
        raise ValueError("a score outside 0 to 1, or a value that isn't finite")


@dataclass
class _Run:
    """An estimator over the frames of a partition."""

    make: Callable[[], Estimator]
    estimator: Estimator | None = field(default=None)

    def result(self, frame: Row) -> tuple:
        self.estimator = self.estimator or self.make()
        p, found, status, reason = self.estimator.provenance, Estimate(), SUCCESS, None
        step = PREPROCESSING_FAILURE
        try:
            prepared = self.estimator.prepare(frame)
            step = INFERENCE_FAILURE
            made = self.estimator.infer(prepared)
            step = INVALID_OUTPUT
            _checked(made)
            found = made
        except Rejected as why:
            status, reason = REJECTED_INPUT, str(why)
        except Exception as why:  # whatever it is, it is this frame's
            status, reason = step, f"{type(why).__name__}: {why}"
        detections = [(list(map(float, d.values)), d.score) for d in found.detections]
        return len(detections), detections, found.tracking_quality, status, reason, p.model_id, p.weights_sha256, p.preprocessing_sha256, p.environment_id


def estimated(frames: DataFrame, make: Callable[[], Estimator], by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """keep (columns of frames), n_detections, detections, tracking_quality, status, reason and the provenance of every frame.

    Frames are given to an estimator in `order` within each value of `by`; make() gives a fresh one for each. A stream's frames
    are one task's work, one at a time. Statuses: SUCCESS, REJECTED_INPUT, PREPROCESSING_FAILURE, INFERENCE_FAILURE, INVALID_OUTPUT (a
    value that isn't finite, or a score outside 0 to 1), of which all but the first have no detections. A frame with a null in `by`
    belongs to the stream without a name."""
    ship(frames.sparkSession)
    schema = StructType([frames.schema[c] for c in keep] + StructType.fromDDL(_RESULT).fields)

    class Estimation:
        def __init__(self):
            self.run = _Run(make)

        def eval(self, frame: Row):
            yield (*(frame[c] for c in keep), *self.run.result(frame))

    table = frames.asTable().partitionBy(*by).orderBy(*order)
    return F.udtf(Estimation, returnType=schema)(table)
