"""Decoded frames and detections: timestamp status, presentation order, ranks, selection, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BITS, INFERENCE_STATUSES
from .timeseries import neighbours


#: Decode ordinals that are ordered together where a stream is cut.
ORDINALS = 65_536


def classify(frames: DataFrame, keys: list[str], pts: str = "pts", decoded: str = "decode_ordinal", gap: int = 1_000_000_000, bucket: int | None = None) -> DataFrame:
    """frames with same_pts_rank, presentation_ordinal, gap_before, quality_bits, pts_status.

    Order within keys: decode order for reversals, (pts, same_pts_rank) for presentation; frames without pts have no
    place there. Bits may combine; the status is the first of MISSING, DUPLICATE, NON_MONOTONIC, DISCONTINUITY, VALID.

    With a bucket, a width in the units of pts, a stream is ordered in buckets of pts and of ORDINALS decode ordinals, so a long one is the work
    of many tasks; without, it is one task's.
    """
    if bucket is not None:
        return _flagged(_placed(frames, keys, pts, decoded, bucket), pts, gap)
    same = Window.partitionBy(*keys, pts).orderBy(decoded)
    shown = Window.partitionBy(*keys).orderBy(F.col(pts).asc_nulls_last(), decoded)
    before = Window.partitionBy(*keys).orderBy(decoded).rowsBetween(Window.unboundedPreceding, -1)
    present = F.col(pts).isNotNull()
    x = frames.withColumn("same_pts_rank", F.when(present, F.row_number().over(same) - 1).cast("long"))
    x = x.withColumn("presentation_ordinal", F.when(present, F.row_number().over(shown) - 1).cast("long"))
    x = x.withColumn("gap_before", F.when(present, F.col(pts) - F.lag(pts).over(shown)))
    x = x.withColumn("__twice", present & (F.count("*").over(Window.partitionBy(*keys, pts)) > 1)).withColumn("__back", F.coalesce(F.col(pts) < F.last(pts, True).over(before), F.lit(False)))
    return _flagged(x, pts, gap)


def _placed(frames: DataFrame, keys: list[str], pts: str, decoded: str, bucket: int) -> DataFrame:
    """frames with what classify derives from their order, ordered once in buckets of decode ordinals and once in buckets of pts; a table of one row a
    bucket tells what lies before it. Frames of one time lie in one bucket, next to each other."""
    timed = frames.where(F.col(pts).isNotNull())
    cell = F.floor(F.col(pts) / bucket)
    x = neighbours(timed, keys, [decoded], [pts], ORDINALS).withColumn("__back", F.coalesce(F.col("prev_row")[pts] > F.col(pts), F.lit(False))).drop("prev_row", "next_row").withColumn("__b", cell)
    ends = timed.groupBy(*keys, cell.alias("__b")).agg(F.count("*").alias("__n"), F.max(pts).alias("__last"))
    over = Window.partitionBy(*keys).orderBy("__b")
    ends = ends.select(*keys, "__b", F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.lag("__last").over(over).alias("__earlier"))
    shown, same = Window.partitionBy(*keys, "__b").orderBy(pts, decoded), Window.partitionBy(*keys, "__b", pts).orderBy(decoded)
    x = x.select("*", F.row_number().over(shown).alias("__k"), F.lag(pts).over(shown).alias("__p"), F.lead(pts).over(shown).alias("__f"), (F.row_number().over(same) - 1).cast("long").alias("same_pts_rank")).join(ends, [*keys, "__b"])
    x = x.withColumn("presentation_ordinal", (F.col("__base") + F.col("__k") - 1).cast("long")).withColumn("gap_before", F.col(pts) - F.coalesce("__p", "__earlier"))
    x = x.withColumn("__twice", F.coalesce(F.col("__p") == F.col(pts), F.lit(False)) | F.coalesce(F.col("__f") == F.col(pts), F.lit(False)))
    none = {"same_pts_rank": "long", "presentation_ordinal": "long", "gap_before": x.schema["gap_before"].dataType, "__twice": "boolean", "__back": "boolean"}
    missing = frames.where(F.col(pts).isNull()).select(*frames.columns, *(F.lit(False if c.startswith("__") else None).cast(t).alias(c) for c, t in none.items()))
    return x.select(*frames.columns, *none).unionByName(missing)


def _flagged(x: DataFrame, pts: str, gap: int) -> DataFrame:
    """x with quality_bits and pts_status from __twice, __back and gap_before, which stays."""
    present = F.col(pts).isNotNull()
    jump = F.coalesce(F.col("gap_before") > gap, F.lit(False))
    bit = lambda c, name: F.when(c, BITS[name]).otherwise(0)
    bits = bit(~present, "MISSING_TIMESTAMP").bitwiseOR(bit(F.col("__twice"), "DUPLICATE")).bitwiseOR(bit(F.col("__back"), "NON_MONOTONIC")).bitwiseOR(bit(jump, "STREAM_GAP"))
    status = F.when(~present, "MISSING").when(F.col("__twice"), "DUPLICATE").when(F.col("__back"), "NON_MONOTONIC").when(jump, "DISCONTINUITY").otherwise("VALID")
    return x.withColumn("quality_bits", bits.cast("long")).withColumn("pts_status", status).drop("__twice", "__back")


def rates(frames: DataFrame, keys: list[str], time: str, order: list[str], epoch: str | None = None, end: Column | None = None, bucket: int | None = None) -> DataFrame:
    """frames with effective_fps and gap_before_ms.

    The rate comes from the first difference there is: to the next frame if that is of the same epoch; for the last
    frame of a stream, to `end` if one is given; from the frame before if that is of the same epoch. It is null if that
    difference isn't positive. The gap is that to the frame before, whatever its epoch."""
    x = neighbours(frames, keys, order, [time, *([epoch] if epoch else [])], bucket)
    near = lambda row: row.isNotNull() & (row[epoch].eqNullSafe(F.col(epoch)) if epoch else F.lit(True))
    prev, following = F.col("prev_row"), F.col("next_row")
    step = F.when(near(following), following[time] - F.col(time))
    if end is not None:
        step = step.when(following.isNull(), end - F.col(time))
    step = step.when(near(prev), F.col(time) - prev[time])
    x = x.withColumn("__step", step)
    return x.withColumn("effective_fps", F.when(F.col("__step") > 0, 1e9 / F.col("__step"))).withColumn("gap_before_ms", (F.col(time) - prev[time]) / 1e6).drop("prev_row", "next_row", "__step")


def detection_rank(detections: DataFrame, frame: list[str], score: str, digest: str) -> DataFrame:
    """detections with rank (by falling score, then digest) and same_payload_rank among equal ones, both from 0."""
    by = Window.partitionBy(*frame).orderBy(F.col(score).desc(), digest)
    same = Window.partitionBy(*frame, score, digest).orderBy(F.lit(0))
    return detections.withColumn("rank", F.row_number().over(by).cast("long") - 1).withColumn("same_payload_rank", F.row_number().over(same).cast("long") - 1)


def primary_selection(frames: DataFrame, detections: DataFrame, frame: list[str], detection: str, status: str | None = None) -> DataFrame:
    """frame, selection_status, selection_reason, selected of every frame: SELECTED if it has one detection, else
    ABSTAINED. Where inference gave neither SUCCESS nor NO_DETECTION, its status is the reason."""
    n = detections.groupBy(*frame).agg(F.count("*").alias("n"), F.min(detection).alias("one"))
    x = frames.join(n, frame, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    failed = ~F.col(status).isin("SUCCESS", "NO_DETECTION") if status else F.lit(False)
    reason = F.when(failed, F.concat(F.lit("INFERENCE_STATUS_"), F.col(status)) if status else F.lit(None)).when(F.col("n") == 0, "NO_DETECTIONS").when(F.col("n") > 1, "MULTIPLE_DETECTIONS").otherwise("SINGLE_DETECTION")
    x = x.withColumn("selection_reason", reason)
    one = F.col("selection_reason") == "SINGLE_DETECTION"
    return x.select(*frame, F.when(one, "SELECTED").otherwise("ABSTAINED").alias("selection_status"), "selection_reason", F.when(one, F.col("one")).alias("selected"))


def selection_violations(results: DataFrame, detections: DataFrame, frame: list[str], status: str = "inference_status") -> DataFrame:
    """rule, key: inference statuses that no selection may rest on. SUCCESS needs a detection, other statuses forbid them."""
    n = detections.groupBy(*frame).agg(F.count("*").alias("n"))
    x = results.join(n, frame, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    known = F.coalesce(F.col(status).isin(*INFERENCE_STATUSES), F.lit(False))
    rule = F.when(~known, "STATUS_UNKNOWN").when((F.col(status) == "SUCCESS") & (F.col("n") == 0), "SUCCESS_WITHOUT_DETECTION").when((F.col(status) != "SUCCESS") & (F.col("n") > 0), "DETECTIONS_OF_A_FAILURE")
    return x.withColumn("rule", rule).where("rule is not null").select("rule", F.concat_ws("/", *frame).alias("key"))


def display_transform(width: Column, height: Column, degrees: Column) -> Column:
    """Row-major 3x3 matrix from coded to displayed pixels for a counter-clockwise right angle; null for other angles."""
    w, h = (width - 1).cast("double"), (height - 1).cast("double")
    row = lambda *v: F.array(*(F.lit(float(x)) if isinstance(x, int) else x for x in v))
    return (
        F.when(degrees == 0, row(1, 0, 0, 0, 1, 0, 0, 0, 1))
        .when(degrees == 90, row(0, 1, 0, -1, 0, w, 0, 0, 1))
        .when(degrees == 180, row(-1, 0, w, 0, -1, h, 0, 0, 1))
        .when(degrees == 270, row(0, -1, h, 1, 0, 0, 0, 0, 1))
    )


def display_size(width: Column, height: Column, degrees: Column) -> Column:
    turned = degrees.isin(90, 270)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def map_point(x: Column, y: Column, m: Column) -> Column:
    """Homogeneous map of a point; null where it goes to infinity."""
    at = lambda i: F.get(m, F.lit(i))
    w = at(6) * x + at(7) * y + at(8)
    return F.when(F.abs(w) > 1e-12, F.struct(((at(0) * x + at(1) * y + at(2)) / w).alias("x"), ((at(3) * x + at(4) * y + at(5)) / w).alias("y")))


def compose(a: Column, b: Column) -> Column:
    """Matrix of a, then b."""
    at = lambda m, i: F.get(m, F.lit(i))
    return F.array(*(sum((at(b, 3 * i + k) * at(a, 3 * k + j) for k in (1, 2)), at(b, 3 * i) * at(a, j)) for i in range(3) for j in range(3)))


def invert(m: Column) -> Column:
    """Inverse by the adjugate; null where the determinant is within 1e-12 of 0."""
    a, b, c, d, e, f, g, h, i = (F.get(m, F.lit(k)) for k in range(9))
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    cofactors = (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)
    return F.when(F.abs(det) > 1e-12, F.array(*(x / det for x in cofactors)))


def to_pixels(x: Column, size: Column) -> Column:
    """A normalised coordinate in pixels, not clipped."""
    return x * (size - 1)


def map_box(x0: Column, y0: Column, x1: Column, y1: Column, m: Column) -> Column:
    """Bounds of a mapped box."""
    corners = [map_point(a, b, m) for a in (x0, x1) for b in (y0, y1)]
    pick = lambda f, k: f(*(c[k] for c in corners))
    return F.struct(pick(F.least, "x").alias("x0"), pick(F.least, "y").alias("y0"), pick(F.greatest, "x").alias("x1"), pick(F.greatest, "y").alias("y1"))


def valid_fraction(flags: Column) -> Column:
    """Share of true flags; 0 if null or empty."""
    return F.when(F.size(F.coalesce(flags, F.array().cast("array<boolean>"))) > 0, F.size(F.filter(flags, lambda x: x)) / F.size(flags)).otherwise(0.0)
