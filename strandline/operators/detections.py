"""Detections in display pixels: right angles of display matrices, normalised landmarks, boxes, float32 tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import map_box, map_point


def rotation_degrees(matrix: Column) -> Column:
    """Counter-clockwise right angle of a display matrix of nine little-endian 16.16 integers; null for reflections,
    skews, other angles and lengths."""
    zero, one, minus = "00000000", "00000100", "0000FFFF"
    angles = {one + zero + zero + one: 0, zero + minus + one + zero: 90, minus + zero + zero + minus: 180, zero + one + minus + zero: 270}
    words = F.hex(matrix)
    known = F.create_map(*(F.lit(v) for item in angles.items() for v in item))
    return F.when(F.octet_length(matrix) == 36, F.try_element_at(known, F.concat(F.substring(words, 1, 16), F.substring(words, 25, 16))))


def to_display(points: Column, space: Column, width: Column, height: Column, to_display_: Column) -> Column:
    """Array of (x, y) in display pixels as floats: NORMALIZED points are scaled by size - 1, CODED ones mapped by the matrix, DISPLAY ones stay. A null point stays null."""

    def one(p: Column) -> Column:
        moved = F.when(space == "NORMALIZED", F.struct((p["x"] * (width - 1)).alias("x"), (p["y"] * (height - 1)).alias("y"))).when(space == "CODED", map_point(p["x"], p["y"], to_display_)).otherwise(F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
        return F.when(p.isNotNull(), F.struct(moved["x"].cast("float").alias("x"), moved["y"].cast("float").alias("y")))

    return F.transform(points, one)


def box_of(points: Column, valid: Column) -> Column:
    """Bounds of the valid points (flag true, finite); null without any."""
    kept = F.filter(points, lambda p, i: F.get(valid, i) & p.isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    at = lambda f, k: f(F.transform(kept, lambda p: p[k]))
    return F.when(F.size(kept) > 0, F.struct(at(F.array_min, "x").alias("x0"), at(F.array_min, "y").alias("y0"), at(F.array_max, "x").alias("x1"), at(F.array_max, "y").alias("y1")))


def canonical(detections: DataFrame) -> DataFrame:
    """detections (points, valid, space, width, height, matrix, box) with display_points and display_box; a missing box is that of the valid points."""
    x = detections.withColumn("display_points", to_display(F.col("points"), F.col("space"), F.col("width"), F.col("height"), F.col("matrix")))
    b = lambda k: F.col(f"box.{k}")
    w, h = F.col("width") - 1, F.col("height") - 1
    scaled = F.struct((b("x0") * w).alias("x0"), (b("y0") * h).alias("y0"), (b("x1") * w).alias("x1"), (b("y1") * h).alias("y1"))
    given = F.when(F.col("space") == "NORMALIZED", scaled).when(F.col("space") == "CODED", map_box(b("x0"), b("y0"), b("x1"), b("y1"), F.col("matrix"))).otherwise(F.struct(*(b(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1"))))
    as_float = lambda s: F.when(s.isNotNull(), F.struct(*(s[k].cast("float").alias(k) for k in ("x0", "y0", "x1", "y1"))))
    own = F.when(F.col("box").isNotNull(), given)
    return x.withColumn("display_box", F.coalesce(as_float(own), as_float(box_of(F.col("display_points"), F.col("valid")))))


def half_ulp_float(x: Column) -> Column:
    """Half the distance to the next float32 of a value's size."""
    return F.when(x == 0, F.pow(F.lit(2.0), -150)).otherwise(F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-126)) - 24))


def reconciles(normalised: Column, display: Column, size: Column) -> Column:
    """A display coordinate is its normalised one within what float32 rounding of both, and 64 double roundings, allow."""
    want = normalised.cast("double") * (size - 1)
    allowed = half_ulp_float(normalised.cast("double")) * (size - 1) + half_ulp_float(display.cast("double")) + 64 * 2.0**-52 * F.greatest(F.abs(want), F.lit(1.0))
    return F.abs(display.cast("double") - want) <= allowed


def payload_rank(detections: DataFrame, frame: list[str], payload: str) -> DataFrame:
    """detections with rank by payload bytes (unsigned) and same_payload_rank among equal ones, from 0."""
    by = Window.partitionBy(*frame).orderBy(payload)
    x = detections.withColumn("rank", F.row_number().over(by).cast("long") - 1)
    return x.withColumn("same_payload_rank", F.col("rank") - F.min("rank").over(Window.partitionBy(*frame, payload)))
