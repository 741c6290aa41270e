"""Piecewise clock maps: native device times onto the canonical timeline."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import drift_ppm, rescale

STREAM = ["recording_id", "stream_id"]
MAPPED, NO_SEGMENT, AMBIGUOUS, UNUSABLE = "MAPPED", "NO_SEGMENT", "AMBIGUOUS", "UNUSABLE"


def canonical(native: Column) -> Column:
    """Canonical time of a native time under the row's segment."""
    return rescale(native, F.col("native_anchor_ns"), F.col("canonical_anchor_ns"), F.col("scale_numerator"), F.col("scale_denominator"))


def with_bounds(clock: DataFrame) -> DataFrame:
    """clock with canonical_start_ns and canonical_end_ns (of the exclusive end)."""
    return clock.withColumn("canonical_start_ns", canonical(F.col("native_start_ns"))).withColumn("canonical_end_ns", canonical(F.col("native_end_ns")))


def map_times(rows: DataFrame, clock: DataFrame, native: str, epoch: str | None = None, source_ordinal: str | None = None, keys: list[str] = STREAM, bucket: int = 86_400_000_000_000) -> DataFrame:
    """rows with canonical_time_ns and map_status.

    With an epoch column, the epoch's segment must contain the time (and source ordinal). Without, exactly one segment
    must: none is NO_SEGMENT, several (as after a reset) AMBIGUOUS. A segment that isn't VALID gives UNUSABLE. Where
    the status isn't MAPPED the time is null; raise_on_failure makes that an error. Segments meet rows in the time
    cells they touch, so Spark joins on equality and may broadcast a small map.
    """
    parts = ["native_start_ns", "native_end_ns", "source_start_ordinal", "source_stop_ordinal", "native_anchor_ns", "canonical_anchor_ns", "scale_numerator", "scale_denominator", "mapping_status"]
    dim = clock.select(*keys, F.struct("clock_epoch_id", *parts).alias("__m"))
    x = rows.withColumn("__id", F.monotonically_increasing_id()) if epoch is None else rows
    inside = (F.col(native) >= F.col("__m.native_start_ns")) & (F.col(native) < F.col("__m.native_end_ns"))
    if source_ordinal:
        inside &= (F.col(source_ordinal) >= F.col("__m.source_start_ordinal")) & (F.col(source_ordinal) < F.col("__m.source_stop_ordinal"))
    if epoch is not None:
        met = x.withColumn("__k", F.col(epoch)).join(dim.withColumn("__k", F.col("__m.clock_epoch_id")), [*keys, "__k"], "left").drop("__k")
        met = met.withColumn("__n", F.coalesce(inside, F.lit(False)).cast("int")).withColumn("__m", F.when(F.col("__n") == 1, F.col("__m")))
    else:
        cells = dim.withColumn("__c", F.explode(F.sequence(F.floor(F.col("__m.native_start_ns") / bucket), F.floor((F.col("__m.native_end_ns") - 1) / bucket))))
        y = x.withColumn("__c", F.floor(F.col(native) / bucket)).join(cells, [*keys, "__c"], "left").withColumn("__in", F.coalesce(inside, F.lit(False)))
        met = y.groupBy("__id").agg(F.first(F.struct(*rows.columns)).alias("__r"), F.sum(F.col("__in").cast("int")).alias("__n"), F.first(F.when(F.col("__in"), F.col("__m")), True).alias("__m")).select("__r.*", "__n", "__m")
    status = F.when(F.col("__n") == 0, NO_SEGMENT).when(F.col("__n") > 1, AMBIGUOUS).when(F.col("__m.mapping_status") != "VALID", UNUSABLE).otherwise(MAPPED)
    met = met.withColumn("map_status", status)
    m = lambda c: F.col(f"__m.{c}")
    time = F.when(F.col("map_status") == MAPPED, rescale(F.col(native), m("native_anchor_ns"), m("canonical_anchor_ns"), m("scale_numerator"), m("scale_denominator")))
    return met.withColumn("canonical_time_ns", time).select(*rows.columns, "canonical_time_ns", "map_status")


def raise_on_failure(mapped: DataFrame) -> DataFrame:
    """mapped, whose reading fails at a row that could not be mapped."""
    return mapped.withColumn("canonical_time_ns", F.when(F.col("map_status") == MAPPED, F.col("canonical_time_ns")).otherwise(F.raise_error(F.concat(F.lit("clock map: "), "map_status")).cast("long")))


def violations(clock: DataFrame, keys: list[str] = STREAM, tolerance_ns: int = 1) -> DataFrame:
    """rule, keys, clock_epoch_id of every segment that breaks a rule of clock maps."""
    w = Window.partitionBy(*keys).orderBy("acquisition_ordinal", "clock_epoch_id")
    lag = lambda c: F.lag(c).over(w)
    same = lag("continuity_component_id") == F.col("continuity_component_id")
    x = with_bounds(clock.where("scale_denominator > 0")).select(
        *keys, "clock_epoch_id", "acquisition_ordinal", "continuity_component_id", "drift_ppm_derived", "scale_numerator", "scale_denominator", "residual_p50_ms", "residual_p95_ms",
        "native_start_ns", "native_end_ns", "source_start_ordinal", "source_stop_ordinal", "mapping_status",
        F.count("*").over(Window.partitionBy(*keys, "clock_epoch_id")).alias("epochs"),
        F.count("*").over(Window.partitionBy(*keys, "acquisition_ordinal")).alias("acquired"),
        (lag("source_stop_ordinal") > F.col("source_start_ordinal")).alias("overlaps"),
        (same & ((lag("source_stop_ordinal") != F.col("source_start_ordinal")) | (lag("native_end_ns") != F.col("native_start_ns")))).alias("broken"),
        (F.col("canonical_start_ns") < lag("canonical_end_ns") - tolerance_ns).alias("backward"),
        F.when(~F.coalesce(same, F.lit(False)), 1).otherwise(0).alias("fresh"),
    )
    x = x.withColumn("uses", F.sum("fresh").over(Window.partitionBy(*keys, "continuity_component_id")))
    rules = {
        "EPOCH_REPEATED": F.col("epochs") > 1,
        "ACQUISITION_ORDINAL_REPEATED": F.col("acquired") > 1,
        "SOURCE_OVERLAP": F.col("overlaps"),
        "COMPONENT_NOT_CONTIGUOUS": F.col("broken"),
        "CANONICAL_BACKWARD": F.col("backward"),
        "COMPONENT_REUSED": F.col("uses") > 1,
        "EMPTY_SEGMENT": (F.col("native_end_ns") <= F.col("native_start_ns")) | (F.col("source_stop_ordinal") <= F.col("source_start_ordinal")),
        "SCALE_NOT_POSITIVE": F.col("scale_numerator") <= 0,
        "DRIFT_NOT_DERIVED": F.abs(F.col("drift_ppm_derived") - drift_ppm(F.col("scale_numerator"), F.col("scale_denominator"))) > 1e-6,
        "RESIDUALS_UNPAIRED": F.col("residual_p50_ms").isNull() != F.col("residual_p95_ms").isNull(),
        "RESIDUALS_REVERSED": F.col("residual_p95_ms") < F.col("residual_p50_ms"),
        "STATUS_UNKNOWN": ~F.col("mapping_status").isin("VALID", "UNRESOLVED", "REJECTED"),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    out = x.select(F.explode(found).alias("rule"), *keys, "clock_epoch_id")
    zero = clock.where("scale_denominator <= 0").select(F.lit("DENOMINATOR_NOT_POSITIVE").alias("rule"), *keys, "clock_epoch_id")
    return out.union(zero)


def materialized_violations(rows: DataFrame, clock: DataFrame, native: str, epoch: str, stored: str = "canonical_time_ns", keys: list[str] = STREAM) -> DataFrame:
    """Rows whose stored canonical time is not what the map gives."""
    mapped = map_times(rows.withColumnRenamed(stored, "__stored"), clock, native, epoch, keys=keys)
    return mapped.where(~F.col("__stored").eqNullSafe(F.col("canonical_time_ns"))).select(*keys, epoch, native, "__stored", "canonical_time_ns", "map_status").withColumnRenamed("__stored", "stored_ns")
