"""Which samples each frame owns, which one is nearest, and how trustworthy that is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeseries import DAY, among, locate, medians, nearest


def frame_sensor_index(frames: DataFrame, samples: DataFrame, keys: list[str], bucket: int = DAY) -> DataFrame:
    """keys, frame, time, end, start_ordinal, stop_ordinal, n_samples, nearest_ordinal, nearest_delta.

    frames: keys, frame, time, end. samples: keys, time, ordinal, where ordinal is the canonical (dense) one. A frame
    owns samples with time <= t < end; its range in ordinals is stop-exclusive and equal at both ends if empty. The
    nearest sample may lie outside the range; of equally near ones the earlier wins, then the lower ordinal.
    """
    targets = frames.select(*keys, "frame", "time", "end", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    found = nearest(locate(targets.withColumn("at", F.when(F.col("side") == 0, F.col("time")).otherwise(F.col("end"))), samples, keys, bucket=bucket))
    at_start = lambda c: F.max(F.when(F.col("side") == 0, F.col(c)))
    out = found.groupBy(*keys, "frame", "time", "end").agg(
        at_start("n_before").alias("start_ordinal"), F.max(F.when(F.col("side") == 1, F.col("n_before"))).alias("stop_ordinal"),
        at_start("nearest_ordinal").alias("nearest_ordinal"), at_start("nearest_delta").alias("nearest_delta"),
    )
    return out.withColumn("n_samples", F.col("stop_ordinal") - F.col("start_ordinal"))


def continuity_owner(frames: DataFrame, intervals: DataFrame, keys: list[str], bucket: int = DAY) -> DataFrame:
    """frames with owner_start, owner_end of the interval that contains [time, end), and continuity: OWNED,
    CONTINUITY_BOUNDARY (it only meets some) or OUTSIDE_CONTINUITY."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / bucket)))
    x = frames.withColumn("__cell", cells("time", "end"))
    y = intervals.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e")).withColumn("__cell", cells("__s", "__e"))
    met = x.join(y, [*keys, "__cell"], "left").withColumn("__hit", (F.col("__s") < F.col("end")) & (F.col("time") < F.col("__e")))
    owner = F.when((F.col("__s") <= F.col("time")) & (F.col("end") <= F.col("__e")), F.struct("__s", "__e"))
    out = met.groupBy(*frames.columns).agg(F.max(owner).alias("__o"), F.coalesce(F.bool_or("__hit"), F.lit(False)).alias("__any"))
    status = F.when(F.col("__o").isNotNull(), "OWNED").when(F.col("__any"), "CONTINUITY_BOUNDARY").otherwise("OUTSIDE_CONTINUITY")
    return out.select(*frames.columns, F.col("__o.__s").alias("owner_start"), F.col("__o.__e").alias("owner_end"), status.alias("continuity"))


def aligned(frames: DataFrame, samples: DataFrame, intervals: DataFrame, keys: list[str], min_coverage: float = 0.8, max_gap_ns: int | None = None, bucket: int = DAY) -> DataFrame:
    """The full index: ranges over the whole stream; nearest sample, period and gaps over the owning interval.

    frames: keys, frame, time, end, which don't overlap in a key; samples: keys, time, ordinal; intervals: keys, start,
    end (disjoint in a key). alignment_status, first that holds: the continuity status, NO_IMU (the frame owns no
    sample), CADENCE_UNKNOWN, DUPLICATE_TIMESTAMP (in the range, or the nearest one's time), GAP (low coverage, or a
    spacing over the limit: between samples of the range, into its first and out of its last one, as far as the other
    sample lies in the interval), OK. Streams without any interval have empty ranges at 0.
    """
    own = continuity_owner(frames.select(*keys, "frame", "time", "end"), intervals, keys, bucket)
    x = among(own, samples, keys, ["time", "end", "frame", "owner_start", "owner_end", "continuity"], bucket)
    t, prev, following = F.col("sample.t"), F.col("prev.t"), F.col("next.t")
    cell = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket)))
    span = intervals.select(*keys, "start", "end").withColumn("__cell", cell).select(*keys, "__cell", F.col("start").alias("owner_start"), F.col("end").alias("__e"))
    steps = x.where("sample is not null and prev is not null").select(*keys, t.alias("t"), prev.alias("p")).withColumn("__cell", F.floor(F.col("t") / bucket))
    steps = steps.join(span, [*keys, "__cell"]).where("p >= owner_start and t < __e")
    owner = [*keys, "owner_start"]
    period = medians(steps.select(*owner, (F.col("t") - F.col("p")).alias("d")), owner, "d", "period")
    # a frame's own row tells what is around its beginning, rows of samples up to its end what it owns
    begins, owns = F.col("sample").isNull(), F.col("sample").isNotNull() & (F.col("at") < F.col("mark.end"))
    at_start = lambda c: F.max(F.when(begins, c))
    f = x.where(F.col("mark").isNotNull() & (begins | owns)).groupBy(*keys, "mark").agg(
        at_start(F.col("n_before")).alias("start_ordinal"), at_start(F.col("prev")).alias("prev"), at_start(F.col("next")).alias("next"), F.coalesce(F.sum("sample.n"), F.lit(0)).alias("n_samples"),
        F.coalesce(F.max("sample.n") > 1, F.lit(False)).alias("repeated"), F.max(F.when(prev >= F.col("mark.time"), t - prev)).alias("inner"),
        F.min(F.when(owns, F.struct("at", prev.alias("p")))).alias("first"), F.max(F.when(owns, F.struct("at", following.alias("n")))).alias("last"),
    ).select(*keys, "mark.*", "start_ordinal", "prev", "next", "n_samples", "repeated", "inner", "first", "last")
    owned = F.col("continuity") == "OWNED"
    # the nearest sample and spacings count as far as both samples lie in the interval
    back = F.when(owned & (F.col("prev.t") >= F.col("owner_start")), F.col("time") - F.col("prev.t"))
    forth = F.when(owned & (F.col("next.t") < F.col("owner_end")), F.col("next.t") - F.col("time"))
    earlier = back.isNotNull() & (forth.isNull() | (back <= forth))
    pick = lambda a, b: F.when(earlier, a).when(forth.isNotNull(), b)
    into = F.when(F.col("first.p") >= F.col("owner_start"), F.col("first.at") - F.col("first.p"))
    out_of = F.when(F.col("last.n") < F.col("owner_end"), F.col("last.n") - F.col("last.at"))
    f = f.withColumn("nearest_ordinal", pick(F.col("prev.o"), F.col("next.o"))).withColumn("nearest_delta", pick(-back, forth)).withColumn("near_repeated", F.coalesce(pick(F.col("prev.n"), F.col("next.n")) > 1, F.lit(False)))
    f = f.withColumn("widest", F.greatest("inner", into, out_of)).join(period, owner, "left")
    expected = F.greatest(F.lit(1.0), F.floor((F.col("end") - F.col("time")) / F.col("period") + 1e-9))
    f = f.withColumn("coverage", F.when(F.col("period").isNull() | ~owned, 0.0).otherwise(F.least(F.lit(1.0), F.col("n_samples") / expected)))
    limit = F.lit(max_gap_ns).cast("long") if max_gap_ns is not None else F.greatest(F.lit(1), F.rint(F.col("period") * 2.5).cast("long"))
    status = (
        F.when(~owned, F.col("continuity"))
        .when(F.col("n_samples") == 0, "NO_IMU")
        .when(F.col("period").isNull(), "CADENCE_UNKNOWN")
        .when(F.col("repeated") | F.col("near_repeated"), "DUPLICATE_TIMESTAMP")
        .when(F.coalesce(F.col("widest") > limit, F.lit(False)) | (F.col("coverage") < min_coverage), "GAP")
        .otherwise("OK")
    )
    none = intervals.select(*keys).distinct().withColumn("__some", F.lit(True))
    f = f.withColumn("stop_ordinal", F.col("start_ordinal") + F.col("n_samples")).join(none, keys, "left")
    zero = lambda c: F.when(F.col("__some"), F.col(c)).otherwise(0).cast("long").alias(c)
    return f.select(*keys, "frame", "time", "end", zero("start_ordinal"), zero("stop_ordinal"), zero("n_samples"), "nearest_ordinal", "nearest_delta", "coverage", status.alias("alignment_status"))
