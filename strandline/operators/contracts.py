"""Contracts between tables, authority of clocks, and provenance documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BITS, ELIGIBLE_TIERS
from . import align, validate, windows
from .frames import primary_selection
from .reconcile import differing, one_to_one

# Columns that tables of ordinals without a clock must not have.
CLOCK_COLUMNS = frozenset("canonical_time_ns clock_epoch_id sensor_time_native_ns video_pts_native_ns start_time_ns end_time_ns".split())


def eligible(tier: Column) -> Column:
    """Authority tiers that may carry canonical times."""
    return F.coalesce(tier.isin(*ELIGIBLE_TIERS), F.lit(False))


def forbid_clock_columns(df: DataFrame) -> DataFrame:
    found = sorted(CLOCK_COLUMNS & set(df.columns))
    if found:
        raise ValueError(f"an ordinal-only table has clock columns: {found}")
    return df


def frame_contract(frames: DataFrame, results: DataFrame, detections: DataFrame, selections: DataFrame, key: list[str], status: str = "inference_status") -> DataFrame:
    """rule, key of what breaks the contract of a finalized recording: one result and one selection a frame, detections
    of known frames whose number the result states and whose ranks are dense, and selections that follow from them."""
    name = F.concat_ws("/", *key).alias("key")
    out = one_to_one(frames, results, key).select(F.lit("RESULT_NOT_ONE_TO_ONE").alias("rule"), name)
    out = out.union(one_to_one(frames, selections, key).select(F.lit("SELECTION_NOT_ONE_TO_ONE"), name))
    out = out.union(detections.join(frames, key, "left_anti").select(F.lit("DETECTION_WITHOUT_FRAME"), name).distinct())
    n = results.join(detections.groupBy(*key).agg(F.count("*").alias("__n")), key, "left")
    out = out.union(n.where(F.col("detection_count") != F.coalesce("__n", F.lit(0))).select(F.lit("DETECTION_COUNT"), name))
    out = out.union(n.where((F.col(status) != "SUCCESS") & (F.coalesce("__n", F.lit(0)) > 0)).select(F.lit("DETECTIONS_OF_A_FAILURE"), name))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("rank")) - 1
    out = out.union(detections.withColumn("__r", rank).where("rank <> __r").select(F.lit("RANK_NOT_DENSE"), name).distinct())
    want = primary_selection(results.select(*key, status), detections, key, "detection_id", status).withColumnRenamed("selected", "selected_detection_id")
    have = selections.select(*want.columns)
    return out.union(differing(want, have).select(F.lit("SELECTION_NOT_DERIVED"), name).distinct())


def nearest_quality(alignment: DataFrame, samples: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, quality_bits: OR over the samples that the alignment rows of a group name as nearest."""
    s = samples.select(*keys, F.col("ordinal").alias("nearest_ordinal"), "quality_bits")
    return alignment.join(s, [*keys, "nearest_ordinal"], "left").groupBy(*by).agg(F.coalesce(F.bit_or("quality_bits"), F.lit(0)).cast("long").alias("quality_bits"))


def trim_defects(trims: DataFrame, removed: str, cycle: int = 5) -> DataFrame:
    """removed, n files, mid_cycle (the trim ends within a sensor cycle)."""
    return trims.groupBy(removed).agg(F.count("*").alias("n")).withColumn("mid_cycle", F.pmod(removed, F.lit(cycle)) != 0)


def choice_conflicts(plots: DataFrame, rows: DataFrame, overrides: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, plot, row, override values, and outcome: AGREES, OVERRIDDEN, CONFLICT, PLOT_ONLY, ROW_ONLY."""
    named = lambda df, n: df.groupBy(*key).agg(F.sort_array(F.collect_set(value)).alias(n))
    x = named(plots, "plot").join(named(rows, "row"), key, "full_outer").join(named(overrides, "override"), key, "left")
    odd = F.when(F.col("row").isNull(), "PLOT_ONLY").when(F.col("plot").isNull(), "ROW_ONLY").when(F.size(F.array_except("row", "plot")) == 0, "AGREES").when(F.size(F.array_except("row", F.coalesce("override", F.array().cast(x.schema["row"].dataType)))) == 0, "OVERRIDDEN").otherwise("CONFLICT")
    return x.withColumn("outcome", odd)


def split_at(intervals: DataFrame, points: DataFrame, keys: list[str], bucket: int = 86_400_000_000_000) -> DataFrame:
    """intervals (start, end) cut at the points (at) of their key that lie inside; pieces keep the other columns.

    Points meet intervals in the time cells they touch; each interval's cuts are gathered as one array."""
    x = intervals.where("start < end").withColumn("__id", F.struct(*intervals.columns))
    cells = x.withColumn("__c", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    p = points.select(*keys, "at").distinct().withColumn("__c", F.floor(F.col("at") / bucket))
    met = cells.join(p, [*keys, "__c"], "left").groupBy("__id").agg(F.collect_set(F.when((F.col("at") > F.col("start")) & (F.col("at") < F.col("end")), F.col("at"))).alias("__at"))
    ends = met.withColumn("__e", F.array_sort(F.array_union(F.array_union(F.array(F.col("__id.start")), "__at"), F.array(F.col("__id.end")))))
    pieces = F.transform(F.slice("__e", F.lit(1), F.size("__e") - 1), lambda a, i: F.struct(a.alias("start"), F.get("__e", i + 1).alias("end")))
    y = ends.withColumn("__p", F.explode(pieces))
    return y.select(*(F.col(f"__id.{c}") for c in intervals.columns if c not in ("start", "end")), "__p.start", "__p.end")


def alignment_differences(stored: DataFrame, frames: DataFrame, samples: DataFrame, intervals: DataFrame, keys: list[str], **settings) -> DataFrame:
    """Rows of a stored alignment that the streams don't give, and rows that they give and it lacks; see align.aligned.

    side is `a` for stored rows, `b` for regenerated ones. Coverage is compared to nine decimals."""
    plain = lambda df: df.withColumn("coverage", F.round("coverage", 9))
    fresh = plain(align.aligned(frames, samples, intervals, keys, **settings))
    return differing(plain(stored).select(*fresh.columns), fresh)


def window_differences(valid: DataFrame, ledger: DataFrame, columns: list[str], *inputs, **more) -> DataFrame:
    """Rows of a stored window index and its ledger that the streams don't give, and the other way; see windows.candidates.

    columns: those that tell a window and what is compared of valid ones; of rejected ones the reasons are compared too.
    table says which of the two differs."""
    why = ("reason_bits", "reason_codes")
    listed = lambda df, name: df.select(*columns, *(F.col(c) if name == "ledger" else F.lit(None).cast(kinds[c]).alias(c) for c in why), F.lit(name).alias("table"))
    fresh = windows.candidates(*inputs, **more)
    kinds, good = {c: fresh.schema[c].dataType for c in why}, F.col("reason_codes") == ""
    fresh = fresh.select(*columns, *(F.when(~good, F.col(c)).alias(c) for c in why), F.when(good, "index").otherwise("ledger").alias("table"))
    return differing(listed(valid, "index").unionByName(listed(ledger, "ledger")), fresh)


def segment_violations(segments: DataFrame, domain: DataFrame, intervals: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """rule, key, detail of a pair's continuity segments (keys, segment, start, end, accepted, quality_bits).

    They must cover the pair's domain (keys, from, to) without gap or overlap; an accepted one must lie inside one
    clock run (keys, stream, start, end) of each of the pair's streams; and those of a pair without any interval of common
    continuity (intervals: keys, start, end) must all be rejected, with a bit that says what is wrong with the clock."""
    out = validate.partition_of(segments.select(*keys, "start", "end"), keys, domain)
    s = segments.where("accepted").select(*keys, "segment", F.col("start").alias("time"), "end")
    streams = runs.select(*keys, "stream").distinct()
    owned = align.continuity_owner(s.join(streams, keys), runs, [*keys, "stream"])
    name = F.concat_ws("/", *keys, "segment")
    out = out.union(validate.broken(owned, name, {"OUTSIDE_A_CLOCK_RUN": F.col("continuity") != "OWNED"}, F.col("stream")))
    lost = segments.join(intervals.select(*keys).distinct(), keys, "left_anti")
    clock = F.col("quality_bits").bitwiseAND(F.lit(BITS["UNRESOLVED_CLOCK_MAP"] | BITS["SYNC_RESIDUAL_EXCEEDED"] | BITS["CLOCK_RESET"])) != 0
    return out.union(validate.broken(lost, name, {"NO_CLOCK_BUT_NOT_REJECTED": F.col("accepted") | ~clock}))


def run_counters(frames: DataFrame, results: DataFrame, detections: DataFrame, selections: DataFrame) -> DataFrame:
    """One row: what a run counts of its frames, results, detections and selections, and the references that lead nowhere.

    frames: frame_id, pts, pts_status, quality_bits; results: frame_id, detection_count, inference_status; detections:
    frame_id, detection_id; selections: frame_id, selection_status, selected_detection_id. Each id is counted on all
    sides before the sides meet, so a frequent one is one row."""
    bit = lambda n: F.count_if(F.col("quality_bits").bitwiseAND(F.lit(BITS[n])) != 0)
    status = lambda s: F.count_if(F.col("inference_status") == s)
    n = lambda c: F.count_if(c)
    one = [
        frames.agg(
            F.count("*").alias("decoded_frames"), F.count("pts").alias("frames_with_source_pts"), n(F.col("pts_status") == "VALID").alias("valid_pts_frames"), bit("MISSING_TIMESTAMP").alias("missing_pts_frames"),
            bit("DUPLICATE").alias("duplicate_pts_frames"), bit("NON_MONOTONIC").alias("nonmonotonic_pts_frames"), bit("STREAM_GAP").alias("discontinuity_pts_frames"), bit("DECODE_FAILURE").alias("decoded_corrupt_frames"),
        ),
        results.agg(
            F.count("*").alias("cv_frame_results"), n(F.col("detection_count") == 0).alias("zero_detection_frames"), n(F.col("detection_count") == 1).alias("one_detection_frames"), n(F.col("detection_count") > 1).alias("multiple_detection_frames"),
            status("DECODE_FAILURE").alias("decode_failures"), status("PREPROCESS_FAILURE").alias("preprocessing_failures"), status("INFERENCE_FAILURE").alias("inference_failures"), status("REJECTED_INPUT").alias("rejected_input_failures"),
            n(~F.col("inference_status").isin("SUCCESS", "NO_DETECTION")).alias("cv_failures"),
        ),
        selections.agg(F.count("*").alias("selection_rows"), n(F.col("selection_status") == "SELECTED").alias("selected_frames"), n(F.col("selection_status") == "ABSTAINED").alias("abstained_frames")),
    ]
    sides = {"f": frames.select(F.col("frame_id").alias("id")), "r": results.select(F.col("frame_id").alias("id")), "d": detections.select(F.col("frame_id").alias("id")), "s": selections.select(F.col("frame_id").alias("id"))}
    counted = lambda parts: reduce(DataFrame.unionByName, (df.groupBy("id").agg(F.count("*").alias("c")).withColumn("side", F.lit(k)) for k, df in parts.items())).groupBy("id").agg(*(F.coalesce(F.sum(F.when(F.col("side") == k, F.col("c"))), F.lit(0)).alias(k) for k in parts))
    total = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("long")
    missing = F.when(F.col("f") == 0, F.col("d")).otherwise(0)
    unplaced = F.when(F.col("f") == 0, F.col("s")).otherwise(0)
    one.append(counted(sides).agg(
        total(((F.col("f") > 0) & (F.col("r") == 0)).cast("int")).alias("missing_frame_results"), total(F.greatest(F.col("r") - 1, F.lit(0))).alias("duplicate_frame_results"), total(F.greatest(F.col("f") - 1, F.lit(0))).alias("duplicate_frame_ids"),
        total(missing).alias("orphan_detections"), total(unplaced).alias("selections_without_frame"),
    ))
    picked = {"d": detections.select(F.col("detection_id").alias("id")), "p": selections.where("selected_detection_id is not null").select(F.col("selected_detection_id").alias("id"))}
    one.append(counted(picked).agg(total("d").alias("total_detections"), total(F.greatest(F.col("d") - 1, F.lit(0))).alias("duplicate_detection_ids"), total(F.when(F.col("d") == 0, F.col("p")).otherwise(0)).alias("invalid_selected_detection_ids")))
    # one row each
    x = reduce(lambda a, b: a.join(b, "one"), (df.withColumn("one", F.lit(1)) for df in one)).drop("one")
    x = x.withColumn("invalid_selection_references", F.col("selections_without_frame") + F.col("invalid_selected_detection_ids"))
    return x.withColumn("foreign_key_violations", F.col("orphan_detections") + F.col("invalid_selection_references")).drop("selections_without_frame")


def poll_groups(rows: DataFrame, recording: str, kind: str, cycle: int = 5) -> DataFrame:
    """recording, raw_groups, ticks, status of rows of kinds RAW, STO and MOT: dynamic poll groups (what is left of RAW
    rows without the first cycle, in whole cycles) against dynamic rows at the nominal rate (STO without the first row).

    status: NOTHING_DYNAMIC, STO_AND_MOT_DIFFER, EQUAL, or NOT_ONE_TO_ONE, as a poll group is no tick of a clock."""
    n = lambda k: F.count_if(F.col(kind) == k)
    x = rows.groupBy(recording).agg(n("RAW").alias("raw"), n("STO").alias("sto"), n("MOT").alias("mot"))
    x = x.withColumn("raw_groups", F.greatest(F.lit(0), F.expr(f"(raw - {cycle}) div {cycle}"))).withColumn("ticks", F.greatest(F.lit(0), F.col("sto") - 1))
    status = F.when(F.col("sto") != F.col("mot"), "STO_AND_MOT_DIFFER").when((F.col("ticks") < 1) | (F.col("raw") < cycle), "NOTHING_DYNAMIC").when(F.col("raw_groups") == F.col("ticks"), "EQUAL").otherwise("NOT_ONE_TO_ONE")
    return x.select(recording, "raw_groups", "ticks", status.alias("status"))


def check_document(value, shape, at: str = "$") -> list[str]:
    """What is wrong with a provenance document: a shape is a type, a set of allowed values, [shape of items], or
    {key: shape}, whose keys are all there are; a key that ends in ? may be missing."""
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return [f"{at} is no object"]
        known = {k.rstrip("?") for k in shape}
        wrong = [f"{at}.{k} is unknown" for k in sorted(value.keys() - known)]
        for k, s in shape.items():
            if k.rstrip("?") in value:
                wrong += check_document(value[k.rstrip("?")], s, f"{at}.{k.rstrip('?')}")
            elif not k.endswith("?"):
                wrong.append(f"{at}.{k} is missing")
        return wrong
    if isinstance(shape, list):
        return [w for i, v in enumerate(value) for w in check_document(v, shape[0], f"{at}[{i}]")] if isinstance(value, list) else [f"{at} is no list"]
    if isinstance(shape, (set, frozenset)):
        return [] if value in shape else [f"{at} is none of {sorted(map(str, shape))}"]
    good = isinstance(value, shape) and not (isinstance(value, bool) and shape is not bool)
    return [] if good else [f"{at} is no {shape.__name__}"]


#: Provenance of a snapshot: sources with digests, terms, the plan of alignment and windows.
PROVENANCE = {
    "recording_id": str,
    "sources": [{"path": str, "sha256": str, "bytes": int}],
    "license": {"name": str, "redistribution": {"ALLOWED", "DERIVED_ONLY", "FORBIDDEN"}},
    "streams": [{"stream_id": str, "kind": {"VIDEO", "IMU"}, "authority": {"RAW_SHARED", "RAW_MAPPED", "SOURCE_DERIVED", "NONE"}}],
    "alignment": [{"video_stream_id": str, "imu_stream_id": str, "video_end_ns": int, "max_imu_gap_ns?": int, "min_coverage_fraction": float, "max_clock_residual_p95_ms": float}],
    "windows?": [{"policy_id": str, "window_ns": int, "hop_ns": int}],
}
