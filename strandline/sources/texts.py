"""Text sources: numbered lines, sensor logs, pose tables, trim instructions, file inventories."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..schemas import BITS
from .ranges import file_ranges

# Order of sensors in a cycle, for lower-body (activities 1-4) and upper-body (5-13) recordings.
LOWER = ["qsHIPS", "qsRUL", "qsRLL", "qsLUL", "qsLLL"]
UPPER = ["qsBACK", "qsRUA", "qsRLA", "qsLUA", "qsLLA"]
JOINTS, UNIT_TOLERANCE = 34, 1e-3


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_number (from 0), line of every line; \\r\\n and \\n end lines. A file without bytes has one empty line.

    A large file is the work of many tasks: Spark reads it in blocks, lines are counted in each, and a table of one row a
    block tells how many precede it."""
    read = spark.read.option("recursiveFileLookup", "true")
    x = read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"), F.regexp_replace("value", "\r$", "").alias("line"))
    x = x.withColumn("__k", F.row_number().over(Window.partitionBy("path", "__b").orderBy("__i")))
    before = F.sum("__n").over(Window.partitionBy("path").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = x.groupBy("path", "__b").agg(F.count("*").alias("__n")).select("path", "__b", F.coalesce(before, F.lit(0)).alias("__base"))
    numbered = x.join(blocks, ["path", "__b"]).select("path", (F.col("__base") + F.col("__k") - 1).cast("long").alias("line_number"), "line")
    none = read.format("binaryFile").load(path).where("length = 0").select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.lit(0).cast("long"), F.lit(""))
    return numbered.union(none)


def time_key(token: Column) -> Column:
    """Exact order of a plain decimal with at most nine fraction digits, in billionths; null if it isn't one."""
    plain = token.rlike(r"^\d{1,22}(\.\d{1,9})?$") & (F.length(token) <= 32)
    parts = F.split(token, r"\.")
    return F.when(plain, F.concat(F.get(parts, F.lit(0)), F.rpad(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 9, "0")).cast("decimal(31,0)"))


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Struct of four doubles, or null if one isn't a finite number or the norm is off 1 by more than 1e-3."""
    v = [c.try_cast("double") for c in (w, x, y, z)]
    norm = F.sqrt(sum((c * c for c in v[1:]), v[0] * v[0]))
    return F.when(F.abs(norm - 1) <= UNIT_TOLERANCE, F.struct(*(c.alias(n) for c, n in zip(v, ("qw", "qx", "qy", "qz"), strict=True))))


def sensor_log(rows: DataFrame) -> DataFrame:
    """Rows of sensor logs from lines (path, line_number, line, activity): five calibration rows, then cycles of five.

    Columns: path, sensor_label, source_epoch_kind, sample_index (of the sensor), source_ordinal, source_line_number,
    source_timestamp_token, qw, qx, qy, qz, source_quality_bits. A quaternion that isn't one is null and flagged, equal
    timestamps that follow each other in a sensor are flagged on both rows; neither row is dropped.
    """
    x = rows.where("line_number > 0").withColumn("f", F.split("line", ",")).withColumn("source_ordinal", F.col("line_number").cast("long") - 1)
    at = lambda i: F.get("f", F.lit(i))
    layout = F.when(F.col("activity") <= 4, F.array(*map(F.lit, LOWER))).otherwise(F.array(*map(F.lit, UPPER)))
    x = x.withColumn("sensor_label", F.get(layout, F.pmod("source_ordinal", F.lit(5)).cast("int"))).withColumn("source_epoch_kind", F.when(F.col("source_ordinal") < 5, "NPOSE_CALIBRATION").otherwise("DYNAMIC_OBSERVATION"))
    x = x.withColumn("q", quaternion(at(1), at(2), at(3), at(4))).withColumn("source_timestamp_token", at(5)).withColumn("t", time_key(at(5)))
    w = Window.partitionBy("path", "sensor_label", "source_epoch_kind").orderBy("source_ordinal")
    twice = (F.lag("t").over(w) == F.col("t")) | (F.lead("t").over(w) == F.col("t"))
    bits = F.when(F.coalesce(twice, F.lit(False)), BITS["DUPLICATE"]).otherwise(0).bitwiseOR(F.when(F.col("q").isNull(), BITS["INVALID_IMU_PAYLOAD"]).otherwise(0))
    return x.select("path", "sensor_label", "source_epoch_kind", F.floor(F.col("source_ordinal") / 5).alias("sample_index"), "source_ordinal", (F.col("line_number") + 1).cast("long").alias("source_line_number"), "source_timestamp_token", "q.*", bits.cast("long").alias("source_quality_bits"))


def sensor_log_violations(rows: DataFrame) -> DataFrame:
    """rule, path, line_number: header, field count, tag, incomplete last cycle, timestamps that are no decimals, run back, or precede calibration."""
    f = rows.withColumn("f", F.split("line", ",")).withColumn("t", time_key(F.get("f", F.lit(5)))).withColumn("o", F.col("line_number") - 1)
    w = Window.partitionBy("path", F.pmod("o", F.lit(5))).orderBy("line_number")
    # one row a file
    last = rows.groupBy("path").agg(F.max("line_number").alias("n")).where(F.pmod("n", F.lit(5)) != 0).select(F.lit("CYCLE_INCOMPLETE").alias("rule"), "path", F.col("n").alias("line_number"))
    body = f.where("line_number > 0").withColumn("back", F.lag("t").over(w) > F.col("t"))
    start = body.where("o < 5").groupBy("path").agg(F.count_distinct("t").alias("times"), F.max("t").alias("calibrated"))
    found = {"FIELDS": F.size("f") != 6, "TAG": F.get("f", F.lit(0)) != "QUAT", "TIMESTAMP": F.col("t").isNull(), "TIME_REVERSED": F.col("back"), "BEFORE_CALIBRATION": (F.col("o") >= 5) & (F.col("t") <= F.col("calibrated"))}
    rules = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in found.items())), lambda r: r.isNotNull())
    out = body.join(start, "path").select(F.explode(rules).alias("rule"), "path", "line_number")
    out = out.union(start.where("times <> 1").select(F.lit("CALIBRATION_TIMES"), "path", F.lit(1)))
    return out.union(last).union(rows.where((F.col("line_number") == 0) & (F.col("line") != "QUAT,w,x,y,z,timestamp")).select(F.lit("HEADER"), "path", "line_number"))


def pose_table(rows: DataFrame) -> DataFrame:
    """path, source_row_ordinal, positions_mm (102), zero_triplet_mask (34) from lines of pose tables, without the header.

    A value that is no number is null here; pose_violations tells which rows aren't as they should be."""
    x = rows.where("line_number > 0").withColumn("positions_mm", F.transform(F.split("line", ","), lambda v: v.try_cast("double")))
    zero = F.transform(F.sequence(F.lit(0), F.lit(JOINTS - 1)), lambda i: F.forall(F.slice("positions_mm", 3 * i + 1, 3), lambda v: v == 0))
    return x.select("path", (F.col("line_number") - 1).cast("long").alias("source_row_ordinal"), "positions_mm", zero.alias("zero_triplet_mask"))


def pose_violations(rows: DataFrame, header: str | None = None) -> DataFrame:
    """rule, path, line_number: another header than the given one, not 102 values, white space or nothing where a value
    should be, no number, no finite number."""
    f = rows.withColumn("f", F.split("line", ",")).withColumn("v", F.transform("f", lambda t: t.try_cast("double")))
    blank = F.exists("f", lambda t: t.rlike(r"^\s|\s$|^$"))
    rules = {
        "VALUES": F.size("f") != 3 * JOINTS, "WHITE_SPACE": blank, "NO_NUMBER": ~blank & F.exists("v", lambda v: v.isNull()),
        "NOT_FINITE": F.exists("v", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    out = f.where("line_number > 0").select(F.explode(found).alias("rule"), "path", "line_number")
    if header is not None:
        out = out.union(rows.where((F.col("line_number") == 0) & (F.col("line") != header)).select(F.lit("HEADER"), "path", "line_number"))
    return out


#: How a recording is written: subject, activity 01-13, trial.
RECORDING = r"S\d{2}_A(?:0[1-9]|1[0-3])_T\d{2}"


def instructions(rows: DataFrame) -> DataFrame:
    """Trim instructions from lines (path, line_number, line): recording_id, subject, activity, trial, file, type, cut_frames, rmse values, row_sha256 (of the line with \\r\\n), problem (null if there is none).

    Fields count as they are, with no white space taken off. problem is the first of: WIDTH (not eight fields),
    IDENTITY (no recording, or an unknown type), FILE (another name than the recording's of that type), NUMBERS,
    RANGE (a cut of other than 1 to 14 frames), REPEATED (a recording's type twice)."""
    f = F.split("line", ",")
    at = lambda i: F.get(f, F.lit(i))
    x = rows.where("line_number > 0").select(
        "path", "line_number", F.concat_ws("_", at(0), at(1), at(2)).alias("recording_id"), at(0).alias("subject"), at(1).alias("activity"), at(2).alias("trial"), at(3).alias("file"), at(4).alias("type"),
        F.when(at(5).rlike(r"^[+-]?\d{1,9}$"), at(5).try_cast("int")).alias("cut_frames"), at(6).try_cast("double").alias("original_rmse"), at(7).try_cast("double").alias("theoretical_rmse"),
        F.sha2(F.concat("line", F.lit("\r\n")), 256).alias("row_sha256"), (F.size(f) != 8).alias("__width"),
    )
    n = F.count("*").over(Window.partitionBy("path", "recording_id", "type"))
    name = F.element_at(F.split("file", r"[\\/]"), -1)
    should = F.concat(F.when(F.col("type") == "mot", "ik_").otherwise(""), "recording_id", F.lit("."), "type")
    problem = (
        F.when(F.col("__width"), "WIDTH")
        .when(~F.col("recording_id").rlike(f"^{RECORDING}$") | ~F.col("type").isin("csv", "mot", "mp4", "raw"), "IDENTITY")
        .when(name != should, "FILE")
        .when(F.col("cut_frames").isNull() | F.col("original_rmse").isNull() | F.col("theoretical_rmse").isNull(), "NUMBERS")
        .when(~F.col("cut_frames").between(1, 14), "RANGE")
        .when(n > 1, "REPEATED")
    )
    return x.withColumn("problem", problem).drop("__width")


def choices(texts: DataFrame, activity: str | None = None, text: str = "text") -> DataFrame:
    """texts with each choice that a plot states: recording, rmse (two decimals), imu_cut, video_cut, direction, problem.

    A choice is a comment that names a recording's angle file, and the next comment SHIFTED with the error and both
    cuts. direction is IMU or VIDEO by the cut that isn't zero, else ZERO. problem: BOTH_CUT, RANGE (over 14),
    ACTIVITY (another one than the column `activity` says), REPEATED (a recording chosen twice), else null."""
    whole = rf"(?s)(<!-- {RECORDING}\.mot \(Angle: [^)]*\) -->.*?<!-- SHIFTED, RMSE: [0-9]+\.[0-9]{{2}}  \(cut imu:[0-9]+, cut vid:[0-9]+\) -->)"
    x = texts.withColumn("__c", F.explode(F.regexp_extract_all(text, F.lit(whole), F.lit(1))))
    shifted = lambda part: F.regexp_extract("__c", rf"(?s)^.*<!-- SHIFTED, RMSE: ([0-9]+\.[0-9]{{2}})  \(cut imu:([0-9]+), cut vid:([0-9]+)\) -->$", part)
    x = x.withColumn("recording", F.regexp_extract("__c", f"^<!-- ({RECORDING})", 1)).withColumn("rmse", shifted(1)).withColumn("imu_cut", shifted(2).cast("int")).withColumn("video_cut", shifted(3).cast("int")).drop("__c")
    x = x.withColumn("direction", F.when(F.col("imu_cut") > 0, "IMU").when(F.col("video_cut") > 0, "VIDEO").otherwise("ZERO"))
    problem = F.when((F.col("imu_cut") > 0) & (F.col("video_cut") > 0), "BOTH_CUT").when(F.greatest("imu_cut", "video_cut") > 14, "RANGE")
    if activity is not None:
        problem = problem.when(F.get(F.split("recording", "_"), F.lit(1)) != F.col(activity), "ACTIVITY")
    return x.withColumn("problem", problem.when(F.count("*").over(Window.partitionBy("recording")) > 1, "REPEATED"))


def utc_time(text: Column) -> Column:
    """The instant of an RFC 3339 time that ends in Z, which must exist in the calendar; null for any other text."""
    form = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z\z") & ~text.rlike(r"T\d{2}:\d{2}:60") & ~text.rlike(r"T24")
    return F.when(form, F.try_to_timestamp(F.concat(F.substring(text, 1, 19), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, length, extension, recording (S<n>_A<n>_T<n> in the name), sha256 of every file under root, however long it is."""
    files = file_ranges(spark, root, 0)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.nullif(F.regexp_extract(name, r"(S\d+_A\d+_T\d+)", 1), F.lit("")).alias("recording"), "sha256")


def file_classes(files: DataFrame, known: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """files (path below the data folder) with recording, class, reason.

    class: POSE, RAW, VIDEO (the slots of a recording, in its subject's folder), KNOWN (a path of `known`, which gives
    its recording and reason), COMPANION (files that go with a recording but aren't read: calibration poses, inverse
    kinematics, orientation errors, merged storage, output of full-size videos), MISPLACED (one of these outside its
    subject's folder), UNEXPECTED. Names of slots and calibration poses count in any case, their recording in upper case;
    other companions and all extensions are as they are written. Numbers have one digit or more."""
    # What stands around a recording's name in slots and companions, in any case and as it is written.
    slots = {".csv": "POSE", ".raw": "RAW", "_pose.mp4": "VIDEO"}
    calibration = {"_npose.csv": "NPOSE_CALIBRATION", "_npose_pose.mp4": "NPOSE_CALIBRATION"}
    companions = {"ik_.mot": "INVERSE_KINEMATICS", "ik__orientationErrors.sto": "ORIENTATION_ERRORS", ".sto": "MERGED_STORAGE", ".mot": "PLAIN_KINEMATICS", ".mp4.out": "FULL_SIZE_OUTPUT", "_Npose.mp4.out": "FULL_SIZE_OUTPUT"}
    # The recordings that have plain kinematics.
    plain = "S48_A01_T01 S48_A02_T02 S48_A03_T02 S48_A04_T01 S48_A05_T02 S48_A06_T02 S48_A07_T02 S48_A08_T01 S48_A09_T01 S48_A10_T02 S48_A11_T02 S48_A12_T02 S48_A13_T02".split()
    table = lambda d: F.create_map(*(F.lit(v) for item in d.items() for v in item))
    parts = F.split("path", "/")
    part = lambda k: F.regexp_extract(F.element_at(parts, -1), r"^(ik_)?((?i:S\d+_A\d+_T\d+))([_.].*)$", k)
    written = part(2)
    # an extension is as it is written; what precedes it counts in any case for slots and calibration
    loose = F.concat(part(1), F.lower(F.regexp_extract(part(3), r"^(.*?)(\.[^.]*)?$", 1)), F.regexp_extract(part(3), r"(\.[^.]*)$", 1))
    strict = F.when(written == F.upper(written), F.concat(part(1), part(3)))
    x = files.withColumn("__p", F.struct(F.upper(written).alias("recording"), loose.alias("loose"), F.when((strict != ".mot") | written.isin(plain), strict).alias("form"), F.size(parts).alias("depth"), F.get(parts, F.lit(0)).alias("folder")))
    pinned = F.try_element_at(table({p: f"{r}\n{why}" for p, (r, why) in known.items()}), F.col("path")) if known else F.lit(None).cast("string")
    why = F.coalesce(F.try_element_at(table(calibration), F.col("__p.loose")), F.try_element_at(table(companions), F.col("__p.form")))
    x = x.withColumn("__f", F.struct(pinned.alias("pinned"), F.try_element_at(table(slots), F.col("__p.loose")).alias("slot"), why.alias("why")))
    named = F.col("__f.slot").isNotNull() | F.col("__f.why").isNotNull()
    placed = (F.col("__p.depth") == 2) & (F.col("__p.folder") == F.substring_index("__p.recording", "_", 1))
    kind = F.when(F.col("__f.pinned").isNotNull(), "KNOWN").when(~named, "UNEXPECTED").when(~placed, "MISPLACED").otherwise(F.coalesce("__f.slot", F.lit("COMPANION")))
    half = lambda k: F.get(F.split("__f.pinned", "\n"), F.lit(k))
    return x.withColumn("recording", F.coalesce(half(0), F.when(named, F.col("__p.recording")))).withColumn("class", kind).withColumn("reason", F.coalesce(half(1), F.col("__f.why"))).drop("__p", "__f")


def recordings(classified: DataFrame) -> DataFrame:
    """recording, video_path, pose_path, raw_path, complete, ambiguous (two files of a slot) of classified files."""
    slot = {"VIDEO": "video_path", "POSE": "pose_path", "RAW": "raw_path"}
    x = classified.where(F.col("class").isin(*slot)).groupBy("recording").agg(*(F.min(F.when(F.col("class") == c, F.col("path"))).alias(n) for c, n in slot.items()), *(F.count_if(F.col("class") == c).alias(f"__{c}") for c in slot))
    every = lambda f: F.array(*(f(c) for c in slot))
    x = x.withColumn("complete", F.forall(every(lambda c: F.col(f"__{c}")), lambda n: n > 0)).withColumn("ambiguous", F.exists(every(lambda c: F.col(f"__{c}")), lambda n: n > 1))
    return x.drop(*(f"__{c}" for c in slot))


def strays(classified: DataFrame) -> DataFrame:
    """recording, path, class of classified files whose name begins as a recording's files do (in any case, with or without
    ik_), but that are none of its slots or companions in their place: what a second look at a recording must not find."""
    begun = F.upper(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(?i:ik_)?((?i:S\d+_A\d+_T\d+))", 1))
    return classified.where(F.col("class").isin("UNEXPECTED", "MISPLACED")).withColumn("recording", begun).where("recording <> ''").select("recording", "path", "class")


def pair_modalities(files: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """recording, a path for each kind (extension to column), inventory_complete, n_extra (files beyond one a kind, or of no kind)."""
    named = files.where(F.col("recording").isNotNull())
    x = named.groupBy("recording").agg(*(F.min(F.when(F.col("extension") == e, F.col("path"))).alias(c) for e, c in kinds.items()), F.count("*").alias("__n"))
    some = sum((F.col(c).isNotNull().cast("int") for c in kinds.values()), F.lit(0))
    return x.withColumn("inventory_complete", some == len(kinds)).withColumn("n_extra", F.col("__n") - some).drop("__n")


def exclusions(files: DataFrame, reason: Column) -> DataFrame:
    """Ledger (relative path, reason, sha256) of files for which reason isn't null, in order."""
    return files.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("path", "reason", "sha256").orderBy("path")


def path_key(path: Column) -> Column:
    """NFC and case folding: paths with one key can't lie side by side everywhere."""

    def keys(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", p).casefold())

    return F.pandas_udf(keys, StringType())(path)


def path_problems(files: DataFrame, path: str = "path") -> DataFrame:
    """path, problem: ABSOLUTE, ESCAPES (a .. part), BACKSLASH, EMPTY_PART, COLLIDES (another path with its key)."""
    x = files.select(F.col(path).alias("path")).withColumn("__k", path_key(F.col("path")))
    n = x.groupBy("__k").agg(F.count_distinct("path").alias("__n"))
    parts = F.split("path", "/")
    rules = {
        "ABSOLUTE": F.col("path").rlike(r"^(/|[A-Za-z]:)"), "ESCAPES": F.array_contains(parts, ".."), "BACKSLASH": F.col("path").contains("\\"),
        "EMPTY_PART": F.exists(F.slice(parts, 2, 1 << 20), lambda p: p == "") | (F.col("path") == ""), "COLLIDES": F.col("__n") > 1,
    }
    found = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return x.join(n, "__k").select("path", F.explode(found).alias("problem"))


def catalog(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A closed JSON catalogue (one document): a value of another type is an error, not a null."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def by_kind(rows: DataFrame, kinds: tuple[str, ...] = ("csv", "mot", "mp4", "raw")) -> DataFrame:
    """Trim instructions with a recording a row: cut_frames of each kind, and whether all kinds that are there agree."""
    x = rows.groupBy("subject", "activity", "trial").pivot("type", list(kinds)).agg(F.max("cut_frames"))
    return x.withColumn("agree", F.size(F.array_distinct(F.filter(F.array(*kinds), lambda c: c.isNotNull()))) <= 1)


def verify_members(listed: DataFrame, found: DataFrame) -> DataFrame:
    """listed (path, length, sha256) with status VERIFIED, MISMATCH or UNAVAILABLE against found; paths meet by path_key."""
    key = lambda df, n: df.withColumn("__k", path_key(F.regexp_replace("path", "^\\./", ""))).withColumnRenamed("path", n)
    y = key(found, "__p").select("__k", F.col("length").alias("__l"), F.col("sha256").alias("__h"))
    status = F.when(F.col("__h").isNull(), "UNAVAILABLE").when((F.col("__h") == F.col("sha256")) & (F.col("__l") == F.col("length")), "VERIFIED").otherwise("MISMATCH")
    return key(listed, "path").join(y, "__k", "left").withColumn("status", status).drop("__k", "__l", "__h")
