"""Primitives over timestamped streams: ordinals, owned intervals, nearest samples, islands, interval algebra, hop windows.

Times are long nanoseconds, intervals half open. Operators that need the order within a stream take `bucket`, a width
in nanoseconds: rows are then ordered within (stream, bucket) only and carried over bucket borders by a small table of
one row for each bucket, so one hot stream is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DAY = 86_400_000_000_000
#: Rows that a task holds in memory where rows are laid by key.
ROWS = 250_000


def parts(df: DataFrame, times: int = 1) -> int:
    """In how many partitions there are ROWS rows in each, and a task for each core; counts the rows, for which Parquet's footers do.

    times: how many rows come of one."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * times // ROWS))


def laid(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """df by keys in n partitions, or as many as `parts` says, so that a task's share doesn't grow with the input; Spark's own number is the
    session's, whatever the input, and it joins small partitions to larger ones."""
    return df.repartition(parts(df) if n is None else n, *keys)


def _in_bucket(df: DataFrame, order: list[str], bucket: int) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(order[0]) / bucket))


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket: int | None) -> DataFrame:
    """df with structs prev_row and next_row of the columns of the rows next to it in a key's order (null at its ends).

    With a bucket, order[0] is a number, such as a time; without, a key's rows are one task's work."""
    if bucket is None:
        row, w = F.struct(*columns), Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("prev_row", F.lag(row).over(w)).withColumn("next_row", F.lead(row).over(w))
    return bucketed_neighbours(df, keys, order, columns, bucket).drop("__b")


def bucketed_neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket: int) -> DataFrame:
    """As neighbours; keeps the bucket as __b, by which (with the keys) the rows lie."""
    row, x = F.struct(*columns), _in_bucket(df, order, bucket)
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    place, over = F.struct(*order), Window.partitionBy(*keys).orderBy("__b")
    ends = x.groupBy(*keys, "__b").agg(F.min_by(row, place).alias("__first"), F.max_by(row, place).alias("__last"))
    ends = ends.select(*keys, "__b", F.lag("__last").over(over).alias("__earlier"), F.lead("__first").over(over).alias("__later"))
    x = x.withColumn("__p", F.lag(row).over(w)).withColumn("__n", F.lead(row).over(w)).join(ends, [*keys, "__b"])
    return x.select(*df.columns, "__b", F.coalesce("__p", "__earlier").alias("prev_row"), F.coalesce("__n", "__later").alias("next_row"))


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: int | None) -> DataFrame:
    """df with the sum of value over a key's rows up to and with this one."""
    if bucket is None:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    x = _in_bucket(df.withColumn("__v", value), order, bucket)
    sums = x.groupBy(*keys, "__b").agg(F.sum("__v").alias("__s"))
    sums = sums.select(*keys, "__b", F.coalesce(F.sum("__s").over(_before(keys)), F.lit(0)).alias("__base"))
    here = F.sum("__v").over(Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("__h", here).join(sums, [*keys, "__b"])
    return x.select(*df.columns, (F.col("__h") + F.col("__base")).cast("long").alias(name))


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "canonical_ordinal", bucket: int | None = None) -> DataFrame:
    """Dense zero-based rank within keys."""
    x = running(df, keys, order, F.lit(1), name, bucket)
    return x.withColumn(name, F.col(name) - 1)


def owned_ordinals(df: DataFrame, keys: list[str], time: str, order: list[str], end: Column, name: str = "interval_end", ordinal: str = "ordinal", bucket: int = DAY) -> DataFrame:
    """df with ordinals and owned intervals (see there), whose order is found once for both."""
    x = _in_bucket(df, order, bucket)
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    ends = x.groupBy(*keys, "__b").agg(F.count("*").alias("__n"), F.min(time).alias("__first"))
    over = Window.partitionBy(*keys).orderBy("__b")
    ends = ends.select(*keys, "__b", F.coalesce(F.sum("__n").over(_before(keys)), F.lit(0)).alias("__base"), F.lead("__first").over(over).alias("__later"))
    x = x.withColumn("__k", F.row_number().over(w)).withColumn("__next", F.lead(time).over(w)).join(ends, [*keys, "__b"])
    return x.select(*df.columns, (F.col("__base") + F.col("__k") - 1).cast("long").alias(ordinal), F.coalesce("__next", "__later", end).alias(name))


def owned_intervals(df: DataFrame, keys: list[str], time: str, order: list[str], end: Column | None = None, name: str = "interval_end", bucket: int | None = None) -> DataFrame:
    """Each row owns from its time to the next row's; the last one to `end` (null without)."""
    x = neighbours(df, keys, order, [time], bucket)
    following = F.col("next_row")[time]
    return x.withColumn(name, F.coalesce(following, end) if end is not None else following).drop("prev_row", "next_row")


def medians(df: DataFrame, keys: list[str], value: str, name: str, every: bool = False) -> DataFrame:
    """keys, exact median of the positive values of a key, however many it has; with `every`, also keys without any (null).

    Equal values are counted first. Counts by the logarithm of the value, in steps of a 4096th of an octave, tell which
    cells hold the middle, and only the distinct values of those are put in order."""
    v = df.where(F.col(value) > 0).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c")).withColumn("__bin", F.floor(F.log2("__v") * 4096))

    def holding(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
        """Cells that hold the places in `at`, which become places in the cell."""
        upto = F.sum("__c").over(Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
        x = counts.withColumn("__before", upto - F.col("__c"))
        x = x.withColumn("__at", F.filter("__at", lambda a: (a >= F.col("__before")) & (a < F.col("__before") + F.col("__c"))))
        return x.where(F.size("__at") > 0).withColumn("__at", F.transform("__at", lambda a: a - F.col("__before")))

    n = F.sum("__c").over(Window.partitionBy(*keys))
    bins = v.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__c")).withColumn("__at", F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
    bins = holding(bins, keys, "__bin").select(*keys, "__bin", "__at")
    middle = holding(v.join(bins, [*keys, "__bin"]), [*keys, "__bin"], "__v")
    found = middle.groupBy(*keys).agg((F.sum(F.col("__v").cast("double") * F.size("__at")) / 2).alias(name))
    return df.select(*keys).distinct().join(found, keys, "left") if every else found


def median_period(df: DataFrame, keys: list[str], time: str, bucket: int | None = None) -> DataFrame:
    """keys, period (exact median of positive differences, null if there is none), gap_limit (2.5 periods, ties to even, at least 1)."""
    x = neighbours(df.select(*keys, time), keys, [time], [time], bucket)
    out = medians(x.withColumn("__d", F.col(time) - F.col("prev_row")[time]), keys, "__d", "period", every=True)
    return out.withColumn("gap_limit", F.when(F.col("period").isNotNull(), F.greatest(F.lit(1), F.rint(F.col("period") * 2.5).cast("long"))))


def locate(targets: DataFrame, samples: DataFrame, keys: list[str], at: str = "at", time: str = "time", ordinal: str = "ordinal", bucket: int = DAY) -> DataFrame:
    """targets with n_before (samples earlier than `at`), and time and lowest ordinal of the samples next to it on
    either side (prev_time <= at, next_time >= at; null where there is none)."""
    s = samples.groupBy(*keys, F.col(time).alias("__t")).agg(F.count("*").alias("__n"), F.min(ordinal).alias("__o"))
    both = targets.withColumn("__row", F.struct(*targets.columns)).select(*keys, F.col(at).alias("__t"), "__row", F.lit(None).cast("long").alias("__n"), F.lit(None).cast(s.schema["__o"].dataType).alias("__o"))
    both = both.unionByName(s.select(*keys, "__t", F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), "__n", "__o"))
    both = both.withColumn("__b", F.floor(F.col("__t") / bucket)).withColumn("__s", F.when(F.col("__n").isNotNull(), F.struct("__t", "__o")))
    # targets come before samples of their time, so counts are of earlier ones; both look at samples of their own time
    w = Window.partitionBy(*keys, "__b").orderBy("__t", F.col("__n").isNotNull())
    through = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(0, Window.unboundedFollowing)
    near = both.select("*", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__count"), F.last("__s", True).over(through).alias("__prev"), F.first("__s", True).over(onward).alias("__next"))
    b = both.groupBy(*keys, "__b").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.max("__s").alias("last"), F.min("__s").alias("first"))
    order = Window.partitionBy(*keys).orderBy("__b")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    b = b.select(*keys, "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"), F.last("last", True).over(before).alias("__earlier"), F.first("first", True).over(after).alias("__later"))
    out = near.where(F.col("__row").isNotNull()).join(b, [*keys, "__b"])
    prev, following = F.coalesce("__prev", "__earlier"), F.coalesce("__next", "__later")
    return out.select("__row.*", (F.col("__count") + F.col("__base")).alias("n_before"), prev["__t"].alias("prev_time"), prev["__o"].alias("prev_ordinal"), following["__t"].alias("next_time"), following["__o"].alias("next_ordinal"))


def nearest(located: DataFrame, at: str = "at") -> DataFrame:
    """located with nearest_ordinal and nearest_delta (sample - target); of equally near ones the earlier."""
    back, forth = F.col(at) - F.col("prev_time"), F.col("next_time") - F.col(at)
    earlier = forth.isNull() | (back <= forth)
    return located.withColumn("nearest_ordinal", F.when(back.isNotNull() & earlier, F.col("prev_ordinal")).otherwise(F.col("next_ordinal"))).withColumn("nearest_delta", F.when(back.isNotNull() & earlier, -back).otherwise(forth))


def among(marks: DataFrame, samples: DataFrame, keys: list[str], mark: list[str], bucket: int = DAY) -> DataFrame:
    """Marks and distinct sample times of a stream in one order, each with what is next to it.

    marks: keys, time and the columns of `mark`; samples: keys, time, ordinal. Rows: keys, at, sample (null for marks,
    else a struct of t, o, n: time, lowest ordinal, samples of that time), mark (the last one at or before the row),
    n_before (samples earlier than at), prev and next (samples strictly before and after in that order). Marks come
    before samples of their time. Rows are ordered within (stream, bucket); a table of one row a bucket tells what
    lies beyond its borders."""
    s = samples.groupBy(*keys, F.col("time").alias("at")).agg(F.struct(F.first("time").alias("t"), F.min("ordinal").alias("o"), F.count("*").alias("n")).alias("sample"))
    s = s.withColumn("sample", F.struct(F.col("at").alias("t"), F.col("sample.o").alias("o"), F.col("sample.n").alias("n")))
    both = marks.select(*keys, F.col("time").alias("at"), F.struct(*mark).alias("mark"), F.lit(None).cast(s.schema["sample"].dataType).alias("sample"))
    both = both.unionByName(s.select(*keys, "at", F.lit(None).cast(both.schema["mark"].dataType).alias("mark"), "sample")).withColumn("__b", F.floor(F.col("at") / bucket))
    here = Window.partitionBy(*keys, "__b").orderBy("at", F.col("sample").isNotNull(), "mark")
    earlier, later = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(1, Window.unboundedFollowing)
    n = F.coalesce(F.col("sample.n"), F.lit(0))
    x = both.select(
        *keys, "at", "__b", "sample", F.last("mark", True).over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("__mark"), (F.sum(n).over(here.rowsBetween(Window.unboundedPreceding, 0)) - n).alias("__n"),
        F.last("sample", True).over(earlier).alias("__prev"), F.first("sample", True).over(later).alias("__next"),
    )
    ends = both.groupBy(*keys, "__b").agg(F.sum(n).alias("n"), F.max("sample").alias("last"), F.min("sample").alias("first"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.struct("at", "mark"))).alias("mark"))
    order = Window.partitionBy(*keys).orderBy("__b")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(*keys, "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"), F.last("mark", True).over(before).alias("__open"), F.last("last", True).over(before).alias("__earlier"), F.first("first", True).over(after).alias("__later"))
    return x.join(ends, [*keys, "__b"]).select(*keys, "at", "sample", F.coalesce("__mark", "__open").alias("mark"), (F.col("__n") + F.col("__base")).cast("long").alias("n_before"), F.coalesce("__prev", "__earlier").alias("prev"), F.coalesce("__next", "__later").alias("next"))


def islands(df: DataFrame, keys: list[str], time: str, order: list[str], gap: Column, bucket: int | None = None) -> DataFrame:
    """df with island, which counts up where a row is more than `gap` after the one before."""
    x = neighbours(df, keys, order, [time], bucket).withColumn("__new", F.coalesce((F.col(time) - F.col("prev_row")[time] > gap).cast("int"), F.lit(0)))
    return running(x, keys, order, F.col("__new"), "island", bucket).select(*df.columns, "island")


def clock_runs(clock: DataFrame, keys: list[str], usable: Column) -> DataFrame:
    """keys, run, run_id, start, end: continuity runs of a clock map's epochs (canonical_start_ns, canonical_end_ns).

    A run breaks at an unusable epoch, where the component changes, and where an epoch does not begin in canonical time
    where the one before ended; source ordinals and native times may jump. Runs without length are left out.
    """
    w = Window.partitionBy(*keys).orderBy("acquisition_ordinal")
    lag = lambda c: F.lag(c).over(w)
    same = lag("__usable") & F.col("__usable") & (lag("continuity_component_id") == F.col("continuity_component_id")) & (lag("canonical_end_ns") == F.col("canonical_start_ns"))
    x = clock.withColumn("__usable", F.coalesce(usable, F.lit(False)))
    x = x.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    x = x.withColumn("run", F.sum("__new").over(w).cast("long")).where("__usable")
    return x.groupBy(*keys, "run").agg(
        F.concat_ws(":", F.min_by("continuity_component_id", "acquisition_ordinal"), F.min_by("clock_epoch_id", "acquisition_ordinal")).alias("run_id"),
        F.min("canonical_start_ns").alias("start"), F.max("canonical_end_ns").alias("end"),
    ).where("start < end")


def _cells(df: DataFrame, start: str, end: str, bucket: int) -> DataFrame:
    return df.where(F.col(start) < F.col(end)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))


def intersect_intervals(a: DataFrame, b: DataFrame, keys: list[str], bucket: int = DAY) -> DataFrame:
    """Overlaps of intervals (start, end) of a and b with equal keys: keys, other columns of both, start, end.

    Intervals meet in the time cells they touch, an equi-join; each overlap is made in the cell where it begins.
    """
    x = _cells(a.withColumnRenamed("start", "__s").withColumnRenamed("end", "__e"), "__s", "__e", bucket)
    y = _cells(b.withColumnRenamed("start", "__u").withColumnRenamed("end", "__v"), "__u", "__v", bucket)
    met = x.join(y, [*keys, "__cell"]).where((F.col("__s") < F.col("__v")) & (F.col("__u") < F.col("__e")))
    met = met.withColumn("start", F.greatest("__s", "__u")).withColumn("end", F.least("__e", "__v"))
    return met.where(F.floor(F.col("start") / bucket) == F.col("__cell")).drop("__s", "__e", "__u", "__v", "__cell")


def split_intervals(intervals: DataFrame, every: int) -> DataFrame:
    """Intervals cut at multiples of `every`; pieces are numbered by `piece`."""
    x = intervals.where("start < end").withColumn("__c", F.explode(F.sequence(F.floor(F.col("start") / every), F.floor((F.col("end") - 1) / every))))
    return x.select(*(c for c in intervals.columns if c not in ("start", "end")), (F.col("__c") - F.floor(F.col("start") / every)).alias("piece"), F.greatest("start", F.col("__c") * every).alias("start"), F.least("end", (F.col("__c") + 1) * every).alias("end"))


def hop_windows(segments: DataFrame, window: int, hop: int) -> DataFrame:
    """Windows (k, window_start, window_end) of segments (start, end): start + k * hop while they fit; none where the segment is shorter."""
    fits = segments.where(F.col("end") - F.col("start") >= window)
    x = fits.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - F.col("start") - window) / hop))))
    return x.withColumn("window_start", F.col("start") + F.col("k") * hop).withColumn("window_end", F.col("window_start") + window)


def to_windows(rows: DataFrame, segments: DataFrame, keys: list[str], time: str, window: int, hop: int) -> DataFrame:
    """rows joined to the segment (keys must name it) and to each window k they fall in; a row is in window / hop windows at most."""
    x = rows.join(segments.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e")), keys)
    off = F.col(time) - F.col("__s")
    first = F.greatest(F.lit(0).cast("long"), F.floor((off - window) / hop) + 1)
    last = F.least(F.floor(off / hop), F.floor((F.col("__e") - F.col("__s") - window) / hop))
    x = x.where((off >= 0) & (first <= last)).withColumn("k", F.explode(F.sequence(first, last)))
    return x.drop("__s", "__e")


def held_runs(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: int | None = None) -> DataFrame:
    """keys, n_rows, n_runs (1 + changes of value), n_held, first and last value, of rows in order; null equals null."""
    x = neighbours(df, keys, order, [value], bucket)
    x = x.withColumn("__new", F.when(F.col("prev_row").isNull(), 1).otherwise((~F.col("prev_row")[value].eqNullSafe(F.col(value))).cast("int")))
    place = F.struct(*order)
    out = x.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum("__new").alias("n_runs"), F.min_by(value, place).alias("first_value"), F.max_by(value, place).alias("last_value"))
    return out.withColumn("n_held", F.col("n_rows") - F.col("n_runs"))
