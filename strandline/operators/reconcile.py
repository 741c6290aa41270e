"""Reconciliation: foreign keys, key sets, one-to-one contracts, exact ratio summaries, status counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import decimal_6


def foreign_keys(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """One row: parents, children, orphans (children without parent), childless parents, parents that are repeated.

    Both sides are counted by key before they meet, so a hot key is one row."""
    p = parent.groupBy(F.col(parent_key).alias("k")).agg(F.count("*").alias("p"))
    c = child.groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("c"))
    x = p.join(c, "k", "full_outer")
    total = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("long")
    return x.agg(
        total(F.col("p")).alias("parents"), total(F.col("c")).alias("children"), total(F.when(F.col("p").isNull(), F.col("c"))).alias("orphans"),
        total(F.when(F.col("c").isNull(), F.col("p"))).alias("childless"), total((F.col("p") > 1).cast("int")).alias("repeated"),
    )


def one_to_one(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key, n_a, n_b of every key that doesn't have one row on either side; null keys are a key."""
    count = lambda df, n: df.groupBy(*key).agg(F.count("*").alias(n))
    x, y = count(a, "n_a").alias("x"), count(b, "n_b").alias("y")
    met = x.join(y, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in key], "full_outer")
    out = met.select(*(F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in key), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return out.where("n_a <> 1 or n_b <> 1")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys in both, only in a, only in b."""
    x = a.select(F.col(key).alias("k"), F.lit(1).alias("s")).union(b.select(F.col(key).alias("k"), F.lit(2).alias("s"))).groupBy("k").agg(F.bit_or("s").alias("s"))
    return x.agg(*(F.count(F.when(F.col("s") == s, 1)).alias(n) for s, n in ((3, "in_both"), (1, "only_a"), (2, "only_b"))))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, as often as it lacks them; side tells where they are. Empty if the tables
    are equal. Both are read once and counted by row in one aggregate, before anything meets."""
    name = [f"`{c}`" for c in a.columns]
    x = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1))).groupBy(*name).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return x.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n")))).select(*name, F.when(F.col("__n") > 0, "a").otherwise("b").alias("side"))


def ratio_summary(rows: DataFrame, num: str, den: str, label: list[str]) -> DataFrame:
    """pick (min, median_low, median_high, max), label, num, den, ratio (six decimals, exact) over rows with den > 0.

    Ratios are ordered exactly (as a 128-bit scaled quotient), ties by label. Counts by the logarithm of the ratio
    tell which cell a pick lies in, counts by ratio in that cell which ratio, and only rows of that ratio are ordered."""
    scaled = (F.col(num).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)")
    den_ = F.col(den).cast("decimal(38,0)")
    ratio = F.col(num) / F.col(den)
    # a cell is an order of size, so there are some thousands at most
    size = F.floor(F.log2(F.abs(ratio)) * 64).cast("long") + 8192
    x = rows.where(F.col(den) > 0).withColumn("__q", ((scaled - scaled % den_) / den_).cast("decimal(38,0)")).withColumn("__cell", F.when(ratio == 0, F.lit(0)).when(ratio > 0, size).otherwise(-size).cast("long"))
    exact = x.groupBy("__cell", "__q").agg(F.count("*").alias("__c"))
    wanted = _holding(_holding(_picked(exact.groupBy("__cell").agg(F.sum("__c").alias("__c"))), [], "__cell").select("__cell", "__at").join(exact, "__cell"), ["__cell"], "__q").select("__cell", "__q", "__at")
    ties = x.join(wanted, ["__cell", "__q"]).withColumn("__r", F.row_number().over(Window.partitionBy("__cell", "__q").orderBy(*label)) - 1)
    out = ties.withColumn("__p", F.explode(F.filter("__at", lambda p: p["at"] == F.col("__r"))))
    return out.select(F.col("__p.pick").alias("pick"), *label, num, den, decimal_6(F.col(num), F.col(den)).alias("ratio"))


def _picked(cells: DataFrame) -> DataFrame:
    """Counts (__c) of a bounded number of cells, with the places of the picks among all rows."""
    n = F.sum("__c").over(Window.partitionBy())
    at = {"min": F.lit(0).cast("long"), "median_low": F.floor((n - 1) / 2), "median_high": F.floor(n / 2), "max": n - 1}
    return cells.withColumn("__at", F.array(*(F.struct(F.lit(k).alias("pick"), v.alias("at")) for k, v in at.items())))


def _holding(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
    """Cells that hold places in __at, which become places within the cell."""
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
    x = counts.withColumn("__before", upto - F.col("__c"))
    x = x.withColumn("__at", F.filter("__at", lambda p: (p["at"] >= F.col("__before")) & (p["at"] < F.col("__before") + F.col("__c"))))
    return x.where(F.size("__at") > 0).withColumn("__at", F.transform("__at", lambda p: F.struct(p["pick"].alias("pick"), (p["at"] - F.col("__before")).alias("at"))))


def status_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the count of rows for which each condition holds, and n_rows."""
    return rows.agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def uniform(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and column names where a column has several values (null is one) in a group."""
    x = rows.groupBy(*by).agg(*((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns))
    many = F.filter(F.array(*(F.when(F.col(c) > 1, F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    return x.select(*by, F.explode(many).alias("column"))


def modality_partition(rows: DataFrame, key: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Keys that don't have exactly one row of each kind."""
    x = rows.groupBy(*key).agg(*(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds), F.count_if(~F.col(kind).isin(kinds) | F.col(kind).isNull()).alias("n_other"))
    wrong = F.col("n_other") > 0
    for k in kinds:
        wrong |= F.col(f"n_{k}") != 1
    return x.where(wrong)


def replay_comparison(a: DataFrame, b: DataFrame, key: list[str], digest: str) -> DataFrame:
    """key, outcome (EQUAL, DIFFERENT, ONLY_A, ONLY_B) of two runs' digests."""
    x = a.select(*key, F.col(digest).alias("__a")).join(b.select(*key, F.col(digest).alias("__b")), key, "full_outer")
    return x.select(*key, F.when(F.col("__b").isNull(), "ONLY_A").when(F.col("__a").isNull(), "ONLY_B").when(F.col("__a") == F.col("__b"), "EQUAL").otherwise("DIFFERENT").alias("outcome"))


def sensor_groups(rows: DataFrame, group: list[str], order: str, label: str, layout: list[str]) -> DataFrame:
    """group, labels (in order), status, first that holds: INCOMPLETE (not as many as the layout), MALFORMED (a null or
    empty label), UNKNOWN_SENSOR, DUPLICATE_SENSOR, MALFORMED (another order), COMPLETE."""
    x = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("l")))).alias("__g"))
    x = x.select(*group, F.transform("__g", lambda e: e["l"]).alias("labels"))
    known = F.array(*map(F.lit, layout))
    status = (
        F.when(F.size("labels") != len(layout), "INCOMPLETE")
        .when(F.array_contains("labels", ""), "MALFORMED")
        .when(F.size(F.array_except("labels", known)) > 0, "UNKNOWN_SENSOR")
        .when(F.size(F.array_distinct("labels")) < F.size("labels"), "DUPLICATE_SENSOR")
        .when(F.col("labels") != known, "MALFORMED")
        .otherwise("COMPLETE")
    )
    return x.withColumn("status", status)


def trim(rows: DataFrame, keys: list[str], order: list[str], removed: Column, retained: int = 0) -> DataFrame:
    """rows without those that a trim removes: after the first `retained` of a key, the next `removed` (of the row's key)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("__n", n).where((F.col("__n") < retained) | (F.col("__n") >= retained + removed)).drop("__n")
