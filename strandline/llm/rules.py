"""Quality rules: a learned decision list over statistics of a text, in DataFrame functions only.

Statistics are computed once for every document. Sequential covering then works on the labelled ones: a rule grows by
the threshold condition with the highest FOIL gain, is pruned on rows that growing did not see, and what it covers
leaves the table. Each step is one Spark aggregate of (statistic, bin) counts, so only statistics * bins numbers
come to the driver however many labels there are. The list ends as one Spark CASE expression.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_SPACE = " \t\n\x0b\f\r"
WINDOW = 8
#: What conditions can test; all are ratios but n_words.
FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "exclaims")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and FEATURES of every row.

    Words are runs of non-space characters (space, \\t, \\n, \\v, \\f, \\r). Null and empty texts have 0 everywhere.
    Windows of 8 words are compared by 64-bit hashes within a text. A very long text is one row's work, in proportion
    to its words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.btrim(text, F.lit(_SPACE)).alias("trimmed"))
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", "[ \\t\\n\\x0B\\f\\r]+"))
    x = x.select(
        "doc_id",
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(_SPACE)) != "").alias("lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("\\p{Lu}")).alias("uppers"),
        F.regexp_count("text", F.lit("!")).alias("exclaims"),
        F.length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
    )
    # hashes of 2, 4, 8 words from those of half as many
    joined = lambda h, k: F.zip_with(F.slice(h, F.lit(1), F.size(h) - k), F.slice(h, F.lit(k + 1), F.size(h) - k), lambda a, b: F.xxhash64(a, b))
    x = x.select(
        "doc_id", "n_symbols", "uppers", "exclaims", "word_chars",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.when(F.size("words") >= WINDOW, joined(F.col("words"), 1)).alias("windows"),
    )
    x = x.withColumn("windows", joined(F.col("windows"), 2)).withColumn("windows", joined(F.col("windows"), 4))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    x = x.withColumn("ordered", F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    twin = lambda r, i: F.coalesce(F.get("ordered", i - 1)["h"] == r["h"], F.lit(False)) | F.coalesce(F.get("ordered", i + 1)["h"] == r["h"], F.lit(False))
    x = x.withColumn("places", F.when(F.col("ordered").isNotNull(), F.sort_array(F.transform(F.filter("ordered", twin), lambda r: r["p"]))))
    reach = F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW))))
    x = x.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return x.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("word_chars", "n_words").alias("word_length"), per("n_symbols", "n_words").alias("symbols"), per("n_dup_lines", "n_lines").alias("dup_lines"),
        per("n_repeat_words", "n_words").alias("repeats"), per("n_distinct", "n_words").alias("distinct"), per("uppers", "word_chars").alias("upper"), per("exclaims", "n_words").alias("exclaims"),
    )


def holds(condition: tuple[str, str, float]) -> Column:
    feature, sign, bound = condition
    return F.col(feature) <= bound if sign == "<=" else F.col(feature) > bound


def conjunction(rule: list[tuple[str, str, float]]) -> Column:
    return reduce(lambda a, b: a & b, map(holds, rule), F.lit(True))


def _binned(rows: DataFrame, bounds: dict[str, list[float]]) -> DataFrame:
    """rows with the place of each statistic among its bounds (how many are below it) instead of the statistic, so that what
    learning asks of them again and again is a comparison of whole numbers."""
    place = lambda f: sum((F.when(F.col(f) > b, 1).otherwise(0) for b in bounds[f]), F.lit(0))
    return rows.select("bad", "grow", *(place(f).alias(f) for f in FEATURES))


def _within(rule: list[tuple[str, str, float]], bounds: dict[str, list[float]]) -> Column:
    """conjunction, of rows that are binned: a statistic is at most the i-th bound where its place is at most i."""
    return conjunction([(f, sign, bounds[f].index(bound)) for f, sign, bound in rule])


def _bounds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Quantiles of each statistic, over all labelled rows and over the bad ones."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)) if bad else F.col(f), shares, 2000).alias(f"{f}{bad}") for f in FEATURES for bad in (0, 1))).first()
    return {f: sorted({float(x) for bad in (0, 1) for x in found[f"{f}{bad}"] or []}) for f in FEATURES}


def _best(rows: DataFrame, bounds: dict[str, list[float]]) -> tuple[float, tuple[str, str, float]] | None:
    """The condition with the highest FOIL gain on these binned rows, from one aggregate."""
    cells = rows.select("bad", F.posexplode(F.array(*FEATURES)).alias("f", "bin"))
    counts: dict[int, dict[int, tuple[int, int]]] = {}
    for r in cells.groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.count("*").alias("c")).collect():  # statistics * bins rows
        counts.setdefault(r["f"], {})[r["bin"]] = (r["p"], r["c"] - r["p"])
    best = None
    for k, f in enumerate(FEATURES):
        cell = counts.get(k, {})
        p0, n0 = (sum(x[i] for x in cell.values()) for i in (0, 1))
        if not p0 or not n0:
            continue
        base, p, n = math.log2(p0 / (p0 + n0)), 0, 0
        for i, bound in enumerate(bounds[f]):
            p, n = p + cell.get(i, (0, 0))[0], n + cell.get(i, (0, 0))[1]
            for sign, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                if pp and (gain := pp * (math.log2(pp / (pp + nn)) - base)) > (best[0] if best else 1e-9):
                    best = gain, (f, sign, bound)
    return best


def learn(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", bins: int = 24, most_rules: int = 10, most_conditions: int = 4, precision: float = 0.9) -> list[list[tuple[str, str, float]]]:
    """Rules for label 0, in order. A rule is kept if it reaches the precision on rows that growing did not see.

    Two thirds of the labelled rows grow rules, the others prune them, by a hash of the id. Null labels and labels
    without a document are ignored; without bad rows there are no rules.
    """
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.when(F.min(label_col) == 0, 1).otherwise(0).alias("bad"))
    rows = cut(statistics.join(y, "doc_id").select("bad", *FEATURES, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow")))
    bounds, rules = _bounds(rows, bins), []
    left = cut(_binned(rows, bounds))
    for _ in range(most_rules):
        rule: list[tuple[str, str, float]] = []
        while len(rule) < most_conditions and (best := _best(left.where(F.col("grow") & _within(rule, bounds)), bounds)):
            rule.append(best[1])
        if not rule:
            break
        # each beginning of the rule, on the rows held back
        sums = [f(F.when(_within(rule[:k], bounds), F.col("bad"))).alias(f"{name}{k}") for k in range(1, len(rule) + 1) for name, f in (("p", F.sum), ("c", F.count))]
        seen = left.where(~F.col("grow")).agg(*sums).first()
        worth = {k: (2 * (seen[f"p{k}"] or 0) - seen[f"c{k}"]) / seen[f"c{k}"] for k in range(1, len(rule) + 1) if seen[f"c{k}"]}
        if not worth:
            break
        k = max(worth, key=lambda k: (round(worth[k], 2), -k))
        if (seen[f"p{k}"] or 0) < precision * seen[f"c{k}"]:
            break
        rules.append(rule[:k])
        left = left.where(~_within(rule[:k], bounds))
    return rules


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The decision list as a conditional expression: true keeps."""
    return reduce(lambda chain, rule: chain.when(conjunction(rule), False), rules, F.when(F.lit(False), False)).otherwise(True)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **settings) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every row of docs.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows (so null and empty texts
    fail). kept: passes that and the learned list. Repeated rows, and rows of one id, get results of their own texts; of
    several labels of an id the least counts, and of conditions with equal gain the first by FEATURES, then bound.
    Without labels, or documents, there are no rules; other columns are ignored.
    """
    found = cut(text_statistics(docs, id_col, text_col))
    rules = learn(found, labels, id_col, label_col, **settings)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
