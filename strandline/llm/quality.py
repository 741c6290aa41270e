"""Quality by a factorisation machine (Rendle, 2010) over hashed words, structure statistics, and metadata that is in the
text itself: its lengths in words, bytes and lines.

    z = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)

scores all pairs of features in time linear in their number. Statistics take the first columns of the feature space,
buckets of hashed words the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, ship
from .samples import features_of, first_by_hash, training_labels
from .textbytes import SPACED, Words, buffers, folding, runs

BITS = 16
STATISTICS = ("log_words", "log_bytes", "word_bytes", "symbols", "exclaims", "upper", "digits", "lines", "marks", "beyond_ascii", "adjacent_repeats", "distinct", "repeated_lines", "digit_words")
_LINES = folding(lambda b: b != 10)


def _classes() -> np.ndarray:
    """For each byte, one of the classes that statistics count, or 0."""
    out = np.zeros(256, np.uint8)
    for k, members in enumerate((b"#*$%&|<>", b"!", range(65, 91), b"0123456789", b"\n", b".,;:?", range(192, 256)), 1):
        out[list(members)] = k
    return out


_CLASS = _classes()


def statistics(data: np.ndarray, off: np.ndarray, words: Words) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(off) - 1
    per = lambda a, b: a / np.maximum(b, 1)
    size, count = np.diff(off).astype(float), np.diff(words.of).astype(float)
    text = np.repeat(np.arange(n), np.diff(off))
    kind = np.bincount(text * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8).astype(float)
    h, of = words.hashes, words.of
    same = np.zeros(len(h) + 1)
    same[2:] = np.cumsum(h[1:] == h[:-1]) if len(h) else 0
    digit = np.concatenate([[0], np.cumsum((_CLASS[data[words.starts]] == 4) if len(h) else np.zeros(0))])
    lines = Words(data, off, _LINES)
    distinct, fresh = np.ones(n), np.ones(n)
    for k in range(n):
        for all_, at, out in ((h, of, distinct), (lines.hashes, lines.of, fresh)):
            if at[k + 1] > at[k]:
                x = np.sort(all_[at[k] : at[k + 1]])
                out[k] = (1 + np.count_nonzero(x[1:] != x[:-1])) / len(x)
    repeats = np.where(count > 1, same[of[1:]] - same[np.minimum(of[:-1] + 1, len(h))], 0)
    return np.stack([
        np.log1p(count), np.log1p(size), per(size, count), per(kind[:, 1], count), per(kind[:, 2], count), per(kind[:, 3], size), per(kind[:, 4], size), per(kind[:, 5], count),
        per(kind[:, 6], count), per(kind[:, 7], size), per(repeats, count), distinct, 1 - fresh, per(digit[of[1:]] - digit[of[:-1]], count),
    ], 1)


@dataclass
class Machine:
    mean: np.ndarray
    deviation: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.deviation, -4, 4).astype(np.float32)


def _run(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, Words, np.ndarray]:
    words = Words(data, off, SPACED)
    return statistics(data, off, words), words, (words.hashes & np.uint64((1 << BITS) - 1)).astype(np.int64) + len(STATISTICS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, stats, buckets, values: of each text its statistics, the columns of its distinct words, and their shares."""
    for batch in batches:
        data, off = buffers(batch.column(1))
        stats, at, columns, values = [np.zeros((0, len(STATISTICS)))], [0], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for i, j in runs(off):
            s, words, f = _run(data[off[i] : off[j]], off[i : j + 1] - off[i])
            stats.append(s)
            for a, b in zip(words.of[:-1], words.of[1:], strict=True):
                u, c = np.unique(f[a:b], return_counts=True)
                columns.append(u.astype(np.int32))
                values.append((c / max(b - a, 1)).astype(np.float32))
                at.append(at[-1] + len(u))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(STATISTICS) * len(batch) + 1, len(STATISTICS), dtype=np.int32)), pa.array(np.concatenate(stats).reshape(-1)))
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(x))) for x in (columns, values)]
        yield pa.RecordBatch.from_arrays([batch.column(0), rows, *lists], ["row", "stats", "buckets", "values"])


def score_and_gradient(w0: float, w: np.ndarray, v: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, Callable]:
    """Scores of n sparse rows by the sum-of-squares identity, and a function that maps the derivative by the scores to
    that by w0, w and v. Cells of a row stand together."""
    weighed = v[column] * value[:, None]
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    sums = np.zeros((n, v.shape[1]), v.dtype)
    sums[row[begin]] = np.add.reduceat(weighed, begin, 0) if len(begin) else 0
    z = w0 + np.bincount(row, w[column] * value + -0.5 * np.einsum("ij,ij->i", weighed, weighed), n) + 0.5 * np.einsum("ij,ij->i", sums, sums)

    def back(d: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        dv = (d[row] * value)[:, None].astype(v.dtype) * (sums[row] - weighed)
        by = np.argsort(column, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(column[by]) != 0)) if len(by) else by
        gv = np.zeros_like(v)
        if len(by):
            gv[column[by][first]] = np.add.reduceat(dv[by], first, 0)
        return float(d.sum()), np.bincount(column, d[row] * value, len(w)), gv

    return z, back


def fit(found: pa.Table, factors: int = 8, least_texts: int = 10, steps: int = 500, batch: int = 256, rate: float = 0.03, decay: float = 1e-4, seed: int = 1) -> Machine:
    """Logistic loss, by Adam, from a table of y, stats, buckets and values. Word buckets in fewer texts than least_texts, or in
    over half, keep 0. With one class, or no text, the intercept alone answers."""
    k, rng, y = len(STATISTICS), np.random.default_rng(seed), found["y"].to_numpy().astype(float)
    size = k + (1 << BITS)
    machine = Machine(np.zeros(k), np.ones(k), 0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    if not len(y) or y.min() == y.max():
        machine.w0 = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return machine
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in found[c].chunks])
    stats, f, x = flat("stats").reshape(len(y), k), flat("buckets").astype(np.int64), flat("values")
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(found["buckets"]).to_numpy())])
    machine.mean, machine.deviation = stats.mean(0), stats.std(0) + 1e-6
    dense = machine.dense(stats)
    seen = np.bincount(f, minlength=size)
    live = (seen >= least_texts) & (seen <= len(y) / 2)
    keep = live[f]
    at, f, x = np.concatenate([[0], np.cumsum(keep)])[at], f[keep], x[keep]
    live = np.concatenate([np.arange(k), np.flatnonzero(live)])
    f = np.searchsorted(live, f)
    p = [np.zeros(1), np.zeros(len(live)), rng.normal(0, 0.02, (len(live), factors)).astype(np.float32)]
    m, s = ([np.zeros_like(a) for a in p] for _ in range(2))
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(y), batch)
        n = at[rows + 1] - at[rows]
        # each row's statistics, then its words
        width = n + k
        start = np.cumsum(width) - width
        row = np.repeat(np.arange(batch), width)
        place = np.arange(len(row)) - start[row]
        words = place >= k
        source = np.where(words, at[rows][row] + place - k, 0)
        column = np.where(words, f[source] if len(f) else 0, np.minimum(place, k - 1))
        value = np.where(words, x[source] if len(x) else 0, dense[rows[row], np.minimum(place, k - 1)])
        z, back = score_and_gradient(p[0][0], p[1], p[2], row, column, value, batch)
        g = back((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / batch)
        for i, q in enumerate(g):
            q = q + (decay * p[i] if i else 0)
            m[i] = 0.9 * m[i] + 0.1 * q
            s[i] = 0.999 * s[i] + 0.001 * q * q
            p[i] = (p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)).astype(p[i].dtype)
    machine.w0 = float(p[0][0])
    machine.w[live], machine.v[live] = p[1], p[2]
    return machine


def logits(machine: Machine, texts: pa.Array) -> np.ndarray:
    data, off = buffers(texts)
    out, k = [np.zeros(0)], len(STATISTICS)
    for i, j in runs(off):
        stats, words, f = _run(data[off[i] : off[j]], off[i : j + 1] - off[i])
        x = machine.dense(stats)
        z, sums, squares = machine.w0 + x @ machine.w[:k], x @ machine.v[:k], x**2 @ machine.v[:k] ** 2
        live = np.flatnonzero(machine.w[f])
        if len(live):
            text = np.repeat(np.arange(j - i), np.diff(words.of))[live]
            cell, c = np.unique(text * (1 << BITS) + f[live] - k, return_counts=True)
            text, column = cell >> BITS, (cell & ((1 << BITS) - 1)) + k
            share = c / np.diff(words.of)[text]
            v = machine.v[column] * share[:, None]
            z = z + np.bincount(text, machine.w[column] * share, j - i)
            sums = sums + np.stack([np.bincount(text, a, j - i) for a in v.T], 1)
            squares = squares + np.stack([np.bincount(text, a, j - i) for a in (v**2).T], 1)
        out.append(z + 0.5 * (sums**2 - squares).sum(1))
    return np.concatenate(out)


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits(model.value, batch.column(1)), -30, 30))))], ["doc_id", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held_out: int = 1, most_each: int = 2500, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Fitting takes at most most_each labelled texts of either label, of any length, outside the held-out fold (crc32 of
    the id modulo modulus), by a hash of the id. Scores see the whole text and its lengths only. Null and empty texts
    are scored by statistics that are all 0 (distinct: 1). With no labels every score is 0.5, with one label all
    answers are that. Rows with a null id are scored (their fold is that of empty text) but not learned from; repeated
    rows get equal scores, rows of one id each by its own text, and of several labels of an id the largest counts.
    Scores may tie; predicted is 1 from 0.5 on. A very long text is one row's work. Without documents there are no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    known = training_labels(labels, id_col, label_col, modulus, held_out).where("y in (0, 1)")
    chosen = first_by_hash(known.where("y = 0"), most_each).union(first_by_hash(known.where("y = 1"), most_each))
    found = features_of(docs, chosen, id_col, text_col, _features, "stats array<double>, buckets array<int>, values array<float>")
    model = spark.sparkContext.broadcast(fit(found, **settings))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(partial(_scores, model=model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
