"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear scorer over hashed words and word beginnings is fitted to confirmed toxic texts (P) and to texts drawn from
the whole corpus, toxic ones among them (U). With the share of toxic texts pi, the risk is

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)),

whose second term estimates the loss on clean texts; where a batch makes it negative, it gives no gradient.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, ship
from .samples import features_of, first_by_hash, training_labels
from .textbytes import ALNUM, Words, buffers, runs

BITS = 18
#: Beginnings of words, in bytes, beside whole words.
BEGINNINGS = (4, 5, 6)
SCALE = np.float32(100)


def token_features(words: Words) -> list[np.ndarray]:
    """For each kind of feature, a bucket for each word: the whole word, then its beginnings."""
    mask = np.uint64((1 << BITS) - 1)
    out = [(words.hashes & mask).astype(np.int64)]
    for n in BEGINNINGS:
        ends = np.minimum(words.starts + n, words.ends)
        out.append(((words.hash(words.starts, ends) * np.uint64(2 * n + 1) >> np.uint64(20)) & mask).astype(np.int64))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, buckets, values: of each text its distinct buckets, and their shares of the words, times SCALE and at most 1."""
    for batch in batches:
        data, off = buffers(batch.column(1))
        at, buckets, values = [0], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for i, j in runs(off):
            words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
            kinds = token_features(words)
            for a, b in zip(words.of[:-1], words.of[1:], strict=True):
                u, c = np.unique(np.concatenate([k[a:b] for k in kinds]), return_counts=True)
                buckets.append(u.astype(np.int32))
                values.append(np.minimum(c / max(b - a, 1) * SCALE, 1).astype(np.float32))
                at.append(at[-1] + len(u))
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(x))) for x in (buckets, values)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["row", "buckets", "values"])


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """pi * R_P(+), R_U(-) - pi * R_P(-), and the gradient of their sum by z_p and z_u; where the second term is negative, of
    the first one alone. The loss is logistic."""
    s_p, s_u = 1 / (1 + np.exp(-np.clip(z_p, -30, 30))), 1 / (1 + np.exp(-np.clip(z_u, -30, 30)))
    positive, negative = prior * np.logaddexp(0, -z_p).mean(), np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    d_p, d_u = prior * (s_p - 1) / len(z_p), np.zeros(len(z_u))
    if negative > 0:
        d_p, d_u = d_p - prior * s_p / len(z_p), s_u / len(z_u)
    return positive, negative, d_p, d_u


def fit(positive: pa.Table, unlabelled: pa.Table, prior: float, least_z: float | None = 6.0, least_texts: int = 5, steps: int = 3000, batch: int = 256, rate: float = 0.05, decay: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the intercept, from tables of buckets and values.

    A bucket keeps weight 0 if fewer than least_texts texts have it, or, unless least_z is None, if its share of P's
    texts isn't over that of U's by least_z deviations."""
    weights = np.zeros(1 << BITS, np.float32)
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return weights, -5.0
    flat = lambda c: np.concatenate([np.concatenate([x.flatten().to_numpy() for x in t[c].chunks] or [np.zeros(0)]) for t in (positive, unlabelled)])
    sizes = np.concatenate([pc.list_value_length(t["buckets"]).to_numpy() for t in (positive, unlabelled)])
    at, f, x = np.concatenate([[0], np.cumsum(sizes)]), flat("buckets").astype(np.int64), flat("values")
    of_p, of_u = (np.bincount(part, minlength=1 << BITS) for part in (f[: at[n_p]], f[at[n_p] :]))
    keep = of_p + of_u >= least_texts
    if least_z is not None:
        mean = (of_p + of_u + 1) / (n_p + n_u + 2)
        keep &= of_p / n_p - of_u / n_u >= least_z * np.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u))
    live, kept = np.flatnonzero(keep), keep[f]
    at, f, x = np.concatenate([[0], np.cumsum(kept)])[at], np.searchsorted(live, f[kept]), x[kept]
    w, b = np.zeros(len(live)), -1.0
    m, v, mb, vb = np.zeros(len(live)), np.zeros(len(live)), 0.0, 0.0
    rng = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.integers(0, n_p, batch), rng.integers(n_p, n_p + n_u, batch)])
        n = at[rows + 1] - at[rows]
        take = np.repeat(at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        where = np.repeat(np.arange(len(rows)), n)
        z = b + np.bincount(where, w[f[take]] * x[take], len(rows))
        d = np.concatenate(risk(z[:batch], z[batch:], prior)[2:])
        g, gb = np.bincount(f[take], d[where] * x[take], len(live)) + decay * w, d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b = b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights[live] = w
    return weights, float(b)


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    weights, bias = model.value
    for batch in batches:
        out = []
        data, off = buffers(batch.column(1))
        for i, j in runs(off):
            words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
            z = np.full(j - i, bias)
            kinds = token_features(words)
            for k, (a, b) in enumerate(zip(words.of[:-1], words.of[1:], strict=True)):
                if b > a:
                    f = np.concatenate([kind[a:b] for kind in kinds])
                    f = np.sort(f[weights[f] != 0])
                    if len(f):
                        begin = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
                        c = np.diff(np.append(begin, len(f)))
                        z[k] += float(weights[f[begin]] @ np.minimum(c / (b - a) * SCALE, 1))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, held_out: int = 0, most_positive: int = 1500, most_unlabelled: int = 4000, default_prior: float = 0.1, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Fitting takes at most most_positive toxic texts and most_unlabelled texts of the whole corpus, of any length, all
    outside the held-out fold (crc32 of the id modulo modulus), by a hash of the id. The class prior is the share of
    label 1 among all labels of the other folds. Scores see nothing but the whole text; null and empty texts get the
    intercept's score, as do texts without words. With no toxic example every score is near 0. Rows with a null id are
    scored (their fold is that of empty text) but not learned from; repeated rows get equal scores, rows of one id
    each by its own text, and of several labels of an id the largest counts. Scores may tie; predicted is 1 from 0.5
    on. A very long text is one row's work. Without documents there are no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    known = training_labels(labels, id_col, label_col, modulus, held_out)
    counts = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"), F.min("y").alias("least")).first()
    prior = counts["p"] / counts["n"] if counts["n"] and counts["least"] == 0 else default_prior
    toxic = first_by_hash(known.where("y = 1").select("id"), most_positive)
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull() & (fold("id", modulus) != held_out)).distinct()
    chosen = toxic.select("id", F.lit(1).alias("p")).union(first_by_hash(ids, most_unlabelled).select("id", F.lit(0).alias("p")))
    found = features_of(docs, chosen.groupBy("id").agg(F.max("p").alias("p"), F.min("p").alias("u")), id_col, text_col, _features, "buckets array<int>, values array<float>")
    p, u = (found.filter(pc.equal(found[c], k)) for c, k in (("p", 1), ("u", 0)))
    model = spark.sparkContext.broadcast(fit(p, u, prior, **settings))
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_scores, model=model), _schema(docs, id_col))
    return scored.select("doc_id", (fold("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _schema(docs: DataFrame, id_col: str) -> str:
    return f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double"
