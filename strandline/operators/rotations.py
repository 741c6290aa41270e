"""The widest angle between rotations, found by branch and bound over cells of the 3-sphere.

Unit quaternions q and -q are one rotation, so of each the one in a half sphere stands for both. Vectors are split at
medians into a balanced tree of cells, each with a centre and an angular radius. Two cells hold no pair wider than the angle between their
centres plus both radii; pairs of cells that can't beat the widest pair found so far go, whole branches at a time, and of
what is left the leaves are multiplied. The result is that of all pairs: only pairs that are too narrow aren't made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import ship

#: Vectors of a leaf; up to SMALL of them are simply multiplied. Pairs of cells that are looked at together.
LEAF, SMALL, PAIRS = 64, 512, 1 << 16
#: Products that are held at once; leaves are larger where a large tree meets a small one.
PRODUCTS = 1 << 20
#: What rounding may take from an angle that comes from a cosine near 1.
SLACK = 1e-7
#: More than rounding by a product of matrices may take from a product of two unit vectors; norms this near 1 are 1.
NEAR, UNIT = 4e-15, 1e-15


def _least(m: np.ndarray, u: np.ndarray, v: np.ndarray, best: float) -> float:
    """The least |u[.., i, :] . v[.., j, :]|, or best if that is less, where m[.., i, j] is that product as a product of matrices gives it (inf: no pair).

    Such a product rounds a pair by where it stands in the matrices, so pairs that may be the least are added up again entry by entry:
    the result depends on the vectors alone, and is the one of plain arithmetic."""
    least = float(m.min(initial=np.inf))
    if least > best + NEAR:
        return best
    some = np.flatnonzero(m <= min(least, best) + NEAR)
    for k in range(0, len(some), PAIRS):
        *of, i, j = np.unravel_index(some[k : k + PAIRS], m.shape)
        p = u[(*of, i)] * v[(*of, j)]
        best = min(best, float(np.abs(p[:, 0] + p[:, 1] + p[:, 2] + p[:, 3]).min()))
    return best


def _tree(q: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Leaves (2**depth of equal size, 4), and of each level of the tree, the root's first, centres and radii of its cells."""
    parts = [q]
    for _ in range(depth):
        split = []
        for x in parts:
            at = len(x) // 2
            order = np.argpartition(x[:, np.argmax(np.ptp(x, axis=0))], at)
            split += [x[order[:at]], x[order[at:]]]
        parts = split
    size = max(map(len, parts))
    leaves = np.stack([x[np.arange(size) % len(x)] for x in parts])  # repeats of a vector make no wider pair
    centres, radii, cells = [], [], leaves
    for _ in range(depth + 1):
        c = cells.mean(1)
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-300)
        cosine = np.einsum("kij,kj->ki", cells, c).min(1)
        centres.insert(0, c)
        radii.insert(0, np.arccos(np.clip(cosine, -1, 1)) + SLACK)
        cells = cells.reshape(len(cells) // 2, -1, 4) if len(cells) > 1 else cells
    return leaves, centres, radii


def _halved(q: np.ndarray) -> np.ndarray:
    """Each vector or its opposite, whichever has a first entry that isn't 0 above 0."""
    first = np.argmax(q != 0, axis=1)
    return q * np.where(q[np.arange(len(q)), first] < 0, -1.0, 1.0)[:, None]


def _searched(one: tuple, two: tuple, same: bool, best: float) -> float:
    """The least |u . v| of u in one tree and v in the other, which are as deep, or best if that is less. same: they are one
    tree, of which each pair of cells counts once."""
    (a_leaves, a_centres, a_radii), (b_leaves, b_centres, b_radii) = one, two
    todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        between = np.arccos(np.clip(np.abs((a_centres[level][i] * b_centres[level][j]).sum(1)), 0, 1))
        widest = between + a_radii[level][i] + b_radii[level][j] + SLACK
        keep = widest >= np.arccos(best)
        i, j, widest = i[keep], j[keep], widest[keep]
        if not len(i):
            continue
        if level + 1 < len(a_centres):
            a, b = (2 * i[:, None] + np.array([0, 0, 1, 1])).ravel(), (2 * j[:, None] + np.array([0, 1, 0, 1])).ravel()
            if same:
                a, b = a[a <= b], b[a <= b]
            todo += [(level + 1, a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)]
            continue
        order = np.argsort(-widest)  # the most promising first
        step = max(1, PRODUCTS // (a_leaves.shape[1] * b_leaves.shape[1]))
        for k in range(0, len(order), step):
            some = order[k : k + step]
            if widest[some[0]] < np.arccos(best):
                break
            u, v = a_leaves[i[some]], b_leaves[j[some]]
            m = u @ v.transpose(0, 2, 1)
            best = _least(np.abs(m, out=m), u, v, best)
    return best


def _depth(n: int) -> int:
    return max(0, int(np.ceil(np.log2(n / LEAF))))


def least_product(q: np.ndarray, best: float = 1.0) -> float:
    """The least |u . v| of all pairs of the unit vectors in the rows of q (n, 4), or best if that is less."""
    if len(q) <= SMALL:
        m = np.abs(q @ q.T)
        m[np.tri(len(q), dtype=bool)] = np.inf
        return _least(m, q, q, best)
    tree = _tree(_halved(q), _depth(len(q)))
    sample = tree[0][:, 0]
    for k in range(0, len(sample), 512):  # a pair of different leaves, of which there are some
        m = np.abs(sample[k : k + 512] @ sample.T)
        m[np.arange(len(m)), np.arange(k, k + len(m))] = np.inf
        best = _least(m, sample[k : k + 512], sample, best)
    return _searched(tree, tree, True, best)


def least_between(p: np.ndarray, q: np.ndarray, best: float = 1.0) -> float:
    """The least |u . v| of u in the rows of p and v in those of q, or best if that is less."""
    if min(len(p), len(q)) <= LEAF:
        for k in range(0, len(p), SMALL):
            best = _least(np.abs(p[k : k + SMALL] @ q.T), p[k : k + SMALL], q, best)
        return best
    depth = _depth(min(len(p), len(q)))
    one, two = _tree(_halved(p), depth), _tree(_halved(q), depth)
    u, v = one[0][:, 0], two[0][:, 0]
    return _searched(one, two, False, _least(np.abs(u @ v.T), u, v, best))


def widest_angle(q: np.ndarray, tolerance: float = 1e-3) -> float:
    """2 acos of the least |u . v| of unit quaternions in the rows of q; 0 for fewer than two or where one isn't finite.

    Norms that are off 1 by more than the tolerance are an error. Vectors whose norm is 1 but for rounding stay as they are."""
    if len(q) < 2 or not np.isfinite(q).all():
        return 0.0
    norms = np.sqrt((q * q).sum(1, keepdims=True))
    if (np.abs(norms - 1) > tolerance).any():
        raise ValueError("quaternions must have norm 1")
    norms[np.abs(norms - 1) <= UNIT] = 1.0
    return 2 * math.acos(min(least_product(q / norms), 1.0))


def turned(half: Column) -> Column:
    """The rotation about the first axis by twice that angle, as a quaternion; of the C library's cosine and sine, from which Spark's own
    differ in the last bit for some angles."""

    def quaternions(angles: pa.Array) -> pa.Array:
        q = np.zeros((len(angles), 4))
        x = angles.to_numpy(zero_copy_only=False).tolist()
        q[:, 0], q[:, 1] = [math.cos(v) for v in x], [math.sin(v) for v in x]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * 4), pa.array(q.ravel()))

    return F.arrow_udf(quaternions, "array<double>")(half)


def widest_angles_of(vectors: Column, tolerance: float = 1e-3) -> Column:
    """The widest angle of each array of quaternions (arrays of four; another length gives 0); 0 for null."""

    def angles(lists: pa.Array) -> pa.Array:
        out = []
        for k in range(len(lists)):
            x = lists[k].values if lists[k].is_valid else None
            if x is None or len(x) < 2 or set(x.value_lengths().to_pylist()) != {4}:
                out.append(0.0)
                continue
            out.append(widest_angle(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4), tolerance))
        return pa.array(out, pa.float64())

    return F.arrow_udf(angles, "double")(vectors)


#: Parts of each axis by which the vectors of a large group fall into cells, vectors of a chunk of a cell, and how many of
#: these give a first idea of how wide the group is.
PARTS, CHUNK, SAMPLE = 4, 1 << 15, 16


def _box_bounds(lo: np.ndarray, hi: np.ndarray, i: int) -> np.ndarray:
    """Of box i and each box: the least |u . v| that any u and v in them could have."""
    ends = np.stack([lo[i] * lo, lo[i] * hi, hi[i] * lo, hi[i] * hi])
    least, most = ends.min(0).sum(1), ends.max(0).sum(1)
    return np.where((least <= 0) & (most >= 0), 0.0, np.minimum(np.abs(least), np.abs(most)))


def rotation_ranges(rows: DataFrame, by: list[str], vector: str, tolerance: float = 1e-3, chunk: int = CHUNK) -> DataFrame:
    """by, angle: widest_angle of the quaternions of each group, of any size; 0 for fewer than two, or where one isn't
    finite or no array of four. Null vectors are left out; norms that are off 1 by more than the tolerance are an error.

    Vectors fall into cells, large cells into chunks, which are packed where they lie. A task for each group sees the bounds and a
    few vectors of each chunk and drops the pairs of chunks that can't hold a wider pair than these few do; the pairs that are left
    meet in tasks of their own, each a branch and bound."""
    ship(rows.sparkSession)
    kinds = [rows.schema[c] for c in by]
    q = F.transform(vector, lambda v: v.cast("double"))
    x = rows.where(F.col(vector).isNotNull()).select(*by, q.alias("q"))
    good = F.coalesce((F.size("q") == 4) & F.forall("q", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    groups = x.groupBy(*by).agg(F.count("*").alias("n"), F.every(good).alias("good"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v))
    x = x.where(good).withColumn("norm", norm)
    x = x.withColumn("q", F.when(F.abs(F.col("norm") - 1) > tolerance, F.raise_error(F.lit("quaternions must have norm 1")).cast("array<double>")).otherwise(F.transform("q", lambda v: v / F.col("norm"))))
    sign = F.coalesce(F.get(F.filter("q", lambda v: v != 0), F.lit(0)), F.lit(1.0)) < 0
    # a frequent vector is one: what equals it is no wider pair with it than it is with itself
    x = x.select(*by, F.when(sign, F.transform("q", lambda v: -v)).otherwise(F.col("q")).alias("q")).distinct()
    place = F.aggregate("q", F.lit(0), lambda a, v: a * PARTS + F.least(F.lit(PARTS - 1), F.floor((v + 1) * PARTS / 2)).cast("int"))
    x = x.withColumn("cell", place)
    sizes = x.groupBy(*by, "cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).withColumnRenamed("cell", "of")
    same = F.col("cell") == F.col("of")
    for c in by:
        sizes = sizes.withColumnRenamed(c, f"of_{c}")
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    x = x.join(F.broadcast(sizes.where("chunks > 1")), same, "left")  # a row for each chunk vectors at least
    x = x.select(*by, F.xxhash64("cell", F.pmod(F.xxhash64("q"), F.coalesce("chunks", F.lit(1)))).alias("part"), "q")

    def pack(group: pa.Table) -> pa.Table:
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group["q"].chunks]).reshape(-1, 4)
        some = v[np.linspace(0, len(v) - 1, min(SAMPLE, len(v))).astype(int)]
        bounds = np.stack([v.min(0), v.max(0)])
        out = group.select([*by, "part"]).slice(0, 1)
        for name, data in (("v", v), ("bounds", bounds), ("some", some)):
            out = out.append_column(name, pa.array([data.tobytes()], pa.binary()))
        return out

    packed = x.groupBy(*by, "part").applyInArrow(pack, StructType([*kinds, *StructType.fromDDL("part long, v binary, bounds binary, some binary").fields]))

    def pairs(group: pa.Table) -> pa.Table:
        part = group["part"].to_numpy()
        bounds = np.stack([np.frombuffer(b).reshape(2, 4) for b in group["bounds"].to_pylist()])
        few = np.concatenate([np.frombuffer(b).reshape(-1, 4) for b in group["some"].to_pylist()])
        best = least_product(few) if len(few) > 1 else 1.0
        i = [(k, j) for k in range(len(part)) for j in np.flatnonzero(_box_bounds(bounds[:, 0], bounds[:, 1], k) <= best + 1e-12) if j >= k]
        head = group.select(by).slice(0, 1).to_pylist()[0]
        return pa.table({**{c: pa.array([head[c]] * len(i), group.schema.field(c).type) for c in by}, "a": part[[k for k, _ in i]] if i else pa.array([], pa.int64()), "b": part[[j for _, j in i]] if i else pa.array([], pa.int64()), "best": pa.array([best] * len(i), pa.float64())})

    wanted = packed.select(*by, "part", "bounds", "some").groupBy(*by).applyInArrow(pairs, StructType([*kinds, *StructType.fromDDL("a long, b long, best double").fields]))
    key = F.struct(*by)
    sides = [packed.select(key.alias(f"key_{s}"), F.col("part").alias(s), F.col("v").alias(f"v_{s}")) for s in "ab"]
    met = wanted.withColumn("key_a", key).withColumn("key_b", key).join(sides[0], ["key_a", "a"]).join(sides[1], ["key_b", "b"])

    def least(batches):
        for batch in batches:
            found = []
            for r in range(batch.num_rows):
                a, b, v, w, best = (batch.column(c)[r].as_py() for c in ("a", "b", "v_a", "v_b", "best"))
                p = np.frombuffer(v).reshape(-1, 4)
                found.append(least_product(p, best) if a == b else least_between(p, np.frombuffer(w).reshape(-1, 4), best))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(found, pa.float64())], [*by, "least"])

    each = met.select(*by, "a", "b", "v_a", "v_b", "best").mapInArrow(least, StructType([*kinds, *StructType.fromDDL("least double").fields]))
    of = each.groupBy(*by).agg(F.min("least").alias("least")).select(key.alias("key"), "least")
    out = groups.withColumn("key", key).join(of, "key", "left")
    return out.select(*by, F.when((F.col("n") < 2) | ~F.col("good"), 0.0).otherwise(2 * F.acos(F.least(F.lit(1.0), "least"))).alias("angle"))
