"""Whitening, prefix tries and SimHash against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import near_dedup, prefix_trie, simhash, whitening
from strandline.llm.queries import queries

# SimHash


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_bits(spark, texts, width=3):
    """Fingerprints by Spark's own XXH64, a bit at a time."""
    rows = [(i, " ".join(w[k : k + width])) for i, t in enumerate(texts) if (w := words_of(t)) for k in range(max(1, len(w) - width + 1))]
    out = [0] * len(texts)
    for i, hashes in spark.createDataFrame(rows, "i long, s string").groupBy("i").agg(F.collect_list(F.xxhash64("s"))).collect():
        out[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out


def components(rows, distance):
    """Least id that links reach, every pair compared."""
    at = {i: i for i, _ in rows}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for x, fx in rows:
        for y, fy in rows:
            if (fx ^ fy).bit_count() <= distance:
                a, b = sorted((top(x), top(y)))
                at[b] = a
    return {i: top(i) for i in at}


def test_fingerprints(spark, odd):
    texts = [r["text"] for r in odd.collect()]
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.near_duplicates(odd).collect()}
    want = by_bits(spark, texts)
    assert got == {(r["doc_id"], f"{f:016x}") for r, f in zip(odd.collect(), want, strict=True)}
    assert simhash.fingerprint("") == simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    text = " ".join(texts[6].split()[:5000])
    for size in (1, 7, 1000):
        assert simhash.fingerprint(text, block_bytes=size) == simhash.fingerprint(text)


def test_half_of_the_hashes_is_not_over_half(monkeypatch):
    given = iter([0b11, 0b01])
    monkeypatch.setattr(simhash.xxhash, "xxh64_intdigest", lambda data, seed: next(given))
    assert simhash.fingerprint("a b c d") == 0b01


@pytest.mark.parametrize(("small", "distance"), [(64, 2), (3, 2), (1, 2), (1, 1), (2, 3)])
def test_links_of_fingerprints(spark, small, distance):
    rnd = random.Random(small * 10 + distance)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(64), n))
    found = {flip(c, rnd.randint(0, 5)) for c in centres for _ in range(15)} | {0, 1, 3, 7, (1 << 64) - 1, (1 << 63) - 1}
    rows = [(i, f) for i, f in enumerate(sorted(found, key=lambda _: rnd.random()))]
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in rows], "fp long")
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(nodes, distance, small).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in pairs)
    index = {f: i for i, f in rows}
    at = {i: i for i, _ in rows}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(index[a]), top(index[b])))
        at[y] = x
    assert {i: top(i) for i in at} == components(rows, distance)
    if small == 64:  # all of them, not only those by which groups hang together
        assert {frozenset(p) for p in pairs} == {frozenset((x, y)) for x in found for y in found if x != y and (x ^ y).bit_count() <= distance}


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_segments_differ_in_one_bit_at_most(distance):
    parts = simhash.segments(distance)
    assert sum(n for _, n in parts) == 64 and [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    assert distance // len(parts) <= 1


def test_what_an_explode_makes_is_not_broadcast(spark, capsys):
    # Spark takes its size for that of the table it comes of: 64 signatures a node, or every shingle of a set
    nodes = spark.range(100).withColumnRenamed("id", "fp")
    sets = spark.range(100).select(F.lit(1).alias("crowd"), F.col("id").alias("node"), F.sequence(F.lit(1), F.lit(500)).alias("shingles"))
    for made in (simhash._shared(nodes, 2), near_dedup._places(sets, 80)):
        made.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("small", [64, 1])
def test_simhash_of_documents(spark, odd, empty, small):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [rnd.choice(vocabulary) for _ in range(200)]
    texts = []
    for k in range(40):
        copy = list(base)
        for _ in range(k % 4):
            copy[rnd.randrange(200)] = rnd.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [None, "", "!", "a b", "A  B", " ".join(rnd.choice(vocabulary) for _ in range(50))]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (60, texts[0])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=small).collect()
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(i or -1 for i, _ in rows)
    known = [(i, f) for (i, t), f in zip(rows, by_bits(spark, [t for _, t in rows]), strict=True) if i is not None]
    want = components(known[:-1], 2)  # 60 and 100 have one text, and 60 is another one's id, too
    assert want[100] <= 100
    for r in got:
        assert r["doc_id"] is not None or r["component_id"] is None
    links = {r["fingerprint"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert len({(r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None}) == len(links)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] not in (None, 60, 100)}.items() <= {i: min(c, 60) if want[i] == want[100] else c for i, c in want.items()}.items()
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(odd).count() == odd.count()


def test_simhash_of_tables(spark, table):
    docs = table("documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    prints = by_bits(spark, [t for _, t in rows])
    want = components([(i, f) for (i, _), f in zip(rows, prints, strict=True)], 2)
    got = queries()["op13_simhash"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{f:016x}", want[i]) for (i, _), f in zip(rows, prints, strict=True)}
    assert len(got) == len(rows)


def test_distances_that_cannot_be_indexed(odd):
    with pytest.raises(ValueError, match="distance"):
        simhash.near_duplicates(odd, distance=4)


# Whitening


def whole(vectors):
    return [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]


def brute(vectors, k=8):
    """Deviations, variances, components, by exact sums and a covariance with entries rounded once."""
    x = whole(vectors)
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    away = [sum((n * r[j] - total[j]) ** 2 for j in range(d)) for r in x]
    cov = np.array([[float(Fraction(sum((n * r[i] - total[i]) * (n * r[j] - total[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    values, found = np.linalg.eigh(cov)
    values, found = values[::-1][:k], found[:, ::-1][:, :k]
    centred = np.array([[float(Fraction(n * r[j] - total[j], n)) for j in range(d)] for r in x])
    return n, away, centred @ found / np.sqrt(values), values / np.trace(cov)


def same_but_for_sign(a, b):
    signs = np.sign((a * b).sum(0))
    assert np.allclose(a * signs, b, rtol=1e-7, atol=1e-9)


def test_whitening_of_tables(spark, table):
    rows = table("embeddings").orderBy("vec_id").collect()
    n, away, white, shares = brute([r["embedding"] for r in rows])
    got = queries()["op11_whitening"](spark, "/root/testdata/sf0.001").orderBy("vec_id", "component").collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got[::8]] == away
    same_but_for_sign(np.array([r["whitened"] for r in got]).reshape(n, 8), white)
    assert np.allclose([r["explained"] for r in got[:8]], shares, rtol=1e-9)
    assert {r["component"] for r in got} == set(range(1, 9)) and all(r["identity_error"] < 1e-9 for r in got)


def test_vectors_that_cannot_be_used(spark):
    rnd = random.Random(5)
    good = [[rnd.gauss(3 * j, 1 + j) for j in range(5)] for _ in range(60)]
    good[7] = list(good[3])  # a tie
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [nan] * 5, [1.0, 2.0, inf, 3.0, 4.0], [-inf] * 5, [1.0, 2.0], [1.0] * 6]
    rows = [(i, v, 1, "r", 2.0) for i, v in enumerate(good)] + [(100 + i, v, 1, "r", 2.0) for i, v in enumerate(bad)] + [(None, good[0], None, None, None)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, row string, whitened double").repartition(7)
    n, away, white, _ = brute([*good, good[0]])
    got = whitening.whitening_report(given, components=9).orderBy("vec_id", "component").collect()
    assert len(got) == 5 * n  # there are no more components than dimensions
    first, rest = got[:5], got[5:]
    assert {r["vec_id"] for r in first} == {None} and [r["deviation"] for r in rest[::5]] == away[:-1]
    same_but_for_sign(np.array([r["whitened"] for r in [*rest, *first]]).reshape(n, 5), white)
    some, model = whitening.whiten(given)
    assert model.n == n and some.select("row.row", "row.n", "row.whitened").count() == n


def test_vectors_without_variance(spark):
    make = lambda rows: whitening.whitening_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).count() == make([(1, None)]).count() == 0
    one = make([(1, [1.0, 2.0])]).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    flat = make([(k, [float(k), 5.0]) for k in range(10)]).orderBy("vec_id", "component").collect()
    assert all(r["whitened"] is not None for r in flat[::2]) and all(r["whitened"] is None for r in flat[1::2])
    assert flat[0]["explained"] == pytest.approx(1) and flat[0]["identity_error"] < 1e-9


def test_deviations_of_any_size():
    x = np.array([[1 << 40, -(1 << 41)], [3, 1 << 42]], np.int64)
    model = whitening.Whitening(1 << 30, [(1 << 69) + 1, -5], np.eye(2), np.ones(2), np.ones(2))
    assert list(model.deviations(x)) == [sum(((1 << 30) * int(v) - s) ** 2 for v, s in zip(r, model.sums, strict=True)) for r in x]


def test_moments_merge():
    rows = np.random.default_rng(1).normal(1e6, 3, (500, 4))
    parts = [whitening.Moments.of(rows[a:b]) for a, b in ((0, 1), (1, 200), (200, 500))]
    merged = whitening.Moments().merge(parts[2]).merge(parts[0]).merge(parts[1])
    assert merged.n == 500 and np.allclose(merged.outer / 500, np.cov(rows.T, bias=True), rtol=1e-9)


def test_sums_are_exact(spark):
    rows = [(i, [(-1.0) ** i * 2.0**41 + i, 0.5]) for i in range(200)]
    model = whitening.fit(spark.createDataFrame(rows, "i long, v array<double>").repartition(9), "v")
    x = [[int(c * 1024) + 100_000 for c in v] for _, v in rows]
    assert model.sums == [sum(r[j] for r in x) for j in range(2)]


# Prefix tries


def brute_trie(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = c - int(np.fmod(c, 20))
        rebuilt[c] = tuple(own.get(rest, [])[:h] + turns[h:])
    members = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], set()).add(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], set()).add(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == p)
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())), sum(q not in children for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows, **settings):
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(given, **settings).drop("node", "parent").collect()), key=str)


@pytest.mark.parametrize("family_nodes", [20_000, 3, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_tries(spark, seed, family_nodes):
    rnd = random.Random(seed)
    texts = ["hello", "hello there", "a b c", "", None, "x y z"]
    rows = []
    for c in rnd.sample(range(-45, 130), 90):
        if rnd.random() < 0.5:
            rows += [(c, k, "user", f"common {k}") for k in range(rnd.randint(1, 6))]
        else:
            rows += [(c, rnd.choice([None, 1, 2, 3, 3]), rnd.choice(["user", "bot", None, ""]), rnd.choice(texts)) for _ in range(rnd.randint(1, 5))]
    rows += [(None, 1, "user", "nobody"), *rows[:3]]
    rows += [(200, k, "user", f"long {k}") for k in range(300)] + [(203, k, "user", f"long {k}") for k in range(250)]
    rnd.shuffle(rows)
    assert trie_of(spark, rows, family_nodes=family_nodes) == brute_trie(rows)


def test_tries_of_odd_rows(spark):
    assert trie_of(spark, []) == trie_of(spark, [(None, 1, "a", "b")]) == []
    # without a base conversation there may be no turns at all
    alone = next(c for c in range(1, 20) if prefix_trie.begun(c) == 3)
    assert trie_of(spark, [(alone, 1, "user", "hi")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    long = [(1, 0, "user", "word " * 200_000), (1, 1, None, None), (1, None, "x", "first")]
    clash = spark.createDataFrame([(*r, 1, b"n", [2], 3) for r in long], "conv_id long, turn long, role string, text string, base long, node binary, members array<long>, depth long")
    assert sorted((tuple(r) for r in prefix_trie.trie_report(clash).collect()), key=str) == brute_trie(long)


def test_parts_of_roles_and_texts_differ():
    assert prefix_trie.child(prefix_trie.ROOT, "ab", b"c") != prefix_trie.child(prefix_trie.ROOT, "a", b"bc")


def test_many_conversations_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_BITS", 3)
    rows = [(c, k, "user", f"same {k}") for c in [*range(-30, 60), 10**18, 10**18 + 1, -(10**18)] for k in range(4)]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_digests_over_batches():
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ids"])
    got = [tuple(r.values()) for b in prefix_trie._digests(iter([make([(b"a", "1,2"), (b"a", "3")]), make([]), make([(b"a", "4"), (b"b", "5")])])) for r in b.to_pylist()]
    assert got == [(b"a", hashlib.sha256(b"1,2,3,4").hexdigest()), (b"b", hashlib.sha256(b"5").hexdigest())]
