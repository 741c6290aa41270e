"""Operators on texts against brute force, exact round trips and the library."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from strandline.llm import chunks, decontaminate, near_dedup, pieces, rules, textbytes, warc
from strandline.llm.components import connected_components
from strandline.llm.textbytes import ALNUM, SPACED, Words, buffers

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def collect(df):
    return df.select("doc_id", "text").collect()


@pytest.mark.parametrize(("table", "words"), [(SPACED, spaced), (ALNUM, alnum)])
def test_words(odd, table, words):
    texts = [r["text"] for r in collect(odd)]
    data, off = buffers(pa.array(texts))
    w = Words(data, off, table)
    want = [words(t) for t in texts]
    assert (w.of[1:] - w.of[:-1]).tolist() == [len(x) for x in want]
    by_word = defaultdict(set)
    for h, x in zip(w.hashes.tolist(), (y for x in want for y in x), strict=True):
        by_word[x].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({h for x in by_word.values() for h in x}) == len(by_word)


def thue_morse(steps, a="a", b="b"):
    """Two words of 2**steps letters that a polynomial modulo 2**64 can't tell apart at any odd base, from 10 steps on."""
    x = a
    for _ in range(steps):
        x += x.translate(str.maketrans(a + b, b + a))
    return x, x.translate(str.maketrans(a + b, b + a))


def test_products_modulo_the_prime():
    rnd = random.Random(2)
    a, b = ([0, 1, textbytes.PRIME - 1, *(rnd.randrange(textbytes.PRIME) for _ in range(300))] for _ in range(2))
    rnd.shuffle(b)
    assert textbytes.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % textbytes.PRIME for x, y in zip(a, b, strict=True)]
    assert textbytes.powers(300).tolist() == [pow(textbytes._BASE, k, textbytes.PRIME) for k in range(300)]
    at = np.array([0, 1, 65_535, 65_536, 10**7 + 3])
    assert textbytes.divided(np.full(5, 7, np.uint64), at).tolist() == [7 * pow(textbytes._BASE, -int(k), textbytes.PRIME) % textbytes.PRIME for k in at]


@pytest.mark.parametrize("exact", [1 << 23, 5, 100])
def test_hashes_are_polynomials(monkeypatch, exact):
    monkeypatch.setattr(textbytes, "_EXACT", exact)
    rnd = random.Random(4)
    values = [rnd.randrange(1, 256) for _ in range(700)]
    large = [rnd.randrange(textbytes.PRIME) for _ in range(700)]
    starts = np.array([rnd.randrange(700) for _ in range(200)])
    ends = np.array([rnd.randint(s, 700) for s in starts])
    poly = lambda x: sum(v * pow(textbytes._BASE, k, textbytes.PRIME) for k, v in enumerate(x)) % textbytes.PRIME
    for x, kind, whole in ((values, np.uint8, False), (large, np.uint64, True)):
        got = textbytes.Prefixes(np.array(x, kind), whole).hash(starts, ends)
        assert got.tolist() == [poly(x[s:e]) for s, e in zip(starts, ends, strict=True)]


def test_words_and_sequences_that_are_built_to_collide(spark):
    one, other = thue_morse(11)
    rest = " ".join(f"w{k}" for k in range(9))
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {rest}"), (4, f"{other} {rest}")], "doc_id long, text string")
    assert [(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs, width=4).orderBy("doc_id").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    items = spark.createDataFrame([("x", one), ("y", f"{one} {rest}")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.leak_report(docs, items).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (10, 2), 4: (0, 0)}
    # the same with words for letters
    first, second = (" ".join(x) for x in thue_morse(11))
    docs = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    items = spark.createDataFrame([("x", first)], "item_id string, text string")
    got = {r["doc_id"]: [m.asDict() for m in r["matches"]] for r in decontaminate.find_leaks(docs, items, width=2048).select("row.doc_id", "matches").collect()}
    assert got == {1: [{"item_id": "x", "item_start": 0, "start": 0, "length": 2048}], 2: []}
    # chunks of words that collide are no repeats of each other
    prose = " ".join(f"{w}{k}" for k in range(100) for w in (one, "a", "bc"))
    docs = spark.createDataFrame([(1, prose), (2, prose.replace(one, other))], "doc_id long, text string")
    assert {r["n_removed"] for r in chunks.repeat_report(docs).collect()} == {0}


def groups(rows, width, percent=80):
    """component by document, every pair compared."""
    sets, at = {}, {}
    for i, (d, t) in enumerate(rows):
        w = spaced(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        at[i] = i

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None:
            continue
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            at[top(j)] = top(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), -1 if d is None else least[top(i)]) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def test_near_duplicates(odd, empty, table):
    assert found(near_dedup.near_duplicates(odd)) == groups(collect(odd), 5)
    docs = table("documents")
    got = near_dedup.near_duplicates(docs, width=4)
    assert found(got) == groups(collect(docs), 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.first_of_each_group(odd)
    assert kept.columns == odd.columns and {8, 9}.isdisjoint(r["doc_id"] for r in kept.collect())


@pytest.mark.parametrize("small", [1, 3, 16])
def test_large_groups_of_near_duplicates(spark, monkeypatch, small):
    """Chains, and texts that share boilerplate only, whichever way a table's pairs are found."""
    for name, value in (("SMALL", small), ("LEADS", 2), ("BLOCK", 5)):
        monkeypatch.setattr(near_dedup, name, value)
    rnd = random.Random(3)
    base = [[f"w{rnd.randint(0, 10**6)}" for _ in range(120)] for _ in range(2)]
    rows = []
    for i in range(70):
        t = list(base[i % 2])
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randint(0, 119)] = f"v{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(t)))
    for i in range(30):  # each follows from the one before by a few words
        base[0] = [*base[0][3:], *(f"u{i}{k}" for k in range(3))]
        rows.append((100 + i, " ".join(base[0])))
    for i in range(40):
        rows.append((200 + i, " ".join([*base[1][:80], *(f"x{i}{k}" for k in range(30 - i // 2))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_dedup.near_duplicates(df)) == groups(rows, 5)


def test_an_id_with_several_texts(spark):
    rnd = random.Random(8)
    a, b = ([f"{c}{rnd.randint(0, 10**6)}" for _ in range(100)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "z"])), (3, " ".join([*b, "z"])), (4, " ".join([*a, "z"])), (5, "one two")]
    for order in (rows, rows[::-1], [rows[k] for k in (1, 3, 0, 5, 2, 4)]):
        for parts in (1, 3):
            got = near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(parts))
            assert found(got) == groups(rows, 5) and {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_places_where_similar_sets_meet(spark):
    """Whatever their sizes, two sets as similar as asked share an index place of the smaller and a probe place of the larger."""
    rnd = random.Random(12)
    sets = []
    for k in range(150):
        s = set(rnd.sample(range(60), rnd.randint(3, 40))) if k % 5 == 0 or not sets else set(sets[-1])
        for x in list(s)[: rnd.randint(0, 2)]:
            s.discard(x)
        sets.append(s | {rnd.randint(0, 200)})
    sets = [s for s in {frozenset(s) for s in sets}]
    df = spark.createDataFrame([(b"c", bytes([k]), sorted(s)) for k, s in enumerate(sets)], "crowd binary, node binary, shingles array<long>")
    met = defaultdict(list)
    for r in near_dedup._places(df, 80).collect():
        met[r["shingle"]].append((bytes(r["node"])[0], r["index"]))
    pairs = {tuple(sorted((a, b), key=lambda k: (len(sets[k]), k))) for x in met.values() for a, i in x for b, _ in x if a != b and i and (len(sets[a]), a) < (len(sets[b]), b)}
    similar = 0
    for a, b in combinations(range(len(sets)), 2):
        a, b = sorted((a, b), key=lambda k: (len(sets[k]), k))
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            similar += 1
            assert (a, b) in pairs
    assert similar > 30


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    at = list(range(600))
    top = lambda i: i if at[i] == i else top(at[i])
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        at[b] = a
    want = {i: top(i) for x in links if x[0] != x[1] for i in x}
    got = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(want)


def leaks(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(None if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, ids = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= x - {None}
        out.append((str(d), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_leaks(spark, odd, empty, table, block):
    items = [(1, None), (2, ""), (3, "one"), (None, "Two words"), (4, "two words"), (4, "two words")] + [(10 + r["doc_id"], r["text"][:300]) for r in odd.where("doc_id in (6, 7)").collect()]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = lambda docs, bench: sorted((str(r["doc_id"]), *r[1:]) for r in decontaminate.leak_report(docs, bench, block_bytes=block).collect())
    assert got(odd, b) == leaks(collect(odd), items)
    bench = table("benchmark")
    assert got(table("documents"), bench) == leaks(collect(table("documents")), [tuple(r) for r in bench.collect()])
    assert decontaminate.leak_report(empty, b).count() == 0 and decontaminate.leak_report(odd, b.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.without_leaks(odd, b)
    assert kept.columns == odd.columns and {6, 7}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_longest_matches(spark):
    w = [f"w{i}" for i in range(60)]
    d = spark.createDataFrame([(0, " ".join(["x", *w[5:37], "y", *w[:12]]))], "doc_id long, text string")
    b = spark.createDataFrame([("q", " ".join(w))], "item_id string, text string")
    got = decontaminate.find_leaks(d, b).first()["matches"]
    assert sorted((m["item_id"], m["item_start"], m["start"], m["length"]) for m in got) == [("q", 0, 34, 12), ("q", 5, 1, 32)]


def runs_of_words(doc, item, width):
    """(item_start, start, length) of matches that can't be made longer, pair of places by pair."""
    least, out = min(width, len(item)), set()
    for i in range(len(doc)):
        for q in range(len(item)):
            if (i and q and doc[i - 1] == item[q - 1]) or doc[i] != item[q]:
                continue
            n = 0
            while i + n < len(doc) and q + n < len(item) and doc[i + n] == item[q + n]:
                n += 1
            if n >= least:
                out.add((q, i, n))
    return out


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_matches_of_repeated_words(spark, block):
    """Few different words, so that suffixes agree for long and windows repeat within items and documents."""
    rnd = random.Random(block)
    text = lambda n: [rnd.choice("ab" if rnd.random() < 0.9 else "abcd") for _ in range(n)]
    docs = [text(rnd.randint(0, 60)) for _ in range(25)] + [["a"] * 50, ["a", "b"] * 20, [], ["a"] * 9]
    items = [text(rnd.randint(1, 30)) for _ in range(12)] + [["a"] * 30, ["b", "a"] * 9, ["a"], ["c", "d"]]
    d = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(str(k), " ".join(x)) for k, x in enumerate(items)], "item_id string, text string")
    got = decontaminate.find_leaks(d, b, width=6, block_bytes=block).collect()
    assert len(got) == len(docs)
    for r in got:
        doc = docs[r["row"]["doc_id"]]
        want = sorted((str(k), *m) for k, item in enumerate(items) for m in runs_of_words(doc, item, 6))
        assert sorted(tuple(m) for m in r["matches"]) == want
        assert r["n_hit"] == len({i + n for _, _, i, k in want for n in range(k)})


@pytest.mark.parametrize(("block", "gathered"), [(1 << 20, 1 << 20), (400, 1 << 20), (400, 3)])
def test_items_are_those_of_the_matches(spark, monkeypatch, block, gathered):
    monkeypatch.setattr(decontaminate, "_GATHERED", gathered)
    rnd = random.Random(21)
    words = [f"w{k}" for k in range(6)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(f"i{k}", make(rnd.choice([0, 1, 4, 9]))) for k in range(40)] + [("i3", make(6)), (None, make(5)), ("i4", None)]
    texts = [(k, make(rnd.choice([0, 3, 30]))) for k in range(30)] + [(99, None), (99, "w1 w2"), (None, make(20))]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    full = decontaminate.find_leaks(docs, bench, width=4, block_bytes=block).select("row.doc_id", "row.text", "n_words", "n_hit", F.array_distinct(F.transform("matches", lambda m: m["item_id"])).alias("items"))
    some = decontaminate.find_items(docs, bench, width=4, block_bytes=block).select("row.doc_id", "row.text", "n_words", "n_hit", "items")
    shown = lambda df: sorted(((r["doc_id"], r["text"], r["n_words"], r["n_hit"], sorted(r["items"], key=str)) for r in df.collect()), key=str)
    assert shown(full) == shown(some) and any(r[3] for r in shown(some))


def test_a_phrase_of_many_items_and_documents(spark):
    phrase = " ".join(f"p{k}" for k in range(14))
    docs = spark.createDataFrame([(k, f"{phrase} d{k}") for k in range(400)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(f"i{k}", f"b{k} {phrase}") for k in range(1500)], "item_id string, text string")
    began = time.time()
    got = decontaminate.leak_report(docs, bench).groupBy("n_words", "n_hit", "n_items").count().collect()
    assert [tuple(r) for r in got] == [(15, 14, 1500, 400)] and time.time() - began < 60


def test_suffixes_are_in_order():
    rnd = random.Random(3)
    for _ in range(30):
        texts = [[rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 40))] for _ in range(rnd.randint(1, 5))]
        w = Words(*buffers(pa.array([" ".join(t) for t in texts])), ALNUM)
        s = decontaminate.Sequence(w.hashes, w.of)
        h = [w.hashes[a:b].tolist() for a, b in zip(w.of, w.of[1:])]
        suffixes = [(t[k:], at) for at, t, k in ((int(w.of[n]) + k, t, k) for n, t in enumerate(h) for k in range(len(t)))]
        order = decontaminate.SuffixArray(s).order.tolist()
        inside = dict((at, x) for x, at in suffixes)
        assert sorted(order) == sorted(inside) and [inside[k] for k in order] == sorted(x for x, _ in suffixes)


def test_many_equal_words_need_little_memory():
    import tracemalloc

    class Block:
        value = None

    w = Words(*buffers(pa.array([" ".join(["x"] * 10_000)])), ALNUM)
    Block.value = {"hashes": w.hashes, "of": w.of, "ids": ["i"]}
    doc = pa.array([{"text": " ".join(["x"] * 20_000)}])
    batch = pa.RecordBatch.from_arrays([doc, pa.array([[]], pa.list_(decontaminate._MATCH))], ["row", "matches"])
    tracemalloc.start()
    (out,) = decontaminate._leaks(iter([batch]), 10, "text", Block)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    matches = out.column(1).to_pylist()[0]
    # one for each diagonal that has a window on it
    assert out.column(3).to_pylist() == [20_000] and len(matches) == 30_000 - 1 - 2 * 9 and most < 100 << 20


def test_statistics(odd, empty, table):
    for docs in (odd, table("documents")):
        got = sorted((str(r["doc_id"]), *r[1:6]) for r in rules.text_statistics(docs).collect())
        want = []
        for d, t in collect(docs):
            t = t or ""
            w, at = re.findall(r"[^\x20\x09-\x0D]+", t), defaultdict(list)
            for k in range(len(w) - 7):
                at[tuple(w[k : k + 8])].append(k)
            repeated = {k + j for x in at.values() if len(x) > 1 for k in x for j in range(8)}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want.append((str(d), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)))
        assert got == sorted(want)
    assert rules.text_statistics(empty).count() == 0


def test_rules(odd, empty, labels, no_labels, table):
    assert rules.apply_rules(odd, labels).count() == odd.count() and rules.apply_rules(empty, no_labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in rules.apply_rules(odd, no_labels).collect())
    docs, y = table("documents", "/root/testdata/sf0.01"), table("labels", "/root/testdata/sf0.01")
    held = "crc32(cast(doc_id as string)) % 4 = 0"
    x = rules.apply_rules(docs, y.where(f"not ({held})")).join(y.where(held), "doc_id").where("not base_failed").toPandas()
    assert (x["kept"] == (x["quality"] == 1)).mean() > 0.9 and x[x["quality"] == 1]["kept"].mean() > 0.97


def grown_by_hand(rows, bounds):
    """The highest FOIL gain of any condition on rows (bad, statistics), every condition tried on every row."""
    p0, n0 = sum(b for b, _ in rows), sum(1 - b for b, _ in rows)
    best = None
    for k, f in enumerate(rules.FEATURES):
        for bound in bounds[f]:
            for sign in ("<=", ">"):
                kept = [b for b, x in rows if (x[k] <= bound) == (sign == "<=")]
                p, n = sum(kept), len(kept) - sum(kept)
                if p and p0 and n0:
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if gain > (best[0] if best else 1e-9):
                        best = gain, (f, sign, bound)
    return best


def test_conditions_of_rules_by_hand(spark):
    rnd = random.Random(14)
    for _ in range(4):
        rows = [(int(rnd.random() < 0.3), [round(rnd.random(), 2) for _ in rules.FEATURES]) for _ in range(150)]
        rows = [(b, [v + 0.3 * b * (k == 2) for k, v in enumerate(x)]) for b, x in rows]
        df = spark.createDataFrame([(b, *x, True) for b, x in rows], "bad int, " + ", ".join(f"{f} double" for f in rules.FEATURES) + ", grow boolean")
        bounds = rules._bounds(df, 8)
        assert all(b == sorted(set(b)) for b in bounds.values())
        binned = rules._binned(df, bounds)
        gain, condition = rules._best(binned, bounds)
        want = grown_by_hand(rows, bounds)
        assert abs(gain - want[0]) < 1e-9 and condition == want[1]
        # the next condition, on the rows that the first one keeps
        kept = [(b, x) for b, x in rows if (x[rules.FEATURES.index(condition[0])] <= condition[2]) == (condition[1] == "<=")]
        assert df.where(rules.conjunction([condition])).count() == binned.where(rules._within([condition], bounds)).count() == len(kept)
        then, more = rules._best(binned.where(rules._within([condition], bounds)), bounds), grown_by_hand(kept, bounds)
        assert (then is None) == (more is None) and (then is None or abs(then[0] - more[0]) < 1e-9)


def test_a_rule_that_is_learned(spark):
    """Bad texts shout, or repeat words; the list that is learned says so."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(300):
        w = [word() for _ in range(60)]
        if i % 3 == 0:
            w = [x.upper() for x in w] if i % 2 else [w[0], w[1]] * 30
        rows.append((i, " ".join(w), int(i % 3 > 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = rules.text_statistics(df)
    learned = rules.learn(found, df)
    assert {c[0] for rule in learned for c in rule} <= {"upper", "distinct", "repeats"} and len(learned) == 2
    verdicts = found.select("doc_id", rules.verdict(learned).alias("kept")).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) for r in verdicts)


def test_pieces_equal_the_library():
    m, sp = pieces.Model(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(2)
    texts = ["", " ", "   a", " a ", "a  b", "▁", "a▁b", "<s>", "</s> x", "<unk><0x41>", "\n", "\n\n a\n", "日本語", "😀😀 a", "a\x00b", "x" * 300, " " * 40, "�", " ⁇ ", "a\r\nb"]
    texts += ["".join(rnd.choice("abcdefghijklmnop ▁\n<>/s0x1éß中😀.,") for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        want = [*sp.encode(t), m.end]
        assert m.encode(t) == want and m.decode(want) == sp.decode(want)
        assert m.listing(t) == (" ".join(map(str, want)), sp.decode(want))


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5_000)
    m, sp = pieces.Model(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(5)
    for _ in range(200):
        t = " ".join("".join(rnd.choice("abcdé中") for _ in range(rnd.choice([3, 8, 40, 900]))) for _ in range(6))
        assert m.listing(t)[0] == " ".join(map(str, [*sp.encode(t), m.end]))
        for memory in (m.parts, m.listed):
            assert sum(map(len, memory)) <= 5_000 and sum(map(len, memory.before)) <= 5_000


def test_decoding_of_any_ids():
    m, sp = pieces.Model(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(4)
    for _ in range(500):
        ids = [rnd.choice([rnd.randint(0, 31999), rnd.randint(3, 258), 1, 2]) for _ in range(rnd.randint(0, 8))]
        assert m.decode(ids) == sp.decode(ids), ids


def test_encoding_of_tables(odd, empty, table):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for docs in (odd, table("documents")):
        want = []
        for d, t in collect(docs):
            ids = [*sp.encode(t or ""), 2]
            want.append((str(d), len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
        assert sorted((str(r["doc_id"]), *r[1:]) for r in pieces.encoding_report(docs, MODEL).collect()) == sorted(want)
    got = pieces.encode(odd, MODEL).collect()
    assert all(r["ids"] == [*sp.encode(r["row"]["text"] or ""), 2] and r["decoded"] == sp.decode(r["ids"]) for r in got)
    assert pieces.encoding_report(empty, MODEL).count() == 0


def test_repeats_of_passages(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: [word() for _ in range(n)]
    passages, lines = [" ".join(prose(60)) for _ in range(40)], [" ".join(prose(12)) for _ in range(4)]
    rows, holds = [], []
    for i in range(160):
        p = i % 40 if i < 40 or i % 2 else None
        rows.append((i, "\n".join([rnd.choice(lines), " ".join([*prose(rnd.randint(5, 200)), passages[p] if p is not None else "", *prose(rnd.randint(5, 80))])])))
        holds.append(p)
    got = {r["doc_id"]: r for r in chunks.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, caught, again = set(), 0, 0
    for i, p in enumerate(holds):
        again += (dup := p is not None and p in seen)
        caught += dup and got[i]["changed"]
        seen.add(p)
        if not dup:
            assert not got[i]["changed"] and got[i]["kept_text"] == rows[i][1]
        else:  # what is left is the text without one run of words
            t, k = rows[i][1], got[i]["kept_text"]
            assert all(t[s["start"] : s["stop"]].strip() in passages[p] for s in got[i]["removed"]) and len(k) == len(t) - got[i]["removed_bytes"]
    assert caught >= 0.98 * again


def test_repeats_of_odd_documents(odd, empty):
    got = {r["doc_id"]: r for r in chunks.repeat_report(odd.where("doc_id is not null")).collect()}
    assert len(got) == 14 and got[0]["kept_text"] is None and got[1]["kept_text"] == "" and not got[7]["changed"] and got[8]["changed"] and got[9]["changed"]
    out = chunks.without_repeats(odd, length_col="n_chars")
    assert out.columns == odd.columns and out.dtypes == odd.dtypes and out.where("doc_id = 7").count() == 3
    assert chunks.repeat_report(empty).count() == 0


def chunks_by_hand(t):
    """(first word, words) of the chunks of a text: cuts where the hash before a word is the least of seven."""
    w = t.lower().split()
    body, h, hashes = " ".join(w).encode(), 0, []
    for i, b in enumerate(body):
        h = ((h << 1) + int(chunks._GEAR[0 if b == 32 else b])) & 0xFFFF
        if b != 32 and body[i + 1 : i + 2] in (b"", b" "):
            hashes.append(h)
    before = [None, *hashes[:-1]]  # nothing is before the first word
    cuts = [0]
    for k in range(1, len(w)):
        left, right = [before[j] for j in range(max(1, k - 3), k)], [before[j] for j in range(k + 1, min(len(w), k + 4))]
        if all(before[k] < x for x in left) and all(before[k] <= x for x in right):
            cuts.append(k)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(w)]):
        out += [(x, min(24, b - x)) for x in range(a, b, 24)] if w else []
    return out


def removed_by_hand(rows, least=20):
    """Text without runs of repeated chunks, document by document; chunks are told apart by their words."""
    first, out = {}, []
    for d, t in rows:
        w = (t or "").lower().split()
        for a, n in chunks_by_hand(t or ""):
            first[tuple(w[a : a + n])] = min(d, first.get(tuple(w[a : a + n]), d))
    for d, t in rows:
        w, places, seen, run, gone = (t or "").lower().split(), [m.start() for m in re.finditer(r"\S+", t or "")], set(), [], []
        for a, n in [*chunks_by_hand(t or ""), (None, 0)]:
            key = tuple(w[a : a + n]) if n else None
            if n and (first[key] != d or key in seen):
                run.append((a, n))
            else:
                if sum(k for _, k in run) >= least:
                    end = run[-1][0] + run[-1][1]
                    gone.append((places[run[0][0]], places[end] if end < len(w) else len(t)))
                run = []
            seen.add(key)
        for a, b in reversed(gone):
            t = t[:a] + t[b:]
        out.append((d, t))
    return sorted(out, key=str)


def test_chunks_and_removal_by_hand(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    shared = [prose(rnd.randint(10, 90)) for _ in range(8)]
    rows = []
    for i in range(60):
        w = prose(rnd.randint(0, 60)) + rnd.choice([[], rnd.choice(shared), rnd.choice(shared) * 2, ["na"] * rnd.randint(1, 80)]) + prose(rnd.randint(0, 30))
        rows.append((i, "".join(x + rnd.choice([" ", "\n", "  "]) for x in w)))
    rows += [(60, rows[5][1]), (61, None), (62, ""), (63, " \n")]
    texts = [t or "" for _, t in rows]
    w = Words(*buffers(pa.array(texts)), SPACED)
    starts, at = chunks.chunk_starts(w)
    assert [(starts[a:b] - w.of[k]).tolist() for k, (a, b) in enumerate(zip(at, at[1:]))] == [[x for x, _ in chunks_by_hand(t)] for t in texts]
    got = chunks.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["kept_text"]) for r in got), key=str) == removed_by_hand(rows)


def test_repeats_where_an_id_has_several_texts(spark):
    rnd = random.Random(13)
    a, b = (" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(2))
    rows = [(1, a), (2, b), (5, a), (5, b + " tail of another"), (5, b + " tail of another"), (6, "x " + a)]
    for parts in (1, 4):
        got = chunks.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        kept = sorted((r["doc_id"], len(r["kept_text"].split())) for r in got)
        assert kept[:2] == [(1, 60), (2, 60)] and kept[2] == (5, 0) and kept[3] == kept[4] and 3 <= kept[3][1] < 20 and kept[5][1] < 20


def test_gear_hash_by_the_byte():
    texts = ["Hello  World this\nis a test", "", "  x y  zé qqqq wwww ", "one"]
    w = Words(*buffers(pa.array(texts)), SPACED)
    want = []
    for t in texts:
        h, body = 0, " ".join(t.lower().split()).encode()
        for i, b in enumerate(body):
            h = ((h << 1) + int(chunks._GEAR[0 if b == 32 else b])) & 0xFFFF
            if b != 32 and body[i + 1 : i + 2] in (b"", b" "):
                want.append(h)
    assert chunks.gear(w).tolist() == want


def test_warc(spark, tmp_path, table):
    big = "é" * 30_000
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n0\r\n\r\n" * 40
    rows = [(1, "u", big), (2, None, None), (3, "u", ""), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u\r\nX: y", "x" * 1000), (7, "u", "x" * 1000), (8, "u", tricky), (9, "u", big), (9, "u", big), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, refers string, kept long")
    path = f"{tmp_path}/w"
    warc.write_archive(pages, path, segment_bytes=700, chunk_bytes=100, records_per_file=3)
    got = warc.read_archive(spark, path)
    texts = sorted((str(r["page_id"]), bytes(r["payload"]).decode()) for r in got.where("record_type = 'response'").collect())
    assert texts == sorted((str(p), h or "") for p, _, h in rows if p not in (1, 6))
    want = sorted((str(p), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *({1: ("revisit", 9), 6: ("revisit", 7)}.get(p, ("response", None)))) for p, _, h in rows)
    assert sorted((str(r[0]), *r[1:]) for r in warc.archive_report(got).collect()) == want
    path = f"{tmp_path}/e"
    warc.write_archive(pages.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def archive(path, *records, cut_at=None, name="part-0.gz"):
    path.mkdir(exist_ok=True)
    data = gzip.compress(b"".join(r + b"\r\n\r\n" for r in records))
    (path / name).write_bytes(data[:cut_at] if cut_at else data)
    return str(path)


def record(kind="response", length=None, block=b"HTTP/1.1 200 OK\r\n\r\nbody", **fields):
    head = [b"WARC/1.1", *([b"WARC-Type: " + kind.encode()] if kind else []), *(f"{k.replace('_', '-')}: {v}".encode() for k, v in fields.items())]
    if length != "none":
        head.append(f"Content-Length: {len(block) if length is None else length}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block


def states(spark, path):
    return sorted((str(r["page_id"]), r["status"], None if r["payload"] is None else bytes(r["payload"])) for r in warc.read_archive(spark, path).collect())


def test_warc_segments_that_are_missing(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    part = lambda origin, k, block, total=None: record("continuation", block=block, WARC_Record_ID=f"<{origin}:{k}>", WARC_Segment_Origin_ID=f"<{origin}>", WARC_Segment_Number=k, **({"WARC_Segment_Total_Length": total} if total else {}))
    first = lambda origin, page: record(block=http + b"a", WARC_Record_ID=f"<{origin}>", X_Page=page, WARC_Segment_Number=1)
    whole = [part("a", 3, b"c", len(http) + 3), first("a", 1), part("a", 2, b"b")]
    path = archive(tmp_path / "x", *whole, first("b", 2), part("b", 3, b"c", len(http) + 3), first("c", 3), part("c", 2, b"b", 99), part("d", 2, b"b", 2), record("continuation", WARC_Record_ID="<e>"))
    archive(tmp_path / "x", first("f", 4), name="part-1.gz")
    archive(tmp_path / "x", part("f", 2, b"b", len(http) + 2), name="part-2.gz")
    assert states(spark, path) == [("1", "OK", b"abc"), ("2", "SEGMENT_MISSING", None), ("3", "SEGMENT_MISSING", None), ("4", "OK", b"ab"), ("None", "SEGMENT_MISSING", None), ("None", "SEGMENT_MISSING", None)]


def test_warc_records_that_are_broken(spark, tmp_path):
    good = lambda p: record(X_Page=p)
    bad = [record(length="none", X_Page=2), record(length="x", X_Page=3), record(length=-5, X_Page=4), record(kind=None, X_Page=5), b"WARC/1.1\r\nWARC-Type: response\r\nX-Page: 6", record(block=b"no header", X_Page=7), record(block=b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab", X_Page=8), b"WARC/1.1", record(kind="request", X_Page=9), record(X_Page="x", WARC_Payload_Digest="sha1:!")]
    path = archive(tmp_path / "x", good(1), *(y for n, x in enumerate(bad) for y in (x, good(20 + n))))
    want = [("1", "OK", b"body"), ("2", "NO_LENGTH", None), ("3", "NO_LENGTH", None), ("4", "NO_LENGTH", None), ("5", "NO_TYPE", None), ("6", "NO_HEADER_END", None), ("7", "NO_HTTP_HEADER", None), ("8", "BROKEN_CHUNKS", None), ("None", "NO_HEADER_END", None), ("None", "OK", b"body")] + [(str(20 + n), "OK", b"body") for n in range(len(bad))]
    assert states(spark, path) == sorted(want, key=str)
    path = archive(tmp_path / "y", good(1), record(length=500, X_Page=2))
    assert states(spark, path) == [("1", "OK", b"body"), ("2", "TRUNCATED", None)]
    noise = random.Random(1).randbytes(200_000)
    path = archive(tmp_path / "z", good(1), record(block=b"HTTP/1.1 200 OK\r\n\r\n" + noise, X_Page=2), good(3), cut_at=120_000)
    assert states(spark, path) == [("1", "OK", b"body"), ("2", "TRUNCATED", None), ("None", "DAMAGED_FILE", None)]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.gz").write_bytes(gzip.compress(b"nothing of the kind"))
    assert states(spark, str(tmp_path / "n")) == []


def test_warc_cuts_at_the_ends_of_buffers(spark, tmp_path):
    """Blocks that end in a blank line, so that the end of a reader's buffer can fall into any byte between two records."""
    (tmp_path / "b").mkdir()
    for shift in range(16):
        data, n = b"", 0
        while n < 200:
            head = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page: %d\r\nContent-Length: " % (1000 * shift + n)
            room = 4096 * (n + 1) + 8 - shift - len(data) - len(head) - 12
            block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * (room - 23) + b"\r\n\r\n"
            data += head + b"%d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
            n += 1
        (tmp_path / "b" / f"{shift}.gz").write_bytes(gzip.compress(data))
    got = warc.read_archive(spark, str(tmp_path / "b")).select("page_id", "status").collect()
    assert sorted(tuple(r) for r in got) == [(1000 * shift + n, "OK") for shift in range(16) for n in range(200)]


def test_warc_blocks_that_look_like_records():
    rnd = random.Random(6)
    bits = [b"\r\n\r\nWARC/1.", b"WARC/1.", b"\r\n\r\n", b"\r\n", b"x", b"Content-Length: 3", b"1\r\n", b"WARC-Type: response"]
    for _ in range(300):
        blocks = [b"".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 5))]
        data = b"".join(record(block=x) + b"\r\n\r\n" for x in blocks)
        pieces = [("f", x) for x in data.split(warc._CUT)]
        assert [(x, s) for _, x, s in warc.assemble(iter(pieces))] == [(x, "OK") for x in blocks]
        n = rnd.randint(1, 20)
        assert list(warc.pieces_of(data[i : i + n] for i in range(0, len(data), n))) == data.split(warc._CUT)


def unpack(data, size):
    """What comes out, and whether the file is whole."""
    out = []
    try:
        out += warc.unpacked(data[i : i + size] for i in range(0, len(data), size))
    except warc.Damaged:
        return b"".join(out), False
    return b"".join(out), True


def test_gzip_members(monkeypatch):
    rnd = random.Random(8)
    members = [rnd.randbytes(rnd.randint(0, 900)) for _ in range(6)] + [b"a" * 200_000]
    data = b"".join(gzip.compress(m) + b"\0" * rnd.choice([0, 0, 3]) for m in members)
    for size, most in ((1, 1 << 20), (7, 100), (1000, 5000), (1 << 20, 1 << 20)):
        monkeypatch.setattr(warc, "_UNPACKED", most)
        assert unpack(data, size) == (b"".join(members), True)
    ends = {len(data[: k]) for k in range(len(data) + 1) if unpack(data[:k], 64)[1]}
    tails = set(np.cumsum([0, *(len(gzip.compress(m)) for m in members)]).tolist())
    assert len(ends) >= len(members) and all(unpack(data[:k], 64)[0] == b"".join(members)[: len(unpack(data[:k], 64)[0])] for k in ends) and 0 in tails & ends
    for _ in range(200):
        k = rnd.randrange(len(data))
        spoilt = data[:k] + bytes([data[k] ^ (1 << rnd.randrange(8))]) + data[k + 1 :]
        out, whole = unpack(spoilt, 64)
        assert not whole or out == b"".join(members)  # a bit of a header that says nothing
    assert unpack(b"WARC/1.1 plain", 5) == (b"WARC/1.1 plain", True) and unpack(b"nothing", 3) == (b"", False) and unpack(b"", 1) == (b"", True)


def test_gzip_files_that_end_with_a_line_feed():
    """The highest byte of the length of 160 to 176 MB is a line feed, which the reader of lines doesn't give."""
    data = gzip.compress(b"\0" * (10 << 24), 1)
    assert data[-1:] == b"\n"
    for chunks in ([data[:-1]], [data[:-9], data[-9:-1]], [data]):
        assert sum(map(len, warc.unpacked(iter(chunks)))) == 10 << 24
    with pytest.raises(warc.Damaged):
        list(warc.unpacked(iter([data[:-2]])))


def test_warc_files_that_are_damaged(spark, tmp_path):
    """Every record is a row or lies behind a row that says so."""
    rnd = random.Random(12)
    bodies = [b"HTTP/1.1 200 OK\r\n\r\n" + rnd.randbytes(3000) for _ in range(60)]
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b.partition(b"\r\n\r\n")[2]).digest()).decode()
    data = gzip.compress(b"".join(record(block=b, X_Page=k, WARC_Payload_Digest=sha(b)) + b"\r\n\r\n" for k, b in enumerate(bodies)))
    flip = lambda k: data[:k] + bytes([data[k] ^ 0x10]) + data[k + 1 :]
    cases = {"half": data[: len(data) // 2], "flip": flip(len(data) // 2), "first": flip(1), "end": data[:-1], "sum": flip(len(data) - 6), "more": data + b"junk", "none": b"", "whole": data}
    (tmp_path / "d").mkdir()
    for name, x in cases.items():
        (tmp_path / "d" / f"{name}.gz").write_bytes(x)
    got = defaultdict(list)
    for r in warc.read_archive(spark, str(tmp_path / "d")).collect():
        got[r["file"].rsplit("/", 1)[1][:-3]].append((r["status"], r["page_id"], r["payload"] and bytes(r["payload"])))
    right = {("OK", k, b.partition(b"\r\n\r\n")[2]) for k, b in enumerate(bodies)}
    assert set(got.pop("whole")) == right and "none" not in got
    for name, rows in got.items():
        assert [s for s, _, _ in rows].count("DAMAGED_FILE") == 1 and {r for r in rows if r[0] == "OK"} <= right, name
        assert {s for s, _, _ in rows} <= {"OK", "DAMAGED_FILE", "TRUNCATED", "WRONG_DIGEST", "NO_HEADER_END", "NO_LENGTH"}, name
    assert sum(s == "OK" for s, _, _ in got["half"]) in range(25, 31) and [s for s, _, _ in got["first"]] == ["DAMAGED_FILE"]
    assert sum(s == "OK" for s, _, _ in got["end"]) == sum(s == "OK" for s, _, _ in got["more"]) == 60


def test_warc_files_that_cannot_be_read_fail_the_job(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"text {k}") for k in range(30)], "page_id long, url string, html string")
    path = f"{tmp_path}/w"
    warc.write_archive(pages.repartition(3), path)
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        victim = next((tmp_path / "w").glob("*.gz"))
        (tmp_path / "w" / f".{victim.name}.crc").write_bytes(b"crc\0\0\0\2\0" + b"\1\2\3\4")  # the file system's own sums don't agree: a read error
        with pytest.raises(Exception, match=r"(?i)checksum|corrupt|read"):
            warc.read_archive(spark, path).count()
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")


def test_chunked_framing():
    for n in (0, 1, 99, 100, 101, 5000):
        data = ("aé中" * n).encode()[:n]
        data = data.decode(errors="ignore").encode()
        assert warc.dechunked(warc.chunked(data, 100)) == data
    assert warc.dechunked(b"5;x=1\r\nabcde\r\n0\r\nT: 1\r\n\r\n") == b"abcde"
    assert warc.dechunked(b"5\r\nabc") is None and warc.dechunked(b"zz\r\n") is None
