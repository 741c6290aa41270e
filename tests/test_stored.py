"""Hashes of sequences, footers, publishing."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import sequences
from strandline.sources import files, parts, store


def digest(values):
    return hashlib.sha256("".join("N" if v is None else f"V{len(str(v).encode())}:{v}" for v in values).encode()).digest()


def test_products_are_associative_and_do_not_commute():
    rnd = random.Random(1)
    a, b, c = (tuple(sequences.matrices([rnd.randbytes(32)])[0]) for _ in range(3))
    assert sequences.product(sequences.product(a, b), c) == sequences.product(a, sequences.product(b, c)) and sequences.product(a, b) != sequences.product(b, a)
    assert sequences.product(a, sequences.IDENTITY) == a == sequences.product(sequences.IDENTITY, a)


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_sequence_hashes_equal_one_pass(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice("ab") if k % 9 else None, rnd.choice([None, k // 3]), rnd.choice(["x", "é", "", None])) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, v string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["g"]: (r["n_rows"], r["sequence_sha256"]) for r in sequences.sequence_hashes(df, ["o"], ["g"]).collect()}
        whole = sequences.sequence_hash(df, ["o"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in ("a", "b", None):
        mine = sorted(((o is not None, o or 0, digest((o, v))) for h, o, v in rows if h == g))
        assert got[g] == (len(mine), sequences.serial_hash([d for _, _, d in mine]))
    every = sorted((o is not None, o or 0, digest((h, o, v))) for h, o, v in rows)
    assert whole == sequences.serial_hash([d for _, _, d in every])


def test_sequence_hashes_tell_order(spark):
    rows = [(k, f"v{k}") for k in range(40)]
    make = lambda rows: spark.createDataFrame(rows, "o int, v string")
    of = lambda rows: sequences.sequence_hashes(make(rows), ["o"], columns=["v"]).first()["sequence_sha256"]
    swapped = [(7, "v8") if k == 7 else (8, "v7") if k == 8 else (k, v) for k, v in rows]
    assert of(rows) == of(rows[::-1]) != of(swapped)
    assert of(rows) != of(rows[:-1]) and of(rows) == of([(2 * k - 90, v) for k, v in rows])
    assert sequences.sequence_hash(make([]), ["o"]) == sequences.serial_hash([]) and sequences.sequence_hashes(make([]), ["o"]).count() == 0
    zero = spark.createDataFrame([(1, 0.0)], "o int, v double")
    assert sequences.sequence_hash(zero, ["o"]) != sequences.sequence_hash(zero.withColumn("v", -F.col("v")), ["o"])


def test_an_id_is_published_once(spark, tmp_path):
    root, a = str(tmp_path), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    # another publisher has reserved the id and crashed
    assert files.create_new(spark, f"{root}/reserved/one") and not files.create_new(spark, f"{root}/reserved/one")
    with pytest.raises(FileExistsError):
        store.publish(spark, root, {"t": a}, {}, "one", {"t": ["k"]})
    store.abandon(spark, root, "one")
    manifest = store.publish(spark, root, {"t": a}, {}, "one", {"t": ["k"]})
    assert manifest["tables"]["t"]["sequence_sha256"] == sequences.sequence_hash(a, ["k"])
    with pytest.raises(FileExistsError):
        store.abandon(spark, root, "one")
    # numbers, not clocks, tell which snapshot is the last: two that were taken meanwhile are left out
    assert files.create_new(spark, f"{root}/published_numbers/{2:012d}") and files.create_new(spark, f"{root}/published_numbers/{3:012d}")
    store.publish(spark, root, {"t": a.where("k = 1")}, {}, "two", {"t": ["k"]})
    assert [(r["name"], r["number"]) for r in store._log(spark, f"{root}/published").collect()] == [("one", 1), ("two", 4)]
    assert store.Snapshot(spark, root).id == "two"


def test_scratch_folders_are_shared(spark):
    path = files.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert path.startswith(files.shared_folder(spark)) and spark.read.parquet(path).count() == 3
    files.delete(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_footers_tell_how_tables_are_stored(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id") % 7).alias("v"))
    store.write_table(df, f"{tmp_path}/good", ["k"], rows_per_group=1000)
    found = parts.footers(spark, f"{tmp_path}/good")
    assert parts.layout_violations(found, 1000, sort_key="k", kind="long").count() == 0
    groups = found.where("column = 'k'").collect()
    assert sum(r["rows"] for r in groups) == 5000 and all(int(r["most"]) - int(r["least"]) == r["rows"] - 1 and r["nulls"] == 0 for r in groups)
    df.coalesce(1).orderBy("v").write.parquet(f"{tmp_path}/bad")
    (tmp_path / "bad" / "no.parquet").write_bytes(b"PAR1 nothing")
    rules = {r["rule"]: r["n"] for r in parts.layout_violations(parts.footers(spark, f"{tmp_path}/bad"), 1000).groupBy("rule").agg(F.count("*").alias("n")).collect()}
    assert rules == {"GROUP_TOO_LARGE": 1, "CODEC": 1, "DICTIONARY": 1, "NO_FOOTER": 1}
    wrong = spark.createDataFrame([("p", 9, g, 10, "k", "ZSTD", False, 0, str(a), str(z), "OK") for g, (a, z) in enumerate([(1, 5), (5, 9), (8, 20), (100, 200)])], parts.Footers({}).schema())
    assert [(r["rule"], r["row_group"]) for r in parts.layout_violations(wrong, 10, sort_key="k", kind="long").collect()] == [("KEY_OVERLAPS", 2)]


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_trees_tell_which_files_changed(spark, depth):
    rnd = random.Random(depth)
    files_ = [(f"d{k % 5}/{k}", k, hashlib.sha256(str(k).encode()).hexdigest()) for k in range(300)]
    changed = {p for p, _, _ in rnd.sample(files_, 4)}
    other = [(p, n, "0" * 64 if p in changed else h) for p, n, h in files_ if n not in (7, 8)] + [("new", 1, "1")]
    make = lambda rows: spark.createDataFrame(rows, "path string, length long, sha256 string")
    got = {r["path"]: r["state"] for r in parts.changed_files(make(files_), make(other), depth).collect()}
    gone = {f"d{k % 5}/{k}" for k in (7, 8)}
    assert got == {**dict.fromkeys(changed - gone, "CHANGED"), **dict.fromkeys(gone, "MISSING"), "new": "UNLISTED"}
    assert parts.changed_files(make(files_), make(files_[::-1]), depth).count() == 0
    root = parts.digest_tree(make(files_), depth).where("level = 0").first()
    assert root["n_files"] == 300 and root["sha256"] != parts.digest_tree(make(other), depth).where("level = 0").first()["sha256"]


def test_one_file_is_held_without_hashing_the_rest(spark, tmp_path, monkeypatch):
    for k in range(20):
        (tmp_path / f"{k}.bin").write_bytes(b"x" * k)
    listed = parts.listing(spark, str(tmp_path)).checkpoint()
    tree = parts.digest_tree(listed).checkpoint()
    (tmp_path / "3.bin").write_bytes(b"yyy")
    (tmp_path / "4.bin").unlink()
    (tmp_path / "5.bin").chmod(0o000)  # no one reads it
    asked = lambda listing: {r["path"]: r["state"] for r in parts.held_against(spark, str(tmp_path), listing, tree, ["3.bin", "4.bin", "6.bin", "z.bin"]).collect()}
    assert asked(listed) == {"3.bin": "CHANGED", "4.bin": "MISSING", "6.bin": "OK", "z.bin": "UNLISTED"}
    forged = listed.withColumn("sha256", F.when(F.col("path") == "9.bin", "0").otherwise(F.col("sha256")))
    assert set(asked(forged).values()) == {"LISTING_DIFFERS"}
    (tmp_path / "5.bin").chmod(0o600)
    assert {r["path"]: r["state"] for r in parts.changed_files(listed, parts.listing(spark, str(tmp_path))).collect()} == {"3.bin": "CHANGED", "4.bin": "MISSING"}
