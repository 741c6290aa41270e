"""Every registered query against its SQL counterpart in DuckDB."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from strandline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, found):
    def text(v):
        return "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF), duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_hash_does_not_depend_on_order(spark):
    out = catalog.queries()["table_semantic_hash"](spark, SF).collect()
    assert all(r["stable"] for r in out) and len({r["semantic_sha256"] for r in out}) == 2


def test_all_orders_meet_customers(spark, tmp_path):
    for name, rows, columns in (("customer", [(1,), (11,), (12,)], "c_custkey long"), ("orders", [(1, 11), (2, 22), (3, 1)], "o_orderkey long, o_custkey long"), ("lineitem", [(1,), (4,)], "l_orderkey long")):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["link"]: r for r in catalog.queries()["fk_reconciliation_of_all_orders"](spark, str(tmp_path)).collect()}
    assert [got["orders"][c] for c in ("parents", "children", "orphans", "childless", "repeated")] == [3, 3, 1, 1, 0]
    assert [got["lineitem"][c] for c in ("parents", "children", "orphans", "childless", "repeated")] == [3, 2, 1, 2, 0]


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(s) <= set(q); from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)
