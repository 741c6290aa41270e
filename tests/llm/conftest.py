import random

import pytest

SF = "/root/testdata/sf0.001"
#: Columns whose names operators might use themselves.
CLASHING = "row string, id long, n long, k long, c long, key string, kept boolean, score double, n_words long, matches string, component long, node long, `a b` string"
DDL = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, clashing extra columns."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    same, extra = prose(80), ("r", 1, 2, 3, 4, "k", True, 0.5, 6, "m", 7, 8, "ab")
    texts = [None, "", "   \n\t ", "one", "Two words", "!!! ### 123", prose(60_000), same, same, "".join(c.upper() if c.isascii() else c for c in same), prose(30) + "\n" + same, "日本語 テキスト 😀", "a\x00b " * 30, "x" * 5000]
    rows = [(i, t, "en", "s", 3, *extra) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, same, None, None, None, *[None] * len(extra)), (None, None, None, None, None, *[None] * len(extra))]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 1), (7, 1, None), (None, 0, 1), (99, 0, 1), (10, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, sf=SF: spark.read.parquet(f"{sf}/{name}.parquet")
