"""Strict JSON against the standard library with its hooks."""

import hashlib
import json
import random

import pytest

from strandline.operators import documents


class Refused(Exception):
    pass


def strict(text):
    """The value, or Refused, as json with hooks has it."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise Refused
        return dict(pairs)

    def constant(name):
        raise Refused

    try:
        return json.loads(text, object_pairs_hook=unique, parse_constant=constant)
    except (json.JSONDecodeError, RecursionError):
        raise Refused from None


def made(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 4 else 6)
    if kind == 6:
        return "{" + ",".join(f'{rnd.choice(["", " "])}"{rnd.choice("abcdé")}{rnd.choice(["", "1", chr(92) + "n"])}" : {made(rnd, depth + 1)}' for _ in range(rnd.randrange(5))) + "}"
    if kind == 7:
        return "[" + ", ".join(made(rnd, depth + 1) for _ in range(rnd.randrange(4))) + "]"
    return rnd.choice(["1", "-0.5e+3", "true", "null", '"x"', '"\\u00e9\\"{"', "12345678901234567890", "0", '""', "NaN", "-Infinity"] if rnd.random() < 0.3 else ["1", "false", '"x"', "-2.25"])


def test_documents_equal_the_strict_library():
    rnd, counts = random.Random(7), {True: 0, False: 0}
    for _ in range(6000):
        text = made(rnd)
        for _ in range(rnd.choice([0, 0, 1, 2])):  # damage
            k = rnd.randrange(len(text) + 1)
            text = rnd.choice([text[:k] + rnd.choice('{}[],:"\\ \n\t01-+.eEnaIx') + text[k:], text[:k] + text[k + 1 :], text + rnd.choice([" ", "x", "{}"])])
        try:
            strict(text)
            good = True
        except Refused:
            good = False
        assert (documents.problems(text) == []) == good, text
        counts[good] += 1
    assert min(counts.values()) > 1000


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1, "b": {"c": [0, {"d": 1, "d": 2}]}, "a": 2}', ["REPEATED_KEY at $.b.c[1].d", "REPEATED_KEY at $.a"]),
        ('{"a": 1, "\\u0061": 2}', ["REPEATED_KEY at $.a"]),
        ('[1, NaN, {"x": -Infinity}]', ["NOT_FINITE at $[1]", "NOT_FINITE at $[2].x"]),
        ("{} x", ["TRAILING_TEXT at 3"]), ("1 2", ["TRAILING_TEXT at 2"]), ("", ["EMPTY at 0"]), (" \n", ["EMPTY at 0"]), ("{", ["SYNTAX at 1"]), ('{"a" 1}', ["SYNTAX at 5"]), ("[1,]", ["SYNTAX at 3"]), ("01", ["SYNTAX at 0"]), ("'a'", ["SYNTAX at 0"]), ('"\t"', ["SYNTAX at 0"]), ("nullx", ["SYNTAX at 0"]),
        ("[" * 201, ["TOO_DEEP at $" + "[0]" * 200]), ("[" * 200 + "]" * 200, []), (' {"a": [ ] , "b" : { } } ', []),
    ],
)
def test_problems_have_their_place(text, want):
    assert documents.problems(text) == want


def test_documents_of_a_table(spark):
    shape = {"name": str, "size?": int}
    rows = [(1, b'{"size": 2, "name": "\xc3\xa9"}'), (2, b'{"name": 1, "x": 2}'), (3, b'{"name": "a", "name": "b"}'), (4, b"\xff"), (5, None), (6, b""), (7, b'{"name": "a", "size": 1e999}'), (8, b'{"name": "\\ud800"}'), (1, b'{"name":"z"}')]
    df = spark.createDataFrame([(k, bytearray(d) if d is not None else None, "p", 1) for k, d in rows], "k int, document binary, problems string, row int")
    got = [(r["k"], *list(r)[-3:]) for r in documents.checked(df.drop("problems"), "document", shape).collect()]
    digest = lambda v: hashlib.sha256((json.dumps(v, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()).hexdigest()
    assert sorted(got, key=str) == sorted([
        (1, [], [], digest({"name": "é", "size": 2})), (2, [], ["$.x is unknown", "$.name is no str"], digest({"name": 1, "x": 2})), (3, ["REPEATED_KEY at $.name"], None, None), (4, ["NOT_UTF8 at 0"], None, None), (5, None, None, None), (6, ["EMPTY at 0"], None, None),
        (7, ["NOT_FINITE at $"], None, None), (8, ["NOT_UTF8 at 0"], None, None), (1, [], [], digest({"name": "z"})),
    ], key=str)
    assert documents.checked(df.limit(0), "document").count() == 0
