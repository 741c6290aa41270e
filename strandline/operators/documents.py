"""JSON documents, a row each: a parse that refuses what a lenient one lets pass, closed shapes, canonical digests.

A document is read once, token by token, with the keys of each object that is open. What a usual reader drops in silence is
a problem here, with its place: a repeated key at any depth, a number that isn't finite, text after the end.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import ship
from .contracts import check_document

NOT_UTF8, EMPTY, SYNTAX, REPEATED_KEY, NOT_FINITE, TRAILING_TEXT, TOO_DEEP = "NOT_UTF8", "EMPTY", "SYNTAX", "REPEATED_KEY", "NOT_FINITE", "TRAILING_TEXT", "TOO_DEEP"
#: Objects and lists that may be open at once.
DEPTH = 200
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|((?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![0-9A-Za-z_.+-]))|(-?Infinity|NaN))')
_SPACE = re.compile(r"[ \t\n\r]*")
# what may come next
_VALUE, _VALUE_OR_END, _KEY, _KEY_OR_END, _COLON, _MORE, _NOTHING = range(7)


class _Open:
    """An object or list that is open: where it is, its keys or how many items it has, the key that is being given a value."""

    __slots__ = ("place", "keys", "items", "key")

    def __init__(self, place: str, is_object: bool):
        self.place, self.keys, self.items, self.key = place, set() if is_object else None, 0, None

    def at(self) -> str:
        return f"{self.place}.{self.key}" if self.keys is not None else f"{self.place}[{self.items}]"


def problems(text: str) -> list[str]:
    """What is wrong with a document: rule and place, or rule and offset in characters where it can't be read on from."""
    found, stack, i, now, n = [], [], 0, _VALUE, len(text)
    end = _SPACE.match(text).end()
    if end == n:
        return [f"{EMPTY} at 0"]
    while now != _NOTHING:
        m = _TOKEN.match(text, i)
        if not m:
            return [*found, f"{SYNTAX} at {_SPACE.match(text, i).end()}"]
        sign, quoted, plain, infinite = m.groups()
        i, top = m.end(), stack[-1] if stack else None
        start = m.start(m.lastindex)
        if now in (_VALUE, _VALUE_OR_END) and (quoted or plain or infinite or sign in ("{", "[")):
            place = top.at() if top else "$"
            if infinite:
                found.append(f"{NOT_FINITE} at {place}")
            if sign:
                if len(stack) == DEPTH:
                    return [*found, f"{TOO_DEEP} at {place}"]
                stack.append(_Open(place, sign == "{"))
                now = _KEY_OR_END if sign == "{" else _VALUE_OR_END
                continue
        elif now in (_KEY, _KEY_OR_END) and quoted:
            top.key = json.loads(quoted) if "\\" in quoted else quoted[1:-1]
            if top.key in top.keys:
                found.append(f"{REPEATED_KEY} at {top.at()}")
            top.keys.add(top.key)
            now = _COLON
            continue
        elif now == _COLON and sign == ":":
            now = _VALUE
            continue
        elif now == _MORE and sign == ",":
            top.items += 1
            now = _KEY if top.keys is not None else _VALUE
            continue
        elif sign == "}" and top and top.keys is not None and now in (_KEY_OR_END, _MORE) or sign == "]" and top and top.keys is None and now in (_VALUE_OR_END, _MORE):
            stack.pop()
        else:
            return [*found, f"{SYNTAX} at {start}"]
        now = _MORE if stack else _NOTHING
    i = _SPACE.match(text, i).end()
    return [*found, f"{TRAILING_TEXT} at {i}"] if i < n else found


def canonical(value) -> str:
    """Sorted keys, two spaces, no NaN, a line end."""
    return json.dumps(value, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False) + "\n"


def checked(rows: DataFrame, column: str, shape=None) -> DataFrame:
    """rows with problems (array), wrong (array: against the closed shape, see check_document) and canonical_sha256 of the
    document in a string or binary column; digest and wrong are null where there are problems, all three where it is null."""
    ship(rows.sparkSession)
    names = rows.columns
    x = rows.select(F.struct("*").alias("row"), F.col(column).cast("binary").alias("document"))
    schema = StructType([x.schema["row"], *StructType.fromDDL("problems array<string>, wrong array<string>, canonical_sha256 string").fields])

    def one(data: bytes | None) -> tuple[list[str] | None, list[str] | None, str | None]:
        if data is None:
            return None, None, None
        try:
            text = data.decode()
        except UnicodeDecodeError as why:
            return [f"{NOT_UTF8} at {why.start}"], None, None
        if bad := problems(text):
            return bad, None, None
        value = json.loads(text)
        try:
            digest = hashlib.sha256(canonical(value).encode()).hexdigest()
        except (ValueError, UnicodeEncodeError):  # 1e999 is no number, a lone surrogate no text
            return [f"{NOT_FINITE} at $" if "surrogates" not in repr(value) and _infinite(value) else f"{NOT_UTF8} at 0"], None, None
        return [], check_document(value, shape) if shape is not None else [], digest

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(d) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.list_(pa.string()), pa.list_(pa.string()), pa.string())))], schema.fieldNames())

    return x.mapInArrow(check, schema).select(*(F.col("row")[c].alias(c) for c in names), "problems", "wrong", "canonical_sha256")


def _infinite(value) -> bool:
    if isinstance(value, float):
        return value in (float("inf"), float("-inf"))
    return any(map(_infinite, value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()))
