"""SentencePiece byte-pair encoding and decoding by a prefix table.

A merge-type vocabulary gives each prefix of a text exactly one last token. For each place in turn, an Aho-Corasick
automaton lists the pieces that end there; the one that may follow the last token of the prefix before it is stored,
and ids are then read backwards. Whether a token may follow another depends on the two alone: they may if the merge
rules, run on both texts joined, give the two back.

No piece of such a model has the space mark after another character, so texts fall into units (marks, then other
characters) that are encoded apart and remembered. Characters without a piece stand alone and become bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain
from operator import add

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import ship

MARK = "▁"
#: What a Python worker remembers of units, and of parts a quarter of it, in units of about four bytes of memory, at most
#: twice as much for a time; longer units than LONG characters are encoded each time they are met. PAIRS: token pairs.
REMEMBERED, LONG, PAIRS = 40_000_000, 200, 800_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Model:
    """Pieces of a SentencePiece BPE model whose normaliser is identity."""

    def __init__(self, proto: bytes, remember: int | None = None):
        remember = REMEMBERED if remember is None else remember
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) for i in range(len(self.pieces))]
        self.hidden = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not sp.is_unused(i)}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        if any(regex.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece has a space mark after another character, so units can't be encoded apart")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.inner = {x for p in self.ids for x in map(add, p, p[1:])}
        self.special = self.hidden | self.of_byte.keys() | {self.unknown}
        self.decimal = [f" {i}" for i in range(len(self.pieces))]
        self.parts = _Remembered(self._part, remember // 4)
        self.listed = _Remembered(self._listed, remember)
        self.coded = _Remembered(self._coded, remember)
        self.follows: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What the merge rules make of a short text: again and again the best-scored pair, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether a text's tokens may be these two, or with left -2 the right one alone."""
        a, b = self.pieces[left] if left >= 0 else "", self.pieces[right]
        return self.merged(a + b) == ([a, b] if a else [b])

    def _part(self, text: str) -> list[int]:
        """Ids of a part, by the last token of each of its prefixes."""
        if text not in self.ids and len(text) == 1:
            return [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]
        follows, n = self.follows, len(text)
        if len(follows) > PAIRS:
            follows.clear()
        last, size = [-1] * (n + 1), [0] * (n + 1)
        last[0] = -2
        for end, (token, length) in self.automaton.iter(text):
            left = last[end + 1 - length]
            if left != -1 and last[end + 1] == -1:
                known = follows.get(pair := (left + 2) << 24 | token)
                if known is None:
                    known = follows[pair] = self.may_follow(left, token)
                if known:
                    last[end + 1], size[end + 1] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def unit(self, text: str) -> list[int]:
        out, begin, parts, inner = [], 0, self.parts, self.inner
        for k, two in enumerate(map(add, text, text[1:]), 1):
            if two not in inner:
                out += parts[text[begin:k]]
                begin = k
        if begin < len(text):
            out += parts[text[begin:]]
        return out

    def _listed(self, text: str) -> tuple[str, str]:
        """A unit's ids in decimal, each after a space, and the text that they decode to."""
        ids, back = self._coded(text)
        return "".join(map(self.decimal.__getitem__, ids)), back

    def _coded(self, text: str) -> tuple[list[int], str]:
        """A unit's ids, and the text that they decode to: itself, where all are pieces, as these cover it."""
        ids = self.unit(text)
        if self.special.isdisjoint(ids):
            return ids, text
        back = self._text(ids)
        return ids, text if back == text else back

    def split(self, text: str) -> list[str]:
        """Units of a text; spaces become marks, and one mark goes before the text. A line end without a piece is a unit."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text or "\n" in self.ids:
            return _UNIT.findall(MARK + text.replace(" ", MARK))
        return (MARK + text).replace(" ", f" {MARK}").replace("\n", " \n ").split(" ")

    def encode(self, text: str) -> list[int]:
        """Ids with an end id."""
        return [*chain.from_iterable(map(self.unit, self.split(text))), self.end]

    def coding(self, text: str) -> tuple[list[int], str]:
        """Ids with an end id, and the text they decode to."""
        parts = [*map(self.coded.__getitem__, self.split(text))]
        return [*chain.from_iterable([p[0] for p in parts]), self.end], _shown("".join([p[1] for p in parts]))

    def listing(self, text: str) -> tuple[str, str]:
        """The ids in decimal, one space apart, and the text they decode to."""
        # a unit's bytes are whole characters, so units decode apart
        parts = [*map(self.listed.__getitem__, self.split(text))]
        return f"{''.join([p[0] for p in parts])} {self.end}"[1:], _shown("".join([p[1] for p in parts]))

    def _text(self, ids) -> str:
        """Pieces of ids joined: control ids go, and byte ids that follow each other are read as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i not in self.hidden:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i])
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, ids) -> str:
        """Text of ids; one mark at the start goes."""
        return _shown(self._text(ids))


class _Remembered(dict):
    """Values of a function of a unit. When they take up too much, those not asked for since the last time are forgotten."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.before, self.weight, self.most = make, {}, 0, most

    def __missing__(self, unit: str):
        if len(unit) > LONG:
            return self.make(unit)
        value = self.before.get(unit)
        if value is None:
            value = self.make(unit)
        weight = 4 * len(unit) + 40  # ids are no more than a unit's bytes
        if self.weight + weight > self.most:
            self.before = dict(self)
            self.clear()
            self.weight = 0
        self.weight += weight
        self[unit] = value
        return value


def _shown(text: str) -> str:
    """Joined pieces as text: one mark at the start goes, the others are spaces."""
    return (text[1:] if text[:1] == MARK else text).replace(MARK, " ")


def _utf8(data: bytearray) -> str:
    """Each byte that belongs to no whole character becomes U+FFFD."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        i += n
    return "".join(out)


_UNIT = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_models: dict[tuple[str, int], Model] = {}


def model_of(proto, remember: int) -> Model:
    """The model of a broadcast, built once in each Python worker."""
    key = hashlib.sha256(proto.value).hexdigest(), remember
    if key not in _models:
        _models[key] = Model(proto.value, remember)
    return _models[key]


def _encoded(batches: Iterator[pa.RecordBatch], column: str, proto, digests: bool, remember: int) -> Iterator[pa.RecordBatch]:
    model = model_of(proto, remember)
    for batch in batches:
        row = batch.column(0)
        texts = pc.struct_field(row, column).cast(pa.string())
        for i in range(0, len(row), 200):
            here, strings = row.slice(i, 200), [t or "" for t in texts.slice(i, 200).to_pylist()]
            if digests:
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                ids, back = zip(*map(model.listing, strings), strict=True)
                yield pa.RecordBatch.from_arrays([here, pa.array([x.count(" ") + 1 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, back), pa.string())], ["row", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ids, back = zip(*map(model.coding, strings), strict=True)
                yield pa.RecordBatch.from_arrays([here, pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["row", "ids", "decoded"])


def _proto(docs: DataFrame, path: str):
    ship(docs.sparkSession)
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", remember: int = REMEMBERED) -> DataFrame:
    """row (struct of the columns of docs), ids (with the end id), decoded text of every row of docs.

    A Python worker keeps what it remembers of units (remember, see REMEMBERED) for its next tasks. The model file, of a fixed size, is read on the driver and broadcast. Null and empty texts have the end id only
    and decode to an empty text. A very long text is one row's work, in proportion to its length. Repeated rows, and
    rows of one id, are encoded each by its own text; of equally scored merges the first one goes first, as in the
    library. Without documents there are no rows; other columns stay in row.
    """
    proto, rows = _proto(docs, model_path), _rows(docs)
    schema = StructType([rows.schema["row"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return rows.mapInArrow(lambda x: _encoded(x, text_col, proto, False, remember), schema)


def encoding_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs; digests are made where texts are encoded."""
    proto, rows = _proto(docs, model_path), _rows(docs.select(*dict.fromkeys([id_col, text_col])))
    schema = StructType().add(rows.schema["row"]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return rows.mapInArrow(lambda x: _encoded(x, text_col, proto, True, REMEMBERED), schema).select(F.col("row")[id_col].alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
