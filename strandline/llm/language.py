"""Language identification by cross-parsing (Ziv and Merhav, 1993).

Labelled text of each language makes a suffix automaton. A text is parsed against it greedily: each phrase is the
longest piece that occurs in the language's text. Phrases times the bits that point to one, a symbol, estimate the
cross entropy; the language with the least wins.

Automata are kept as dense tables whose missing transitions already lead to where the next phrase begins, flagged in
the top bit, so numpy walks many texts and all languages at once, one symbol a step. Texts are cut into segments of
SEGMENT symbols for that, which are walked side by side. A segment's own walk begins with a phrase of its own, but the
text's phrase reaches into it; so each is walked again from where the one before ended, beside a repeat of its own
walk, until both are in the same state, as they are after a phrase or two. From there on they agree, so the phrases are
exactly the text's.

The tables have a bound in bytes, whatever the count of languages: with many of them each learns from fewer symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold, ship
from .samples import texts_of
from .textbytes import buffers, runs

SEGMENT = 512
#: Bytes of the table of all languages, which is broadcast. A language has up to two states a symbol.
TABLE_BYTES = 256 << 20
UNDETERMINED = "und"
_OTHER, _SPACE, _FLAG = 0, 1, np.uint32(1 << 31)


def suffix_automaton(text: np.ndarray, size: int) -> np.ndarray:
    """Transitions (state, symbol) of the suffix automaton of text, -1 where there is none; state 0 is the root."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.full((len(to), size), -1, np.int64)
    for s, edges in enumerate(to):
        for c, t in edges.items():
            out[s, c] = t
    return out


class Languages:
    """Automata of all languages in one table."""

    def __init__(self, texts: dict[str, list[str]], most_symbols: int, most_bytes: int = TABLE_BYTES):
        self.names = sorted(texts)
        high = np.zeros(256, bool)
        for name in self.names:
            for x in texts[name]:
                high[np.frombuffer(x.lower().encode(), np.uint8)] = True
        self.symbols = np.full(256, _SPACE, np.uint8)
        self.symbols[128:] = _OTHER
        self.symbols[97:123] = self.symbols[65:91] = np.arange(2, 28)
        seen = 128 + np.flatnonzero(high[128:])
        self.symbols[seen] = np.arange(28, 28 + len(seen))
        self.width = 28 + len(seen)
        tables, self.roots, self.bits, base = [], [], [], 0
        # states beside those of symbols: the root, the one after a separator, and where a symbol is lost
        most_symbols = max(1, min(most_symbols, (most_bytes // (4 * self.width * max(len(self.names), 1)) - 4) // 2))
        for name in self.names:
            parts, n = [], 0
            for x in texts[name]:
                s, _ = self.encode(pa.array([x.lower()]))
                if n + len(s) + 1 <= most_symbols or not parts:
                    parts += [s[:most_symbols], np.array([_OTHER], np.uint8)]
                    n += len(s) + 1
            body = np.concatenate(parts)
            automaton = suffix_automaton(body, self.width)
            automaton[:, _OTHER] = -1  # separates texts, and stands for unknown bytes
            # the last row is where a symbol leads that the language lacks: a phrase of its own, which ends at once
            lost = len(automaton)
            start = np.where(automaton[0] < 0, lost, automaton[0])
            missing = automaton < 0
            flat = np.concatenate([(np.where(missing, start[None, :], automaton) + base) * self.width, (start[None, :] + base) * self.width])
            flag = np.concatenate([missing, np.ones((1, self.width), bool)])
            if (base + len(flat)) * self.width >= 1 << 31:
                raise ValueError("most_bytes must be less than 2**33")
            tables.append(flat.astype(np.uint32) | np.where(flag, _FLAG, np.uint32(0)))
            self.roots.append((base + lost) * self.width)  # where any symbol begins a phrase
            self.bits.append(np.log2(max(len(body), 2)))
            automaton = flat
            base += len(automaton)
        self.table = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.uint32)

    def encode(self, lower: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and offsets of lower-cased texts; runs of other characters are one space."""
        data, off = buffers(lower)
        s = self.symbols[data]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != _SPACE) | (s[:-1] != _SPACE)
        keep[off[off < len(s)]] = True
        return s[keep], np.concatenate([[0], np.cumsum(keep)])[off]

    def phrases(self, s: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language."""
        n, k = np.diff(off), len(self.names)
        pieces = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), pieces)
        place = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = off[:-1][text] + place * SEGMENT
        size = np.minimum(SEGMENT, off[1:][text] - begin)
        order = np.argsort(-size, kind="stable")
        lane = np.empty_like(order)
        lane[order] = np.arange(len(order))
        begin, size, text, place = begin[order], size[order], text[order], place[order]
        before = np.where(place > 0, lane[np.maximum(order - 1, 0)], -1)
        most = int(size[0]) if len(size) else 0
        state = np.repeat(np.array(self.roots, np.uint32)[:, None], len(text), 1)
        ends = np.zeros(state.shape, np.int64)
        lanes = np.searchsorted(-size, -np.arange(most), side="left")
        for t, m in enumerate(lanes):
            v = self.table[state[:, :m] + s[begin[:m] + t].astype(np.uint32)]
            ends[:, :m] += v >> np.uint32(31)
            state[:, :m] = v & ~_FLAG
        own, final = ends.copy(), state.copy()
        # segments that follow another one, in each language: walked from where that one ended
        x, y = np.nonzero(np.repeat((before >= 0)[None, :], k, 0))
        while len(x):
            now, seen = state[x, before[y]], np.zeros(len(x), np.int64)
            mine, passed = np.array(self.roots, np.uint32)[x], np.zeros(len(x), np.int64)
            changed = np.zeros((k, len(text)), bool)
            t, a, b = 0, x, y
            while len(a):
                c = s[begin[b] + t].astype(np.uint32)
                v, w = self.table[now + c], self.table[mine + c]
                seen, passed = seen + (v >> np.uint32(31)), passed + (w >> np.uint32(31))
                now, mine = v & ~_FLAG, w & ~_FLAG
                met = now == mine
                ends[a[met], b[met]] = own[a[met], b[met]] - passed[met] + seen[met]
                over = ~met & (size[b] == t + 1)
                ends[a[over], b[over]] = seen[over]
                for which, end in ((met, final[a[met], b[met]]), (over, now[over])):
                    changed[a[which], b[which]] = state[a[which], b[which]] != end
                    state[a[which], b[which]] = end
                left = ~(met | over)
                now, seen, mine, passed, a, b = now[left], seen[left], mine[left], passed[left], a[left], b[left]
                t += 1
            again = np.zeros_like(changed)
            has = before >= 0
            again[:, has] = changed[:, before[has]]
            x, y = np.nonzero(again)
        return np.stack([np.bincount(text, e, len(n)) for e in ends], 1) if k else np.zeros((len(n), 0))


def _identified(batches: Iterator[pa.RecordBatch], column: str | None, model) -> Iterator[pa.RecordBatch]:
    known: Languages = model.value
    for batch in batches:
        first = batch.column(0)
        texts = (pc.struct_field(first, column) if column else batch.column(1)).cast(pa.large_string()).fill_null("")
        lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        if known.names and len(texts):
            lower = pc.utf8_lower(texts)
            for i, j in runs(buffers(lower)[1]):
                s, off = known.encode(lower.slice(i, j - i))
                bits = known.phrases(s, off) * np.array(known.bits) / np.maximum(np.diff(off), 1)[:, None]
                order = np.argsort(bits, axis=1, kind="stable")
                best = bits[np.arange(j - i), order[:, 0]]
                second = bits[np.arange(j - i), order[:, 1]] if len(known.names) > 1 else 2 * best
                here = lettered[i:j]
                lang[i:j][here] = np.array(known.names, object)[order[:, 0]][here]
                score[i:j][here] = (1 - best / np.maximum(second, 1e-9))[here]
        yield pa.RecordBatch.from_arrays([first, pa.array(lang, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held_out: int = 2, most_texts: int = 300, most_chars: int = 2_000, most_symbols: int = 40_000) -> Languages:
    """Automata of the languages that rows outside the held-out fold name.

    Of each language, texts are taken in order of a hash of the id, from the first most_texts or so, one of each id,
    while they have at most most_symbols symbols together, or one. Texts of more than most_chars characters, which are
    chosen alike, give most_chars of them, in pieces spread over the whole text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.length(F.col(text_col).cast("string")).alias("chars"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.col("chars") > 0) & (fold("id", modulus) != held_out))
    # a row a language; their automata go to all tasks anyway
    counts = [(r["lang"], r["c"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("c")).collect()]
    counted = F.broadcast(spark.createDataFrame(counts, "lang string, c long"))
    # a share of each language's hashes that holds about 4 * most_texts ids, so that what is ranked has a bound
    near = rows.join(counted, "lang")
    near = near.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * F.col("c") < (4 * most_texts) << 20).groupBy("id").agg(F.min("lang").alias("lang"))
    ranked = near.selectExpr("id", "lang", "row_number() OVER (PARTITION BY lang ORDER BY pmod(xxhash64(id), 1 << 20), xxhash64(id), id) AS k").where(F.col("k") <= most_texts)
    found = texts_of(docs, ranked, id_col, text_col, most_chars).sort_by("k")
    texts: dict[str, list[str]] = {}
    for lang, pieces in zip(found["lang"].to_pylist(), found["pieces"].to_pylist(), strict=True):
        texts.setdefault(lang, []).append(chr(0x10FFFF).join(pieces))  # a byte that no text has parts them
    return Languages(texts, most_symbols)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held_out: int = 2, **settings) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    lang_pred is a language of rows outside the held-out fold (crc32 of the id modulo modulus), or und for null and
    empty texts, texts without any letter, and where no labelled text was found. score is 1 - least / second least
    entropy: 0 for und and ties, of which the first language in order wins. Null languages and ids are not learned
    from; rows with a null id are identified (their fold is that of empty text). Repeated rows get equal results, rows
    of one id each by its own text. A very long text is parsed whole, with memory in proportion to it. Without
    documents there are no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, modulus, held_out, **settings))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(partial(_identified, column=None, model=model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select("doc_id", (fold("doc_id", modulus) == held_out).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs in a language that was identified; those with lang_pred und go. Columns stay as they are."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col=text_col, **settings))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(partial(_identified, column=text_col, model=model), schema).where(F.col("lang_pred") != UNDETERMINED).select("row.*")
