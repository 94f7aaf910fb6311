"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled text answers how far a phrase can go on and
still occur there.  A document is parsed greedily into longest matches against each language; the one
that needs the fewest phrases, weighed by the logarithm of its training length, wins.  The automata are
flattened into transition tables, those of many letters into sorted keys, and all segments of a batch take the same step together.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load
from .quality import id_remainder

#: Bounds of the training sample of each language: documents, characters that slices spread over their whole texts
#: give in all, and slices of a document.
TRAIN_DOCS, LANG_CHARS, SLICES = 96, 24_576, 4
#: So many languages are learned at most, those of the most training documents.
MOST_LANGS = 2000
#: Phrases do not cross the ends of segments of so many symbols, so that long texts can be parsed side by side.
SEGMENT, BLOCK_SEGMENTS = 4096, 4096
#: If the automata of all languages have more cells (states by letters), they are held as sorted keys in place of tables.
DENSE_CELLS = 1 << 24


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 if it is none.  Marks count as letters, since the vowels
    of many scripts are marks; selectors of variants (as of emoji) do not."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(0x40000):  # no letters above
        ch = chr(c)
        if ch.isalpha() or (unicodedata.category(ch) in ("Mn", "Mc") and not 0xFE00 <= c <= 0xFE0F):
            out[c] = ord(ch.lower()[0])
    return out


class Alphabet:
    """Symbols: 0 for runs of anything but letters, 1 for letters that training texts lack, then theirs."""

    def __init__(self, texts: list[str]):
        letters = _letters()
        found = np.unique(letters[_code_points("".join(texts))])
        found = found[found != 0]
        self.size = len(found) + 2
        symbol = np.ones(len(letters), np.int32)
        symbol[found] = np.arange(2, self.size)
        symbol[0] = 0
        self.table = symbol[letters]

    def codes(self, text: str) -> np.ndarray:
        raw = self.table[_code_points(text)]
        keep = raw != 0
        keep[1:] |= raw[:-1] != 0
        return raw[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """The automaton of one text; its columns are the symbols that the text has, and 0 for all others."""

    def __init__(self, codes: np.ndarray, symbols: int, languages: int, dense_cells: int):
        own = np.unique(codes)
        self.width = len(own) + 1
        self.column = np.zeros(symbols + 1, np.int32)  # the last for no symbol
        self.column[own] = np.arange(1, self.width)
        nxt = suffix_automaton(self.column[codes].tolist())
        #: Where documents begin and what a lacking symbol leads to: whatever follows starts a phrase.
        self.closed = len(nxt)
        fresh = np.full(self.width, self.closed, np.int32)
        for c, s in nxt[0].items():
            fresh[c] = s
        self.ended = ~fresh
        keys = np.array([s * self.width + c for s, row in enumerate(nxt) for c in row], np.int64)
        ends = np.array([t for row in nxt for t in row.values()], np.int32)
        self.table = None
        if (self.closed + 1) * self.width * languages <= dense_cells:
            self.table = np.tile(self.ended, self.closed + 1)
            self.table[keys] = ends
        else:
            order = np.argsort(keys)
            self.keys, self.ends = keys[order], ends[order]

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The next states, or ~(the state that the symbol starts anew) where a phrase ends."""
        if self.table is not None:
            return self.table[state * self.width + column]
        key = state.astype(np.int64) * self.width + column
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ends[at], self.ended[column])


@lru_cache(maxsize=1)
def _built(texts: tuple[tuple[str, str], ...], dense_cells: int) -> tuple[Alphabet, list[Parser], np.ndarray]:
    """Made once in a worker, however many tasks it runs; only the last one is kept."""
    alphabet = Alphabet([t for _, t in texts])
    codes = [alphabet.codes(t) for _, t in texts]
    return alphabet, [Parser(c, alphabet.size, len(texts), dense_cells) for c in codes], np.array([np.log2(max(len(c), 2)) for c in codes])


class Model:
    """Automata of each language, built from bounded texts; small to ship, since only texts are pickled."""

    def __init__(self, texts: dict[str, str]):
        self.texts = dict(sorted(texts.items()))
        self.langs = list(self.texts)

    def __getstate__(self):
        return {"texts": self.texts}

    def __setstate__(self, state):
        self.__init__(state["texts"])

    def build(self) -> None:
        self.alphabet, self.parsers, self.weight = _built(tuple(self.texts.items()), DENSE_CELLS)

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """phrases[doc, lang]."""
        self.build()
        pad = self.alphabet.size
        sizes = [max(1, -(-len(c) // SEGMENT)) for c in codes]
        owner = np.repeat(np.arange(len(codes)), sizes)
        flat = np.full(len(owner) * SEGMENT, pad, np.int32)
        at = 0
        for c, n in zip(codes, sizes):
            flat[at : at + len(c)] = c
            at += n * SEGMENT
        grid = flat.reshape(-1, SEGMENT)
        out = np.zeros((len(codes), len(self.langs)))
        for lo in range(0, len(grid), BLOCK_SEGMENTS):
            part = grid[lo : lo + BLOCK_SEGMENTS]
            order = np.argsort((part != pad).sum(1))[::-1]
            steps = np.ascontiguousarray(part[order].T)
            live = (steps != pad).sum(1)
            for k, parser in enumerate(self.parsers):
                columns = parser.column[steps]
                state, count = np.full(len(part), parser.closed, np.int32), np.zeros(len(part), np.int32)
                for row, n in zip(columns, live):
                    if n == 0:
                        break
                    t = parser.step(state[:n], row[:n])
                    ended = t >> 31
                    count[:n] -= ended
                    state[:n] = t ^ ended
                np.add.at(out[:, k], owner[lo : lo + BLOCK_SEGMENTS][order], count)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, confidence) for each text; ("und", 0.0) without any letter."""
        self.build()
        codes = [self.alphabet.codes(t or "") for t in texts]
        seen = [bool((c != 0).any()) and any(ch.isalpha() for ch in t) for c, t in zip(codes, texts)]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        cost = self.phrases(codes) * self.weight
        best = cost.argmin(1)
        sure = 1 / np.exp2(np.maximum(cost.min(1, keepdims=True) - cost, -60) / self.weight).sum(1)
        return [(self.langs[b], float(s)) if ok else ("und", 0.0) for ok, b, s in zip(seen, best, sure)]


def fit(sample: list[tuple[str, str]]) -> Model:
    """A model from (language, text) rows.  Labels may be wrong here and there: each half of the sample is
    judged by a model of the other, and rows whose label it contradicts are left out."""
    by: dict[str, list[str]] = {}
    for lang, text in sorted(sample):
        by.setdefault(lang, []).append(text)

    def model(rows: dict[str, list[str]]) -> Model:
        return Model({x: "\n".join(ts) for x, ts in rows.items() if ts})

    if len(by) > 1 and min(map(len, by.values())) >= 8:
        kept: dict[str, list[str]] = {}
        for half in (0, 1):
            judge = model({x: ts[1 - half :: 2] for x, ts in by.items()})
            for x, ts in by.items():
                mine = ts[half::2]
                kept.setdefault(x, []).extend(t for t, (p, _) in zip(mine, judge.predict(list(mine))) if p == x)
        by = {x: kept[x] if 2 * len(kept[x]) >= len(ts) else ts for x, ts in by.items()}
    return model(by)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from documents with a language whose id's remainder of 4 is not 2: TRAIN_DOCS of each language at most, by
    hash of the id (null ids take no part).  Of their texts, SLICES slices spread from beginning to end are read, so long that a language
    gives about LANG_CHARS characters; shorter texts are read whole.  Every language has its share, up to MOST_LANGS languages.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (id_remainder(F.col(id_col), 4) != 2))
    known = known.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    least = known.groupBy("lang", F.pmod("h", F.lit(TRAIN_DOCS)).alias("salt")).agg(F.min("h").alias("h")).drop("salt")
    # TRAIN_DOCS rows a language at most
    least = least.join(F.broadcast(known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).select("lang")), "lang")
    chosen = least.join(least.groupBy("lang").agg(F.floor(F.lit(LANG_CHARS) / F.count("*")).alias("share")), "lang")
    n, wide = F.char_length("t"), F.floor(F.col("share") / SLICES)
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substr("t", (F.lit(1) + F.floor(i * (n - wide) / (SLICES - 1))).cast("int"), wide.cast("int"))), "\n")
    rows = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.when(n <= F.col("share"), F.col("t")).otherwise(spread)).alias("t"))
    return fit([(r["lang"], r["t"]) for r in rows.toLocalIterator()])


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score (input columns of these names are replaced).

    Texts that are null or without letters are ``und`` with 0; of languages that need equally little the first by name is taken.
    """
    docs = docs.drop("lang_pred", "lang_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, max(whole.num_rows, 1), 1024):
                b = whole.slice(lo, 1024)
                got = model.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*b.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
