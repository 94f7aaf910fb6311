"""Texts scanned in Arrow batches: the terms that they hold and what patterns match.  The rules on what is found stay Column expressions.

Looking for dozens of terms in long texts one by one is what costs there; Python's own search takes a small part of it.
The functions travel by value and need no module on the workers.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain_pattern

HELD = "array<struct<term:string,n:int>>"
#: Java's \s with the classes of Unicode, as Python's has four separators more.
_JAVA_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def terms_held(x: Column, terms: list[str]) -> Column:
    """The terms that a text has, in dictionary order, and how often (``text.count_of``); a null text has none."""
    terms = list(terms)

    def scan(texts: pa.Array) -> pa.Array:
        ends, names, counts = [0], [], []
        for t in texts.to_pylist():
            if t:
                for w in terms:
                    if w in t:
                        names.append(w)
                        counts.append(t.count(w))
            ends.append(len(names))
        rows = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int32())], ["term", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return F.arrow_udf(scan, HELD)(x)


def stripped_length(x: Column) -> Column:
    """Characters of a text without white space at its ends (``text.strip``); 0 for a null one."""

    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([len(t.strip()) if t else 0 for t in texts.to_pylist()], pa.int32())

    return F.arrow_udf(scan, "int")(x)


def any_held(x: Column, terms: Column) -> Column:
    """Whether a text has any of its row's terms; false if either is null."""

    def scan(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([t is not None and ws is not None and any(w in t for w in ws if w is not None) for t, ws in zip(texts.to_pylist(), lists.to_pylist())], pa.bool_())

    return F.arrow_udf(scan, "boolean")(x, terms)


def all_matches(x: Column, pattern: str, groups: list[int], *, starts: str = "", distinct: bool = True) -> Column:
    """array<array<string>>: the groups of all matches of a pattern (as Java reads it with the classes of Unicode), in order, each
    once or all; a group without a match is empty.  ``starts`` is a class of the characters with which a match begins, if they
    are few: what is between them is passed over.  A null text has none.
    """
    body = pattern.replace(r"\s", _JAVA_SPACE)
    of = re.compile(f"[^{starts}]+|({body})|[{starts}]" if starts else f"({body})")
    takes = tuple(g + 1 for g in groups)

    def scan(texts: pa.Array) -> pa.Array:
        ends, found = [0], []
        for t in texts.to_pylist():
            if t:
                each = [m.group(*takes, 1)[:-1] for m in of.finditer(t) if m.lastindex]
                found.extend(dict.fromkeys(each) if distinct else each)
            ends.append(len(found))
        flat = pa.array([g or "" for m in found for g in m], pa.string())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(takes)), pa.int32()), flat))

    return F.arrow_udf(scan, "array<array<string>>")(x)


def match_number(x: Column, pattern: str) -> Column:
    """How often a pattern (as Java reads it with the classes of ASCII) matches; null for a null text."""
    of = pattern.replace(r"\s", r"[\t-\r ]")

    def scan(texts: pa.Array) -> pa.Array:
        return pc.count_substring_regex(texts, of).cast(pa.int32())

    return F.arrow_udf(scan, "int")(x)


def _python(pattern: str) -> re.Pattern[str]:
    """``text.plain_pattern`` as Python writes it."""
    plain = plain_pattern(pattern)
    if plain.startswith("(?iU)"):
        return re.compile(pattern, re.IGNORECASE)
    if r"[\p{L}\p{M}\p{N}_]" in plain:
        marks = "".join(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
        plain = plain.replace(r"[\p{L}\p{M}\p{N}_]", rf"[\w{marks}]")
    return re.compile(plain.replace(r"\p{Nd}", r"\d").replace("(?iu:", "(?i:"))


def match_counts(x: Column, patterns: list[str]) -> Column:
    """array<struct<i, n>> of an array of texts: for those that any pattern matches, the place (from 0) and the number of distinct
    matches of each pattern, case ignored.  Equal texts of a batch are matched once."""
    of = [_python(p) for p in patterns]

    def scan(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        counts = np.array([[len(set(p.findall(t))) for p in of] for t in flat.dictionary.to_pylist()], np.int32).reshape(-1, len(of))
        codes = flat.indices.to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(len(codes)) - np.repeat(ends[:-1], sizes)
        hit = counts.any(axis=1)[codes] if len(codes) else np.zeros(0, bool)
        kept = np.concatenate([[0], np.cumsum(hit)])[ends]
        n = counts[codes[hit]] if len(codes) else counts
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(of), pa.int32()), pa.array(n.reshape(-1), pa.int32()))
        rows = pa.StructArray.from_arrays([pa.array(place[hit], pa.int32()), inner], ["i", "n"])
        return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), rows)

    return F.arrow_udf(scan, "array<struct<i:int,n:array<int>>>")(x)
