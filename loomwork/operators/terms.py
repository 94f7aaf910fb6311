"""Texts against a dictionary that is a table, of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.sources.scratch import checkpointed

#: Dictionaries of more keys than these are joined by a shuffle.
BROADCAST_KEYS = 500_000
_FACTOR = 0x9E3779B97F4A7C15


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def _windows(text: str, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` characters from each place on."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    count = max(0, len(codes) - width + 1)
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(_FACTOR) + codes[k : k + count]
        out ^= out >> np.uint64(29)
    return out


def _grams(rows: DataFrame, text: str, sizes: list[int], asked: np.ndarray | None = None, by_row: bool = True) -> DataFrame:
    """For each row its other columns and ``gram``: hashes of its substrings of the given sizes (null: its column ``_n`` alone), each once;
    of ``asked`` (sorted) only, if given.  Without ``by_row``: (gram, met), how many of the rows of a batch have it."""
    kept = [f for f in rows.schema.fields if f.name != text]

    def found(x: str, widths: list[int]) -> np.ndarray:
        h = np.unique(np.concatenate([_windows(x, n) for n in widths]))
        return h if asked is None else h[asked[np.minimum(np.searchsorted(asked, h), len(asked) - 1)] == h] if len(asked) else h[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                widths = [[n] for n in b.column("_n").to_pylist()] if not sizes else [sizes] * b.num_rows
                got = [found(x, w) for x, w in zip(b.column(text).to_pylist(), widths)]
                every = np.concatenate(got).view(np.int64)
                if by_row:
                    at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
                    yield pa.RecordBatch.from_arrays([*[b.column(f.name).take(at) for f in kept], pa.array(every)], [*[f.name for f in kept], "gram"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(every, return_counts=True)], ["gram", "met"])

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{named}, gram long" if by_row else "gram long, met long")


def _listed(grams: DataFrame) -> np.ndarray | None:
    """The distinct grams, sorted, if they are few enough to go to every task; else None."""
    distinct = grams.select("gram").distinct()
    first = distinct.limit(BROADCAST_KEYS + 1).toPandas()["gram"].to_numpy(np.int64)
    return np.sort(first.view(np.uint64)) if len(first) <= BROADCAST_KEYS else None


def contained_terms(texts: DataFrame, terms: DataFrame, *, key: str, text: str, term: str, width: int = 5) -> DataFrame:
    """(key, term): which terms of a table stand in which texts, each pair once.

    A text that holds a term holds each of its substrings of ``width`` characters (a shorter term: itself).  The rarest of them
    over all texts is the term's key, so hot substrings bring no candidates; keys meet the texts' substrings in an equi-join, and
    only such candidates are looked into.  Substrings go by 64-bit hashes: equal ones bring a candidate more, no wrong result.
    Null texts, null and empty terms meet nothing; texts that share a key count together.
    """
    rows = texts.select(key, F.col(text).cast("string").alias("_text")).filter("_text is not null and _text <> ''")
    words = terms.select(F.col(term).alias("term")).filter("term is not null and term <> ''").distinct()
    words = words.withColumn("_n", F.least(F.lit(width), F.char_length("term")))
    sizes = sorted(r["_n"] for r in words.select("_n").distinct().collect())  # no more numbers than ``width``
    if not sizes:
        return rows.join(words.select("term"), F.lit(False)).select(key, "term")
    parts = _grams(words.withColumn("_whole", F.col("term")), "_whole", []).select("term", "gram")
    met = _grams(rows.select("_text"), "_text", sizes, _listed(parts), by_row=False)
    counts = met.groupBy("gram").agg(F.sum("met").alias("_met"))
    # a substring that no text has tells that none has the term
    rarest = parts.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("_met", F.lit(0).cast("long")).alias("met"), "gram")).alias("r"))
    chosen = checkpointed(rarest.filter("r.met > 0").select("term", F.col("r.gram").alias("gram")))
    found = _grams(rows, "_text", sizes, _listed(chosen)).join(few(chosen, BROADCAST_KEYS), "gram").select(key, "term").distinct()
    return found.join(rows, key).filter(F.contains("_text", F.col("term"))).select(key, "term").distinct()
