"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

A text's word shingles are hashed once.  The top bits of a hash choose its bin and the bin keeps its
least hash.  An empty bin copies from a bin that it finds by a fixed sequence of hashed tries until one
is full (optimal densification: the tries depend on the empty bin alone, so two sets choose alike).
Of each bin ``bits`` low-order bits are stored; likeness subtracts the chance that those agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, shared_checkpoint
from .shingles import mix64, shingle_hashes

BINS, BITS, WORDS = 256, 4, 5
TRIES = 512
#: Documents that one stretch of the id order holds, about, and how many stretches there are at most: their first rows
#: are broadcast, 24 bytes each.  Beyond, stretches grow; they are sorted with spills and streamed, never held.
STRETCH_DOCS, MOST_STRETCHES = 1000, 20_000


def donors(bins: int) -> np.ndarray:
    """donors[t, b]: the bin that the empty bin b asks at try t."""
    t, b = np.meshgrid(np.arange(TRIES, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (mix64((t + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bins)).astype(np.int64)


_DONORS: dict[int, np.ndarray] = {}


def densified(hashes: np.ndarray, bins: int) -> np.ndarray | None:
    """The least hash of each bin, empty bins filled; None for an empty set.  ``hashes`` are sorted."""
    if not len(hashes):
        return None
    if bins not in _DONORS:
        _DONORS[bins] = donors(bins)
    where = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[where[first]] = hashes[first]
    full[where[first]] = True
    need, own = np.flatnonzero(~full), full.copy()
    for row in _DONORS[bins]:
        if not len(need):
            break
        ask = row[need]
        ok = own[ask]
        out[need[ok]] = out[ask[ok]]
        need = need[~ok]
    if len(need):  # all tries failed: the nearest full bin above, round the end
        at = np.flatnonzero(own)
        out[need] = out[at[np.searchsorted(at, need) % len(at)]]
    return out


def fingerprint(text: str | None, *, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> bytes:
    """``bins * bits / 8`` bytes; none for a text without words."""
    mins = densified(shingle_hashes(text, words), bins)
    if mins is None:
        return b""
    low = (mix64(mins) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(((low[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).astype(np.uint8).reshape(-1)).tobytes()


def likeness(a: bytes, b: bytes, *, bits: int = BITS) -> float:
    """Estimated Jaccard similarity: the share of equal bins less what chance gives, from 0 to 1.

    Two texts without words are alike (1); one such text is unlike any other (0).
    """
    if not a or not b:
        return float(a == b)
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits)
    same, chance = 1.0 - x.any(1).mean(), 2.0**-bits
    return float(min(1.0, max(0.0, (same - chance) / (1.0 - chance))))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``id_col``, fingerprint (binary) of every row; null texts count as empty (a fingerprint of no bytes)."""
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([fingerprint(x, words=words, bins=bins, bits=bits) for x in b.column("t").to_pylist()], pa.binary())], [id_col, "fingerprint"])

    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema['id'].dataType.simpleString()}, fingerprint binary")


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the following text as there is."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


class Stretches:
    """The order of documents (ids descending, null ids last, equal ids by descending hash of their texts), cut into stretches.

    Edges are quantiles of the ids, so stretches hold equally many rows.  An id that takes several edges, and null
    ids, are spread over as many stretches by their hashes.
    """

    def __init__(self, ids: DataFrame):
        n, null = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
        parts = min(MOST_STRETCHES, (n - null) // STRETCH_DOCS)
        self.null_parts = int(max(1, min(MOST_STRETCHES, null // STRETCH_DOCS)))
        edges = ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
        self.edges = np.array(edges or [], np.int64)

    def of(self, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        share = (hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) / 2.0**64
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        left, right = np.searchsorted(self.edges, known), np.searchsorted(self.edges, known, side="right")
        at = len(self.edges) - left - np.floor(share * np.maximum(right - left, 1)).astype(np.int64).clip(0, np.maximum(right - left - 1, 0))
        nulls = len(self.edges) + self.null_parts - np.floor(share * self.null_parts).astype(np.int64).clip(0, self.null_parts - 1)
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), nulls, at)


def with_successor(docs: DataFrame) -> DataFrame:
    """(stretch, doc_id, hash, text, mark, own): the rows of each stretch of the order, with their fingerprints.

    The first row of the following stretch (of the first, after the last) comes along, not ``own``, so
    each stretch is complete: no window sees all rows, and texts are shuffled once.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    ids = shared_checkpoint(docs.select("doc_id", "hash"))
    cut = Stretches(ids)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cut.of(b.column("doc_id"), b.column("hash")), pa.int64()), b.column("doc_id"), b.column("hash")], ["stretch", "doc_id", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array(cut.of(b.column("doc_id"), b.column("hash")), pa.int64())
            yield pa.RecordBatch.from_arrays([at, *b.columns, pa.array([fingerprint(x) for x in b.column("text").to_pylist()], pa.binary())], ["stretch", *b.schema.names, "mark"])

    heads = ids.mapInArrow(number, "stretch long, doc_id long, hash long").groupBy("stretch").agg(F.max(F.struct("doc_id", "hash")).alias("head"))
    order = Window.orderBy("stretch")
    last = F.last("stretch").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sent = heads.select(F.coalesce(F.lag("stretch").over(order), last).alias("to"), F.col("head.doc_id").alias("head"), F.col("head.hash").alias("mark_hash"))
    # at most 2 * MOST_STRETCHES rows
    firsts = docs.join(F.broadcast(sent), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("hash") == F.col("mark_hash")))
    copies = firsts.select(F.col("to").alias("stretch"), "doc_id", "hash", "text", F.lit(None).cast("binary").alias("mark"), F.lit(0).alias("own"))
    return docs.mapInArrow(run, "stretch long, doc_id long, hash long, text string, mark binary").withColumn("own", F.lit(1)).unionByName(copies)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with the next in descending order of doc_id, null ids last; equal ids in descending order of the hash of
    their texts.  Null texts are empty; a single document is its own next; an empty table gives no rows."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # within a stretch the copied row comes last
    placed = with_successor(docs).repartition("stretch").sortWithinPartitions("stretch", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (stretch, doc_id, text, mark) that waits for its next document
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            out = []
            for stretch, doc_id, text, mark, own in zip(*[b.column(c).to_pylist() for c in ("stretch", "doc_id", "text", "mark", "own")]):
                if held is not None and held[0] == stretch:
                    changed = edited(held[2], text)
                    other = fingerprint(changed)
                    near = likeness(held[3], fingerprint(text) if mark is None else mark)
                    out.append((held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), held[3].hex(), other.hex(), likeness(held[3], other), near))
                held = (stretch, doc_id, text, mark) if own else None
            cols = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLES: dict[str, str] = {}
