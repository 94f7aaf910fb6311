"""Best-fit packing of token sequences by non-negative least squares over length patterns.

1. Encode each document once (Arrow), cut what is longer than the capacity, and note for each piece its
   rank among the pieces of equal length in its partition.
2. Count pieces by length: at most ``capacity`` numbers, whatever the corpus holds.
3. On that histogram, enumerate patterns of few lengths that fill a sequence, fit repeat counts by
   non-negative least squares, round them down, and put the pieces left over by best fit, longest
   first, into the open room and then into new sequences.  All of it works on counts, not pieces.
4. The plan is a table of ranges (length, ranks) -> (sequence, offset), its size bounded by the
   capacity.  A piece's global rank (local rank plus what other partitions hold) finds its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, shared_checkpoint
from .tokens import default_tokenizer, encoder

CAPACITY = 2048
GRAINS = (16, 32, 128)
#: Shares of the fitted repeats that are realised; the fewer, the more pieces best fit has for the gaps.
SHARES = (1.0, 0.75, 0.5)
DEPTH = 3


def cut_document(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, of which only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def patterns(total: int, depth: int) -> np.ndarray:
    """Non-increasing rows of at most ``depth`` positive bins, zero-filled, that sum to ``total``."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, row: tuple[int, ...]) -> None:
        if left == 0:
            out.append(row + (0,) * (depth - len(row)))
        elif len(row) < depth:
            for b in range(min(left, most), (left - 1) // (depth - len(row)), -1):
                grow(left - b, b, row + (b,))

    grow(total, total, ())
    return np.array(out, dtype=np.int64).reshape(-1, depth)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Least squares with non-negative unknowns by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram_b = a.T @ b
    tol = 1e-9 * (np.abs(gram_b).max() + 1)
    for _ in range(rounds):
        w = gram_b - a.T @ (a[:, passive] @ x[passive])
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= tol:
            break
        passive[j] = True
        while True:
            idx = np.flatnonzero(passive)
            p = a[:, idx]
            s = np.linalg.lstsq(p, b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[idx] = s
                break
            bad = s <= 0
            step = np.min(x[idx][bad] / np.maximum(x[idx][bad] - s[bad], 1e-300))
            x[idx] += step * (s - x[idx])
            gone = idx[(x[idx] <= 1e-12) & bad]
            x[gone] = 0
            passive[gone] = False
            if not passive.any():
                return x
    return x


def plan_groups(counts: np.ndarray, capacity: int, grain: int, depth: int = DEPTH, shares: tuple[float, ...] = (1.0,)) -> list[tuple[int, tuple[int, ...]]]:
    """Groups (repeats, lengths) that place ``counts[length]`` pieces of each length, all of them.

    One fit, of which each of ``shares`` is realised; the one with the fewest sequences counts.  Pieces shorter than an eighth of the capacity are not fitted: they fill the gaps afterwards.
    """
    left = counts.astype(np.int64).copy()
    groups: list[tuple[int, tuple[int, ...]]] = [(int(left[capacity]), (capacity,))] if left[capacity] else []
    left[capacity] = 0
    bins = capacity // grain
    small = left.copy()
    small[capacity // 8 :] = 0
    left -= small
    binned = np.zeros(bins + 1)
    np.add.at(binned, -(-np.arange(capacity + 1) // grain), left)
    rows = patterns(bins, depth)
    rows = rows[((binned[rows] > 0) | (rows == 0)).all(1)]
    if not len(rows):
        return best_fit(groups, left + small, capacity)
    a = np.zeros((bins + 1, len(rows)))
    for d in range(depth):
        np.add.at(a, (rows[:, d], np.arange(len(rows))), 1.0)
    weight = np.arange(bins + 1) / bins  # short pieces fill gaps easily: their misfit counts less
    fit = nnls(a * weight[:, None], binned * weight, 3 * bins)
    found = []
    for share in shares:
        repeats, rest, taken = np.floor(fit * share + 1e-6).astype(np.int64), left.copy(), list(groups)
        for j in sorted(np.flatnonzero(repeats > 0), key=lambda j: tuple(-rows[j])):
            taken += realise([int(b) for b in rows[j] if b], int(repeats[j]), rest, capacity, grain)
        found.append(best_fit(taken, rest + small, capacity))
    return min(found, key=lambda groups: sum(q for q, _ in groups))


def longest(left: np.ndarray, low: int, high: int, used: dict[int, int]) -> int:
    """The greatest length in (low, high] of which pieces are left besides those in ``used``; else 0."""
    for n in np.flatnonzero(left[low + 1 : high + 1])[::-1]:
        if left[low + 1 + n] > used.get(int(low + 1 + n), 0):
            return int(low + 1 + n)
    return 0


def realise(bins: list[int], repeats: int, left: np.ndarray, capacity: int, grain: int) -> list[tuple[int, tuple[int, ...]]]:
    """Turn a pattern of bins into groups of exact lengths, taking them from ``left``.

    The last slot takes the longest piece that fits, up to what the others left of the capacity.
    """
    out = []
    while repeats > 0:
        row: dict[int, int] = {}
        room = capacity
        for i, b in enumerate(bins):
            last = i == len(bins) - 1
            n = longest(left, (b - 1) * grain, min(room, capacity) if last else b * grain, row)
            if not n:
                return out
            row[n] = row.get(n, 0) + 1
            room -= n
        q = min([repeats, *(int(left[n]) // k for n, k in row.items())])
        for n, k in row.items():
            left[n] -= q * k
        out.append((q, tuple(n for n, k in row.items() for _ in range(k))))
        repeats -= q
    return out


def best_fit(groups: list[tuple[int, tuple[int, ...]]], left: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Put ``left[length]`` pieces, longest first, where least room stays; else into new sequences."""
    free: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    open_ = np.zeros(capacity + 1, bool)
    for q, row in groups:
        s = capacity - sum(row)
        free.setdefault(s, []).append((q, row))
        open_[s] = True
    for n in np.flatnonzero(left)[::-1]:
        n, c = int(n), int(left[n])
        while c:
            fits = int(open_[n:].argmax()) + n
            if not open_[fits]:
                k = capacity // n
                for q, m in ((c // k, k), (1 if c % k else 0, c % k)):
                    if q:
                        free.setdefault(capacity - n * m, []).append((q, (n,) * m))
                        open_[capacity - n * m] = True
                break
            q, row = free[fits].pop()
            take = min(c, q)
            if take < q:
                free[fits].append((q - take, row))
            open_[fits] = bool(free[fits])
            free.setdefault(fits - n, []).append((take, row + (n,)))
            open_[fits - n] = True
            c -= take
    merged: dict[tuple[int, ...], int] = {}
    for rows in free.values():
        for q, row in rows:
            key = tuple(sorted(row, reverse=True))
            merged[key] = merged.get(key, 0) + q
    return [(q, row) for row, q in sorted(merged.items(), reverse=True)]


def plan(counts: np.ndarray, capacity: int = CAPACITY, grains: tuple[int, ...] = GRAINS) -> list[tuple[int, tuple[int, ...]]]:
    """The fit with the fewest sequences over the grains of the length bins and the shares of the fit."""
    fits = [plan_groups(counts, capacity, g, shares=SHARES) for g in grains if capacity % g == 0 and capacity // g >= 2] or [plan_groups(counts, capacity, 1, shares=SHARES)]
    return min(fits, key=lambda groups: sum(q for q, _ in groups))


def ranges(groups: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by (length, first rank)."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for q, row in groups:
        offset = 0
        for n in dict.fromkeys(row):
            k = row.count(n)
            rows.append((n, rank.get(n, 0), k, base, offset))
            rank[n] = rank.get(n, 0) + q * k
            offset += n * k
        base += q
    t = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (t[:, 0] << 44) | t[:, 1], "first": t[:, 1], "k": t[:, 2], "base": t[:, 3], "offset": t[:, 4]}


def tokenize_pieces(docs: DataFrame, *, capacity: int, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """Pieces with their partition and their rank among the partition's pieces of the same length."""
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, enc, ranks = TaskContext.get().partitionId(), encoder(tokenizer_path), np.zeros(capacity + 1, np.int64)
        for b in batches:
            texts = [x or "" for x in b.column("t").to_pylist()]
            src, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(enc.encode(texts)):
                ids += b"\0\0\0\0"
                for k, (s, n) in enumerate(cut_document(len(ids) // 4, capacity)):
                    src.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)] if n < len(ids) // 4 else ids))
            n = np.array(length, np.int64)
            order = np.argsort(n, kind="stable")
            sorted_n = n[order]
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.searchsorted(sorted_n, sorted_n) + ranks[sorted_n]
            ranks += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(src, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), pid, np.int32)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "rank"],
            )

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, pid int, rank long")


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds the closing id 0 alone.  Repeated rows are packed
    each by itself, an empty table gives no rows, other columns are not read, and a text of any length
    is cut into pieces of ``capacity`` tokens of which only the first may be shorter.
    """
    pieces = shared_checkpoint(tokenize_pieces(docs, capacity=capacity, tokenizer_path=tokenizer_path or default_tokenizer(), id_col=id_col, text_col=text_col))
    by_part = pieces.groupBy("length", "pid").agg(F.count("*").alias("n"))
    # at most `capacity` rows come here
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator():
        counts[r["length"]] = r["n"]
    table = ranges(plan(counts, capacity)) if counts.any() else ranges([])
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("length", "pid", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(table["key"], (n << 44) | rank, side="right") - 1
            rep, slot = np.divmod(rank - table["first"][at], table["k"][at])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(table["base"][at] + rep), pa.array(table["offset"][at] + slot * n)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLES: dict[str, str] = {}
