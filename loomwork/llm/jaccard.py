"""Exact Jaccard links between documents' sets of word shingles, and their connected components.

1. Each distinct set is cut into parts by the hash of its elements, a few more than the elements in which two
   linking sets can differ.  So linking sets have several parts alike, and a set that has fewer parts in common
   with all others links with nothing.  Only hashes of parts are shuffled, a few bytes a shingle, and only
   counts come back.  What is left are sets that have near copies, about in proportion to the input, whatever
   chance meetings of single shingles there are.
2. A size-aware heavy-light join of those sets:

   * Their shingles are counted exactly; rare first is the global order.
   * Small sets: the subsets of the size that a link needs are enumerated; sets link only if they share one.
   * Large sets: inverted lists of the prefix shingles are scanned, with filters of size, position and bitmaps.
   * The boundary between small and large is where the counted cost of both together is least.
3. Within a list first everyone meets a pivot (a star, linear in the list); what that leaves in different
   components meets pairwise.  Links inside one component need no check, so large groups of near copies cost no
   pairs, and none between different components is skipped: the result is exact (up to equal 64-bit hashes).

Vertices are distinct sets, so copies cost nothing and neither null nor repeated ids matter.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, release, shared_checkpoint
from .shingles import mix64, shingle_hashes

CHUNK_TOKENS, CHUNK_DOCS = 500_000, 60_000
#: Sets up to this size may be handled by subsets; the boundary within is chosen by cost.
SMALL = 24
#: Rounds against pivots at most (none after one that helped little), and meetings an entry, on average, from which a round pays: fewer are met pairwise at once.
STAR_ROUNDS, MEET = 6, 4
#: Rows that may be broadcast (8 bytes each) to pick the candidates' texts; beyond, a shuffled join does.
BROADCAST_IDS = 500_000
_LOCAL = np.uint32(1 << 31)
_NEVER = 1 << 30
_SET = ["sid", "n", "u", "b0", "b1", "b2", "b3"]


def overlap(n: int, m: int, num: int, den: int) -> int:
    """The least intersection with which sets of n and m elements link: den * i >= num * (n + m - i)."""
    return -(-num * (n + m) // (num + den))


def prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """So many first elements, in any order common to all sets, cannot all miss a partner's."""
    return n - -(-num * n // den) + 1


def size_tags(most: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Tags of sizes: (first size of each, elements in which linking sets that meet under it differ at most).

    A size grows to the first of the next tag by den / num, so sets link only within a tag or with the next one's;
    a set goes by its own tag and by the one before.
    """
    first = [1]
    while first[-1] <= most:
        first.append(first[-1] * den // num + 1)
    first = np.array([*first, first[-1] * den // num + 1], np.int64)
    return first[:-1], (first[1:] - 1) * (den - num) // num


def part_keys(every: np.ndarray, n: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For sets (``every``: their sorted elements, one set after the other; ``n``: their sizes), under the own tag and
    under the one before: (set, hash of a part, for each set how many parts must be another's too).

    With ``differ + spare`` parts, two linking sets have ``spare`` alike at least.  Empty parts say nothing; they are
    left out, and the number asked for is less by them, where that leaves any.
    """
    first, differ = size_tags(int(n.max(initial=1)), num, den)
    own = np.searchsorted(first, n, side="right") - 1
    doc = np.repeat(np.arange(len(n)), n)
    cuts = np.concatenate(([0], np.cumsum(n)))
    out = []
    for tag in (own, own - 1):
        d = np.where((tag < 0) | (n == 0), 0, differ[np.maximum(tag, 0)])
        spare = 2 + d // 4
        parts = np.where(d > 0, d + spare, 0)
        base = np.concatenate(([0], np.cumsum(parts)))
        used = parts[doc] > 0
        part = ((every >> np.uint64(32)) * parts[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot = base[doc] + part
        count = np.bincount(slot[used], minlength=base[-1])
        # elements of a part lie side by side, as they are sorted
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(every ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)))
        owner = np.repeat(np.arange(len(n)), parts)
        upto = np.concatenate(([0], np.cumsum(count)))
        ends = upto[1:] + np.repeat(cuts[:-1] - upto[base[:-1]], parts)
        value = sums[ends] - sums[ends - count]
        which = np.arange(base[-1]) - base[owner]
        key = mix64(mix64(value + np.uint64(0x9E3779B97F4A7C15) * which.astype(np.uint64)) ^ (tag[owner].astype(np.uint64) << np.uint64(40)) ^ count.astype(np.uint64))
        few = np.bincount(owner[count == 0], minlength=len(n))
        whole = few >= spare  # rare: then all parts count, and one of them may do
        need = np.where(d == 0, _NEVER, np.where(whole, 1, spare - few))
        sent = (count > 0) | whole[owner]
        out.append((owner[sent], key[sent], need))
    return out


def _parts(words: int, num: int, den: int, ranges: int):
    """Documents -> for each chunk and range of the hashes: hashes of parts and their sets; and the chunk's documents.

    A part that several sets of the chunk have is sent once, as such; those sets have it counted here.
    """

    def pack(cid: int, ids: list, rows: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([*sets, np.empty(0, np.uint64)])
        bounds = np.concatenate(([0], np.cumsum(n)))
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))) for x in (every, mix64(every ^ np.uint64(0x5851F42D4C957F2D)))]
        fp1, fp2 = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
        sid = mix64(mix64(fp1 + n.astype(np.uint64)) + fp2) & ~np.uint64(1) | np.uint64(1 << 63)
        _, one = np.unique(sid, return_index=True)  # equal sets of the chunk go as one
        pick = np.zeros(len(n), bool)
        pick[one] = n[one] > 0
        kept = np.flatnonzero(pick)
        found = part_keys(every[np.repeat(pick, n)], n[kept], num, den)
        need = np.full((len(n), 2), _NEVER, np.int64)
        seen = np.zeros((len(n), 2), np.int64)
        who, key = [], []
        for t, (owner, k, want) in enumerate(found):
            need[kept, t] = want
            who.append(owner * 2 + t)
            key.append(k)
        who, key = np.concatenate(who), np.concatenate(key)
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(start, len(key)))
        many = np.repeat(count > 1, count)
        local = np.bincount(who[many], minlength=2 * len(kept)).reshape(-1, 2)
        seen[kept] = local
        key, who = key[start], who[start]
        owner = np.where(count > 1, np.uint64(0), sid[kept][who // 2] | (who % 2).astype(np.uint64)) if len(key) else np.empty(0, np.uint64)
        where = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        low = key.astype(np.uint32)
        cuts = np.searchsorted(where, np.arange(ranges + 1))
        home = cid % ranges
        go = [r for r in range(ranges) if cuts[r] < cuts[r + 1] or r == home]
        table = pickle.dumps({"doc_id": ids, "row": rows, "n": n, "sid": np.where(n > 0, sid, 0).astype(np.int64), "need0": need[:, 0], "need1": need[:, 1], "seen0": seen[:, 0], "seen1": seen[:, 1]}, protocol=5)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(go, pa.int32()),
                pa.array([low[cuts[r] : cuts[r + 1]].tobytes() for r in go], pa.binary()),
                pa.array([owner[cuts[r] : cuts[r + 1]].tobytes() for r in go], pa.binary()),
                pa.array([table if r == home else None for r in go], pa.binary()),
            ],
            ["rng", "key", "owner", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cid, ids, rows, sets, size = TaskContext.get().partitionId() * 1021, [], [], [], 0
        for b in batches:
            for i, r, t in zip(b.column("id").to_pylist(), b.column("row").to_pylist(), b.column("t").to_pylist()):
                s = shingle_hashes(t, words)
                ids.append(i)
                rows.append(r)
                sets.append(s)
                size += len(s)
                if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield pack(cid, ids, rows, sets)
                    cid, ids, rows, sets, size = cid + 1, [], [], [], 0
        if ids:
            yield pack(cid, ids, rows, sets)

    return run


_MARKED = "doc_id long, row long, n long, sid long, need0 long, need1 long, seen0 long, seen1 long"


def _shared_parts(rows: pd.DataFrame) -> pd.DataFrame:
    """One range of the hashes: its documents (n is set), and how many of each set's parts are another set's too."""
    key = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["key"]])
    owner = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["owner"]])
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    out = [pd.DataFrame({"doc_id": pd.array(t["doc_id"], dtype="Int64"), **{c: pd.array(t[c], dtype="Int64") for c in ("row", "n", "sid", "need0", "need1", "seen0", "seen1")}}) for t in (pickle.loads(x) for x in rows["docs"] if x is not None)]
    if len(key):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(start, len(key)))
        first, last = owner[start], owner[start + count - 1]  # sorted: different if any are; 0 stands for several
        met = np.repeat((first != last) | (first == 0), count)
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        who, times = np.unique(owner[met & new & (owner != 0)], return_counts=True)
        before = (who & np.uint64(1)).astype(bool)
        null = pd.array([None] * len(who), dtype="Int64")
        out.append(pd.DataFrame({"doc_id": null, "row": null, "n": null, "sid": pd.array((who & ~np.uint64(1)).astype(np.int64), dtype="Int64"), "need0": null, "need1": null, "seen0": pd.array(np.where(before, 0, times), dtype="Int64"), "seen1": pd.array(np.where(before, times, 0), dtype="Int64")}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.array([], dtype="Int64") for c in ("doc_id", "row", "n", "sid", "need0", "need1", "seen0", "seen1")})


def _scatter(ranges: int):
    """(sid, s) -> for each chunk and range: distinct shingles, counts, and the sets they are in."""

    def pack(cid: int, ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([*sets, np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        tok, doc = every[order], np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
        first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.empty(0, np.int64)
        uniq, count = tok[first], np.diff(np.append(first, len(tok))).astype(np.uint32)
        where = ((uniq >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        # a shingle of many of the chunk's sets is sent as a count; who has it stays with the chunk
        local = count >= max(64, len(n) // 16)
        held = [(int(uniq[j]), doc[first[j] : first[j] + count[j]]) for j in np.flatnonzero(local)]
        sent = np.repeat(~local, count)
        cuts = np.searchsorted(where, np.arange(ranges + 1))
        ends = np.concatenate(([0], np.cumsum(np.where(local, 0, count), dtype=np.int64)))
        doc = doc[sent]
        flagged = np.where(local, count | _LOCAL, count).astype(np.uint32)
        home = cid % ranges
        rows = [r for r in range(ranges) if cuts[r] < cuts[r + 1] or r == home]
        table = pickle.dumps({"ids": ids, "n": n, "bits": np.stack([bitmap(x) for x in sets]), "held": held}, protocol=5)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int32()),
                pa.array([cid] * len(rows), pa.int64()),
                pa.array([uniq[cuts[r] : cuts[r + 1]].tobytes() for r in rows], pa.binary()),
                pa.array([flagged[cuts[r] : cuts[r + 1]].tobytes() for r in rows], pa.binary()),
                pa.array([doc[ends[cuts[r]] : ends[cuts[r + 1]]].tobytes() for r in rows], pa.binary()),
                pa.array([table if r == home else None for r in rows], pa.binary()),
            ],
            ["rng", "cid", "tok", "cnt", "doc", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cid, ids, sets, size = TaskContext.get().partitionId() << 24, [], [], 0
        for b in batches:
            for i, x in zip(b.column("sid").to_pylist(), b.column("s")):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                ids.append(i)
                sets.append(s)
                size += len(s)
                if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield pack(cid, ids, sets)
                    cid, ids, sets, size = cid + 1, [], [], 0
        if ids:
            yield pack(cid, ids, sets)

    return run


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """One range of the hash space: keep what occurs at least twice in all, with its count."""
    toks = [np.frombuffer(x, np.uint64) for x in rows["tok"]]
    flags = [np.frombuffer(x, np.uint32) for x in rows["cnt"]]
    tok, flag = np.concatenate(toks), np.concatenate(flags)
    _, inverse = np.unique(tok, return_inverse=True)
    df = np.bincount(inverse, flag & ~_LOCAL).astype(np.int64)[inverse] if len(tok) else np.empty(0, np.int64)
    out, at = [], 0
    for r, t, f in zip(rows.itertuples(index=False), toks, flags):
        d = df[at : at + len(t)]
        at += len(t)
        keep = d >= 2
        if not keep.any() and r.docs is None:
            continue
        who = np.frombuffer(r.doc, np.uint16)
        here = np.where(f & _LOCAL, 0, f)
        out.append((r.cid, t[keep].tobytes(), f[keep].tobytes(), np.minimum(d[keep], 2**31).astype(np.uint32).tobytes(), who[np.repeat(keep, here)].tobytes(), r.docs))
    return pd.DataFrame(out, columns=["cid", "tok", "cnt", "df", "doc", "docs"])


def bitmap(s: np.ndarray) -> np.ndarray:
    """Four words of 64 bits, of which each element sets one: two sets differ in as many elements at least as bits."""
    bits = np.zeros(256, np.uint8)
    bits[(s & np.uint64(255)).astype(np.int64)] = 1
    return np.packbits(bits).view(">u8").astype(np.int64)


def _prefixes(num: int, den: int):
    """One chunk: (sid, n, u, bits, keys).  ``u`` shingles are the set's alone; ``keys`` are the rest of its prefix,
    rarest first (all of them for small sets).  Sets that cannot link are left out."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        t = pickle.loads(next(x for x in rows["docs"] if x is not None))
        held = dict(t["held"])
        who, keys, dfs = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for r in rows.itertuples(index=False):
            key = np.frombuffer(r.tok, np.uint64)
            flag, df = np.frombuffer(r.cnt, np.uint32), np.frombuffer(r.df, np.uint32).astype(np.int64)
            here = np.where(flag & _LOCAL, 0, flag)
            who.append(np.frombuffer(r.doc, np.uint16).astype(np.int64))
            keys.append(np.repeat(key, here))
            dfs.append(np.repeat(df, here))
            for j in np.flatnonzero(flag & _LOCAL):
                docs = held[int(key[j])].astype(np.int64)
                who.append(docs)
                keys.append(np.full(len(docs), key[j], np.uint64))
                dfs.append(np.full(len(docs), df[j], np.int64))
        w, k, d = np.concatenate(who), np.concatenate(keys), np.concatenate(dfs)
        order = np.lexsort((k, d, w))
        w, k = w[order], (k[order] >> np.uint64(1)).astype(np.int64)
        n = t["n"]
        bounds = np.searchsorted(w, np.arange(len(n) + 1))
        u = n - np.diff(bounds)
        p = prefix(n, num, den)
        able = np.flatnonzero((n > 0) & (u < p))
        out = [k[bounds[i] : bounds[i + 1]] if n[i] <= SMALL else k[bounds[i] : bounds[i] + p[i] - u[i]] for i in able]
        return pd.DataFrame({"sid": np.array(t["ids"], np.int64)[able], "n": n[able], "u": u[able], **{f"b{j}": t["bits"][able, j] for j in range(4)}, "keys": out})

    return run


def prefix_keys(members: DataFrame, num: int, den: int) -> DataFrame:
    """sid, n, u, b0 to b3, keys of distinct sets (see ``_prefixes``)."""
    # two ranges for each input partition: a range then holds half of what a partition does, about
    ranges = max(16, 2 * members.rdd.getNumPartitions())
    sent = members.mapInArrow(_scatter(ranges), "rng int, cid long, tok binary, cnt binary, doc binary, docs binary")
    counted = sent.groupBy("rng").applyInPandas(_count, "cid long, tok binary, cnt binary, df binary, doc binary, docs binary")
    return counted.groupBy("cid").applyInPandas(_prefixes(num, den), "sid long, n long, u long, b0 long, b1 long, b2 long, b3 long, keys array<long>")


def subset_sizes(n: int, most: int, num: int, den: int) -> list[int]:
    """Intersections that a set of n elements needs with partners of at most ``most``."""
    partners = range(-(-num * n // den), min(most, den * n // num) + 1)
    return sorted({c for m in partners if (c := overlap(n, m, num, den)) <= min(n, m)})


def boundary(sets: dict[int, int], scans: list[int], num: int, den: int) -> int:
    """The size up to which subsets are cheaper.  ``sets``: how many of each size; ``scans[s]``: the squares of the
    lengths of all inverted lists, summed, if sets up to size s are handled by subsets."""

    def cost(s: int) -> int:
        return scans[s] + sum(k * sum(math.comb(n, c) for c in subset_sizes(n, s, num, den)) for n, k in sets.items() if n <= s)

    return min(range(len(scans)), key=cost)


def _subsets(most: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, at = [], []
            for i, (n, keys) in enumerate(zip(b.column("n").to_pylist(), b.column("keys").to_pylist())):
                keys = np.sort(np.array(keys, np.int64).astype(np.uint64))
                for c in subset_sizes(n, most, num, den):
                    if c > len(keys):
                        continue
                    rows = np.array(list(combinations(range(len(keys)), c)), np.int64)
                    h = np.full(len(rows), c, np.uint64)
                    for col in keys[rows].T:
                        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + col)
                    key.append((h | np.uint64(1 << 63)).astype(np.int64))  # below 0: no shingle's key
                    at.append(np.full(len(rows), i, np.int64))
            key, at = (pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (key, at))
            same = [b.column(c).take(at) for c in _SET]
            yield pa.RecordBatch.from_arrays([key, *same, pa.array(np.full(len(key), -1, np.int64))], ["key", *_SET, "pos"])

    return run


def inverted_lists(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, the set's columns, pos): subsets of small sets (pos -1) and prefix shingles of large ones."""
    size = (F.col("n") - F.ceil(F.col("n") * num / den) + 1 - F.col("u")).cast("int")
    lists = sets.select(F.posexplode(F.slice("keys", F.lit(1), size)).alias("i", "key"), *_SET).select("key", *_SET, (F.col("u") + F.col("i")).alias("pos"))
    small = sets.filter(F.col("n") <= SMALL)
    stats = {r["n"]: r["sets"] for r in small.groupBy("n").agg(F.count("*").alias("sets")).collect()}  # SMALL rows at most
    if not stats:
        return lists

    def low(most: int) -> int:
        """The least size of a set that may link with one above ``most``: it is in the lists too."""
        return -(-num * (most + 1) // den)

    each = lists.groupBy("key").agg(*[F.count_if(F.col("n") >= low(s)).alias(f"c{s}") for s in range(SMALL + 1)])
    scans = each.agg(*[F.sum(F.col(f"c{s}").cast("decimal(38,0)") * F.col(f"c{s}")) for s in range(SMALL + 1)]).first()
    most = boundary(stats, [int(x or 0) for x in scans], num, den)
    if most == 0:
        return lists
    return lists.filter(F.col("n") >= low(most)).unionByName(sets.filter(F.col("n") <= most).select(*_SET, "keys").mapInArrow(_subsets(most, num, den), f"key long, {', '.join(f'{c} long' for c in _SET)}, pos long"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b) but the roots: the least vertex of its component.

    Alternating large-star and small-star steps; the work of each is linear in the edges.  They end when no vertex
    has two edges to lesser ones, or edges to lesser and greater ones: then all are stars around their least vertex.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).filter("v != w").distinct()
    old = None
    while True:
        both = e.select(F.col("v").alias("x"), F.col("w").alias("y")).union(e.select("w", "v"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("w")).filter("v != w").distinct()
        least = large.groupBy("v").agg(F.min("w").alias("m"))
        small = large.join(least, "v").select("v", "w", "m")
        e = shared_checkpoint(small.select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("w")), F.struct(F.col("w").alias("v"), F.col("m").alias("w")))).alias("e")).select("e.*").filter("v != w").distinct())
        if old is not None:
            release(old)
        old = e
        ends = e.select(F.col("v").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("w", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            return e.select("v", F.col("w").alias("root"))


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append(common * (num + den) >= num * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep, pa.bool_())), b.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def _hash_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array([shingle_hashes(t, words).tobytes() for t in b.column("t").to_pylist()], pa.binary())], ["sid", "s"])

    return run


def _able(a: str, b: str, num: int, den: int) -> F.Column:
    """Whether the sizes of two sets allow a link, and the bits in which their bitmaps differ."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.b{j}").bitwiseXOR(F.col(f"{b}.b{j}"))) for j in range(1, 4)), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    return (n * den >= m * num) & (m * den >= n * num) & ((n + m - differ) * (num + den) >= (n + m) * (2 * num))


def _meetings(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of sets with different labels that meet in a list and pass the filters of size, position
    and bitmaps.  Of each list those outside its largest component meet everyone of another component.
    """
    one, two = lists.filter("label != top").alias("x"), lists.alias("y")
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) * (num + den) >= (F.col("x.n") + F.col("y.n")) * num
    once = (F.col("y.label") == F.col("y.top")) | (F.col("x.sid") < F.col("y.sid"))
    met = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & once & (room | (F.col("x.pos") < 0)) & _able("x", "y", num, den))
    return met.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()


def _open(lists: DataFrame) -> tuple[DataFrame, int, int]:
    """The lists that hold several labels, with the label that most entries have; their entries, and the meetings left in them.

    What is joined on keys is written first, so both sides of the join are dealt anew and a hot key can be split.
    """
    keys = lists.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels")).filter("labels > 1")
    keys = shared_checkpoint(keys.select("key", "total", F.col("m.c").alias("most"), F.col("m.label").alias("top")))
    entries, work = keys.agg(F.sum("total"), F.sum(F.col("total").cast("decimal(38,0)") * (F.col("total") - F.col("most")))).first()
    out = shared_checkpoint(lists.drop("top").join(keys.select("key", "top"), "key"))
    release(keys)
    return out, int(entries or 0), int(work or 0)


def jaccard_components(docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; with ``row_col``, a (long) key of the row, also
    class_id (a number that all rows of a component share, whatever their ids; null for empty sets) and that key.

    Documents link when den * |intersection| >= num * |union| of their sets of ``words``-word shingles
    (fewer words: the sequence itself).  Null, empty and wordless texts have an empty set and link with
    nothing.  The component is the least id that links reach.  Repeated rows are repeated; rows that share an id
    but not the text are documents of their own; rows with a null id have the least id that they reach, null if
    there is none.  An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t"))
    rows = rows.withColumn("row", F.xxhash64("id", "t")) if row_col is None else docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t"), docs[row_col].cast("long").alias("row"))
    # two ranges for each input partition: a range then holds half of what a partition does, about
    ranges = max(16, 2 * rows.rdd.getNumPartitions())
    sent = rows.mapInArrow(_parts(words, num, den, ranges), "rng int, key binary, owner binary, docs binary")
    marked = shared_checkpoint(sent.groupBy("rng").applyInPandas(_shared_parts, _MARKED))
    seen = [F.coalesce(F.max(F.when(F.col("n").isNotNull(), F.col(f"seen{t}"))), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("n").isNull(), F.col(f"seen{t}"))), F.lit(0)) >= F.min(f"need{t}") for t in (0, 1)]
    classes = shared_checkpoint(marked.filter("sid != 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), (seen[0] | seen[1]).alias("able")))
    ids = classes.filter("able").select("row", "sid")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = rows.join(ids, "row").select("sid", "t")
    # equal rows come once each
    members = shared_checkpoint(texts.mapInArrow(_hash_sets(words), "sid long, s binary").groupBy("sid").agg(F.first("s").alias("s")))
    sets = shared_checkpoint(prefix_keys(members, num, den))
    lists = inverted_lists(sets, num, den)
    lists, entries, work = _open(lists.withColumn("label", F.col("sid")))
    release(sets)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(members.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a").join(members.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(_verify(num, den), "a long, b long")

    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 + (den / num - 1) / 2)).cast("int")
    links, turn, before = None, 0, None
    while work:
        stuck = before is not None and work > 0.9 * before
        if turn == STAR_ROUNDS or stuck or work <= MEET * entries:
            found = shared_checkpoint(verified(_meetings(lists, num, den)))
            work = 0
        else:
            # the pivot is a set with few shingles of its own, as the original of a group of copies is; another one each turn
            other = F.col("sid").bitwiseXOR(F.lit(turn * 0x2545F4914F6CDD1D & (1 << 63) - 1))
            banded = lists.withColumn("band", band)
            pivot = F.struct((F.col("u") if turn % 2 == 0 else F.lit(0).cast("long")).alias("o"), other.alias("p"), "label", *_SET)
            pivots = shared_checkpoint(banded.groupBy("key", "band").agg(F.min(pivot).alias("m"), F.count("*").alias("c")).filter("c > 1").select("key", "band", "m.*"))
            met = banded.alias("x").join(pivots.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.label") != F.col("y.label")) & _able("x", "y", num, den))
            # one pivot a member and round: most members of a group agree on it
            pairs = met.groupBy(F.col("x.sid").alias("a")).agg(F.min(F.struct("y.o", "y.p", "y.sid")).alias("m")).select("a", F.col("m.sid").alias("b"))
            found = shared_checkpoint(verified(pairs))
            release(pivots)
        roots = components(found if links is None else links.unionByName(found))
        links = roots.select(F.col("v").alias("a"), F.col("root").alias("b"))
        if work:
            before = work
            labelled = lists.drop("label").join(roots, lists["sid"] == roots["v"], "left").drop("v").withColumn("label", F.coalesce("root", "sid")).drop("root")
            old, (lists, entries, work) = lists, _open(labelled)
            release(old)
            turn += 1
    if links is None:
        links = classes.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0)
    roots = links.select(F.col("a").alias("sid"), F.col("b").alias("root"))
    linked = classes.select("sid", "least").join(roots.unionByName(roots.select(F.col("root").alias("sid"), "root")).distinct(), "sid")
    # written first, so the join below deals both sides anew and a large component can be split
    ends = shared_checkpoint(linked.groupBy("root").agg(F.min("least").alias("component")))
    linked = linked.select("sid", "root").join(ends, "root")
    ends = classes.select("sid", "least").join(linked, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), F.coalesce("component", "least").alias("component"))
    full = marked.filter("n is not null").join(ends, "sid", "left")
    out = full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.col("root").alias("class_id"), "row")
    return out.select("doc_id", "n_shingles", "component_id", "class_id", F.col("row").alias(row_col)) if row_col else out.drop("class_id", "row")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"), words=4, num=85, den=100)


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(l[i : i + 3], ' ') AS g FROM w, unnest(range(1, greatest(2, len(l) - 2))) AS u(i) WHERE len(l) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(other) AS component_id FROM r GROUP BY 1) m ON m.id = d.doc_id"""
ORACLES = {"op2_ngram_jaccard": _SQL}
