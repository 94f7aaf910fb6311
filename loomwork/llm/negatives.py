"""Hard negatives by a pivot table.

Vectors get one more component, sqrt(M2 - |x|^2) with M2 the greatest squared norm, and anchors 0 there.  Then
|q - x|^2 = |q|^2 + M2 - 2 q.x: the greater the inner product, the less the Euclidean distance.  Each row's distances to a
few pivots are stored once.  By the triangle inequality they bracket the distance of any anchor to any row, so the
score, without reading the vector; only rows whose bracket reaches what is asked for are multiplied out, in integers.

Anchors meet rows in blocks of bounded size: positives within a label, whose blocks are hash parts; negatives over blocks of
rows near the same pivot.  The ranges of a block's stored distances bracket the scores of all its rows, and a pair of
blocks that cannot hold a negative is not made.  A hot label, cell or vector is only more blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, load, shared_checkpoint

#: Pivots, the rows that they are chosen from, and the pairs that judge a choice.
PIVOTS, SAMPLE_ROWS, SAMPLE_PAIRS = 8, 1024, 4096
ROW_BLOCK, ANCHOR_BLOCK, CHUNK = 8192, 1024, 2048
#: More labels than these are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Below this squared norm all sums of products are exact in doubles; up to LARGEST they are exact in 64-bit integers.
DOUBLES, LARGEST = 2.0**52, 2.0**62


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers; what a vector lacks is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(ends), width), flat.dtype)
    out[np.arange(width) < ends[:, None]] = flat
    return out


class Pivots:
    """The pivots and the greatest squared norm; tells distances and brackets."""

    def __init__(self, sample: np.ndarray, top: float, n: int = PIVOTS):
        self.top = max(float(top), 1.0)
        self.slack = 1e-9 * self.top  # far above the rounding of distances
        self.pivots = sample[:0].astype(float)
        if len(sample):
            self.pivots = sample.astype(float)
            rng = np.random.default_rng(12)
            far = self.of_rows(sample)
            gap = np.abs(far[rng.integers(0, len(sample), SAMPLE_PAIRS)] - far[rng.integers(0, len(sample), SAMPLE_PAIRS)])
            chosen, best = [], np.zeros(SAMPLE_PAIRS)
            for _ in range(min(n, len(sample))):  # the one that raises the mean lower bound of the pairs most
                j = int(np.maximum(gap, best[:, None]).mean(0).argmax())
                chosen.append(j)
                best = np.maximum(best, gap[:, j])
            self.pivots = self.pivots[chosen]

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of augmented rows to the augmented pivots."""
        x = x.astype(float)
        nx, np_ = (x**2).sum(1), (self.pivots**2).sum(1)
        extra = np.sqrt(np.maximum(self.top - nx, 0))[:, None] * np.sqrt(np.maximum(self.top - np_, 0))
        return np.sqrt(np.maximum(2 * self.top - 2 * (x @ self.pivots.T + extra), 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(float)
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.top - 2 * q @ self.pivots.T, 0))

    def scores(self, norm: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score at distances from ``near`` to ``far``."""
        both = norm + self.top
        return (both - far**2) / 2 - self.slack, (both - near**2) / 2 + self.slack

    def brackets(self, q: np.ndarray, dq: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, far = np.zeros((len(dq), len(dx))), np.full((len(dq), len(dx)), np.inf)
        for j in range(dq.shape[1]):
            np.maximum(near, np.abs(dq[:, j, None] - dx[:, j]), out=near)
            np.minimum(far, dq[:, j, None] + dx[:, j], out=far)
        return self.scores((q.astype(float) ** 2).sum(1)[:, None], near, far)


def products(q: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    if top < DOUBLES:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def firsts(group: np.ndarray, score: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first ``most`` of each group by falling score, then rising ``order``."""
    at = np.lexsort((order, -score, group))
    g = group[at]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    return at[rank < most]


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Columns as integers that are equal where the values are."""
    everything = pa.chunked_array([c for col in columns for c in col.chunks], columns[0].type).combine_chunks().dictionary_encode()
    return np.split(everything.indices.to_numpy(zero_copy_only=False), np.cumsum([len(c) for c in columns])[:-1])


_FOUND = "anchor_id long, anchor_key long, slot int, id long, key long, score long"


def _meet(rows: DataFrame, anchors: DataFrame, keys: list[str], meet) -> DataFrame:
    """Each block of rows with its block of anchors; both come from one table, so columns are named anew."""
    return rows.groupBy(*keys).cogroup(anchors.toDF(*anchors.columns).groupBy(*keys)).applyInArrow(meet, _FOUND)


def _found(anchors: pa.Table, rows: pa.Table, a: np.ndarray, slot: np.ndarray, r: np.ndarray, score: np.ndarray) -> pa.Table:
    a, r = pa.array(a), pa.array(r)
    return pa.table({"anchor_id": anchors["id"].take(a), "anchor_key": anchors["key"].take(a), "slot": pa.array(slot.astype(np.int32)), "id": rows["id"].take(r), "key": rows["key"].take(r), "score": pa.array(score)})


class Meeting:
    """A block of anchors and a block of rows; walks over the pairs whose brackets reach what is asked for."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, pivots: Pivots, width: int):
        self.rows, self.anchors, self.pivots = rows, anchors, pivots
        self.x, self.q = matrix(rows["v"], width), matrix(anchors["v"], width)
        self.dx, self.dq = matrix(rows["d"], len(pivots.pivots)), pivots.of_anchors(self.q)
        self.id, self.anchor_id = rows["id"].to_numpy(), anchors["id"].to_numpy()
        self.order = np.empty(len(self.id), np.int64)
        self.order[np.lexsort((rows["key"].to_numpy(), self.id))] = np.arange(len(self.id))

    def walk(self, allowed, low, high):
        """Yields (anchor index, row index, score) of all allowed pairs with low <= score <= high, chunk by chunk;
        ``low`` is asked again for each chunk, since it rises with what was found."""
        for at in range(0, len(self.x), CHUNK):
            part = slice(at, at + CHUNK)
            least, greatest = self.pivots.brackets(self.q, self.dq, self.dx[part])
            alive = allowed(part) & (greatest >= low()[:, None]) & (least <= high[:, None])
            columns, lines = np.flatnonzero(alive.any(0)), np.flatnonzero(alive.any(1))
            if len(columns):
                s = products(self.q[lines], self.x[part][columns], self.pivots.top)
                keep = alive[np.ix_(lines, columns)] & (s >= low()[lines, None]) & (s <= high[lines, None])
                a, r = np.nonzero(keep)
                yield lines[a], columns[r] + at, s[a, r]


_HIGHEST = np.iinfo(np.int64).max


def windows(positives: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) scores of negatives for each positive, low * p <= 100 * score <= high * p in whole
    numbers; where there is no positive or no such score, the greatest is below the least."""
    scores = [[p["score"] for p in ps] for ps in positives.to_pylist()]
    out = np.full((2, len(scores), max(map(len, scores), default=0)), _HIGHEST)
    out[1] = -_HIGHEST
    for i, row in enumerate(scores):
        for k, p in enumerate(row):
            least, greatest = -(-low * p // 100), high * p // 100
            if least <= greatest:
                out[:, i, k] = least, greatest
    return out[0], out[1]


def _positives(pivots: Pivots, width: int, most: int):
    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        m = Meeting(rows, anchors, pivots, width)
        n = len(m.q)
        a, r, s, low = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(n, -np.inf)
        for more in m.walk(lambda part: m.anchor_id[:, None] != m.id[part], lambda: low, np.full(n, np.inf)):
            a, r, s = (np.concatenate(x) for x in zip((a, r, s), more))
            kept = firsts(a, s, m.order[r], most)
            a, r, s = a[kept], r[kept], s[kept]
            full = np.flatnonzero(np.bincount(a, minlength=n) == most)
            low[full] = s[np.searchsorted(a, full, "right") - 1]  # the last of each anchor is its least
        return _found(anchors, rows, a, np.zeros(len(a)), r, s)

    return meet


def _negatives(pivots: Pivots, width: int, most: int, low: int, high: int):
    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        m = Meeting(rows, anchors, pivots, width)
        lows, highs = windows(anchors["positives"], low, high)
        least, greatest, depth = lows.min(1, initial=_HIGHEST), highs.max(1, initial=-_HIGHEST), lows.shape[1]
        own, other = _codes(anchors["label"], rows["label"])
        found = [(np.zeros(0, np.int64),) * 3 for _ in range(depth)]
        for a, r, s in m.walk(lambda part: own[:, None] != other[part], lambda: least, greatest):
            for k in range(depth):
                inside = (s >= lows[a, k]) & (s <= highs[a, k])
                x, y, z = (np.concatenate(v) for v in zip(found[k], (a[inside], r[inside], s[inside])))
                kept = firsts(x, z, m.order[y], most)
                found[k] = (x[kept], y[kept], z[kept])
        a, r, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        return _found(anchors, rows, a, np.repeat(np.arange(depth), [len(f[0]) for f in found]), r, s)

    return meet


def cell_blocks(counts: dict[int, int], cells: int, size: int) -> tuple[list[int], list[int], int]:
    """(first block, blocks) of each cell and the number of blocks: large cells are split, small ones share a block."""
    first, parts, at, held = [], [], 0, 0
    for c in range(cells):
        n = counts.get(c, 0)
        if held and held + n > size:
            at, held = at + 1, 0
        first.append(at)
        parts.append(max(1, -(-n // size)))
        held += n
        if n > size:
            at, held = at + parts[-1], 0
    return first, parts, at + (held > 0)


def _block(first: list[int], parts: list[int]) -> Column:
    at = F.col("cell") + 1
    return F.element_at(F.array(*map(F.lit, first)), at) + F.pmod(F.xxhash64("id", "key"), F.element_at(F.array(*map(F.lit, parts)), at)).cast("int")


def mine_hard_negatives(rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector_col`` holds arrays of integers, ``anchor`` is a condition on the columns of ``rows``.  An anchor's positives are
    its best ``positives`` rows of its label and another id; for each, the best ``negatives`` rows of other labels
    with low * positive <= 100 * negative <= high * positive are returned; score falls, then id rises.

    Rows with a null id, label, vector or component take no part.  Rows equal in id, label and vector count once; rows
    that share only the id are rows of their own, but no positives of each other.  Shorter vectors count as ended by zeros.
    Anchors without positives, and empty tables, give no rows.  Other columns are not read unless ``anchor`` names
    them.  ValueError if a squared norm reaches 2^62, since scores are 64-bit integers.
    """
    spark = rows.sparkSession
    v = F.col(vector_col).cast("array<bigint>")
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    usable = usable.filter("id is not null and label is not null and v is not null and not exists(v, x -> x is null)").dropDuplicates(["id", "label", "v"])
    usable = shared_checkpoint(usable.withColumn("key", F.xxhash64("label", "v")))
    stats = usable.agg(F.max(F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * x)")).alias("top"), F.max(F.size("v")).alias("width")).first()
    top, width = stats["top"] or 0.0, stats["width"] or 0
    if top >= LARGEST:
        raise ValueError("a vector's squared norm does not fit in 64-bit scores")
    sample = usable.select(F.xxhash64("id").alias("h"), "id", "key", "v").orderBy("h", "id", "key").limit(SAMPLE_ROWS).collect()
    pivots = Pivots(np.array([r["v"] + [0] * (width - len(r["v"])) for r in sample], np.int64).reshape(len(sample), width), top)
    cells = max(1, len(pivots.pivots))

    def measure(batches):
        for b in batches:
            d = pivots.of_rows(matrix(b.column("v"), width))
            cell = d.argmin(1).astype(np.int32) if d.shape[1] else np.zeros(len(d), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(cell)], [*b.schema.names, "d", "cell"])

    table = shared_checkpoint(usable.mapInArrow(measure, "id long, label string, v array<bigint>, anchor boolean, key long, d array<double>, cell int"))
    asked = table.filter("anchor")

    # positives: blocks within a label
    sizes = few(table.groupBy("label").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("parts"), F.ceil(F.count_if("anchor") / ANCHOR_BLOCK).cast("int").alias("sets")).filter("sets > 0"), BROADCAST_LABELS)
    spread = F.xxhash64("id", "key")
    theirs = table.join(sizes, "label").withColumn("part", F.pmod(spread, "parts").cast("int")).withColumn("set", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).select("label", "part", "set", "id", "key", "v", "d")
    ours = asked.join(sizes, "label").withColumn("set", F.pmod(spread, "sets").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("label", "part", "set", "id", "key", "v")
    found = _meet(theirs, ours, ["label", "part", "set"], _positives(pivots, width, positives))
    place = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key").orderBy(F.col("score").desc(), "id", "key"))
    best = found.withColumn("slot", place).filter(F.col("slot") <= positives)
    best = best.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("slot", "id", "score"))).alias("positives"))
    armed = shared_checkpoint(asked.join(best, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key"))).select("id", "key", "label", "v", "cell", "positives"))

    # negatives: blocks of rows near the same pivot, at most `cells` counts come here
    def numbered(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
        counts = {r["cell"]: r["n"] for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        first, parts, n = cell_blocks(counts, cells, size)
        return df.withColumn(name, _block(first, parts)), n

    by_block, _ = numbered(table, "block", ROW_BLOCK)
    sets, n_sets = numbered(armed, "set", ANCHOR_BLOCK)
    k = len(pivots.pivots)

    def reach(b):
        """Each anchor's distances to the pivots, squared norm and the least score asked for."""
        for t in b:
            q = matrix(t.column("v"), width)
            d = pivots.of_anchors(q)
            least = windows(t.column("positives"), low, high)[0].min(1, initial=_HIGHEST)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([t.column("set"), lists, pa.array((q.astype(float) ** 2).sum(1)), pa.array(least)], ["set", "d", "norm", "least"])

    def ranges(df: DataFrame, by: str, more: list[Column]) -> DataFrame:
        return df.groupBy(by).agg(*[f(F.col("d")[j]).alias(f"{by}_{w}{j}") for j in range(k) for w, f in (("lo", F.min), ("hi", F.max))], *more)

    of_sets = ranges(sets.mapInArrow(reach, "set int, d array<double>, norm double, least long"), "set", [F.max("norm").alias("norm"), F.min("least").alias("least")])
    of_blocks = ranges(by_block, "block", [F.count("*").alias("rows")]).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(max(n_sets, 1) - 1))))
    apart = [F.greatest(F.col(f"set_lo{j}") - F.col(f"block_hi{j}"), F.col(f"block_lo{j}") - F.col(f"set_hi{j}"), F.lit(0.0)) for j in range(k)]
    near = F.greatest(*apart, F.lit(0.0), F.lit(0.0))
    reachable = (F.col("norm") + F.lit(pivots.top) - near * near) / 2 + F.lit(pivots.slack) >= F.col("least")
    pairs = shared_checkpoint(of_blocks.join(of_sets, "set").filter(reachable).select("block", "set"))
    theirs = by_block.select("block", "id", "key", "label", "v", "d").join(pairs, "block")
    ours = sets.select("set", "id", "key", "label", "v", "positives").join(pairs, "set")
    found = _meet(theirs, ours, ["block", "set"], _negatives(pivots, width, negatives, low, high))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key", "slot").orderBy(F.col("score").desc(), "id", "key"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    named = armed.select(F.col("id").alias("anchor_id"), F.col("key").alias("anchor_key"), F.posexplode("positives").alias("slot", "p"))
    out = ranked.join(named, ["anchor_id", "anchor_key", "slot"])
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    finite = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ready = rows.filter(finite).select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return mine_hard_negatives(ready, F.col("vec_id") % 100 == 0)


_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": _SQL}
