"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from a text alone.  Trees are fitted on a bounded sample of labelled rows with numpy
and flattened into arrays (feature, threshold, leaf), which workers traverse for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load
from .shingles import distinct, mix64, word_hashes

#: At most so many labelled rows are fitted on (chosen by a hash of their id).
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LAMBDA = 80, 4, 32, 0.15, 1.0
THRESHOLD = 0.3
_GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "mark": b"*%$&#@^~", "angle": b"<>[]{}()/\\=_+", "quote": b"'\"`-", "wide": range(128, 256)}
_SELECT = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS.values()):
    _SELECT[list(_g), _i] = 1
N_FEATURES = len(_GROUPS) + 13


def statistics(text: str | None) -> np.ndarray:
    """The text's statistics; an empty or null text has zeros."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    counts = np.bincount(b, minlength=256)
    n, g = len(b), len(_GROUPS)
    groups = counts @ _SELECT
    out[:g] = groups / n
    p = counts[counts > 0] / n
    h = word_hashes(text)
    w = max(len(h), 1)
    d = np.sort(h)
    runs = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))), [len(d)]))) if len(d) else np.zeros(1)
    lines = raw.split(b"\n")
    three = distinct(mix64(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:])) if len(h) > 2 else h
    out[g:] = (
        np.log1p(n), np.log1p(len(h)), (n - groups[3] - groups[4]) / w, -(p * np.log2(p)).sum(), len(runs) / w, runs.max() / w,
        (h[1:] == h[:-1]).sum() / w, len(three) / max(len(h) - 2, 1), len(set(lines)) / len(lines), np.log1p(n / len(lines)), w / (groups[5] + 1), groups[0] / (groups[0] + groups[1] + 1), np.log1p(max(map(len, lines))),
    )
    return out


def fit(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Boosted trees for the logistic loss as flat arrays; without both classes, the base rate alone."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = {"base": np.array(np.log(rate / (1 - rate))), "feature": np.zeros((0, inner), np.int64), "threshold": np.zeros((0, inner)), "leaf": np.zeros((0, leaves))}
    if len(y) < 20 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), float(model["base"]))
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            width = 1 << level
            g = np.stack([np.bincount(node * BINS + binned[:, f], grad, width * BINS).reshape(width, BINS) for f in range(x.shape[1])])
            h = np.stack([np.bincount(node * BINS + binned[:, f], hess, width * BINS).reshape(width, BINS) for f in range(x.shape[1])])
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + LAMBDA) + (gt - gl) ** 2 / (ht - hl + LAMBDA) - gt**2 / (ht + LAMBDA)
            gain[(hl < 1) | (ht - hl < 1)] = -1
            flat = gain.transpose(1, 0, 2).reshape(width, -1)
            best = flat.argmax(1)
            for k in range(width):
                f, cut = divmod(int(best[k]), BINS)
                at = width - 1 + k
                if flat[k, best[k]] > 1e-6 and cut < len(edges[f]):
                    feature[at], threshold[at] = f, edges[f][cut]
            at = width - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = -RATE * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + LAMBDA)
        score += leaf[node]
        trees.append((feature, threshold, leaf))
    for name, arrays in zip(("feature", "threshold", "leaf"), zip(*trees)):
        model[name] = np.stack(arrays)
    return model


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1: all rows walk down each tree together."""
    score, rows = np.full(len(x), float(model["base"])), np.arange(len(x))
    for feature, threshold, leaf in zip(model["feature"], model["threshold"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            at = (1 << level) - 1 + node
            node = 2 * node + (x[rows, feature[at]] > threshold[at])
        score += leaf[node]
    return 1 / (1 + np.exp(-score))


def id_remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Fit on labelled documents of which the id's remainder of 5 is not 0: ``rows`` at most, by hash of the id.

    Null ids and labels take no part.  An id counts once: with the mean of its labels, and one of its texts.
    """
    known = labels.filter(F.col(label_col).isNotNull() & (id_remainder(F.col(id_col), 5) != 0)).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"), F.xxhash64(id_col).alias("h"))
    known = known.groupBy("id", "h").agg(F.avg("y").alias("y"))  # an id that is labelled twice counts once
    n = known.count()
    if n > 1.2 * rows:  # else the sort below would see far more than it keeps
        known = known.filter(F.pmod("h", F.lit(1_000_000)) < int(1_200_000 * rows / n) + 1)
    sample = known.orderBy("h", "id").limit(rows)
    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t"))
    joined = chosen.join(F.broadcast(sample), F.col("doc") == F.col("id")).select("doc", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("y"), pa.array([statistics(t).tolist() for t in b.column("t").to_pylist()], pa.list_(pa.float64()))], ["doc", "y", "x"])

    kind = chosen.schema["doc"].dataType.simpleString()
    # of documents that share an id the one with the least statistics counts, so `rows` rows come here at most
    found = joined.mapInArrow(run, f"doc {kind}, y double, x array<double>").groupBy("doc").agg(F.min(F.struct("x", "y")).alias("m")).select("doc", "m.*")
    got = sorted((r["doc"], r["y"], tuple(r["x"])) for r in found.toLocalIterator())
    x = np.array([r[2] for r in got]).reshape(-1, N_FEATURES)
    return fit(x, (np.array([r[1] for r in got]) > 0.5).astype(float))


def score(docs: DataFrame, model: dict[str, np.ndarray], *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (an input column of that name is replaced).  Null texts are scored as empty; rows
    and the other columns stay as they are; an empty table gives no rows."""
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            x = np.stack([statistics(t) for t in texts]) if texts else np.zeros((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(predict(model, x))], [*b.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
