"""Resampling and hashes of images against loops over points, and entries replaced on their path."""

import math
import random

import numpy as np

from loomwork.functions import pixels
from loomwork.operators import ledger


def slow_line(line, out):
    """A line of values resampled by the definition: a windowed sinc around each centre, in fixed point."""
    scale = len(line) / out
    wide = max(scale, 1.0)

    def sinc(x):
        return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)

    result = []
    for k in range(out):
        centre = (k + 0.5) * scale
        lo, hi = max(int(centre - 3 * wide + 0.5), 0), min(int(centre + 3 * wide + 0.5), len(line))
        w = [sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0 for x in ((i - centre + 0.5) / wide for i in range(lo, hi))]
        fixed = [int(v / sum(w) * 2**22 + (0.5 if v >= 0 else -0.5)) for v in w]
        result.append(min(255, max(0, (sum(f * line[lo + i] for i, f in enumerate(fixed)) + 2**21) >> 22)))
    return result


def slow_hash(image):
    rows = [slow_line(r, 9) for r in image]
    columns = [slow_line([r[x] for r in rows], 8) for x in range(9)]
    bits = [columns[x][y] > columns[x + 1][y] for y in range(8) for x in range(8)]
    return f"{int(''.join('01'[b] for b in bits), 2):016x}"


def test_hashes_equal_a_slow_resampling():
    rng = random.Random(1)
    for h, w in ((40, 60), (8, 9), (100, 7), (5, 33), (64, 64), (1, 1)):
        images = [[[rng.randrange(256) for _ in range(w)] for _ in range(h)] for _ in range(6)] + [[[200] * w] * h]
        got = pixels.dhashes(np.array(images))
        want = [slow_hash(x) for x in images]
        # weights are sums of floats: a value next to a half may round to its neighbour
        assert all(bin(int(a, 16) ^ int(b, 16)).count("1") <= 1 for a, b in zip(got, want)) and sum(a == b for a, b in zip(got, want)) >= 6


def test_features_of_awkward_images(spark):
    rows = [(1, [5] * 18, [1, 1, 1, 2, 3]), (2, None, None), (3, [], []), (4, [1, 2, 3], [7]), (5, [None] * 18, [1, None])]
    df = spark.createDataFrame(rows, "id int, g array<int>, c array<int>")
    got = {r["id"]: tuple(r)[1:] for r in pixels.image_features(df, key="id", grey="g", colour="c", width=9).collect()}
    assert got == {1: ("0" * 16, 0.6, 0.8, True), 2: (None,) * 4, 3: (None,) * 4, 4: (None, 1.0, 1.0, True), 5: (None,) * 4}


def test_replacing_takes_tags_and_usage_along(spark):
    media = spark.createDataFrame([(1, "a", "h1", 3), (2, "b", "h2", 1)], "id long, path string, hash string, use_count long")
    tags, usage = spark.createDataFrame([(1, "x"), (2, "y")], "id long, tag string"), spark.createDataFrame([(1,), (1,), (2,)], "id long")
    new = spark.createDataFrame([(1, "a", "n1"), (2, "a", "n2"), (3, "c", "n3")], "ord int, path string, hash string")
    m, t, u = ledger.replace_on_path(media, tags, usage, new)
    assert sorted((r["path"], r["hash"], r["use_count"]) for r in m.collect()) == [("a", "n2", 0), ("b", "h2", 1), ("c", "n3", 0)]
    assert [tuple(r) for r in t.collect()] == [("2", "y")] and [tuple(r) for r in u.collect()] == [("2",)]
