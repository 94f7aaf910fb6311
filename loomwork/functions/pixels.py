"""Images as arrays of grey or colour values: resampling, difference hashes, flat graphics.  Arrow batches of numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Width of the Lanczos window, and the bits of its fixed-point weights.
LOBES, BITS = 3, 22
HASH_WIDTH, HASH_HEIGHT = 9, 8
#: Shares of all points that make an image a flat graphic: of its most frequent colour, and of the two most frequent.
FLAT_ONE, FLAT_TWO = 0.60, 0.72


def lanczos_weights(size: int, out: int) -> np.ndarray:
    """(out, size) fixed-point weights; the window widens with the scale when an image shrinks, and each row sums to one."""
    scale = size / out
    wide = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    first = np.maximum((centre - LOBES * wide + 0.5).astype(int), 0)
    last = np.minimum((centre + LOBES * wide + 0.5).astype(int), size)
    place = np.arange(size)
    x = (place - centre[:, None] + 0.5) / wide
    w = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    w[(place < first[:, None]) | (place >= last[:, None])] = 0.0
    w /= w.sum(1, keepdims=True)
    return np.where(w < 0, w * (1 << BITS) - 0.5, w * (1 << BITS) + 0.5).astype(np.int64)


def resampled(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """(n, h, w) grey values 0 to 255 to (n, height, width): rows first, then columns, rounded to whole values after each."""

    def along(x: np.ndarray, out: int) -> np.ndarray:
        if x.shape[-1] == out:
            return x
        return np.clip((x @ lanczos_weights(x.shape[-1], out).T + (1 << (BITS - 1))) >> BITS, 0, 255)

    rows = along(images.astype(np.int64), width)
    return along(rows.transpose(0, 2, 1), height).transpose(0, 2, 1)


def dhashes(images: np.ndarray) -> list[str]:
    """16 hexadecimal digits for each image: whether each point of 9 by 8 is lighter than the one to its right."""
    small = resampled(images, HASH_HEIGHT, HASH_WIDTH)
    bits = (small[:, :, :-1] > small[:, :, 1:]).reshape(len(images), 64)
    return [x.tobytes().hex() for x in np.packbits(bits, axis=1)]


def top_shares(colours: np.ndarray) -> tuple[float, float]:
    """The share of the most frequent value, and of the two most frequent."""
    counts = np.sort(np.unique(colours, return_counts=True)[1])[::-1]
    return counts[0] / len(colours), counts[:2].sum() / len(colours)


def image_features(images: DataFrame, *, key: str, grey: str, colour: str, width: int) -> DataFrame:
    """(key, dhash, top1, top2, flat) of images as flat arrays, row by row: ``grey`` of 0 to 255, ``colour`` of numbers.

    Images of one batch that are equally large are resampled together.  A null, empty or not rectangular array, or one
    with nulls, gives nulls.
    """
    chosen = images.select(key, grey, colour)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 256):
                b = whole.slice(at, 256)
                n = b.num_rows
                hashes, ones, twos = [None] * n, [None] * n, [None] * n
                by_size: dict[int, list[int]] = {}
                for i, x in enumerate(b.column(1)):
                    if x.is_valid and len(x) and len(x) % width == 0 and not x.values.null_count:
                        by_size.setdefault(len(x), []).append(i)
                for size, rows in by_size.items():
                    stacked = np.stack([b.column(1)[i].values.to_numpy() for i in rows]).reshape(len(rows), size // width, width)
                    for i, h in zip(rows, dhashes(stacked)):
                        hashes[i] = h
                for i, x in enumerate(b.column(2)):
                    if x.is_valid and len(x) and not x.values.null_count:
                        ones[i], twos[i] = map(float, top_shares(x.values.to_numpy()))
                flat = [None if a is None else a > FLAT_ONE or c > FLAT_TWO for a, c in zip(ones, twos)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.string()), pa.array(ones, pa.float64()), pa.array(twos, pa.float64()), pa.array(flat, pa.bool_())], [key, "dhash", "top1", "top2", "flat"])

    fields = [chosen.schema[key], T.StructField("dhash", T.StringType()), T.StructField("top1", T.DoubleType()), T.StructField("top2", T.DoubleType()), T.StructField("flat", T.BooleanType())]
    return chosen.mapInArrow(run, T.StructType(fields))
