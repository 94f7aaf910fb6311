"""Word shingles as 64-bit hashes, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE[65:91] = _BYTE[97:123]
_UP, _DOWN = _powers(_BASE, 4096), _powers(_INVERSE, 4096)


def _grow(n: int) -> None:
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)


def _chunks(raw: bytes) -> list[bytes]:
    """Pieces of about a megabyte, cut at spaces or line feeds."""
    out, at = [], 0
    while len(raw) - at > _CHUNK:
        cuts = [c for c in (raw.find(b" ", at + _CHUNK), raw.find(b"\n", at + _CHUNK)) if c >= 0]
        if not cuts:
            break
        out.append(raw[at : min(cuts)])
        at = min(cuts)
    return [*out, raw[at:]]


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, in order."""
    out = []
    for raw in _chunks((text or "").encode("utf-8", "surrogatepass")):
        b = np.frombuffer(raw, np.uint8)
        word = np.zeros(len(b) + 2, np.int8)
        word[1:-1] = ~_SPACE[b]
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[0::2], edge[1::2]
        _grow(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * _UP[: len(b)], out=sums[1:])
        out.append(mix64((sums[end] - sums[start]) * _DOWN[start] + (end - start).astype(np.uint64)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence if there are fewer words."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + h[i : i + n]
    return distinct(mix64(out))
