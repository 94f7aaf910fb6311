"""Token counts: batch encoding inside Arrow functions that give back lengths only.

Arrow batches are regrouped into batches of bounded bytes.  Texts longer than a slice are split at
*safe* places: a single U+0020 with no white space on either side.  The byte-level pre-tokenizer
always ends a word before such a space and starts the next one with it, so the ids of the slices,
concatenated, are the ids of the whole.

It also ends a word before the last space of a run of white space, if no white space follows.  So for
counts the texts of a batch are cut before each such space, and equal slices are encoded once.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import load

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_CUTS = re.compile(r"(?= \S)")
#: Latin texts without "<", of which no special string can be part.
_LATIN = re.compile(r"[\x00-;=-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")
#: The words into which the tokenizer's pattern splits a Latin text, with its classes written out for those characters.
_WORDS = re.compile(r" ?[A-Za-z\u00c0-\u017f]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r A-Za-z\u00c0-\u017f0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Words whose ids a worker remembers, and how long such words may be.
KNOWN_WORDS, KNOWN_CHARS = 1 << 19, 64
BATCH_BYTES = 4 << 20
SLICE_CHARS = 1 << 16
#: A batch of which more slices than this share differ is not cut for counts: many short slices cost more than whole texts.
MOST_NEW = 0.5


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(text: str, most: int = SLICE_CHARS) -> list[str]:
    """Cut a long text at safe places, every ``most`` characters or at the first such place after."""
    out, at = [], 0
    while len(text) - at > most and (m := _SAFE.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def balanced(texts: list[str], sizes: np.ndarray | None = None) -> Iterator[list[list[str]]]:
    """The texts as lists of slices, in batches of about BATCH_BYTES; ``sizes`` are their bytes, if they are known."""
    batch: list[list[str]] = []
    size = 0
    for x, n in zip(texts, sizes.tolist() if sizes is not None else (len(x) if x.isascii() else len(x.encode()) for x in texts)):
        batch.append(slices(x))
        size += n
        if size >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def byte_letters() -> dict[int, int]:
    """Byte-level tokenizers write a byte that is no visible Latin-1 character as one from U+0100 on, in order."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_LETTERS = byte_letters()
_SPACE_LETTER = chr(_LETTERS[32])


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, all of them from the tokenizer.

    A byte-level tokenizer without normaliser encodes each word of its split by itself.  So Latin texts are
    split here, words that the worker has met before are looked up, and only new ones go to the tokenizer's
    model.  All other texts (other scripts, special strings), and all texts of another kind of tokenizer,
    go there whole.  ``lengths`` takes no such way: it has all texts of a batch encoded by the tokenizer's batch
    call, with any pattern and model of its own, and remembers nothing for the next batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        spec = json.loads(self.tok.to_str())
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = all("<" in t["content"] for t in spec.get("added_tokens") or [])
        unspaced = not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or [])
        self.by_slice = bool(plain and unspaced and spec.get("normalizer") is None)
        self.by_word = bool(plain and added and spec.get("normalizer") is None and spec.get("model", {}).get("type", "BPE") == "BPE")
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        letters = word.replace(" ", _SPACE_LETTER) if plain else word.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        words = [_WORDS.findall(x) if self.by_word and _LATIN.fullmatch(x) else None for x in texts]
        whole = iter(self.tok.encode_batch_fast([x for x, ws in zip(texts, words) if ws is None], add_special_tokens=False))
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        new = set().union(*[ws for ws in words if ws is not None]).difference(known)
        for w in new:
            known[w] = self._word(w)
        out = [array("I", next(whole).ids).tobytes() if ws is None else b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > KNOWN_CHARS:
                del known[w]
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """One bytes object for each text, in order, encoded in batches of bounded bytes."""
        for batch in balanced(texts):
            found = iter(self.batch([y for ys in batch for y in ys]))
            for ys in batch:
                yield next(found) if len(ys) == 1 else b"".join(next(found) for _ in ys)

    def lengths(self, texts: list[str], sizes: np.ndarray) -> Iterator[int]:
        """The number of ids of each text, in order, by the tokenizer's own batch encoding, equal slices of a batch once."""
        for batch in balanced(texts, sizes):
            if self.by_slice:
                cut = [[z for y in ys for z in _CUTS.split(y)] for ys in batch]
                if len(set().union(*cut)) <= MOST_NEW * sum(map(len, cut)):
                    batch = cut
            once = list(set().union(*batch))
            found = dict(zip(once, map(len, self.tok.encode_batch_fast(once, add_special_tokens=False))))
            for ys in batch:
                yield sum(map(found.__getitem__, ys))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; kept while the worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, tokenizer_path: str | None = None) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Null texts count as empty (0 bytes, 0 tokens).  Repeated rows give repeated results, an empty
    table gives none, and other columns, whatever their names, are not read.
    """
    path = tokenizer_path or default_tokenizer()
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [x or "" for x in b.column("t").to_pylist()]
            n_bytes = pc.fill_null(pc.binary_length(b.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            n_tokens = np.fromiter(enc.lengths(texts, n_bytes), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
