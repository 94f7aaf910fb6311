"""Chat formatting with loss masks aligned by offsets.

The template writes each turn as ``[INST]role[/INST]text</s>``.  Control strings inside roles and texts get a
backslash after their first character, and one more if they have some; reading takes one away, so nothing is lost.
The markers are tokens of their own for the tokenizer, so no token reaches over the end of a text.

Turns are range-partitioned by conversation and turn and sorted, so one conversation of very many turns lies over many
partitions.  Each task renders the conversations that pass by, whole ones unless they exceed a segment, encodes them once
with offsets, and finds the tokens of each assistant text by binary search of its span in the token spans.  Segments end
between turns.  What is read back comes from the written rows: turns from the formatted text, texts under the mask from
the masked ids.  Conversations of one segment are digested where they lie; only those that may go on in another
partition, two for each partition, and the long ones go on to one stream each, which holds one segment at a time.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, scratch_folder
from .tokens import byte_letters, default_tokenizer, slices

OPEN, MIDDLE, END = "[INST]", "[/INST]", "</s>"
#: Strings that no text may hold as they are: the template's markers and the tokenizer's own.
CONTROL = (OPEN, MIDDLE, END, "<|endoftext|>")
LEARNED_ROLE = "assistant"
#: A segment ends with the turn that brings it to so many characters.
SEGMENT_CHARS = 1 << 20
FORMATTED = "conv_id long, segment int, pid int, whole boolean, formatted string, input_ids array<int>, loss_mask array<boolean>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(rf"{re.escape(OPEN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    """One backslash more behind the first character of each control string; no control string begins inside another."""
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text and the spans (start, end) of the texts to be learned, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        at += len(head)
        if role == LEARNED_ROLE:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask_tokens(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in the spans.  Tokens are sorted by start and by end; of a character cut into several
    tokens each has the whole character's span."""
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(starts, spans[:, 1], "left")
    full = spans[:, 1] > spans[:, 0]
    change = np.bincount(first[full], minlength=len(starts) + 1) - np.bincount(last[full], minlength=len(starts) + 1)
    return np.cumsum(change)[: len(starts)] > 0


class ChatEncoder:
    """The tokenizer with the template's markers as added tokens, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])
        letter = {chr(v): k for k, v in byte_letters().items()} | {chr(b): b for b in range(256) if b not in byte_letters()}
        vocabulary = self.tok.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.bytes[i] = word.encode() if word in CONTROL else bytes(letter[c] for c in word)
        self.tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends); very long texts go in slices that are cut at safe places."""
        ids, offsets, at = [], [], 0
        for part in slices(text):
            e = self.tok.encode(part, add_special_tokens=False)
            ids.append(np.array(e.ids, np.int32))
            offsets.append(np.array(e.offsets, np.int64).reshape(-1, 2) + at)
            at += len(part)
        spans = np.concatenate(offsets)
        return np.concatenate(ids), spans[:, 0], spans[:, 1]

    def learned(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The text of each run of masked tokens."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
        return [unescape(b"".join(map(self.bytes.__getitem__, ids[a:b].tolist())).decode()) for a, b in edges.reshape(-1, 2)]


_ENCODERS: dict[str, ChatEncoder] = {}


def chat_encoder(path: str) -> ChatEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChatEncoder(path)
    return _ENCODERS[path]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]], bool, bool]]:
    """(conversation, turns, does it begin the conversation here, does it end it here) from sorted rows."""
    conv, turns, size, begun = None, [], 0, True
    for b in batches:
        for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if turns and (c != conv or size >= SEGMENT_CHARS):
                yield conv, turns, begun, c != conv
                turns, size, begun = [], 0, c != conv
            conv = c
            turns.append((role, text))
            size += len(role) + len(text)
    if turns:
        yield conv, turns, begun, True


def format_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """conv_id, segment, pid, whole, formatted, input_ids, loss_mask: one row for each conversation, or several, in the
    order of (pid, segment), for one that is long or lies over partitions.

    Turns go by their number (nulls first), equal ones by role and text; every row is a turn, repeated ones too.  Null
    roles and texts are empty; null conversation ids are one conversation; an empty table gives no rows; other columns
    are not read.
    """
    path = tokenizer_path or default_tokenizer()
    order = ["conv_id", "turn", "role", "text"]
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    turns = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *plain)
    dealt = turns.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, pid = chat_encoder(path), TaskContext.get().partitionId()
        held, number, first = None, 0, None

        def row(segment, last: bool) -> pa.RecordBatch:
            conv, turns, begins, ends = segment
            formatted, spans = render(turns)
            ids, starts, stops = enc.encode(formatted)
            whole = begins and ends and not last and conv != first
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (ids, mask_tokens(spans, starts, stops))]
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([number], pa.int32()), pa.array([pid], pa.int32()), pa.array([whole]), pa.array([formatted]), *lists], ["conv_id", "segment", "pid", "whole", "formatted", "input_ids", "loss_mask"])

        for segment in _segments(batches):
            if held is None:
                first = segment[0]
            else:
                yield row(held, False)
                number += 1
            held = segment
        if held is not None:
            yield row(held, True)

    return dealt.mapInArrow(run, FORMATTED)


class Reading:
    """What is read back of one conversation, segment by segment."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.chars, self.size = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, enc: ChatEncoder, formatted: str, ids: np.ndarray, mask: np.ndarray) -> None:
        for role, text in turns_of(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for text in enc.learned(ids, mask):
            self.chars += len(text)
            self.loss.update(text.encode())
        self.size += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size


def read_back(formatted: DataFrame, *, tokenizer_path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rows of ``format_conversations``."""
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, now = chat_encoder(path), None
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            done = []
            ids, mask = b.column("input_ids"), b.column("loss_mask")
            for i, conv in enumerate(b.column("conv_id").to_pylist()):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = Reading(conv)
                now.take(enc, b.column("formatted")[i].as_py(), ids[i].values.to_numpy(), mask[i].values.to_numpy(zero_copy_only=False))
            if done:
                yield out(done)
        if now is not None:
            yield out([now.row()])

    here = formatted.filter("whole").select("conv_id", "formatted", "input_ids", "loss_mask").mapInArrow(run, DIGEST)
    order = ["conv_id", "pid", "segment"]
    rest = formatted.filter("not whole").repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "input_ids", "loss_mask")
    return here.unionByName(rest.mapInArrow(run, DIGEST))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatted conversations are written as Parquet in the shared folder and read again."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    home = scratch_folder(spark, "chat")
    format_conversations(rows).write.parquet(home)
    return read_back(spark.read.schema(FORMATTED).parquet(home))


def _escaped(x: str) -> str:
    for c in CONTROL:
        first, rest = re.escape(c[0]), re.escape(c[1:])
        x = f"regexp_replace({x}, '({first})(\\\\*{rest})', '\\1\\\\\\2', 'g')"
    return x


_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
  sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(OPEN + MIDDLE + END)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

QUERIES = {"op13_chat_formatting": op13_chat_formatting}
ORACLES = {"op13_chat_formatting": _SQL}
