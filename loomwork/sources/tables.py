"""Sources and sinks: tables by name, file listings as a catalogue, lenient text decoding, JSON lines, feeds."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType())}


def schema(fields: str) -> T.StructType:
    """A schema from "name type, ..." without a session."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (x.split() for x in fields.split(","))])


MEDIA = schema(
    "id long, singer_id long, media_type string, subtype string, file_path string, file_hash string, dhash string, source string, source_url string, provider_media_id string, "
    "author string, license string, tags array<string>, description string, created_at timestamp_ntz, last_used_at timestamp_ntz, use_count long, favorite int, active int, approved int, "
    "youtube_video_id string, youtube_url string, channel_name string, video_title string, original_start double, original_end double, clip_duration double, fps double, width int, height int, rights_status string"
)
SINGERS = schema("id long, name string, aliases array<string>, created_at timestamp_ntz")
CACHE = schema("id long, provider string, query string, media_type string, response_json string, created_at timestamp_ntz, expires_at timestamp_ntz")
PROJECTS = schema("id long, project_id string, singer_name string, created_at timestamp_ntz")
USAGE = schema("id long, project_id string, media_id long, scene_index int, role string, created_at timestamp_ntz")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt to all cores if it comes in fewer partitions than there are; for costly work on each row.

    Only for a table straight from ``load``: large tables have more partitions than cores and stay as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def evolve(df: DataFrame, to: T.StructType) -> DataFrame:
    """Additive schema evolution: columns of ``to`` that ``df`` lacks are null, those it has are cast."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in to.fields])


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file_path, file_hash, file_name, tags (name split at - and _), size, modified: a directory as a catalogue."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    tags = F.array_distinct(F.filter(F.transform(F.split(stem, "[-_]"), lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    return files.filter(~name.startswith("temp_")).select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"), name.alias("file_name"), tags.alias("tags"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def media_role(path: Column) -> Column:
    """What a file of the catalogue is by its place and kind: a clip, a general clip, or a photo."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    video = p.rlike(r"\.(mp4|avi|mov|mkv|webm)$")
    return F.when(F.contains(p, F.lit("clips")), "stage_clip").when(F.contains(p, F.lit("stock")), "general_broll").when(video, "stage_clip").otherwise("singer_photo")


def new_files(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files whose path and content the catalogue does not have."""
    return listed.join(known.select("file_path"), "file_path", "left_anti").join(known.filter("file_hash is not null").select("file_hash"), "file_hash", "left_anti")


def content_hash(content: Column, path: Column) -> Column:
    """SHA-256 of the content; of the lower-case path with forward slashes where there is none."""
    return F.coalesce(F.sha2(content, 256), F.sha2(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), 256))


def json_lines(lines: DataFrame, column: str, fields: str) -> DataFrame:
    """Line-delimited JSON; blank and broken lines are skipped."""
    parsed = F.from_json(F.trim(column), fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.filter(F.trim(column).startswith("{")).select(parsed.alias("j")).select("j.*").dropna("all")


def feed_items(spark: SparkSession, path: str, k: int = 5) -> DataFrame:
    """The first ``k`` items of an RSS file, in the file's order, with their ``place`` from 0; none if it has none."""
    channels = spark.read.format("xml").option("rowTag", "channel").load(path)
    if "item" not in channels.columns:
        return channels.limit(0).select(F.lit(0).alias("place"))
    # if no feed has more than one, the reader sees no list
    listed = F.col("item") if isinstance(channels.schema["item"].dataType, T.ArrayType) else F.array_compact(F.array("item"))
    return channels.select(F.posexplode(listed).alias("place", "i")).filter(F.col("place") < k).select("place", "i.*")


#: Charsets whose texts can be decoded side by side: line feeds and zeros are bytes of their own in them.
_SIDE_BY_SIDE = ("utf-8", "euc-kr", "cp949")
_GAP = b"\n\0\n"


def valid_utf8(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the texts flat[start:end] are UTF-8, by masks over all bytes at once.  Three bytes of ASCII stand
    between any two and after the last, so none reaches into the next."""

    def after(mask: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(mask), bool)
        out[k:] = mask[:-k]
        return out

    two, three, four = (flat >= 0xC2) & (flat <= 0xDF), (flat >= 0xE0) & (flat <= 0xEF), (flat >= 0xF0) & (flat <= 0xF4)
    follows = (flat & 0xC0) == 0x80
    wanted = after(two | three | four, 1) | after(three | four, 2) | after(four, 3)
    wrong = (follows != wanted) | (flat == 0xC0) | (flat == 0xC1) | (flat >= 0xF5)
    for lead, low, high in ((0xE0, 0xA0, 0xBF), (0xED, 0x80, 0x9F), (0xF0, 0x90, 0xBF), (0xF4, 0x80, 0x8F)):
        wrong |= after(flat == lead, 1) & ((flat < low) | (flat > high))
    upto = np.concatenate([[0], np.cumsum(wrong)])
    return upto[ends + 1] == upto[starts]


def decoded(raws: list[bytes], charset: str) -> list[str | None]:
    """The texts of a batch, None where the bytes are not of the charset.

    All of them are decoded at once; where that fails, those that are not UTF-8 are told by masks, and of other charsets halves
    are tried, down to the text at fault.
    """
    if not raws:
        return []
    if charset.lower() in _SIDE_BY_SIDE and len(raws) > 1 and not any(_GAP in r for r in raws):
        try:
            return list(_GAP.join(raws).decode(charset).split(_GAP.decode()))
        except UnicodeDecodeError:
            pass
        if charset.lower() == "utf-8":
            sizes = np.array([len(r) for r in raws])
            starts = np.cumsum(sizes + 3) - sizes - 3
            good = valid_utf8(np.frombuffer(b"\n\n\n".join([*raws, b""]), np.uint8), starts, starts + sizes)
            texts = iter(decoded([r for r, ok in zip(raws, good) if ok], charset))
            return [next(texts) if ok else None for ok in good]
        half = len(raws) // 2
        return decoded(raws[:half], charset) + decoded(raws[half:], charset)
    out: list[str | None] = []
    for r in raws:
        try:
            out.append(r.decode(charset))
        except (UnicodeDecodeError, LookupError):
            out.append(None)
    return out


def decode_batch(raws: list[bytes | None], charsets: tuple[str, ...], need: str) -> list[str | None]:
    """The first decode of each text that has ``need``: by the charset that it declares, then by ``charsets``; else UTF-8 with
    replacements.  Each charset is tried once for all texts that it may be of."""
    out: list[str | None] = [None] * len(raws)
    waiting = [i for i, r in enumerate(raws) if r is not None]
    declared: dict[str, list[int]] = {}
    for i in waiting:
        if said := re.search(rb"charset=[\"']?([\w-]+)", raws[i][:2048], re.I):
            declared.setdefault(said[1].decode(), []).append(i)
    for charset, rows in [*declared.items(), *[(c, None) for c in charsets]]:
        rows = [i for i in (waiting if rows is None else rows) if out[i] is None]
        for i, text in zip(rows, decoded([raws[i] for i in rows], charset)):
            if text is not None and re.search(need, text):
                out[i] = text
        waiting = [i for i in waiting if out[i] is None]
    for i in waiting:
        out[i] = raws[i].decode("utf-8", "replace")
    return out


def decode_text(df: DataFrame, column: str, out: str = "text", charsets: tuple[str, ...] = ("utf-8", "euc-kr", "cp949"), need: str = r"[가-힣]") -> DataFrame:
    """Bytes to text: a declared ``charset=`` first, then ``charsets``; the first decode that has ``need``
    wins, else UTF-8 with replacements.  Null stays null."""
    at = df.columns.index(column)

    def decode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decode_batch(b.column(at).to_pylist(), charsets, need), pa.string())], [*b.schema.names, out])

    return df.mapInArrow(decode, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def subtitle_text(df: DataFrame, column: str, out: str = "text") -> DataFrame:
    """Bytes of a subtitle file to text: UTF-8 with or without a mark, then the two Korean charsets; no letter is asked for."""
    return decode_text(df, column, out, ("utf-8-sig", "utf-8", "cp949", "euc-kr"), need="")


def write_files(df: DataFrame, path: str, *, name: str, text: str) -> None:
    """A file for each row, as of subtitles, in a folder of its ``name``; a task that is run again leaves no second file."""
    df.select(name, F.col(text).cast("string").alias("value")).write.partitionBy(name).text(path)


def read_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, text) of the files of ``write_files``."""
    return spark.read.text(path, wholetext=True).select(name, F.col("value").alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)
