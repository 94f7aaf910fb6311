"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled PCM, with numpy.

The companding codes expand through 256-entry tables made from the G.711 rule.  ADPCM is decoded
across blocks: one step handles the same sample of every block, so the loop runs over the samples of a
block and not over the blocks.  Media are RIFF/WAVE bytes in a binary column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load, scratch_folder

MULAW, ALAW, IMA_ADPCM, PCM = 7, 6, 17, 1
UNIT = 64
FEATURE_SAMPLES = 1 << 20
#: About so many bytes of PCM go to Spark at once.
BATCH_BYTES = 8 << 20
#: Rows of a batch that are held as Python objects at once.
STORE_ROWS = 256


def mulaw_table() -> np.ndarray:
    """Linear 16-bit value of each mu-law code (bits inverted; sign, 3-bit segment, 4-bit step)."""
    c = ~np.arange(256) & 0xFF
    size = ((((c & 15) << 3) + 132) << ((c >> 4) & 7)) - 132
    return np.where(c & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit value of each A-law code (even bits inverted)."""
    c = np.arange(256) ^ 0x55
    seg, step = (c >> 4) & 7, (c & 15) << 4
    size = np.where(seg == 0, step + 8, (step + 0x108) << np.maximum(seg - 1, 0))
    return np.where(c & 0x80, size, -size).astype(np.int16)


MULAW_LINEAR, ALAW_LINEAR = mulaw_table(), alaw_table()


#: Fixed values of the IMA ADPCM format.
IMA_STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
        1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
        8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ]
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: whole blocks of ``block`` bytes, each with a 4-byte header; an end too short for a header is dropped by the format."""
    whole = len(data) // block
    out = []
    for chunk, size in ((data[: whole * block], block), (data[whole * block :], len(data) - whole * block)):
        if size < 4 or not chunk:
            continue
        b = np.frombuffer(chunk, np.uint8).reshape(-1, size)
        now = b[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
        index = np.clip(b[:, 2].astype(np.int64), 0, 88)
        codes = np.stack([b[:, 4:] & 15, b[:, 4:] >> 4], axis=2).reshape(len(b), -1).astype(np.int64)
        pcm = np.empty((len(b), codes.shape[1] + 1), np.int16)
        pcm[:, 0] = now
        for i in range(codes.shape[1]):
            code, step = codes[:, i], IMA_STEPS[index]
            diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            now = np.clip(now + np.where(code & 8, -diff, diff), -32768, 32767)
            index = np.clip(index + IMA_INDEX[code & 7], 0, 88)
            pcm[:, i + 1] = now
        out.append(pcm.reshape(-1))
    return np.concatenate(out) if out else np.empty(0, np.int16)


def write_wav(data: bytes, *, codec: int = MULAW, rate: int = 8000, bits: int = 8, block: int = 1) -> bytes:
    """RIFF/WAVE, mono.  An odd chunk is padded, as the format asks; the data's length stays exact."""
    fmt = struct.pack("<HHIIHHH", codec, 1, rate, rate * block if codec != PCM else rate * bits // 8, block if codec != PCM else bits // 8, bits, 0)
    fact = struct.pack("<I", len(data) * 8 // max(bits, 1))
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<I", 4) + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes | memoryview) -> tuple[dict[str, int], memoryview]:
    """The format and the data chunk of RIFF/WAVE bytes; ValueError if they are not that."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    view, at, fmt = memoryview(media), 12, {}
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), int.from_bytes(view[at + 4 : at + 8], "little")
        if name == b"fmt ":
            codec, _, rate, _, block, bits = struct.unpack("<HHIIHH", view[at + 8 : at + 24])
            fmt = {"codec": codec, "rate": rate, "block": block, "bits": bits}
        elif name == b"data":
            return fmt, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(fmt: dict[str, int], data: memoryview) -> np.ndarray:
    """Linear 16-bit samples of the stored bytes."""
    if fmt["codec"] == MULAW:
        return MULAW_LINEAR[np.frombuffer(data, np.uint8)]
    if fmt["codec"] == ALAW:
        return ALAW_LINEAR[np.frombuffer(data, np.uint8)]
    if fmt["codec"] == IMA_ADPCM:
        return decode_adpcm(bytes(data), fmt["block"])
    if fmt["codec"] == PCM and fmt["bits"] == 16:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"codec {fmt['codec']} with {fmt['bits']} bits")


def resampled(fmt: dict[str, int], data: memoryview, to: int) -> Iterator[np.ndarray]:
    """The stored samples at another rate, in slices: linear interpolation, the same length of time.

    Companded samples are expanded slice by slice too, so memory does not follow the length.
    """
    rate, companded = fmt["rate"], fmt["codec"] in (MULAW, ALAW)
    raw = np.frombuffer(data, np.uint8) if companded else decode(fmt, data)
    table = MULAW_LINEAR if fmt["codec"] == MULAW else ALAW_LINEAR
    total = max(1, len(raw) * to // rate) if len(raw) else 0
    for at in range(0, total, FEATURE_SAMPLES):
        place = np.arange(at, min(at + FEATURE_SAMPLES, total), dtype=np.int64) * rate
        left, rest = place // to, place % to
        lo = int(left[0])
        part = raw[lo : int(left[-1]) + 2]
        part = table[part] if companded else part
        now = part[left - lo].astype(np.int64)
        then = part[np.minimum(left - lo + 1, len(part) - 1)]
        yield np.rint(now + (then - now) * (rest / to)).astype(np.int16)


def _stored(batches: Iterator[pa.RecordBatch], codec: int, rate: int) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(at, STORE_ROWS) for whole in batches for at in range(0, whole.num_rows, STORE_ROWS)):
        raw = [x or b"" for x in b.column("b").to_pylist()]
        media = [write_wav(x.ljust(max(UNIT, -(-len(x) // UNIT) * UNIT), b"\0"), codec=codec, rate=rate) for x in raw]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])


def _converted(batches: Iterator[pa.RecordBatch], rate: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pcm, errors, held, at = [], [], 0, 0
        for i, m in enumerate(b.column("media")):
            try:
                fmt, data = read_wav(memoryview(m.as_buffer() if m.is_valid else b""))
                pcm.append(write_wav(b"".join(x.astype("<i2").tobytes() for x in resampled(fmt, data, rate)), codec=PCM, rate=rate, bits=16))
                errors.append(None)
                held += len(pcm[-1])
            except (ValueError, struct.error) as e:
                pcm.append(None)
                errors.append(str(e))
            if held >= BATCH_BYTES or i == b.num_rows - 1:
                part = b.slice(at, len(pcm))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pcm, pa.binary()), pa.array(errors, pa.string())], [*part.schema.names, "pcm", "error"])
                pcm, errors, held, at = [], [], 0, i + 1


def _named(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.rename_columns([id_col, *b.schema.names[1:]])


def store_audio(rows: DataFrame, *, id_col: str = "doc_id", data_col: str = "text", codec: int = MULAW, rate: int = 8000, pcm_rate: int | None = None) -> DataFrame:
    """``id_col``, n_bytes, media: the column's UTF-8 (or binary) bytes, filled with bytes 0 to a positive
    multiple of 64, losslessly as 8-bit telephony samples.  Null counts as no bytes.

    With ``pcm_rate`` the columns of ``convert_audio`` at that rate follow, in the same pass.
    """
    chosen = rows.select(rows[id_col].alias("id"), rows[data_col].cast("binary").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        media = _stored(batches, codec, rate)
        return _named(_converted(media, pcm_rate) if pcm_rate else media, id_col)

    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema['id'].dataType.simpleString()}, n_bytes long, media binary" + ", pcm binary, error string" * bool(pcm_rate))


def to_pcm(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", rate: int = 16000) -> DataFrame:
    """``id_col``, pcm (RIFF/WAVE, 16 bits, at ``rate``), error: telephony media decoded and resampled.

    Null or broken media give a null pcm and say why in ``error``; they never stop the job.
    """
    chosen = media.select(media[id_col].alias("id"), media[media_col].cast("binary").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for m in b.column("m").to_pylist():
                try:
                    fmt, data = read_wav(m or b"")
                    out.append(write_wav(b"".join(x.astype("<i2").tobytes() for x in resampled(fmt, data, rate)), codec=PCM, rate=rate, bits=16))
                    errors.append(None)
                except (ValueError, struct.error) as e:
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary()), pa.array(errors, pa.string())], [id_col, "pcm", "error"])

    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema['id'].dataType.simpleString()}, pcm binary, error string")


def samples_digest(slices: Iterable[np.ndarray], rate: int) -> tuple[int, str, str]:
    """Bytes and SHA-256 of 16-bit samples, and their features: samples, peak, root mean square and zero crossings,
    from exact integer sums over slices."""
    n = peak = energy = crossings = 0
    last, digest = None, hashlib.sha256()
    for pcm in slices:
        digest.update(pcm.astype("<i2").tobytes())
        x = pcm.astype(np.int64)
        peak = max(peak, int(np.abs(x).max()))
        energy += int((x * x).sum())
        sign = pcm < 0
        crossings += int((sign[1:] != sign[:-1]).sum()) + (last is not None and last != bool(sign[0]))
        last, n = bool(sign[-1]), n + len(pcm)
    m = max(n, 1)
    return 2 * n, digest.hexdigest(), f"rate={rate};n={n};peak={peak};rms={(energy / m) ** 0.5:.3f};zcr={crossings / m:.5f}"


def pcm_digest(fmt: dict[str, int], data: memoryview, rate: int) -> tuple[int, str, str]:
    """``samples_digest`` of the resampled PCM, which is not kept."""
    return samples_digest(resampled(fmt, data, rate), rate)


def audio_digest(stored: DataFrame, *, id_col: str = "doc_id", rate: int = 16000) -> DataFrame:
    """Digests of stored media and of their resampled PCM, all from the stored bytes read back.

    Null or broken media give null digests and say why in ``error``; they never stop the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for m in b.column("media"):
                try:
                    media = memoryview(m.as_buffer() if m.is_valid else b"")
                    fmt, data = read_wav(media)
                    pcm_bytes, pcm_sha256, feature = pcm_digest(fmt, data, rate)
                    values = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, pcm_bytes, pcm_sha256, None)
                except (ValueError, struct.error) as e:
                    values = (None,) * 8 + (str(e),)
                for c, v in zip(cols, values):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), b.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256", "error"],
            )

    kind = stored.schema[id_col].dataType.simpleString()
    return stored.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string, error string")


def convert_audio(stored: DataFrame, *, id_col: str = "doc_id", rate: int = 16000) -> DataFrame:
    """``id_col``, n_bytes, the stored ``media``, and their resampled PCM as RIFF/WAVE bytes (``pcm``).

    Null or broken media give null PCM and say why in ``error``; they never stop the job.
    """
    kind = stored.schema[id_col].dataType.simpleString()
    return stored.select(id_col, "n_bytes", "media").mapInArrow(lambda batches: _converted(batches, rate), f"`{id_col}` {kind}, n_bytes long, media binary, pcm binary, error string")


def same_samples(fmt: dict[str, int], data: memoryview, pcm: np.ndarray, rate: int) -> Iterator[np.ndarray]:
    """``pcm`` in slices; ValueError if they are not what the media's samples give at ``rate``."""
    at = 0
    for x in resampled(fmt, data, rate):
        part = pcm[at : at + len(x)]
        if not np.array_equal(part, x):
            raise ValueError("the PCM are not those of the media")
        yield part
        at += len(x)
    if at < len(pcm):
        raise ValueError("the PCM are longer than the media")


def pcm_features(converted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The columns of ``audio_digest``: those on media from the bytes of ``convert_audio``'s ``media``, those on PCM from its ``pcm``.

    Every PCM is compared with what its media give; where they differ, the digests are null and ``error`` says so.
    """
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm_bytes", pa.int64()), ("pcm_sha256", pa.string()), ("error", pa.string())]

    def digest(m: pa.BinaryScalar, p: pa.BinaryScalar, error: str | None) -> tuple:
        if error is not None:
            return (None,) * 8 + (error,)
        try:
            media = memoryview(m.as_buffer() if m.is_valid else b"")
            fmt, data = read_wav(media)
            pcm_fmt, pcm = read_wav(memoryview(p.as_buffer() if p.is_valid else b""))
            n, sha256, feature = samples_digest(same_samples(fmt, data, decode(pcm_fmt, pcm), pcm_fmt["rate"]), pcm_fmt["rate"])
        except (ValueError, struct.error) as e:
            return (None,) * 8 + (str(e),)
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, n, sha256, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [digest(m, p, e.as_py()) for m, p, e in zip(b.column("media"), b.column("pcm"), b.column("error"))]
            made = [pa.array([g[k] for g in got], kind) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("n_bytes"), *made], [id_col, "n_bytes", *[name for name, _ in fields]])

    kind = converted.schema[id_col].dataType.simpleString()
    return converted.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string, error string")


def _write(rows: DataFrame, path: str) -> None:
    """Parquet, tightly packed, since samples at the higher rate take four bytes for each of the text.

    Pages are compressed one by one; those of 8 MB show zstd more that repeats than the usual ones of 1 MB.
    """
    rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "11").option("parquet.page.size", str(8 << 20)).parquet(path)


def op7_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media and their resampled PCM are written as Parquet in the folder that the cluster shares, and both are read again from there.

    They are columns of the same files, so no digest of the media has to be kept beside the PCM.  Texts are sorted
    within their partitions, so that near copies are compressed together.
    """
    path = scratch_folder(spark, "pcm")
    _write(store_audio(load(spark, sf_dir, "documents").select("doc_id", "text").sortWithinPartitions("text"), pcm_rate=16000), path)
    return pcm_features(spark.read.parquet(path))


QUERIES = {"op7_media_audio": op7_media_audio}
ORACLES: dict[str, str] = {}
