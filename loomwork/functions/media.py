"""Media metadata as Column expressions: hashes, probe reports, geometry, colours, subtitles, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes of up to 16 digits; 64 where one is missing or not hex."""

    def half(x: Column, at: int) -> Column:
        return F.conv(F.substr(F.lpad(strip(x), 16, "0"), F.lit(at), F.lit(8)), 16, 10).cast("long")

    ok = lambda x: strip(x).rlike("^[0-9a-fA-F]{1,16}$")
    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))  # one word of 64 bits would overflow
    return F.when(F.coalesce(ok(a) & ok(b), F.lit(False)), bits).otherwise(64)


def rising_bits(grey: Column, width: int = 9) -> Column:
    """16 hex digits of a grey image of ``width`` columns in row order: 1 where a point is brighter than its right one."""
    n = F.size(grey)
    at = F.filter(F.sequence(F.lit(0), n - 2), lambda i: i % width != width - 1)
    bits = F.array_join(F.transform(at, lambda i: (F.get(grey, i) > F.get(grey, i + 1)).cast("int").cast("string")), "")
    return F.when(n == 8 * width, F.concat(*[F.lpad(F.lower(F.conv(F.substr(bits, F.lit(i), F.lit(32)), 2, 16)), 8, "0") for i in (1, 33)]))


def probe(report: Column) -> Column:
    """struct<duration, has_audio, has_video, width, height, fps> of a probe's report; what is absent is null or false."""
    video = F.filter(F.split(report, r"\r?\n"), lambda s: F.contains(s, F.lit("Stream #")) & F.contains(s, F.lit("Video:")))
    first = lambda p, i: F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(F.filter(video, lambda s: s.rlike(p)), F.lit(1)), F.lit("")), p, i), F.lit(""))
    clock = r"Duration:\s*([0-9]+):([0-9]+):([0-9.]+)"
    part = lambda i: F.regexp_extract(report, clock, i).try_cast("double")
    size = "([0-9]{3,5})x([0-9]{3,5})"
    return F.struct(
        (part(1) * 3600 + part(2) * 60 + part(3)).alias("duration"),
        F.coalesce(report.rlike(r"Stream #[^\n]*Audio:"), F.lit(False)).alias("has_audio"),
        (F.size(F.coalesce(video, F.array().cast("array<string>"))) > 0).alias("has_video"),
        first(size, 1).try_cast("int").alias("width"),
        first(size, 2).try_cast("int").alias("height"),
        first(r"([0-9.]+)\s*fps", 1).try_cast("double").alias("fps"),
    )


def crop_window(width: Column, height: Column, face_x: Column, face_y: Column, ratio: float = 9 / 16) -> Column:
    """struct<x, y, width, height> of a portrait crop: a wide image around the face, a tall one with the face 30 % from its top."""
    wide = width / height > ratio
    w = F.when(wide, F.floor(height * ratio)).otherwise(width).cast("int")
    h = F.when(wide, height).otherwise(F.floor(width / ratio)).cast("int")
    kept = lambda at, room: F.greatest(F.lit(0), F.least(at.cast("int"), room)).cast("int")
    return F.struct(F.when(wide, kept(face_x - w / 2, width - w)).otherwise(0).alias("x"), F.when(wide, 0).otherwise(kept(face_y - h * 0.3, height - h)).alias("y"), w.alias("width"), h.alias("height"))


def subtitle_colour(css: Column) -> Column:
    """#RRGGBB as &H00BBGGRR; yellow for anything else."""
    x = F.regexp_replace(css, "^#+", "")
    return F.when(F.length(x) == 6, F.upper(F.concat(F.lit("&H00"), F.substr(x, F.lit(5), F.lit(2)), F.substr(x, F.lit(3), F.lit(2)), F.substr(x, F.lit(1), F.lit(2))))).otherwise("&H0000FFFF")


def video_id(url: Column) -> Column:
    """The eleven characters of a video's address; null without them."""
    return F.nullif(F.regexp_extract(url, "(?:v=|/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def absolute_url(url: Column, base: Column) -> Column:
    """https for // addresses, the base's host for those that begin with /, others as they are."""
    host = F.regexp_extract(base, "^(https?://[^/]+)", 1)
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(host, url)).otherwise(url)


def cues(srt: Column) -> Column:
    """array<struct<text, stacked>> of a subtitle file: lines after each timing, without tags; stacked if several or broken."""
    blocks = F.split(strip(F.coalesce(srt, F.lit(""))), r"\r?\n\s*\r?\n")

    def cue(block: Column) -> Column:
        rows = F.filter(F.transform(F.split(block, r"\r?\n"), strip), lambda s: s != "")
        timing = F.array_position(F.transform(rows, lambda s: F.contains(s, F.lit("-->"))), True).cast("int")
        raw = F.slice(rows, timing + 1, F.size(rows))  # without a timing, all of them
        clean = F.transform(raw, lambda s: strip(F.regexp_replace(s, "<[^>]+>", "")))
        broken = F.exists(clean, lambda s: F.contains(s, F.lit("\\n"))) | F.exists(raw, lambda s: F.contains(F.lower(s), F.lit("<br")))
        return F.struct(F.array_join(clean, "\n").alias("text"), ((F.size(clean) > 1) | broken).alias("stacked"), F.size(clean).alias("n"))

    return F.transform(F.filter(F.transform(blocks, cue), lambda c: c["n"] > 0), lambda c: F.struct(c["text"].alias("text"), c["stacked"].alias("stacked")))


def rescaled(srt: Column, factor: float) -> Column:
    """A subtitle file with all times divided by ``factor`` (milliseconds rounded); as it is within 0.001 of 1 or not above 0."""
    if factor <= 0 or abs(factor - 1) < 0.001:
        return srt

    def clock(x: Column) -> Column:
        p = F.split(F.replace(strip(x), F.lit(","), F.lit(".")), ":")
        n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
        ms = F.bround((n(1) * 3600 + n(2) * 60 + n(3)) / factor * 1000).cast("long")
        two = lambda v: F.lpad(F.floor(v).cast("string"), 2, "0")
        return F.concat(F.concat_ws(":", two(ms / 3_600_000), two(F.floor(ms / 60_000) % 60), two(F.floor(ms / 1000) % 60)), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))

    def line(s: Column) -> Column:
        p = F.split(s, "-->")
        times = F.concat(clock(F.get(p, F.lit(0))), F.lit(" --> "), clock(F.get(p, F.lit(1))))
        return F.when(F.contains(s, F.lit("-->")), F.coalesce(times, s)).otherwise(s)

    return F.array_join(F.transform(F.split(srt, "\n"), line), "\n")


def repair(issue_type: Column, action: Column, component: Column) -> Column:
    """Which repair an issue gets: the first that fits, null without any."""
    a = F.coalesce(action, F.lit(""))
    return (
        F.when((issue_type == "ai_qa_not_run") | (a == "rerun_ai_qa") | (component == "ai_review"), "rerun_review")
        .when((issue_type == "blog_length_issue") | F.contains(a, F.lit("blog")), "extend_blog")
        .when((issue_type == "shorts_length_issue") | (a == "rephrase_script"), "shorten_script")
        .when((issue_type == "tts_sync_issue") | (a == "tts_sync_fix"), "resync_script")
    )
