"""Rules that choose candidates and shape their fields, as Column expressions.  Bounds and marks are fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip


def first_given(*values: str | Column) -> Column:
    """The first value that is neither null nor empty; else null."""
    return F.coalesce(*[F.nullif(F.col(v) if isinstance(v, str) else v, F.lit("")) for v in values])


def approval_tags(category: Column, tags: Column) -> Column:
    """The category (``general`` if blank), two fixed tags, then the given ones: trimmed, lower case, each once."""
    clean = F.filter(F.transform(tags, lambda t: F.lower(strip(t))), lambda t: t != "")
    return F.array_distinct(F.concat(F.array(F.coalesce(F.nullif(F.lower(strip(category)), F.lit("")), F.lit("general")), F.lit("general_broll"), F.lit("approved")), clean))


def valid_photo(width: Column, height: Column, flat: Column) -> Column:
    """At least 280 by 200, no icon of 64 by 64 or less, no flat graphic."""
    return (width >= 280) & (height >= 200) & ~((width <= 64) & (height <= 64)) & ~flat


def usable_length(seconds: Column) -> Column:
    return seconds.between(5, 1200)


def file_rank(f: DataFrame) -> Column:
    """struct to take the least of: mp4 first, then portrait, then by resolution, then in order; carries pos and link.

    The least of the struct is the choice of pool and file at once: a pool is used if it has any file.
    """
    mp4 = F.contains(F.lower(F.col("kind")), F.lit("mp4")) | F.contains(F.lower(F.coalesce("link", F.lit(""))), F.lit(".mp4"))
    size = F.when((F.col("height") == 1920) & (F.col("width") == 1080), 1000).when(F.col("height") >= 1080, 500).when(F.col("height") >= 720, 300).otherwise(F.col("height"))
    return F.struct((~mp4).alias("a"), (F.col("height") < F.col("width")).alias("b"), (-size).alias("c"), "pos", "link")


def telling_sentences(text: Column, marks: list[str]) -> Column:
    """Sentences between full stops, line feeds as spaces: those of more than 20 characters without any mark."""
    each = F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), r"\."), lambda x: F.trim(x))
    return F.filter(each, lambda x: (F.length(x) > 20) & ~F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(x, m)))


def without_cues(text: Column) -> Column:
    """Cues in brackets or parentheses are not spoken."""
    return F.regexp_replace(text, r"\[.*?\]|\(.*?\)", "")


def filled(template: str, fields: dict[str, Column]) -> Column:
    """``{name}`` replaced literally by each field, in order."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def name_by_word(text: Column) -> Column:
    """The Korean name after the word for singer, else before it; null without either."""
    of = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(of(r"가수\s+([가-힣]{2,4})"), of(r"([가-힣]{2,4})\s+가수"))


def name_by_opening(text: Column) -> Column:
    """The Korean name with which the first 80 characters begin, before a word of the trade; null without it."""
    return F.nullif(F.regexp_extract(F.left(text, F.lit(80)), r"^([가-힣]{2,4})(?:이|가|의|은|는)?\s*(?:가수|콘서트|신곡|무대|소속사)", 1), F.lit(""))


def image_extension(address: Column) -> Column:
    """The path's extension if it is jpg, jpeg or png; else .jpg."""
    found = F.regexp_extract(F.lower(F.regexp_replace(address, "[?#].*$", "")), r"(\.(?:jpg|jpeg|png))$", 1)
    return F.when(found == "", ".jpg").otherwise(found)


def first_text_key(raw: Column, keys: list[str]) -> Column:
    """The first key of a JSON object whose text is not blank, stripped; the text of a JSON string; else null."""
    as_text = F.from_json(F.concat(F.lit('{"x":'), raw, F.lit("}")), "x string")["x"]
    blank = lambda x: F.nullif(strip(x), F.lit(""))
    fields = F.coalesce(*[blank(F.get_json_object(raw, f"$.{k}")) for k in keys])
    return F.when(F.try_parse_json(raw).isNull(), F.lit(None).cast("string")).when(raw.startswith("{"), fields).when(raw.startswith('"'), blank(as_text))


def timeline_segments(raw: Column, name: Column, duration: Column) -> Column:
    """The segments of a timeline file for a video: of a bare list all; of an object those listed, if its video has this
    file name, or else if its length is within 2 s; none otherwise or if it is no JSON."""
    seg = "array<struct<type string, path string, start double, end double>>"
    j = F.from_json(raw, f"video_path string, total_duration double, segments {seg}")
    mine = F.element_at(F.split(j["video_path"], r"[/\\]"), -1) == name
    near = (F.coalesce(j["total_duration"], F.lit(0.0)) != 0) & (F.abs(j["total_duration"] - duration) < 2.0)
    listed = F.when(raw.startswith("["), F.from_json(raw, seg)).when(F.coalesce(mine, F.lit(False)) | F.coalesce(near, F.lit(False)), j["segments"])
    return F.coalesce(F.when(F.try_parse_json(raw).isNotNull(), listed), F.array().cast("array<struct<type:string,path:string,start:double,end:double>>"))


def cut_line(index: Column, category: Column, text: Column, cut: float = 2.8) -> Column:
    """One cut of a plan for people: number, times, category or photo, 35 characters of its text."""
    mark = F.coalesce(F.concat(F.lit("["), category, F.lit("]")), F.lit("[사진]"))
    return F.format_string("  - Cut %02d (%4.1fs~%4.1fs) %s | %s", index, index * F.lit(cut), (index + 1) * F.lit(cut), F.rpad(mark, F.greatest(F.lit(10), F.length(mark)), F.lit(" ")), F.left(text, F.lit(35)))


def shared_out(images: Column, videos: Column, total: float, clip: float, title: float = 2.0, least: float = 2.0, cut: float = 2.8) -> Column:
    """struct<clip_dur, cuts, img_dur>: clips shrink (to ``least`` s) if title, clips and ``least`` s an image are too long together;
    images share the rest in cuts of about ``cut`` s, each image once at least."""
    over = title + videos * clip + images * least > total
    clip_dur = F.when(over, F.greatest(F.lit(least), (F.lit(total - title) - images * least) / F.greatest(F.lit(1), videos))).otherwise(F.lit(clip)).cast("double")
    rest = F.greatest(images * least, F.lit(total - title) - videos * clip_dur)
    cuts = F.greatest(images, F.bround(rest / cut, 0).cast("long"))
    return F.struct(clip_dur.alias("clip_dur"), cuts.alias("cuts"), (rest / cuts).alias("img_dur"))
