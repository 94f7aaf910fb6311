"""Text as Column expressions: tokens, sentences, numbers, grounding, captions, times.  No Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[가-힣a-zA-Z0-9]+"


#: White space of Unicode and the four separators of ASCII.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """All white space at both ends, not only spaces; no pattern, which would look at every character."""
    return F.btrim(x, F.lit(WHITE))


def tokens(x: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(TOKEN), 0), lambda t: F.lower(t)))


def word_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def lines(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s != "")


def hook(x: Column) -> Column:
    """The first sentence of the first line that is not blank; the whole line if no mark and white space end one in it."""
    return F.split(F.coalesce(F.try_element_at(lines(x), F.lit(1)), F.lit("")), r"(?<=[.?!])\s+")[0]


def sentences(x: Column) -> Column:
    """Per line: runs without terminators and the terminators that follow them, stripped."""
    each = F.transform(lines(x), lambda s: F.regexp_extract_all(s, F.lit(r"[^.?!~]+(?:[.?!~]+|$)"), 0))
    return F.filter(F.transform(F.flatten(each), strip), lambda s: s != "")


def long_sentences(x: Column, most: int = 80) -> Column:
    """As ``sentences``; one long sentence is split at the ending syllables that Korean sentences have."""
    ends = F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"[^다요죠군네까]+(?:[다요죠군네까]+|$)"), 0), strip), lambda s: s != "")
    s = sentences(x)
    return F.when((F.size(s) <= 1) & (F.length(x) > most), ends).otherwise(s)


def trimmed(x: Column, most: int) -> Column:
    """A text of more than ``most`` characters cut to its leading sentences, joined by spaces, up to the first that does
    not fit with a separator; if none fits, to the first characters of the first."""
    each = F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def step(a: Column, s: Column) -> Column:
        fits = a["open"] & (F.length(a["text"]) + F.length(s) + 1 <= most)
        return F.struct(F.when(fits, F.concat(a["text"], F.when(a["text"] != "", " ").otherwise(""), s)).otherwise(a["text"]).alias("text"), fits.alias("open"))

    kept = F.nullif(F.aggregate(each, start, step, lambda a: a["text"]), F.lit(""))
    return F.when(F.length(x) <= most, x).otherwise(F.coalesce(kept, F.left(F.try_element_at(each, F.lit(1)), F.lit(most)), x))


def count_of(x: Column, term: Column) -> Column:
    """Occurrences that do not overlap; an empty term occurs never."""
    return F.when(F.length(term) > 0, (F.length(x) - F.length(F.replace(x, term, F.lit("")))) / F.length(term)).otherwise(0).cast("long")


def plain_pattern(pattern: str) -> str:
    """The pattern as it is with case ignored and the classes of Unicode, but without those flags where it can be.

    The flags make every literal slow.  Classes and word ends are written out, and only literals with Latin letters ignore case.
    """
    space = "[" + "".join(f"\\u{ord(c):04x}" for c in WHITE) + "]"
    out = pattern.replace(r"\s", space).replace(r"\d", r"\p{Nd}")
    out = re.sub(r"\\b(\w+)\\b", r"(?<![\\p{L}\\p{M}\\p{N}_])\1(?![\\p{L}\\p{M}\\p{N}_])", out)
    if "\\b" in out or re.search(r"[a-z](?![^{]*\})", re.sub(r"\\u[0-9a-f]{4}|\\p\{\w+\}", "", out)):
        return f"(?iU){pattern}"
    return re.sub(r"(?<![{A-Za-z])([A-Z]{2,})(?![}A-Za-z])", r"(?iu:\1)", out)


def matches(x: Column, pattern: str) -> Column:
    """Distinct matches in their order, case ignored."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(plain_pattern(pattern)), 0))


def ungrounded_terms(script: Column, article: Column, terms: list[str]) -> Column:
    """Terms of the dictionary that the script has and the article lacks, in dictionary order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(script, t) & ~F.contains(article, t))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, milliseconds cut off."""
    ms = F.floor(seconds * 1000)
    return F.concat_ws(",", F.concat_ws(":", *[F.lpad(x.cast("string"), 2, "0") for x in (F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60)]), F.lpad((ms % 1000).cast("string"), 3, "0"))


def parse_srt_time(x: Column) -> Column:
    p = F.split(F.replace(x, F.lit(","), F.lit(":")), ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("long")
    return (n(1) * 3_600_000 + n(2) * 60_000 + n(3) * 1000 + n(4)) / 1000


def pack_captions(words: Column, max_chars: int = 13, max_words: int = 4) -> Column:
    """Greedy captions: a new one where it would get too long or too many words, or a sentence mark ended the last."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(a: Column, w: Column) -> Column:
        cut = (a["n"] > 0) & ((F.length(a["now"]) + 1 + F.length(w) > max_chars) | (a["n"] >= max_words) | a["now"].rlike("[.!?,~]$"))
        fresh = F.when(cut, F.array_append(a["done"], a["now"])).otherwise(a["done"])
        return F.struct(fresh.alias("done"), F.when(cut | (a["n"] == 0), w).otherwise(F.concat_ws(" ", a["now"], w)).alias("now"), F.when(cut, 1).otherwise(a["n"] + 1).alias("n"))

    return F.aggregate(words, start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"]))


def lenient_json(x: Column) -> Column:
    """The object of a reply, without its fence: the whole if it is one, the first of a list of objects; only if the
    whole is no JSON the outermost braces; else null."""
    bare = strip(x)
    bare = F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(bare)
    inner, first = F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.get_json_object(bare, "$[0]")
    parses = F.try_parse_json(bare).isNotNull()
    whole = F.when(bare.startswith("{"), bare).when(bare.startswith("[") & first.startswith("{"), first)
    return F.when(parses, whole).when(F.try_parse_json(inner).isNotNull(), inner)


def greedy_gap(times: Column, gap: float, most: int) -> Column:
    """Of times in priority order, those at least ``gap`` from all accepted before, ``most`` at most."""
    none = F.array().cast("array<double>")
    return F.aggregate(times, none, lambda acc, t: F.when((F.size(acc) < most) & ~F.exists(acc, lambda a: F.abs(a - t) < gap), F.array_append(acc, t)).otherwise(acc))


def rounded_cursor(durations: Column, total: float) -> Column:
    """Segments with a running, rounded cursor, clipped at the total; those without length are dropped."""
    seg = "array<struct<start:double,end:double>>"
    start = F.struct(F.array().cast(seg).alias("out"), F.lit(0.0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        end = F.floor(F.least(a["at"] + x, F.lit(total)) * 100 + 0.5) / 100
        ok = end > a["at"]
        return F.struct(F.when(ok, F.array_append(a["out"], F.struct(a["at"].alias("start"), end.alias("end")))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], end).alias("at"))

    return F.aggregate(durations, start, step, lambda a: a["out"])
