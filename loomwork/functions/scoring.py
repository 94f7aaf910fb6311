"""Composite scores as Column expressions.  The bounds and penalties are fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import ISSUE_LADDER

def shorts_band(n: Column) -> Column:
    """Penalty for the length of a short script."""
    return F.when(n == 0, 2.0).when(n < 350, 2.0).when(n < 400, 1.0).when(n <= 550, 0.0).otherwise(1.0)


def blog_band(n: Column) -> Column:
    """Penalty for the length of a long text."""
    return F.when(n == 0, 4.0).when(n < 1800, 4.0).when(n < 2160, 2.0).when(n <= 2900, 0.0).otherwise(1.0)


def length_class(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n < 350, "serious_short").when(n < 400, "slight_short").when(n <= 500, "optimal").when(n <= 550, "slight_long").otherwise("excessive")


def hook_penalty(similarity: Column) -> Column:
    return F.when(similarity >= 0.85, 5.0).when(similarity > 0.70, 4.0).when(similarity >= 0.50, 1.5).otherwise(0.0)


def streak_penalty(run: Column) -> Column:
    return F.when(run >= 3, 5.0).when(run == 2, 3.0).when(run == 1, 1.0).otherwise(0.0)


def overlap_penalty(dup: Column, percent: Column) -> Column:
    """One photo used before is no fault; ``percent`` is rounded to one place."""
    return F.when(dup <= 1, 0.0).when(percent >= 50, 10.0).when(percent >= 20, 4.0).otherwise(0.0)


def number_fidelity(major: Column, minor: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(10.0) - 3.0 * major - 1.5 * minor)


def term_score(critical: Column, clickbait: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(8.0) - 4.0 * critical - 2.0 * clickbait)


def entity_score(present: Column, mismatched: Column, quotes: Column, programs: Column) -> Column:
    """No target is a null ``present``: the full score."""
    base = F.when(present.isNull(), F.lit(8.0)).when(mismatched & ~present, F.lit(0.0)).when(mismatched, F.lit(5.0)).when(~present, F.lit(4.0)).otherwise(F.lit(8.0))
    return F.when(present.isNull(), base).otherwise(F.greatest(F.lit(0.0), base - quotes - 1.5 * programs))


def clamp_total(parts: list[Column], top: float) -> Column:
    """Sum of components, a null one (not run) skipped, kept in [0, top] and rounded to one place."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(top), total)), 1)


def verdict(total: Column, critical: Column, reviewed: Column) -> Column:
    return F.when(critical | (total < 70), "FAIL").when(~reviewed, "WARNING").when(total < 90, "WARNING").otherwise("PASS")


def technical(width: Column, height: Column, fps: Column, duration: Column, gap: Column) -> Column:
    """Resolution, frame rate, duration and sound sync of a clip, 11 points at most."""
    res = F.when((width == 1080) & (height == 1920), 5.0).when(height > width, 4.0).otherwise(0.0)
    rate = F.when(fps.between(29, 31), 2.0).when(fps.between(24, 61), 1.5).when(fps > 0, 0.5).otherwise(0.0)
    sync = F.when(gap <= 2.5, 2.0).when(gap <= 5, 1.0).otherwise(0.0)
    return res + rate + F.when(duration > 5, 1.0).otherwise(0.0) + sync


def severity(kind: Column) -> Column:
    return F.when(kind == "error", "high").when(kind == "info", "low").otherwise("medium")


def known_issue(message: Column, component: Column) -> Column:
    """The type of an issue by the first rung of the ladder that its message has; else the component's own."""
    out = F.when(F.lower(message).rlike(ISSUE_LADDER[0][0]), ISSUE_LADDER[0][1])
    for pattern, name in ISSUE_LADDER[1:]:
        out = out.when(F.lower(message).rlike(pattern), name)
    return out.otherwise(F.concat(component, F.lit("_issue")))


def repair_action(kind: Column) -> Column:
    """The repair of a type of issue; null for those that cannot be repaired."""
    return F.when(kind.isin("caption_overflow", "caption_position"), "caption_resize").when(kind.isin("photo_repetition", "scene_mismatch"), "replace_photo").when(kind == "broll_repetition", "replace_broll").when(kind.isin("hook_repetition", "sensationalism", "number_discrepancy"), "rephrase_script")


def advice(status: Column, not_run: Column, technical: Column, factual: Column, repetition: Column, extra: Column) -> Column:
    """array of advice: rules in their order, then what the reviewer adds, trimmed, each once."""
    rules = F.array(
        F.when(not_run, "review_not_run"),
        F.when(status == "PASS", "upload").when(status == "WARNING", "look_first").otherwise("mend"),
        F.when(technical < 15, "check_technical"),
        F.when(factual < 22, "check_facts"),
        F.when(repetition < 18, "check_freshness"),
    )
    return F.array_distinct(F.concat(F.array_compact(rules), F.filter(F.transform(extra, lambda x: F.trim(x)), lambda x: x != "")))


def upload_gate(tech_passed: Column, tech: Column, tech_error: Column, fact_passed: Column, fact: Column, rep_passed: Column, rep: Column) -> Column:
    """struct<technical, factual, repetition>: 14, 21 and 18 points at least (18 is stricter than the check's 17.5)."""
    return F.struct((tech_passed & (tech >= 14) & ~tech_error).alias("technical"), (fact_passed & (fact >= 21)).alias("factual"), (rep_passed & (rep >= 18)).alias("repetition"))


def technical_total(kb: Column, decodes: Column, width: Column, height: Column, fps: Column, duration: Column, audio: Column, gap: Column, srt: Column, assets: Column) -> Column:
    """struct<score, critical, passed>: 20 points; a tiny or broken file or a gap of sound above 5 s caps them at 12."""
    critical = (kb < 10) | ~decodes | (gap > 5)
    raw = F.when(kb >= 10, 3.0).otherwise(0.0) + F.when(decodes, 3.0).otherwise(0.0) + technical(width, height, fps, duration, gap) + F.when(audio, 2.0).otherwise(0.0) + srt + assets
    score = F.when(critical, F.least(F.lit(12.0), raw)).otherwise(raw)
    return F.struct(score.alias("score"), critical.alias("critical"), (~critical & (score >= 14)).alias("passed"))


def timing(at: Column, ideal: Column, total: Column) -> Column:
    """Falls with the distance from the ideal time, rises in the window 28 to 42 s, and is small before 10 s."""
    near = F.greatest(F.lit(0.2), 1 - F.abs(at - ideal) / F.greatest(F.lit(15.0), total))
    return F.when(at.between(28, 42), near + 0.35).when(at < 10, near * 0.4).otherwise(near)


def candidate_score(n: Column, weight: Column, at: Column, ideal: Column, total: Column) -> Column:
    """(n * 1.2 + w) * t for a sentence's best category."""
    return (n * 1.2 + weight) * timing(at, ideal, total)


def secondary_score(n: Column, weight: Column, at: Column, ideal: Column, total: Column) -> Column:
    """(n * 0.8 + w) * t * 0.85 for its other categories."""
    return (n * 0.8 + weight) * timing(at, ideal, total) * 0.85


def ideal_time(total: Column, cut: float = 2.8) -> Column:
    return F.when(total >= 45, 34.0).otherwise(F.greatest(F.lit(2 * cut), total * 0.55))


def exact_round(x: Column, places: int) -> Column:
    """``x`` rounded half to even by its exact binary value, as Python's round does: 2.675 to 2 places is 2.67.

    The product with the power of ten is split into a double and its exact error (Dekker), so ties and near ties are told
    apart.  Exact where the product is below 2^52; beyond, and for NaN and infinities, ``x`` is rounded as a decimal.
    """
    ten = float(10**places)
    split = 134217729.0  # 2^27 + 1
    ten_high = split * ten - (split * ten - ten)
    ten_low = ten - ten_high
    x = x.cast("double")
    high = x * split - (x * split - x)
    low = x - high
    product = x * ten
    error = ((high * ten_high - product) + high * ten_low + low * ten_high) + low * ten_low
    floor = F.floor(product).cast("double")
    beyond = (product - floor - 0.5) + error  # the first difference is exact, and only its sign with the error counts
    # an error below zero at a whole product lies under that whole number, where half is far: no case of its own
    up = F.when(beyond > 0, 1.0).when(beyond < 0, 0.0).otherwise(F.pmod(floor, F.lit(2.0)))
    return F.when(F.abs(product) < 2.0**52, (floor + up) / ten).otherwise(F.bround(x, places))
