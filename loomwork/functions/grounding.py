"""Quantities, terms and categories of Korean texts, and how an article grounds them.  Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionaries as d
from . import scoring as s
from .text import count_of, lenient_json, lines, matches, plain_pattern, strip

_CUT = "\u0001"


def _words(terms: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def _has_any(x: Column, terms: list[str]) -> Column:
    return F.exists(_words(terms), lambda t: F.contains(x, t))


def quantities(x: Column) -> Column:
    """array<struct<token, num, unit>>: dates, ranks and amounts with a scale or unit, each token once.

    A null text has none.  Numbers that stand alone or tell nothing are left out.
    """
    x = F.coalesce(x, F.lit(""))
    groups = lambda p, n: F.transform(F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?U){p}"), 0)), lambda m: F.array(m, *[F.regexp_extract(m, f"(?U){p}", i) for i in range(1, n + 1)]))
    return quantities_of(groups(d.DATE, 0), groups(d.RANK, 1), groups(d.AMOUNT, 3))


def quantities_of(dates: Column, ranks: Column, amounts: Column) -> Column:
    """``quantities`` of the three patterns' matches: arrays of the whole match and the groups (of ranks one, of amounts three).

    A match by itself has the same groups as in its text, since the patterns look at nothing beside it.
    """

    def row(token: Column, num: Column, unit: Column) -> Column:
        return F.concat_ws(_CUT, token, num, unit)

    dates = F.transform(dates, lambda m: row(strip(m[0]), strip(m[0]), F.lit("date")))
    ranks = F.transform(ranks, lambda m: row(strip(m[0]), m[1], F.lit("rank")))
    told = F.filter(amounts, lambda m: ((m[2] != "") | (m[3] != "")) & ~strip(m[0]).isin(d.BENIGN_NUMBERS))
    amounts = F.transform(told, lambda m: row(strip(m[0]), F.concat(F.replace(m[1], F.lit(","), F.lit("")), m[2]), m[3]))
    # of strings, which Spark tells apart by hashing
    every = F.array_distinct(F.concat(dates, ranks, amounts))
    part = lambda s, i: F.split_part(s, F.lit(_CUT), F.lit(i))
    return F.transform(every, lambda s: F.struct(part(s, 1).alias("token"), part(s, 2).alias("num"), part(s, 3).alias("unit")))


def squeezed(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(","), F.lit("")), F.lit(" "), F.lit(""))


def quantity_grounded(q: Column, article: Column, plain: Column | None = None) -> Column:
    """As it stands, without spaces and commas, as an equal rank, by number and scale, or by three digits or more.

    ``plain``, the article squeezed, may be given as a column that is there already.
    """
    plain, num = squeezed(article) if plain is None else plain, squeezed(q["num"])
    digits, rank = F.regexp_replace(q["num"], "[^0-9]", ""), F.regexp_extract(q["token"], "([0-9]+)", 1)
    same_rank = (q["unit"] == "rank") & F.when(rank == "1", _has_any(article, d.FIRST_RANK)).otherwise(F.contains(plain, F.concat(rank, F.lit("위"))) | F.contains(plain, F.concat(rank, F.lit("등"))))
    by_digits = (F.length(digits) >= 3) & F.contains(plain, digits)
    return F.contains(article, q["token"]) | F.contains(plain, squeezed(q["token"])) | same_rank | ((num != "") & F.contains(plain, num)) | by_digits


def major_claim(q: Column) -> Column:
    return _has_any(q["token"], d.MAJOR_SCALES) | (F.contains(q["token"], F.lit("만")) & _has_any(q["token"], d.MAJOR_UNITS)) | (q["unit"] == "rank")


def ungrounded_quantities(script: Column, article: Column) -> Column:
    """Quantities of a script that its article (null: empty) does not ground, in the script's order by kind."""
    a = F.coalesce(article, F.lit(""))
    return F.filter(quantities(script), lambda q: ~quantity_grounded(q, a))


def quoted_entities(x: Column) -> Column:
    """What stands between quotation marks, 2 to 25 characters, in order, repeats included."""
    return stripped_entities(F.regexp_extract_all(x, F.lit(d.QUOTED), 1))


def stripped_entities(quoted: Column) -> Column:
    """``quoted_entities`` of what the pattern's group holds."""
    return F.filter(F.transform(quoted, strip), lambda q: F.length(q) >= 2)


def detected_artist(title: Column, content: Column, name: Column, artists: list[str] = d.ARTISTS) -> Column:
    """The name if given; else the first artist in the title; else the most frequent one, the first of equals; else null."""
    both = F.concat_ws("\n", title, content)
    return target_artist(title, name, F.transform(_words(artists), lambda a: F.struct(a.alias("term"), count_of(both, a).alias("n"))), artists)


def target_artist(title: Column, name: Column, counted: Column, artists: list[str] = d.ARTISTS) -> Column:
    """``detected_artist`` by the artists' numbers (``scan.terms_held``, or all) in title and content."""
    in_title = F.try_element_at(F.filter(_words(artists), lambda a: F.contains(title, a)), F.lit(1))
    ranked = F.transform(F.filter(counted, lambda x: x["n"] > 0), lambda x, i: F.struct(x["n"].alias("n"), (-i).alias("o"), x["term"].alias("a")))
    return F.coalesce(F.nullif(strip(name), F.lit("")), in_title, F.array_max(ranked)["a"])


def names_of(target: Column, aliases: dict[str, list[str]] = d.ALIASES) -> Column:
    """An artist's names, the other ones first; of none, a null."""
    called = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), _words(v))])
    return F.array_append(F.coalesce(F.try_element_at(called, target), F.array().cast("array<string>")), target)


def fact_parts(title: Column, content: Column, script: Column, blog: Column, name: Column, *, artists: list[str] = d.ARTISTS, aliases: dict[str, list[str]] = d.ALIASES, programs: list[str] = d.PROGRAMS, critical_terms: list[str] = d.CRITICAL_TERMS, clickbait: list[str] = d.CLICKBAIT, target: Column | None = None, missing: Column | None = None, seen: dict[str, Column] | None = None) -> Column:
    """struct<artist, entity, numbers, terms, blog, short, grave>: the parts of the check of a script against its article.

    Nulls count as empty; without a blog its points are full.  ``target`` (of ``detected_artist``) and ``missing`` (of
    ``ungrounded_quantities`` against title and text) may be given as columns that are there already, since both are used often.  So may what ``scan`` has
    ``seen``: ``script`` and ``blog`` (terms held, with the artists and without), ``quotes``, ``sections``, ``script_named`` and
    ``blog_named`` (any of ``names_of`` the target), ``script_length`` and ``blog_length`` (without white space at the ends).
    """
    title, content, script, blog, name = (F.coalesce(x, F.lit("")) for x in (title, content, script, blog, name))
    article = F.concat_ws("\n", title, content)
    target = detected_artist(title, content, name, artists) if target is None else target
    if seen is None:
        seen = {k: F.filter(_words([*(artists if x is script else ()), *programs, *critical_terms, *clickbait]), lambda t: F.contains(x, t)) for k, x in (("script", script), ("blog", blog))}
        names = names_of(target, aliases)
        seen |= {f"{k}_named": F.exists(names, lambda n: F.contains(x, n)) for k, x in (("script", script), ("blog", blog))}
        seen |= {"quotes": F.regexp_extract_all(script, F.lit(d.QUOTED), 1), "sections": F.regexp_count(blog, F.lit(d.SECTION)), "script_length": F.length(strip(script)), "blog_length": F.length(strip(blog))}
    lacks = lambda text, terms: F.size(F.filter(seen[text], lambda t: t.isin(terms) & ~F.contains(article, t)))
    named = lambda text: F.when(target.isNotNull(), seen[f"{text}_named"])
    others = F.size(F.filter(seen["script"], lambda a: a.isin(artists) & (a != target) & ~F.contains(article, a))) > 0
    quotes = F.size(F.filter(stripped_entities(seen["quotes"]), lambda q: ~F.contains(article, q)))
    entity = s.entity_score(named("script"), others, quotes, lacks("script", programs))
    missing = ungrounded_quantities(script, article) if missing is None else missing
    major = F.size(F.filter(missing, major_claim))
    numbers = s.number_fidelity(major, F.size(missing) - major)
    terms = s.term_score(lacks("script", critical_terms), lacks("script", clickbait))
    none = seen["blog_length"] == 0
    loose = ~((seen["sections"] >= 3) | ((F.length(blog) >= 500) & F.contains(blog, F.lit("\n\n"))))
    lost = F.when(~F.coalesce(named("blog"), F.lit(True)), 1.5).otherwise(0.0) + lacks("blog", critical_terms) * 2.0 + F.when(loose, 1.0).otherwise(0.0) + s.blog_band(seen["blog_length"])
    blog_score = F.when(none, 4.0).otherwise(F.greatest(F.lit(0.0), 4.0 - lost))
    grave = F.coalesce(others & ~named("script"), F.lit(False)) | (major >= 2) | (lacks("script", critical_terms) > 0) | (~none & (lacks("blog", critical_terms) > 0))
    return F.struct(target.alias("artist"), entity.alias("entity"), numbers.alias("numbers"), terms.alias("terms"), blog_score.alias("blog"), s.shorts_band(seen["script_length"]).alias("short"), grave.alias("grave"))


def fact_total(p: Column) -> Column:
    """struct<artist, entity, numbers, terms, blog, total, critical, passed> of the parts."""
    total = s.clamp_total([p["entity"], p["numbers"], p["terms"], p["blog"], -p["short"]], 30.0)
    critical = p["grave"] | (total < 15)
    return F.struct(*[p[c].alias(c) for c in ("artist", "entity", "numbers", "terms", "blog")], total.alias("total"), critical.alias("critical"), ((total >= 21) & ~critical).alias("passed"))


def fact_check(*texts: Column, **lists) -> Column:
    """``fact_total`` of ``fact_parts``, for single rows; on tables give the parts a column of their own."""
    return fact_total(fact_parts(*texts, **lists))


def category_matches(x: Column) -> Column:
    """array<struct<category, n, score>> of the categories that a sentence has, in dictionary order.

    One alternation of all patterns tells first whether there is any; only sentences that have one are matched category by category.
    """
    anyone = x.rlike("|".join(map(plain_pattern, d.CATEGORY_PATTERNS.values())))
    each = [F.struct(F.lit(c).alias("category"), F.size(matches(x, p)).alias("n"), F.lit(d.CATEGORY_WEIGHTS[c]).alias("w")) for c, p in d.CATEGORY_PATTERNS.items()]
    found = F.transform(F.filter(F.array(*each), lambda m: m["n"] > 0), lambda m: F.struct(m["category"].alias("category"), m["n"].alias("n"), (m["n"] * m["w"]).alias("score")))
    return F.when(anyone, found).otherwise(F.array().cast("array<struct<category:string,n:int,score:double>>"))


def best_category(x: Column) -> Column:
    """The category of the greatest weighted count, the first of equals; null without any."""
    ranked = F.transform(category_matches(x), lambda m, i: F.struct(m["score"].alias("score"), (-i).alias("o"), m["category"].alias("category")))
    return F.array_max(ranked)["category"]


def canonical_category(name: Column) -> Column:
    """A keyword's category; else that of the first keyword in the name; else its letters, digits, _ and -; else audience."""
    clean = F.lower(strip(name))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in d.KEYWORD_CATEGORIES.items()])
    hit = lambda test: F.try_element_at(F.filter(pairs, test), F.lit(1))["v"]
    plain = F.regexp_replace(clean, "[^a-zA-Z0-9_-]", "")
    return F.coalesce(hit(lambda p: p["k"] == clean), hit(lambda p: F.contains(clean, p["k"])), F.nullif(plain, F.lit("")), F.lit("audience"))


def article_lines(x: Column) -> Column:
    """Lines of ten characters or more without menus, addresses, rights and marks."""

    def good(s: Column) -> Column:
        marks = F.exists(_words(d.LINE_STARTS), lambda m: F.startswith(s, m))
        return (F.length(s) >= 10) & ~_has_any(s, d.LINE_JUNK) & ~s.rlike(d.EMAIL) & ~_has_any(s, d.LINE_RIGHTS) & ~marks

    return F.filter(lines(x), good)


def reviewed(raw: Column) -> Column:
    """A reviewer's reply, whatever stands around its object, as ``reviewed_object`` reads it."""
    return reviewed_object(lenient_json(raw))


def reviewed_object(json: Column) -> Column:
    """A reply's object as struct<score, status, not_run, critical, n_issues, n_recommendations>.

    Without an object or a number as its score the review was not run: null score.  A score is kept in
    0 to 25; an error, a high severity or a critical flag fails it, and then it is 14.5 if above 15.
    """
    fields = "score string, status string, critical_error boolean, issues array<struct<type string, severity string, message string, evidence string>>, recommendations array<string>"
    j = F.from_json(json, fields)
    number = j["score"].try_cast("double")
    score = F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(25.0), number)))  # least and greatest pass over nulls
    text = lambda s: strip(F.coalesce(s, F.lit("")))
    issues = F.filter(F.coalesce(j["issues"], F.array().cast("array<struct<type:string,severity:string,message:string,evidence:string>>")), lambda i: (text(i["message"]) != "") | (text(i["evidence"]) != ""))
    low = lambda s: F.lower(F.coalesce(s, F.lit("")))
    severe = lambda i: (low(i["type"]) == "error") | (low(i["severity"]) == "high")
    failed = F.exists(issues, severe) | F.coalesce(j["critical_error"], F.lit(False))
    said = F.upper(F.coalesce(j["status"], F.lit("")))
    by_score = F.when(score >= 20, "PASS").when(score >= 15, "WARNING").otherwise("FAIL")
    status = F.when(failed, "FAIL").when((F.size(issues) == 0) & (score >= 20), "PASS").when(said.isin("PASS", "WARNING", "FAIL", "AI_QA_NOT_RUN", "NOT_RUN"), said).otherwise(by_score)
    advice = F.filter(F.coalesce(j["recommendations"], F.array().cast("array<string>")), lambda r: text(r) != "")
    return F.struct(
        s.exact_round(F.when(failed & (score > 15), 14.5).otherwise(score), 1).alias("score"),
        F.when(score.isNull(), "AI_QA_NOT_RUN").otherwise(status).alias("status"),
        score.isNull().alias("not_run"),
        (score.isNotNull() & F.coalesce(j["critical_error"], F.lit(False))).alias("critical"),
        F.when(score.isNull(), 0).otherwise(F.size(issues)).alias("n_issues"),
        F.when(score.isNull(), 0).otherwise(F.size(advice)).alias("n_recommendations"),
    )
