"""Queries on scripts, articles and blogs in Korean that are written from the rows of the tables.

Each order is a script, each of its items a sentence: who, two phrases and a number, chosen by the item's keys.  The article
has the same sentences, some left out and some with another number.  The SQL writes the same texts and holds the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import dictionaries as words
from loomwork.functions import grounding as ground
from loomwork.functions import media as m
from loomwork.functions import scan
from loomwork.functions import scoring as s
from loomwork.functions import selection as sel
from loomwork.functions import text as t
from loomwork.sources.scratch import scratch_folder
from loomwork.sources.tables import decode_text, json_lines, load, read_files, write_files, write_lines

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


SUBJECTS = ["임영웅이", "그는", "팬들은", "송가인의", "홍길동", "이찬원과", "많은 사람이", "소속사는", "영탁"]
PHRASES = [
    "콘서트 무대에서", "차트 1위를", "기부자 명단에", "눈물바다 속에", "전속계약을 맺고", "팬클럽 응원봉과", "건강 이상으로", "3억 플렉스에", "SNS 댓글로", "새 CF 모델로", "어느 팬 곁에서", "대상을받은 뒤",
    "병원 치료 후", "유튜브 조회수로", "가슴 뭉클 감동적", "오늘은", "날씨가 좋아", "은퇴 소식에", "충격적인", "\"작은 노래\"로", "미스터트롯 무대", "수상식 1등", "떼창과 함성", "그런데", "불화 끝에", "전국투어 공연",
]
MARKS = ["?", "!", "~", ".", ".", ".", "."]
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _number_sql(q: str) -> str:
    return f"CASE (k + s) % 8 WHEN 0 THEN {q} || '위에 올랐다' WHEN 1 THEN {q} || '억 원을 냈다' WHEN 2 THEN {q} || ',000회를 넘겼다' WHEN 3 THEN {q} || '만 명이 모였다' WHEN 4 THEN '2024년 ' || (1 + pos % 12) || '월 ' || (1 + {q} % 28) || '일에 열렸다' WHEN 5 THEN '60초 만에 끝났다' WHEN 6 THEN {q} || '이라고 말했다' ELSE '끝까지 함께했다' END"


def _number(q: Column) -> Column:
    kind, say = (F.col("k") + F.col("s")) % 8, lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    cases = [say(q, "위에 올랐다"), say(q, "억 원을 냈다"), say(q, ",000회를 넘겼다"), say(q, "만 명이 모였다"), say("2024년 ", 1 + F.col("pos") % 12, "월 ", 1 + q % 28, "일에 열렸다"), F.lit("60초 만에 끝났다"), say(q, "이라고 말했다")]
    out = F.when(kind == 0, cases[0])
    for i, c in enumerate(cases[1:], 1):
        out = out.when(kind == i, c)
    return out.otherwise("끝까지 함께했다")


_HEAD = f"{_list(SUBJECTS)}[1 + k % {len(SUBJECTS)}] || ' ' || {_list(PHRASES)}[1 + (k + 3 * s) % {len(PHRASES)}] || ' ' || {_list(PHRASES)}[1 + (5 * k + pos) % {len(PHRASES)}] || ' '"
#: id, pos, k, s, text (the script's sentence), told (the article's, null if left out)
_SENTENCES = f"""n AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS pos, l_partkey AS k, l_suppkey AS s, l_quantity::BIGINT AS q FROM lineitem),
w AS (SELECT id, pos, k, s, {_HEAD} || {_number_sql('q')} AS text, CASE WHEN k % 5 <> 0 THEN {_HEAD} || {_number_sql("(q + (k % 3 = 0)::BIGINT)")} END AS told FROM n)"""
_JOINED = f"string_agg({{x}} || {_list(MARKS)}[1 + k % {len(MARKS)}] || CASE WHEN pos % 3 = 0 THEN chr(10) ELSE ' ' END, '' ORDER BY pos)"
#: id, title, article (title and text), script, blog
_TEXTS = f"""{_SENTENCES}, j AS (SELECT id, repeat({_JOINED.format(x='text')}, (1 + id % 6)::INT) AS script, coalesce({_JOINED.format(x='told')}, '') AS content, CASE WHEN id % 4 = 0 THEN {_list(words.ARTISTS[:8])}[1 + id % 8] || ' 새 소식' ELSE '오늘의 소식' END AS title FROM w GROUP BY 1),
a AS (SELECT id, title, title || chr(10) || content AS article, script, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN repeat('[사진 1] ' || script || chr(10) || chr(10), 8) WHEN 2 THEN content ELSE repeat(content, 20) END AS blog FROM j)"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).cast("long")
    n = load(spark, d, "lineitem").select("l_orderkey", *_ORDER).select(F.col("l_orderkey").alias("id"), pos.alias("pos"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"))
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    k, q = F.col("k"), F.col("q")
    head = F.concat_ws(" ", pick(SUBJECTS, k), pick(PHRASES, k + 3 * F.col("s")), pick(PHRASES, 5 * k + F.col("pos")), F.lit(""))
    told = F.when(k % 5 != 0, F.concat(head, _number(q + (k % 3 == 0).cast("long"))))
    end = F.concat(pick(MARKS, k), F.when(F.col("pos") % 3 == 0, "\n").otherwise(" "))
    return n.select("id", "pos", "k", "s", F.concat(head, _number(q)).alias("text"), told.alias("told"), end.alias("end"))


def once(*columns: Column) -> Column:
    """The columns, computed in this place: an optimizer would put long expressions wherever they are used."""
    return F.inline(F.array(F.struct(*columns)))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    bag = F.array_sort(F.collect_list(F.struct("pos", F.concat("text", "end").alias("text"), F.concat("told", "end").alias("told"))))
    joined = lambda c: F.array_join(F.transform("bag", lambda x: x[c]), "")
    i = F.col("id")
    artist = F.element_at(F.array(*map(F.lit, words.ARTISTS[:8])), (i % 8 + 1).cast("int"))
    title = F.when(i % 4 == 0, F.concat(artist, F.lit(" 새 소식"))).otherwise("오늘의 소식")
    j = _sentences(spark, d).groupBy("id").agg(bag.alias("bag")).select("id", once(F.repeat(joined("text"), (1 + i % 6).cast("int")).alias("script"), joined("told").alias("content"), title.alias("title")))
    blog = F.when(i % 4 == 1, F.repeat(F.concat(F.lit("[사진 1] "), "script", F.lit("\n\n")), 8)).when(i % 4 == 2, F.col("content")).when(i % 4 == 3, F.repeat("content", 20))
    return j.select("id", "title", "content", "script", once(blog.alias("blog")))


# --- numbers ---


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_TRIM = "trim({}, ' ' || chr(10))"
#: Quantities of the texts in x(id, text): id, token, num, kind; each once.
_FOUND = " UNION ".join(
    f"SELECT id, {_TRIM.format('z[1]')} AS token, {num} AS num, {unit} AS unit, '{kind}' AS kind FROM (SELECT id, unnest(list_zip({', '.join(f'list_transform(regexp_extract_all(text, $${p}$$, {i}), lambda y: coalesce(y, {chr(39) * 2}))' for i in groups)})) AS z FROM x) {where}"
    for kind, p, groups, num, unit, where in (
        ("date", words.DATE, (0, 0), _TRIM.format("z[1]"), "'date'", ""),
        ("rank", words.RANK, (0, 1), "z[2]", "'rank'", ""),
        ("amount", words.AMOUNT, (0, 1, 2, 3), "replace(z[2], ',', '') || z[3]", "z[4]", f"WHERE (z[3] <> '' OR z[4] <> '') AND {_TRIM.format('z[1]')} NOT IN ({', '.join(map(repr, words.BENIGN_NUMBERS))})"),
    )
)


@query(f"WITH {_SENTENCES}, x AS (SELECT (id, pos) AS id, text FROM w), f AS ({_FOUND}) SELECT w.id AS l_orderkey, w.pos, coalesce(string_agg(replace(token, ',', '') || ':' || unit, '|' ORDER BY replace(token, ',', '') || ':' || unit), '') AS tokens FROM w LEFT JOIN f ON f.id = (w.id, w.pos) GROUP BY 1, 2")
def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each sentence with their unit: dates, ranks, amounts; bare and idle numbers are left out."""
    shown = F.transform(ground.quantities(F.col("text")), lambda q: F.concat(F.replace(q["token"], F.lit(","), F.lit("")), F.lit(":"), q["unit"]))
    return _sentences(spark, d).select(F.col("id").alias("l_orderkey"), "pos", F.array_join(F.array_sort(shown), "|").alias("tokens"))


_HAS = lambda x, terms: "(" + " OR ".join(f"contains({x}, '{y}')" for y in terms) + ")"
#: n(id, n, missing, major) of the scripts in a.
_NUMBERS = f"""x AS (SELECT id, script AS text FROM a), f AS ({_FOUND}), plain AS (SELECT id, article, replace(replace(article, ',', ''), ' ', '') AS plain FROM a),
g AS (SELECT f.*, article, plain, regexp_replace(num, '[^0-9]', '', 'g') AS digits, regexp_extract(token, '[0-9]+') AS r FROM f JOIN plain ON plain.id = f.id),
v AS (SELECT id, contains(article, token) OR contains(plain, replace(replace(token, ',', ''), ' ', '')) OR (replace(num, ' ', '') <> '' AND contains(plain, replace(num, ' ', ''))) OR (length(digits) >= 3 AND contains(plain, digits)) OR (kind = 'rank' AND CASE WHEN r = '1' THEN {_HAS('article', words.FIRST_RANK)} ELSE contains(plain, r || '위') OR contains(plain, r || '등') END) AS ok,
{_HAS('token', words.MAJOR_SCALES)} OR (contains(token, '만') AND {_HAS('token', words.MAJOR_UNITS)}) OR kind = 'rank' AS big FROM g),
m AS (SELECT id, count(*) AS n, count(*) FILTER (NOT ok) AS missing, count(*) FILTER (NOT ok AND big) AS major FROM v GROUP BY 1),
n2 AS (SELECT a.id, coalesce(n, 0) AS n, coalesce(missing, 0) AS missing, coalesce(major, 0) AS major, greatest(0, 10 - 3.0 * coalesce(major, 0) - 1.5 * (coalesce(missing, 0) - coalesce(major, 0)))::DOUBLE AS numbers FROM a LEFT JOIN m ON m.id = a.id)"""


@query(f"WITH {_TEXTS}, {_NUMBERS} SELECT id AS l_orderkey, n AS n_quantities, missing AS n_missing, major AS n_major, numbers AS score, major >= 2 AS critical FROM n2")
def number_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of a script that its article lacks."""
    j = _texts(spark, d).select("id", F.concat_ws("\n", "title", "content").alias("article"), ground.quantities(F.col("script")).alias("q"))
    j = j.withColumn("missing", F.filter("q", lambda x: ~ground.quantity_grounded(x, F.col("article"))))
    n = j.select(F.col("id").alias("l_orderkey"), F.size("q").cast("long").alias("n_quantities"), F.size("missing").cast("long").alias("n_missing"), F.size(F.filter("missing", ground.major_claim)).cast("long").alias("n_major"))
    return n.withColumn("score", s.number_fidelity(F.col("n_major"), F.col("n_missing") - F.col("n_major"))).withColumn("critical", F.col("n_major") >= 2)


# --- the whole check of a script ---

_TIMES = "((length({x}) - length(replace({x}, e, ''))) // length(e))"
_ARTISTS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(words.ARTISTS))
#: target(id, target): the first artist in the title, else the most frequent one of article and script's article, the first of equals.
_TARGET = f"""most AS (SELECT id, arg_max(e, n * 100 - o) AS e FROM (SELECT id, e, o, {_TIMES.format(x='{body}')} AS n FROM a, (VALUES {_ARTISTS}) AS v(o, e)) WHERE n > 0 GROUP BY 1),
target AS (SELECT a.id, coalesce(list_filter({_list(words.ARTISTS)}, lambda y: contains(title, y))[1], most.e) AS target FROM a LEFT JOIN most ON most.id = a.id)"""
_CALLED = "CASE target " + " ".join(f"WHEN '{k}' THEN {_list([*v, k])}" for k, v in words.ALIASES.items()) + " ELSE [target] END"
_MISS = lambda x, terms: f"len(list_filter({_list(terms)}, lambda y: contains({x}, y) AND NOT contains(article, y)))"
_NAMED = lambda x: f"len(list_filter({_CALLED}, lambda y: contains({x}, y))) > 0"
_SHORTS = "CASE WHEN {n} < 350 THEN 2 WHEN {n} < 400 THEN 1 WHEN {n} <= 550 THEN 0 ELSE 1 END"
_BLOGS = "CASE WHEN {n} < 1800 THEN 4 WHEN {n} < 2160 THEN 2 WHEN {n} <= 2900 THEN 0 ELSE 1 END"


@query(f"""WITH {_TEXTS}, {_TARGET.replace('{body}', 'article')}, {_NUMBERS},
p AS (SELECT a.id, target, {_NAMED('script')} AS named, len(list_filter({_list(words.ARTISTS)}, lambda y: y <> target AND contains(script, y) AND NOT contains(article, y))) > 0 AS others,
len(list_filter(list_transform(regexp_extract_all(script, '{_quoted(words.QUOTED)}', 1), lambda y: trim(y)), lambda y: length(y) >= 2 AND NOT contains(article, y))) AS quotes, {_MISS('script', words.PROGRAMS)} AS programs, {_MISS('script', words.CRITICAL_TERMS)} AS grave, {_MISS('script', words.CLICKBAIT)} AS bait,
length({_TRIM.format('script')}) AS n, blog IS NULL OR {_TRIM.format('blog')} = '' AS none FROM a JOIN target ON target.id = a.id),
b AS (SELECT a.id, coalesce(NOT {_NAMED('blog')}, FALSE) AND target IS NOT NULL AS unnamed, {_MISS('blog', words.CRITICAL_TERMS)} AS blog_grave, NOT (len(regexp_extract_all(blog, $${words.SECTION}$$)) >= 3 OR (length(blog) >= 500 AND contains(blog, chr(10) || chr(10)))) AS loose, length({_TRIM.format('blog')}) AS bn FROM a JOIN target ON target.id = a.id WHERE blog IS NOT NULL),
e AS (SELECT p.*, CASE WHEN target IS NULL THEN 8 ELSE greatest(0, CASE WHEN others AND NOT named THEN 0 WHEN others THEN 5 WHEN NOT named THEN 4 ELSE 8 END - quotes - 1.5 * programs) END::DOUBLE AS entity, greatest(0, 8 - 4 * grave - 2 * bait)::DOUBLE AS terms,
CASE WHEN none THEN 4 ELSE greatest(0, 4 - CASE WHEN unnamed THEN 1.5 ELSE 0 END - 2 * blog_grave - loose::INT - {_BLOGS.format(n='bn')}) END::DOUBLE AS blog, (target IS NOT NULL AND others AND NOT named) OR grave > 0 OR (NOT none AND blog_grave > 0) AS fatal FROM p LEFT JOIN b ON b.id = p.id),
z AS (SELECT e.*, numbers, major, greatest(0, least(30, entity + numbers + terms + blog - {_SHORTS.format(n='e.n')}))::DOUBLE AS total FROM e JOIN n2 ON n2.id = e.id)
SELECT id AS l_orderkey, target AS artist, entity, numbers, terms, blog, total, fatal OR major >= 2 OR total < 15 AS critical, total >= 21 AND NOT (fatal OR major >= 2 OR total < 15) AS passed FROM z""")
def factual_total(spark: SparkSession, d: str) -> DataFrame:
    """The whole check of a script and its blog against the article, with the real word lists."""
    none, script, blog, article = F.lit(None).cast("string"), F.col("script"), F.col("blog"), F.concat_ws("\n", "title", "content")
    told = [*words.ARTISTS, *words.PROGRAMS, *words.CRITICAL_TERMS, *words.CLICKBAIT]
    x = _texts(spark, d).select("*", once(article.alias("article"), ground.squeezed(article).alias("plain")))
    x = x.select("*", scan.terms_held(F.col("article"), words.ARTISTS).alias("artists"))
    x = x.select("*", once(ground.target_artist(F.col("title"), none, F.col("artists")).alias("target"))).select("*", once(ground.names_of(F.col("target")).alias("names")))
    x = x.select("*", scan.terms_held(script, told).alias("script_terms"), scan.terms_held(blog, words.CRITICAL_TERMS).alias("blog_terms"), *[scan.any_held(F.col(c), F.col("names")).alias(f"{c}_named") for c in ("script", "blog")], *[scan.stripped_length(F.col(c)).alias(f"{c}_length") for c in ("script", "blog")],
        scan.all_matches(script, words.DATE, [0], starts=r"\d").alias("dates"), scan.all_matches(script, words.RANK, [0, 1], starts=r"\dTt").alias("ranks"), scan.all_matches(script, words.AMOUNT, [0, 1, 2, 3], starts=r"\d").alias("amounts"),
        scan.all_matches(script, words.QUOTED, [1], distinct=False).alias("quotes"), F.coalesce(scan.match_number(blog, words.SECTION), F.lit(0)).alias("sections"))
    x = x.select("*", once(ground.quantities_of(F.col("dates"), F.col("ranks"), F.col("amounts")).alias("q")))
    missing = F.filter("q", lambda q: ~ground.quantity_grounded(q, F.col("article"), F.col("plain")))
    seen = {"script": F.col("script_terms.term"), "blog": F.col("blog_terms.term"), "quotes": F.flatten("quotes"), **{c: F.col(c) for c in ("sections", "script_named", "blog_named", "script_length", "blog_length")}}
    x = x.select("*", once(missing.alias("missing")))
    parts = ground.fact_parts(F.col("title"), F.col("content"), script, blog, none, target=F.col("target"), missing=F.col("missing"), seen=seen)
    return x.select(F.col("id").alias("l_orderkey"), once(parts.alias("p"))).select("l_orderkey", ground.fact_total(F.col("p")).alias("c")).select("l_orderkey", "c.*")


@query(f"""WITH {_TEXTS}, {_TARGET.replace('{body}', "title || chr(10) || script")}
SELECT a.id AS l_orderkey, CASE WHEN a.id % 5 = 4 THEN '송가인' ELSE coalesce(target, regexp_extract(left(script, 80), '^([가-힣]{{2,4}})(?:이|가|의|은|는)?\\s*(?:가수|콘서트|신곡|무대|소속사)', 1), '') END AS singer FROM a JOIN target ON target.id = a.id""")
def detected_singer(spark: SparkSession, d: str) -> DataFrame:
    """The name given, else the first artist in the title, else the most frequent one, else a name at the opening, else an empty text."""
    x, given = _texts(spark, d), F.when(F.col("id") % 5 == 4, " 송가인 ").when(F.col("id") % 5 == 3, "  ")
    singer = F.coalesce(ground.detected_artist(F.col("title"), F.col("script"), given), sel.name_by_opening(F.col("script")), F.lit(""))
    return x.select(F.col("id").alias("l_orderkey"), singer.alias("singer"))


# --- scenes ---

#: The patterns without what RE2 lacks (a look ahead, word boundaries of Korean), and the single words that then count by themselves.
_PLAIN = {c: p.replace(r"(?![가-힣])", r"(?:[^가-힣]|$)").replace(r"|\b팬\b", "").replace(r"|\bSNS\b", "").replace(r"|(?:\bCF\b)", "") for c, p in words.CATEGORY_PATTERNS.items()}
_ALONE = {"audience": "팬", "smartphone": "SNS", "business": "CF"}


def _count_sql(x: str, c: str) -> str:
    n = f"len(list_distinct(list_transform(regexp_extract_all({x}, $$(?i){_PLAIN[c]}$$), lambda y: regexp_replace(y, '[^가-힣0-9]$', ''))))"
    return n + (f" + regexp_matches({x}, '(?i)(^|[^가-힣a-zA-Z0-9_]){_ALONE[c]}([^가-힣a-zA-Z0-9_]|$)')::BIGINT" if c in _ALONE else "")


def _categories_sql(rows: str) -> str:
    """Of rows(id, pos, text): id, pos, category, o, n, w for each category that a sentence has."""
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, pos, '{c}' AS category, {o} AS o, {_count_sql('text', c)} AS n, {words.CATEGORY_WEIGHTS[c]}::DOUBLE AS w FROM {rows}" for o, c in enumerate(words.CATEGORY_PATTERNS)) + ") WHERE n > 0"


@query(f"WITH {_SENTENCES}, c AS ({_categories_sql('w')}) SELECT w.id AS l_orderkey, w.pos, arg_max(category, (n * c.w, -o)) AS category FROM w LEFT JOIN c ON c.id = w.id AND c.pos = w.pos GROUP BY 1, 2")
def sentence_category(spark: SparkSession, d: str) -> DataFrame:
    """The category of each sentence by the real patterns and weights; nothing without a keyword."""
    return _sentences(spark, d).select(F.col("id").alias("l_orderkey"), "pos", ground.best_category(F.col("text")).alias("category"))


def exact_sql(x: str, places: int) -> str:
    """SQL of ``exact_round``: the same steps in doubles."""
    ten = float(10**places)
    high = 134217729.0 * ten - (134217729.0 * ten - ten)
    steps = f"(SELECT (fl + CASE WHEN b > 0 THEN 1 WHEN b < 0 THEN 0 ELSE fl % 2 END) / {ten}::DOUBLE FROM (SELECT fl, (p - fl - 0.5::DOUBLE) + (((h * {high}::DOUBLE - p) + h * {ten - high}::DOUBLE + l * {high}::DOUBLE) + l * {ten - high}::DOUBLE) AS b FROM (SELECT *, floor(p) AS fl, x - h AS l FROM (SELECT x, x * {ten}::DOUBLE AS p, x * 134217729::DOUBLE - (x * 134217729::DOUBLE - x) AS h FROM (SELECT ({x})::DOUBLE AS x)))))"
    return steps


_SENT = "list_filter(flatten(list_transform(list_filter(list_transform(string_split(script, chr(10)), lambda l: trim(l)), lambda l: l <> ''), lambda l: list_transform(regexp_extract_all(l, '[^.?!~]+(?:[.?!~]+|$)'), lambda y: trim(y)))), lambda y: y <> '')"
FALLBACKS = ["audience", "concert", "emotion"]


@query(f"""WITH {_TEXTS}, sl AS (SELECT id, {_SENT} AS l FROM a), sc AS (SELECT id, pos, l[pos] AS text FROM sl, unnest(range(2, len(l) + 1)) AS g(pos)),
size AS (SELECT id, len(l) * 2.8::DOUBLE AS total, len(l) AS scenes, CASE WHEN len(l) * 2.8::DOUBLE >= 45 THEN 34.0::DOUBLE ELSE greatest(5.6::DOUBLE, len(l) * 2.8::DOUBLE * 0.55::DOUBLE) END AS ideal FROM sl),
mid AS (SELECT *, greatest(0, least(scenes - 1, round_even(ideal / 2.8::DOUBLE, 0)::BIGINT)) + 1 AS mid FROM size),
c AS ({_categories_sql('sc')}), r AS (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY n * w DESC, o) = 1 AS best FROM c),
y AS (SELECT r.*, total, ideal, {exact_sql('(pos - 1) * 2.8::DOUBLE', 2)} AS start FROM r JOIN mid ON mid.id = r.id),
z AS (SELECT *, CASE WHEN start BETWEEN 28 AND 42 THEN near + 0.35::DOUBLE WHEN start < 10 THEN near * 0.4::DOUBLE ELSE near END AS fit FROM (SELECT *, greatest(0.2::DOUBLE, 1 - abs(start - ideal) / greatest(15.0::DOUBLE, total)) AS near FROM y)),
k AS (SELECT id, category, pos, best, o, {exact_sql("CASE WHEN best THEN (n * 1.2::DOUBLE + w) * fit ELSE (n * 0.8::DOUBLE + w) * fit * 0.85::DOUBLE END", 3)} AS score FROM z),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id, category ORDER BY score DESC, pos) = 1),
first AS (SELECT id, category, pos AS scene_index, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos, NOT best, o) AS place FROM u),
have AS (SELECT mid.id, mid, count(category) AS n, coalesce(list(category) FILTER (category IS NOT NULL), []) AS cats FROM mid LEFT JOIN first ON first.id = mid.id GROUP BY 1, 2),
pad AS (SELECT id, category, mid AS scene_index, CASE WHEN n > 0 THEN 0.5 WHEN category = 'audience' THEN 1.0 ELSE 0.85::DOUBLE END AS score, n + row_number() OVER (PARTITION BY id ORDER BY f) AS place, n FROM have, (VALUES (1, 'audience'), (2, 'concert'), (3, 'emotion')) AS v(f, category) WHERE NOT list_contains(cats, category))
SELECT id AS l_orderkey, place, category, scene_index, score::DOUBLE AS score FROM (SELECT id, place, category, scene_index, score FROM first UNION ALL SELECT id, place, category, scene_index, score FROM pad WHERE place <= CASE WHEN n = 0 THEN 2 ELSE 3 END)""")
def scene_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each script for the clip in the middle, the first being the choice: categories by their best scene, and
    where they are fewer than three the usual ones at the middle scene."""
    x = _texts(spark, d).select("id", t.sentences(F.col("script")).alias("l"))
    total = F.size("l") * F.lit(2.8)
    ideal = s.ideal_time(total)
    mid = F.greatest(F.lit(0), F.least(F.size("l") - 1, F.bround(ideal / 2.8, 0).cast("int"))) + 1
    at = s.exact_round(F.col("i") * F.lit(2.8), 2)
    shots = x.select("id", total.alias("total"), ideal.alias("ideal"), mid.alias("mid"), scan.match_counts(F.col("l"), list(words.CATEGORY_PATTERNS.values())).alias("shots"))
    # the first sentence has no shot of its own; a script without any keeps its row
    found = shots.select("id", "total", "ideal", "mid", F.explode_outer(F.filter("shots", lambda c: c["i"] > 0)).alias("s")).select("id", "total", "ideal", "mid", F.col("s.i").alias("i"), F.col("s.n").alias("n"))
    found = found.select("id", "total", "ideal", "mid", "i", at.alias("at"), F.array(*[F.struct((F.col("n")[o] * w).alias("worth"), F.lit(-1 - o).cast("long").alias("o"), F.lit(c).alias("category"), F.col("n")[o].alias("n"), F.lit(w).alias("w")) for o, (c, w) in enumerate((c, words.CATEGORY_WEIGHTS[c]) for c in words.CATEGORY_PATTERNS)]).alias("found"))
    # -o is the greater, the earlier a category stands in the dictionary
    numbered = F.filter("found", lambda c: c["n"] > 0)
    ranked = found.select("id", "total", "ideal", "mid", "i", "at", F.sort_array(numbered, asc=False).alias("found"))
    fit = s.timing(F.col("at"), F.col("ideal"), F.col("total"))
    weight = F.element_at(F.create_map(*[F.lit(v) for kv in words.CATEGORY_WEIGHTS.items() for v in kv]), F.col("c.category"))
    score = F.when(F.col("p") == 0, (F.col("c.n") * 1.2 + weight) * fit).otherwise((F.col("c.n") * 0.8 + weight) * fit * 0.85)
    each = ranked.select("id", "mid", "i", "at", "ideal", "total", F.posexplode_outer("found").alias("p", "c")).select("id", "mid", F.col("c.category").alias("category"), F.struct(s.exact_round(score, 3).alias("score"), (-F.col("i") - 1).alias("at"), (F.col("p") == 0).alias("best"), F.col("c.o").alias("o")).alias("b"))
    best = each.groupBy("id", "mid", "category").agg(F.max("b").alias("b"))  # of equal scores the earliest scene
    bag = F.sort_array(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("b.score", "b.at", "b.best", "b.o", "category"))), asc=False)
    listed = best.groupBy("id", "mid").agg(bag.alias("l"))
    have = F.transform("l", lambda c: F.struct(c["category"].alias("category"), (-c["at"]).alias("scene_index"), c["score"].alias("score")))
    n = F.size("l")
    lacking = F.filter(F.array(*map(F.lit, FALLBACKS)), lambda f: ~F.exists("l", lambda c: c["category"] == f))
    added = F.slice(lacking, F.lit(1), F.greatest(F.lit(0), F.when(n == 0, 2).otherwise(3 - n)))
    usual = F.transform(added, lambda f: F.struct(f.alias("category"), F.col("mid").alias("scene_index"), F.when(n > 0, 0.5).when(f == "audience", 1.0).otherwise(0.85).alias("score")))
    out = listed.select("id", F.posexplode(F.concat(have, usual)).alias("p", "c"))
    return out.select(F.col("id").alias("l_orderkey"), (F.col("p") + 1).cast("long").alias("place"), "c.category", F.col("c.scene_index").cast("long").alias("scene_index"), "c.score")


# --- lines of an article ---

JUNK = ["짧은 줄", "본문 바로가기 메뉴를 눌러 주세요", "문의는 press{k}@news.co.kr 으로 보내 주세요", "무단 전재 및 재배포 금지 {k}", "▶ 관련 기사 {k} 더 보러 가기", "기자 = 홍길동 {k}", "※ 안내 말씀 {k} 드립니다 여러분"]
_LINE = f"CASE WHEN k % 3 = 0 THEN replace({_list(JUNK)}[1 + s % {len(JUNK)}], '{{k}}', k::VARCHAR) ELSE text END"
_RULES = " OR ".join([*[f"contains(y, '{x}')" for x in [*words.LINE_JUNK, *words.LINE_RIGHTS]], *[f"starts_with(y, '{x}')" for x in words.LINE_STARTS], f"regexp_matches(y, '{words.EMAIL}')"])


@query(f"WITH {_SENTENCES}, l AS (SELECT id, list(trim(line) ORDER BY pos) AS l FROM (SELECT id, pos, {_LINE} AS line FROM w) GROUP BY 1) SELECT id AS l_orderkey, array_to_string(list_filter(l, lambda y: length(y) >= 10 AND NOT ({_RULES})), '|') AS text FROM l")
def article_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an article without menus, addresses, rights and marks."""
    junk = F.replace(F.element_at(F.array(*map(F.lit, JUNK)), (F.col("s") % len(JUNK) + 1).cast("int")), F.lit("{k}"), F.col("k").cast("string"))
    line = F.when(F.col("k") % 3 == 0, junk).otherwise(F.col("text"))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: F.concat(F.lit(" "), x["line"])), "\n \n")
    return _sentences(spark, d).groupBy(F.col("id").alias("l_orderkey")).agg(page.alias("page")).select("l_orderkey", F.array_join(ground.article_lines(F.col("page")), "|").alias("text"))


# --- replies of a reviewer and the repairs of issues ---

STATUSES = ["PASS", "warning", "FAIL", "odd", ""]
_FIELDS = "e AS (SELECT event_id, round(value, 1) - 20 AS v, event_id % 5 AS st, event_id % 3 AS issues, event_id % 11 = 0 AS fatal, event_id % 13 = 0 AS severe, event_id % 17 = 0 AS unscored, event_id % 6 AS wrap, event_id % 4 AS advice FROM events)"


@query(f"""WITH {_FIELDS}, r AS (SELECT *, CASE WHEN wrap = 5 OR unscored THEN NULL ELSE greatest(0, least(25, v)) END::DOUBLE AS sc, issues + severe::INT AS n, upper({_list(STATUSES)}[1 + st]) AS said FROM e)
SELECT event_id, {exact_sql('CASE WHEN (severe OR fatal) AND sc > 15 THEN 14.5 ELSE sc END', 1)} AS score, CASE WHEN sc IS NULL THEN 'AI_QA_NOT_RUN' WHEN severe OR fatal THEN 'FAIL' WHEN n = 0 AND sc >= 20 THEN 'PASS' WHEN said IN ('PASS', 'WARNING', 'FAIL') THEN said WHEN sc >= 20 THEN 'PASS' WHEN sc >= 15 THEN 'WARNING' ELSE 'FAIL' END AS status,
sc IS NULL AS not_run, sc IS NOT NULL AND fatal AS critical, CASE WHEN sc IS NULL THEN 0 ELSE n END::INT AS n_issues, CASE WHEN sc IS NULL THEN 0 ELSE advice END::INT AS n_recommendations FROM r""")
def review_replies(spark: SparkSession, d: str) -> DataFrame:
    """A reviewer's replies made safe: scores out of bounds or as texts, fences, lists, prose, broken ones, blank issues, and faults that fail it."""
    e = F.col("event_id")
    v = F.round("value", 1) - 20
    blank = F.struct(F.lit("note").alias("type"), F.lit("low").alias("severity"), F.lit(" ").alias("message"), F.lit("").alias("evidence"))
    issue = F.struct(F.lit("note").alias("type"), F.lit("low").alias("severity"), F.lit("").alias("message"), F.lit("seen").alias("evidence"))
    error = F.struct(F.lit("x").alias("type"), F.when(e % 2 == 0, "HIGH").otherwise("high").alias("severity"), F.lit("why").alias("message"), F.lit("").alias("evidence"))
    issues = F.concat(F.array(blank), F.array_repeat(issue, (e % 3).cast("int")), F.when(e % 13 == 0, F.array(error)).otherwise(F.slice(F.array(error), 1, 0)))
    score = F.when(e % 17 != 0, F.when(e % 2 == 0, v.cast("string")).otherwise(F.concat(F.lit(" "), v.cast("string"))))
    fields = F.struct(score.alias("score"), F.element_at(F.array(*map(F.lit, STATUSES)), (e % 5 + 1).cast("int")).alias("status"), (e % 11 == 0).alias("critical_error"), issues.alias("issues"), F.concat(F.array(F.lit(" ")), F.array_repeat(F.lit("do"), (e % 4).cast("int"))).alias("recommendations"))
    j, wrap = F.to_json(fields), e % 6
    raw = F.when(wrap == 0, j).when(wrap == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(wrap == 2, F.concat(F.lit("Result: "), j, F.lit(" done"))).when(wrap == 3, F.concat(F.lit("["), j, F.lit(', {"score": 1}]'))).when(wrap == 4, F.concat(F.lit(" \n"), j)).otherwise(F.concat(F.lit("{"), j))
    replies = load(spark, d, "events").select("event_id", once(raw.alias("raw"))).select("event_id", once(t.lenient_json(F.col("raw")).alias("json")))
    return replies.select("event_id", once(ground.reviewed_object(F.col("json")).alias("r"))).select("event_id", "r.*")


TYPES = ["ai_qa_not_run", "blog_length_issue", "shorts_length_issue", "tts_sync_issue", "photo_repetition", "caption_overflow"]
ACTIONS = ["", "rerun_ai_qa", "grow_blog", "rephrase_script", "tts_sync_fix", "resize", None]
COMPONENTS = ["ai_review", "technical", "factual", "repetition"]
_PICK = lambda values, x: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][1 + ({x}) % {len(values)}]"


@query(f"""WITH i AS (SELECT event_id, {_PICK(TYPES, 'event_id + user_id')} AS kind, coalesce({_PICK(ACTIONS, 'event_id')}, '') AS action, {_PICK(COMPONENTS, 'user_id')} AS component FROM events)
SELECT event_id, CASE WHEN kind = 'ai_qa_not_run' OR action = 'rerun_ai_qa' OR component = 'ai_review' THEN 'rerun_review' WHEN kind = 'blog_length_issue' OR contains(action, 'blog') THEN 'extend_blog' WHEN kind = 'shorts_length_issue' OR action = 'rephrase_script' THEN 'shorten_script' WHEN kind = 'tts_sync_issue' OR action = 'tts_sync_fix' THEN 'resync_script' END AS repair FROM i""")
def repair_route(spark: SparkSession, d: str) -> DataFrame:
    """The repair of issues of all types, with all actions, from all components."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (i % len(values) + 1).cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    return load(spark, d, "events").select("event_id", m.repair(pick(TYPES, e + u), pick(ACTIONS, e), pick(COMPONENTS, u)).alias("repair"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {exact_sql('l_extendedprice * l_discount / 3', 2)} AS cents, {exact_sql('l_quantity * 0.125::DOUBLE', 2)} AS ties, {exact_sql('l_extendedprice * l_tax', 1)} AS tenths FROM lineitem")
def exact_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Products rounded half to even by their exact binary values."""
    x = F.col("l_extendedprice")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", s.exact_round(x * F.col("l_discount") / 3, 2).alias("cents"), s.exact_round(F.col("l_quantity") * 0.125, 2).alias("ties"), s.exact_round(x * F.col("l_tax"), 1).alias("tenths"))


# --- files: subtitles, lines of JSON, other charsets ---

_MS = "(turn * 2500 + 120 * (conv_id % 7))"
_CUE = "regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '^[ \t\r]+|[ \t\r]+$', '', 'g')"


@query(f"SELECT conv_id, count(*) AS cues, count(*) FILTER (turn % 3 = 0) AS stacked, max(length({_CUE}) + CASE WHEN turn % 3 = 0 THEN 5 ELSE 0 END)::BIGINT AS longest, min({_MS}) / 1000 AS starts, (max({_MS}) + 1900) / 1000 AS ends FROM conversations WHERE {_CUE} <> '' GROUP BY 1")
def subtitle_files(spark: SparkSession, d: str) -> DataFrame:
    """A subtitle file for each conversation, written, read again and parsed: a turn's first line is a cue."""
    start = F.col("turn") * 2500 + 120 * (F.col("conv_id") % 7)
    first = F.regexp_replace(F.split(F.coalesce("text", F.lit("")), "\n")[0], r"^[ \t\r]+|[ \t\r]+$", "")
    said = load(spark, d, "conversations").select("conv_id", "turn", start.alias("start"), first.alias("said")).filter("said <> ''")
    clock = lambda ms: t.srt_time(ms / 1000)
    block = F.concat(F.lit("\n"), clock(F.col("start")), F.lit(" --> "), clock(F.col("start") + 1900), F.lit("\n"), "said", F.when(F.col("turn") % 3 == 0, "\n<i>more</i>").otherwise(""))
    cues = F.array_sort(F.collect_list(F.struct("turn", "start", block.alias("block"))))
    srt = F.array_join(F.transform("c", lambda x, i: F.concat((i + 1).cast("string"), x["block"])), "\n\n")
    home = scratch_folder(spark, "subtitles")
    write_files(said.groupBy("conv_id").agg(cues.alias("c")).select("conv_id", srt.alias("srt")), home, name="conv_id", text="srt")
    read = read_files(spark, home, "conv_id").select(F.col("conv_id").cast("long").alias("conv_id"), "text")
    times = F.transform(F.regexp_extract_all("text", F.lit(r"(\d+:\d+:\d+,\d+) --> (\d+:\d+:\d+,\d+)"), 1), t.parse_srt_time)
    ends = F.transform(F.regexp_extract_all("text", F.lit(r"(\d+:\d+:\d+,\d+) --> (\d+:\d+:\d+,\d+)"), 2), t.parse_srt_time)
    found = read.select("conv_id", once(m.cues(F.col("text")).alias("c"), times.alias("s"), ends.alias("e")))
    return found.select("conv_id", F.size("c").cast("long").alias("cues"), F.size(F.filter("c", lambda x: x["stacked"])).cast("long").alias("stacked"), F.array_max(F.transform("c", lambda x: F.length(x["text"]))).cast("long").alias("longest"), F.array_min("s").alias("starts"), F.array_max("e").alias("ends"))


@query("SELECT event_id, event_type AS kind, value FROM events WHERE event_id % 7 < 5")
def json_line_file(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of JSON, written and read again; blank lines and broken ones, two of seven, are skipped."""
    e = load(spark, d, "events")
    line = F.when(F.col("event_id") % 7 == 5, " ").when(F.col("event_id") % 7 == 6, '{"event_id": broken').otherwise(F.concat(F.lit("  "), F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), "value"))))
    home = scratch_folder(spark, "lines")
    write_lines(e.select(line.alias("line")), "line", home)
    return json_lines(spark.read.text(home), "value", "event_id bigint, kind string, value double")


_BYTES = "CASE WHEN (k + pos) % 5 = 3 THEN '<meta charset=euc-kr> ' || text ELSE text END"


@query(f"WITH {_SENTENCES} SELECT id AS l_orderkey, pos, CASE WHEN (k + pos) % 5 = 4 THEN chr(65533) || ' plain ' || k ELSE {_BYTES} END AS text FROM w")
def charset_texts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences in UTF-8, in both Korean charsets, with a declared one, and broken ones, as bytes and back."""
    import pyarrow as pa

    kind = (F.col("k") + F.col("pos")) % 5
    text = F.when(kind == 4, F.concat(F.lit("plain "), F.col("k").cast("string"))).when(kind == 3, F.concat(F.lit("<meta charset=euc-kr> "), "text")).otherwise(F.col("text"))

    def encode(batches):
        for b in batches:
            raw = [b"\xff " + x.encode() if n == 4 else x.encode(("utf-8", "euc-kr", "cp949", "euc-kr")[n]) for x, n in zip(b.column("text").to_pylist(), b.column("kind").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("l_orderkey"), b.column("pos"), pa.array(raw, pa.binary())], ["l_orderkey", "pos", "raw"])

    raw = _sentences(spark, d).select(F.col("id").alias("l_orderkey"), "pos", kind.cast("int").alias("kind"), text.alias("text")).mapInArrow(encode, "l_orderkey bigint, pos bigint, raw binary")
    return decode_text(raw, "raw").select("l_orderkey", "pos", "text")
