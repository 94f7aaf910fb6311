"""Text, scoring, timeline and selection queries on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import dictionaries as words
from loomwork.functions import grounding as ground
from loomwork.functions import scoring as s
from loomwork.functions import text as t
from loomwork.functions.article import news_articles
from loomwork.operators.catalogue import padded, round_robin
from loomwork.operators.terms import contained_terms
from loomwork.sources.tables import load, spread

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


_TOK = "list_distinct(list_transform(regexp_extract_all({}, '[가-힣a-zA-Z0-9]+'), lambda x: lower(x)))"
_PAIRS = "SELECT a.conv_id, a.turn, a.text AS x, b.text AS y, b.turn AS past FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 5 AND a.turn - 1"


@query(f"SELECT conv_id, turn, past, len(list_intersect(u, v))::BIGINT AS common, len(list_distinct(list_concat(u, v)))::BIGINT AS everything FROM (SELECT conv_id, turn, past, {_TOK.format('x')} AS u, {_TOK.format('y')} AS v FROM ({_PAIRS}))")
def tokens_jaccard(spark: SparkSession, d: str) -> DataFrame:
    p = _turn_pairs(spark, d, t.tokens)
    return p.select("conv_id", "turn", "past", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), F.size(F.array_union("x", "y")).cast("long").alias("everything"))


def _turn_pairs(spark: SparkSession, d: str, f) -> DataFrame:
    """Each turn with the five before it: an equi-join on the turn, so a long conversation gives no square of pairs."""
    c = load(spark, d, "conversations").select("conv_id", "turn", f(F.coalesce("text", F.lit(""))).alias("v"))
    back = F.explode(F.sequence(F.col("turn") - 5, F.col("turn") - 1))
    return c.select("conv_id", "turn", F.col("v").alias("x"), back.alias("past")).join(c.select("conv_id", F.col("turn").alias("past"), F.col("v").alias("y")), ["conv_id", "past"])


_LINE = "trim(list_filter(string_split({}, chr(10)), lambda l: trim(l) <> '')[1])"
_HOOK = f"CASE WHEN regexp_matches({_LINE}, '[.?!]\\s') THEN regexp_extract({_LINE}, '^(.*?[.?!])\\s', 1) ELSE {_LINE} END"


@query(f"""WITH h AS (SELECT conv_id, turn, past, {_TOK.format(_HOOK.replace('{}', 'x'))} AS u, {_TOK.format(_HOOK.replace('{}', 'y'))} AS v FROM ({_PAIRS})),
j AS (SELECT conv_id, turn, past, CASE WHEN len(u) > 0 AND len(v) > 0 THEN len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) ELSE 0 END AS sim FROM h),
m AS (SELECT conv_id, turn, round_even(max(sim), 3) AS best, arg_max(past, (sim, past)) FILTER (sim > 0) AS most_similar FROM j GROUP BY 1, 2)
SELECT conv_id, turn, best, most_similar, CASE WHEN best >= 0.85 THEN 5.0::DOUBLE WHEN best > 0.7 THEN 4.0 WHEN best >= 0.5 THEN 1.5 ELSE 0.0 END AS deduction FROM m""")
def hook_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The most similar of the five hooks before, the newest of equals, none without a common word; rounded before the bands."""
    p = _turn_pairs(spark, d, lambda x: t.tokens(t.hook(x)))
    sim = t.word_jaccard(F.col("x"), F.col("y"))
    g = p.groupBy("conv_id", "turn").agg(F.max(F.struct(sim.alias("sim"), "past")).alias("m"))
    best = F.bround(F.col("m.sim"), 3)
    return g.select("conv_id", "turn", best.alias("best"), F.when(F.col("m.sim") > 0, F.col("m.past")).alias("most_similar"), s.hook_penalty(best).alias("deduction"))


_SENT = "list_filter(flatten(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), lambda l: list_transform(regexp_extract_all(l, '[^.?!~]+(?:[.?!~]+|$)'), lambda x: trim(x)))), lambda x: x <> '')"


@query(f"SELECT doc_id, i::BIGINT AS scene_index, s[i] AS sentence FROM (SELECT doc_id, {_SENT} AS s FROM documents), unnest(range(1, len(s) + 1)) AS g(i)")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return spread(_docs(spark, d)).select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).cast("long").alias("scene_index"), "sentence")


#: Category, pattern and weight, in the order that breaks ties.
CATEGORIES = [("arrival", "(?:the|der|les)", 1.0), ("crowd", "(?:and|und|que)", 1.5), ("stage", "(?:tion|ing|keit)", 1.2), ("award", "(?:for|als|para)", 2.0)]
_CASE = " UNION ALL ".join(f"SELECT doc_id, scene_index, sentence, {i} AS o, '{n}' AS category, len(list_distinct(regexp_extract_all(sentence, '(?i){p}')))::BIGINT AS n, {w}::DOUBLE AS w FROM b" for i, (n, p, w) in enumerate(CATEGORIES))
SCENE_SQL = f"""WITH b AS ({ORACLES['sentence_split']}), m AS ({_CASE}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scene_index ORDER BY n * w DESC, o) rn FROM m WHERE n > 0)
SELECT doc_id, scene_index, category, n, (scene_index - 1) * 28 AS start_tenths, scene_index * 28 AS end_tenths FROM r WHERE rn = 1 AND scene_index > 1"""


@query(SCENE_SQL)
def scene_plan(spark: SparkSession, d: str) -> DataFrame:
    """Sentences tiled every 2.8 s; the category with most weighted matches wins, the first on ties; the first scene stays a photo."""
    return _scenes(spark, d).filter("scene_index > 1").select("doc_id", "scene_index", "category", "n", ((F.col("scene_index") - 1) * 28).alias("start_tenths"), (F.col("scene_index") * 28).alias("end_tenths"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Each sentence with all categories: struct<score, o, n, category, w>; of equal scores the first category is the greatest."""
    counts = F.array(*[F.struct(F.size(t.matches(F.col("sentence"), p)).cast("long").alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("category"), F.lit(w).alias("w")) for i, (c, p, w) in enumerate(CATEGORIES)])
    scored = F.transform(counts, lambda x: F.struct((x["n"] * x["w"]).alias("score"), x["o"].alias("o"), x["n"].alias("n"), x["category"].alias("category"), x["w"].alias("w")))
    return sentence_split(spark, d).select("doc_id", "scene_index", scored.alias("scored"))


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    # an explode in place of a filter: a pushed filter would match every pattern once more
    best = F.explode(F.filter(F.array(F.array_max("scored")), lambda m: m["n"] > 0))
    return _scored(spark, d).select("doc_id", "scene_index", best.alias("m")).select("doc_id", "scene_index", "m.category", "m.n", "m.w")


@query(f"""WITH b AS ({ORACLES['sentence_split']}), m AS ({_CASE}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scene_index ORDER BY n * w DESC, o) rn FROM m WHERE n > 0),
x AS (SELECT doc_id, 2.8::DOUBLE * max(scene_index) AS total, CASE WHEN 2.8::DOUBLE * max(scene_index) >= 45 THEN 34.0 ELSE greatest(5.6, 2.8::DOUBLE * max(scene_index) * 0.55::DOUBLE) END AS ideal FROM b GROUP BY 1),
y AS (SELECT r.*, rn = 1 AS best, round_even((scene_index - 1) * 2.8::DOUBLE, 2) AS t, total::DOUBLE AS total, ideal::DOUBLE AS ideal FROM r JOIN x ON r.doc_id = x.doc_id WHERE scene_index > 1),
f AS (SELECT *, greatest(0.2::DOUBLE, 1 - abs(t - ideal) / greatest(15.0::DOUBLE, total)) AS near FROM y),
k AS (SELECT *, floor((n * CASE WHEN best THEN 1.2::DOUBLE ELSE 0.8 END + w) * CASE WHEN t BETWEEN 28 AND 42 THEN near + 0.35::DOUBLE WHEN t < 10 THEN near * 0.4::DOUBLE ELSE near END * CASE WHEN best THEN 1 ELSE 0.85::DOUBLE END * 1000 + 0.5) / 1000 AS score FROM f)
SELECT doc_id, category, scene_index, n, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY score DESC, scene_index) AS p FROM k) WHERE p = 1""")
def primary_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Of each category the scene of the greatest score: a sentence's best category and, for less, its others."""
    every = _scored(spark, d).select("doc_id", "scene_index", F.array_max("scored").alias("top"), F.explode(F.filter("scored", lambda m: m["n"] > 0)).alias("m"))
    last = sentence_split(spark, d).groupBy("doc_id").agg(F.max("scene_index").alias("scenes"))
    at, total = F.bround((F.col("scene_index") - 1) * F.lit(2.8), 2), F.col("scenes") * F.lit(2.8)
    of = lambda f: f(F.col("m.n"), F.col("m.w"), at, s.ideal_time(total), total)
    score = F.floor(F.when(F.col("m.o") == F.col("top.o"), of(s.candidate_score)).otherwise(of(s.secondary_score)) * 1000 + 0.5) / 1000
    k = every.filter("scene_index > 1").join(last, "doc_id").select("doc_id", "scene_index", "m.category", "m.n", score.alias("score"))
    best = k.groupBy("doc_id", "category").agg(F.max(F.struct("score", (-F.col("scene_index")).alias("o"), "n")).alias("b"))
    return best.select("doc_id", "category", (-F.col("b.o")).alias("scene_index"), "b.n", "b.score")


ENTITIES = ["the", "that", "les", "der", "que", "para", "und"]
_TITLE = "string_split(text, chr(10))[1]"
_COUNT = "((length({x}) - length(replace({x}, '{e}', ''))) // length('{e}'))"
_ENT = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{e}' AS entity, 10 * {_COUNT.format(x=_TITLE, e=e)} + {_COUNT.format(x='text', e=e)} AS score FROM documents" for i, e in enumerate(ENTITIES))


@query(f"SELECT doc_id, entity, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) rn FROM ({_ENT}) WHERE score > 0) WHERE rn = 1")
def entity_detect_weighted(spark: SparkSession, d: str) -> DataFrame:
    """10 for each occurrence in the title (the first line), 1 in the whole; the first of equals in list order."""
    title = F.element_at(F.split("text", "\n"), 1)
    each = F.array(*[F.struct((t.count_of(title, F.lit(e)) * 10 + t.count_of(F.col("text"), F.lit(e))).alias("score"), F.lit(-i).alias("o"), F.lit(e).alias("entity")) for i, e in enumerate(ENTITIES)])
    # an explode in place of a filter: a pushed filter would count every name once more
    best = F.explode(F.filter(F.array(F.array_max(each)), lambda m: m["score"] > 0))
    return _docs(spark, d).select("doc_id", best.alias("m")).select("doc_id", "m.entity", "m.score")


TERMS, BAIT = ["worthless", "pathetic", "stupid", "idiot"], ["!!", "$$$", "***"]
#: Each document beside the article that its id falls on, of all articles.
_PAIRED = "SELECT d.doc_id, d.text, b.text AS article FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"
_MISS = "len(list_filter([{}], lambda x: contains(d.text, x) AND NOT contains(d.article, x)))"
_GROUND = f"SELECT doc_id, {_MISS.format(', '.join(map(repr, TERMS)))}::BIGINT AS critical, {_MISS.format(', '.join(map(repr, BAIT)))}::BIGINT AS clickbait, length(d.text) AS n FROM ({_PAIRED}) d"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "benchmark").select("item_id", F.col("text").alias("article"))
    n = load(spark, d, "benchmark").agg(F.count("*").alias("n_articles"))
    return _docs(spark, d).withColumn("item_id", F.col("doc_id") % n.scalar()).join(b, "item_id")


def _grounding(spark: SparkSession, d: str) -> DataFrame:
    j = _paired(spark, d)
    n = lambda terms: F.size(t.ungrounded_terms(F.col("text"), F.col("article"), terms)).cast("long")
    return j.select("doc_id", n(TERMS).alias("critical"), n(BAIT).alias("clickbait"), F.length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, critical, clickbait, greatest(0, 8 - 4 * critical - 2 * clickbait)::DOUBLE AS score FROM ({_GROUND})")
def term_grounding(spark: SparkSession, d: str) -> DataFrame:
    return _grounding(spark, d).select("doc_id", "critical", "clickbait", s.term_score(F.col("critical"), F.col("clickbait")).alias("score"))


_TERMS = "SELECT DISTINCT term FROM (SELECT p_name AS term FROM part UNION ALL SELECT unnest(string_split(text, ' ')) FROM benchmark) WHERE term <> ''"


@query(f"SELECT doc_id, count(*) AS n, min(term) AS first, max(term) AS last FROM documents JOIN ({_TERMS}) ON contains(text, term) GROUP BY 1")
def dictionary_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a table (names of parts, words of the benchmark) that each document holds."""
    names = load(spark, d, "part").select(F.col("p_name").alias("term"))
    terms = names.unionByName(load(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("term")))
    found = contained_terms(spread(load(spark, d, "documents").select("doc_id", "text")), terms, key="doc_id", text="text", term="term")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("term").alias("first"), F.max("term").alias("last"))


@query()
def html_article(spark: SparkSession, d: str) -> DataFrame:
    """Title and text of each page by known places, with the lines that are not text left out."""
    a = news_articles(load(spark, d, "pages").select("page_id", "html"))
    return a.select("page_id", "title", F.array_join(ground.article_lines(F.col("body")), "\n\n").alias("text"))


_SHORT = "(CASE WHEN n < 350 THEN 2 WHEN n < 400 THEN 1 WHEN n <= 550 THEN 0 ELSE 1 END)"
_BLOG = "(CASE WHEN n < 1800 THEN 4 WHEN n < 2160 THEN 2 WHEN n <= 2900 THEN 0 ELSE 1 END)"


@query(f"SELECT doc_id, n, {_SHORT}::DOUBLE AS shorts, {_BLOG}::DOUBLE AS blog, CASE WHEN n = 0 THEN 'empty' WHEN n < 350 THEN 'serious_short' WHEN n < 400 THEN 'slight_short' WHEN n <= 500 THEN 'optimal' WHEN n <= 550 THEN 'slight_long' ELSE 'excessive' END AS class FROM (SELECT doc_id, length(trim(text, ' ' || chr(10))) AS n FROM documents)")
def length_bands(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return _docs(spark, d).select("doc_id", F.length(t.strip(F.col("text"))).cast("long").alias("n")).select("doc_id", "n", s.shorts_band(n).alias("shorts"), s.blog_band(n).alias("blog"), s.length_class(n).alias("class"))


@query("SELECT doc_id, (length(text) * 10 // 68)::BIGINT AS tenths, CASE WHEN length(text) < 374 THEN 'short' WHEN length(text) <= 401 THEN 'fit' ELSE 'long' END AS band FROM documents")
def speech_estimate(spark: SparkSession, d: str) -> DataFrame:
    """6.8 characters a second; 55 to 59 seconds fit."""
    n = F.length("text")
    return _docs(spark, d).select("doc_id", F.floor(n * 10 / 68).alias("tenths"), F.when(n < 374, "short").when(n <= 401, "fit").otherwise("long").alias("band"))


@query(r"SELECT doc_id, len(l)::BIGINT AS kept, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS chars FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 10 AND NOT contains(lower(x), 'license') AND NOT contains(lower(x), 'copyright') AND NOT regexp_matches(x, '[\w.]+@[\w.]+')) AS l FROM documents)")
def line_filter(spark: SparkSession, d: str) -> DataFrame:
    ok = lambda x: (F.length(x) >= 10) & ~F.contains(F.lower(x), F.lit("license")) & ~F.contains(F.lower(x), F.lit("copyright")) & ~F.rlike(x, F.lit(r"[\w.]+@[\w.]+"))
    return _docs(spark, d).select("doc_id", F.filter(F.split("text", "\n"), ok).alias("l")).select("doc_id", F.size("l").cast("long").alias("kept"), F.coalesce(F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(x)), F.lit(0).cast("long")).alias("chars"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages WHERE regexp_matches(lower(url), '(/en/|/fr/)') AND NOT regexp_matches(lower(url), '(ref=|//m\\.)')")
def url_filter(spark: SparkSession, d: str) -> DataFrame:
    u = F.lower("url")
    return load(spark, d, "pages").filter(u.rlike("(/en/|/fr/)") & ~u.rlike(r"(ref=|//m\.)")).select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


_WORDS = "SELECT conv_id, turn, l[i] AS w, i FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS l FROM conversations), unnest(range(1, len(l) + 1)) AS g(i)"


@query(f"""WITH RECURSIVE w AS MATERIALIZED ({_WORDS}), r AS (SELECT conv_id, turn, i, w AS now, 1 AS n, 0 AS cap, w FROM w WHERE i = 1 UNION ALL
SELECT conv_id, turn, i, CASE WHEN cut THEN w ELSE now || ' ' || w END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN cap + 1 ELSE cap END, w FROM (SELECT w.conv_id, w.turn, w.i, r.now, r.n, r.cap, w.w, length(r.now) + 1 + length(w.w) > 13 OR r.n >= 4 OR regexp_matches(r.now, '[.!?,~]$') AS cut FROM r JOIN w ON w.conv_id = r.conv_id AND w.turn = r.turn AND w.i = r.i + 1))
SELECT conv_id, turn, cap AS i, string_agg(w, ' ' ORDER BY r.i) AS caption FROM r GROUP BY 1, 2, 3""")
def caption_pack(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(t.pack_captions(words)).alias("i", "caption"))


@query("SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS start FROM (SELECT l_orderkey, l_linenumber, floor(l_quantity * 77.25 * 1000)::BIGINT AS ms FROM lineitem)")
def srt_format(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.srt_time(F.col("l_quantity") * 77.25).alias("start"))


_CURSOR = """WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
r AS (SELECT l_orderkey, i, 0.0::DOUBLE AS s, floor(least(l_quantity / 8, 12.0) * 100 + 0.5) / 100 AS e FROM o WHERE i = 1
UNION ALL SELECT o.l_orderkey, o.i, r.e, greatest(r.e, floor(least(r.e + o.l_quantity / 8, 12.0) * 100 + 0.5) / 100) FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.i = r.i + 1)
SELECT l_orderkey, s AS start, e AS "end" FROM r WHERE e > s"""


@query(_CURSOR)
def timeline_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a clip list on a timeline of 12 s; the sum is of rounded ends."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    g = load(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("x"))
    return g.select("l_orderkey", F.explode(t.rounded_cursor(F.transform("x", lambda i: i["l_quantity"] / 8), 12.0)).alias("g")).select("l_orderkey", "g.*")


_KIND = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag = 'R' AS video, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, count(*) FILTER (l_returnflag <> 'R') OVER (PARTITION BY l_orderkey) AS ni, count(*) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS nv FROM lineitem"


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN NOT video THEN i WHEN i * greatest(1, ni // (nv + 1)) <= ni THEN i * greatest(1, ni // (nv + 1)) ELSE 1000000 END, video, i) AS place FROM ({_KIND})")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    """After every step-th image the next video; videos left over come last."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    w = Window.partitionBy("l_orderkey")
    x = load(spark, d, "lineitem").select("l_orderkey", "l_returnflag", *order).withColumn("video", F.col("l_returnflag") == "R")
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey", "video").orderBy(*order))).withColumn("ni", F.count_if(~F.col("video")).over(w)).withColumn("nv", F.count_if(F.col("video")).over(w))
    at = F.col("i") * F.greatest(F.lit(1), F.floor(F.col("ni") / (F.col("nv") + 1)))
    key = F.when(~F.col("video"), F.col("i")).when(at <= F.col("ni"), at).otherwise(1_000_000)
    return x.select("l_orderkey", "l_partkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(key, "video", "i")).cast("long").alias("place"))


_ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'N', turn, l_returnflag, {', '.join(_ITEM_ORDER)}) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {', '.join(_ITEM_ORDER)}) AS turn FROM lineitem)")
def round_robin_merge(spark: SparkSession, d: str) -> DataFrame:
    """Of two kinds of items one each in turn; those of any other kind come last."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_returnflag", *_ITEM_ORDER)
    merged = round_robin(rows, ["A", "R"], group="l_orderkey", kind="l_returnflag", order=[F.asc(x) for x in _ITEM_ORDER])
    return merged.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "place")


@query("SELECT l_orderkey, l_returnflag, place FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS place FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) UNION ALL SELECT l_orderkey, f, have + row_number() OVER (PARTITION BY l_orderkey ORDER BY f) FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS x, count(DISTINCT l_returnflag) AS have FROM lineitem GROUP BY 1), (VALUES ('A'), ('N'), ('R')) v(f) WHERE NOT list_contains(x, f))")
def padded_categories(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of items by frequency, padded with those that lack to three for each order."""
    n = load(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    ranked = n.select("l_orderkey", "l_returnflag", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("n"), "l_returnflag")).cast("long").alias("place"))
    defaults = spark.createDataFrame([("A", 1), ("N", 2), ("R", 3)], "l_returnflag string, place long")
    return padded(ranked, defaults, 3, group="l_orderkey", key="l_returnflag")


@query("SELECT l_orderkey, n, greatest(2.0, 40.0 / n) AS clip_dur, greatest(n, floor(40 / 2.8)::BIGINT) AS cuts, 40.0 / greatest(n, floor(40 / 2.8)::BIGINT) AS img_dur FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def duration_alloc(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    cuts = F.greatest(n, F.lit(14).cast("long"))
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select("l_orderkey", "n", F.greatest(F.lit(2.0), 40.0 / n).alias("clip_dur"), cuts.alias("cuts"), (40.0 / cuts).alias("img_dur"))


@query("""WITH RECURSIVE g AS (SELECT l_orderkey, sum(l_quantity) AS total, list(l_quantity ORDER BY l_quantity) AS x FROM lineitem GROUP BY 1),
c AS MATERIALIZED (SELECT l_orderkey, list_concat(CASE WHEN total >= 48 THEN [0.5::DOUBLE, 15, 30, 45, total - 1] ELSE [total * 1 / 10, total * 3 / 10, total * 5 / 10, total * 7 / 10, total * 9 / 10] END, x) AS l FROM g),
r AS (SELECT l_orderkey, 0 AS i, []::DOUBLE[] AS acc FROM c UNION ALL SELECT r.l_orderkey, r.i + 1, CASE WHEN len(acc) < 10 AND len(list_filter(acc, lambda a: abs(a - l[r.i + 1]) < 1.5)) = 0 THEN list_append(acc, l[r.i + 1]) ELSE acc END FROM r JOIN c ON c.l_orderkey = r.l_orderkey WHERE r.i < len(l))
SELECT r.l_orderkey, j - 1 AS i, acc[j] AS at FROM r JOIN c ON c.l_orderkey = r.l_orderkey AND r.i = len(l), unnest(range(1, len(acc) + 1)) AS h(j)""")
def frame_plan(spark: SparkSession, d: str) -> DataFrame:
    """Base times first, then the starts of items; a time is taken if 1.5 s from all others, ten at most."""
    g = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"), F.array_sort(F.collect_list("l_quantity")).alias("x"))
    base = F.when(F.col("total") >= 48, F.array(F.lit(0.5), F.lit(15.0), F.lit(30.0), F.lit(45.0), F.col("total") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("total") * (i * 2 + 1) / 10))
    return g.select("l_orderkey", F.posexplode(t.greedy_gap(F.concat(base, F.col("x")), 1.5, 10)).alias("i", "at"))


@query(f"""WITH b AS (SELECT doc_id, scene_index, length(sentence) AS n FROM ({ORACLES['sentence_split']})), c AS (SELECT *, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY scene_index) - 1 AS upto FROM b)
SELECT doc_id, count(*) FILTER (upto <= 380) AS kept, coalesce(max(upto) FILTER (upto <= 380), 0)::BIGINT AS chars FROM c GROUP BY 1""")
def prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    """Leading sentences while their length with separators stays within 380; lengths grow, so the first overflow ends it."""
    upto = F.sum(F.length("sentence") + 1).over(Window.partitionBy("doc_id").orderBy("scene_index")) - 1
    c = sentence_split(spark, d).withColumn("upto", upto)
    return c.groupBy("doc_id").agg(F.count_if(F.col("upto") <= 380).alias("kept"), F.coalesce(F.max(F.when(F.col("upto") <= 380, F.col("upto"))), F.lit(0)).cast("long").alias("chars"))


@query("SELECT user_id, arg_max(event_id, (CASE WHEN k >= 90 THEN 1000 WHEN k >= 70 THEN 500 WHEN k >= 50 THEN 300 ELSE k END, -event_id)) AS event_id FROM (SELECT user_id, event_id, (props->>'k')::INT AS k FROM events) GROUP BY 1")
def candidate_rank_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    score = F.when(k >= 90, 1000).when(k >= 70, 500).when(k >= 50, 300).otherwise(k)
    m = load(spark, d, "events").groupBy("user_id").agg(F.max(F.struct(score.alias("s"), (-F.col("event_id")).alias("e"))).alias("m"))
    return m.select("user_id", (-F.col("m.e")).alias("event_id"))


@query("SELECT event_id, CASE WHEN event_id % 6 IN (3, 5) THEN NULL ELSE (props->>'k')::INT END AS k FROM events")
def lenient_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects out of replies: plain, fenced, amid prose, broken (null), the first of a list, a list that begins with none (null)."""
    k, p = F.col("event_id") % 6, F.col("props")
    raw = F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), p, F.lit(" ok"))).when(k == 3, F.lit("{broken")).when(k == 4, F.concat(F.lit("["), p, F.lit(', {"k": 1}]'))).otherwise(F.concat(F.lit("[1, "), p, F.lit("]")))
    return load(spark, d, "events").select("event_id", F.get_json_object(t.lenient_json(raw), "$.k").try_cast("int").alias("k"))


@query("WITH h AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) rn, sum(n) OVER (PARTITION BY user_id) AS total FROM h) SELECT user_id, sum(n) FILTER (rn = 1)::BIGINT AS top1, sum(n) FILTER (rn <= 2)::BIGINT AS top2, max(total)::BIGINT AS total, sum(n) FILTER (rn = 1) > 0.6 * max(total) OR sum(n) FILTER (rn <= 2) > 0.72 * max(total) AS flat FROM r GROUP BY 1")
def histogram_topshare(spark: SparkSession, d: str) -> DataFrame:
    h = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    r = h.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")))
    g = r.groupBy("user_id").agg(F.sum(F.when(F.col("rn") == 1, F.col("n"))).alias("top1"), F.sum(F.when(F.col("rn") <= 2, F.col("n"))).alias("top2"), F.sum("n").alias("total"))
    return g.withColumn("flat", (F.col("top1") > 0.6 * F.col("total")) | (F.col("top2") > 0.72 * F.col("total")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > l_tax * 500 THEN 4.0::DOUBLE ELSE 0.0 END + CASE WHEN l_quantity BETWEEN 29 AND 31 THEN 2.0 WHEN l_quantity BETWEEN 24 AND 61 THEN 1.5 WHEN l_quantity > 0 THEN 0.5 ELSE 0.0 END + CASE WHEN l_quantity > 5 THEN 1.0 ELSE 0.0 END + CASE WHEN l_discount * 100 <= 2.5 THEN 2.0 WHEN l_discount * 100 <= 5 THEN 1.0 ELSE 0.0 END AS score FROM lineitem")
def technical_bands(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.technical(F.col("l_tax") * 500, q, q, q, F.col("l_discount") * 100).alias("score"))


_VERDICT = "SELECT doc_id, total, CASE WHEN toxic = 1 OR total < 70 THEN 'FAIL' WHEN doc_id % 5 = 0 THEN 'WARNING' WHEN total < 90 THEN 'WARNING' ELSE 'PASS' END AS status FROM (SELECT l.doc_id, toxic, (40 * quality + CASE WHEN length(text) > 1000 THEN 55 ELSE 35 END)::DOUBLE AS total FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query(_VERDICT)
def verdict(spark: SparkSession, d: str) -> DataFrame:
    j = load(spark, d, "labels").join(_docs(spark, d), "doc_id")
    j = j.withColumn("total", s.clamp_total([F.col("quality") * F.lit(40.0), F.when(F.length("text") > 1000, 55.0).otherwise(35.0)], 100.0))
    return j.select("doc_id", "total", s.verdict(F.col("total"), F.col("toxic") == 1, F.col("doc_id") % 5 != 0).alias("status"))


@query("SELECT doc_id, quality, rn FROM (SELECT l.doc_id, quality, source, row_number() OVER (PARTITION BY source ORDER BY l.doc_id DESC) AS rn FROM labels l JOIN documents d ON l.doc_id = d.doc_id) WHERE rn <= 10")
def recent_qa_rows(spark: SparkSession, d: str) -> DataFrame:
    j = load(spark, d, "labels").join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id"))).cast("long")).filter("rn <= 10").select("doc_id", "quality", "rn")


@query("SELECT page_id, regexp_extract(url, '([^/?#]*)[^/]*$', 1) AS base, left(sha256(page_id || '_' || url), 8) AS id, regexp_replace(left(url, 45), '[^A-Za-z0-9-]', '_', 'g') AS slug, least(100, greatest(10, page_id)) AS clamped FROM pages")
def scalar_pack(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.regexp_extract("url", "([^/?#]*)[^/]*$", 1).alias("base"), F.left(F.sha2(F.concat_ws("_", "page_id", "url").cast("binary"), 256), F.lit(8)).alias("id"), F.regexp_replace(F.left("url", F.lit(45)), "[^A-Za-z0-9-]", "_").alias("slug"), F.least(F.lit(100), F.greatest(F.lit(10), "page_id")).alias("clamped"))
