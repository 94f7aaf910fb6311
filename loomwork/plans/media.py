"""Queries on media metadata, subtitles, replies and Korean texts.

The tables hold none of these, so each query writes them from literals and ids; its SQL says what the rule gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import dictionaries as words
from loomwork.functions import grounding as ground
from loomwork.functions import media as m
from loomwork.functions import scoring as s
from loomwork.functions import text as t
from loomwork.functions.pixels import image_features
from loomwork.operators import catalogue as c
from loomwork.sources.scratch import scratch_folder
from loomwork.sources.tables import content_hash, evolve, feed_items, load, schema, write_files

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _text(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _case(on: Column, *values) -> Column:
    """The value whose place is ``on``; the last for all others."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(on == 0, lit(values[0]))
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(on == i, lit(v))
    return out.otherwise(lit(values[-1]))


@query("""SELECT event_id, (60 + event_id % 60)::DOUBLE + 0.5 AS duration, event_id % 3 > 0 AS has_audio, event_id % 7 > 0 AS has_video, CASE WHEN event_id % 7 > 0 THEN (100 + event_id % 900)::INT END AS width, CASE WHEN event_id % 7 > 0 THEN 1920 END AS height, CASE WHEN event_id % 7 > 0 THEN 29.97::DOUBLE END AS fps FROM events""")
def probe_report(spark: SparkSession, d: str) -> DataFrame:
    """A probe's report read: length, streams, size and frame rate; what it does not say is null or false."""
    e = F.col("event_id")
    report = F.concat(F.lit("Input #0\n  Duration: 00:01:"), F.lpad(_text(e % 60), 2, "0"), F.lit(".50, start: 0.0\n"), F.when(e % 7 > 0, F.concat(F.lit("  Stream #0:0: Video: h264 (High), yuv420p, "), _text(100 + e % 900), F.lit("x1920, 1200 kb/s, 29.97 fps, 30 tbr\n"))).otherwise(""), F.when(e % 3 > 0, "  Stream #0:1: Audio: aac\n").otherwise(""))
    return load(spark, d, "events").select("event_id", m.probe(report).alias("p")).select("event_id", "p.*")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '&H0000FFFF' ELSE '&H00' || upper(substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)) END AS colour FROM (SELECT c_custkey, left(md5(c_custkey::VARCHAR), 6) AS x FROM customer)")
def subtitle_colours(spark: SparkSession, d: str) -> DataFrame:
    x = F.left(F.md5(_text("c_custkey").cast("binary")), F.lit(6))
    css = F.when(F.col("c_custkey") % 5 == 0, "yellowish").otherwise(F.concat(F.lit("#"), x))
    return load(spark, d, "customer").select("c_custkey", m.subtitle_colour(css).alias("colour"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN left(md5(p_partkey::VARCHAR), 11) END AS video FROM part")
def video_ids(spark: SparkSession, d: str) -> DataFrame:
    k, x = F.col("p_partkey"), F.left(F.md5(_text("p_partkey").cast("binary")), F.lit(11))
    url = _case(k % 4, F.concat(F.lit("https://youtube.com/watch?v="), x), F.concat(F.lit("https://youtu.be/"), x, F.lit("?t=3")), F.concat(F.lit("https://m.youtube.com/shorts/"), x), "https://youtube.com/c/short")
    return load(spark, d, "part").select("p_partkey", m.video_id(url).alias("video"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN wide THEN greatest(0, least(trunc(w / 3.0 - cw / 2.0)::INT, w - cw)) ELSE 0 END AS x, CASE WHEN wide THEN 0 ELSE greatest(0, least(trunc(h / 4.0 - ch * 0.3::DOUBLE)::INT, h - ch)) END AS y, cw AS width, ch AS height
FROM (SELECT *, CASE WHEN wide THEN floor(h * 9 / 16.0)::INT ELSE w END AS cw, CASE WHEN wide THEN h ELSE floor(w / (9 / 16.0::DOUBLE))::INT END AS ch FROM (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity * 32 + 160)::INT AS w, (l_partkey % 40 * 32 + 160)::INT AS h, (l_quantity * 32 + 160) / (l_partkey % 40 * 32 + 160) > 9 / 16.0 AS wide FROM lineitem))""")
def crop_windows(spark: SparkSession, d: str) -> DataFrame:
    """Portrait crops: a wide image around a face at a third of its width, a tall one below its top."""
    w, h = (F.col("l_quantity") * 32 + 160).cast("int"), (F.col("l_partkey") % 40 * 32 + 160).cast("int")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", m.crop_window(w, h, w / 3, h / 4).alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", "c.*")


_GREY = "list_transform(range(1, 73), lambda i: ({k} * {k} * i + i * i * 17) % 251)"
_HEX = "list_aggregate(list_transform(range(0, 16), lambda k: substr('0123456789abcdef', 1 + 8 * {b}[4 * k + 1] + 4 * {b}[4 * k + 2] + 2 * {b}[4 * k + 3] + {b}[4 * k + 4], 1)), 'string_agg', '')"
_RISE = "list_transform(list_filter(range(1, 72), lambda i: i % 9 <> 0), lambda i: ({g}[i] > {g}[i + 1])::INT)"


@query(f"""WITH g AS (SELECT vec_id, {_GREY.format(k='vec_id')} AS g, {_GREY.format(k='(vec_id + 1)')} AS h FROM embeddings), b AS (SELECT vec_id, {_RISE.format(g='g')} AS b, {_RISE.format(g='h')} AS c FROM g)
SELECT vec_id, {_HEX.format(b='b')} AS hash, CASE WHEN vec_id % 9 = 0 THEN 64 ELSE list_sum(list_transform(range(1, 65), lambda i: (b[i] <> c[i])::INT)) END::INT AS distance FROM b""")
def photo_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of grey images of 9 by 8 points, and their distance to another image's hash; 64 to one that is no hash."""

    def grey(k: Column) -> Column:
        return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(72).cast("long")), lambda i: (k * k * i + i * i * 17) % 251)

    k = F.col("vec_id")
    e = load(spark, d, "embeddings").select("vec_id", m.rising_bits(grey(k)).alias("hash"), m.rising_bits(grey(k + 1)).alias("other"))
    other = F.when(k % 9 == 0, "no hash").otherwise(F.col("other"))
    return e.select("vec_id", "hash", m.hamming_hex(F.col("hash"), other).cast("int").alias("distance"))


_NAMED = "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN ' 관객 ' WHEN 1 THEN '병원 앞 의사' WHEN 2 THEN 'My_Own-Name!' WHEN 3 THEN '###' WHEN 4 THEN '콘서트장 팬' WHEN 5 THEN '현금' ELSE split_part(p_name, ' ', 1) END AS name FROM part"
_KEYS = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(words.KEYWORD_CATEGORIES.items()))


@query(f"""WITH n AS (SELECT p_partkey, lower(trim(name)) AS c FROM ({_NAMED})), k(o, k, v) AS (VALUES {_KEYS}) SELECT p_partkey, coalesce((SELECT v FROM k WHERE k.k = c), (SELECT arg_min(v, o) FROM k WHERE contains(c, k.k)), nullif(regexp_replace(c, '[^a-zA-Z0-9_-]', '', 'g'), ''), 'audience') AS category FROM n""")
def category_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of categories to the known ones: by keyword, by the first keyword in the name, by their letters, or the default."""
    name = _case(F.col("p_partkey") % 7, " 관객 ", "병원 앞 의사", "My_Own-Name!", "###", "콘서트장 팬", "현금", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return load(spark, d, "part").select("p_partkey", ground.canonical_category(name).alias("category"))


_CLOCK = "printf('%02d:%02d:%02d,%03d', ({x}) // 3600000, ({x}) // 60000 % 60, ({x}) // 1000 % 60, ({x}) % 1000)"


@query(f"SELECT conv_id, turn, {_CLOCK.format(x='(turn * 60000 + 250) * 4 // 5')} || ' --> ' || {_CLOCK.format(x='(turn * 60000 + 1500) * 4 // 5')} AS timing, 2::BIGINT AS cues, (CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS stacked, role || CASE WHEN turn % 3 = 0 THEN chr(10) || 'more' ELSE '' END AS first FROM conversations")
def srt_validate(spark: SparkSession, d: str) -> DataFrame:
    """A subtitle file with times made 1.25 times as fast, then its cues: several lines or a break in one are stacked."""
    ms = lambda x: t.srt_time(x / 1000)
    start = F.col("turn") * 60000 + 250
    block = F.concat(F.lit("1\n"), ms(start), F.lit(" --> "), ms(start + 1250), F.lit("\n"), F.col("role"), F.when(F.col("turn") % 3 == 0, "\n<i>more</i>").otherwise(""))
    srt = F.concat(block, F.lit("\n\n2\n"), ms(start + 2000), F.lit(" --> "), ms(start + 3000), F.lit("\nend"), F.when(F.col("turn") % 2 == 0, "<br>next").otherwise(""), F.lit("\n"))
    fast = m.rescaled(srt, 1.25)
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.split(fast, "\n")[1].alias("timing"), m.cues(fast).alias("c"))
    return rows.select("conv_id", "turn", "timing", F.size("c").cast("long").alias("cues"), F.size(F.filter("c", lambda x: x["stacked"])).cast("long").alias("stacked"), F.col("c")[0]["text"].alias("first"))


_KOREAN = "SELECT p_partkey, repeat('오늘 ' || p_name || ' 무대가 좋았다 내일도 오세요 ', (1 + p_partkey % 4)::INT) || CASE WHEN p_partkey % 5 = 0 THEN '.' ELSE '' END AS x FROM part"


@query(f"SELECT p_partkey, len(s)::BIGINT AS n, s[1] AS first FROM (SELECT p_partkey, CASE WHEN length(x) > 80 THEN list_filter(list_transform(regexp_extract_all(x, '[^다요죠군네까]+(?:[다요죠군네까]+|$)'), lambda y: trim(y)), lambda y: y <> '') ELSE [trim(x)] END AS s FROM ({_KOREAN}))")
def long_sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """One long line without marks is cut at the syllables that end Korean sentences."""
    k = F.col("p_partkey")
    x = F.concat(F.repeat(F.concat(F.lit("오늘 "), "p_name", F.lit(" 무대가 좋았다 내일도 오세요 ")), (1 + k % 4).cast("int")), F.when(k % 5 == 0, ".").otherwise(""))
    return load(spark, d, "part").select("p_partkey", t.long_sentences(x).alias("s")).select("p_partkey", F.size("s").cast("long").alias("n"), F.col("s")[0].alias("first"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name || '|' || p_brand ELSE '' END AS quoted, p_partkey % 2 = 0 AS parts FROM part")
def quoted_names(spark: SparkSession, d: str) -> DataFrame:
    """What stands between marks (the pattern's closing marks are the straight and the opening ones), and whether a long text has sections."""
    k = F.col("p_partkey")
    q = F.when(k % 3 == 0, F.concat(F.lit('그는 "'), "p_name", F.lit('" 말했다'))).when(k % 3 == 1, F.concat(F.lit("'"), "p_name", F.lit("' 와 <"), "p_brand", F.lit(">"))).otherwise("아무 말 “ab” 없다")
    blog = F.concat(q, F.when(k % 2 == 0, " [사진 1] a [사진2] b [이미지 3]").otherwise(" [사진 1] a ### 2"))
    return load(spark, d, "part").select("p_partkey", F.array_join(ground.quoted_entities(q), "|").alias("quoted"), (F.regexp_count(blog, F.lit(words.SECTION)) >= 3).alias("parts"))


_ONE = "regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g')"


@query(f"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split({_ONE}, chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i, l[i] AS s, sum(length(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l, unnest(range(1, len(l) + 1)) AS g(i)),
k AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS kept FROM (SELECT *, upto - CASE WHEN i > 1 THEN 1 ELSE 0 END <= 380 AS ok FROM u) WHERE ok GROUP BY 1)
SELECT l.doc_id, CASE WHEN length(text) <= 380 THEN text ELSE coalesce(kept, left(l[1], 380), text) END AS script FROM l LEFT JOIN k ON l.doc_id = k.doc_id""")
def script_trim(spark: SparkSession, d: str) -> DataFrame:
    """A script of more than 380 characters cut to its leading sentences; to 380 characters of the first if that is too long."""
    return load(spark, d, "documents").filter("text is not null").select("doc_id", t.trimmed(F.col("text"), 380).alias("script"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'plain ' || event_type ELSE (props->>'k') END AS value FROM events")
def json_or_text(spark: SparkSession, d: str) -> DataFrame:
    """A field of a JSON text; a text that is no JSON stays as it is."""
    raw = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("plain "), "event_type")).otherwise(F.col("props"))
    return load(spark, d, "events").select("event_id", F.when(F.try_parse_json(raw).isNull(), raw).otherwise(F.get_json_object(raw, "$.k")).alias("value"))


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER ('h' || (l_partkey % 97) IN (SELECT 'h' || (p_size * 2) FROM part)) AS known FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def known_images(spark: SparkSession, d: str) -> DataFrame:
    """How many of the images that are there now have a content that is known."""
    stored = load(spark, d, "part").select((F.col("p_size") * 2).cast("long").alias("h")).distinct().withColumn("hit", F.lit(1))
    rows = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 97).alias("h")).join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(stored, "h", "left").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count("hit").alias("known"))


@query("SELECT o_orderkey, CASE WHEN total >= 45 THEN 34.0::DOUBLE ELSE greatest(5.6::DOUBLE, total * 0.55::DOUBLE) END AS ideal FROM (SELECT o_orderkey, count(*) * 2.8::DOUBLE AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def ideal_slot(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") * F.lit(2.8)).alias("total"))
    return n.join(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", s.ideal_time(F.col("total")).alias("ideal"))


@query("SELECT s_nationkey, place, s_name AS title, 'https://x.test/' || s_suppkey AS link FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier) WHERE place < 5")
def feed_files(spark: SparkSession, d: str) -> DataFrame:
    """A feed for each nation, written and read again: its first five items in their order."""
    k = F.col("s_suppkey")
    item = F.concat(F.lit("<item><title>"), "s_name", F.lit("</title><link>https://x.test/"), _text(k), F.lit("</link><guid>"), _text("s_nationkey"), F.lit("</guid></item>"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("item")))), lambda x: x["item"]), "")
    feeds = load(spark, d, "supplier").groupBy("s_nationkey").agg(items.alias("items"))
    home = scratch_folder(spark, "feeds")
    xml = feeds.select(F.col("s_nationkey").alias("feed"), F.concat(F.lit("<rss><channel><title>t</title>"), "items", F.lit("</channel></rss>")).alias("xml"))
    write_files(xml, home, name="feed", text="xml")  # a file for each
    read = feed_items(spark, home)
    return read.select(F.col("guid").cast("int").alias("s_nationkey"), F.col("place").cast("long").alias("place"), "title", "link")


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 OR text IS NULL THEN 'c:/files/' || lower(source) || '/' || doc_id ELSE text END) AS file_hash FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of contents; of the path, lower case and with forward slashes, where there is no content."""
    path = F.concat(F.lit("C:\\Files\\"), F.upper("source"), F.lit("\\"), _text("doc_id"))
    content = F.when(F.col("doc_id") % 4 != 0, F.col("text").cast("binary"))
    return load(spark, d, "documents").select("doc_id", content_hash(content, path).alias("file_hash"))


@query("SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS aliases, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS extra FROM customer")
def added_columns(spark: SparkSession, d: str) -> DataFrame:
    """A table of fewer columns read under a schema that has more: those are null; two such tables fit together."""
    old = load(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("name"))
    to = schema("id long, name string, aliases string, extra int")
    new = old.filter("id % 2 = 0").withColumn("extra", F.lit(1).cast("long"))
    return evolve(new, to).unionByName(evolve(old.filter("id % 2 <> 0"), to))


@query("SELECT p_partkey, p_size % 5 <> 0 AND there AS active, p_size % 5 <> 0 AND NOT there AS deactivated FROM (SELECT *, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40) AS there FROM part)")
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    """Media whose file is not in a listing (the items of large quantities) are no longer active; those that were are told apart, and no row is deleted."""
    part = load(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 != 0).alias("was"))
    listed = load(spark, d, "lineitem").filter("l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("there", F.lit(True))
    j = part.join(listed, "p_partkey", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return j.select("p_partkey", (F.col("was") & F.col("there")).alias("active"), (F.col("was") & ~F.col("there")).alias("deactivated"))


#: An image of 60 by 40 points from a vector: its colours are the vector's values in as many steps as its id tells.
_POINT = "floor((embedding[1 + (x * 7 + y * 3 + x * y) % 64] + 1) * (2 + vec_id % 9))"


@query(f"""WITH p AS (SELECT vec_id, {_POINT} AS c FROM embeddings, (SELECT unnest(range(0, 60)) AS x), (SELECT unnest(range(0, 40)) AS y)), n AS (SELECT vec_id, c, count(*) AS n FROM p GROUP BY 1, 2),
r AS (SELECT vec_id, n, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC) AS place FROM n), t AS (SELECT vec_id, sum(n) FILTER (place = 1) / 2400 AS top1, sum(n) FILTER (place <= 2) / 2400 AS top2 FROM r GROUP BY 1) SELECT vec_id, top1, top2, top1 > 0.60 OR top2 > 0.72 AS flat FROM t""")
def flat_graphics(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the most frequent colours of images, and whether those are flat graphics."""
    return _images(spark, d).select("vec_id", "top1", "top2", "flat")


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Images of 60 by 40 points, their hashes and colours."""
    place = F.sequence(F.lit(0), F.lit(2399))
    value = lambda i: F.element_at("embedding", (1 + (i % 60 * 7 + F.floor(i / 60) * 3 + i % 60 * F.floor(i / 60)) % 64).cast("int"))
    colour = F.transform(place, lambda i: F.floor((value(i) + 1) * (F.col("vec_id") % 9 + 2)).cast("int"))
    grey = F.transform(place, lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((value(i) + 1) * 127.5))).cast("int"))
    images = load(spark, d, "embeddings").select("vec_id", grey.alias("grey"), colour.alias("colour"))
    return image_features(images, key="vec_id", grey="grey", colour="colour", width=60)


def pixel_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Difference hashes of images from their points; a test holds the resampling against a slow one."""
    return _images(spark, d).select("vec_id", "dhash")


QUERIES["pixel_hashes"] = pixel_hashes


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 40")
def ordered_by_list(spark: SparkSession, d: str) -> DataFrame:
    """An order given as a list of columns and directions from a white list."""
    order = c.order_columns([("p_size", "desc"), ("p_brand", "asc"), ("p_partkey", "asc")], {"p_partkey", "p_brand", "p_size"})
    return load(spark, d, "part").select("p_partkey", "p_brand", "p_size").orderBy(*order).limit(40)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS version FROM orders QUALIFY version = 1")
def replace_history(spark: SparkSession, d: str) -> DataFrame:
    """A project written again replaces its older entry: the newest id of each key stays."""
    return c.recent_n(load(spark, d, "orders").select("o_custkey", "o_orderkey"), 1, key="o_custkey", order=[F.desc("o_orderkey")]).select("o_orderkey", F.col("rn").alias("version"))
