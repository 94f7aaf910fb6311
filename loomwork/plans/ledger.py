"""Queries on the history of projects, the catalogue's write path, candidate choice, and the scalar rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import media as m
from loomwork.functions import scoring as s
from loomwork.functions import selection as sel
from loomwork.functions import text as t
from loomwork.operators import catalogue as c
from loomwork.operators import ledger as g
from loomwork.plans import catalogue as plans
from loomwork.sources.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# --- history of projects: a customer's orders, newest first; items stand for photos, clips and hooks ---

_ITEM = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_ORDER = ", ".join(_ITEM)
#: A photo's dHash as two words of 32 bits: contents (l_partkey % 97) of nine families, in each with up to three bits of their own.
_CONTENT = "(l_partkey % 97)"
_DHASH = [f"xor(({_CONTENT} % 9 * 2654435761) % 4294967296, 1::BIGINT << ({_CONTENT} % 32)::INT)", f"xor(({_CONTENT} % 9 * 2246822519) % 4294967296, xor(1::BIGINT << ({_CONTENT} * 7 % 32)::INT, 1::BIGINT << ({_CONTENT} * 11 % 32)::INT))"]
_HISTORY = f"""p AS (SELECT o_orderkey, o_custkey AS who, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS back FROM orders),
i AS (SELECT who, back, l_partkey, 'h' || (l_partkey % 97) AS hash, (l_partkey % 50) || '/' || (l_suppkey % 40) || '.jpg' AS path, (l_suppkey % 40) || '.jpg' AS base, {_DHASH[0]} AS w1, {_DHASH[1]} AS w2, row_number() OVER (PARTITION BY who, back ORDER BY {_ORDER}) AS pos FROM lineitem JOIN p ON l_orderkey = o_orderkey WHERE back <= 5),
c AS (SELECT *, row_number() OVER (PARTITION BY who, hash ORDER BY pos) > 1 AS again FROM i WHERE back = 0), b AS (SELECT * FROM i WHERE back > 0)"""


def _dhash(content: Column) -> list[Column]:
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), (content * n % 32).cast("int"))
    family = lambda n: content % 9 * n % (1 << 32)
    return [family(2654435761).bitwiseXOR(bit(1)).alias("w1"), family(2246822519).bitwiseXOR(bit(7)).bitwiseXOR(bit(11)).alias("w2")]


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The items of each customer's newest order and of the five before it, partitioned by customer; one exchange for all uses."""
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("who"), "o_orderdate")
    p = g.numbered_projects(orders, who="who", order=[F.desc("o_orderdate"), F.desc("o_orderkey")], most=5).drop("o_orderdate")
    i = load(spark, d, "lineitem").select("l_orderkey", *_ITEM).join(p, F.col("l_orderkey") == F.col("o_orderkey")).select("who", "back", *_ITEM).repartition("who")
    base = F.concat((F.col("l_suppkey") % 40).cast("string"), F.lit(".jpg"))
    pos = F.row_number().over(Window.partitionBy("who", "back").orderBy(*_ITEM)).cast("long")
    i = i.select("who", "back", "l_partkey", "l_suppkey", pos.alias("pos"))
    return i.select("who", "back", "l_partkey", F.concat(F.lit("h"), (F.col("l_partkey") % 97).cast("string")).alias("hash"), F.concat_ws("/", (F.col("l_partkey") % 50).cast("string"), base).alias("path"), base.alias("base"), *_dhash(F.col("l_partkey") % 97), "pos")


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The items of each customer's newest order, and of the five before it."""
    i = _items(spark, d)
    return i.filter("back = 0"), i.filter("back > 0")


#: Photos are near duplicates if at most so many bits of their dHashes differ.
_NEAR = 5
_CLOSE = f"x.path <> c.path AND bit_count(xor(c.w1, x.w1)) + bit_count(xor(c.w2, x.w2)) <= {_NEAR}"
_PHOTO = f"""{_HISTORY}, near AS (SELECT DISTINCT c.who, c.pos FROM c JOIN b x ON x.who = c.who AND {_CLOSE} UNION SELECT DISTINCT c.who, c.pos FROM c JOIN c x ON x.who = c.who AND x.pos < c.pos AND {_CLOSE}),
f AS (SELECT c.who, EXISTS (SELECT 1 FROM b WHERE b.who = c.who AND b.hash = c.hash) OR EXISTS (SELECT 1 FROM b WHERE b.who = c.who AND b.path = c.path) OR (again AND EXISTS (SELECT 1 FROM b WHERE b.who = c.who AND b.base = c.base)) AS exact, near.who IS NOT NULL AS close FROM c LEFT JOIN near ON near.who = c.who AND near.pos = c.pos),
photo AS (SELECT who, n, dup, near_dup, percent, 12.0::DOUBLE - CASE WHEN dup < 2 THEN 0 WHEN percent >= 50 THEN 10 WHEN percent >= 20 THEN 4 ELSE 0 END AS photo FROM (SELECT who, count(*) AS n, count(*) FILTER (exact OR close) AS dup, count(*) FILTER (close AND NOT exact) AS near_dup, round_even(100.0::DOUBLE * count(*) FILTER (exact OR close) / count(*), 1) AS percent FROM f GROUP BY 1))"""


@query(f"WITH {_PHOTO} SELECT * FROM photo")
def photo_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Photos of the newest project that the five before it had, by any of three rules or nearly so by dHash, and those near an earlier one of their own project; one is no fault; the share is rounded before the bands."""
    return _photo(*_history(spark, d))


def _photo(now: DataFrame, past: DataFrame) -> DataFrame:
    near = g.near_repeats(now, past, who="who", pos="pos", words=["w1", "w2"], threshold=_NEAR).withColumn("close", F.lit(True))
    met = g.reused(now, past, who="who", pos="pos").join(near, ["who", "pos"], "left").withColumn("close", F.coalesce("close", F.lit(False)))
    n = met.groupBy("who").agg(F.count("*").alias("n"), F.count_if(F.col("dup") | F.col("close")).alias("dup"), F.count_if(F.col("close") & ~F.col("dup")).alias("near_dup"))
    n = n.withColumn("percent", F.bround(F.lit(100.0) * F.col("dup") / F.col("n"), 1))
    return n.withColumn("photo", F.lit(12.0) - s.overlap_penalty(F.col("dup"), F.col("percent")))


_CLIP = f"""{{history}}, met AS (SELECT DISTINCT c.who, c.pos, b.back FROM c JOIN b ON c.who = b.who AND (c.hash = b.hash OR c.path = b.path OR c.base = b.base)),
runs AS (SELECT who, pos, count(*) FILTER (back = rn) AS run FROM (SELECT *, row_number() OVER (PARTITION BY who, pos ORDER BY back) AS rn FROM met) GROUP BY 1, 2),
clip AS (SELECT c.who, count(*) AS clips, count(*) FILTER (run > 0) AS reused, coalesce(max(run), 0)::BIGINT AS longest, 7.0::DOUBLE - coalesce(max(CASE WHEN run >= 3 THEN 5 WHEN run = 2 THEN 3 WHEN run = 1 THEN 1 ELSE 0 END), 0) AS broll FROM c LEFT JOIN runs ON c.who = runs.who AND c.pos = runs.pos GROUP BY 1)"""


@query(f"WITH {_CLIP.replace('{history}', _HISTORY)} SELECT * FROM clip")
def clip_runs(spark: SparkSession, d: str) -> DataFrame:
    """In how many projects in a row each clip was used; the worst clip counts, not the sum."""
    return _clips(*_history(spark, d))


def _clips(now: DataFrame, past: DataFrame) -> DataFrame:
    r = g.clip_runs(now, past, who="who", pos="pos", most=5)
    n = r.groupBy("who").agg(F.count("*").alias("clips"), F.count_if(F.col("run") > 0).alias("reused"), F.max("run").alias("longest"), F.max(s.streak_penalty(F.col("run"))).alias("lost"))
    return n.select("who", "clips", "reused", "longest", (F.lit(7.0) - F.least(F.lit(5.0), "lost")).alias("broll"))


_TOK = "list_distinct(list_transform(regexp_extract_all({}, '[가-힣a-zA-Z0-9]+'), lambda x: lower(x)))"
_HOOK = f"""hooks AS (SELECT who, back, {_TOK.format("p_name || ' ' || p_brand")} AS u FROM i JOIN part ON l_partkey = p_partkey WHERE pos = 1),
sims AS (SELECT a.who, b.back, len(list_intersect(a.u, b.u)) / len(list_distinct(list_concat(a.u, b.u))) AS sim FROM hooks a JOIN hooks b ON a.who = b.who AND a.back = 0 AND b.back > 0),
hook AS (SELECT who, round_even(max(sim), 3) AS similarity, CASE WHEN round_even(max(sim), 3) >= 0.85 THEN 1.0::DOUBLE WHEN round_even(max(sim), 3) > 0.7 THEN 2.0 WHEN round_even(max(sim), 3) >= 0.5 THEN 4.5 ELSE 6.0 END AS hook FROM sims GROUP BY 1)"""


@query(f"""WITH {_CLIP.replace('{history}', _PHOTO)}, {_HOOK} SELECT photo.who, photo, broll, coalesce(hook, 6.0) AS hook, photo + broll + coalesce(hook, 6.0) AS total, photo + broll + coalesce(hook, 6.0) >= 17.5 AS passed, photo + broll + coalesce(hook, 6.0) < 10 AS critical
FROM photo JOIN clip ON photo.who = clip.who LEFT JOIN hook ON photo.who = hook.who""")
def repetition_total(spark: SparkSession, d: str) -> DataFrame:
    """All three parts measured on the five projects before the newest; without any before, all points are full.

    The items are shuffled by customer once; what was there before comes from windows over them.
    """
    items = _items(spark, d)
    met = g.met_before(items, who="who", pos="pos").filter("back = 0")
    n = met.groupBy("who").agg(F.count("*").alias("n"), F.count_if("dup").alias("dup"), F.max(s.streak_penalty(F.col("run"))).alias("lost"))
    near = g.near_within(met.filter("not dup"), items, who="who", pos="pos", words=["w1", "w2"], threshold=_NEAR).groupBy("who").agg(F.count("*").alias("near"))
    n = n.join(near, "who", "left").withColumn("dup", F.col("dup") + F.coalesce("near", F.lit(0)))
    n = n.withColumn("photo", F.lit(12.0) - s.overlap_penalty(F.col("dup"), F.bround(F.lit(100.0) * F.col("dup") / F.col("n"), 1))).withColumn("broll", F.lit(7.0) - F.least(F.lit(5.0), "lost"))
    part = load(spark, d, "part").select("p_partkey", t.tokens(F.concat_ws(" ", "p_name", "p_brand")).alias("u"))
    first = items.filter("pos = 1").select("who", "back", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    first = first.select("who", "back", "u", F.max(F.when(F.col("back") == 0, F.col("u"))).over(Window.partitionBy("who")).alias("v")).filter("back > 0 and v is not null")
    sims = first.groupBy("who").agg(F.bround(F.max(t.word_jaccard(F.col("v"), F.col("u"))), 3).alias("sim"))
    hooks = sims.select("who", (F.lit(6.0) - s.hook_penalty(F.col("sim"))).alias("hook"))
    j = n.select("who", "photo", "broll").join(hooks, "who", "left").withColumn("hook", F.coalesce("hook", F.lit(6.0)))
    total = s.clamp_total([F.col("photo"), F.col("broll"), F.col("hook")], 25.0)
    return j.withColumn("total", total).withColumn("passed", F.col("total") >= 17.5).withColumn("critical", F.col("total") < 10)


# --- write path: parts stand for stored media ---

_STORED = "s AS (SELECT p_partkey AS id, 'p/' || p_partkey AS path, 'h' || p_partkey AS hash, CASE WHEN p_size >= 10 THEN 'd' || p_size END AS dhash, CASE WHEN p_size % 2 = 1 THEN p_size::BIGINT END AS singer, (p_size % 5 <> 0)::INT AS active, (p_size % 7 = 0)::INT AS approved, p_type AS subtype, p_partkey % 4 = 0 AS gone FROM part WHERE p_partkey % 3 <> 0)"


def _text(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return load(spark, d, "part").filter(k % 3 != 0).select(k.alias("id"), F.concat(F.lit("p/"), _text(k)).alias("path"), F.concat(F.lit("h"), _text(k)).alias("hash"), F.when(size >= 10, F.concat(F.lit("d"), _text(size))).alias("dhash"), F.when(size % 2 == 1, size.cast("long")).alias("singer"), (size % 5 != 0).cast("int").alias("active"), (size % 7 == 0).cast("int").alias("approved"), F.col("p_type").alias("subtype"), (k % 4 == 0).alias("gone"))


_USED = "u AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 'x/' ELSE 'p/' END || l_partkey AS path, 'h' || l_partkey AS hash FROM lineitem)"


@query(f"""WITH {_STORED}, {_USED} SELECT l_orderkey, l_linenumber, l_partkey, coalesce(a.id::VARCHAR, b.id::VARCHAR, 'n-' || left(md5(u.hash), 12)) AS media_id, CASE WHEN a.id IS NOT NULL THEN 'path' WHEN b.id IS NOT NULL THEN 'hash' ELSE 'new' END AS how
FROM u LEFT JOIN s a ON u.path = a.path LEFT JOIN (SELECT hash, min(id) AS id FROM s GROUP BY 1) b ON u.hash = b.hash""")
def usage_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Used files to media: by path, else by content, else as new ones."""
    k = F.col("l_partkey")
    u = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.when(F.col("l_linenumber") == 1, "x/").otherwise("p/"), _text(k)).alias("path"), F.concat(F.lit("h"), _text(k)).alias("hash"))
    return g.resolve_usage(u, _stored(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "media_id", "how")


_INCOMING = """n AS (SELECT p_partkey * 2 + r AS ord, CASE WHEN r = 1 THEN 'r/' WHEN p_partkey % 6 = 2 THEN 'q/' ELSE 'p/' END || p_partkey AS path, CASE WHEN p_partkey % 6 = 4 THEN 'n' ELSE 'h' END || p_partkey AS hash,
CASE WHEN p_size % 4 > 0 THEN 'e' || p_size END AS dhash, CASE WHEN r = 1 THEN p_size + 100::BIGINT END AS singer, (p_size % 3 = r)::INT AS approved, CASE WHEN p_size % 3 = r THEN 'general_broll' ELSE 'photo' END AS subtype FROM part, (VALUES (0), (1)) v(r) WHERE p_partkey % 2 = 0)"""
_REGISTER = f"""WITH {_STORED}, {_INCOMING},
f AS (SELECT hash, arg_min(path, ord) AS path, arg_min(dhash, ord) AS dhash, arg_min(singer, ord) AS singer, max(approved) AS approved, arg_min(subtype, ord) AS subtype, bool_or(subtype = 'general_broll') AS general, max(ord) AS ord FROM n GROUP BY 1),
a AS (SELECT s.id::VARCHAR AS id, CASE WHEN f.ord IS NOT NULL AND gone THEN f.path ELSE s.path END AS path, s.hash, coalesce(s.dhash, f.dhash) AS dhash, coalesce(s.singer, f.singer) AS singer, CASE WHEN f.ord IS NOT NULL THEN 1 ELSE active END AS active, greatest(s.approved, coalesce(f.approved, 0)) AS approved, CASE WHEN f.general THEN 'general_broll' ELSE s.subtype END AS subtype, CASE WHEN f.ord IS NOT NULL THEN TRUE END AS is_duplicate FROM s LEFT JOIN f ON s.hash = f.hash),
o AS (SELECT * FROM f WHERE hash NOT IN (SELECT hash FROM s)),
l AS (SELECT path, arg_max(hash, ord) AS hash, arg_max(approved, ord) AS approved, max_by(struct_pack(d := dhash), ord) AS dhash FROM o GROUP BY 1)
SELECT a.id, a.path, coalesce(l.hash, a.hash) AS hash, CASE WHEN l.path IS NOT NULL THEN l.dhash.d ELSE a.dhash END AS dhash, a.singer, CASE WHEN l.path IS NOT NULL THEN 1 ELSE a.active END AS active, CASE WHEN l.approved = 1 THEN 1 ELSE a.approved END AS approved, a.subtype, CASE WHEN l.path IS NOT NULL THEN TRUE ELSE a.is_duplicate END AS is_duplicate FROM a LEFT JOIN l ON a.path = l.path
UNION ALL SELECT 'n-' || left(md5(hash), 12), path, hash, dhash, singer, 1, approved, CASE WHEN general THEN 'general_broll' ELSE subtype END, FALSE FROM o WHERE path NOT IN (SELECT path FROM a)"""


@query(_REGISTER)
def register_batch(spark: SparkSession, d: str) -> DataFrame:
    """Registrations by content, then by path, then as new rows; each file comes twice."""
    k, size, r = F.col("p_partkey"), F.col("p_size"), F.col("r")
    rows = load(spark, d, "part").filter(k % 2 == 0).select("p_partkey", "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("r"))
    general = size % 3 == r
    n = rows.select(
        (k * 2 + r).alias("ord"), F.concat(F.when(r == 1, "r/").when(k % 6 == 2, "q/").otherwise("p/"), _text(k)).alias("path"), F.concat(F.when(k % 6 == 4, "n").otherwise("h"), _text(k)).alias("hash"),
        F.when(size % 4 > 0, F.concat(F.lit("e"), _text(size))).alias("dhash"), F.when(r == 1, (size + 100).cast("long")).alias("singer"), general.cast("int").alias("approved"), F.when(general, "general_broll").otherwise("photo").alias("subtype"),
    )
    return g.register(_stored(spark, d), n)


_TAGS = "SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS tag FROM part"


@query(f"WITH a AS (SELECT DISTINCT * FROM ({_TAGS})), n AS (SELECT DISTINCT l_partkey AS id, CASE WHEN l_returnflag = 'A' THEN 'red' ELSE lower(l_linestatus) END AS tag FROM lineitem) SELECT id, tag, FALSE AS is_new FROM a UNION ALL SELECT id, tag, TRUE FROM (SELECT * FROM n EXCEPT SELECT * FROM a)")
def tags_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    new = load(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_returnflag") == "A", "red").otherwise(F.lower("l_linestatus")).alias("tag"))
    return g.insert_or_ignore(_tags(spark, d), new, ["id", "tag"])


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("tag")).distinct()


@query(f"""WITH w AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey * 3)::VARCHAR ELSE 'p/' || (s_suppkey * 5) END AS what FROM supplier), x AS (SELECT p_partkey AS id FROM part WHERE p_partkey::VARCHAR IN (SELECT what FROM w) OR 'p/' || p_partkey IN (SELECT what FROM w))
SELECT 'media' AS name, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT id FROM x) UNION ALL SELECT 'tags', count(*) FROM (SELECT DISTINCT * FROM ({_TAGS})) WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT 'usage', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM x)""")
def delete_with_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What is left of media, tags and usage after deletes by id (digits) or by path."""
    k = F.col("s_suppkey")
    wanted = load(spark, d, "supplier").select(F.when(k % 2 == 0, _text(k * 3)).otherwise(F.concat(F.lit("p/"), _text(k * 5))).alias("what"))
    media = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p/"), _text("p_partkey")).alias("path"))
    left = g.delete_cascade(media, _tags(spark, d), load(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), wanted)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("media", left[0]).unionByName(one("tags", left[1])).unionByName(one("usage", left[2]))


@query("""WITH s AS (SELECT p_partkey AS id, 'p/' || p_partkey AS path, 'h' || p_partkey AS hash FROM part WHERE p_partkey % 3 <> 0), u AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
n AS (SELECT 'p/' || p_partkey AS path, CASE WHEN p_partkey % 10 = 0 THEN 'y' ELSE 'x' END || p_partkey AS hash FROM part WHERE p_partkey % 5 = 0),
m AS (SELECT s.id::VARCHAR AS id, path, hash, coalesce(u.n, 0) AS use_count, (SELECT len(list_distinct(string_split(p_name, ' '))) FROM part WHERE p_partkey = s.id) AS tags, coalesce(u.n, 0) AS uses FROM s LEFT JOIN u ON u.id = s.id WHERE path NOT IN (SELECT path FROM n)
UNION ALL SELECT 'n-' || left(md5(hash), 12), path, hash, 0, 0, 0 FROM n) SELECT * FROM m""")
def replace_media(spark: SparkSession, d: str) -> DataFrame:
    """Files written again to their paths: the older entries go with their tags and usage, the new ones begin unused; the last of two writes stays."""
    k = F.col("p_partkey")
    usage = load(spark, d, "lineitem").select(F.col("l_partkey").alias("id"))
    used = usage.groupBy("id").agg(F.count("*").alias("n"))
    media = load(spark, d, "part").filter(k % 3 != 0).select(k.alias("id"), F.concat(F.lit("p/"), _text(k)).alias("path"), F.concat(F.lit("h"), _text(k)).alias("hash"))
    media = media.join(used, "id", "left").select("id", "path", "hash", F.coalesce("n", F.lit(0).cast("long")).alias("use_count"))
    tags = load(spark, d, "part").select(k.alias("id"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("tag"))
    writes = load(spark, d, "part").filter(k % 5 == 0).select(F.explode(F.when(k % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("ord"), "p_partkey")
    incoming = writes.select("ord", F.concat(F.lit("p/"), _text(k)).alias("path"), F.concat(F.when(F.col("ord") == 2, "y").otherwise("x"), _text(k)).alias("hash"))
    media, tags, usage = g.replace_on_path(media, tags, usage, incoming)
    count = lambda t, name: t.groupBy("id").agg(F.count("*").alias(name))
    whole = media.join(count(tags, "tags"), "id", "left").join(count(usage, "uses"), "id", "left")
    return whole.select("id", "path", "hash", "use_count", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("tags", "uses")])


@query("SELECT doc_id, sha256(text || CASE WHEN doc_id % 7 = 0 THEN ' (edited)' ELSE '' END) AS file_hash, doc_id % 7 = 0 AS changed FROM documents")
def rehash(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes after an edit, and which of them changed."""
    edited = load(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")).alias("now"))
    of = lambda x: F.sha2(F.col(x).cast("binary"), 256)
    return edited.select("doc_id", of("now").alias("file_hash"), (of("now") != of("text")).alias("changed"))


@query("SELECT p_partkey AS id, p_size >= 25 AS was_listed, list_aggregate(CASE WHEN lower(split_part(p_type, ' ', 1)) = split_part(p_name, ' ', 1) THEN [lower(split_part(p_type, ' ', 1)), 'general_broll', 'approved', split_part(p_name, ' ', 2)] ELSE [lower(split_part(p_type, ' ', 1)), 'general_broll', 'approved', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] END, 'string_agg', ',') AS tags, 1 AS favorite, 1 AS approved FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def approve_media(spark: SparkSession, d: str) -> DataFrame:
    """Approval: the category and two fixed tags come first, then the given ones, each once."""
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    rows = load(spark, d, "part").filter(word(1) != word(2))
    tags = sel.approval_tags(F.split_part("p_type", F.lit(" "), F.lit(1)), F.split("p_name", " "))
    return rows.select(F.col("p_partkey").alias("id"), (F.col("p_size") >= 25).alias("was_listed"), F.array_join(tags, ",").alias("tags"), F.lit(1).alias("favorite"), F.lit(1).alias("approved"))


_QA = """q AS (SELECT l.doc_id, source, round_even(length(text) / 7.0, 2) AS total, to_json({'severity': CASE WHEN quality = 0 THEN 'high' ELSE 'low' END, 'singer': '가수', 'toxic': toxic})::VARCHAR AS issues_json FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


@query(f"WITH {_QA} SELECT doc_id, total, issues_json, issues_json->>'severity' AS severity, (issues_json->>'toxic')::INT AS toxic, rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM q) WHERE rn <= 10")
def qa_history(spark: SparkSession, d: str) -> DataFrame:
    """Reviews appended with scores of two places and their issues as JSON; the newest of each source, parsed again."""
    j = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    issues = F.to_json(F.struct(F.when(F.col("quality") == 0, "high").otherwise("low").alias("severity"), F.lit("가수").alias("singer"), "toxic"))
    q = j.select("doc_id", "source", F.bround(F.length("text") / F.lit(7.0), 2).alias("total"), issues.alias("issues_json"))
    r = c.recent_n(q, 10, key="source", order=[F.desc("doc_id")])
    back = F.from_json("issues_json", "severity string, toxic int")
    return r.select("doc_id", "total", "issues_json", back["severity"].alias("severity"), back["toxic"].alias("toxic"), "rn")


@query("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) || ',' || left(n_name, 3) ELSE '' END AS before, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) || ',' || left(n_name, 3) ELSE n_name || ' fans' END AS aliases FROM nation")
def alias_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Aliases given with a known name are taken only where it has none."""
    before = F.when(F.col("n_nationkey") % 3 == 0, F.concat_ws(",", F.lower("n_name"), F.left("n_name", F.lit(3)))).otherwise("")
    rows = load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), before.alias("before"))
    return rows.withColumn("aliases", sel.first_given("before", F.concat("name", F.lit(" fans"))))


@query("""WITH k AS (SELECT n_nationkey::BIGINT AS id, lower(n_name) AS k, lower(replace(n_name, '_', '-')) AS a FROM nation), w AS (SELECT upper(n_name) AS name FROM nation UNION SELECT replace(n_name, '_', '-') FROM nation UNION SELECT s_name FROM supplier UNION SELECT upper(s_name) FROM supplier),
f AS (SELECT name, lower(name) AS k, coalesce((SELECT min(id) FROM k WHERE k.k = lower(w.name)), (SELECT min(id) FROM k WHERE k.a = lower(w.name))) AS id FROM w),
n AS (SELECT k, row_number() OVER (ORDER BY left(md5(k), 3), k) AS r FROM (SELECT DISTINCT k FROM f WHERE id IS NULL)) SELECT name, coalesce(f.id, (SELECT max(id) FROM k) + r) AS id FROM f LEFT JOIN n ON f.k = n.k""")
def names_to_ids(spark: SparkSession, d: str) -> DataFrame:
    """Known names and aliases keep their ids, whatever the case; all others get the next ones."""
    nation, supplier = load(spark, d, "nation"), load(spark, d, "supplier")
    dashed = F.replace(F.col("n_name"), F.lit("_"), F.lit("-"))
    known = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.array(dashed).alias("aliases"))
    names = nation.select(F.upper("n_name").alias("name")).union(nation.select(dashed)).union(supplier.select("s_name")).union(supplier.select(F.upper("s_name")))
    return c.get_or_create(names, known)


# --- near duplicates of new photos among stored ones ---


@query(f"""WITH b AS (SELECT vec_id, {plans._BITS} AS bits FROM embeddings), n AS (SELECT vec_id, list_transform(bits, lambda x, i: CASE WHEN i <= 3 THEN 1 - x ELSE x END) AS bits FROM b WHERE vec_id % 10 = 0)
SELECT n.vec_id + 1000000 AS a, b.vec_id AS b, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN n.bits[i] <> b.bits[i] THEN 1 ELSE 0 END))::BIGINT AS distance FROM n, b WHERE distance <= 5""")
def near_dup_stored(spark: SparkSession, d: str) -> DataFrame:
    """New photos (here: stored ones with three bits turned over) against all stored ones: at most 5 of 63 bits differ, so one of 6 blocks agrees."""
    new = plans._bit_words(spark, d, blocks=6, flipped=3).filter("vec_id % 10 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return g.hamming_between(new, plans._bit_words(spark, d, blocks=6), 5, key="vec_id", words=["w1", "w2"], blocks=[f"k{i}" for i in range(6)])


# --- choice of candidates ---


@query("SELECT p_partkey FROM part WHERE p_size * 12 >= 280 AND p_retailprice / 4 >= 200 AND NOT (p_size * 12 <= 64 AND p_retailprice / 4 <= 64) AND p_type <> 'PROMO'")
def photo_filter(spark: SparkSession, d: str) -> DataFrame:
    """Large enough, no icon, no flat graphic (here: a kind of parts)."""
    return load(spark, d, "part").filter(sel.valid_photo(F.col("p_size") * 12, F.col("p_retailprice") / 4, F.col("p_type") == "PROMO")).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity * 30 BETWEEN 5 AND 1200")
def clip_range(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").filter(sel.usable_length(F.col("l_quantity") * 30)).select("l_orderkey", "l_linenumber", "l_partkey")


_FILES = "f AS (SELECT l_orderkey AS video, row_number() OVER (PARTITION BY l_orderkey ORDER BY {o}) AS pos, CASE WHEN l_returnflag = 'A' THEN 'webm' ELSE 'video/mp4' END AS kind, (l_quantity * 40)::BIGINT AS height, (l_partkey % 50 * 40)::BIGINT AS width, CASE WHEN l_linenumber % 3 > 0 THEN 'http://x/' || l_partkey END AS link FROM lineitem)".format(o=_ORDER)


@query(f"""WITH {_FILES}, a AS (SELECT *, kind LIKE '%mp4%' AS mp4, bool_or(kind LIKE '%mp4%') OVER (PARTITION BY video) AS any4 FROM f), b AS (SELECT *, height >= width AS tall, bool_or(height >= width) OVER (PARTITION BY video) AS anytall FROM a WHERE mp4 OR NOT any4),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN height = 1920 AND width = 1080 THEN 1000 WHEN height >= 1080 THEN 500 WHEN height >= 720 THEN 300 ELSE height END DESC, pos) AS rn FROM b WHERE tall OR NOT anytall) SELECT video, pos, link FROM r WHERE rn = 1 AND link IS NOT NULL""")
def file_pick(spark: SparkSession, d: str) -> DataFrame:
    """Of a video's files: mp4 before others, portrait before landscape, then by resolution, the first of equals; without a link none."""
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ITEM)).cast("long")
    k = F.col("l_partkey")
    f = load(spark, d, "lineitem").withColumn("pos", pos).select(F.col("l_orderkey").alias("video"), "pos", F.when(F.col("l_returnflag") == "A", "webm").otherwise("video/mp4").alias("kind"), (F.col("l_quantity") * 40).cast("long").alias("height"), (k % 50 * 40).alias("width"), F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("http://x/"), _text(k))).alias("link"))
    best = f.groupBy("video").agg(F.min(sel.file_rank(f)).alias("m"))
    return best.select("video", "m.pos", "m.link").filter("link is not null")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 30 THEN 'L' || l_partkey WHEN l_discount > 0.03 THEN 'M' || l_partkey WHEN l_tax > 0.02 THEN 'S' || l_partkey END AS url FROM lineitem")
def size_pick(spark: SparkSession, d: str) -> DataFrame:
    """The first of large, medium and small that has an address (an empty one is none)."""
    k = _text("l_partkey")
    one = lambda ok, name: F.when(ok, F.concat(F.lit(name), k)).otherwise("")
    url = sel.first_given(one(F.col("l_quantity") > 30, "L"), one(F.col("l_discount") > 0.03, "M"), one(F.col("l_tax") > 0.02, "S"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", url.alias("url"))


@query("SELECT user_id, max(ts) AS newest, arg_max(event_id, (ts, -event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1")
def newest_file(spark: SparkSession, d: str) -> DataFrame:
    """The newest by time of change, the first id of equals."""
    m = load(spark, d, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.max(F.struct("ts", (-F.col("event_id")).alias("e"))).alias("m"))
    return m.select("user_id", F.col("m.ts").alias("newest"), (-F.col("m.e")).alias("event_id"))


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, md5('7-' || p_partkey), p_partkey) AS place FROM part")
def score_groups(spark: SparkSession, d: str) -> DataFrame:
    return g.shuffled_groups(load(spark, d, "part").select("p_partkey", "p_size"), score="p_size", key="p_partkey", seed=7)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'n' || s_nationkey ELSE 'unknown' END AS channel, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0.0 END AS duration FROM supplier")
def projection_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Renamed fields with fall-backs; an empty text counts as missing."""
    k = F.col("s_suppkey")
    up, ch = F.when(k % 3 == 0, F.col("s_name")).otherwise(""), F.when(k % 3 == 1, F.concat(F.lit("n"), _text("s_nationkey"))).otherwise("")
    return load(spark, d, "supplier").select("s_suppkey", sel.first_given(up, ch, F.lit("unknown")).alias("channel"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("duration"))


# --- texts ---

_PLAIN = "list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: trim(x)), lambda x: length(x) > 20 AND NOT regexp_matches(x, 'license|copyright|Menu'))"


@query(f"SELECT doc_id, coalesce(l[1], 'one of ' || source) AS first, coalesce(l[2], 'two') AS second, coalesce(l[3], 'three') AS third FROM (SELECT doc_id, source, {_PLAIN} AS l FROM documents)")
def lead_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The first three sentences that say something, with a default for each place."""
    kept = sel.telling_sentences(F.col("text"), ["license", "copyright", "Menu"])
    at = lambda i, default: F.coalesce(F.try_element_at("l", F.lit(i)), default)
    return load(spark, d, "documents").select("doc_id", "source", kept.alias("l")).select("doc_id", at(1, F.concat(F.lit("one of "), "source")).alias("first"), at(2, F.lit("two")).alias("second"), at(3, F.lit("three")).alias("third"))


@query(r"SELECT conv_id, turn, regexp_replace('[' || role || '] ' || replace(replace(text, chr(10), ' '), '.', ' (pause) '), '\[.*?\]|\(.*?\)', '', 'g') AS spoken FROM conversations")
def spoken_text(spark: SparkSession, d: str) -> DataFrame:
    cued = F.concat(F.lit("["), "role", F.lit("] "), F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("."), F.lit(" (pause) ")))
    return load(spark, d, "conversations").select("conv_id", "turn", sel.without_cues(cued).alias("spoken"))


@query("SELECT doc_id, 'Title: ' || left(text, 45) || '; script: ' || left(replace(text, '{title}', ''), 3000) || '; by ' || source AS prompt FROM documents")
def prompt_fill(spark: SparkSession, d: str) -> DataFrame:
    """A template filled by literal replaces with texts cut to their lengths."""
    fields = {"title": F.left("text", F.lit(45)), "script": F.left(F.replace(F.col("text"), F.lit("{title}"), F.lit("")), F.lit(3000)), "source": F.col("source")}
    return load(spark, d, "documents").select("doc_id", sel.filled("Title: {title}; script: {script}; by {source}", fields).alias("prompt"))


_NAMES = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '가수 임영웅 신곡' WHEN 1 THEN '오늘 송가인 가수 등장' WHEN 2 THEN '박서진의 무대' ELSE p_name END AS text FROM part"


@query(f"SELECT p_partkey, coalesce(nullif(regexp_extract(text, '가수\\s+([가-힣]{{2,4}})', 1), ''), nullif(regexp_extract(text, '([가-힣]{{2,4}})\\s+가수', 1), '')) AS by_word, nullif(regexp_extract(left(text, 80), '^([가-힣]{{2,4}})(?:이|가|의|은|는)?\\s*(?:가수|콘서트|신곡|무대|소속사)', 1), '') AS by_opening FROM ({_NAMES})")
def name_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Names beside the word for singer, or at the opening of a text."""
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, "가수 임영웅 신곡").when(k == 1, "오늘 송가인 가수 등장").when(k == 2, "박서진의 무대").otherwise(F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", sel.name_by_word(F.col("x")).alias("by_word"), sel.name_by_opening(F.col("x")).alias("by_opening"))


_SRC = "SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN '//cdn.x/a.PNG' WHEN 1 THEN '/img/' || page_id || '.jpeg?w=1' WHEN 2 THEN 'https://y.z/b.gif' ELSE url END AS src FROM pages"


@query(f"SELECT page_id, u AS address, CASE WHEN regexp_matches(p, '\\.(jpg|jpeg|png)$') THEN regexp_extract(p, '(\\.[a-z]+)$', 1) ELSE '.jpg' END AS extension FROM (SELECT page_id, u, lower(regexp_replace(u, '[?#].*$', '')) AS p FROM (SELECT page_id, CASE WHEN src LIKE '//%' THEN 'https:' || src WHEN src LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || src ELSE src END AS u FROM ({_SRC})))")
def image_address(spark: SparkSession, d: str) -> DataFrame:
    """Whole addresses of images, and an extension of a white list."""
    k = F.col("page_id") % 4
    src = F.when(k == 0, "//cdn.x/a.PNG").when(k == 1, F.concat(F.lit("/img/"), _text("page_id"), F.lit(".jpeg?w=1"))).when(k == 2, "https://y.z/b.gif").otherwise(F.col("url"))
    u = m.absolute_url(src, F.col("url"))
    return load(spark, d, "pages").select("page_id", u.alias("address")).withColumn("extension", sel.image_extension(F.col("address")))


@query("SELECT page_id, list_aggregate(list_filter(l, lambda x, i: list_position(l, x) = i), 'string_agg', ' ') AS ids FROM (SELECT page_id, regexp_extract_all(html, 'href=\"/([A-Za-z]{2,11})\"', 1) AS l FROM pages)")
def page_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids in a page's source, each once, in their order."""
    ids = F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]{2,11})"'), 1))
    return load(spark, d, "pages").select("page_id", F.when(F.size(ids) > 0, F.array_join(ids, " ")).alias("ids"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'k' || (props->>'k') WHEN event_id % 4 = 1 THEN event_type WHEN event_id % 4 = 2 THEN 'bare text' END AS hook FROM events")
def first_key(spark: SparkSession, d: str) -> DataFrame:
    """The first of the known keys that a JSON object has with a text that is not blank; a JSON string itself; else nothing."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.to_json(F.struct(F.lit(" ").alias("hook"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("title")))).when(k == 1, F.to_json(F.struct(F.col("event_type").alias("first_sentence"), F.lit("no").alias("script")))).when(k == 2, '"bare text"').otherwise("{broken")
    return load(spark, d, "events").select("event_id", sel.first_text_key(raw, ["hook", "first_sentence", "title", "script", "shorts_script"]).alias("hook"))


_TIMELINE = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 0 WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_custkey % 5 < 2 THEN 1 ELSE 0 END ELSE 3 END AS n FROM orders"


@query(f"SELECT o_orderkey, n::BIGINT AS n_segments FROM ({_TIMELINE})")
def timeline_source(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a timeline file: a bare list; or an object's, if its video has this name or nearly this length."""
    k, off = F.col("o_orderkey") % 4, F.col("o_custkey") % 5
    seg = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("start")))
    named = F.to_json(F.struct(F.concat(F.lit("/a/b/"), _text("o_orderkey"), F.lit(".mp4")).alias("video_path"), F.lit(1.0).alias("total_duration"), seg(2).alias("segments")))
    near = F.to_json(F.struct(F.lit("/c/other.mp4").alias("video_path"), (F.lit(60.0) + off).alias("total_duration"), seg(1).alias("segments")))
    raw = F.when(k == 0, named).when(k == 1, near).when(k == 2, F.to_json(seg(3))).otherwise("{")
    rows = load(spark, d, "orders").select("o_orderkey", raw.alias("raw"), F.concat(_text("o_orderkey"), F.lit(".mp4")).alias("name"))
    return rows.select("o_orderkey", F.size(sel.timeline_segments(F.col("raw"), F.col("name"), F.lit(60.0))).cast("long").alias("n_segments"))


# --- plans and scores ---


@query("SELECT l_orderkey, string_agg('  - Cut ' || lpad((pos - 1)::VARCHAR, 2, '0') || ' (' || lpad(printf('%.1f', (pos - 1) * 2.8), 4, ' ') || 's~' || lpad(printf('%.1f', pos * 2.8), 4, ' ') || 's) ' || rpad(CASE WHEN l_returnflag = 'R' THEN '[' || l_linestatus || ']' ELSE '[사진]' END, 10, ' ') || ' | ' || left('part ' || l_partkey || ' of supplier number ' || l_suppkey || ' and more', 35), chr(10) ORDER BY pos) AS plan FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + _ORDER + ") AS pos FROM lineitem) GROUP BY 1")
def plan_text(spark: SparkSession, d: str) -> DataFrame:
    """A plan's cuts as lines for people."""
    words = F.concat(F.lit("part "), _text("l_partkey"), F.lit(" of supplier number "), _text("l_suppkey"), F.lit(" and more"))
    rows = load(spark, d, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ITEM)))
    line = sel.cut_line(F.col("pos") - 1, F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")), words)
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("plan"))


_CUTS = """v AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS images, count(*) FILTER (l_returnflag = 'R') AS videos FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag <> 'R') > 0),
w AS (SELECT *, CASE WHEN 2.0 + videos * 12.0 + images * 2.0 > 40 THEN greatest(2.0, (40 - 2.0 - images * 2.0) / greatest(1, videos)) ELSE 12.0 END::DOUBLE AS clip_dur FROM v),
x AS (SELECT *, greatest(images * 2.0, 40 - 2.0 - videos * clip_dur)::DOUBLE AS rest FROM w), y AS (SELECT *, greatest(images, round_even(rest / 2.8, 0)::BIGINT) AS cuts FROM x)"""


@query(f"WITH {_CUTS} SELECT l_orderkey, clip_dur, cuts, rest / cuts AS img_dur, (i - 1) AS cut, (i - 1) % images AS image, (i - 1) % 6 AS motion FROM y, unnest(range(1, cuts + 1)) AS g(i)")
def cut_plan(spark: SparkSession, d: str) -> DataFrame:
    """40 s shared out: 2 s of title, clips of 12 s or what is left for them, and images in cuts of about 2.8 s, with six motions in turn."""
    v = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("images"), F.count_if(F.col("l_returnflag") == "R").alias("videos")).filter("images > 0")
    x = v.select("l_orderkey", "images", sel.shared_out(F.col("images"), F.col("videos"), 40.0, 12.0).alias("p")).select("l_orderkey", "images", "p.*")
    return x.select("l_orderkey", "clip_dur", "cuts", "img_dur", "images", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut")).select("l_orderkey", "clip_dur", "cuts", "img_dur", "cut", (F.col("cut") % F.col("images")).alias("image"), (F.col("cut") % 6).alias("motion"))


_ISSUE = """SELECT doc_id, i AS place, CASE i WHEN 1 THEN 'error' WHEN 2 THEN 'info' ELSE 'warning' END AS kind, component, CASE doc_id % 6 WHEN 0 THEN '자막 too long' WHEN 1 THEN 'photo again' WHEN 2 THEN 'broll again' WHEN 3 THEN '후킹 문장' WHEN 4 THEN 'nothing known' ELSE 'Number differs' END AS message
FROM labels, (VALUES (1, 'technical'), (2, 'factual'), (3, 'repetition'), (4, 'ai_review')) v(i, component) WHERE doc_id % 5 <> i"""


@query(f"""SELECT doc_id, place, component, CASE kind WHEN 'error' THEN 'high' WHEN 'info' THEN 'low' ELSE 'medium' END AS severity, t AS issue_type, t IN ('caption_overflow', 'photo_repetition', 'broll_repetition', 'hook_repetition', 'number_discrepancy') AS repairable,
CASE t WHEN 'caption_overflow' THEN 'caption_resize' WHEN 'photo_repetition' THEN 'replace_photo' WHEN 'broll_repetition' THEN 'replace_broll' WHEN 'hook_repetition' THEN 'rephrase_script' WHEN 'number_discrepancy' THEN 'rephrase_script' END AS action
FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'caption_overflow' WHEN 1 THEN 'photo_repetition' WHEN 2 THEN 'broll_repetition' WHEN 3 THEN 'hook_repetition' WHEN 4 THEN component || '_issue' ELSE 'number_discrepancy' END AS t FROM ({_ISSUE}))""")
def issue_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Issues of four checks in their order, with severity, kind by the first word that fits, and the repair."""
    k = F.col("doc_id") % 6
    message = F.when(k == 0, "자막 too long").when(k == 1, "photo again").when(k == 2, "broll again").when(k == 3, "후킹 문장").when(k == 4, "nothing known").otherwise("Number differs")
    one = lambda kind, name: F.when(F.col("doc_id") % 5 != {"technical": 1, "factual": 2, "repetition": 3, "ai_review": 4}[name], F.array(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("component"), message.alias("message")))).otherwise(F.array().cast("array<struct<kind:string,component:string,message:string>>"))
    # the producers' lists, one after the other; places are those of the producers
    lists = F.array(one("error", "technical"), one("info", "factual"), one("warning", "repetition"), one("warning", "ai_review"))
    rows = load(spark, d, "labels").select("doc_id", F.posexplode(lists).alias("p", "l")).select("doc_id", (F.col("p") + 1).alias("place"), F.explode("l").alias("i"))
    kind = s.known_issue(F.col("i.message"), F.col("i.component"))
    return rows.select("doc_id", "place", F.col("i.component").alias("component"), s.severity(F.col("i.kind")).alias("severity"), kind.alias("issue_type")).withColumn("repairable", s.repair_action(F.col("issue_type")).isNotNull()).withColumn("action", s.repair_action(F.col("issue_type")))


_SCORES = "SELECT doc_id, (length(text) % 21)::DOUBLE AS tech, (length(text) % 31)::DOUBLE AS fact, (length(text) % 26)::DOUBLE AS rep, quality, toxic FROM labels l JOIN documents d USING (doc_id)"
_STATUS = f"SELECT *, CASE WHEN toxic = 1 OR tech + fact + rep + 25 * quality < 70 THEN 'FAIL' WHEN doc_id % 7 = 0 THEN 'WARNING' WHEN tech + fact + rep + 25 * quality < 90 THEN 'WARNING' ELSE 'PASS' END AS status FROM ({_SCORES})"


@query(f"""SELECT doc_id, status, concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'review_not_run' END, CASE status WHEN 'PASS' THEN 'upload' WHEN 'WARNING' THEN 'look_first' ELSE 'mend' END, CASE WHEN tech < 15 THEN 'check_technical' END, CASE WHEN fact < 22 THEN 'check_facts' END, CASE WHEN rep < 18 THEN 'check_freshness' END, CASE WHEN doc_id % 3 = 0 THEN 'shorter' END) AS advice FROM ({_STATUS})""")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """What to do, by rules in their order, and what the reviewer adds that is not there yet."""
    r = _scores(spark, d)
    extra = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" shorter "), F.lit("shorter"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    return r.select("doc_id", "status", F.array_join(s.advice(F.col("status"), F.col("doc_id") % 7 == 0, F.col("tech"), F.col("fact"), F.col("rep"), extra), ",").alias("advice"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    r = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "toxic", "quality", (n % 21).cast("double").alias("tech"), (n % 31).cast("double").alias("fact"), (n % 26).cast("double").alias("rep"))
    total = s.clamp_total([F.col("tech"), F.col("fact"), F.col("rep"), F.col("quality") * F.lit(25.0)], 100.0)
    return r.withColumn("status", s.verdict(total, F.col("toxic") == 1, F.col("doc_id") % 7 != 0))


@query(f"SELECT doc_id, tech >= 14 AND quality = 1 AS technical, fact >= 21 AND toxic = 0 AS factual, rep >= 18 AND rep >= 17.5 AS repetition FROM ({_SCORES})")
def upload_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate before an upload: as strict as the checks, and stricter on repetition; no error among the technical issues."""
    r = _scores(spark, d)
    gate = s.upload_gate(F.lit(True), F.col("tech"), F.col("quality") == 0, F.col("toxic") == 0, F.col("fact"), F.col("rep") >= 17.5, F.col("rep"))
    return r.select("doc_id", gate.alias("g")).select("doc_id", "g.*")


_TECH = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN kb < 10 THEN 0 ELSE 3 END + CASE WHEN l_returnflag <> 'A' THEN 3 ELSE 0 END + CASE WHEN q = 27 THEN 5 WHEN q > 20 THEN 4 ELSE 0 END + CASE WHEN fps BETWEEN 29 AND 31 THEN 2 WHEN fps BETWEEN 24 AND 61 THEN 1.5 WHEN fps > 0 THEN 0.5 ELSE 0 END + CASE WHEN q > 5 THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END
 + CASE WHEN gap <= 2.5 THEN 2 WHEN gap <= 5 THEN 1 ELSE 0 END + CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END + CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END AS raw, kb < 10 OR l_returnflag = 'A' OR gap > 5 AS critical
FROM (SELECT *, l_quantity AS q, l_extendedprice / 100 AS kb, l_suppkey % 70 AS fps, l_discount * 100 AS gap FROM lineitem)"""


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN critical THEN least(12, raw) ELSE raw END)::DOUBLE AS score, critical, NOT critical AND raw >= 14 AS passed FROM ({_TECH})")
def technical_whole(spark: SparkSession, d: str) -> DataFrame:
    """All 20 points: file, decoding, resolution, frame rate, length, sound, sync, subtitles, assets; a grave fault caps them at 12."""
    q, k = F.col("l_quantity"), F.col("l_partkey")
    half = lambda x: F.when(x % 3 == 0, 1.0).when(x % 3 == 1, 0.5).otherwise(0.0)
    whole = s.technical_total(F.col("l_extendedprice") / 100, F.col("l_returnflag") != "A", F.when(q == 27, 1080).otherwise(900), F.when(q == 27, 1920).when(q > 20, 1000).otherwise(800), F.col("l_suppkey") % 70, q, F.col("l_linestatus") == "F", F.col("l_discount") * 100, half(F.col("l_linenumber")), half(k))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", whole.alias("w")).select("l_orderkey", "l_linenumber", "l_partkey", "w.*")
