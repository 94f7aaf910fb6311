"""Catalogue queries on the test tables: parts stand for media, line items for their use, orders for projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import scoring as s
from loomwork.operators import catalogue as c
from loomwork.sources.scratch import scratch_folder
from loomwork.sources.tables import load
from loomwork.streaming import cache

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _usage(spark: SparkSession, d: str) -> DataFrame:
    facts = load(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return c.usage_state(load(spark, d, "part"), facts, media_id="p_partkey", fact_id="l_partkey", at="o_orderdate").withColumn("favorite", (F.col("p_size") >= 40).cast("int"))


USAGE_SQL = """WITH u AS (SELECT l_partkey, count(*) AS use_count, max(o_orderdate) AS last_used_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey),
m AS (SELECT p.*, coalesce(u.use_count, 0)::BIGINT AS use_count, u.last_used_at, (p_size >= 40)::INT AS favorite FROM part p LEFT JOIN u ON p_partkey = l_partkey) """
_LEAST = "use_count ASC, last_used_at ASC NULLS FIRST, favorite DESC, p_partkey"


@query(USAGE_SQL + f"SELECT p_partkey, use_count, last_used_at, favorite FROM m ORDER BY {_LEAST} LIMIT 30")
def least_used_topk(spark: SparkSession, d: str) -> DataFrame:
    return c.least_used_first(_usage(spark, d).select("p_partkey", "use_count", "last_used_at", "favorite"), 30, favorite="favorite", tie="p_partkey")


@query("""SELECT count(*) AS n_media, count(*) FILTER (p_type = 'PROMO') AS n_promo, count(*) FILTER (p_type = 'PROMO' OR p_size > 25) AS n_broll,
count(*) FILTER (p_name LIKE '%ring%') AS n_ring, count(DISTINCT p_brand) AS n_brands, count(*) FILTER (p_retailprice >= 1000) AS n_costly, count(*) FILTER (p_size <= 10) AS n_small FROM part""")
def media_stats(spark: SparkSession, d: str) -> DataFrame:
    n = lambda e, a: F.count_if(F.expr(e)).alias(a)
    return load(spark, d, "part").agg(F.count("*").alias("n_media"), n("p_type = 'PROMO'", "n_promo"), n("p_type = 'PROMO' or p_size > 25", "n_broll"), n("contains(p_name, 'ring')", "n_ring"), F.countDistinct("p_brand").alias("n_brands"), n("p_retailprice >= 1000", "n_costly"), n("p_size <= 10", "n_small"))


@query("SELECT p_partkey, p_type FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 60 DAY FROM orders))")
def exclude_recent_project(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    edge = orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 60 DAYS")).alias("edge"))
    recent = orders.join(F.broadcast(edge), F.col("o_orderdate") >= F.col("edge"), "left_semi")
    used = load(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(recent, F.col("l_orderkey") == F.col("o_orderkey"))
    return c.exclude_used(load(spark, d, "part").select("p_partkey", "p_type"), used, "p_partkey", "l_partkey")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE len(list_intersect(string_split(lower(p_name), ' '), ['ring', 'widget'])) > 0 AND p_size <= 30")
def tag_search_semi(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    tags = part.select("p_partkey", F.explode(c.tag_list(F.col("p_name"))).alias("tag"))
    return c.any_tag(c.where_all(part, F.col("p_size") <= 30, None), tags, ["ring", "Widget"], key="p_partkey").select("p_partkey", "p_name", "p_brand")


_APPROVED = "(favorite = 1 OR p_type = 'PROMO' OR p_brand IN ('Brand#1', 'Brand#2'))"
_LIVE = "p_partkey % 3 <> 0"


@query(USAGE_SQL + f"SELECT p_partkey, use_count FROM (SELECT * FROM m WHERE {_APPROVED} ORDER BY {_LEAST} LIMIT 50) WHERE {_LIVE}")
def approved_by_category(spark: SparkSession, d: str) -> DataFrame:
    """The limit comes before the liveness filter."""
    return c.least_used_first(_usage(spark, d).filter(_APPROVED), 50, favorite="favorite", tie="p_partkey").filter(_LIVE).select("p_partkey", "use_count")


@query(USAGE_SQL + f"SELECT p_partkey, use_count FROM (SELECT * FROM m WHERE {_APPROVED} AND {_LIVE} ORDER BY {_LEAST} LIMIT 50)")
def filter_then_limit(spark: SparkSession, d: str) -> DataFrame:
    """The liveness filter comes before the limit; liveness is a semi join with the live keys."""
    media = _usage(spark, d).filter(_APPROVED)
    live = load(spark, d, "part").filter(_LIVE).select("p_partkey")
    return c.least_used_first(media.join(live, "p_partkey", "left_semi"), 50, favorite="favorite", tie="p_partkey").select("p_partkey", "use_count")


_RECENT = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders"


@query(f"SELECT o_custkey, o_orderkey, rn FROM ({_RECENT}) WHERE rn <= 5")
def recent_projects_per_singer(spark: SparkSession, d: str) -> DataFrame:
    return c.recent_n(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), 5, key="o_custkey", order=[F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "rn")


@query(f"SELECT o_custkey, o_orderkey, count(*) AS n_media, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS media FROM ({_RECENT}) JOIN lineitem ON l_orderkey = o_orderkey WHERE rn <= 5 GROUP BY ALL")
def recent_projects_media(spark: SparkSession, d: str) -> DataFrame:
    """One join and a nested list in place of a query for each project."""
    recent = c.recent_n(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), 5, key="o_custkey", order=[F.desc("o_orderdate"), F.desc("o_orderkey")])
    items = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nested = items.join(recent, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    return nested.select("o_custkey", "o_orderkey", F.size("m").cast("long").alias("n_media"), F.array_join(F.transform("m", lambda x: x["l_partkey"].cast("string")), ",").alias("media"))


@query("""WITH w AS (SELECT DISTINCT replace(lower(n_name), 'nation_', '') AS alias FROM nation UNION SELECT lower(n_name) FROM nation),
h AS (SELECT alias, n_nationkey, CASE WHEN lower(n_name) = alias THEN 0 ELSE 1 END AS tier FROM w JOIN nation ON contains(lower(n_name), alias))
SELECT alias, n_nationkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY tier, n_nationkey) rn FROM h) WHERE rn = 1""")
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    wanted = nation.select(F.replace(F.lower("n_name"), F.lit("nation_"), F.lit("")).alias("alias")).union(nation.select(F.lower("n_name"))).distinct()
    return c.lookup_or_alias(wanted, nation.select("n_name", "n_nationkey"), want="alias", name="n_name", key="n_nationkey")


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_content(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash")).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")).filter("copies > 1")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS file_hash, lang, source FROM documents WHERE text IS NOT NULL),
o AS (SELECT file_hash, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, NULL::VARCHAR AS source FROM h WHERE doc_id % 2 = 0 GROUP BY 1),
n AS (SELECT file_hash, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM h WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT coalesce(o.file_hash, n.file_hash) AS file_hash, coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.lang, n.lang) AS lang, coalesce(o.source, n.source) AS source, o.file_hash IS NOT NULL AS was_known, o.file_hash IS NOT NULL AND n.file_hash IS NOT NULL AS is_duplicate
FROM o FULL JOIN n ON o.file_hash = n.file_hash""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    h = load(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), "lang", "source")
    first = Window.partitionBy("file_hash").orderBy("doc_id")
    old = h.filter("doc_id % 2 = 0").withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn").withColumn("source", F.lit(None).cast("string"))
    return c.merge_content(old, h.filter("doc_id % 2 = 1"), hash_col="file_hash", patch=["lang", "source"], tie="doc_id")


_CACHE = "SELECT user_id, event_type, event_id, ts, CASE WHEN (props->>'k')::INT % 10 = 0 THEN NULL ELSE ts + to_days((props->>'k')::INT) END AS expires FROM events"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").select("user_id", "event_type", "event_id", "ts", F.when(k % 10 != 0, F.col("ts") + F.make_dt_interval(k)).alias("expires"))


@query(f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM ({_CACHE}) WHERE expires IS NULL OR expires > TIMESTAMP '2024-02-15') WHERE rn = 1")
def cache_latest_valid(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2024-02-15").cast("timestamp_ntz")
    return c.latest_valid(_cache(spark, d), keys=["user_id", "event_type"], at="ts", expires="expires", as_of=as_of, tie="event_id").select("user_id", "event_type", "event_id")


@query(f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM ({_CACHE}) WHERE expires IS NULL OR expires > (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)) WHERE rn = 1")
def cache_stream(spark: SparkSession, d: str) -> DataFrame:
    """The cache as a stream over the events, asked at its last watermark: the newest version of each key that is valid then."""
    home, store = scratch_folder(spark, "cache"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        log = spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
        k = F.get_json_object("props", "$.k").cast("int")
        at = F.col("ts").cast("timestamp")
        versions = log.select("user_id", "event_type", "event_id", at.alias("ts"), F.when(k % 10 != 0, at + F.make_dt_interval(k)).alias("expires"))
        told = cache.valid_versions(versions, keys=["user_id", "event_type"], id="event_id", at="ts", expires="expires")
        # a batch that is run again after a failure writes the same folder again
        kept = told.writeStream.outputMode("update").option("checkpointLocation", f"{home}/progress").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{home}/told/{i}"))
        kept.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    answers = spark.read.parquet(f"{home}/told/*").groupBy("user_id", "event_type").agg(F.max_by("id", F.struct("batch", "asked")).alias("event_id"))
    return answers.filter("event_id is not null")


@query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, max(ts) AS updated_at, max(ts) + INTERVAL 30 DAY AS expires_at, count(*) AS versions FROM events GROUP BY ALL")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Appended versions folded to the newest for each key; it lives 30 days more."""
    e = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"), F.count("*").alias("versions"))
    return e.select("user_id", "event_type", "m.event_id", F.col("m.ts").alias("updated_at"), (F.col("m.ts") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"), "versions")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events),
n AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS newest FROM r),
s AS (SELECT user_id, max(newest) AS item, coalesce(min(CASE WHEN event_type <> newest THEN rn END) - 1, count(*))::BIGINT AS run_length FROM n GROUP BY 1)
SELECT *, CASE WHEN run_length >= 3 THEN 5 WHEN run_length = 2 THEN 3 ELSE 1 END AS deduction FROM s""")
def clip_reuse_streak(spark: SparkSession, d: str) -> DataFrame:
    s = c.streak(load(spark, d, "events"), key="user_id", item="event_type", order="ts", tie="event_id")
    return s.withColumn("deduction", F.when(F.col("run_length") >= 3, 5).when(F.col("run_length") == 2, 3).otherwise(1))


OVERLAP_SQL = f"""WITH o AS ({_RECENT}), cur AS (SELECT o_custkey, o_orderkey FROM o WHERE rn = 1), past AS (SELECT DISTINCT o_custkey, l_partkey FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE rn BETWEEN 2 AND 6),
c AS (SELECT cur.o_custkey, l_partkey FROM cur JOIN lineitem ON l_orderkey = o_orderkey),
g AS (SELECT c.o_custkey, count(*) AS n, count(past.l_partkey) AS dup FROM c LEFT JOIN past ON c.o_custkey = past.o_custkey AND c.l_partkey = past.l_partkey GROUP BY 1)
SELECT o_custkey, n, dup, CASE WHEN dup <= 1 THEN 0 WHEN round_even(100.0::DOUBLE * dup / n, 1) >= 50 THEN 10 WHEN round_even(100.0::DOUBLE * dup / n, 1) >= 20 THEN 4 ELSE 0 END AS deduction FROM g"""


@query(OVERLAP_SQL)
def photo_overlap_band(spark: SparkSession, d: str) -> DataFrame:
    """The look-back ends before the current project, so a project is never compared with itself."""
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ranked = c.recent_n(o, 6, key="o_custkey", order=[F.desc("o_orderdate"), F.desc("o_orderkey")])
    items = load(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(ranked, F.col("l_orderkey") == F.col("o_orderkey"))
    past = items.filter("rn >= 2").select("o_custkey", "l_partkey", F.lit(1).alias("hit")).distinct()
    g = items.filter("rn = 1").join(past, ["o_custkey", "l_partkey"], "left").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count("hit").alias("dup"))
    return g.withColumn("deduction", s.overlap_penalty(F.col("dup"), F.bround(F.lit(100.0) * F.col("dup") / F.col("n"), 1)).cast("int"))


@query("SELECT l_partkey, count(*) AS use_count, max(o_orderdate) AS last_used_at, count(DISTINCT o_custkey) AS n_projects FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return f.groupBy("l_partkey").agg(F.count("*").alias("use_count"), F.max("o_orderdate").alias("last_used_at"), F.countDistinct("o_custkey").alias("n_projects"))


_BITS = "list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN 1 ELSE 0 END)"
NEAR_SQL = f"""WITH b AS (SELECT vec_id, {_BITS} AS bits FROM embeddings)
SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN x.bits[i] <> y.bits[i] THEN 1 ELSE 0 END))::BIGINT AS distance FROM b x JOIN b y ON x.vec_id < y.vec_id WHERE distance <= """


def _bit_words(spark: SparkSession, d: str, blocks: int = 13, flipped: int = 0) -> DataFrame:
    """63 comparison bits of neighbours in two words, and disjoint blocks; the first ``flipped`` bits turned over."""
    e = load(spark, d, "embeddings")
    bits = F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: ((F.element_at("embedding", i) > F.element_at("embedding", i + 1)) != (i <= flipped)).cast("long"))
    word = lambda lo, hi: F.aggregate(F.slice(F.col("bits"), lo, hi - lo + 1), F.lit(0).cast("long"), lambda a, x: a * 2 + x)
    return e.select("vec_id", bits.alias("bits")).select("vec_id", word(1, 32).alias("w1"), word(33, 63).alias("w2"), *[word(63 * i // blocks + 1, 63 * (i + 1) // blocks).alias(f"k{i}") for i in range(blocks)])


@query(NEAR_SQL + "18")
def near_dup_hamming(spark: SparkSession, d: str) -> DataFrame:
    """A threshold too loose for equal parts of the bits: blocks of rows are compared, two at a time."""
    return c.hamming_pairs(_bit_words(spark, d), 18, key="vec_id", words=["w1", "w2"])


@query(NEAR_SQL + "12")
def near_dup_blocked(spark: SparkSession, d: str) -> DataFrame:
    """At most 12 of 63 bits differ, so one of 7 blocks of 9 bits agrees but for one bit: equi-joins, same rows as all pairs."""
    return c.hamming_pairs(_bit_words(spark, d, blocks=7), 12, key="vec_id", words=["w1", "w2"], blocks=[f"k{i}" for i in range(7)], width=9, radius=1)


_TIERS = """SELECT s_nationkey AS g, l_partkey AS k, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 ELSE 3 END AS tier FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


@query(f"""WITH t AS ({_TIERS}), b AS (SELECT g, k, min(tier) AS tier FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g, tier ORDER BY k) rn FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY tier, k) AS place FROM r WHERE rn <= CASE tier WHEN 1 THEN 12 WHEN 2 THEN 10 ELSE 8 END) SELECT g AS nation, k AS part, tier, place FROM p WHERE place <= 25""")
def tiered_quota_fill(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    rows = load(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").join(load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("nation"), F.col("l_partkey").alias("part"), tier.alias("tier")).distinct()
    return c.tiered_fill(rows, 25, group="nation", key="part", tier="tier", order=[F.asc("part")], caps={1: 12, 2: 10, 3: 8})


@query(f"WITH t AS ({_TIERS}) SELECT g AS nation, min(tier) AS tier, min(k) FILTER (tier = m) AS part FROM (SELECT *, min(tier) OVER (PARTITION BY g) m FROM t) GROUP BY 1")
def first_tier_hit(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    rows = load(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").join(load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    m = rows.groupBy(F.col("s_nationkey").alias("nation")).agg(F.min(F.struct(tier.alias("t"), "l_partkey")).alias("m"))
    return m.select("nation", F.col("m.t").alias("tier"), F.col("m.l_partkey").alias("part"))


#: Five tiers of a supplier's parts: (condition, cap).
CASCADE = [("l_returnflag = 'A' AND l_quantity >= 44", None), ("l_returnflag = 'A' AND l_discount >= 0.09", 12), ("l_returnflag = 'N' AND l_quantity >= 46", 10), ("l_returnflag = 'N'", 8), ("l_returnflag = 'R'", None)]


def _cascade_sql(ask: str) -> str:
    steps = [f"d0 AS (SELECT s_suppkey AS supplier, {ask} AS need FROM supplier)"]
    for i, (where, cap) in enumerate(CASCADE, 1):
        before = " UNION ALL ".join(f"SELECT supplier, part FROM t{j}" for j in range(1, i)) or "SELECT NULL::BIGINT AS supplier, NULL::BIGINT AS part WHERE FALSE"
        steps.append(f"t{i} AS (SELECT supplier, part, {i} AS tier, row_number() OVER (PARTITION BY supplier ORDER BY part) AS nth, need FROM (SELECT DISTINCT l_suppkey AS supplier, l_partkey AS part, need FROM lineitem JOIN d{i - 1} ON supplier = l_suppkey WHERE need > 0 AND {where} AND (l_suppkey, l_partkey) NOT IN ({before})) QUALIFY nth <= {f'least(need, {cap})' if cap else 'need'})")
        steps.append(f"d{i} AS (SELECT d.supplier, d.need - count(t.part) AS need FROM d{i - 1} d LEFT JOIN t{i} t ON t.supplier = d.supplier GROUP BY d.supplier, d.need)")
    every = " UNION ALL ".join(f"SELECT supplier, part, tier, nth FROM t{i}" for i in range(1, len(CASCADE) + 1))
    return f"WITH {', '.join(steps)} SELECT supplier, part, tier, row_number() OVER (PARTITION BY supplier ORDER BY tier, nth) AS place FROM ({every})"


def _cascade(spark: SparkSession, d: str, ask: Column) -> DataFrame:
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), "l_returnflag", "l_quantity", "l_discount")
    demand = load(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), ask.alias("need"))
    return c.cascade(demand, [(rows.filter(where).select("supplier", "part"), cap) for where, cap in CASCADE], group="supplier", key="part", need="need", order=[F.asc("part")])


@query(_cascade_sql("20 + s_suppkey % 50"))
def tier_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Five sources of a supplier's parts, each asked only for what the ones before did not give."""
    return _cascade(spark, d, F.col("s_suppkey") % 50 + 20)


@query(_cascade_sql("1"))
def first_source(spark: SparkSession, d: str) -> DataFrame:
    """The first source that has anything: a cascade for one part; later sources are not read for suppliers that have it."""
    return _cascade(spark, d, F.lit(1))


@query("SELECT p_partkey, md5(p_partkey::VARCHAR || '-7') AS h FROM part ORDER BY h LIMIT 20")
def random_k_seeded(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable random sample: the k least keyed hashes."""
    return load(spark, d, "part").select("p_partkey", F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("-7"))).alias("h")).orderBy("h").limit(20)


@query("SELECT l_orderkey, arg_max(l_linenumber, (l_quantity * l_extendedprice, -l_linenumber)) AS line, max(l_quantity * l_extendedprice) AS area FROM lineitem GROUP BY 1")
def argmax_product(spark: SparkSession, d: str) -> DataFrame:
    area = F.col("l_quantity") * F.col("l_extendedprice")
    m = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct(area.alias("area"), (-F.col("l_linenumber")).alias("neg"))).alias("m"))
    return m.select("l_orderkey", (-F.col("m.neg")).alias("line"), "m.area")


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%widget%' THEN 'photo' ELSE 'video' END AS kind, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'stock' WHEN p_name LIKE 'small%' THEN 'clip' ELSE 'general' END AS subtype FROM part""")
def name_path_classify(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_name").rlike("ring|widget"), "photo").otherwise("video")
    sub = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "stock").when(F.col("p_name").startswith("small"), "clip").otherwise("general")
    return load(spark, d, "part").select("p_partkey", kind.alias("kind"), sub.alias("subtype"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (1, 5, 7, 11, 400)")
def isin_lookup(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").filter(F.col("p_partkey").isin(1, 5, 7, 11, 400)).select("p_partkey", "p_name")


@query("SELECT event_type, user_id, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY ALL")
def event_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The batch result of the streaming extension: first event of a key, and how many there are."""
    m = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.min(F.struct("ts", "event_id")).alias("m"), F.count("*").alias("n"))
    return m.select("event_type", "user_id", "m.event_id", "n")


@query("""WITH g AS (SELECT user_id, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (gap < INTERVAL 60 SECOND) AS too_fast FROM g GROUP BY 1""")
def rate_gaps(spark: SparkSession, d: str) -> DataFrame:
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = load(spark, d, "events").select("user_id", gap.alias("gap"))
    return g.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("gap") < F.expr("INTERVAL 60 SECOND")).alias("too_fast"))
