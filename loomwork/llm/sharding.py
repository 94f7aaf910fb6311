"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters records uniformly into buckets by a seeded hash of the whole record; the number of buckets
follows the number and the bytes of the records, so a bucket fits in memory whatever the size of the table.  Records that occur
very often are counted first and scattered a few together, so neither they nor a key that many records share meet in one
bucket; all others move once.  Pass 2 shuffles each bucket (Spark's ``shuffle`` is a seeded Fisher-Yates) and deals its records to the
shards in turn.  Each bucket is a partition of its own number, from which its seed comes, so the order does not
depend on the session's settings.  Only the given columns move; the counts of earlier buckets give a bucket's first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, load, scratch_folder, shared_checkpoint

#: A bucket holds at most about BUCKET_ROWS records and BUCKET_BYTES; small tables still get many buckets, up to SPREAD.
BUCKET_ROWS, BUCKET_BYTES, SPREAD_ROWS, SPREAD = 200_000, 64 << 20, 1000, 1000
#: So many equal records go together.
EQUAL_ROWS = 64
#: Above so many hashes of frequent records a shuffled join is used.
BROADCAST_FREQUENT = 1_000_000


def counted_in_parts(rows: DataFrame, most: int = EQUAL_ROWS) -> DataFrame:
    """(_row, _part, _n): the distinct rows of ``rows``, those that occur more than ``most`` times in several parts."""
    counted = rows.select(F.struct(*[F.col(c) for c in rows.columns]).alias("_row")).groupBy("_row").agg(F.count("*").alias("_all"))
    parts = counted.select("_row", "_all", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_all") - 1) / most))).alias("_part"))
    return parts.select("_row", "_part", F.least(F.lit(most).cast("long"), F.col("_all") - F.col("_part") * most).alias("_n"))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def _comparable(rows: DataFrame) -> DataFrame:
    """``rows`` with maps as sorted entries, since maps can be neither hashed nor grouped."""
    for f in rows.schema.fields:
        inner = [f.dataType.keyType, f.dataType.valueType] if isinstance(f.dataType, T.MapType) else [f.dataType]
        if any(map(_holds_map, inner)):
            raise ValueError(f"column {f.name}: maps inside other types cannot be sharded")
    return rows.select(*[F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in rows.schema.fields])


def _restored(schema: T.StructType) -> list[Column]:
    """The columns of ``_row``, maps as maps again."""
    return [(F.map_from_entries(x) if isinstance(f.dataType, T.MapType) else x).alias(f.name) for f in schema.fields for x in [F.col("_row")[f.name]]]


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes ``_row`` takes."""

    def size(f: T.StructField) -> Column:
        x = F.col("_row")[f.name]
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(x), F.lit(0))
        if isinstance(f.dataType, (T.ArrayType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(x.alias("x")))), F.lit(0))
        return F.lit(8)

    return sum((size(f).cast("long") for f in schema.fields), F.lit(16).cast("long"))


def _placed(rows: DataFrame, seed: int, bucket_rows: int) -> DataFrame:
    """(_row, _at): each row of ``rows`` as a struct and its place."""
    plain = _comparable(rows)
    hashed = plain.select(F.struct(*[F.col(c) for c in plain.columns]).alias("_row")).withColumn("_hash", F.xxhash64("_row"))
    # only hashes are counted; different records that share one are told apart in counted_in_parts
    sizes = shared_checkpoint(hashed.groupBy("_hash").agg(F.count("*").alias("_n"), F.sum(row_bytes(plain.schema)).alias("_bytes")))
    n, size = sizes.agg(F.sum("_n"), F.sum("_bytes")).first()
    n, size = n or 0, size or 0
    buckets = max(1, -(-n // bucket_rows), -(-size // BUCKET_BYTES), min(SPREAD, -(-n // SPREAD_ROWS)))
    frequent = few(sizes.filter(F.col("_n") > EQUAL_ROWS).select("_hash"), BROADCAST_FREQUENT)
    single = hashed.join(frequent, "_hash", "left_anti").select("_row", F.lit(0).cast("long").alias("_part"), F.lit(1).cast("long").alias("_n"))
    parts = single.unionByName(counted_in_parts(hashed.join(frequent, "_hash", "left_semi").select("_row.*")))
    parts = parts.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_row", "_part"), F.lit(buckets)).cast("int"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = parts.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    firsts = F.broadcast(counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_first")))
    # sorted first, so a bucket that is computed again comes out the same
    bags = parts.repartitionById(buckets, "_bucket").groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct("_row", "_part", "_n"))).alias("_bag"))
    each = F.flatten(F.transform("_bag", lambda p: F.array_repeat(p["_row"], p["_n"].cast("int"))))
    dealt = bags.select("_bucket", F.posexplode(F.shuffle(each, seed)).alias("_pos", "_row"))
    return dealt.join(firsts, "_bucket").select("_row", (F.col("_first") + F.col("_pos")).alias("_at"))


def shuffled_positions(rows: DataFrame, *, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``position``: their place, from 0 without gaps, in a uniform random order.

    All columns travel with the row, maps too (ValueError for maps inside arrays, structs or maps).  Equal rows and nulls
    are shuffled like any others; an empty table gives no rows; an input column named ``position`` is replaced.
    """
    rows = rows.drop("position")
    return _placed(rows, seed, bucket_rows).select(*_restored(rows.schema), F.col("_at").alias("position"))


def shard_rows(rows: DataFrame, *, shards: int, seed: int = 17) -> DataFrame:
    """``rows`` with shard and slot under the law that shards hold equally many rows, give or take one.

    All columns travel with the row, as in ``shuffled_positions``; input columns named ``shard`` or ``slot`` are replaced.
    """
    rows = rows.drop("shard", "slot")
    return _placed(rows, seed, BUCKET_ROWS).select(*_restored(rows.schema), F.pmod("_at", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_at") / shards).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, *, shards: int, seed: int = 17) -> None:
    """Write whole records, a folder for each shard, in the order of their slots within each file."""
    placed = shard_rows(rows, shards=shards, seed=seed)
    placed.repartition("shard", F.floor(F.col("slot") / BUCKET_ROWS)).sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are written into the shards and read again; what is told of them comes from there.

    Null texts have size 1 (their end) and the checksum of no bytes; an empty table gives no rows.
    """
    path = scratch_folder(spark, "shards")
    docs = load(spark, sf_dir, "documents")
    write_shards(docs, path, shards=8)
    schema = T.StructType([*docs.drop("shard", "slot").schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    return spark.read.schema(schema).parquet(path).select("doc_id", size, F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_sharding": op3_sharding}
ORACLES: dict[str, str] = {}
