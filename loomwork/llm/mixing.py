"""Mix sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each document should be taken ``target / source size`` times.  The whole part is certain; the fraction
is rounded so that a source's words stay at its target.  Two documents with fractions meet: mass (in
words) moves from one to the other, in a random direction whose odds keep the expectations, until one
fraction is 0 or 1; the other document goes on.  Each bucket of a source ends with one fraction at most;
those residuals meet in ever fewer buckets, a reduction tree, until one is left and is rounded to the nearest.
The words by which that misses are made good by documents of the same source that were rounded up or down: a few of each
class of lengths are drawn, and of them the longest that fit change sides, so the mix misses by half a short document.
No row of a bucket depends on another bucket, so a source that holds most rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, load, shared_checkpoint
from .sharding import counted_in_parts

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BUCKET_DOCS, FAN_IN = 128, 64
#: Documents of each class of lengths (powers of two) that may make good what rounding the last fraction misses.
MENDERS = 8
_ELEM = "struct<o:bigint,u:bigint,id:bigint,w:bigint,p:double,base:bigint>"
_DONE = "array<struct<u:bigint,id:bigint,w:bigint,base:bigint,bit:bigint>>"


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs and target for a table of source, source_size, n_docs.

    Sources by code point, null last, get the weights in turn.  Resharing the excess of capped sources
    until none is above ends where target = min(cap, level * weight), so the level is found directly:
    with sources by cap / weight, those before the first whose share at the then level fits are capped.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_r", F.col("_cap") / F.col("_w"))
    up = Window.orderBy("_r", F.col("source").asc_nulls_last())
    below, above = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("_r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))) / F.sum("_w").over(above)
    leveled = caps.withColumn("_level", level)
    first = F.first(F.when(F.col("_level") <= F.col("_r"), F.col("_level")), ignorenulls=True).over(everything)
    return leveled.withColumn("_at", first).select("source", "source_size", "n_docs", F.least(F.col("_cap"), F.coalesce(F.col("_at"), F.lit(float("inf"))) * F.col("_w")).alias("target"))


def _unit(u: Column, level: int) -> Column:
    """A number in [0, 1) from a hash, another one on each level of the tree."""
    return F.pmod(F.xxhash64(u, F.lit(level)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _meet(level: int):
    """The step of ``aggregate``: the fraction carried so far meets the next document."""

    def step(acc: Column, e: Column) -> Column:
        c = acc["carry"]
        none = c.isNull()
        settled = (e["p"] <= 0) | (e["w"] <= 0)
        up = F.least((1 - c["p"]) * c["w"], e["p"] * e["w"])  # mass from e to the carried one
        down = F.least(c["p"] * c["w"], (1 - e["p"]) * e["w"])
        rise = _unit(F.xxhash64(c["u"], e["u"]), level) * (up + down) < down
        c_full = rise & ((1 - c["p"]) * c["w"] <= e["p"] * e["w"])
        e_void = rise & (e["p"] * e["w"] <= (1 - c["p"]) * c["w"])
        c_void = ~rise & (c["p"] * c["w"] <= (1 - e["p"]) * e["w"])
        e_full = ~rise & ((1 - e["p"]) * e["w"] <= c["p"] * c["w"])
        moved = F.when(rise, up).otherwise(-down)

        def done(x: Column, bit: Column) -> Column:
            return F.struct(x["u"].alias("u"), x["id"].alias("id"), x["w"].alias("w"), x["base"].alias("base"), bit.alias("bit"))

        def with_p(x: Column, p: Column) -> Column:
            return F.struct(x["o"].alias("o"), x["u"].alias("u"), x["id"].alias("id"), x["w"].alias("w"), p.alias("p"), x["base"].alias("base"))

        c_done, e_done = c_full | c_void, e_full | e_void
        empty = F.lit(None).cast(_ELEM)
        left = F.when(~c_done, with_p(c, c["p"] + moved / c["w"])).when(~e_done, with_p(e, e["p"] - moved / e["w"])).otherwise(empty)
        out = F.concat(F.when(c_done, F.array(done(c, c_full.cast("long")))).otherwise(F.array().cast(_DONE)), F.when(e_done, F.array(done(e, e_full.cast("long")))).otherwise(F.array().cast(_DONE)))
        return (
            F.when(settled, F.struct(c.alias("carry"), F.concat(acc["out"], F.array(done(e, F.lit(0).cast("long")))).alias("out")))
            .when(none, F.struct(e.alias("carry"), acc["out"].alias("out")))
            .otherwise(F.struct(left.alias("carry"), F.concat(acc["out"], out).alias("out")))
        )

    return step


def _copies(bag: Column) -> Column:
    """Each element of a bag of (e, _n) so often, each time with a random number of its own."""

    def again(x: Column) -> Column:
        e = x["e"]
        return F.transform(F.sequence(F.lit(1).cast("long"), x["_n"]), lambda i: F.struct(e["o"].alias("o"), F.xxhash64(e["u"], i).alias("u"), e["id"].alias("id"), e["w"].alias("w"), e["p"].alias("p"), e["base"].alias("base")).cast(_ELEM))

    return F.flatten(F.transform(bag, again))


def _round_level(rows: DataFrame, level: int) -> DataFrame:
    """One level of the tree: (source, bucket, e) -> (source, bucket, carry, out); at level 0 ``e`` holds its count too."""
    start = F.struct(F.lit(None).cast(_ELEM).alias("carry"), F.array().cast(_DONE).alias("out"))
    bag = F.collect_list("e")
    bags = rows.groupBy("source", "bucket").agg(F.sort_array(bag if level else _copies(bag)).alias("es"))
    return bags.select("source", "bucket", F.aggregate("es", start, _meet(level)).alias("acc")).select("source", "bucket", "acc.carry", "acc.out")


def _menders(settled: DataFrame, last: DataFrame) -> DataFrame:
    """(source, u, turn): the documents that change sides, and by how much their copies change.

    ``last`` has (source, id, w, u, p) of each source's last fraction.  From the longest to the shortest, a document
    changes sides if what is missed gets less by that.  At most MENDERS documents of a side and class of lengths
    are looked at, drawn by hash.
    """
    bit = (F.col("p") >= 0.5).cast("long")
    missed = last.select("source", ((bit - F.col("p")) * F.col("w")).alias("missed"))
    able = settled.alias("s").join(F.broadcast(missed).alias("m"), F.col("s.source").eqNullSafe(F.col("m.source")) & (F.col("s.w") > 0))
    drawn = able.groupBy(F.col("s.source").alias("source"), F.floor(F.log2("s.w")).alias("class"), "s.bit", F.pmod(F.xxhash64("s.u"), F.lit(MENDERS)).alias("draw"))
    drawn = drawn.agg(F.min(F.struct(F.xxhash64("s.u", F.lit(1)).alias("h"), F.col("s.u").alias("u"), F.col("s.w").alias("w"))).alias("d"), F.first("missed").alias("missed"))
    bags = drawn.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("d.w")).alias("o"), "d.u", (1 - 2 * F.col("bit")).alias("turn")))).alias("es"), F.first("missed").alias("missed"))
    start = F.struct(F.col("missed"), F.array().cast("array<struct<u:bigint,turn:bigint>>").alias("turned"))

    def step(acc: Column, e: Column) -> Column:
        after = acc["missed"] - e["o"] * e["turn"]
        return F.when((F.abs(after) < F.abs(acc["missed"])) & (after * acc["missed"] >= 0), F.struct(after.alias("missed"), F.concat(acc["turned"], F.array(F.struct(e["u"].alias("u"), e["turn"].alias("turn")))).alias("turned"))).otherwise(acc)

    greedy = bags.select("source", "es", F.aggregate("es", start, step).alias("a"))
    rest = greedy.select("source", "a.*", F.filter("es", lambda e: ~F.array_contains(F.transform("a.turned", lambda t: t["u"]), e["u"])).alias("es"))
    none = F.array(F.struct(F.lit(0).cast("long").alias("d"), F.array().cast("array<struct<u:bigint,turn:bigint>>").alias("t")))

    def some(side: Column, two: bool) -> Column:
        """No document of a side, one, or two, with the words that they bring."""
        one = F.transform(side, lambda e: F.struct((-e["o"] * e["turn"]).alias("d"), F.array(F.struct(e["u"].alias("u"), e["turn"].alias("turn"))).alias("t")))
        if not two:
            return F.concat(none, one)
        pairs = F.transform(one, lambda x, i: F.transform(F.slice(one, i + 2, F.size(one)), lambda y: F.struct((x["d"] + y["d"]).alias("d"), F.concat(x["t"], y["t"]).alias("t"))))
        return F.concat(none, one, F.flatten(pairs))

    downs, ups = F.filter("es", lambda e: e["turn"] < 0), F.filter("es", lambda e: e["turn"] > 0)

    def nearest(x: Column, y: Column) -> Column:
        return F.array_min(F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.struct(F.abs(F.col("missed") + a["d"] + b["d"]).alias("left"), a["t"].alias("x"), b["t"].alias("y"))))))

    sides = rest.select("source", "missed", "turned", downs.alias("downs"), ups.alias("ups"))
    sides = sides.select("source", "missed", "turned", some(F.col("downs"), False).alias("d1"), some(F.col("downs"), True).alias("d2"), some(F.col("ups"), False).alias("u1"), some(F.col("ups"), True).alias("u2"))
    best = sides.select("source", "turned", F.least(nearest(F.col("d2"), F.col("u1")), nearest(F.col("d1"), F.col("u2"))).alias("b"))
    return best.select("source", F.explode(F.concat("turned", "b.x", "b.y")).alias("t")).select("source", "t.*")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 4) -> DataFrame:
    """Copies of each document: id, source, size, source_size, target, copies.

    A document's size is its number of words, 0 if the text is null.  Null sources are one source, the
    last.  Documents without words are taken 0 times where the rate is below 1.  Repeated rows are
    rounded each by itself; an empty table gives no rows; other columns are not read.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_RE)).cast("long")
    rows = shared_checkpoint(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("w")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("w").alias("source_size"), F.count("*").alias("n_docs")), weights=weights, share=share, most=most)
    targets = shared_checkpoint(targets)
    # equal rows (id, source, words) are counted and go a few together: no id that many rows share meets in one bucket
    joined = counted_in_parts(rows).alias("r").join(targets.alias("t"), F.col("r._row.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    u = F.xxhash64(F.lit(seed), "_row", "_part")
    w = F.col("_row.w")
    # the long ones meet first: what is left over at the end is short more often
    e = F.struct((-w).alias("o"), u.alias("u"), F.col("_row.id").alias("id"), w.alias("w"), (rate - F.floor(rate)).alias("p"), F.floor(rate).cast("long").alias("base"))
    buckets = F.ceil(F.col("n_docs") / BUCKET_DOCS)
    level_rows = joined.select(F.col("r._row.source").alias("source"), F.pmod(F.xxhash64(u), buckets).alias("bucket"), F.struct(e.cast(_ELEM).alias("e"), "_n").alias("e"))
    biggest = targets.agg(F.max(F.ceil(F.col("n_docs") / BUCKET_DOCS))).first()[0] or 0
    outs, level = [], 0
    while True:
        level_rows = _round_level(level_rows, level)
        if level == 0:
            level_rows = shared_checkpoint(level_rows)
        outs.append(level_rows.select("source", F.explode("out").alias("d")).select("source", "d.*"))
        carried = level_rows.filter("carry is not null")
        if biggest <= 1:
            break
        level_rows = carried.select("source", F.floor(F.col("bucket") / FAN_IN).cast("long").alias("bucket"), F.col("carry").alias("e"))
        biggest, level = -(-biggest // FAN_IN), level + 1
    last = shared_checkpoint(carried.select("source", "carry.*"))  # one row a source at most
    outs.append(last.select("source", "u", "id", "w", "base", (F.col("p") >= 0.5).cast("long").alias("bit")))
    settled = outs[0]
    for o in outs[1:]:
        settled = settled.unionByName(o)
    turned = _menders(settled, last).alias("m")  # a hundred rows a source at most
    mended = settled.alias("s").join(F.broadcast(turned), F.col("s.source").eqNullSafe(F.col("m.source")) & (F.col("s.u") == F.col("m.u")), "left")
    copies = (F.col("base") + F.col("bit") + F.coalesce("turn", F.lit(0))).alias("copies")
    full = mended.select("s.source", "id", "w", copies).alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    return full.select(F.col("id").alias(id_col), F.col("s.source").alias("source"), F.col("w").alias("size"), "source_size", "target", "copies")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op4_mixing": op4_mixing}
ORACLES: dict[str, str] = {}
