"""Catalogue operators: usage, selection by least use, exclusion, tags, versions, merge."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.scratch import checkpointed


def usage_state(media: DataFrame, facts: DataFrame, *, media_id: str, fact_id: str, at: str) -> DataFrame:
    """Media with use_count and last_used_at derived from append-only usage facts (unused: 0, null)."""
    used = facts.groupBy(F.col(fact_id).alias("_used")).agg(F.count("*").alias("use_count"), F.max(at).alias("last_used_at"))
    return media.join(used, F.col(media_id) == F.col("_used"), "left").drop("_used").withColumn("use_count", F.coalesce("use_count", F.lit(0)))


def least_used_first(df: DataFrame, k: int, *, favorite: str, tie: str) -> DataFrame:
    """Top k by use_count, last_used_at (never used first), favorites first, then ``tie``."""
    return df.orderBy(F.asc("use_count"), F.asc_nulls_first("last_used_at"), F.desc(favorite), F.asc(tie)).limit(k)


def order_columns(spec: list[tuple[str, str]], allowed: set[str]) -> list[Column]:
    """A typed order list: (column, asc|desc) pairs from a white list."""
    for name, way in spec:
        if name not in allowed or way not in ("asc", "desc"):
            raise ValueError(f"cannot order by {name} {way}")
    return [F.asc_nulls_first(n) if w == "asc" else F.desc_nulls_last(n) for n, w in spec]


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """A conjunction of those conditions that are given."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def exclude_used(df: DataFrame, used: DataFrame, key: str, used_key: str) -> DataFrame:
    return df.join(used.select(F.col(used_key).alias(key)), key, "left_anti")


def any_tag(df: DataFrame, tags: DataFrame, wanted: list[str], *, key: str) -> DataFrame:
    """Rows with any of the wanted tags, each once: a semi join."""
    return df.join(tags.filter(F.col("tag").isin([t.lower() for t in wanted])).select(key), key, "left_semi")


def tag_list(text: Column, separator: str = "[;, ]") -> Column:
    """Trimmed, lower-case, distinct tags in their first order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, separator), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def recent_n(df: DataFrame, n: int, *, key: str, order: list[Column]) -> DataFrame:
    """The ``n`` newest rows of each key, with their rank ``rn``."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("rn") <= n)


def latest_valid(cache: DataFrame, *, keys: list[str], at: str, expires: str, as_of: Column, tie: str) -> DataFrame:
    """The newest version of each key that has not expired at ``as_of``."""
    alive = cache.filter(F.col(expires).isNull() | (F.col(expires) > as_of))
    return alive.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie)))).filter("_rn = 1").drop("_rn")


def merge_content(old: DataFrame, new: DataFrame, *, hash_col: str, patch: list[str], tie: str) -> DataFrame:
    """Upsert by content hash: a known hash keeps its row and fills missing fields, a new one is inserted.

    Of several new rows with one hash the first by ``tie`` counts.  ``is_duplicate`` tells the two apart.
    """
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy(hash_col).orderBy(tie))).filter("_rn = 1").drop("_rn")
    o, n = old.alias("o"), first.alias("n")
    joined = o.join(n, F.col(f"o.{hash_col}") == F.col(f"n.{hash_col}"), "full_outer")
    fields = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in [hash_col, tie, *patch]]
    return joined.select(*fields, F.col(f"o.{hash_col}").isNotNull().alias("was_known"), (F.col(f"o.{hash_col}").isNotNull() & F.col(f"n.{hash_col}").isNotNull()).alias("is_duplicate"))


def numbered(keys: DataFrame, key: str, out: str) -> DataFrame:
    """``keys`` with ``out``: 1, 2, 3 ... without gaps, in the order of 4,096 buckets by hash and of the keys in them.

    A window for each bucket and one over the buckets' counts: no task sees all rows.
    """
    placed = keys.withColumn("_b", F.left(F.md5(F.col(key).cast("binary")), F.lit(3)))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", before.alias("_before"))
    ranked = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return ranked.join(counts, "_b").withColumn(out, F.col("_before") + F.col("_rn")).drop("_b", "_rn", "_before")


def get_or_create(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, id) of each distinct name: ids of known names (ASCII case ignored) or aliases, new ids after the greatest for the rest."""
    fold = F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = names.select("name", fold.alias("_k")).distinct()
    exact = known.select(fold.alias("_k"), F.col("id").alias("_exact")).groupBy("_k").agg(F.min("_exact").alias("_exact"))
    alias = known.select(F.explode("aliases").alias("name"), "id").select(fold.alias("_k"), "id").groupBy("_k").agg(F.min("id").alias("_alias"))
    found = wanted.join(exact, "_k", "left").join(alias, "_k", "left").withColumn("id", F.coalesce("_exact", "_alias"))
    fresh = numbered(found.filter("id is null").select("_k").distinct(), "_k", "_new")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("t")).scalar()
    return found.join(fresh, "_k", "left").withColumn("_top", top).select("name", F.coalesce("id", F.col("_top") + F.col("_new")).alias("id"))


def lookup_or_alias(wanted: DataFrame, known: DataFrame, *, want: str, name: str, key: str) -> DataFrame:
    """For each wanted string: the exact match (ASCII case ignored) if any, else the first name containing it."""
    # ASCII case, as the exact match of a store's text columns does
    fold = lambda c: F.translate(F.col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w, k = wanted.select(want, fold(want).alias("_w")), known.select(key, fold(name).alias("_k"))
    exact = w.join(k, F.col("_w") == F.col("_k")).select(want, key, F.lit(0).alias("_tier"))
    # a name contains a string if one of its substrings of that length is the string: an equi-join, not all pairs
    lengths = w.agg(F.array_sort(F.collect_set(F.length("_w")))).scalar()  # no more numbers than the longest string has characters
    cuts = F.flatten(F.transform("_lengths", lambda n: F.when(F.length("_k") >= n, F.transform(F.sequence(F.lit(1), F.length("_k") - n + 1), lambda i: F.substr("_k", i, n))).otherwise(F.array().cast("array<string>"))))
    parts = k.withColumn("_lengths", lengths).select(key, F.explode(F.array_distinct(cuts)).alias("_w"))
    part = w.join(parts, "_w").select(want, key, F.lit(1).alias("_tier"))
    both = exact.unionByName(part)
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(want).orderBy("_tier", key))).filter("_rn = 1").select(want, key, F.col("_tier").alias("tier"))


def streak(facts: DataFrame, *, key: str, item: str, order: str, tie: str) -> DataFrame:
    """How long the newest run of one item is, per key: rows before the first that differs from the newest."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie)))
    ranked = facts.select(key, item, rn.alias("rn"))
    newest = F.first(item).over(Window.partitionBy(key).orderBy("rn"))
    marked = ranked.withColumn("newest", newest)
    run = F.coalesce(F.min(F.when(F.col(item) != F.col("newest"), F.col("rn"))) - 1, F.count("*"))
    return marked.groupBy(key).agg(F.max("newest").alias("item"), run.cast("long").alias("run_length"))


def flips(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``radius`` of them set."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


#: Rows of a block of which all pairs are compared at once.
PAIR_BLOCK = 4096


def _pairs_of_blocks(bits: DataFrame, threshold: int, *, key: str, words: list[str]) -> DataFrame:
    """All pairs, block by block: rows are dealt to blocks by hash, two blocks meet in one task as arrays of words, and only the
    near pairs come out.  A block goes to as many tasks as there are blocks, and no task holds more than two."""
    rows = bits.select(F.col(key).cast("long").alias("k"), *[F.col(w).cast("long").alias(w) for w in words])
    n = max(1, -(-rows.count() // PAIR_BLOCK))
    block = F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    dealt = rows.withColumn("_b", block)
    first = dealt.withColumn("_o", F.explode(F.sequence("_b", F.lit(n - 1))))
    second = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), "_b")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["k"].to_numpy(), right["k"].to_numpy()
        same = left.num_rows and right.num_rows and left["_b"][0].as_py() == right["_b"][0].as_py()
        found = []
        for lo in range(0, len(a), 512):
            d = sum((np.bitwise_count(left[w].to_numpy()[lo : lo + 512, None] ^ right[w].to_numpy()[None, :]).astype(np.int64) for w in words), np.zeros((len(a[lo : lo + 512]), len(b)), np.int64))
            near = d <= threshold
            near &= (a[lo : lo + 512, None] < b) if same else (a[lo : lo + 512, None] != b)
            i, j = np.nonzero(near)
            found.append((np.minimum(a[lo + i], b[j]), np.maximum(a[lo + i], b[j]), d[i, j]))
        columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3)]
        return pa.table(columns, names=["a", "b", "distance"])

    # the tables come from one, so columns are named anew
    second = second.select(F.col("_o").alias("_b1"), F.col("_b").alias("_o1"), "k", *words, "_b").toDF("_b1", "_o1", "k", *words, "_b")
    return first.groupBy("_b", "_o").cogroup(second.groupBy("_b1", "_o1")).applyInArrow(meet, "a long, b long, distance long")


def hamming_pairs(bits: DataFrame, threshold: int, *, key: str, words: list[str], blocks: list[str] | None = None, width: int = 0, radius: int = 0) -> DataFrame:
    """Pairs a < b whose bit words differ in at most ``threshold`` places.

    Without ``blocks``, for thresholds too loose for them, blocks of rows are compared as arrays.  With ``blocks`` (disjoint parts of the bits) candidates agree in one block but for ``radius`` of its ``width`` bits at
    most: exact by the pigeonhole principle if blocks * (radius + 1) is above the threshold, and an equi-join instead of
    all pairs.  Wider blocks with a radius let far fewer pairs meet by chance than more, narrower ones.
    """
    dist = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words[1:]), F.bit_count(F.col(f"a.{words[0]}").bitwiseXOR(F.col(f"b.{words[0]}"))))
    if blocks is None:
        return _pairs_of_blocks(bits, threshold, key=key, words=words)
    if len(blocks) * (radius + 1) <= threshold:
        raise ValueError("more blocks or a larger radius are needed for the threshold")
    long = bits.select(key, *words, F.posexplode(F.array(*blocks)).alias("_i", "_block"))
    masks = F.array(*[F.lit(x).cast("long") for x in flips(width, radius)])
    near = long.select(key, *words, "_i", F.explode(F.transform(masks, lambda x: F.col("_block").bitwiseXOR(x))).alias("_block"))
    pairs = near.alias("a").join(long.alias("b"), (F.col("a._i") == F.col("b._i")) & (F.col("a._block") == F.col("b._block")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (dist <= threshold))
    return pairs.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), dist.cast("long").alias("distance")).distinct()


def tiered_fill(rows: DataFrame, quota: int, *, group: str, key: str, tier: str, order: list[Column], caps: dict[int, int] | None = None) -> DataFrame:
    """Ordered union of tiers without repeats: each key in its best tier, tiers capped, then the quota of the group."""
    best = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group, key).orderBy(tier, *order))).filter("_rn = 1").drop("_rn")
    if caps:
        cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(tier)), F.lit(2**31 - 1))
        # the first filter is a number, so each task keeps no more of a tier than the largest cap
        most = max(caps.values())
        ranked = best.withColumn("_cap", cap).withColumn("_rn", F.row_number().over(Window.partitionBy(group, tier).orderBy(*order)))
        bounded = F.col("_rn") <= most
        capped = F.col(tier).isin(list(caps))
        best = ranked.filter(capped & bounded & (F.col("_rn") <= F.col("_cap"))).unionByName(ranked.filter(~capped)).drop("_rn", "_cap")
    place = F.row_number().over(Window.partitionBy(group).orderBy(tier, *order))
    return best.withColumn("place", place.cast("long")).filter(F.col("place") <= quota)


def cascade(demand: DataFrame, tiers: list[tuple[DataFrame, int | None]], *, group: str, key: str, need: str, order: list[Column]) -> DataFrame:
    """(group, key, tier, place): each group's ``need`` filled from tier after tier; a later one is asked only for groups that lack.

    ``tiers`` are (rows, cap): no more than the cap comes from one, and no key twice.  What each tier gave is kept in files, and
    with it the demand that remains, which then filters the next tier's rows by a join before they are ranked.
    """
    lacking = checkpointed(demand.select(group, F.col(need).cast("long").alias("_need")).filter("_need > 0"))
    parts: list[DataFrame] = []
    for i, (rows, cap) in enumerate(tiers, 1):
        offered = rows.join(lacking, group)
        if parts:
            offered = offered.join(reduce(DataFrame.unionByName, [p.select(group, key) for p in parts]), [group, key], "left_anti")
        once = offered.withColumn("_n", F.row_number().over(Window.partitionBy(group, key).orderBy(*order))).filter("_n = 1")
        most = F.col("_need") if cap is None else F.least("_need", F.lit(cap).cast("long"))
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order, key)).cast("long")
        taken = checkpointed(once.withColumn("_at", rank).filter(F.col("_at") <= most).select(group, key, F.lit(i).alias("tier"), "_at"))
        parts.append(taken)
        given = taken.groupBy(group).agg(F.count("*").alias("_given"))
        left = F.col("_need") - F.coalesce("_given", F.lit(0).cast("long"))
        lacking = checkpointed(lacking.join(given, group, "left").select(group, left.alias("_need")).filter("_need > 0"))
        if i < len(tiers) and lacking.isEmpty():
            break
    place = F.row_number().over(Window.partitionBy(group).orderBy("tier", "_at")).cast("long")
    return reduce(DataFrame.unionByName, parts).select(group, key, "tier", place.alias("place"))


def round_robin(rows: DataFrame, kinds: list[str], *, group: str, kind: str, order: list[Column]) -> DataFrame:
    """Each group's rows with their ``place``: the first of every kind in the order of ``kinds``, then the second, and so on.

    Kinds that are not listed come after all others.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind)), F.lit(0).cast("long")), F.lit(len(kinds) + 1).cast("long"))
    turned = rows.withColumn("_kind", rank).withColumn("_turn", F.row_number().over(Window.partitionBy(group, kind).orderBy(*order)))
    last = F.when(F.col("_kind") > len(kinds), 1).otherwise(0)
    return turned.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(last, "_turn", "_kind", *order)).cast("long")).drop("_kind", "_turn")


def padded(ranked: DataFrame, defaults: DataFrame, k: int, *, group: str, key: str) -> DataFrame:
    """``ranked`` (group, key, place), and where a group has fewer than ``k`` keys, those of ``defaults`` (key, place) it lacks, in order."""
    groups = ranked.groupBy(group).agg(F.collect_set(key).alias("_have"), F.max("place").alias("_last")).filter(F.size("_have") < k)
    extra = groups.withColumn("_all", defaults.agg(F.array_sort(F.collect_list(F.struct("place", key)))).scalar())
    lacking = F.slice(F.filter("_all", lambda x: ~F.array_contains("_have", x[key])), F.lit(1), F.lit(k) - F.size("_have"))
    added = extra.select(group, "_last", F.posexplode(lacking).alias("_i", "_d"))
    return ranked.unionByName(added.select(group, F.col(f"_d.{key}").alias(key), (F.col("_last") + F.col("_i") + 1).cast("long").alias("place")))
