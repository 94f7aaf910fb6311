"""Scans in Arrow batches against the Column expressions that say the same."""

import random

from pyspark.sql import functions as F

from loomwork.functions import dictionaries as d
from loomwork.functions import grounding, scan, text

BITS = ["팬", "SNS", "Cf", "차트", "1위", " ", "　", "\xa0", "\x1c", "3", "٣", "억", "원", "만", "TOP ", "년", "월", "일", "12", ",000", ".5", "건강", "이상", "눈물", "바다", "\"", "‘", "한 말", "\n", "a", "_", "́", "[사진 1]", "### 2", "경악", "을 금치", "60초"]


def _texts(spark, n):
    rng = random.Random(5)
    rows = [("".join(rng.choices(BITS, k=rng.randrange(16))),) for _ in range(n)] + [("",), (None,)]
    return spark.createDataFrame(rows, "x string").repartition(3)


def test_scans_find_what_the_columns_find(spark):
    df, x = _texts(spark, 1000).localCheckpoint(), F.coalesce("x", F.lit(""))
    terms = [*d.CLICKBAIT, *d.CRITICAL_TERMS, "1위"]
    pairs = df.select(
        "x",
        scan.terms_held(F.col("x"), terms).alias("t"),
        F.transform(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t)), lambda t: F.struct(t.alias("term"), text.count_of(x, t).cast("int").alias("n"))).alias("t0"),
        grounding.quantities_of(scan.all_matches(F.col("x"), d.DATE, [0], starts=r"\d"), scan.all_matches(F.col("x"), d.RANK, [0, 1], starts=r"\dTt"), scan.all_matches(F.col("x"), d.AMOUNT, [0, 1, 2, 3], starts=r"\d")).alias("q"),
        grounding.quantities(F.col("x")).alias("q0"),
        F.flatten(scan.all_matches(F.col("x"), d.QUOTED, [1], distinct=False)).alias("e"),
        F.regexp_extract_all(x, F.lit(d.QUOTED), 1).alias("e0"),
        F.coalesce(scan.match_number(F.col("x"), d.SECTION), F.lit(0)).alias("s"),
        F.regexp_count(x, F.lit(d.SECTION)).alias("s0"),
        scan.stripped_length(F.col("x")).alias("n"),
        F.length(text.strip(x)).alias("n0"),
        scan.any_held(F.col("x"), F.array(F.lit("팬"), F.lit("눈물"))).alias("a"),
        (F.contains(x, F.lit("팬")) | F.contains(x, F.lit("눈물"))).alias("a0"),
    )
    rows = pairs.collect()
    assert [(c, r["x"]) for r in rows for c in "tqesna" if r[c] != r[f"{c}0"]] == []
    assert sum(len(r["q"]) > 0 for r in rows) > 50


def test_texts_reach_the_factual_check_through_scans(spark):
    """Terms looked for one by one in every text took most of its time."""
    from loomwork import registry

    plan = registry.QUERIES["factual_total"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_matches_are_counted_as_the_columns_count_them(spark):
    """The sentences of a script; equal ones were matched again and again, category by category."""
    from loomwork import registry

    df = _texts(spark, 400).groupBy(F.floor(F.rand(1) * 60).alias("k")).agg(F.collect_list("x").alias("l"))
    df = df.unionByName(spark.createDataFrame([(-1, []), (-2, None)], "k long, l array<string>")).localCheckpoint()
    got = {r["k"]: {c["i"]: list(c["n"]) for c in r["c"]} for r in df.select("k", scan.match_counts(F.col("l"), list(d.CATEGORY_PATTERNS.values())).alias("c")).collect()}
    want = {k: {} for k in got}
    for r in df.select("k", F.posexplode("l").alias("i", "x")).select("k", "i", grounding.category_matches(F.col("x")).alias("m")).collect():
        if r["m"]:
            want[r["k"]][r["i"]] = [{m["category"]: m["n"] for m in r["m"]}.get(c, 0) for c in d.CATEGORY_PATTERNS]
    assert got == want and sum(map(len, want.values())) > 50
    plan = registry.QUERIES["scene_analysis"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
