"""Queries that take in every part of a rule, on rows where a left-out part changes the result."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork import registry
from loomwork.functions import grounding, scoring, text
from loomwork.operators import ledger
from loomwork.plans import scripts

DATA = "/root/testdata/sf0.001"


def test_every_part_counts_in_the_factual_check(spark):
    fair = "영탁의 무대 " * 60
    cases = [
        (fair, None, (8.0, 10.0, 8.0, 4.0, 30.0, False, True)),
        (fair + "1위 2억 명", None, (8.0, 4.0, 8.0, 4.0, 24.0, True, False)),
        ("송가인 이야기 " * 53, None, (0.0, 10.0, 8.0, 4.0, 22.0, True, False)),
        (fair + '"없는 말" 뮤직뱅크', None, (5.5, 10.0, 8.0, 4.0, 27.5, False, True)),
        (fair + "은퇴 경악", None, (8.0, 10.0, 2.0, 4.0, 24.0, True, False)),
        (fair, "짧은 글", (8.0, 10.0, 8.0, 0.0, 26.0, False, True)),
        (fair, "영탁 ### 1 ### 2 ### 3" + " 글" * 1200, (8.0, 10.0, 8.0, 4.0, 30.0, False, True)),
        (fair, "영탁 은퇴 ### 1 ### 2 ### 3" + " 글" * 1200, (8.0, 10.0, 8.0, 2.0, 28.0, True, False)),
    ]
    df = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(cases)], "i int, script string, blog string")
    check = grounding.fact_check(F.lit("영탁 소식"), F.lit("영탁의 무대"), F.col("script"), F.col("blog"), F.lit(None).cast("string"))
    got = {r["i"]: tuple(r["c"])[1:] for r in df.select("i", check.alias("c")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}


def test_generated_texts_reach_every_branch(spark):
    """At least a third of the scripts hold quantities, some of them not in the article, and every part varies."""
    n = registry.QUERIES["number_grounding"](spark, DATA).toPandas()
    assert (n.n_quantities > 0).mean() > 0.5 and (n.n_missing > 0).mean() > 0.1 and n.critical.any() and not n.critical.all()
    f = registry.QUERIES["factual_total"](spark, DATA).toPandas()
    assert all(f[c].nunique() > 2 for c in ("entity", "numbers", "terms", "blog")) and f.passed.any() and not f.passed.all()
    found = registry.QUERIES["sentence_category"](spark, DATA).toPandas()
    assert found.category.nunique() == 7 and found.category.isna().any()
    plan = registry.QUERIES["scene_analysis"](spark, DATA).toPandas()
    assert plan.groupby("l_orderkey").size().between(2, 7).all() and (plan.score == 0.5).any() and (plan.score == 0.85).any()
    replies = registry.QUERIES["review_replies"](spark, DATA).toPandas()
    assert set(replies.status) == {"PASS", "WARNING", "FAIL", "AI_QA_NOT_RUN"} and replies.critical.any()
    photos = registry.QUERIES["photo_diversity"](spark, DATA).toPandas()
    assert (photos.near_dup > 0).any() and photos.photo.nunique() > 1


def test_patterns_without_flags_match_as_with_them(spark):
    rng = random.Random(2)
    bits = ["팬", "sns", "SNS", "Cf", "차트", "1위", " ", "　", "\xa0", "3", "억", "원", "만", "a", "_", "é", "건강", "이상", "눈물", "을", "참", "́"]
    rows = [("".join(rng.choices(bits, k=rng.randrange(12))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "x string")
    for c, p in scripts.words.CATEGORY_PATTERNS.items():
        assert "(?iU)" not in text.plain_pattern(p)
        assert df.filter(text.matches(F.col("x"), p) != F.array_distinct(F.regexp_extract_all("x", F.lit(f"(?iU){p}"), 0))).collect() == [], c
    assert text.plain_pattern("(?:the|der)") == "(?iU)(?:the|der)"


@pytest.mark.parametrize("places", [0, 1, 2, 3])
def test_rounding_equals_pythons(spark, places):
    rng = random.Random(places)
    xs = [rng.uniform(-1000, 1000) for _ in range(10_000)] + [rng.randrange(-10**6, 10**6) / 10 ** (places + 1) for _ in range(20_000)] + [rng.randrange(-(10**5), 10**5) / 2**k for k in range(12) for _ in range(300)]
    xs += [2.675, 1.005, 0.5, 1.5, 2.5, -0.5, 1e300, -1e-300, 0.0, 4e15, 5e-324]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scoring.exact_round(F.col("x"), places)).collect()]
    assert [(x, g) for x, g in zip(xs, got) if g != round(x, places)] == []


def test_near_repeats_equal_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.randrange(2**64) for _ in range(4)]

    def item(who, k, pos):
        x = rng.choice(base)
        for _ in range(rng.randrange(8)):
            x ^= 1 << rng.randrange(64)
        return who, pos, f"p{rng.randrange(40)}", x >> 32, x & 0xFFFFFFFF

    now = [item(w, 0, i) for w in range(6) for i in range(25)]
    past = [item(w, 1, i) for w in range(6) for i in range(8)]
    fields = "who long, pos long, path string, w1 long, w2 long"
    near = lambda a, b: a[0] == b[0] and a[2] != b[2] and bin(a[3] ^ b[3]).count("1") + bin(a[4] ^ b[4]).count("1") <= 5
    want = {(a[0], a[1]) for a in now if any(near(a, b) for b in past) or any(near(a, b) and b[1] < a[1] for b in now)}
    got = ledger.near_repeats(spark.createDataFrame(now, fields), spark.createDataFrame(past, fields), who="who", pos="pos", words=["w1", "w2"], threshold=5)
    assert {tuple(r) for r in got.collect()} == want and 0 < len(want) < len(now)
    with pytest.raises(ValueError):
        ledger.near_repeats(spark.createDataFrame(now, fields), spark.createDataFrame(past, fields), who="who", pos="pos", words=["w1"], threshold=5)
