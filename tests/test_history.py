"""One shuffle by customer gives what the joins on keys give."""

import random

from pyspark.sql import functions as F

from loomwork import registry
from loomwork.operators import ledger


def test_windows_and_joins_agree(spark):
    rng = random.Random(8)
    rows = [(w, b, p, f"h{rng.randrange(60)}", f"{rng.randrange(40)}/x", f"{rng.randrange(30)}x", rng.randrange(16) << rng.randrange(9), rng.randrange(4)) for w in range(12) for b in range(6) if b == 0 or rng.random() < 0.8 for p in range(1, 6)]
    h = spark.createDataFrame(rows, "who long, back long, pos long, hash string, path string, base string, w1 long, w2 long").localCheckpoint()
    now, past = h.filter("back = 0"), h.filter("back > 0")
    met = ledger.met_before(h, who="who", pos="pos").filter("back = 0")
    want = ledger.reused(now, past, who="who", pos="pos").select("who", "pos", "dup").join(ledger.clip_runs(now, past, who="who", pos="pos", most=5), ["who", "pos"])
    assert sorted(met.select("who", "pos", "dup", "run").collect()) == sorted(want.select("who", "pos", "dup", "run").collect())
    assert met.filter("dup").count() > 5 and met.filter("run > 1").count() > 0
    near = ledger.near_within(now, h, who="who", pos="pos", words=["w1", "w2"], threshold=2)
    assert sorted(near.select("who", "pos").collect()) == sorted(ledger.near_repeats(now, past, who="who", pos="pos", words=["w1", "w2"], threshold=2).collect())


def test_items_of_the_repetition_check_are_shuffled_once(spark):
    """Each part shuffled them anew before, and near repeats eight times as many rows."""
    plan = registry.QUERIES["repetition_total"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_block") == 0 and plan.count("Generate") == 0
