"""The cache as a stream against the batch rule, with late rows, expiry and a restart from its checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import catalogue
from loomwork.streaming import cache

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, old)


def test_dominated_versions_go():
    assert cache.worth_keeping([(5, 1, 9), (4, 2, 8), (3, 3, 20), (2, 4, 20), (1, 5, 30)], 8) == [(5, 1, 9), (3, 3, 20), (1, 5, 30)]
    rng = random.Random(1)
    for _ in range(300):
        vs = [(rng.randrange(20), i, rng.randrange(5, 40)) for i in range(rng.randrange(12))]
        kept = cache.worth_keeping(vs, 5)
        for now in range(5, 40):
            best = max((v for v in vs if v[2] > now), default=None)
            assert max((v for v in kept if v[2] > now), default=None) == best


def test_stream_of_versions_equals_the_batch_rule(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(9), "a" if i % 2 else None, base + dt.timedelta(minutes=i * 3 - rng.randrange(9)), None) for i in range(240)]
    rows = [(*r[:4], None if r[0] % 7 == 0 else r[3] + dt.timedelta(minutes=rng.randrange(1, 400))) for r in rows]
    fields = "event_id long, user_id long, kind string, ts timestamp, expires timestamp"

    def feed(part, name):
        spark.createDataFrame(part, fields).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        versions = spark.readStream.schema(fields).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = cache.valid_versions(versions, keys=["user_id", "kind"], id="event_id", at="ts", expires="expires")
        batches = []
        q = out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").foreachBatch(lambda df, i: batches.append(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        return [r for b in batches for r in b]

    seen = {}
    for n, (lo, hi) in enumerate([(0, 80), (80, 160), (160, 240)]):  # each run begins from the checkpoint of the last
        feed(rows[lo:hi], f"part{n}")
        for r in run():
            if (r["user_id"], r["kind"]) not in seen or r["asked"] >= seen[r["user_id"], r["kind"]][1]:
                seen[r["user_id"], r["kind"]] = (r["id"], r["asked"])
    asked = max(r[3] for r in rows) - dt.timedelta(minutes=10)
    batch = spark.createDataFrame(rows, fields).withColumn("kind", F.coalesce("kind", F.lit("-")))
    want = {(r["user_id"], None if r["kind"] == "-" else r["kind"]): r["event_id"] for r in catalogue.latest_valid(batch, keys=["user_id", "kind"], at="ts", expires="expires", as_of=F.lit(asked), tie="event_id").collect()}
    assert {k: v[0] for k, v in seen.items() if v[0] is not None} == want
