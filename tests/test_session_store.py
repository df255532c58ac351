import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import session_store as S
from tarn.streaming import session_store as live

T0 = dt.datetime(2024, 1, 1)


def plain(uses, ttl, most):
    """The store as a dictionary, one use after the other: sweep, use, evict."""
    store, out = {}, []
    for ts, event, id_ in sorted(uses):
        for old in [i for i, last in store.items() if (ts - last).total_seconds() > ttl]:
            del store[old]
        known = id_ in store
        store.pop(id_, None)
        store[id_] = ts
        gone = min(store, key=lambda i: store[i]) if len(store) > most else None
        store.pop(gone, None)
        out.append((event, id_, known, gone, len(store)))
    return sorted(out)


def log(seed, n, ids, gap):
    r, now, out = random.Random(seed), T0, []
    for i in range(n):
        now += dt.timedelta(seconds=r.choice([1, gap, gap * 2, 7]))
        out.append((now, i, f"s{int(r.random() ** 2 * ids)}"))
    return out


def frame(spark, uses):
    return spark.createDataFrame([(e, i, ts) for ts, e, i in uses], "event long, id string, ts timestamp_ntz")


@pytest.mark.parametrize("seed,ids,ttl,most,parts", [(1, 40, 300, 10, 6), (2, 15, 60, 200, 4), (3, 60, 1e6, 25, 9), (4, 8, 1e6, 30, 12)])
def test_replay_is_that_of_one_store(spark, seed, ids, ttl, most, parts):
    uses = log(seed, 400, ids, 20)
    got = sorted(map(tuple, S.replayed(frame(spark, uses).repartition(3), ttl, most, parts).collect()))
    assert got == plain(uses, ttl, most)


def test_idle_for_exactly_the_time_to_live(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    uses = [(at(0), 1, "a"), (at(3600), 2, "a"), (at(7200.000001), 3, "a"), (at(7200.000001), 4, "b"), (at(7300), 5, None)]
    got = {r["event"]: (r["known"], r["open"]) for r in S.replayed(frame(spark, uses)).collect()}
    assert got == {1: (False, 1), 2: (True, 1), 3: (False, 1), 4: (False, 2)}
    assert S.replayed(frame(spark, [])).count() == 0


def test_stream_gives_what_the_batch_does(spark, tmp_path):
    uses = log(7, 90, 12, 30)
    ttl, most = 200, 5
    for k in range(3):
        frame(spark, uses[k * 30 : k * 30 + 30]).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    (tmp_path / "flat").mkdir()
    for k in range(3):
        next((tmp_path / f"in/{k}").glob("*.parquet")).rename(tmp_path / f"flat/{k}.parquet")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("event long, id string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
        q = live.session_store(stream, ttl, most).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r["event"], r["id"], r["known"], r["evicted"], r["open"]) for r in out.where("what = 'use'").collect())
    batch = sorted(map(tuple, S.replayed(frame(spark, uses), ttl, most).collect()))
    assert got == batch == plain(uses, ttl, most)
    assert {r["id"] for r in out.where(F.col("what") == "expired").collect()} <= {i for _, _, i in uses}
