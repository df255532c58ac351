"""The session store of a stream of uses, as state with timers; the batch form is operators.session_store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarn.operators.session_store import MOST, TTL, Store

OUT = "event long, id string, known boolean, evicted string, open long, what string"


class Sessions(StatefulProcessor):
    """One store: at most `most` ids with the times of their last uses, and a timer for the one that expires first."""

    def __init__(self, ttl: float, most: int):
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uses = handle.getListState("uses", "id string, at long")

    def _load(self) -> Store:
        return Store(self.ttl, self.most, [(i, at) for i, at in self.uses.get()] if self.uses.exists() else [])

    def _save(self, store: Store) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not store.open:
            self.uses.clear()
            return
        self.uses.put(list(store.open.items()))
        # timers count milliseconds: the first one after the time to live has passed
        self.handle.registerTimer((next(iter(store.open.values())) + store.ttl) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values(["at", "event"])
        store, out = self._load(), []
        for event, id_, at in zip(batch["event"], batch["id"], batch["at"]):
            known, gone = store.use(id_, int(at))
            out.append((event, id_, known, gone, len(store.open), "use"))
        self._save(store)
        yield pd.DataFrame(out, columns=["event", "id", "known", "evicted", "open", "what"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        store = self._load()
        gone = store.sweep(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._save(store)
        yield pd.DataFrame([(None, id_, None, None, len(store.open), "expired") for id_ in gone], columns=["event", "id", "known", "evicted", "open", "what"]).astype({"event": "Int64", "known": "boolean"})


def session_store(uses: DataFrame, ttl: float = TTL, most: int = MOST, late: str = "0 seconds", shards: int = 1) -> DataFrame:
    """(event, id, known, evicted, open, what) of a stream (event, id, ts): a row for each use, as replayed() has it, and one for
    each session that expires (what = 'expired') once the watermark has passed its time.

    A store is a shard of the ids by hash, each with its own `most`, as each process that serves has one of its own. Uses of one
    micro-batch are put in order; those of a later one must not be earlier. The session's state store must be RocksDB.
    """
    timed = uses.where("id is not null and ts is not null").withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    rows = timed.select("event", "id", "time", F.unix_micros("time").alias("at"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    return rows.groupBy("shard").transformWithStateInPandas(Sessions(ttl, most), OUT, outputMode="Append", timeMode="EventTime")
