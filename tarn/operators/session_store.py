"""A bounded session store, replayed over a log: sessions idle for longer than a time to live are swept, and where more than
`most` are open, the one that was used least recently goes.

Which sessions are open is decided by the order of all uses, so a log can't be cut by session. It is cut by time: what a cut
must know of all that came before is the `most` ids used last, with the time of that use. Such a list is made of each cut,
and lists of neighbours are merged, over 1, 2, 4, ... cuts, until each is full. Then every cut is replayed for itself, with a
state that never holds more than `most` sessions.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.sources.shared import checkpointed

#: Seconds after the last use for which a session is kept, and sessions that are kept at most.
TTL, MOST = 3600.0, 200


class Store:
    """The open sessions, id -> time of the last use, least recent first. Times are microseconds."""

    def __init__(self, ttl: float, most: int, uses: list[tuple[str, int]] = []):  # noqa: B006
        self.ttl, self.most, self.open = round(ttl * 1_000_000), most, OrderedDict(uses)

    def sweep(self, now: int) -> list[str]:
        """Sessions idle for longer than the time to live; one that is idle for exactly as long stays."""
        gone = []
        while self.open:
            id_, last = next(iter(self.open.items()))
            if now - last <= self.ttl:
                break
            gone.append(id_)
            del self.open[id_]
        return gone

    def use(self, id_: str, now: int) -> tuple[bool, str | None]:
        """(whether the session was open, which one had to go)."""
        self.sweep(now)
        known = id_ in self.open
        self.open[id_] = now
        self.open.move_to_end(id_)
        return known, self.open.popitem(last=False)[0] if len(self.open) > self.most else None


def _merged(later: str, earlier: str, most: int):
    """The ids of two lists, least recent last, later ones first."""
    ids = F.transform(later, lambda x: x["id"])
    return F.slice(F.concat(later, F.filter(earlier, lambda x: ~F.array_contains(ids, x["id"]))), 1, most)


def used_before(cuts: DataFrame, most: int) -> DataFrame:
    """(part, uses): for every part the `most` ids that were used last before it. cuts (part, uses), parts from 0 without gaps,
    uses: array of (id, at), the most recent first."""
    parts = cuts.count()
    before = cuts.select((F.col("part") + 1).alias("part"), "uses").where(F.col("part") < parts)
    step = 1
    while step < parts:
        # a list that covers `step` parts and isn't full is continued by the list of the part where it ends
        before = checkpointed(before)
        if before.where((F.size("uses") < most) & (F.col("part") > step)).limit(1).count() == 0:
            break
        further = before.select((F.col("part") + step).alias("part"), F.col("uses").alias("earlier"))
        before = before.join(further, "part", "left").withColumn("earlier", F.coalesce("earlier", F.array().cast(dict(cuts.dtypes)["uses"])))
        before = before.select("part", _merged("uses", "earlier", most).alias("uses"))
        step *= 2
    return before


def replayed(log: DataFrame, ttl: float = TTL, most: int = MOST, parts: int | None = None) -> DataFrame:
    """(event, id, known, evicted, open): for each use of a log (event, id, ts) whether its session was open, which session
    went for it, and how many are open now. Uses are in order of ts and event; event is a long, id a string, ts without zone.

    Uses with a null id open a session that nobody asks for again: they are left out of the log, as are those without a
    time. An empty log gives an empty result.
    """
    rows = log.where("id is not null and ts is not null").select(F.col("event").cast("long").alias("event"), F.col("id").cast("string").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    ranged = rows.repartitionByRange(parts, "ts", "event") if parts else rows.repartitionByRange("ts", "event")
    cut = checkpointed(ranged.withColumn("_task", F.spark_partition_id()))
    # tasks without rows are no parts
    numbers = checkpointed(cut.groupBy("_task").agg(F.count("*").alias("n")).withColumn("part", F.row_number().over(Window.orderBy("_task")) - 1).select("_task", "part"))
    cut = cut.join(F.broadcast(numbers), "_task").drop("_task")
    last = cut.groupBy("part", "id").agg(F.max(F.struct("ts", "event")).alias("at"))
    recent = last.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("at")))).where(F.col("rank") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", F.col("at.ts").alias("at")))), lambda x: F.struct(x["id"].alias("id"), x["at"].alias("at")))
    states = used_before(recent.groupBy("part").agg(listed.alias("uses")), most)
    starts = states.select("part", F.explode("uses").alias("u")).select("part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("event"), F.col("u.id").alias("id"), F.col("u.at").alias("ts"))
    uses = cut.select("part", F.lit(1).alias("kind"), "event", "id", "ts")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, store = None, Store(ttl, most)
        for b in batches:
            out = []
            for p, kind, event, id_, ts in zip(b["part"].to_pylist(), b["kind"].to_pylist(), b["event"].to_pylist(), b["id"].to_pylist(), b["ts"].cast(pa.int64()).to_pylist()):
                if p != part:
                    part, store = p, Store(ttl, most)
                if kind == 0:
                    store.open[id_] = ts
                else:
                    known, gone = store.use(id_, ts)
                    out.append((event, id_, known, gone, len(store.open)))
            if out:
                kinds = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["event", "id", "known", "evicted", "open"])

    ordered = starts.unionByName(uses).repartition("part").sortWithinPartitions("part", "kind", "ts", "event")
    return ordered.mapInArrow(replay, "event long, id string, known boolean, evicted string, open long")
