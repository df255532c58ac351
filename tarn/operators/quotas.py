"""Greedy selection under quotas that buckets share: each pick changes what the next ones are worth.

Picks follow one another over all buckets, so only what can be picked at all reaches the one task that picks. With T picks in
all, at most T pieces of evidence are ever used. Of the rows of one bucket, type and topic, one whose evidence is not among
the T + 1 best (by the best row that has it) is always behind a better row with unused evidence, and of rows that share
evidence too no more than the bucket's target can be picked. The rest is cut by two windows with a limit on the rank, which
Spark applies before the shuffle as well. What is left doesn't grow with the table, as long as types and topics are
categories.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a row loses or gains for itself.
TIER = {"high": 0.0, "acceptable": 0.35, "problematic": 2.0}
DIFFICULTY = {"easy": 0.0, "medium": 0.18, "hard": 0.35}
REDUNDANT, SELF_CITING, CROSS_LINGUAL = 0.45, 0.30, 0.20
#: What picks before it change: the type's share of its bucket and of the quota, evidence and topic used.
SHARE, LEAST_SHARE, OVER_SHARE, PRESSURE, FILLED, EVIDENCE, TOPIC = 0.60, 3, 0.90, 0.70, 0.55, 0.35, 0.12


def own_value(score: Column, tier: Column, difficulty: Column, redundant: Column, self_citing: Column, cross_lingual: Column) -> Column:
    """What a row is worth before any pick; null, which is never picked, for other tiers than those of TIER. A null flag is
    no flag, a null or other difficulty is easy, a null score null."""
    by = lambda c, values: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in values.items()))
    less = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(0.0)
    return score - by(tier, TIER) - less(redundant, REDUNDANT) - less(self_citing, SELF_CITING) + F.coalesce(by(difficulty, DIFFICULTY), F.lit(0.0)) - less(cross_lingual, CROSS_LINGUAL)


def pickable(rows: DataFrame, targets: dict[str, int]) -> DataFrame:
    """The rows (bucket, id, qtype, evidence, topic, value) that can be picked at all; see above."""
    most = sum(targets.values())
    least_first = (F.desc("value"), F.asc("id"))
    same = ["bucket", "qtype", "topic"]
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy(*same, "evidence").orderBy(*least_first))).where(F.col("n") <= max(targets.values(), default=0))
    best = kept.where("n = 1").withColumn("k", F.row_number().over(Window.partitionBy(*same).orderBy(*least_first))).where(F.col("k") <= most + 1)
    return kept.drop("n").join(best.select(*same, "evidence"), [*same, "evidence"], "left_semi")


def picks(rows: pd.DataFrame, order: list[str], targets: dict[str, int], quotas: dict[str, int]) -> list[tuple[str, int, int]]:
    """(bucket, id, place) of the rows picked, bucket after bucket.

    A heap for each type of the bucket: within a type what earlier picks take away only grows, so a row taken from the top is
    valued again and put back if it lost, and only the tops of the types are compared.
    """
    types, evidence, topics = Counter(), Counter(), Counter()
    waiting: dict[str, list] = defaultdict(list)
    for r in rows.itertuples(index=False):
        waiting[r.bucket].append(r)
    out = []
    for bucket in order:
        want, here = targets[bucket], Counter()
        share = max(LEAST_SHARE, int(want * SHARE))
        heaps: dict[str, list] = defaultdict(list)
        now = lambda r: round(r.value - EVIDENCE * evidence[r.evidence] - TOPIC * topics[r.topic], 9)
        for r in waiting.pop(bucket, []):
            heaps[r.qtype].append((-now(r), r.id, r))
        for heap in heaps.values():
            heapq.heapify(heap)
        for place in range(1, want + 1):
            need = {t: max(0, n - types[t]) for t, n in quotas.items()}
            total, best = sum(need.values()), None
            for t, heap in heaps.items():
                while heap and (fresh := -now(heap[0][2])) != heap[0][0]:
                    heapq.heapreplace(heap, (fresh, heap[0][1], heap[0][2]))
                if heap:
                    of_type = (PRESSURE * need.get(t, 0) / total if total else 0.0) - (0.0 if need.get(t) else FILLED) - (OVER_SHARE if here[t] >= share else 0.0)
                    top = (-round(of_type - heap[0][0], 9), heap[0][1], t)
                    best = top if best is None or top < best else best
            if best is None:
                break
            r = heapq.heappop(heaps[best[2]])[2]
            for counter, key in ((types, r.qtype), (here, r.qtype), (evidence, r.evidence), (topics, r.topic)):
                counter[key] += 1
            out.append((bucket, r.id, place))
    return out


def quota_selection(rows: DataFrame, targets: dict[str, int], quotas: dict[str, int]) -> DataFrame:
    """(bucket, id, place) of the rows picked from rows (bucket, id, qtype, evidence, topic, value).

    targets has the picks of each bucket, quotas the picks of each type over all buckets. The bucket with the fewest rows
    beyond its target chooses first, of equal ones the one named first. Rows of other buckets or with a null id or value aren't
    picked, though those of a bucket count for its order. A null type, evidence or topic is one of its own; a type without
    quota needs none. Ties go to the lower id; ids are unique. An empty table gives an empty result.
    """
    known = rows.where(F.col("bucket").isin(list(targets)))
    sizes = {r["bucket"]: r["n"] for r in known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a target
    order = sorted(targets, key=lambda b: sizes.get(b, 0) - targets[b])
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in ("evidence", "topic")]
    able = known.where("id is not null and value is not null").select("bucket", F.col("id").cast("long").alias("id"), F.coalesce("qtype", F.lit("")).alias("qtype"), *keys, F.col("value").cast("double").alias("value"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(picks(group, order, targets, quotas), columns=["bucket", "id", "place"])

    return pickable(able, targets).withColumn("together", F.lit(True)).groupBy("together").applyInPandas(pick, "bucket string, id long, place int")
