"""Selections that are sequential by nature: greedy picks under quotas, and bounded rounds of search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import retrieval as R
from tarn.sources.shared import checkpointed


def greedy_selection(candidates: DataFrame, quota: int, penalty: float = 0.25) -> DataFrame:
    """(bucket, id, place): of each bucket, quota picks, each the best by score less penalty for each pick of its group.

    Per bucket only the best quota of each group can be picked, so that is all that reaches a task: candidates
    (bucket, id, grp, score) are cut to those by rank first.
    """
    best = R.top(candidates, quota, ["bucket", "grp"], F.desc("score"), "id").drop("rank")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True])
        used: dict[object, int] = {}
        left, out = list(group.itertuples(index=False)), []
        while left and len(out) < quota:
            at = max(range(len(left)), key=lambda i: (round(left[i].score - penalty * used.get(left[i].grp, 0), 6), -left[i].id))
            row = left.pop(at)
            used[row.grp] = used.get(row.grp, 0) + 1
            out.append((row.bucket, row.id, len(out) + 1))
        return pd.DataFrame(out, columns=["bucket", "id", "place"])

    return best.groupBy("bucket").applyInPandas(pick, "bucket string, id long, place int")


def search_rounds(queries: DataFrame, corpus: DataFrame, rounds: int = 3, k: int = 10, kept: int = 5, weak: float = 0.35) -> DataFrame:
    """(q, round, doc, score, rank): each round fetches k for all queries (q, qv) that are still active at once, and keeps
    some; a query is done when its best score is not weak. Later rounds add the best document's vector to the query."""
    docs = corpus.select("doc", F.transform("dv", lambda x: x.cast("double")).alias("dv"))
    active, out = checkpointed(queries.select("q", F.transform("qv", lambda x: x.cast("double")).alias("qv"))), None
    for n in range(1, rounds + 1):
        found = checkpointed(R.best_of(active, docs, k).select("q", F.lit(n).alias("round"), "doc", "score", "rank"))
        part = found.where(F.col("rank") <= kept)
        out = part if out is None else out.unionByName(part)
        again = found.where((F.col("rank") == 1) & (F.col("score") < weak)).select("q", "doc")
        if n < rounds:
            more = docs.join(R.small(again), "doc").join(active, "q")
            active = checkpointed(more.select("q", F.zip_with("qv", "dv", lambda a, b: a + b).alias("qv")))
    return out
