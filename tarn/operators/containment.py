"""Which texts hold which passages word for word: an equi-join on one rare run of words of each passage, then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.retrieval import BROADCAST_BYTES, width
from tarn.sources.shared import checkpointed

#: Words of a run, and how many runs that are asked for each text's are intersected with in the row (80 KB).
RUN, FEW = 4, 10_000


def _runs(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return words


def holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (text, ...) joined with items (item, ...) that their text contains; null texts hold nothing.

    A passage found anywhere in a text has its inner words, all but the first and the last, as whole words of the text in
    a row. Of the passage's runs of RUN inner words the one with most letters, the least hash of equal ones, is what both
    sides are joined on. The few passages too short for a run are compared with every text, and their number is checked
    before they are broadcast.
    """
    # the words are a column of their own: inside the lambda they would be split anew for every run
    at = lambda w: F.sequence(F.lit(0), F.size(w) - RUN)
    key = lambda w, i: F.xxhash64(*(F.get(w, i + j) for j in range(RUN)))
    letters = lambda w, i: sum((F.length(F.get(w, i + j)) for j in range(1, RUN)), F.length(F.get(w, i)))
    inner = items.withColumn("_w", _runs(F.col("item"))).withColumn("_w", F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))))
    best = F.array_min(F.transform(at("_w"), lambda i: F.struct((-letters("_w", i)).alias("letters"), key("_w", i).alias("key"))))["key"]
    keyed = checkpointed(inner.withColumn("_key", F.when(F.size("_w") >= RUN, best)).drop("_w"))
    long_, short = keyed.where("_key is not null"), keyed.where("_key is null").drop("_key")
    # one look at the items tells what may be broadcast, and whether there are any short ones
    bytes_ = F.sum(width(keyed))
    about = keyed.agg(F.count_distinct("_key").alias("keys"), F.count_if(F.col("_key").isNull()).alias("short"), bytes_.alias("bytes")).first()
    few = F.broadcast if (about["bytes"] or 0) <= BROADCAST_BYTES else (lambda df: df)
    words = docs.withColumn("_w", _runs(F.col("text")))
    hashed = F.when(F.size("_w") >= RUN, F.array_distinct(F.transform(at("_w"), lambda i: key("_w", i))))
    if about["keys"] <= FEW:
        # one array of all keys: a text's own runs are intersected with it before anything is copied
        all_ = long_.agg(F.collect_set("_key").alias("_all"))
        found = words.withColumn("_runs", hashed).drop("_w").join(F.broadcast(all_)).withColumn("_key", F.explode(F.array_intersect("_runs", "_all"))).drop("_runs", "_all")
    else:
        known = long_.select("_key").distinct()
        found = words.withColumn("_key", F.explode(hashed)).drop("_w").join(few(known), "_key", "left_semi")
    hits = found.join(few(long_), "_key").drop("_key").where(F.contains("text", "item"))
    if not about["short"]:
        return hits
    return hits.unionByName(docs.join(few(short), F.contains(docs["text"], short["item"])))
