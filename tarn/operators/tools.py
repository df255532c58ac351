"""Rounds of tool calls: every call of a round is routed to its domain, searched, reranked and judged in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import retrieval as R
from tarn.operators import search
from tarn.sources.shared import checkpointed

#: What the names of tools begin with, rows a call fetches and keeps, and the score below which it is weak.
PREFIX, FETCHED, KEPT, SUFFICIENT = "search_", 10, 5, 0.30


def call_tools(calls: DataFrame, corpus: DataFrame, idf: DataFrame, unseen: DataFrame, reranked: bool = True) -> DataFrame:
    """(q, tool, n_docs, top_score, weak, error, docs) of the calls (q, tool, text) of one round. corpus (doc, text, domain).

    A tool is PREFIX and a domain, of which only the documents, and only their statistics, count. FETCHED documents are reranked
    by scores() and KEPT; without, the first KEPT of the list are, and nothing is weak. A tool without a domain is an error
    with no documents. docs: ids in order.
    """
    calls = calls.withColumn("domain", F.when(F.startswith("tool", F.lit(PREFIX)), F.substring("tool", len(PREFIX) + 1, 10**6)).otherwise(F.col("tool")))
    domains = checkpointed(corpus.select("domain").distinct().join(R.small(calls.select("domain").distinct()), "domain"))
    known = checkpointed(calls.join(R.small(domains), "domain", "left_semi"))
    error = calls.join(R.small(domains), "domain", "left_anti")
    docs = corpus.join(R.small(domains), "domain", "left_semi")
    # each question is scored with the documents of the domains it calls
    pool = checkpointed(R.bm25_top(docs, known.select("q", "domain", "text").distinct(), FETCHED, ["domain"]).select("q", "domain", "doc", "rank"))
    if reranked:
        scored = search.scores(pool.select("q", "doc").distinct(), docs, known.select("q", "text").distinct(), idf, unseen)
        kept = R.top(pool.withColumnRenamed("rank", "prior").join(scored, ["q", "doc"]), KEPT, ["q", "domain"], F.desc("score"), "prior")
    else:
        kept = pool.where(F.col("rank") <= KEPT).withColumn("score", F.lit(0.0))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"].cast("string")), ",")
    found = kept.groupBy("q", "domain").agg(F.count("*").alias("n_docs"), F.round(F.max("score"), 3).alias("top_score"), (F.max("score") < SUFFICIENT).alias("weak"), listed.alias("docs"))
    weak = F.col("weak") if reranked else F.lit(False)
    good = known.join(found, ["q", "domain"]).select("q", "tool", "n_docs", "top_score", weak.alias("weak"), F.lit(None).cast("string").alias("error"), "docs")
    bad = error.select("q", "tool", F.lit(0).cast("long").alias("n_docs"), F.lit(None).cast("double").alias("top_score"), F.lit(None).cast("boolean").alias("weak"), F.lit("unknown_tool").alias("error"), F.lit("").alias("docs"))
    return good.unionByName(bad)


def rounds(first: DataFrame, again: DataFrame, corpus: DataFrame, idf: DataFrame, unseen: DataFrame) -> DataFrame:
    """Two rounds: the calls `first`, and of `again` (q, tool, text) those of questions for which a call of the first round was
    weak or an error. (round, and the columns of call_tools())."""
    one = checkpointed(call_tools(first, corpus, idf, unseen))
    open_ = one.where("coalesce(weak, true)").select("q").distinct()
    two = call_tools(checkpointed(again.join(R.small(open_), "q", "left_semi")), corpus, idf, unseen)
    return one.withColumn("round", F.lit(1)).unionByName(two.withColumn("round", F.lit(2)))
