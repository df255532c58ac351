"""Hybrid search: BM25 and dense lists of one corpus fused by content, reranked, and the gate before it."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import retrieval as R
from tarn.sources.shared import checkpointed

#: Rows that each leg of a hybrid search fetches, nearest utterances of the gate and its threshold.
FETCH, NEAREST, THRESHOLD = 10, 5, 0.63


@dataclass(frozen=True)
class Preset:
    """How a question is answered: which lists, how many rows are kept, whether they are reranked."""

    strategy: str = "hybrid"
    k: int = 10
    rerank: bool = True
    top_n: int = 5
    domain: str | None = None


#: The presets of the search, and of the retrieval variants before it.
PRESETS = {
    "default": Preset(),
    "dense_only": Preset("dense", 5, False),
    "hybrid_no_rerank": Preset("hybrid", 5, False),
    "rerank_no_hybrid": Preset("dense", 10, True),
    "v1": Preset("dense", 5, False),
    "v2": Preset("dense", 20, True),
    "v3": Preset("hybrid", 5, False),
    "v4": Preset("hybrid", 20, True),
    "lexical": Preset("bm25", 5, False),
}


def legs(corpus: DataFrame, asked: DataFrame, k: int, strategy: str) -> DataFrame:
    """(q, doc, list_no, rank) of the lists of a strategy: 1 is BM25, 2 dense. corpus (doc, text, dv), asked (q, text, qv)."""
    out = []
    if strategy in ("bm25", "hybrid"):
        out.append(R.bm25_top(corpus.select("doc", "text"), asked.select("q", "text"), k).select("q", "doc", F.lit(1).alias("list_no"), "rank"))
    if strategy in ("dense", "hybrid"):
        # what has no vector has no dense rank
        out.append(R.dense(asked.select("q", "qv").where("qv is not null"), corpus.select("doc", "dv").where("dv is not null"), F.round(R.dot("qv", "dv"), 4), k, unit=True).select("q", "doc", F.lit(2).alias("list_no"), "rank"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def fused(lists: DataFrame, corpus: DataFrame) -> DataFrame:
    """(q, doc, score, rank): lists of FETCH rows fused with equal weights; rows with equal text are one, the first to come."""
    lists = lists.where(F.col("rank") <= FETCH)
    keyed = lists.join(R.small(lists.select("doc").distinct()).join(corpus.select("doc", F.sha1(F.coalesce("text", F.lit(""))).alias("content")), "doc"), "doc")
    out = R.rrf(keyed.select("q", F.col("content").alias("doc"), "list_no", "rank"), {1: 0.5, 2: 0.5})
    first = keyed.groupBy("q", "content").agg(F.min_by("doc", F.struct("list_no", "rank")).alias("doc"))
    return out.withColumnRenamed("doc", "content").join(first, ["q", "content"]).select("q", "doc", "score", "rank")


def hybrid(corpus: DataFrame, asked: DataFrame, strategy: str = "hybrid") -> DataFrame:
    return fused(checkpointed(legs(corpus, asked, FETCH, strategy)), corpus)


def presets(corpus: DataFrame, asked: DataFrame, idf: DataFrame, unseen: DataFrame, names: list[str]) -> DataFrame:
    """(preset, q, doc, rank) of several presets at once: both lists are made once, as long as any preset needs them, and every
    pool is a part of them; the pools of all presets that rerank are scored together."""
    chosen = {n: PRESETS[n] for n in names}
    longest = max([FETCH, *(p.k for p in chosen.values())])
    lists = checkpointed(legs(corpus, asked, longest, "hybrid"))
    fuse = checkpointed(fused(lists, corpus))
    lists_of = {"hybrid": fuse, "dense": lists.where("list_no = 2"), "bm25": lists.where("list_no = 1")}
    pools = {n: lists_of[p.strategy].where(F.col("rank") <= p.k).select(F.lit(n).alias("preset"), "q", "doc", "rank") for n, p in chosen.items()}
    plain = [pools[n].where(F.col("rank") <= p.top_n) for n, p in chosen.items() if not p.rerank]
    ranked = [pools[n] for n, p in chosen.items() if p.rerank]
    if ranked:
        all_ = checkpointed(functools.reduce(DataFrame.unionByName, ranked))
        scored = scores(all_.select("q", "doc").distinct(), corpus, asked, idf, unseen)
        again = all_.join(scored, ["q", "doc"]).withColumnRenamed("rank", "prior_rank")
        depth = F.coalesce(*(F.when(F.col("preset") == n, F.lit(p.top_n)) for n, p in chosen.items()))
        most = max(p.top_n for p in chosen.values())
        plain.append(R.top(again, most, ["preset", "q"], F.desc("score"), "prior_rank").where(F.col("rank") <= depth).select("preset", "q", "doc", "rank"))
    return functools.reduce(DataFrame.unionByName, plain)


def scores(pool: DataFrame, corpus: DataFrame, asked: DataFrame, idf: DataFrame, unseen: DataFrame) -> DataFrame:
    """(q, doc, score) of pairs (q, doc): how much of the question's rare tokens the document holds. A question is scored as it
    was asked: by its original where it was rewritten.

    asked (q, text[, original]); idf (key, idf) and unseen, one row, are the corpus's (see audit.key_idf).
    """
    text = F.coalesce("original", "text") if "original" in asked.columns else F.col("text")
    # a token counts as often as it is asked, and each distinct one is a row
    tokens = asked.select("q", F.explode(T.keys(T.content_tokens(text))).alias("key")).groupBy("q", "key").agg(F.count("*").alias("times"))
    weighted = tokens.join(R.small(idf.select("key", "idf")), "key", "left").join(F.broadcast(unseen.select(F.greatest(F.log("n") + 1, F.lit(0.05)).alias("unseen"))))
    weighted = weighted.select("q", "key", (F.col("times") * F.coalesce("idf", "unseen")).alias("w"))
    held = corpus.join(R.small(pool.select("doc").distinct()), "doc").select("doc", F.array_distinct(T.keys(T.content_tokens(F.col("text")))).alias("keys"))
    rows = pool.select("q", "doc").join(held, "doc").join(weighted, "q", "left")
    score = F.coalesce(F.round(F.sum(F.when(F.array_contains("keys", F.col("key")), F.col("w")).otherwise(0.0)) / F.sum("w"), 6), F.lit(0.0))
    return rows.groupBy("q", "doc").agg(score.alias("score"))


def rerank(pool: DataFrame, corpus: DataFrame, asked: DataFrame, idf: DataFrame, unseen: DataFrame, top_n: int) -> DataFrame:
    """(q, doc, prior_rank, score, rank): the pool (q, doc, rank) by scores(), equal ones in their order."""
    scored = pool.select("q", "doc", F.col("rank").alias("prior_rank")).join(scores(pool, corpus, asked, idf, unseen), ["q", "doc"])
    return R.top(scored, top_n, ["q"], F.desc("score"), "prior_rank").select("q", "doc", "prior_rank", "score", "rank")


def gate(neighbours: DataFrame, questions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(q, intent) of every question from its nearest utterances (q, valid, score): the class with the higher mean if that
    reaches the threshold; valid where none does, and where there are no neighbours (the gate fails open)."""
    points = F.round(F.col("score") * 10000).cast("long")
    mean = lambda of: F.floor(F.sum(F.when(of, points)) / F.sum(F.when(of, F.lit(1)))) / 10000
    means = neighbours.groupBy("q").agg(mean(F.col("valid")).alias("v"), mean(~F.col("valid")).alias("i"))
    refused = F.coalesce(F.col("i") >= threshold, F.lit(False)) & (F.col("v").isNull() | (F.col("i") >= F.col("v")))
    return questions.select("q").join(means.select("q", F.when(refused, "invalid").otherwise("valid").alias("intent")), "q", "left").select("q", F.coalesce("intent", F.lit("valid")).alias("intent"))
