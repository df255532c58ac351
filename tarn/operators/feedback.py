"""Questions rewritten by what a first search finds (a relevance model), searched again, and both lists fused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import retrieval as R
from tarn.sources.shared import checkpointed

#: Documents of the first list whose words count, words that are added, and how often a question's own words are asked.
FEEDBACK, TERMS, OWN = 3, 10, 2


def expansions(first: DataFrame, corpus: DataFrame, asked: DataFrame, df: DataFrame, feedback: int = FEEDBACK, terms: int = TERMS) -> DataFrame:
    """(q, token, weight, rank): the words that stand out in the first documents (q, doc, rank) of a question, best first.

    A word weighs what share it has of each document, summed up, times the logarithm of how rare it is in the corpus. Words of the question don't
    count. df: statistics() of the corpus. Only the documents found are split; equal weights are in the order of words.
    """
    hits = first.where(F.col("rank") <= feedback).select("q", "doc")
    held = corpus.join(R.small(hits.select("doc").distinct()), "doc", "left_semi").select("doc", R.white_tokens(F.col("text")).alias("tokens"))
    rows = hits.join(held, "doc").select("q", F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    shares = checkpointed(rows.groupBy("q", "token").agg(F.round(F.sum(1 / F.col("dl")), 9).alias("share")))
    total = df.where("token = ''").select(F.col("df").alias("n"))
    known = df.join(R.small(shares.select("token").distinct()), "token").join(F.broadcast(total))
    own = asked.select("q", F.explode(F.array_distinct(R.white_tokens(F.col("text")))).alias("token"))
    weight = F.round(F.col("share") * F.log(F.col("n") / F.col("df")), 9)
    weighted = shares.join(R.small(own), ["q", "token"], "left_anti").join(R.small(known.select("token", "df", "n")), "token").select("q", "token", weight.alias("weight"))
    return R.top(weighted, terms, ["q"], F.desc("weight"), "token")


def rewritten(asked: DataFrame, added: DataFrame) -> DataFrame:
    """(q, text, original): a question's own words OWN times and the words added; one without any is asked as it was."""
    words = added.groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), " ").alias("more"))
    text = F.concat(*(F.concat(F.col("text"), F.lit(" ")) for _ in range(OWN)), F.col("more"))
    return asked.join(words, "q", "left").select("q", F.coalesce(text, "text").alias("text"), F.col("text").alias("original"))


def search(corpus: DataFrame, asked: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """"plain", "rewritten" and "fused": (q, doc, rank) lists of k of questions as asked, rewritten, and of both fused by rank;
    "questions": what was asked. The corpus (doc, text) is counted once."""
    df = R.statistics(corpus)
    plain = R.bm25_top(corpus, asked, k, df=df)
    questions = checkpointed(rewritten(asked, expansions(plain, corpus, asked, df)))
    again = R.bm25_top(corpus, questions.select("q", "text"), k, df=df)
    lists = plain.select("q", "doc", F.lit(1).alias("list_no"), "rank").unionByName(again.select("q", "doc", F.lit(2).alias("list_no"), "rank"))
    fused = R.rrf(lists, {1: 0.5, 2: 0.5}).where(F.col("rank") <= k)
    return {"plain": plain.select("q", "doc", "rank"), "rewritten": again.select("q", "doc", "rank"), "fused": fused.select("q", "doc", "rank"), "questions": questions}
