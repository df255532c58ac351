import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarn.operators import feedback, search, tools
from tarn.operators import retrieval as R
from tarn.sources import shared


def brute(docs, questions, k):
    """{(q, group): [(doc, score)]}: the k best by Okapi BM25, documents without a common token at 0, ties by id."""
    out = {}
    for g in {x[2] for x in docs}:
        mine = {i: t.split() for i, t, h in docs if h == g}
        df, n = Counter(w for t in mine.values() for w in set(t)), len(mine)
        avg = sum(map(len, mine.values())) / n
        raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
        mean = sum(raw.values()) / len(raw)
        idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
        for q, text in questions:
            rows = []
            for i, t in mine.items():
                tf = Counter(t)
                s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split() if w in tf)
                rows.append((-round(s, 6), i))
            out[q, g] = [(i, -s) for s, i in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_lists_are_full_and_in_order(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(r.choices(words, weights=[30, 9, *[1] * 10], k=r.randint(1, 9))), r.choice("ab")) for i in range(40)]
    questions = [(1, "w0 w3 w3"), (2, "w7"), (3, "none of it"), (4, "w0")]
    df = spark.createDataFrame(docs, "doc long, text string, g string")
    asked = spark.createDataFrame(questions, "q long, text string")
    got = {}
    for x in R.bm25_top(df, asked, 4, ["g"]).orderBy("rank").collect():
        got.setdefault((x["q"], x["g"]), []).append((x["doc"], x["score"]))
    want = brute(docs, questions, 4)
    assert got.keys() == want.keys()
    for key in want:
        assert [d for d, _ in got[key]] == [d for d, _ in want[key]] and [s for _, s in got[key]] == pytest.approx([s for _, s in want[key]], abs=2e-6)


def test_rewriting_finds_what_the_words_of_the_first_list_say(spark):
    docs = [(1, "apple pie crust"), (2, "crust dough oven"), (3, "oven heat"), (4, "car wheel"), (5, "road car"), (6, "tree leaf"), (7, "sea salt")]
    corpus, asked = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame([(1, "apple"), (2, "nothing known")], "q long, text string")
    df = R.statistics(corpus)
    added = feedback.expansions(R.bm25_top(corpus, asked, 1, df=df), corpus, asked, df, feedback=1)
    assert [(x["token"], x["rank"]) for x in added.where("q = 1").orderBy("rank").collect()] == [("pie", 1), ("crust", 2)]
    q = {x["q"]: (x["text"], x["original"]) for x in feedback.rewritten(asked, added.where("q = 1")).collect()}
    assert q == {1: ("apple apple pie crust", "apple"), 2: ("nothing known", "nothing known")}
    found = feedback.search(corpus, asked, 2)
    assert [x["doc"] for x in found["rewritten"].where("q = 1").orderBy("rank").collect()] == [1, 2]


def test_documents_without_a_vector_are_searched_by_words(spark):
    corpus = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "beta gamma", None), (3, "delta", [0.0, 1.0]), (4, "other words", None)], "doc long, text string, dv array<double>")
    asked = spark.createDataFrame([(-1, "gamma", [0.9, 0.1]), (-2, "delta", None)], "q long, text string, qv array<double>")
    got = {}
    for x in search.hybrid(corpus, asked).orderBy("rank").collect():
        got.setdefault(x["q"], []).append(x["doc"])
    assert set(got[-1]) == {1, 2, 3, 4} and got[-2][0] == 3 and set(got[-2]) == {1, 2, 3, 4}


def test_tools(spark):
    docs = [(1, "apple pie apple", "food"), (2, "bread butter", "food"), (3, "apple tree", "plant"), (4, "fern", "plant")]
    corpus = spark.createDataFrame(docs, "doc long, text string, domain string")
    idf = spark.createDataFrame([("apple", 1.0), ("pie", 2.0), ("tree", 1.0)], "key string, idf double")
    unseen = spark.createDataFrame([(4,)], "n long")
    calls = spark.createDataFrame([(1, "search_food", "apple pie"), (2, "search_cars", "apple"), (3, "search_plant", "pie"), (3, "food", "pie")], "q long, tool string, text string")
    got = {(x["q"], x["tool"]): x for x in tools.call_tools(calls, corpus, idf, unseen).collect()}
    assert got[1, "search_food"]["docs"] == "1,2" and got[1, "search_food"]["top_score"] == 1.0 and got[1, "search_food"]["weak"] is False
    assert got[2, "search_cars"]["error"] == "unknown_tool" and got[2, "search_cars"]["n_docs"] == 0 and got[2, "search_cars"]["weak"] is None
    assert got[3, "search_plant"]["weak"] is True and got[3, "food"]["weak"] is False
    plain = {(x["q"], x["tool"]): x["weak"] for x in tools.call_tools(calls, corpus, idf, unseen, reranked=False).collect()}
    assert plain[3, "search_plant"] is False
    again = calls.where("q < 3").withColumn("tool", F.lit("search_plant"))
    two = {(x["round"], x["q"], x["tool"]) for x in tools.rounds(calls, again, corpus, idf, unseen).collect()}
    assert {x for x in two if x[0] == 2} == {(2, 2, "search_plant")}


def test_only_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert shared.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(shared, "FEW_BYTES", 1)
    assert shared.spread(df) is df


def test_tasks_score_a_bounded_number_and_questions_one_group(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 3} x", "ab"[i % 2]) for i in range(40)], "doc long, text string, g string")
    asked = spark.createDataFrame([(1, "w0 x", "a"), (2, "w1", "b"), (3, "w2", "none")], "q long, text string, g string")
    monkeypatch.setattr(R, "SCORES", 6)
    assert R.bm25(docs.drop("g"), asked.drop("g")).rdd.getNumPartitions() == 20
    all_ = {tuple(x) for x in R.bm25_top(docs, asked.drop("g"), 3, ["g"]).select("q", "g", "doc", "score", "rank").collect()}
    own = {tuple(x) for x in R.bm25_top(docs, asked, 3, ["g"]).select("q", "g", "doc", "score", "rank").collect()}
    assert own == {x for x in all_ if x[:2] in {(1, "a"), (2, "b")}} and len(own) == 6
