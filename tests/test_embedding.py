import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarn.operators import embedding as E
from tarn.operators import retrieval as R


def corpus(n, seed):
    """Texts of ten topics, each with words of its own and some of all."""
    r = random.Random(seed)
    return [(i, " ".join(r.choices([f"t{i % 10}w{j}" for j in range(30)], k=25) + r.choices([f"common{j}" for j in range(40)], k=15))) for i in range(n)]


def exact(rows):
    """Cosines of tf-idf rows, without hashing."""
    bags = [Counter(t.split()) for _, t in rows]
    df = Counter(w for b in bags for w in b)
    at = {w: i for i, w in enumerate(df)}
    m = np.zeros((len(rows), len(at)))
    for i, b in enumerate(bags):
        for w, c in b.items():
            m[i, at[w]] = (1 + math.log(c)) * math.log((1 + len(rows)) / df[w])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m


def test_directions_are_those_of_the_matrix(spark):
    rows = corpus(120, 1)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    model = E.fit(docs, dims=10, rounds=6)
    assert np.allclose(model.basis.T @ model.basis, np.eye(10), atol=1e-6)
    words = sorted({w for _, t in rows for w in t.split()})
    bucket = {r["text"]: r["ids"][0] for r in E.buckets(spark.createDataFrame([(w,) for w in words], "text string")).collect()}
    m, first = exact(rows), list(dict.fromkeys(w for _, t in rows for w in t.split()))
    image = m @ model.basis[[bucket[w] for w in first]]
    best = (np.linalg.svd(m, compute_uv=False)[:10] ** 2).sum()
    assert 0.97 * best < (image**2).sum() < 1.03 * best  # some words share a bucket
    got = np.array([r["vector"] for r in E.embed(docs, model).orderBy("id").collect()])
    assert np.abs(got - image / np.linalg.norm(image, axis=1, keepdims=True)).max() < 0.1
    again = np.array([r["vector"] for r in E.embed(docs.repartition(7), model).orderBy("id").collect()])
    assert np.allclose(got, again, atol=1e-6)


def test_near_texts_are_found(spark):
    rows = corpus(200, 2)
    r = random.Random(3)
    for i in range(40):  # texts of which a fifth of the words is another's
        words = rows[i][1].split()
        for j in r.sample(range(len(words)), 8):
            words[j] = f"common{r.randint(0, 39)}"
        rows.append((200 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "id long, text string")
    model = E.fit(docs)
    v = E.embed(docs, model)
    found = R.dense(v.where("id >= 200").select(F.col("id").alias("q"), F.col("vector").alias("qv")), v.select(F.col("id").alias("doc"), F.col("vector").alias("dv")), F.lit(0.0), 10, unit=True)
    near = {(x["q"], x["doc"]) for x in found.collect()}
    m = exact(rows)
    top = {(q, int(d)) for q in range(200, 240) for d in np.argsort(-(m @ m[q]) + 9 * (np.arange(240) == q))[:10] if m[d] @ m[q] >= 0.5}
    assert len(top) >= 40 and len(near & top) >= 0.9 * len(top)


def test_questions_weigh_words_once_and_odd_texts(spark):
    docs = spark.createDataFrame(corpus(60, 4), "id long, text string")
    model = E.fit(docs, dims=8, rounds=3)
    texts = spark.createDataFrame([(1, "t1w1 t1w1 t1w1 t2w2"), (2, "t1w1 t2w2"), (3, None), (4, "unknown words"), (None, "t1w1 t2w2")], "id long, text string")
    q = {r["id"]: r["vector"] for r in E.embed(texts, model, question=True).collect()}
    d = {r["id"]: r["vector"] for r in E.embed(texts, model).collect()}
    assert np.allclose(q[1], q[2]) and not np.allclose(d[1], d[2]) and np.allclose(q[None], q[2])
    assert not any(q[3]) and not any(q[4])
    empty = E.fit(docs.where("false"), dims=4, rounds=1)
    assert E.embed(docs, empty).count() == 60


def test_texts_are_counted_once_and_sums_are_few(spark):
    rows = [*corpus(90, 5), (90, None), (91, ""), (92, "t1w1 T1W1, t2w2")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(60)
    sc = spark.sparkContext
    sc.setJobGroup("fit", "fit")
    model = E.fit(docs, dims=8, rounds=3)
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("fit") for s in tracker.getJobInfo(j).stageIds}
    tasks = [i.numTasks for s in stages if (i := tracker.getStageInfo(s))]
    # each task of a round sends a matrix: only the pass over the texts has as many tasks as they have partitions
    assert tasks and sum(n >= 60 for n in tasks) <= 1
    known = E.counted(docs).cache()
    got = {r["id"]: r for r in known.collect()}
    assert sorted(got[92]["ns"]) == [1, 2] and got[92]["ids"] == sorted(set(got[92]["ids"])) and got[90]["ids"] == got[91]["ns"] == []
    assert np.allclose(E.fit(known, dims=8, rounds=3).basis, model.basis, atol=1e-6)
    v, w = ({r["id"]: r["vector"] for r in E.embed(x, model).collect()} for x in (docs, known))
    assert v.keys() == w.keys() and all(np.allclose(v[i], w[i]) for i in v) and not any(v[90])
