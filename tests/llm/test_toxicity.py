import random
import zlib

import numpy as np

from tarn.llm import toxicity as X


def corpus(n=900, seed=1):
    r = random.Random(seed)
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        w = r.choices(words, k=r.randint(20, 120))
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), r.choice(["vile", "scum!", "Nasty,", f"zorg{r.randint(0, 9999)}"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_rows(spark):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (5002, "word " * 50_000), (5003, "x"), (5003, "x")]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(3)
    lab = spark.createDataFrame([*labels, (9999, 1), (5, None)], "doc_id long, toxic int")
    rows = X.toxicity(df, lab).collect()
    assert len(rows) == len(docs)
    truth, right, held = dict(labels), 0, 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"] and r["id"] in truth:
            held += 1
            right += r["predicted"] == truth[r["id"]]
    assert held > 200 and right / held > 0.97


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in X.toxicity(docs, none).collect()] == [0, 0]
    assert X.toxicity(docs.limit(0), none).collect() == []


def simulated(seed=0, n=4000, wrong=0.15):
    """Truth, labels with a part turned over, and votes: some voters for each class, one of them three times."""
    r = np.random.default_rng(seed)
    y = r.random(n) < 0.3
    speak = {0: (0.6, 0.03), 1: (0.45, 0.05), 2: (0.3, 0.1), 3: (0.05, 0.5), 4: (0.5, 0.06), 5: (0.2, 0.2)}  # in toxic, in clean rows
    cols = [r.random(n) < np.where(y, a, b) for a, b in speak.values()]
    cols += [cols[0], cols[0]]
    votes = X.Votes(X.pa.array([np.flatnonzero(row).tolist() for row in np.stack(cols, 1)], X.pa.list_(X.pa.int32())), len(cols))
    return y, np.where(r.random(n) < wrong, ~y, y), votes


def test_label_model_beats_noisy_labels():
    y, noisy, votes = simulated()
    p, accuracy, weight, right = X.posteriors(votes, noisy.astype(int))
    raw = (noisy == y).mean()
    assert raw < 0.87 and ((p > 0.5) == y).mean() > raw + 0.05
    # the accuracy of the labels is found too, far from where the rounds start
    assert abs(right[0] - 0.85) < 0.04 and abs(right[1] - 0.85) < 0.05
    assert abs(accuracy[0] - y[votes.row[votes.voter == 0]].mean()) < 0.08
    assert weight[0] < 0.5 < weight[1]


def test_classifier_on_posteriors_beats_one_on_noisy_labels():
    y, noisy, votes = simulated(wrong=0.35)
    test_y, _, test_votes = simulated(seed=9)
    p = X.posteriors(votes, noisy.astype(int))[0]

    def loss(target):
        w = X.logistic(votes, target)
        z = np.clip(1 / (1 + np.exp(-(test_votes.by_row(w[:-1]) + w[-1]))), 1e-6, 1 - 1e-6)
        return -np.mean(np.where(test_y, np.log(z), np.log(1 - z)))

    assert loss(p) < loss(noisy.astype(float))


def test_voters():
    v = X.Voters(["=bad", "^zor"])
    name = lambda t: [v.names[i] for i in v.votes(t)]
    assert name("BAD zorro, bade") == ["=bad", "^zor", "none of any"]
    assert name("You are such a stupid idiot!") == ["one of en", "two of en", "one of de", "one of fr", "you are", "such"]
    assert name(None) == name("") == ["none of any"]
    assert name("shut up") == ["none of any", "shut up"]


def test_families_inside_others_are_left_out(spark):
    texts = [("zorga bla", 1), ("zorgb blu", 1), ("zorgc", 1), ("zorgc zorgd", 1)] * 5 + [("bla", 0), ("blu blo", 0)] * 40
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "id long, text string, toxic int")
    got = {r[0] for r in X.leaning(rows, 80, 20).collect()}
    assert "^zor" in got and not any(f.startswith(("^zorg", "=zorg")) for f in got)
