"""Blocks of products against pairs one by one: queries of dense search and statistics of pairs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import pairs
from tarn.operators import retrieval as R


def half_up(x):
    return np.copysign(np.floor(abs(x) * 10000 + 0.5), x) / 10000 + 0.0


def vectors(seed, n, same):
    r = random.Random(seed)
    some = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(same)]
    return [(i, some[r.randrange(same)] if i % 3 else [r.uniform(-1, 1) for _ in range(4)]) for i in range(n)]


def cosine(x, y):
    return half_up(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))


@pytest.mark.parametrize("most", [200, 1 << 20])
@pytest.mark.parametrize("distance", [True, False])
def test_nearest_in_blocks(spark, monkeypatch, distance, most):
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "CELLS", 20)
    monkeypatch.setattr(R, "QUERY_BYTES", most)
    rows = vectors(1, 60, 3)
    df = spark.createDataFrame(rows, "doc long, dv array<double>").repartition(3)
    asked = df.where("doc % 5 = 0").select(F.col("doc").alias("q"), F.col("dv").alias("qv"))
    got = {(x["q"], x["rank"]): (x["doc"], x["score"]) for x in R.best_of(asked, df, 4, distance=distance).collect()}
    score = (lambda x, y: half_up(sum((a - b) ** 2 for a, b in zip(x, y)))) if distance else (lambda x, y: -cosine(x, y))
    want = {}
    for q, x in rows[::5]:
        best = sorted((score(x, y), d) for d, y in rows if d != q)[:4]
        want |= {(q, i + 1): (d, s if distance else -s) for i, (s, d) in enumerate(best)}
    assert got == want


def test_halves_are_rounded_up(spark):
    one = [1.0] * 32
    df = spark.createDataFrame([(0, [1.0] * 32), (1, [1.0] * 16 + [-1.0] * 15 + [1.0])], "doc long, dv array<double>")
    assert R.digits(np.array([1 / 32, -1 / 32, 0.0])).tolist() == [313.0, -313.0, 0.0]
    asked = spark.createDataFrame([(5, one)], "q long, qv array<double>")
    assert [x["score"] for x in R.best_of(asked, df, 2).orderBy("rank").collect()] == [1.0, 0.0625]


def test_copies_leave_a_block_k_at_a_time(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "doc long, dv array<double>").coalesce(1)
    asked = df.where("doc % 20 = 0").select(F.col("doc").alias("q"), F.col("dv").alias("qv"))
    assert R._blocks(asked, df, 3, [], False).count() == R._blocks(asked, df, 3, [], True).count() == 60


@pytest.mark.parametrize("most", [200, 1 << 20])
def test_numbers_of_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(R, "BLOCK", 9)
    monkeypatch.setattr(R, "CELLS", 30)
    monkeypatch.setattr(R, "QUERY_BYTES", most)
    rows = vectors(2, 50, 4)
    rows[10], rows[11] = (10, None), (11, None)
    kinds = {i: (i * 7) % 3 - 1 for i, _ in rows}
    df = spark.createDataFrame([(i, v, kinds[i], i % 5 == 0) for i, v in rows], "doc long, dv array<double>, kind int, asked boolean").repartition(3)
    asked = df.where("asked").select(F.col("doc").alias("q"), F.col("dv").alias("qv"), "kind")
    want, listed = {}, []
    for q, x in rows[::5]:
        for d, y in rows:
            if q == d or d % 5 == 0 and d < q:
                continue
            kind = "1-1" if kinds[q] == kinds[d] == 1 else "0-0" if kinds[q] == kinds[d] == 0 else "other"
            s = None if x is None or y is None else cosine(x, y)
            want[kind, s] = want.get((kind, s), 0) + 1
            if kind == "other" and s is not None:
                listed.append((-s, q, d))
    assert {(x["kind"], x["s"]): x["n"] for x in pairs.pair_counts(asked, df).collect()} == want
    got = [(x["a"], x["b"], x["s"]) for x in pairs.greatest_pairs(asked, df, "other", 12).collect()]
    assert got == [(q, d, -s) for s, q, d in sorted(listed)[:12]]


def test_ten_million_pairs(spark):
    """None of them leaves its task; each was a row before."""
    df = spark.range(20_000).select(F.col("id").alias("doc"), F.array(*(F.randn(i) for i in range(64))).alias("dv"), (F.col("id") % 3 - 1).cast("int").alias("kind"), (F.col("id") % 40 == 0).alias("asked")).localCheckpoint()
    asked = df.where("asked").select(F.col("doc").alias("q"), F.col("dv").alias("qv"), "kind")
    began = time.time()
    assert pairs.pair_counts(asked, df).agg(F.sum("n")).first()[0] == 500 * 20_000 - 500 - 500 * 499 // 2
    assert R.best_of(asked.drop("kind"), df.select("doc", "dv"), 5, distance=True).count() == 2500
    assert time.time() - began < 60
