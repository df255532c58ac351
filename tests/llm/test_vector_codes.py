import math
import random

import numpy as np
import pytest

from tarn.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label string, q int, code int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """([(id, code, error, label error)], codebooks) in plain Python; rows (id, vector, label), all of one length."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: r[0])
    whole = [[math.floor(scale * x) for x in v] for _, v, _ in kept]
    w = len(whole[0]) // parts
    cut = [[q[p * w : p * w + w] for p in range(parts)] for q in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for i in range(rounds + 1):
        got = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if i < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [c[p] for c, g in zip(cut, got) if g[p][1] == e]
                    if mine:
                        books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    errors, by = [sum(d for d, _ in g) for g in got], {}
    for (_, _, label), e in zip(kept, errors):
        by[label] = by.get(label, 0) + e
    return [(k[0], "".join(f"{e:02x}" for _, e in g), err, by[k[2]]) for k, g, err in zip(kept, got, errors)], books


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], SCHEMA)
    out = V.vector_codes(df.repartition(3), **options)
    by = {r["label"]: r["label_error"] for r in out["labels"].collect()}
    return sorted((r["id"], r["code"], r["error"], by[r["label"]]) for r in out["codes"].collect()), out


@pytest.mark.parametrize("seed,kind", [(1, "even"), (2, "ties"), (3, "far")])
def test_same_codes_as_plain_lloyd(spark, seed, kind):
    r = random.Random(seed)
    draw = {"even": lambda: r.uniform(-1, 1), "ties": lambda: r.choice([0, 1, -1]) / 1024, "far": lambda: r.choice([1e3, -1e3, 0.5]) * r.random()}[kind]
    rows = [(i * 3, [draw() for _ in range(8)], r.choice(["a", "b", None])) for i in range(150)]
    rows += [(1000, None, "a"), (1001, [None] + [0.5] * 7, "a"), (1002, [math.nan] * 8, "b"), (1003, [math.inf] * 8, "b"), (1004, rows[5][1], "z")]
    got, out = found(spark, rows, entries=20)
    want, books = brute(rows, entries=20)
    assert got == want
    assert out["codebooks"].tolist() == books
    assert out["scans"][0] == 4 * len(want) and sum(out["scans"][1:]) < 4 * 4 * len(want)


def test_bounds_spare_most_scans(spark):
    r = random.Random(4)
    centres = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.01) for x in centres[i % 12]], None) for i in range(400)]
    got, out = found(spark, rows, entries=12)
    assert got == brute(rows, entries=12)[0]
    assert out["scans"][0] == 1600 and out["scans"][-1] < 200


def test_values_beyond_doubles_are_exact():
    x = np.array([[1 << 27, -(1 << 27) + 1], [3, -5]], np.int64)
    d = V.distances(x, x)
    assert d.tolist() == [[0, sum((int(a) - int(b)) ** 2 for a, b in zip(*x))]] * 1 + [[sum((int(a) - int(b)) ** 2 for a, b in zip(*x)), 0]]


def test_odd_tables(spark):
    assert found(spark, [])[0] == []
    assert found(spark, [(None, [1.0] * 4, "a")])[0] == []
    rows = [(1, [0.5, 0.25], None), (1, [0.5, 0.25], None), (2, [], "x"), (3, [1e300] * 5, "x"), (None, [0.5], "x")]
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], SCHEMA)
    out = V.vector_codes(df)
    got = [(r["id"], r["code"]) for r in out["codes"].collect()]
    assert len(got) == 5 and {i for i, _ in got} == {1, 2, 3, None}
    assert out["codebooks"].shape[2] == 2 and len({c for i, c in got if i == 1}) == 1
    assert all(len(c) == 8 for _, c in got)


def test_decoding_gives_the_entries(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], None) for i in range(30)]
    got, out = found(spark, rows, entries=8)
    back = {x["id"]: x["vector"] for x in V.decoded(out["codes"], out["codebooks"]).collect()}
    for i, v, _ in rows:
        error = sum((math.floor(1024 * a) - round(1024 * b)) ** 2 for a, b in zip(v, back[i]))
        assert error == next(e for j, _, e, _ in got if j == i)
