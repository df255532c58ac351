import random

import brute
import pyarrow as pa
import numpy as np
import pytest

from tarn.llm import jaccard as J


def texts(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    shared = [" ".join(r.choices(vocabulary, k=30)) for _ in range(3)]
    out = []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.5:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w) if r.random() < 0.5 else " ".join(w).lower())
        elif kind < 0.6:
            out.append(" ".join(r.choices(vocabulary, k=r.randint(0, 6))))
        else:
            out.append(" ".join(r.choices(vocabulary, k=r.randint(5, 90))) + " " + r.choice(shared))
    return out


@pytest.mark.parametrize(("frequent", "tile"), [(3, 4), (48, 256), (1000, 5)])
def test_same_components_as_all_pairs(spark, monkeypatch, frequent, tile):
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "BUCKET", 2000)
    docs = list(enumerate(texts(frequent))) + [(900, None), (901, ""), (902, " \t\n"), (903, "x"), (904, "X")]
    df = spark.createDataFrame([(i, t, "src") for i, t in docs], "doc_id long, text string, rep string").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in J.jaccard_join(df)["documents"].collect()}
    assert got == brute.jaccard(docs)


@pytest.mark.parametrize("tile", [4, 256])
def test_every_link_between_different_sets(spark, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE", tile)
    docs = list(enumerate(texts(7)))
    got = J.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), every_link=True)
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for i, t in docs for w in [brute.WORD.findall(brute.lower(t))]}
    least = {}
    for i, s in sets.items():
        if s:
            least.setdefault(s, i)
    reps = sorted(least.values())
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(want) > 30 and {tuple(r) for r in got["links"].collect()} == want
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got["documents"].collect()} == brute.jaccard(docs)


def test_sets_that_link_are_in_neighbouring_bands(spark):
    pairs = [(a, b) for a in range(1, 400) for b in range(a, min(a * 4 // 3, 399) + 1) if 100 * a >= 75 * b]
    df = spark.createDataFrame(pairs, "a long, b long").select((J.band(J.F.col("b"), 75) - J.band(J.F.col("a"), 75)).alias("d"))
    assert {r["d"] for r in df.distinct().collect()} == {0, 1}


def test_null_ids_are_linked_with_nothing(spark):
    docs = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (7, "A b c d e f")]
    rows = J.jaccard_join(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, band int"))["documents"].collect()
    assert sorted(map(tuple, rows), key=repr) == [(4, 2, 4), (7, 2, 4), (None, 0, None), (None, 2, None)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_join(df)["documents"].collect() == []


def test_repeated_rows_and_many_copies(spark):
    near = [(i, " ".join(f"a{j}" if j != i % 60 else f"z{i}" for j in range(60))) for i in range(80)]
    docs = [*near, *[(1000 + i, "one two three four five six") for i in range(50)], (1000, "one two three four five six")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = J.jaccard_join(df)["documents"].collect()
    assert len(rows) == len(docs)
    want = brute.jaccard(docs)
    assert {(r[0], r[1], r[2]) for r in rows} == {(i, *want[i]) for i, _ in docs}


def test_shared_rows_of_sorted_batches():
    r = random.Random(4)
    for _ in range(300):
        given = sorted((r.randint(0, 6), r.randint(0, 9)) for _ in range(r.randint(0, 12)))
        batches, i = [], 0
        rows = sorted(set(given))
        while i < len(given):
            j = i + r.randint(1, 3)
            batches.append(pa.RecordBatch.from_arrays([pa.array(np.array([x[c] for x in given[i:j]], np.int64)) for c in (0, 1)], names=["token", "id"]))
            i = j
        got = [tuple(x.values()) for b in J._shared(iter(batches)) for x in b.to_pylist()]
        want = [(t, i, min(y for x, y in rows if x == t)) for t, i in rows if sum(x == t for x, _ in rows) > 1]
        assert sorted(got) == sorted(want)


def test_differing_bits_bound_the_difference():
    r = np.random.default_rng(3)
    for n, m in [(40, 50), (500, 620), (700, 500), (5000, 6000), (1025, 1024)]:
        both = r.integers(0, 2**64, min(n, m) // 2, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 2**64, k - len(both), dtype=np.uint64)])) for k in (n, m))
        only = len(np.setxor1d(a, b))
        assert 0.4 * min(only, 200) < J.differing(J.bitmap(a), J.bitmap(b)) <= only
