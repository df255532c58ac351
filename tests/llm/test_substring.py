import random

import brute
import pytest

from tarn.llm import substring as S


def texts(seed, n=80):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(9)]
    passages = [r.choices(v, k=r.randint(15, 45)) for _ in range(6)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(0, 4)):
            w += r.choice(passages) if r.random() < 0.7 else r.choices(v, k=r.randint(1, 30))
        if w and r.random() < 0.3:
            w[r.randrange(len(w))] = "é"
        out.append(r.choice([" ", "\n", " \t"]).join(w))
    return out


@pytest.mark.parametrize(("window", "batches", "fan"), [(12, 1, 3), (12, 4, 1), (20, 2, 3), (5, 3, 2), (9, 4, 2)])
def test_same_as_brute_force(spark, monkeypatch, window, batches, fan):
    docs = list(enumerate(texts(window))) + [(900, None), (901, ""), (902, " ")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, s int, anchor string").repartition(3)
    make, made = S.FingerprintIndex, []
    monkeypatch.setattr(S, "FingerprintIndex", lambda spark, w: made.append(make(spark, w, fan)) or made[-1])
    monkeypatch.setattr(S, "HOLDERS", 3 * fan)
    rows = S.substring_dedup(df, window=window, batches=batches, with_text=True).collect()
    assert made[0].compacted == {(1, 3): 0, (4, 1): 3, (2, 3): 0, (3, 2): 1, (4, 2): 1}[batches, fan]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("spans_")]
    assert {r[0]: tuple(r)[1:4] for r in rows} == brute.substring(docs, window)
    was = dict(docs)
    assert all(r["kept_text"] == was[r["id"]] for r in rows if not r["n_removed"])


def test_empty_and_repeated_rows(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = " ".join(f"x{i % 7}" for i in range(3000))
    docs = [(1, long), (1, long), (2, long), (3, "a b"), (None, long), (None, None)]
    got = sorted((tuple(r)[:3] for r in S.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    assert got == [(1, 3000, 0), (1, 3000, 0), (2, 3000, 3000), (3, 2, 0), (None, 0, 0), (None, 3000, 0)]


def test_equal_fingerprints_of_unequal_words_are_told_apart():
    words = [f"w{i}" for i in range(60)]
    other = [*words[:30], "else", *words[31:]]
    docs = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:55]))]
    batches = iter([S.pa.RecordBatch.from_pydict({"id": [1], "text": [docs[0][1]], "asked": [[{"anchor": 0, "span": 0, "last": 3, "n": 3, "s": 0, "e": 10, "several": False}]]})])
    known = next(S._known(batches, 50)).to_pylist()[0]
    cuts = [[{"s": 0, "e": 10, "words": known["words"]}], None]
    rows = S.pa.RecordBatch.from_pydict({"id": [2, 3], "text": [docs[1][1], docs[2][1]], "cuts": cuts})
    assert next(S._cut(iter([rows]), 50, False)).column("n_removed").to_pylist() == [0, 0]
    same = S.pa.RecordBatch.from_pydict({"id": [4], "text": [docs[0][1]], "cuts": cuts[:1]})
    assert next(S._cut(iter([same]), 50, False)).column("n_removed").to_pylist() == [60]


def test_places_in_stretches(monkeypatch):
    g = S.np.random.default_rng(2).integers(0, 2**63, 1000, dtype=S.np.uint64) << S.np.uint64(30)
    want = [max(range(i, i + 43), key=lambda j: (-int(g[j] & ~S._POSITION), j)) for i in range(1000 - 42)]
    for stretch in (7, 100, 5000):
        monkeypatch.setattr(S, "STRETCH", stretch)
        assert S.least_places(g, 43).tolist() == want


def test_runs_are_merged_without_moving_them_and_compacted_to_one_row_a_span(spark):
    index = S.FingerprintIndex(spark, 12)
    docs = spark.createDataFrame(list(enumerate(texts(3))), "id long, text string")
    first = docs.where("id < 40")
    index.add(first, first)
    index.add(docs.where("id >= 40"), docs)
    a, b = (spark.table(n) for n in index.runs)
    plan = b.join(a.select("anchor"), "anchor", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan or "Exchange" not in plan
    spans = {(r["anchor"], r["span"]): r["id"] for t in (b, a) for r in t.collect()}
    index.compact()
    (name,) = index.runs
    got = spark.table(name).collect()
    assert len(got) == len(spans) and {(r["anchor"], r["span"]): r["id"] for r in got} == spans
    index.delete()
