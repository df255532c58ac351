import pytest
from pyspark.errors import PySparkException

from tarn.operators import guards as G
from tarn.streaming import results as W


def fails(df, words):
    with pytest.raises(PySparkException, match=words):
        df.collect()


def test_unknown_ids_abort(spark, tmp_path):
    tests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, gold string")
    good = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id long, score double")
    joined, missing = G.scored_with_tests(good, tests)
    assert sorted(map(tuple, joined.collect())) == [(1, 0.5, "a"), (2, 0.7, "b")] and [r["id"] for r in missing.collect()] == [3]
    bad = G.scored_with_tests(good.unionByName(spark.createDataFrame([(9, 0.1), (8, 0.1)], "id long, score double")), tests)[0]
    fails(bad, "unknown ids: 2, the first is 8")
    with pytest.raises(PySparkException):
        bad.write.parquet(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*.parquet")) if (tmp_path / "out").exists() else True
    fails(G.scored_with_tests(good, tests.unionByName(tests))[0], "repeated test ids: 3")


def test_question_sets(spark):
    rows = [("a", "x?", "valid"), ("b", "y?", "valid"), ("c", "z?", "invalid")]
    make = lambda r: spark.createDataFrame(r, "id string, question string, label string")
    assert G.question_set(make(rows), {"valid": 2, "invalid": 1}).count() == 3
    fails(G.question_set(make([*rows, ("a", "w?", "valid")])), "repeated ids: 1, the first is a")
    fails(G.question_set(make([*rows, (None, "w?", "valid")])), "missing ids")
    fails(G.question_set(make([*rows, ("d", "  ", "valid")])), "blank questions: 1, the first is d")
    fails(G.question_set(make(rows), {"valid": 3, "invalid": 1}), "wrong sizes: 1, the first is valid: 2 for 3")
    fails(G.question_set(make(rows), {"valid": 2}), "invalid: 1 for 0")


def test_cached_vectors(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, text string")
    keyed = rows.select("id", G.cache_key("m", 2, rows["id"], rows["text"]).alias("key")).collect()
    key = {r["id"]: r["key"] for r in keyed}
    cache = lambda r: spark.createDataFrame(r, "key string, vector array<double>")
    hits, rest = G.cached_vectors(rows, cache([(key[1], [0.0, 1.0]), ("other", [])]), "m", 2)
    assert [(r["id"], r["vector"]) for r in hits.collect()] == [(1, [0.0, 1.0])] and sorted(r["id"] for r in rest.collect()) == [2, 3]
    assert G.cached_vectors(rows, cache([(key[1], [0.0, 1.0])]), "m2", 2)[1].count() == 3
    fails(G.cached_vectors(rows, cache([(key[1], [0.0])]), "m", 2)[0], "wrong dimensions")
    fails(G.cached_vectors(rows, cache([(key[1], [])]), "m", 2)[0], "wrong dimensions")
    fails(G.cached_vectors(rows, cache([(key[1], [0.0, 1.0])] * 2), "m", 2)[0], "repeated keys")


def test_directory_assertions(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 44)], "nomor int")
    assert G.sized_between(G.complete_numbers(rows, "nomor", 1, 43), 40, 50).count() == 43
    fails(G.complete_numbers(rows.where("nomor <> 7"), "nomor", 1, 43), "missing numbers: 1, the first is 7")
    fails(G.sized_between(rows, 44, 50), "wrong number of rows: 1, the first is 43")


def test_file_order(spark, tmp_path):
    for name, ids in (("b", [5, 3]), ("a", [9, 1, 4])):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.parquet(str(tmp_path / name))
        (tmp_path / "all").mkdir(exist_ok=True)
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"all/{name}.parquet")
    got = G.in_file_order(spark.read.parquet(str(tmp_path / "all"))).orderBy("ordinal").collect()
    assert [(r["id"], r["ordinal"]) for r in got] == [(9, 0), (1, 1), (4, 2), (5, 3), (3, 4)]


def test_a_killed_run_goes_on(spark, tmp_path):
    source, out, schema = tmp_path / "in", str(tmp_path / "out"), "id long, answer string"
    for k in range(3):
        rows = [(k * 4 + i, f"r{k}{i}") for i in range(4)] + [(1, "again"), (k * 4, "twice"), (None, "nobody")]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / str(k)))
        (tmp_path / "flat").mkdir(exist_ok=True)
        next((source / str(k)).glob("*.parquet")).rename(tmp_path / f"flat/{k}.parquet")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))

    def killed(batch):
        if batch == 1:  # saved, but the stream doesn't know yet
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        W.run(stream(), out, str(tmp_path / "cp"), after=killed).awaitTermination(120)
    (tmp_path / "out/_staged-2-x").mkdir()
    (tmp_path / "out/_staged-2-x/part.parquet").write_text("half a file")
    assert W.saved(spark, out, schema).count() == 8
    W.run(stream(), out, str(tmp_path / "cp")).awaitTermination(120)
    ids = sorted(r["id"] for r in W.saved(spark, out, schema).collect())
    assert ids == list(range(12))
    tests = spark.createDataFrame([(i, 1000 * (11 - i)) for i in range(2, 12)], "id long, ordinal long")
    placed = W.in_order(W.saved(spark, out, schema), tests).orderBy("place").collect()
    assert [r["id"] for r in placed] == [*range(11, 1, -1), 0, 1] and [r["place"] for r in placed] == list(range(1, 13))
    candidates = spark.createDataFrame([(i,) for i in range(10, 15)], "id long")
    assert sorted(r["id"] for r in W.unused(candidates, W.saved(spark, out, schema), candidates.where("id = 13")).collect()) == [12, 14]
