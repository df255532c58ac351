import json

from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import chunking, retrieval, selection
from tarn.sources import tables
from tarn.streaming import sessions


def one(spark, f, *values):
    names = "xyz"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names)).alias("v")).first()["v"]


def test_cleaning(spark):
    assert one(spark, T.clean_page, "a\nb") == "a b"
    assert one(spark, T.clean_page, "a.\nb") == "a.\nb"
    assert one(spark, T.clean_page, "x\n 12 \ny") == "x\n y"
    assert one(spark, T.clean_page, "x.....y \t z\n\n\n\nQ.") == "xy z\n\n Q."


def test_cells(spark):
    cell = "Jl. A\nx@y.id.\nlt 2"
    assert one(spark, T.address_of, cell) == "Jl. A lt 2" and one(spark, T.email_of, cell) == "x@y.id"
    assert one(spark, T.address_of, None) == "" and one(spark, T.email_of, None) is None
    assert one(spark, T.phones_of, "1 / 2\n/ ") == ["1", "2"]
    assert one(spark, T.sub_letter, "a. Bagian X") == "a" and one(spark, T.sub_name, "a. Bagian X") == "Bagian X"
    assert one(spark, T.sub_letter, "Induk") is None and one(spark, T.sub_name, "Induk") == "Induk"


def test_spaced_letters(spark):
    assert one(spark, T.despaced_lines, "C a t a t a n\na b") == "Catatan\na b"
    assert one(spark, T.despaced_lines, "s a t u  d u a") == "satu dua"
    page = "P a s a l\n1 2\n" + " ".join("abcdefghijklmnopqrstuv")
    assert one(spark, T.fix_charspacing, page) == "Pasal 12 abcdefghijklmnopqrstuv"
    assert one(spark, T.rebuilt_page, "P a s a l 1 2") == "Pasal 12"


def test_number_support(spark):
    assert one(spark, T.number_support, "1 of 20, 30 and 4", "20 x30 4") == 2 / 3
    assert one(spark, T.number_support, "none", "x") == 1.0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 11, 1), (1, 99, 2), (1, 11, 3), (1, 12, 4), (3, 5, 1)], "q long, doc long, rank int")
    gold = spark.createDataFrame([(1, 11), (1, 12), (1, 13), (2, 7)], "q long, doc long")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "q long")
    got = {r["q"]: tuple(r)[1:] for r in retrieval.ranking_metrics(ranked, gold, asked, 5).collect()}
    assert got == {1: (1.0, 0.666667, 0.75, 1.0), 2: (0.0, 0.0, 0.0, 0.0), 3: (None, None, None, None)}


def test_votes(spark):
    rows = [(1, True, 0.75), (1, True, 0.25), (1, False, 0.5), (1, False, 0.5), (2, True, 0.1), (3, False, 0.9), (4, True, 0.9), (4, False, 0.8)]
    got = {r["q"]: r["predicted"] for r in retrieval.knn_vote(spark.createDataFrame(rows, "q long, valid boolean, score double")).collect()}
    assert got == {1: "INVALID", 2: "VALID", 3: "INVALID", 4: "VALID"}


def test_fusion_prefers_first_appearance(spark):
    rows = [(1, 5, 2, 1), (1, 6, 1, 1), (1, 7, 1, 2), (1, 6, 2, 2)]
    got = retrieval.rrf(spark.createDataFrame(rows, "q long, doc long, list_no int, rank int"), {1: 0.5, 2: 0.5}).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [6, 5, 7] or [r["doc"] for r in got] == [6, 7, 5]
    tied = retrieval.rrf(spark.createDataFrame([(1, 5, 2, 1), (1, 6, 1, 1)], "q long, doc long, list_no int, rank int"), {1: 0.5, 2: 0.5}).orderBy("rank").collect()
    assert [r["doc"] for r in tied] == [6, 5]


def test_recursive_split_covers_the_text():
    text = "\n".join(f"Sentence number {i} of a text. It goes on." for i in range(200))
    parts = chunking.split_recursive(text, 300, 60)
    assert all(len(p) <= 300 for p in parts)
    assert all(f"number {i} of" in " ".join(parts) for i in range(200))
    assert chunking.split_recursive("", 10, 2) == [] and chunking.split_recursive("a" * 25, 10, 0) == ["a" * 10, "a" * 10, "a" * 5]


def test_first_json():
    assert json.loads(chunking.first_json('say ```json\n{"a": "}\\"{", "b": {"c": 1}} rest')) == {"a": '}"{', "b": {"c": 1}}
    assert chunking.first_json("none") is None and chunking.first_json(None) is None and chunking.first_json("{open") is None


def test_greedy_selection(spark):
    rows = [("b", 1, "x", 1.0), ("b", 2, "x", 0.9), ("b", 3, "y", 0.7), ("b", 4, "x", 0.8)]
    got = selection.greedy_selection(spark.createDataFrame(rows, "bucket string, id long, grp string, score double"), 3).orderBy("place").collect()
    assert [r["id"] for r in got] == [1, 3, 2]


def test_tables(spark, tmp_path):
    cells = spark.createDataFrame([(1, ["No", "x"]), (1, [None, "y"]), (2, ["1", "z"])], "page int, cells array<string>")
    assert tables.table_rows(cells).count() == 2
    rows = [("d", 0, None, "orphan", "r"), ("d", 1, "1", "A", "p"), ("d", 2, "", "B", "q"), ("d", 3, None, "a. C", ""), ("d", 4, "2", "D", None)]
    got = tables.merged_rows(spark.createDataFrame(rows, "doc string, place int, number string, name string, rest string")).orderBy("place").collect()
    assert [(r["number"], r["name"], r["rest"]) for r in got] == [("1", "A B", "p\nq"), (None, "a. C", ""), ("2", "D", "")]
    (tmp_path / "q.json").write_text(json.dumps({"_meta": 1, "questions": [{"id": "a", "question": "x"}, {"id": "b", "question": "y"}]}))
    assert tables.questions(spark, str(tmp_path / "q.json"), "id:string,question:string").count() == 2
    (tmp_path / "log.json").write_text('{"id": "a"}\n{broken\n')
    assert [r["id"] for r in tables.tolerant_log(spark, str(tmp_path / "log.json"), "id string").collect()] == ["a"]
    here, gone = tables.manifest(spark.createDataFrame([("q.json",), ("no.pdf",)], "filename string"), tables.files(spark, str(tmp_path), "*.json"))
    assert [r[0] for r in here.collect()] == ["q.json"] and gone.first()["reason"] == "file_missing"
    parts = {"a": spark.createDataFrame([(1, "t")], "id long, text string"), "b": spark.createDataFrame([(1, 2)], "id long, page int")}
    assert tables.write_index(tables.unified(parts), str(tmp_path / "index")) == 2
    assert spark.read.parquet(str(tmp_path / "index")).where("domain = 'b'").first()["id"] == "b:1"


def test_streamed_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:10:00"), (9, "2024-01-09 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, s string").select("user_id", F.col("s").cast("timestamp_ntz").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    sessions.run_sessions(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "user_id long, ts timestamp_ntz").awaitTermination()
    got = {(r["user_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2), (1, 1), (2, 1)}
