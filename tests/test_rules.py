"""Text rules, headings, containment, near pairs, search and sinks against small cases worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import audit, chunking, containment, legal, near, search
from tarn.operators import retrieval as R
from tarn.operators.containment import holders
from tarn.sources import tables
from tarn.streaming import sessions


def one(spark, f, x):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("v")).first()["v"]


def test_stems_and_keys(spark):
    words = "pengurusannya mengurus dibuat kartu ke1 perlindungan 12345678 berkas"
    assert one(spark, lambda x: T.stems(T.content_tokens(x)), words) == ["urus", "urus", "buat", "kartu", "ke1", "lindung", "12345678", "berkas"]
    assert one(spark, lambda x: T.keys(T.content_tokens(x)), "Perlindungan 12345678, yang dan ab") == ["lindun", "12345678"]


def test_flags(spark):
    assert one(spark, T.is_english, "the chapter of an article") and not one(spark, T.is_english, "pasal ini berlaku") and not one(spark, T.is_english, None)
    assert one(spark, T.boilerplate, "Lembaran Negara a b c d e f g h i j k l m n o p q r s t u v") == 0.5
    assert one(spark, T.boilerplate, "x (Jakarta: Penerbit, 2015).") == 1.0
    assert one(spark, T.hard_anchors, "Kirim ke a@b.id 12,5 kg. Oleh Budi Santoso dan Anda. Kota itu") == ["a@b.id", "12,5", "budi", "santoso"]
    assert one(spark, T.clean_cell, "• a \t b\n c ") == "a b\n c"


def test_evidence_and_score(spark):
    docs = spark.createDataFrame([(f"kata{i} umum kartu",) for i in range(20)], "text string")
    rows = [
        (1, "Bagaimana kartu keluarga dibuat cepat", "Kartu keluarga dibuat di Bogor 2020.", ["kartu keluarga dibuat", "Bogor 2020"], "Kartu keluarga dibuat di Bogor sejak 2020 oleh petugas.", 1, 0),
        (2, "Apa", "Semua salah 77.", [], "kartu", 0, 1),
    ]
    cases = spark.createDataFrame(rows, "id int, question string, answer string, facts array<string>, gold string, n_gold long, missing long")
    got = {r["id"]: r for r in audit.scored(audit.evidence(cases, *audit.key_idf(docs))).collect()}
    assert got[1]["fact_mean"] == 1.0 and got[1]["ans_numbers"] == 1.0 and got[1]["n_weak"] == 0
    assert got[1]["tier"] in ("high", "acceptable") and "facts_ungrounded" not in got[1]["flags"]
    assert got[2]["tier"] == "unusable" and {"gold_missing", "no_gold", "no_facts", "question_too_short"} <= set(got[2]["flags"].split(","))
    assert got[2]["score"] < 0.1


#: Texts by line, with what becomes of each: the section and number of a heading that counts, or None.
REGULATIONS = [
    [("MEMUTUSKAN", None), ("Pasal 1", "batang"), ("isi ayat", None), ("Pasal 2", "batang"), ("Pasal 2", None), ("Pasal 1", None), ("Pasal 3", "batang"), ("Pasal 9", "batang"), ("Pasal 4", None)],
    [("Pasal 1", None), ("menimbang", None), ("memutuskan", None), ("pasal 2", "batang")],
    [("Pasal 3", "batang"), ("sebagaimana dalam Pasal 4", None), ("  Pasal   5 berlaku", "batang")],
    [("Memutuskan", None), ("Pasal 1", "batang"), ("Pasal 7", "batang"), ("PENJELASAN ATAS", None), ("Pasal 1", "penjelasan"), ("Pasal 1", None), ("Pasal 8", "penjelasan")],
    [("Pasal  demi  pasal", None), ("Pasal 4", "penjelasan"), ("MEMUTUSKAN", None), ("Pasal 3", None), ("Pasal 6", "penjelasan")],
    [("tanpa judul", None), ("Pasal satu", None)],
]


def test_headings(spark):
    texts, want = [], {}
    for i, lines in enumerate(REGULATIONS):
        at = 0
        for line, section in lines:
            if section:
                # a heading begins with the line break before it
                want.setdefault(i, []).append((max(at - 1, 0), int(line.split()[1]), section))
            at += len(line) + 1
        texts.append((i, "\n".join(line for line, _ in lines)))
    got = {}
    for x in legal.line_headings(spark.createDataFrame(texts, "id int, text string")).orderBy("id", "at").collect():
        got.setdefault(x["id"], []).append((x["at"], x["n"], x["section"]))
    assert got == want


def test_inline_headings_step_and_mentions(spark):
    text = "Mengingat Pasal 2 x MEMUTUSKAN Pasal 1 isi Pasal 9 dimaksud dalam Pasal 2 lalu Pasal 3 dan terus Pasal 40 Pasal 5 akhir"
    rows = legal.inline_headings(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("at").collect()
    assert [x["n"] for x in rows] == [1, 3, 5]


def test_chunks_of_a_regulation(spark):
    words = "isi pasal yang cukup panjang untuk disimpan sebagai satu bagian tersendiri"
    text = f"Judul {words}\nMEMUTUSKAN\nPasal 1\n{words}\nPasal 2\n{'panjang ' * 900}\nPENJELASAN ATAS {words}\nPasal 1\n{words}"
    docs = spark.createDataFrame([(1, text, False), (2, "cerita " * 400, False), (3, None, True)], "id long, text string, spaced boolean")
    rows = legal.chunked(docs).collect()
    kinds = sorted({(x["id"], x["chunk_type"], x["n"]) for x in rows if x["chunk_type"] != "narrative"}, key=str)
    assert kinds == [(1, "pasal", 1), (1, "pasal", 2), (1, "penjelasan_pasal", 1), (1, "penjelasan_preamble", None), (1, "preamble", None)]
    assert {x["part"] for x in rows if x["n"] == 2 and x["id"] == 1} >= {1, 2, 3} and all(len(x["chunk"]) <= 6000 for x in rows)
    assert [x["n"] for x in sorted((x for x in rows if x["id"] == 2), key=lambda x: x["n"])] == [0, 1, 2]


def test_questions(spark):
    text = "\nA. UMUM DAN LAIN\n1. Apakah ini? " + "Ya " * 30 + "\n2 Bagaimana itu? " + "Begitu " * 20
    rows = legal.question_chunks(spark.createDataFrame([(1, text), (2, None)], "id int, text string")).orderBy("number").collect()
    assert [(x["number"], x["question"], x["subsection"]) for x in rows] == [(1, "Apakah ini?", "A. UMUM DAN LAIN"), (2, "Bagaimana itu?", "A. UMUM DAN LAIN")]


@pytest.mark.parametrize("few", [0, 10_000])
def test_holders(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW", few)
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 60))) for _ in range(80)] + [None]
    items = [t[a : a + r.randint(1, 60)] for t in texts[:40] if t for a in [r.randrange(len(t))]] + ["", "nowhere at all in any of them", "w1  w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {(x["doc"], x["k"]) for x in holders(docs, spark.createDataFrame(list(enumerate(items)), "k int, item string")).collect()}
    assert got == {(d, k) for d, t in enumerate(texts) for k, i in enumerate(items) if t is not None and i in t}


def test_near_pairs_and_order(spark):
    r = random.Random(5)
    sets = []
    for i in range(120):
        s = set(r.choice(sets)[1]) if sets and r.random() < 0.6 else {f"t{r.randint(0, 200)}" for _ in range(r.randint(0, 20))}
        for _ in range(r.randint(0, 2)):
            s ^= {f"t{r.randint(0, 200)}"}
        sets.append((i, sorted(s)))
    df = spark.createDataFrame([("b", i, s) for i, s in sets], "bucket string, id long, x array<string>")
    alike = lambda a, b: a and b and 100 * len(set(a) & set(b)) >= 85 * len(set(a) | set(b))
    rep = {i: min(j for j, b in sets if b == s) for i, s in sets}
    want = {(i, j) for i, a in sets for j, b in sets if i < j and alike(a, b) and (rep[j] == i or (rep[i] == i and rep[j] == j))}
    pairs = near.near_pairs(df, 85)
    assert len(want) > 20 and {(x["a"], x["b"]) for x in pairs.collect()} == want
    accepted = []
    for i, s in sets:
        if not any(alike(s, t) for _, t in accepted):
            accepted.append((i, s))
    refused = {x["id"] for x in near.accepted(df, 85).where("not accepted").collect()}
    assert refused == {i for i, _ in sets} - {i for i, _ in accepted}


def test_lists_are_as_long_as_asked_for(spark):
    docs = spark.createDataFrame([(i, "a b" if i == 7 else f"x{i}") for i in range(12)], "doc long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "nothing")], "q long, text string")
    got = {}
    for x in R.bm25_top(docs, asked, 4).orderBy("q", "rank").collect():
        got.setdefault(x["q"], []).append(x["doc"])
    assert got == {1: [7, 0, 1, 2], 2: [0, 1, 2, 3]}


def test_gate_fails_open(spark):
    near_ = spark.createDataFrame([(1, False, 0.7), (1, True, 0.2), (2, False, 0.5), (3, True, 0.9), (3, False, 0.8)], "q long, valid boolean, score double")
    got = {x["q"]: x["intent"] for x in search.gate(near_, spark.createDataFrame([(i,) for i in range(1, 5)], "q long")).collect()}
    assert got == {1: "invalid", 2: "valid", 3: "valid", 4: "valid"}


def test_fusion_by_content_and_rerank_by_the_question_as_asked(spark):
    corpus = spark.createDataFrame([(1, "kartu keluarga", [1.0, 0.0]), (2, "kartu keluarga", [0.9, 0.1]), (3, "akta lahir", [0.0, 1.0])], "doc long, text string, dv array<double>")
    asked = spark.createDataFrame([(9, "akta", [1.0, 0.1], "kartu keluarga")], "q long, text string, qv array<double>, original string")
    pool = search.hybrid(corpus, asked).orderBy("rank").collect()
    assert sorted(x["doc"] for x in pool) in ([1, 3], [2, 3])
    idf, total = audit.key_idf(corpus)
    ranked = search.rerank(search.hybrid(corpus, asked), corpus, asked, idf, total, 2).orderBy("rank").collect()
    assert ranked[0]["doc"] in (1, 2) and ranked[0]["score"] == 1.0 and ranked[1]["score"] == 0.0


def test_json_in_a_column(spark):
    assert one(spark, chunking.first_json_of, 'so {no} {"a": {"b": "}"}} end') == '{"a": {"b": "}"}}'
    assert one(spark, chunking.first_json_of, None) is None


def test_traces_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-02 10:00:00", "b")], "s string, id string").select(F.col("s").cast("timestamp_ntz").alias("ts"), "id")
    tables.append_traces(rows, str(tmp_path / "t"))
    tables.append_traces(rows.limit(1), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).groupBy("day").count().count() == 2 and spark.read.json(str(tmp_path / "t")).count() == 3
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, id string").parquet(str(tmp_path / "in"))
    sessions.trace_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").glob("day=*")) == ["day=2024-01-01", "day=2024-01-02"]


@pytest.mark.parametrize("most", [0, 64 << 20])
def test_dense_search_in_blocks_and_in_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(R, "QUERY_BYTES", most)
    monkeypatch.setattr(R, "BLOCK", 7)
    r = random.Random(2)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)], i % 3) for i in range(60)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0], g) for i, v, g in rows]
    df = spark.createDataFrame(rows, "doc long, dv array<float>, g int").repartition(3)
    asked = df.where("doc % 10 = 0").select(F.col("doc").alias("q"), F.col("dv").alias("qv"), F.col("g").alias("own"))
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 4) + 0.0
    for by in ([], ["g"]):
        got = {(x["q"], x["g"] if by else 0, x["rank"]): (x["doc"], round(x["score"], 4) + 0.0, x["own"]) for x in R.dense(asked, df, F.round(R.dot("qv", "dv"), 4), 4, by, unit=True).collect()}
        want = {}
        for q, v, own in rows[::10]:
            for g in range(3) if by else [0]:
                near_ = sorted((-cos(v, w), d) for d, w, h in rows if d != q and (not by or h == g))[:4]
                want.update({(q, g, n + 1): (d, -s + 0.0, own) for n, (s, d) in enumerate(near_)})
        assert got == want
    assert R.dense(asked.limit(0), df, F.lit(0.0), 4, unit=True).count() == 0 and R.dense(asked, df.limit(0), F.round(R.dot("qv", "dv"), 4), 4, unit=True).count() == 0
