"""Chunks are cut where their documents are: no text is moved, whatever the number of headings."""

import pytest

from tarn.operators import chunking, legal

WORDS = "isi pasal yang cukup panjang untuk disimpan sebagai satu bagian tersendiri"


@pytest.fixture(scope="module")
def docs(spark):
    lines = "".join(f"\nPasal {i}\n{WORDS} {i}" for i in range(1, 40))
    text = f"Judul {WORDS}\nMEMUTUSKAN{lines}\nPENJELASAN ATAS {WORDS}\nPasal 1\n{WORDS}"
    spaced = text.replace("\n", " ")
    return spark.createDataFrame([(1, text, False), (2, spaced, True), (3, "cerita " * 400, False), (4, None, True), (5, text, None)], "id long, text string, spaced boolean")


def test_no_text_is_shuffled(docs):
    asked = docs.selectExpr("id", "'qa' as section", "text").unionByName(docs.selectExpr("id", "'intro' as section", "text"))
    for out in (legal.heading_chunks(docs), legal.chunked(docs), legal.question_chunks(docs), legal.two_tracks(asked), legal.line_headings(docs), legal.inline_headings(docs)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_lines_and_of_lost_lines(docs):
    got = {}
    for x in legal.heading_chunks(docs).collect():
        got.setdefault(x["id"], []).append((x["chunk_type"], x["n"], x["chunk"]))
    assert sorted(got) == [1, 2]  # whether letters were spaced is not known of 5: it has no headings
    for i, sep in ((1, "\n"), (2, " ")):
        of = {(k, n): c for k, n, c in got[i]}
        assert len(of) == len(got[i]) == 39 + 1 + 2
        assert all(of["pasal", n] == f"Pasal {n}{sep}{WORDS} {n}" for n in range(1, 40))
        assert of["preamble", None] == f"Judul {WORDS}{sep}MEMUTUSKAN"
        assert of["penjelasan_preamble", None] == f"PENJELASAN ATAS {WORDS}" and of["penjelasan_pasal", 1] == f"Pasal 1{sep}{WORDS}"


def test_pieces_are_numbered_before_and_after_short_ones_go(spark):
    text = "kata " * 300 + "\n\npendek\n\n" + "kata " * 300
    rows = chunking.pieces(spark.createDataFrame([("a", text, False), ("b", text, True), ("c", None, False)], "k string, text string, whole boolean"), ["k"], "whole", overlap=0).collect()
    want = [p for p in enumerate(chunking.split_recursive(text, overlap=0))]
    assert [(x["part"], x["nth"], x["chunk"]) for x in rows if x["k"] == "a"] == [(p, n, c) for n, (p, c) in enumerate(x for x in want if len(x[1]) >= 50)]
    assert [(x["part"], x["nth"], x["chunk"]) for x in rows if x["k"] == "b"] == [(None, 0, text)] and not [x for x in rows if x["k"] == "c"]
