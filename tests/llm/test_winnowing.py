import hashlib
import random

from pyspark.sql import functions as F

from tarn.llm import winnowing as W


def test_edits_and_links(spark):
    r = random.Random(2)
    docs = [(i * 3, " ".join(f"é{r.randint(0, 99)}" for _ in range(r.choice([0, 2, 5, 28, 29, 300])))) for i in range(40)] + [(1000, None), (1001, ""), (1002, "x")]
    rows = {x["id"]: x for x in W.edit_likeness(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(4)).collect()}
    assert len(rows) == len(docs)
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1
        if len(t) > 1000:
            assert rows[i]["near_edited"] > 0.4 > rows[i]["near_next"]


def test_chosen_values_are_the_rightmost_least_of_every_window(spark):
    text = " ".join(str(i * i % 23) for i in range(200))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    words = text.split()
    grams = [r[0] for r in spark.createDataFrame([(i, *words[i : i + 5]) for i in range(196)], "i int, a string, b string, c string, d string, e string").orderBy("i").select(F.xxhash64(*(F.xxhash64(c) for c in "abcde"))).collect()]
    starts = [(g % 2**64) >> W.PLACE_BITS + 1 for g in grams]
    want = []
    for s in range(len(grams) - W.WINDOW + 1):
        part = starts[s : s + W.WINDOW]
        at = max(s + j for j, g in enumerate(part) if g == min(part))
        if not want or want[-1] != at:
            want.append(at)
    values = W.fingerprints(df, id_col="id").first()["values"]
    assert [v["place"] for v in values] == want
    assert [v["hash"] for v in values] == [grams[i] for i in want]


def test_shared_runs_share_a_fingerprint(spark):
    run = " ".join(f"s{i}" for i in range(W.GRAM + W.WINDOW - 1))
    docs = [(1, " ".join(f"a{i}" for i in range(50)) + " " + run), (2, run + " " + " ".join(f"b{i}" for i in range(70))), (3, run), (4, run)]
    h = {r["id"]: set(r["hashes"]) for r in W.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert h[1] & h[2] & h[3] and h[3] == h[4]


def test_empty_single_and_repeated(spark):
    schema = "doc_id long, text string"
    assert W.edit_likeness(spark.createDataFrame([], schema)).collect() == []
    one = W.edit_likeness(spark.createDataFrame([(5, "a b c d")], schema)).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"a b c a").hexdigest() and one[0]["near_next"] == 1.0
    assert len(W.edit_likeness(spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (6, "x y")], schema)).collect()) == 3
    rows = W.edit_likeness(spark.createDataFrame([(None, "abcdefgh"), (1, "12345678"), (1, "123"), (2, "wxyz")], schema)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(r["id"], r["n_chars"], r["edited_sha256"]) for r in rows} == {(None, 8, sha("abcdef12")), (1, 8, sha("123456wx")), (1, 3, sha("123")), (2, 4, sha("wxya"))}


def test_short_texts_and_texts_without_white_space_keep_their_likeness(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    docs = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 8, 14, 20, 27, 28, 29, 37, 60, 111, 112, 113])]
    docs += [(100 + i, "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))) for i, n in enumerate([6, 40, 600, 5000])] + [(200, "abcd"), (201, "wxyz")]
    rows = {x["id"]: x for x in W.edit_likeness(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for i, t in docs:
        assert rows[i]["near_edited"] > (0.3 if len(t) > 10 else 0), (i, t[:50], rows[i]["near_edited"])
        assert rows[i]["near_next"] < 0.1, (i, rows[i]["near_next"])
    one = W.fingerprints(spark.createDataFrame([(1, "ab  cd"), (2, "b cd ef")], "doc_id long, text string")).collect()
    assert [[v["place"] for v in x["values"]] for x in one] == [[0, 0, 1, 2], [0, 0, 1, 2, 3, 4]]
    assert len(set(one[0]["hashes"]) & set(one[1]["hashes"])) == 2


def test_the_next_text_is_compared_in_the_manner_of_the_text(spark):
    r = random.Random(6)
    docs = []
    for n in (1, 2, 4, 5, 6, 10, 26, 27, 28, 29, 110, 111, 112, 113, 500):
        text = " ".join("".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(n))
        docs += [(len(docs), text), (len(docs) + 1, text + " added"), (len(docs) + 2, text)]
    chars = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(4095))
    docs += [(len(docs), chars), (len(docs) + 1, chars + "x"), (len(docs) + 2, chars)]
    rows = {x["id"]: x for x in W.edit_likeness(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for i, t in docs:
        if i % 3 < 2:
            assert rows[i]["near_next"] > (0.8 if len(t.split()) > 9 or len(t) > 4000 else 0.5 if len(t) > 30 else 0.2), (i, len(t.split()), rows[i]["near_next"])
    # rows with equal ids in different manners: each is compared in its own
    long, short = docs[-4][1], docs[3][1]
    twice = W.edit_likeness(spark.createDataFrame([(1, long), (1, short), (2, short), (3, "quite another")], "doc_id long, text string")).collect()
    assert sorted((x["id"], round(x["near_next"], 1)) for x in twice) == [(1, 0.0), (1, 1.0), (2, 0.0), (3, 0.0)]
